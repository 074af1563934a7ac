"""Token counts under a unigram vocabulary, without building the tokens.

An Aho-Corasick automaton lists all vocabulary pieces that end at each place of a text, and dynamic
programming carries the best score and its number of pieces. No path is kept. Blanks become the
word mark, one goes before the text. Where no piece covers a single character, the character
costs the least score minus a penalty and counts one piece per UTF-8 byte.

Ties: among equal scores the piece that starts first, so the longest one, wins; an uncovered character
comes last. That is the rule of the unigram tokenizers this counts for. Scores are whole numbers, so
sums are exact and a tie is a tie wherever it stands in a text.

A piece never holds a word mark behind another character (this is checked), so the best path goes
through every word's start, and each distinct word is solved once per worker.

Defined results: a null text is an empty one with no tokens; rows that repeat are counted each on its own; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from atalaya.llm.frames import chunks, documents, small_batches

MARK = "▁"
#: Penalty of an uncovered character in natural-log units, as unigram tokenizers have it.
UNCOVERED = 10
#: Score units in one natural-log unit.
SCALE = 1000
#: Words kept by one Python worker; beyond that the cache starts anew. Bounds memory only.
CACHE_WORDS = 500_000


def zipf_vocabulary(model_file: str) -> list[tuple[str, int]]:
    """Ordinary pieces of a model file with whole-number log-probabilities.

    The file orders its pieces by rank; the score of rank k is that of Zipf's law,
    -ln(k + 2) in thousandths. Control and byte pieces are left out. The vocabulary is given, nothing is trained.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_file)
    kept = [
        model.id_to_piece(i) for i in range(model.get_piece_size())
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
    ]
    return [(piece, -round(SCALE * math.log(rank + 2))) for rank, piece in enumerate(kept)]


class UnigramCounter:
    """Best score and number of pieces of words and texts."""

    def __init__(self, vocabulary: list[tuple[str, int]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.uncovered = min(score for _, score in vocabulary) - UNCOVERED * SCALE
        # A cut before each word mark that follows another character is safe only then.
        self.by_word = not any(MARK in piece.lstrip(MARK) for piece, _ in vocabulary)
        self.single = {piece for piece, _ in vocabulary if len(piece) == 1}
        self.known: dict[str, tuple[int, int]] = {}

    def solve(self, text: str) -> tuple[int, int]:
        """(score, pieces) of a text that already has its word marks."""
        size = len(text)
        best, count = [None] * (size + 1), [0] * (size + 1)
        best[0], done = 0, 0

        def close(upto: int) -> None:
            # Places behind which no more piece ends: add the uncovered character, if there is one.
            nonlocal done
            while done < upto:
                char = text[done]
                if char not in self.single:
                    score = best[done] + self.uncovered
                    if best[done + 1] is None or score > best[done + 1]:
                        best[done + 1], count[done + 1] = score, count[done] + len(char.encode("utf-8", "surrogatepass"))
                done += 1

        for end, (length, score) in self.automaton.iter(text):
            # Pieces arrive by end, and at one end the longest first.
            close(end)
            start = end + 1 - length
            score += best[start]
            if best[end + 1] is None or score > best[end + 1]:
                best[end + 1], count[end + 1] = score, count[start] + 1
        close(size)
        return best[size], count[size]

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores and piece counts of plain texts."""
        if not self.by_word:
            solved = [self.solve(MARK + t.replace(" ", MARK)) if t else (0, 0) for t in texts]
            return tuple(np.array([s[k] for s in solved], np.int64) for k in (0, 1))
        # Words between blanks. Runs of blanks leave empty words, which join the mark of the next one.
        # A word mark that the text itself has is as good as a blank.
        words = [t.replace(MARK, " ").split(" ") if t else [] for t in texts]
        for line in words:
            if "" in line:
                line[:] = _joined(line)
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        known = self.known
        for word in set().union(*words) - known.keys():
            known[word] = self.solve(MARK + word)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        found = np.array(list(map(known.__getitem__, itertools.chain.from_iterable(words))), np.int64).reshape(-1, 2)
        sums = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(found, axis=0)])
        borders = np.concatenate([[0], np.cumsum(sizes)])
        per_text = np.diff(sums[borders], axis=0)
        return per_text[:, 0], per_text[:, 1]


def _joined(words: list[str]) -> list[str]:
    """Empty words are further marks of the word that follows; marks at the end stand alone."""
    out, marks = [], 0
    for i, word in enumerate(words):
        if word or i == len(words) - 1:
            out.append(MARK * marks + word)
            marks = 0
        else:
            marks += 1
    return out


@lru_cache(maxsize=1)
def counter(model_file: str) -> UnigramCounter:
    """One automaton and cache per Python worker."""
    return UnigramCounter(zipf_vocabulary(model_file))


def token_counts(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens and score (in thousandths) of every whole text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(model_file)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            solved = [tool.count(texts[a:b]) for a, b in chunks(texts)] or [(np.zeros(0, np.int64),) * 2]
            scores, counts = (np.concatenate([s[k] for s in solved]) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(scores)], ["doc_id", "n_tokens", "score"])

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, score long")
