"""Ids of whole texts by a word-level tokenizer file, with a cache of words.

The tokenizer drops white space and never joins what a blank separates. So a column of texts is
cut at blanks and line ends and numbered by distinct words in Arrow, Python looks up the distinct
words only, and the ids of a text are gathered from the words' ids.
"""

from __future__ import annotations

import itertools
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What one Python worker keeps: characters of words plus `WORD_COST` for each word; beyond that the cache starts
#: anew. Longer words than `KEPT_WORD` are never kept. Bounds memory only.
CACHE_CHARS = 40_000_000
WORD_COST = 100
KEPT_WORD = 128


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """`flat[s:s + n]` for each (s, n), concatenated."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


class Pieces:
    """Growing store of integer sequences, addressed by the order in which they came."""

    def __init__(self, dtype):
        self.flat, self.used = np.empty(1 << 16, dtype), 0
        self.starts, self.lengths, self.count = np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64), 0

    @staticmethod
    def _room(array: np.ndarray, need: int) -> np.ndarray:
        if need <= len(array):
            return array
        grown = np.empty(max(need, 2 * len(array)), array.dtype)
        grown[: len(array)] = array
        return grown

    def extend(self, values: np.ndarray, lengths: np.ndarray) -> None:
        self.flat = self._room(self.flat, self.used + len(values))
        self.flat[self.used : self.used + len(values)] = values
        n = len(lengths)
        self.starts, self.lengths = self._room(self.starts, self.count + n), self._room(self.lengths, self.count + n)
        ends = self.used + np.cumsum(lengths)
        self.starts[self.count : self.count + n] = ends - lengths
        self.lengths[self.count : self.count + n] = lengths
        self.used, self.count = self.used + len(values), self.count + n

    def of(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the sequences, concatenated, and the length of each."""
        lengths = self.lengths[index]
        return gather(self.flat, self.starts[index], lengths), lengths


#: What the word tokenizer takes apart inside a word; fixed by the tokenizer file.
INSIDE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of these characters alone are taken apart here; for all others the library does it.
#: None of them composes with another one, is white space or has a lower case that depends on its place.
PLAIN = r"[!-~\u00a1-\u024f]+"

#: Marks at the end of a word are a piece of their own anyway, so a blank before them keeps "word", "word." and "word,"
#: one entry. Only after plain letters and digits and before a blank: there neither composition nor the lower case of
#: a letter, which may look past marks at other letters, sees the difference.
DETACHED = (r"([0-9A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}])([!-&(-/:-@\[-`{-~]+)( |$)", r"\1 \2\3")


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class WordIds:
    """Token ids of texts; exact for lower-casing BPE tokenizers with word ends that drop white space."""

    def __init__(self, file: str):
        import regex
        from tokenizers import Tokenizer

        from atalaya.llm.bpe import PairMerger

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True
        with open(file, encoding="utf-8") as text:
            model = json.load(text)["model"]
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        pairs = {(vocabulary[a], vocabulary[b]): rank for rank, (a, b) in enumerate(merges)}
        self.merger = PairMerger(pairs, np.array([vocabulary[a + b] for a, b in merges], np.int32))
        self.inner = np.array([vocabulary[c] for c in byte_symbols()], np.int32)
        self.last = np.array([vocabulary[c + end] for c in byte_symbols()], np.int32)
        self.inside, self.plain = regex.compile(INSIDE).findall, re.compile(PLAIN).fullmatch
        self.clear()

    def clear(self) -> None:
        self.index, self.pieces, self.kept = {}, Pieces(np.uint32), 0

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, concatenated, and how many each has."""
        plain = [self.inside(w.lower()) if self.plain(w) else None for w in words]
        cores: dict[str, int] = {}
        for line in plain:
            for core in line or ():
                cores.setdefault(core, len(cores))
        data = [c.encode() for c in cores]
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        raw = np.frombuffer(b"".join(data), np.uint8)
        ids = self.inner[raw]
        ends = np.cumsum(lengths) - 1
        ids[ends] = self.last[raw[ends]]
        found = Pieces(np.uint32)
        found.extend(*self.merger.merge(ids, lengths))
        others = [w for w, line in zip(words, plain, strict=True) if line is None]
        for encoding in self.tokenizer.encode_batch(others, add_special_tokens=False) if others else ():
            found.extend(np.array(encoding.ids, np.uint32), np.array([len(encoding.ids)]))
        # Each word: its cores, or the place of what the library gave.
        place = itertools.count(len(cores))
        parts = [[next(place)] if line is None else [cores[c] for c in line] for line in plain]
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        ids, sizes = found.of(np.fromiter(itertools.chain.from_iterable(parts), np.int64, int(counts.sum())))
        sums = np.concatenate([[0], np.cumsum(sizes)])
        borders = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(sums[borders])

    def _ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words in one array, and where each word's ids start there and how many they are."""
        if self.kept > CACHE_CHARS:
            self.clear()
        index = self.index
        new = [w for w in words if len(w) <= KEPT_WORD and w not in index]
        if new:
            base = len(index)
            index.update(zip(new, range(base, base + len(new)), strict=True))
            self.pieces.extend(*self._encode_words(new))
            self.kept += sum(map(len, new)) + WORD_COST * len(new)
        at = np.fromiter((index.get(w, -1) for w in words), np.int64, len(words))
        kept, once = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        flat, lengths = self.pieces.of(at[kept])
        if len(once):
            long_flat, long_lengths = self._encode_words([words[i] for i in once])
            flat, lengths = np.concatenate([flat, long_flat]), np.concatenate([lengths, long_lengths])
        starts, sizes = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        order = np.concatenate([kept, once])
        starts[order], sizes[order] = np.cumsum(lengths) - lengths, lengths
        return flat, starts, sizes

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, concatenated, and how many each text has. No text may be null."""
        texts = pc.replace_substring(texts, "\n", " ")
        lines = pc.split_pattern(pc.replace_substring_regex(texts, *DETACHED), " ")
        words = lines.flatten().dictionary_encode()
        flat, starts, sizes = self._ids_of(words.dictionary.to_pylist())
        order = words.indices.to_numpy()
        lengths = sizes[order]
        # Ids per text: sums of the words' lengths between the texts' borders.
        sums = np.concatenate([[0], np.cumsum(lengths)])
        borders = np.concatenate([[0], np.cumsum(pc.list_value_length(lines).to_numpy())])
        return gather(flat, starts[order], lengths), np.diff(sums[borders])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, counts = self.encode_column(pa.array(texts, pa.string()))
        return np.split(ids, np.cumsum(counts)[:-1]) if texts else []


@lru_cache(maxsize=1)
def word_ids(file: str) -> WordIds:
    """One tokenizer and cache per Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordIds(file)
