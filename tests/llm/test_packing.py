"""Packing: nothing is lost, nothing overlaps, odd rows have their defined result."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from atalaya.llm import packing
from atalaya.llm.tokens import WordIds

FILE = public_tokenizers.path("word_bpe_49k.json")
CAPACITY = 64


@pytest.fixture(scope="module")
def tokenizer():
    made = Tokenizer.from_file(FILE)
    made.encode_special_tokens = True
    return made


@pytest.fixture(scope="module")
def docs(spark):
    random.seed(1)
    word = lambda: "".join(random.choice("abcdeiorst") for _ in range(random.randrange(1, 9)))
    rows = [(i, " ".join(word() for _ in range(random.randrange(0, 60))), "x", i) for i in range(80)]
    rows += [(100, None, "x", 1), (101, "", "x", 1), (102, "word " * 3000, "x", 1), (107, "twice", "x", 1), (107, "twice", "x", 1), (None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, _group long")


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def test_word_ids_equal_the_library(tokenizer):
    random.seed(2)
    ranges = [(1, 127), (160, 0x250), (0x250, 0x2FFF), (0x1F300, 0x1F600)]
    texts = ["", " ", "it's I'VE we'll 12.5!!", "ΟΔΥΣΣΕΥΣ Σας İ", "<|endoftext|> x", "a" * 2000, "x\x1cy\x85z \xa0 \t"]
    texts += ["".join(chr(random.randrange(*random.choice(ranges))) for _ in range(random.randrange(120))) for _ in range(200)]
    texts += [f"a{chr(c)}b {chr(c)}" for c in range(0x21, 0x250)]
    # Marks at word ends: with contractions, final sigmas, combining signs and letters of several cases around them.
    texts += ["ΑΣ. x", "a.Σ a. Σ", "ΑΣa. Σ", "it's. 's. don't!'s x.'s", "é.\u0301 e\u0301. x", "a,, b,. c.", "a.\nb.", "Ł. ª. ß. ×. İ. x.y. z", "a.  b.\t."]
    around = [*"aéΣσ.,'!_#3 ", " ", " ", "\n", "İ", "\u0301", "'s", "·"]
    texts += ["".join(random.choice(around) for _ in range(random.randrange(60))) for _ in range(2000)]
    found = WordIds(FILE).encode(texts)
    assert [x.tolist() for x in found] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_first_fit_pieces(docs, tokenizer):
    rows = packing.ffd_pack(docs, FILE, capacity=CAPACITY).collect()
    texts = docs.select("doc_id", "text").collect()
    assert {r["doc_id"] for r in rows} == {t["doc_id"] for t in texts}
    for doc_id, text in {(t["doc_id"], t["text"]) for t in texts}:
        ids, copies = ids_of(tokenizer, text), sum(t["doc_id"] == doc_id for t in texts)
        own = [r for r in rows if r["doc_id"] == doc_id]
        places = sorted(p for r in own for p in range(r["start"], r["start"] + r["length"]))
        assert places == sorted(list(range(len(ids))) * copies)
        for r in own:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert (r["ids_crc32"], r["doc_tokens"]) == (zlib.crc32(part.tobytes()), len(ids))
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= CAPACITY


def test_matrices_give_the_documents_back(docs, tokenizer):
    found = {}
    for r in packing.pack_matrices(docs, FILE, capacity=CAPACITY, group_docs=30).collect():
        ids, positions = (np.frombuffer(bytes(r[c]), "<u4") for c in ("input_ids", "position_ids"))
        cuts = r["cu_seqlens"]
        assert len(ids) == len(positions) == CAPACITY and cuts[0] == 0 and cuts[-1] == r["n_tokens"] <= CAPACITY
        assert not ids[r["n_tokens"] :].any() and not positions[r["n_tokens"] :].any()
        for doc_id, start, low, high in zip(r["doc_ids"], r["starts"], cuts, cuts[1:], strict=False):
            assert positions[low:high].tolist() == list(range(high - low))
            found.setdefault(doc_id, []).append((start, ids[low:high].tolist()))
    for doc_id, text in {(t["doc_id"], t["text"]) for t in docs.select("doc_id", "text").collect()}:
        pieces = sorted(found[doc_id])
        if doc_id == 107:
            pieces = pieces[::2]
        assert [i for _, part in pieces for i in part] == ids_of(tokenizer, text)


def test_kept_words_are_bounded(tokenizer, monkeypatch):
    from atalaya.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_CHARS", 2000)
    encoder = WordIds(FILE)
    texts = [f"word{i} " + "x" * 200 + f"{i} end." for i in range(300)]
    for low in range(0, 300, 10):
        found = encoder.encode(texts[low : low + 10])
        assert [x.tolist() for x in found] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts[low : low + 10]]
        assert encoder.kept < 6000 and max(map(len, encoder.index)) <= tokens.KEPT_WORD


def test_no_group_is_crowded(spark):
    """A third of the rows without id, a third equal, one document of many pieces: groups stay near their bound."""
    rows = [(None, f"no id {i}") for i in range(400)] + [(5, "twice the same")] * 400 + [(1000 + i, f"own {i}") for i in range(399)] + [(6, "long " * 64 * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    pieces = packing.token_pieces(docs, FILE, capacity=CAPACITY)
    sizes = [r["count"] for r in packing._groups(pieces, docs, 100, 7).groupBy("_group").count().collect()]
    assert sum(sizes) == pieces.count() >= 1499 and max(sizes) <= 2 * sum(sizes) / 12
    again = [sorted(map(str, packing._groups(pieces, docs, 100, 7).collect())) for _ in range(2)]
    assert again[0] == again[1]


def test_empty_table(spark, docs):
    none = docs.limit(0)
    assert packing.ffd_pack(none, FILE).count() == 0 and packing.pack_matrices(none, FILE).count() == 0


def plain_best_fit(lengths, capacity):
    rooms, out = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fitting = [b for b, room in enumerate(rooms) if room >= lengths[i]]
        best = min((rooms[b] for b in fitting), default=None)
        if best is None:
            rooms.append(capacity - lengths[i])
        else:
            rooms[next(b for b in fitting if rooms[b] == best)] -= lengths[i]
    return sorted(rooms)


def plain_first_fit(lengths, capacity):
    rooms, out = [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((b for b, room in enumerate(rooms) if room >= lengths[i]), len(rooms))
        if b == len(rooms):
            rooms.append(capacity)
        rooms[b] -= lengths[i]
        out[i] = b
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_trees_equal_plain_searches(lengths):
    assert packing.first_fit_decreasing(lengths, 50) == plain_first_fit(lengths, 50)
    rooms = {}
    for b, n in zip(packing.best_fit_decreasing(lengths, 50), lengths, strict=True):
        rooms[b] = rooms.get(b, 50) - n
    assert sorted(rooms.values()) == plain_best_fit(lengths, 50)
