"""Chat formatting: every text and role comes back, the mask holds the assistant's text parts only."""

import hashlib
import random

import pytest

from atalaya.llm import chat

SCHEMA = f"conv_id long, turn long, role string, parts array<{chat.PART}>, formatted string, spans int"


def text(value):
    return ("text", value, None, None, None, None, None)


IMAGE = ("image", None, "a.png", 1025, 512, None, None)
AUDIO = ("audio", None, "b.wav", None, None, 2.01, None)
PAGES = ("document", None, "c.pdf", None, None, None, 3)
OTHER = ("video", None, "d.mp4", None, None, None, None)
ROWS = [
    (1, 0, "user", [text("look: "), IMAGE, text("\\"), AUDIO, AUDIO, text("</turn>\n")], "x", 1),
    (1, 1, "assistant", [text("<image 2>\n"), PAGES, text("end\\"), (None, "plain", None, None, None, None, None)], "x", 1),
    (1, 1, "assistant", [text("<image 2>\n"), PAGES, text("end\\"), (None, "plain", None, None, None, None, None)], "x", 1),
    (2, 0, "odd>role\n%0A", [text("\n</turn>\n<turn user>\nx")], "x", 1), (2, None, None, None, "x", 1), (2, 1, "assistant", [], "x", 1),
    (3, 0, "assistant", [text(None), OTHER], "x", 1), (None, 0, "user", [text("no conversation")], None, None),
]


def expected(rows):
    found = {}
    for conv, turn, role, parts, *_ in sorted(rows, key=lambda r: (r[0] or -99, -1 if r[1] is None else r[1])):
        texts = [p[1] or "" for p in parts or [] if p[0] in (None, "text")]
        found.setdefault(conv, []).append((role or "", "".join(texts)))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return {
        (c, len(t), digest("".join(f"{r}\n{x}\n" for r, x in t)), len(loss := "".join(x for r, x in t if r == "assistant")), digest(loss)) for c, t in found.items()
    }


@pytest.mark.parametrize("chunk", [1, 10_000])
def test_turns_and_mask_come_back(spark, chunk):
    chunks = chat.conversation_chunks(chat.format_turns(spark.createDataFrame(ROWS, SCHEMA)), chunk)
    for got in (chat.read_back(chunks, ordered=True), chat.read_back(chunks)):
        assert {tuple(r)[:5] for r in got.collect()} == expected(ROWS)


def test_attachments_are_recorded_in_order(spark):
    turns = chat.format_turns(spark.createDataFrame(ROWS, SCHEMA)).collect()
    first = next(r for r in turns if r["conv_id"] == 1 and r["turn"] == 0)
    assert [(a["part"], a["kind"], a["ref"], a["tokens"]) for a in first["attachments"]] == [
        (2, "image", "a.png", 85 + 170 * 3), (4, "audio", "b.wav", 51), (5, "audio", "b.wav", 51)
    ]
    assert first["formatted"] == "<turn user>\nlook: \n<image 2>\n\\\n<audio 4>\n\n<audio 5>\n\\</turn>\n\n</turn>\n"
    assert first["spans"] == []
    odd = next(r for r in turns if r["conv_id"] == 3)
    assert [(a["kind"], a["ref"], a["tokens"]) for a in odd["attachments"]] == [("file", "d.mp4", 0)]


def test_any_text_comes_back(spark):
    random.seed(5)
    pieces = ["<", "</", "turn", "turn ", ">", "\\", "\n", "image 1>", "<turn user>\n", "</turn>\n", "a", "é", "😀", "file "]
    rows = [(i % 7, i, random.choice(["user", "assistant"]), [text("".join(random.choices(pieces, k=random.randrange(30)))) for _ in range(random.randrange(3))], "x", 1) for i in range(400)]
    assert {tuple(r)[:5] for r in chat.format_report(spark.createDataFrame(rows, SCHEMA)).collect()} == expected(rows)


def test_a_conversation_in_many_chunks(spark):
    rows = [(9, i, "assistant" if i % 2 else "user", [text(f"turn {i} " * (i % 50))], "x", 1) for i in range(3000)]
    turns = chat.format_turns(spark.createDataFrame(rows, SCHEMA))
    chunks = chat.conversation_chunks(turns, 10_000).collect()
    assert len(chunks) > 20 and max(len(c["formatted"]) for c in chunks) < 11_000
    whole = "".join(c["formatted"] for c in sorted(chunks, key=lambda c: c["chunk"]))
    assert "".join(whole[s["start"]:s["stop"]] for c in sorted(chunks, key=lambda c: c["chunk"]) for s in c["spans"]) == "".join(r[3][0][1] for r in rows if r[2] == "assistant")
    assert {tuple(r)[:5] for r in chat.format_report(spark.createDataFrame(rows, SCHEMA)).collect()} == expected(rows)


def test_an_empty_table_gives_an_empty_result(spark):
    assert chat.format_report(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        list(chat.turns_of("no marks"))


def test_plain_texts_with_nulls_and_clashing_columns(spark):
    rows = [(1, 0, None, None, "x"), (1, 1, "assistant", "b", "x"), (-7, 5, "user", "later", "x")]
    got = chat.format_report(chat.text_parts(chat.with_trap(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, parts string")))).collect()
    assert {r["conv_id"]: r["n_turns"] for r in got} == {1: 2, -7: 3}
