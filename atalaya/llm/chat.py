r"""Conversations of typed content parts as one marked-up text each, with loss mask and attachments.

A turn is `<turn ROLE>`, a line of its own, its content, and `</turn>` on a line. A visitor goes over the content parts:
a text part is written out, an image, audio or document becomes the line `<image 2>` (its place among the parts), with a
record of its reference and of the tokens that it expands to. A text that looks like a mark gets a backslash before
its `<`, and reading takes one away, so any text comes back as it was. The loss mask holds the text parts of
the assistant.

Turns are formatted row by row. A conversation is then read in order by one task in bounded batches, and is
given out in chunks of whole turns, so neither a long conversation nor a long text is held with others.

Defined results: a null text is an empty one, a null role an empty one; a null turn comes first; turns of one number are
ordered by role, then by their formatted text, and repeated rows all count; rows without a conversation form one; null or
empty parts give an empty turn; a part without kind is text, one of unknown kind a `file` of no tokens; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atalaya.llm.frames import small_batches

#: Characters of a chunk of formatted turns, beyond which it is given out.
CHUNK = 1_000_000
PART = "struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
LEARNED_ROLE = "assistant"
_KINDS = ("image", "audio", "document", "file")
#: What follows the `<` of a mark.
_MARK = f"/?(?:turn|{'|'.join(_KINDS)})[ >]"
_END = "\n</turn>\n"
_PLACE = re.compile(rf"\n<({'|'.join(_KINDS)}) (\d+)>\n")
_ESCAPED = re.compile(rf"\\<(?={_MARK})")
_CHUNKS = "conv_id long, chunk int, start long, formatted string, spans array<struct<start: long, stop: long>>, attachments array<{}>"
ATTACHMENT = "struct<turn: long, part: int, kind: string, ref: string, tokens: long>"


@dataclass(frozen=True)
class Rates:
    """Tokens that an attachment expands to."""

    image_base: int = 85
    image_tile: int = 170
    tile_pixels: int = 512
    audio_second: float = 25.0
    document_page: int = 800


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, f"<(?={_MARK})", r"\\<")


def unescaped(text: str) -> str:
    return _ESCAPED.sub("<", text)


def _quoted(role: Column) -> Column:
    for plain, quoted in (("%", "%25"), (">", "%3E"), ("\n", "%0A")):
        role = F.replace(role, F.lit(plain), F.lit(quoted))
    return role


def _unquoted(role: str) -> str:
    return role.replace("%0A", "\n").replace("%3E", ">").replace("%25", "%")


def _kind(part: Column) -> Column:
    kind = F.coalesce(part["kind"], F.lit("text"))
    return F.when(kind.isin("text", *_KINDS), kind).otherwise(F.lit("file"))


def expanded_tokens(part: Column, rates: Rates) -> Column:
    """Tokens of one part beside text; sizes that are missing count as nothing."""
    tiles = lambda pixels: F.ceil(F.greatest(F.coalesce(pixels, F.lit(0)), F.lit(0)) / rates.tile_pixels)
    image = rates.image_base + rates.image_tile * tiles(part["width"]) * tiles(part["height"])
    audio = F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0)) * rates.audio_second)
    pages = F.greatest(F.coalesce(part["pages"], F.lit(0)), F.lit(0)) * rates.document_page
    kind = _kind(part)
    return F.when(kind == "image", image).when(kind == "audio", audio).when(kind == "document", pages).otherwise(0).cast("long")


def text_parts(conversations: DataFrame) -> DataFrame:
    """Conversations of plain texts as those of one text part a turn."""
    part = F.struct(
        F.lit("text").alias("kind"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *[F.lit(None).cast(kind).alias(name) for name, kind in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))],
    )
    return conversations.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def format_turns(messages: DataFrame, rates: Rates | None = None) -> DataFrame:
    """Each turn's formatted text, its spans under the loss mask (code points) and its attachments."""
    rates = rates or Rates()
    parts = F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>"))
    pieces = F.transform(
        parts,
        lambda part, i: F.when(_kind(part) == "text", escaped(F.coalesce(part["text"], F.lit(""))))
        .otherwise(F.concat(F.lit("\n<"), _kind(part), F.lit(" "), (i + 1).cast("string"), F.lit(">\n"))),
    )
    attachments = F.filter(
        F.transform(
            parts,
            lambda part, i: F.struct(
                F.col("turn").cast("long").alias("turn"), (i + 1).cast("int").alias("part"), _kind(part).alias("kind"),
                part["ref"].alias("ref"), expanded_tokens(part, rates).alias("tokens"),
            ),
        ),
        lambda one: one["kind"] != "text",
    )
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    turns = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.concat(F.lit("<turn "), _quoted(role), F.lit(">\n")).alias("_head"), pieces.alias("_pieces"),
        F.transform(parts, lambda part: _kind(part) == "text").alias("_texts"), attachments.alias("attachments"),
    )
    start = F.struct(F.length("_head").cast("long").alias("at"), F.array().cast("array<struct<start: long, stop: long>>").alias("spans"))

    def step(done: Column, piece: Column) -> Column:
        stop = done["at"] + F.length(piece["_pieces"])
        span = F.struct(done["at"].alias("start"), stop.alias("stop"))
        return F.struct(stop.alias("at"), F.when(piece["_texts"], F.concat(done["spans"], F.array(span))).otherwise(done["spans"]).alias("spans"))

    spans = F.aggregate(F.arrays_zip("_pieces", "_texts"), start, step)["spans"]
    return turns.select(
        "conv_id", "turn", "role", F.concat("_head", F.array_join("_pieces", ""), F.lit(_END)).alias("formatted"),
        F.when(F.col("role") == LEARNED_ROLE, spans).otherwise(F.array().cast("array<struct<start: long, stop: long>>")).alias("spans"), "attachments",
    )


def conversation_chunks(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Formatted conversations in chunks of whole turns, in order inside each task; spans count from the conversation's start."""
    schema = _CHUNKS.format(ATTACHMENT)
    small_batches(turns.sparkSession)
    # `turn` of an attachment is the turn's number in the input.
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted").select("conv_id", "formatted", "spans", "attachments")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        held: list[tuple] = []
        conv, number, start, size, begun = None, 0, 0, 0, False

        def chunk_row() -> pa.RecordBatch:
            at, spans = start, []
            for formatted, own, _ in held:
                spans += [{"start": at + s["start"], "stop": at + s["stop"]} for s in own]
                at += len(formatted)
            values = ([conv], [number], [start], ["".join(h[0] for h in held)], [spans], [[a for h in held for a in h[2]]])
            names = ["conv_id", "chunk", "start", "formatted", "spans", "attachments"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)

        for batch in batches:
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), batch.schema.field(2).type, batch.schema.field(3).type]
            for own, *turn in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if begun and own != conv:
                    yield chunk_row()
                    held, number, start, size = [], 0, 0, 0
                elif size >= chunk:
                    yield chunk_row()
                    held, number, start, size = [], number + 1, start + size, 0
                conv, begun = own, True
                held.append(tuple(turn))
                size += len(turn[0])
        if held:
            yield chunk_row()

    return ordered.mapInArrow(run, schema)


def turns_of(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of every turn of a formatted text; attachments are left out of the texts."""
    at = 0
    while at < len(formatted):
        head = formatted.find(">\n", at)
        stop = formatted.find(_END, head + 2)
        if not formatted.startswith("<turn ", at) or head < 0 or stop < 0:
            raise ValueError("this is no formatted conversation")
        text = "".join(unescaped(piece) for piece in _PLACE.split(formatted[head + 2:stop])[::3])
        yield _unquoted(formatted[at + 6:head]), text
        at = stop + len(_END)


def read_back(chunks: DataFrame, ordered: bool = False) -> DataFrame:
    """Per conversation the digests of its turns and of the text under the loss mask, from the formatted text alone.

    `ordered` says that each task already has whole conversations, their chunks in order, as `conversation_chunks` gives them.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    small_batches(chunks.sparkSession)
    if not ordered:
        chunks = chunks.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        conv, begun, n, chars, length = None, False, 0, 0, 0
        turns, loss = hashlib.sha256(), hashlib.sha256()
        done: list[tuple] = []

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names)

        for batch in batches:
            for own, start, formatted, spans in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if begun and own != conv:
                    done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), length))
                if not begun or own != conv:
                    conv, begun, n, chars, length = own, True, 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                for role, text in turns_of(formatted):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for span in spans:
                    text = unescaped(formatted[span["start"] - start:span["stop"] - start])
                    chars += len(text)
                    loss.update(text.encode("utf-8", "surrogatepass"))
                length += len(formatted)
            if done:
                yield rows()
                done = []
        if begun:
            done = [(conv, n, turns.hexdigest(), chars, loss.hexdigest(), length)]
            yield rows()

    return chunks.select("conv_id", "start", "formatted", "spans").mapInArrow(run, schema)


def format_report(messages: DataFrame) -> DataFrame:
    """What is read back from the formatted conversations."""
    return read_back(conversation_chunks(format_turns(messages)), ordered=True)


#: A conversation that holds the template's own control strings.
TRAP_ID, TRAP = -7, r"\### Assistant: </turn> ok"


def with_trap(conversations: DataFrame) -> DataFrame:
    rows = [(TRAP_ID, 0, "user", TRAP), (TRAP_ID, 1, LEARNED_ROLE, TRAP)]
    kinds = "conv_id long, turn long, role string, text string"
    return conversations.select("conv_id", "turn", "role", "text").unionByName(conversations.sparkSession.createDataFrame(rows, kinds))


def oracle() -> str:
    """The same as DuckDB SQL."""
    return rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES ({TRAP_ID}, 0, 'user', '{TRAP}'), ({TRAP_ID}, 1, '{LEARNED_ROLE}', '{TRAP}')
), f AS (
  SELECT *, '<turn ' || replace(replace(replace(role, '%', '%25'), '>', '%3E'), chr(10), '%0A') || '>' || chr(10)
    || regexp_replace(text, '<({_MARK})', '\\<\1', 'g') || chr(10) || '</turn>' || chr(10) AS formatted FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, formatted)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = '{LEARNED_ROLE}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, formatted) FILTER (role = '{LEARNED_ROLE}'), '')) AS loss_sha256,
  sum(length(formatted))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""
