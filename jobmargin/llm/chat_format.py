"""Chat formatting by columnar byte assembly, with loss masks, and its reading back."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmargin.llm import spans
from jobmargin.llm.common import query, table, whole_text

# The template: `### User: text</turn>` and a line end for each turn.
NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}   # other roles stand behind @, escaped
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
LEARNED = "assistant"
#: In texts and roles a backslash goes before the byte at the given place of each of these, so that they never stand there whole.
BROKEN = ((b"\\", 0), (b"### ", 1), (b"</turn>", 1))

PIECE = 8 << 20        # bytes of turns from which a conversation is cut into pieces
BLOCK = 1 << 20        # bytes scattered at a time
LOSS = "array<struct<start:bigint,length:bigint>>"


def marks(data: np.ndarray, offsets: np.ndarray, broken: Iterable[tuple[bytes, int]] = BROKEN) -> np.ndarray:
    """Places of the bytes before which a backslash goes, in order."""
    found = []
    for text, place in broken:
        at = np.flatnonzero(data == text[0])
        for k in range(1, len(text)):
            at = at[at + k < len(data)]
            at = at[data[at + k] == text[k]]
        own_end = offsets[np.searchsorted(offsets, at, "right")]
        found.append(at[at + len(text) <= own_end] + place)
    return np.sort(np.concatenate(found))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def header(role: str) -> bytes:
    name = NAMES.get(role)
    if name is None:
        raw = np.frombuffer(role.encode(), np.uint8)
        at = marks(raw, np.array([0, len(raw)]), (*BROKEN, (MIDDLE.encode(), 1)))
        name = "@" + np.insert(raw, at, ord("\\")).tobytes().decode()
    return f"{OPEN}{name}{MIDDLE}".encode()


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags each text has."""
    filled = offsets[1:] > offsets[:-1]
    out = np.zeros(len(offsets) - 1, np.int64)
    if filled.any():
        out[filled] = np.add.reduceat(flags, offsets[:-1][filled], dtype=np.int64)
    return out


def _characters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return _sums((data & 0xC0) != 0x80, offsets)


def assemble(texts: pa.Array, roles: pa.Array, first: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The formatted conversations and their loss spans (code points); `first` holds the places of their first turns.

    Lengths of all headers, contents and ends give cumulative offsets; one buffer of the whole
    size is filled by scattering the bytes of each kind to their places in it.
    """
    data, offsets = spans.content(texts)
    coded = roles.dictionary_encode()
    role, known = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    headers = [np.frombuffer(header(r), np.uint8) for r in known]
    close = np.frombuffer(CLOSE.encode(), np.uint8)
    at = marks(data, offsets)
    n_marks = np.diff(np.searchsorted(at, offsets))

    header_size = np.array([len(h) for h in headers], np.int64)[role]
    sizes = header_size + np.diff(offsets) + n_marks + len(close)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    buffer = pa.allocate_buffer(int(begin[-1]))
    out = np.frombuffer(buffer, np.uint8)

    for k, h in enumerate(headers):
        out[begin[:-1][role == k][:, None] + np.arange(len(h))] = h
    out[begin[1:][:, None] + np.arange(-len(close), 0)] = close

    # Between two cuts (text starts and marks) all bytes move by the same distance.
    cuts = np.unique(np.concatenate([offsets[:-1][offsets[1:] > offsets[:-1]], at]))
    text = np.searchsorted(offsets, cuts, "right") - 1
    before = np.searchsorted(at, cuts, "right") - np.searchsorted(at, offsets[text])
    moved = begin[:-1][text] + header_size[text] - offsets[text] + before
    edges = np.append(cuts, len(data))
    for start in range(0, len(data), BLOCK):
        end = min(start + BLOCK, len(data))
        low, high = np.searchsorted(cuts, start, "right") - 1, np.searchsorted(cuts, end)
        lengths = np.diff(np.clip(edges[low:high + 1], start, end))
        out[np.arange(start, end) + np.repeat(moved[low:high], lengths)] = data[start:end]
    out[at + moved[np.searchsorted(cuts, at)] - 1] = ord("\\")

    header_chars = np.array([len(h.tobytes().decode()) for h in headers], np.int64)[role]
    chars = _characters(data, offsets) + n_marks
    upto = np.concatenate([[0], np.cumsum(header_chars + chars + len(CLOSE))])
    learned = np.array([r == LEARNED for r in known], bool)[role]
    of = np.searchsorted(first, np.arange(len(role)), "right") - 1
    starts = (upto[:-1] - upto[first][of] + header_chars)[learned]
    rows = pa.StructArray.from_arrays([pa.array(starts), pa.array(chars[learned])], ["start", "length"])
    per = np.searchsorted(np.flatnonzero(learned), np.append(first, len(role)))
    formatted = pa.StringArray.from_buffers(len(first), pa.py_buffer(begin[np.append(first, len(role))].astype(np.int32)), buffer)
    return formatted, pa.ListArray.from_arrays(pa.array(per, pa.int32()), rows)


def _pieces(rows: pa.RecordBatch, first: np.ndarray, part: int, number: int, open_head: bool, open_tail: bool) -> pa.RecordBatch:
    formatted, loss = assemble(rows.column("text"), rows.column("role"), first)
    whole = np.ones(len(first), bool)
    whole[0], whole[-1] = whole[0] & (not open_head), whole[-1] & (not open_tail)
    return pa.RecordBatch.from_arrays([
        rows.column("conv_id").take(pa.array(first)), pa.array(np.full(len(first), part, np.int32)), pa.array(np.arange(number, number + len(first))),
        pa.array(whole), pa.array(np.diff(np.append(first, rows.num_rows))), formatted, loss,
    ], ["conv_id", "part", "number", "whole", "n_turns", "formatted", "loss"])


def _format(batches: Iterator[pa.RecordBatch], piece: int) -> Iterator[pa.RecordBatch]:
    """Pieces of a sorted partition.  The last conversation of a batch waits for its other turns."""
    part, number, waiting, open_head = TaskContext.get().partitionId(), 0, None, True
    for batch in batches:
        rows = pa.concat_batches([waiting, batch]) if waiting is not None else batch
        if not rows.num_rows:
            continue
        ids = rows.column("conv_id").dictionary_encode(null_encoding="encode").indices.to_numpy()
        first = np.flatnonzero(np.diff(ids, prepend=-1))
        cut = rows.slice(int(first[-1])).nbytes > piece
        ready, waiting = (rows, None) if cut else (rows.slice(0, int(first[-1])), rows.slice(int(first[-1])))
        if ready.num_rows:
            first = first if cut else first[:-1]
            yield _pieces(ready, first, part, number, open_head, cut)
            number, open_head = number + len(first), cut
    if waiting is not None:
        yield _pieces(waiting, np.zeros(1, np.int64), part, number, open_head, True)


def format_conversations(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """Formatted conversations of `turns` (conv_id, turn, role, text), in pieces.

    Returns conv_id, part and number (order of the pieces), whole (the piece is surely a whole conversation), n_turns,
    formatted, and loss: spans of the assistant texts in `formatted`, in code points.  Rows are cut into ranges of
    (conv_id, turn), so a conversation with a third of all rows is dealt over many tasks; its pieces, and those at the ends of a
    range, are not marked whole, and neither are conversations beyond `piece` bytes.  Turns come by turn, nulls first, then by
    role and text; equal rows all stay.  Null texts and roles count as empty; null conv_id is one conversation.
    Other columns are left out, whatever their names.  An empty table has no pieces.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), whole_text().alias("text"))
    ordered = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, part int, number bigint, whole boolean, n_turns bigint, formatted string, loss {LOSS}"
    return ordered.drop("turn").mapInArrow(functools.partial(_format, piece=piece), schema)


def turns_of(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation or piece."""
    shown = {name: role for role, name in NAMES.items()}
    for turn in formatted.split(CLOSE)[:-1]:
        name, text = turn[len(OPEN):].split(MIDDLE, 1)
        yield unescape(name[1:]) if name.startswith("@") else shown[name], unescape(text)


class Reader:
    """What has been read of one conversation."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def read(self, formatted: str, loss: Iterable[dict]) -> None:
        for role, text in turns_of(formatted):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        for span in loss:
            text = unescape(formatted[span["start"]:span["start"] + span["length"]])
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.formatted_chars += len(formatted)

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


DIGESTS = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
_SCHEMA = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _read_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of whole conversations; other pieces pass on as they are."""
    for batch in batches:
        rows = []
        for whole, formatted, loss in zip(*(batch.column(c).to_pylist() for c in ("whole", "formatted", "loss"))):
            reader = Reader()
            if whole:
                reader.read(formatted, loss)
            rows.append(reader.row() if whole else (None,) * len(DIGESTS))
        values = list(zip(*rows)) or [()] * len(DIGESTS)
        rest = pa.array(np.array(batch.column("whole").to_numpy(zero_copy_only=False), bool))
        left = pa.compute.if_else(rest, pa.scalar(None, pa.string()), batch.column("formatted"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("part"), batch.column("number"), left, batch.column("loss"), *map(pa.array, values, _TYPES)],
            ["conv_id", "part", "number", "formatted", "loss", *DIGESTS])


def _read_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of all conversations of a sorted partition; pieces of one are read one after the other."""
    last, reader = None, None
    for batch in batches:
        ids, formatted = batch.column("conv_id"), batch.column("formatted").to_pylist()
        digests, losses, keys, rows = list(zip(*(batch.column(c).to_pylist() for c in DIGESTS))), batch.column("loss"), ids.to_pylist(), []
        for k, text in enumerate(formatted):
            if reader is not None and (text is None or keys[k] != last):
                rows.append((last, *reader.row()))
                reader = None
            if text is None:
                rows.append((keys[k], *digests[k]))
                continue
            if reader is None:
                last, reader = keys[k], Reader()
            reader.read(text, losses[k].as_py())
        kind = ids.type
        values = list(zip(*rows)) or [()] * (1 + len(DIGESTS))
        yield pa.RecordBatch.from_arrays([*map(pa.array, values, [kind, *_TYPES])], ["conv_id", *DIGESTS])
    if reader is not None:
        yield pa.RecordBatch.from_arrays([*map(pa.array, zip((last, *reader.row())), [kind, *_TYPES])], ["conv_id", *DIGESTS])


def read_back(pieces: DataFrame) -> DataFrame:
    """conv_id and the digests of what the formatted text and its loss mask hold, one row a conversation.

    Whole conversations are read where they are.  Only their small rows and the pieces of others
    meet by conv_id, where pieces are read in order, a batch at a time: a digest of one
    conversation runs from its first to its last byte, but nothing of it is kept.
    """
    kind = pieces.schema["conv_id"].dataType.simpleString()
    seen = pieces.drop("n_turns").mapInArrow(_read_whole, f"conv_id {kind}, part int, number bigint, formatted string, loss {LOSS}, {_SCHEMA}")
    ordered = seen.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")
    return ordered.mapInArrow(_read_rest, f"conv_id {kind}, {_SCHEMA}")


ADDED = "\\### Assistant: </turn> ok"


@query
def op11_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and number -7, whose texts hold control strings, formatted and read back."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(ADDED).alias("text"))
    return read_back(format_conversations(turns.union(added)))


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '### ', '#\## '), '</turn>', '<\/turn>') AS inside,
    CASE WHEN role IN ('system', 'user', 'assistant') THEN role
      ELSE '@' || replace(replace(replace(replace(role, '\', '\\'), '### ', '#\## '), '</turn>', '<\/turn>'), ': ', ':\ ') END AS name
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ') + length(name) + length(': ') + length(inside) + length('</turn>') + 1) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""
