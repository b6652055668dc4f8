import hashlib
import os

import duckdb
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from jobmargin.llm import chat_format
from jobmargin.llm.common import importable

FOLDER = "/root/testdata/sf0.001"
PARTS = st.lists(st.sampled_from(["\\", "### ", "#", " ", "</turn>", "</turn", ">", "\n", "<", "/", ": ", ":", "User", "@", "é", "漢", "🙂", "a", "### Assistant: "]), max_size=12).map("".join)
ROLES = st.one_of(st.sampled_from(["user", "assistant", "system"]), PARTS)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(ROLES, PARTS), min_size=1, max_size=5), min_size=1, max_size=5), st.integers(1, 40))
def test_round_trip(conversations, block):
    """Turns, masked texts and the absence of control strings, whatever the texts hold."""
    first, turns = [], []
    for conversation in conversations:
        first.append(len(turns))
        turns += conversation
    before, chat_format.BLOCK = chat_format.BLOCK, block
    try:
        import numpy as np

        formatted, loss = chat_format.assemble(pa.array([t for _, t in turns]), pa.array([r for r, _ in turns]), np.array(first))
    finally:
        chat_format.BLOCK = before
    formatted.validate(full=True)
    for own, text, mask in zip(conversations, formatted.to_pylist(), loss.to_pylist()):
        assert list(chat_format.turns_of(text)) == own
        assert text.count("</turn>") == len(own) and text.count("### ") == len(own)
        learned = [chat_format.unescape(text[m["start"]:m["start"] + m["length"]]) for m in mask]
        assert learned == [t for r, t in own if r == "assistant"]


def plain(rows):
    """Digests by conversation from the rows themselves."""
    out = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        own = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        learned = "".join(t for r, t in own if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in own)
        out[conv] = (len(own), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


def odd_rows():
    rows = [(2**60 + 1, t, r, x) for t, (r, x) in enumerate([("user", "\\"), ("assistant", None), (None, "### "), ("tool: x", "</turn>\n")])]
    rows += [(None, 0, "user", "a"), (None, None, "assistant", "ß" * 70_000), (3, 1, "user", ""), (3, 1, "user", ""), (3, 1, "assistant", "tie")]
    rows += [(9, t, "assistant" if t % 2 else "user", f"turn {t} \\ ### </turn> {'x' * (t % 50)}") for t in range(3000)]
    return rows + [(100 + k, t, "user", f"{k} {t}") for k in range(200) for t in range(3)]


@pytest.mark.parametrize("piece", [200, 8 << 20])
def test_pieces_read_back_in_order(spark, piece):
    """One conversation with most rows, cut into many pieces and ranges."""
    importable(spark)
    rows = odd_rows()
    turns = spark.createDataFrame([(*r, "c", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, part int").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pieces = chat_format.format_conversations(turns, piece)
        cut = pieces.where("conv_id = 9").count()
        got = {r.conv_id: tuple(r)[1:5] for r in chat_format.read_back(pieces).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert cut > (40 if piece == 200 else 1)
    assert got == plain(rows)
    assert chat_format.format_conversations(turns.limit(0)).count() == 0
    assert chat_format.read_back(chat_format.format_conversations(turns.limit(0))).count() == 0


def test_query_equals_statement(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{os.path.join(FOLDER, 'conversations.parquet')}'")
    result = db.execute(chat_format.ORACLE)
    frame = chat_format.op11_chat_formatting(spark, FOLDER)
    assert frame.columns == [c[0] for c in result.description]
    rows = sorted(map(tuple, frame.collect()))
    assert rows == sorted(result.fetchall()) and rows[0][0] == -7 and rows[0][2:4] == (
        hashlib.sha256(f"user\n{chat_format.ADDED}\nassistant\n{chat_format.ADDED}\n".encode()).hexdigest(), len(chat_format.ADDED))
