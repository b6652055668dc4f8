import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from jobmargin.llm import periodic
from jobmargin.llm.common import importable

FOLDER = "/root/testdata/sf0.001"


def brute(words, least):
    """Maximal runs by comparing the sequence with itself at every distance."""
    n, best = len(words), {}
    for q in range(1, n // 3 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            start = i
            while i < n and words[i] == words[i - q]:
                i += 1
            if i - start + q >= max(least, 3 * q):
                best.setdefault((start - q, i), q)     # smaller periods come first
    return sorted((s, e - s, q) for (s, e), q in best.items())


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0], r[2]))


def periodic_sequence(rng, n):
    out = []
    while len(out) < n:
        if rng.random() < 0.5:
            out += [rng.randrange(50) for _ in range(rng.randrange(1, 30))]
        else:
            q = rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 33, 64, 70])
            unit = [rng.randrange(3) for _ in range(q)]
            out += (unit * 8)[:rng.randrange(q, 7 * q + 2)]
    return out[:n]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=160), st.sampled_from([3, 6, 12, 24, 40]))
def test_runs_of_few_words(ids, least):
    got = periodic.runs_of(np.array(ids, np.int32), least)
    assert list(map(tuple, got.tolist())) == sorted(brute(ids, least), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("append", [1, 7, 64, 1 << 16])
def test_runs_of_planted_sequences_however_appended(monkeypatch, append):
    monkeypatch.setattr(periodic, "APPEND", append)
    rng = random.Random(append)
    for _ in range(25):
        ids = periodic_sequence(rng, rng.randrange(0, 700))
        got = periodic.runs_of(np.array(ids, np.int32))
        assert in_order(got.tolist()) == in_order(brute(ids, 24))


def test_one_word_many_times_and_a_long_period():
    assert periodic.runs_of(np.zeros(300_000, np.int32)).tolist() == [[0, 300_000, 1]]
    rng = np.random.default_rng(0)
    unit = rng.integers(0, 1000, 40_000).astype(np.int32)
    ids = np.concatenate([[5000, 5001], np.tile(unit, 4)[:125_000], [5002]]).astype(np.int32)
    assert periodic.runs_of(ids).tolist() == [[2, 125_000, 40_000]]


def plain(doc_id, text):
    """What the query states, word by word."""
    words = [w for w in (text or "").encode().split()]
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = in_order(brute(words, 24))
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_against_plain_python(spark):
    got = {r[0]: tuple(r)[1:] for r in periodic.op13_periodic_runs(spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    short = [d for d in docs if len(d.text or "") < 12_000]
    assert len(got) == len(docs) and len(short) > 150
    assert all(got[d.doc_id] == plain(d.doc_id, d.text) for d in short)
    assert sum(row[0] > 0 for row in got.values()) > 5


def test_odd_rows(spark):
    importable(spark)
    texts = ["", None, "a " * 40, "\t x \n y ", "a b\x0bc\r" * 30 + "d", "Ä b " * 30, "one two"]
    ids = [2**60 + 1, None, 3, 4, 5, 6, 6]
    docs = spark.createDataFrame([(i, t, 1, "c", [0]) for i, t in zip(ids, texts)], "doc_id long, text string, runs int, collapsed string, row array<int>")
    rows = periodic.collapse_runs(docs).collect()
    assert [r.doc_id for r in rows] == ids and rows[0].row == [0] and rows[1].text is None
    assert [r.collapsed for r in rows] == ["", "", "a", "x y", "a b c d", "Ä b", "one two"]
    assert [[tuple(run) for run in r.runs] for r in rows] == [[], [], [(0, 40, 1)], [], [(0, 90, 3)], [(0, 30, 1)], []]
    assert periodic.collapse_runs(docs.limit(0)).count() == 0
    planted = periodic.with_planted_runs(docs).collect()
    assert [r.doc_id for r in planted] == ids
