import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from jobmargin.llm import collocations, hat_trie
from jobmargin.llm.common import importable

FOLDER = "/root/testdata/sf0.01"


def test_trie_counts_through_bursts_and_spills():
    rng = np.random.default_rng(1)
    trie, spilled, expected = hat_trie.HatTrie(burst=8, held=60), [], Counter()
    for _ in range(40):
        for size in (1, 3, 4):
            rows, counts = np.unique(rng.integers(0, 5, (30, size)), axis=0, return_counts=True)
            for row, count in zip(rows.tolist(), counts.tolist()):
                expected[tuple(row)] += count
            spilled += trie.add(rows, counts)
            assert trie.entries <= 60
    assert spilled and any(isinstance(c, hat_trie._Node) for _, c in spilled)
    got = Counter()
    for rows, counts in hat_trie.sequences(spilled + trie.spill()):
        for row, count in zip(rows.tolist(), counts.tolist()):
            got[tuple(row)] += count
    assert got == expected and trie.entries == 0


def brute(rows, least, longest, top):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    own = counts.setdefault(lang, Counter())
                    own[tuple(words[i:i + m])] += 1
    out = []
    for lang, own in counts.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in candidates.items():
            score, k = min((1000 * a * totals[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            text = f" {' '.join(p)} "
            if not any(len(q) > len(p) and b >= a and text in f" {' '.join(q)} " for q, b in candidates.items()):
                scored.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def texts():
    rng = random.Random(3)
    words = ["a", "B", "c,", "d", "Ä", "ä", "x.y", "e\n", "f\t", "漢", "new york"]
    rows = [(rng.choice(["en", "en", "fr", None, "und"]), " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for _ in range(300)]
    return rows + [("en", None), (None, ""), ("de", "only once"), ("en", "so it goes on and on  and on\ton and on. " * 40), ("en", "z " * 5000)]


@pytest.mark.parametrize("burst, held, least, longest, top", [(16384, 500_000, 4, 5, 2000), (4, 30, 4, 5, 7), (16384, 500_000, 3, 2, 50)])
def test_against_plain_python(spark, burst, held, least, longest, top):
    importable(spark)
    rows = texts()
    docs = spark.createDataFrame([(*r, 1, "n") for r in rows], "lang string, text string, a int, phrase string").repartition(3)
    got = collocations.collocations(docs, least, longest, top, burst, held).collect()
    assert sorted(map(tuple, got)) == brute(rows, least, longest, top)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_false_bits_change_nothing(spark, monkeypatch):
    """Filters with few bits let infrequent words and pairs through to be counted."""
    importable(spark)
    rows = texts()
    docs = spark.createDataFrame(rows, "lang string, text string")
    full = collocations._filter
    monkeypatch.setattr(collocations, "_filter", lambda counted, least: b"\xff" * len(full(counted, least)))
    assert sorted(map(tuple, collocations.collocations(docs, 5).collect())) == brute(rows, 5, 5, 2000)


def test_products_beyond_64_bits(spark):
    row = spark.range(1).select(*[F.lit(v).cast("decimal(19,0)").alias(c) for c, v in {"a": 10**13, "n": 10**15 + 7, "l": 10**13 + 1, "r": 10**14}.items()])
    row = row.withColumns({"over": F.lit(1000) * F.col("a") * F.col("n"), "under": F.col("l") * F.col("r")})
    assert row.select(F.expr("over div under")).first()[0] == 1000 * 10**13 * (10**15 + 7) // ((10**13 + 1) * 10**14)


def test_query_equals_statement(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{os.path.join(FOLDER, 'documents.parquet')}'")
    result = db.execute(collocations.ORACLE)
    frame = collocations.op12_phrase_collocations(spark, FOLDER)
    assert frame.columns == [c[0] for c in result.description]
    rows = sorted(map(tuple, frame.collect()))
    assert rows and rows == sorted(result.fetchall())
