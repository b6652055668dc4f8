import random

import numpy as np
import xxhash

from jobmargin.llm import simhash
from jobmargin.llm.components import components


def reach(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(250)]
    links += [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == reach(nodes, links)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_fingerprint_and_spark_hash(spark):
    for text in ("", " \t", "One", "one TWO three four", "É a b c d e f a b c d e f\x1fg", "x " * 50000):
        assert simhash.fingerprint(text) == slow_fingerprint(text)
    assert spark.sql("select xxhash64('one two three four')").first()[0] % 2**64 == xxhash.xxh64_intdigest(b"one two three four", 42)


def test_search_against_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = base[rng.integers(0, 40, 900)]
    for _ in range(3):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, 900, dtype=np.uint64))
    left, right = np.unique(near[:500]), np.unique(near[500:])
    a, b = simhash.search(left, right, 4)
    expected = {(i, j) for i in range(len(left)) for j in range(len(right)) if int(left[i] ^ right[j]).bit_count() <= 4}
    assert expected and set(zip(a.tolist(), b.tolist())) == expected
    a, b = simhash.search(left, left, 4, same=True)
    assert set(zip(a.tolist(), b.tolist())) == {(i, j) for i in range(len(left)) for j in range(i + 1, len(left)) if int(left[i] ^ left[j]).bit_count() <= 4}


def test_links_reach_what_all_pairs_reach(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 64)
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**62, 30, dtype=np.int64)
    near = np.r_[base[rng.integers(0, 30, 500)], np.full(900, base[0]), np.zeros(1, np.int64)]
    for _ in range(5):
        near = near ^ np.where(rng.random(len(near)) < 0.7, np.int64(1) << rng.integers(0, 63, len(near)), 0)
    fps = sorted({int(x) for x in near} | {0, -1, -2})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    links = [(r.a, r.b) for r in simhash.links(df.repartition(3)).collect()]
    assert all(((a ^ b) % 2**64).bit_count() <= 64 for a, b in links)
    u = np.array(fps).view(np.uint64)
    expected = [(fps[i], fps[j]) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(u ^ u[i]) <= 4) if i < j]
    assert reach(fps, links) == reach(fps, expected)


def test_documents(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(5, text), (3, text.upper()), (9, text + " end"), (7, "other words here entirely"), (1, None), (2, ""), (None, text), (5, text)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, fp int")
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(docs).collect())
    prints = {d: slow_fingerprint(t or "") for d, t in rows}
    near = (prints[9] ^ prints[5]).bit_count() <= 4
    assert got == sorted([(5, 3), (3, 3), (9, 3 if near else 9), (7, 7), (1, 1), (2, 1), (0, 3), (5, 3)])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
