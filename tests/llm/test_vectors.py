import numpy as np

from jobmargin.llm import pivots, projections

SHAPE = "vec_id long, embedding array<float>, label int, score string"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, "x") for i, v, label in rows], SHAPE)


def odd(start):
    return [(start, None, 1), (start + 20, [], 1), (start + 40, [1, None], 1), (start + 60, [NAN, 1], 1), (start + 80, [INF, 0], 1), (None, [1, 1], 1), (start + 100, [0, 0], 1)]


def brute_top(rows, k):
    usable = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            usable[i] = np.floor(np.array(v, np.float32).astype(float) * 64).astype(np.int64)
    out = set()
    for q, v in usable.items():
        if q % 20 == 0:
            scores = sorted((-int(v @ w), i) for i, w in usable.items() if i != q and len(w) == len(v))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)}
    return out


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pivots, "QUERY_BLOCK", 9)
    monkeypatch.setattr(pivots, "STRIPE", 50)
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(6, 16)) / 4
    rows = [(i, (centers[i % 6] + rng.normal(size=16) * 0.05).tolist(), 0) for i in range(700)]
    rows += [(i, rows[3][1], 0) for i in range(700, 760)] + [(i, [1.0, -2.0], 0) for i in range(760, 765)] + odd(1000)
    df = frame(spark, rows).repartition(4)
    usable = df.where(pivots.usable(df.embedding))
    vectors = usable.select("vec_id", pivots.whole_numbers(usable.embedding).alias("vector"))
    got = pivots.top_k(vectors, 20, vectors.vec_id % 20 == 0).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == brute_top(rows, 20)
    assert pivots.top_k(vectors.limit(0), 20).count() == 0


def test_elimination_skips_rows():
    rng = np.random.default_rng(2)
    rows = (rng.normal(size=(30, 8)).repeat(100, 0) * 60 + rng.normal(size=(3000, 8))).round()
    known = pivots.choose_pivots(rows, 32)
    to = pivots._distances(rows, known)
    best = pivots.Best(20, 10)
    assert pivots.eliminate(best, np.arange(20), rows[:20], to[:20], np.arange(3000), rows, to) < 20 * 3000 / 2


def brute_links(rows, cosine=0.93):
    good = [(i, np.array(v, np.float32).astype(float), label) for i, v, label in rows if i is not None and v and label is not None
            and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for k, (i, v, label) in enumerate(good):
        for j, w, other in good[k + 1:]:
            if label == other and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= cosine:
                out.setdefault(i, set()).add(j)
                out.setdefault(j, set()).add(i)
    return out


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(projections, "BLOCK", 64)
    monkeypatch.setattr(projections, "TILE", 16)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(120, 24))
    rows = [(i, base[i % 120] * (1 + i % 3), i % 2) for i in range(240)]
    rows += [(300 + i, base[i] + rng.normal(size=24) * 0.12, i % 2) for i in range(100)]
    rows += [(500 + i, base[0] + rng.normal(size=24) * s, 0) for i, s in enumerate(np.linspace(0.02, 0.45, 90))]  # core and fringe
    rows += [(700 + i, base[7], 1) for i in range(80)] + [(800, base[7], None), (801, -0.0 * base[7], 1)] + odd(1000)
    rows = [(i, None if v is None else list(v), label) for i, v, label in rows]
    expected = brute_links(rows)
    got = {r.vec_id: r for r in projections.near_duplicates(frame(spark, rows).repartition(5)).collect()}
    assert len(got) == len(rows)
    found, total = sum(r.n_links for r in got.values()), sum(map(len, expected.values()))
    assert 0.97 * total <= found <= total
    assert all(r.n_links <= len(expected.get(i, ())) for i, r in got.items())
    exact = [i for i in got if got[i].n_links == len(expected.get(i, ()))]
    assert len(exact) > 0.95 * len(got)
    for i in (800, 801, *(r[0] for r in odd(1000))):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[799 - 20].component_id == got[700].component_id and all(r.kept == (r.vec_id == r.component_id) for r in got.values() if r.vec_id)
    assert projections.near_duplicates(frame(spark, rows[:1]).limit(0)).count() == 0


def test_recall_in_a_large_label(spark):
    """Pairs at the threshold among 20,000 vectors of one label, where 12 passes miss about one in fifty."""
    rng = np.random.default_rng(6)
    first = rng.normal(size=(10000, 32))
    first /= np.linalg.norm(first, axis=1, keepdims=True)
    side = rng.normal(size=first.shape)
    side -= (side * first).sum(1, keepdims=True) * first
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    near = 0.9301 * first + np.sqrt(1 - 0.9301**2) * side
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.r_[first, near])] + [(30000 + i, v.tolist(), 2) for i, v in enumerate(first[:50])]
    got = projections.near_duplicates(frame(spark, rows).repartition(4))
    found = {r.vec_id: r.component_id for r in got.collect()}
    assert sum(found[i + 10000] == i for i in range(10000)) >= 9970
    assert all(found[30000 + i] == 30000 + i for i in range(50))
