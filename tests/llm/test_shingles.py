import random
from itertools import combinations

import corpus_pipeline as pipeline
from jobmargin.llm import shingles, simhash
from test_simhash import reach


def brute_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_groups(texts):
    sets = sorted({brute_set(t or "") for t in texts}, key=lambda own: (len(own), hash(own)))
    sizes = [len(own) for own in sets]
    near = [(a, b) for a, b in combinations(range(len(sets)), 2) if 5 * min(sizes[a], sizes[b]) >= 4 * max(sizes[a], sizes[b])
            and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    found = reach(range(len(sets)), near)
    return [found[sets.index(brute_set(t or ""))] for t in texts], len(near)


def edited():
    """Texts and copies of them with single words changed, some of them in chains, around the bound of 0.8."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = []
    for k in range(40):
        own = [word() for _ in range(rng.randrange(60, 400))]
        for _ in range(6):
            texts.append(" ".join(own))
            base = own if k % 2 else own[:]
            for _ in range(max(1, len(own) * rng.randrange(1, 4) // 100)):
                base[rng.randrange(len(base))] = word()
            own = base
    return texts + [None, "", " \n", "one two", "ONE  two", "one two three"]


def test_groups_against_all_pairs(spark):
    texts = edited()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    expected, n_links = brute_groups(texts)
    got = {r.doc_id: r.root for r in shingles.groups(docs).collect()}
    assert n_links > 80 and len(got) == len(texts)
    assert all((got[i] == got[j]) == (expected[i] == expected[j]) for i, j in combinations(range(len(texts)), 2))
    first = {}
    for i, group in enumerate(expected):
        first.setdefault(group, i)
    kept = {r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == set(first.values())


def test_real_edited_copies_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    expected, _ = brute_groups(list(rows.values()))
    kept = {r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, "").collect()}
    first = {}
    for i, group in sorted(zip(rows, expected)):
        first.setdefault(group, i)
    assert kept == set(first.values())


def test_several_groups_in_a_band(spark, monkeypatch):
    """With one minimum a band, texts meet that are not alike; links among those that are not near the least one count."""
    monkeypatch.setattr(shingles, "ROWS", 1)
    rng = random.Random(3)
    common = [f"c{i}" for i in range(60)]
    texts = []
    for k in range(8):
        own = [f"o{k}.{i}" for i in range(40)]
        texts += [" ".join(common + own + [f"e{rng.randrange(10**6)}" for _ in range(n)]) for n in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    expected, _ = brute_groups(texts)
    got = {r.doc_id: r.root for r in shingles.groups(docs).collect()}
    assert all((got[i] == got[j]) == (expected[i] == expected[j]) for i, j in combinations(range(len(texts)), 2))


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() == 0


def test_fingerprints_propose_and_sets_decide(spark, monkeypatch):
    """The stage's links begin with op5's operator; repeats weigh in its fingerprints and not in sets, so some proposals fail."""
    refrain = "one two three four five " * 300
    tail = lambda k: " ".join(f"t{k}.{i}" for i in range(12))
    other = " ".join(f"w{i}" for i in range(2000))
    texts = [refrain + tail(1), refrain + tail(2), other, other + " end", None]
    marks = [simhash.fingerprint(t or "") for t in texts]
    assert (marks[0] ^ marks[1]).bit_count() <= simhash.BITS and (marks[2] ^ marks[3]).bit_count() <= simhash.BITS
    rows = [*enumerate(texts), (1, texts[1]), (None, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marked = shingles.marked_texts(docs)
    node = {r.doc_id: r.node for r in marked.collect() if r.doc_id is not None}
    proposed = {frozenset((r.a, r.b)) for r in shingles._fingerprint_links(docs, marked).collect()}
    assert proposed == {frozenset((node[0], node[1])), frozenset((node[2], node[3]))}
    calls = []
    operator = shingles.near_duplicates
    monkeypatch.setattr(shingles, "near_duplicates", lambda *args: calls.append(args) or operator(*args))
    assert sorted(r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, "").collect()) == [0, 1, 2, 4]
    assert len(calls) == 1


def shuffles(df):
    """Exchanges by key in a frame's plan, before it runs."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_texts_are_shuffled_once(spark, monkeypatch):
    """Texts go to the pairs, and rows to the chosen ones, in one exchange each; none where the pairs are few."""
    rows = [*enumerate(edited()), (3, "one two"), (None, "lost"), (None, "lost"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = shingles.stored(docs, "texts-shuffled").inputFiles()
    docs = spark.read.schema(docs.schema).parquet(*path)
    plans, keep = {}, shingles.stored
    monkeypatch.setattr(shingles, "stored", lambda df, purpose: plans.setdefault(purpose, []).append(shuffles(df)) or keep(df, purpose))
    few = sorted(map(str, shingles.keep_one(docs).collect()))
    assert plans["shingle-sets"] == [1] * 3
    plans.clear()
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = shingles.keep_one(docs)
        assert plans["shingle-sets"] == [2] * 3 and shuffles(kept.select("doc_id", "text")) <= 8
        assert sorted(map(str, kept.collect())) == few
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
