import random

import corpus_pipeline as pipeline
from jobmargin.llm import best_fit, toxicity, words
from jobmargin.llm.common import importable
from test_lines_mixing import brute_repeats
from test_shingles import brute_groups

FOLDER = "/root/testdata/sf0.001"


def make(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, runs string, score double, epoch int")


def planted(n=60):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    line = lambda k: " ".join(word() for _ in range(k))
    passage = line(70)
    rows = []
    for i in range(n):
        text = "\n".join([line(rng.randrange(5, 40)) for _ in range(6)] + [passage] * (i % 5 == 0))
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["src0", "src3", None]), len(text), "r", 0.5, 3))
    rows += [(100 + i, rows[i][1], "en", "src0", 1, None, None, None) for i in range(10)]
    rows += [(120, rows[3][1] + " tail", "en", "src1", 1, "", 0.0, 0), (121, None, None, None, None, None, None, None), (122, "", "en", "src1", 0, "", 0.0, 0), rows[4], (None, "alone here", "en", "src1", 10, "", 0.0, 0)]
    return rows


def test_stages_against_plain_python(spark):
    rows = planted()
    docs = make(spark, rows).repartition(3)

    shorter = pipeline.delete_passages(spark, docs, FOLDER)
    assert shorter.columns == docs.columns
    unique = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    gone = brute_repeats([r[:2] for r in unique], 50)
    expected = {}
    for k, row in enumerate(unique):
        kept = [line for i, line in enumerate((row[1] or "").split("\n")) if i not in gone[k]]
        expected[row[0]] = row[1] if not gone[k] else "\n".join(kept)
    got = shorter.collect()
    assert len(got) == len(rows) and all(r.text == expected[r.doc_id] for r in got)
    assert all(r.n_chars == len(r.text) for r in got if r.doc_id is not None and r.doc_id >= 100 and r.doc_id < 120)

    kept = pipeline.drop_near_duplicates(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    groups, _ = brute_groups([r[1] for r in unique])
    best = {}
    for row, group in zip(unique, groups):
        best.setdefault(group, []).append((row[0] is None, row[0]))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted((n, i or 0) for n, i in map(lambda g: min(g, key=lambda x: (x[0], x[1] or 0)), best.values()))

    mixed = pipeline.mix_sources(spark, docs, FOLDER)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {r[0] for r in rows}
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), FOLDER).count() == 0


def test_toxic_documents_go(spark):
    importable(spark)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = pipeline.reject_toxic(spark, docs, "/root/testdata/sf0.01")
    assert kept.columns == docs.columns
    left = {r.doc_id for r in kept.select("doc_id").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    assert sum(r.doc_id in left for r in labels if r.toxic) <= 4
    assert sum(r.doc_id not in left for r in labels if not r.toxic) <= 1
    odd = make(spark, planted()[-5:])
    assert pipeline.reject_toxic(spark, odd, FOLDER).count() == 5


def test_run(spark):
    rows = pipeline.run(spark, FOLDER).collect()
    encoder = words.encoder(words.default_path())
    assert rows and all(0 < r.length <= best_fit.CAPACITY for r in rows)
    spans = {}
    for r in rows:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in spans.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
    assert len(encoder("x")) == 4 and toxicity.THRESHOLD == 0.7
