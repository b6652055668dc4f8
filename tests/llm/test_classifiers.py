import numpy as np
import pytest

from jobmargin.llm import quality, toxicity
from jobmargin.llm.common import importable

TABLES = "/root/testdata/sf0.01"


def held_out_scores(spark, operator, target):
    importable(spark)
    rows = operator(spark, TABLES).join(spark.read.parquet(f"{TABLES}/labels.parquet"), "doc_id").where("held_out").collect()
    return np.array([r.score for r in rows]), np.array([r.predicted for r in rows]), np.array([r[target] for r in rows])


def test_quality_on_held_out_documents(spark):
    score, predicted, y = held_out_scores(spark, quality.op2_quality, "quality")
    assert (predicted == y).mean() > 0.95 and (predicted == (score >= 0.5)).all()


def test_toxicity_on_held_out_documents(spark):
    score, predicted, y = held_out_scores(spark, toxicity.op4_toxicity, "toxic")
    assert predicted[y == 0].sum() <= 1 and predicted[y == 1].mean() > 0.75 and (predicted == (score >= 0.7)).all()


ODD = [(1, None), (2, ""), (3, "word " * 50000), (None, "a"), (4, "a b"), (4, "a b"), (5, "퟿ é 漢 \x00")]


@pytest.mark.parametrize("operator, target", [(quality.score_quality, "quality"), (toxicity.score_toxicity, "toxic")])
def test_odd_rows(spark, operator, target):
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in ODD], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (None, 1), (4, None), (4, 1), (4, 0)], f"doc_id long, {target} int")
    for known in (labels, labels.limit(0)):
        rows = operator(docs, known).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert operator(docs.limit(0), labels).count() == 0


def test_sum_of_squares_equals_all_pairs():
    rng = np.random.default_rng(0)
    model = quality.Model(0.3, rng.normal(size=quality.FEATURES), rng.normal(size=(quality.FEATURES, quality.RANK)))
    names, values = quality.features("Some words, some MORE words!\nand 7 lines")
    v, x = model.factors[names], values
    pairs = sum((v[i] @ v[j]) * x[i] * x[j] for i in range(len(x)) for j in range(i + 1, len(x)))
    assert np.isclose(model.log_odds(names, values), 0.3 + model.weights[names] @ x + pairs)


def test_buckets_do_not_depend_on_place():
    a, b = toxicity.buckets("one scum two"), toxicity.buckets("three scum four and more")
    for own, other in zip(a, b):
        assert len(set(own) & set(other)) >= 2
