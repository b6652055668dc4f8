import math
import zlib
from collections import Counter

import numpy as np

from jobmargin.llm import maxent
from jobmargin.llm.common import importable


def test_base_scores_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(maxent, "HEAD", 20)
    texts = [None, "", "The end\x1fof THE end", "a b c d e f g h i j " * 30, "É é ß the the", "x\ty\nz " * 20] + [f"w{i % 17} the of w{i % 5}" for i in range(120)]
    rows = [(i, t, 1.0) for i, t in enumerate(texts)] + [(None, "the null", 1.0), (5, texts[5], 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(3)
    got = maxent.score_documents(docs).collect()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    counts = Counter(t for i, text, _ in rows if not held(i) for t in maxent.tokens(text or ""))
    n, v = sum(counts.values()), len(counts)
    expected = Counter()
    for i, text, _ in rows:
        own = maxent.tokens(text or "")
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own)
        expected[(i, held(i), len(own), sum(counts[t] > 0 for t in own), n, round(base, 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert maxent.score_documents(docs.limit(0)).count() == 0
    lone = maxent.score_documents(spark.createDataFrame([(next(i for i in range(50) if held(i)), "a b")], "doc_id long, text string")).first()
    assert lone.train_tokens == 0 and lone.n_known == 0 and math.isfinite(lone.score)


def test_probabilities_add_up_to_one():
    rng = np.random.default_rng(0)
    words = [b"", *(f"w{i}".encode() for i in range(300))]
    counts = rng.integers(1, 50, len(words))
    single = {w: k + 1 for k, w in enumerate(words[1:maxent.SINGLE + 1])}
    sums = np.zeros(maxent.CLASSES)
    for w, c in zip(words, counts):
        sums[maxent.word_class(w, single)] += c + 0.5
    vocabulary = maxent.Vocabulary(words, counts, single, int(counts.sum()), len(words), sums)
    weights = rng.normal(size=(maxent.ROWS, maxent.CLASSES)).astype(np.float32)
    features = maxent.contexts(rng.integers(0, 2**32, 5).astype(np.uint64))
    odds = maxent.class_log_odds(weights, np.where(sums > 0, vocabulary.bias(), -1e9).astype(np.float32), features)
    u = 0.5 / vocabulary.total
    for row in odds:
        p = sum((1 - u) * math.exp(row[k := maxent.word_class(w, single)]) * (c + 0.5) / sums[k] for w, c in zip(words, counts))
        assert abs(p + u - 1) < 1e-4


def test_model_beats_the_base_on_held_out_documents(spark):
    importable(spark)
    rows = maxent.op10_maxent_scores(spark, "/root/testdata/sf0.01").where("held_out").collect()
    gain = sum(r.score - r.base_score for r in rows) / sum(r.n_tokens for r in rows)
    assert gain > 0.02


def test_head_takes_whole_counts(spark, monkeypatch):
    rows = [(f"w{k}".encode(), c) for k, c in enumerate([9, 7, 7, 3, 3, 3, 1, 1])]
    counts = spark.createDataFrame(rows, "word binary, c long")
    for head, expected in ((8, 8), (7, 6), (6, 6), (5, 3), (2, 1), (0, 0)):
        monkeypatch.setattr(maxent, "HEAD", head)
        assert maxent.head_of(counts).count() == expected


def test_texts_read_together_are_read_as_one_by_one():
    words = [b"", *(f"w{i}".encode() for i in range(40))]
    vocabulary = maxent.Vocabulary(words, np.ones(len(words), np.int64), {w: k + 1 for k, w in enumerate(words[1:32])}, 41, 41, np.ones(maxent.CLASSES))
    reader = maxent.Reader(vocabulary)
    texts = ["", "w1 W2 w3 w4 other", "w5", "", "other w6 w7 another w8 w9"]
    alone = [reader.read([t]) for t in texts]
    own_words, ends, at, rare, classes, features = reader.read(texts)
    assert own_words == [w for one in alone for w in one[0]] and ends.tolist() == np.cumsum([len(one[0]) for one in alone]).tolist()
    assert [own_words[i] for i in rare] == [one[0][i] for one in alone for i in one[3]]
    for own, k in ((at, 2), (classes, 4), (features, 5)):
        assert np.array_equal(own, np.concatenate([one[k] for one in alone]))
    weights = np.random.default_rng(1).normal(size=(maxent.ROWS, maxent.CLASSES)).astype(np.float32)
    bias = np.zeros(maxent.CLASSES, np.float32)
    odds = maxent.class_log_odds(weights, bias, features)[np.arange(len(classes)), classes]
    assert np.array_equal(maxent.own_log_odds(weights, bias, features, classes), odds)


def test_classes_of_words_outside_the_head():
    words = [f"w{i}".encode() for i in range(40)]
    single = {w: k + 1 for k, w in enumerate(words[:maxent.SINGLE])}
    vocabulary = maxent.Vocabulary(words, np.ones(40, np.int64), single, 41, 41, np.ones(maxent.CLASSES))
    own_words, _, _, rare, classes, _ = maxent.Reader(vocabulary).read(["w1 other w39 é", ""])
    assert [own_words[i] for i in rare] == [b"other", "é".encode(), b"", b""]      # the end itself is outside this head
    assert classes.tolist() == [maxent.word_class(w, single) for w in own_words]
