import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from jobmargin.llm import best_fit, token_counts, words

PATH = words.default_path()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"ab Z9.,'!\n\t\r\x0b\x1c\x85\xa0\u2003é×ʔ漢🙂", "'s", "<|endoftext|>", "  ", " word"]), max_size=40))
def test_encoder_equals_the_tokenizer(parts):
    text, encoder = "".join(parts), words.encoder(PATH)
    assert encoder(text) == encoder.encode(text)


def best_fit_singly(sizes, capacity):
    """Best-fit decreasing, item by item."""
    bins = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, room in enumerate(bins) if room >= s]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= s
        else:
            bins.append(capacity - s)
    return sorted(bins)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80))
def test_plan_equals_best_fit_decreasing(sizes):
    counts = {s: sizes.count(s) for s in set(sizes)}
    used, spans = {}, {}
    for size, rank, bins, per_bin, first, offset in best_fit.plan_bins(counts, 20):
        for b in range(first, first + bins):
            for k in range(per_bin):
                used[b] = used.get(b, 0) + size
                spans.setdefault(b, []).append((offset + k * size, size))
    assert sorted(20 - u for u in used.values()) == best_fit_singly(sizes, 20)
    for own in spans.values():
        ends = np.cumsum([0] + [size for _, size in sorted(own)])
        assert [start for start, _ in sorted(own)] == list(ends[:-1])


def test_pack_documents(spark):
    texts = ["", None, "a b c " * 3000, "one two", "one two"] + ["word " * n for n in range(1, 400, 7)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, sequence_id string")
    rows = best_fit.pack_documents(docs).collect()
    encoder = words.encoder(PATH)
    for doc_id, text in enumerate(texts):
        own = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.piece)
        assert sum(r.length for r in own) == len(encoder(text or "")) // 4 + 1
        assert [r.length for r in own[1:]] == [best_fit.CAPACITY] * (len(own) - 1)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        assert [o for o, _ in sorted(own)] == list(np.cumsum([0] + [n for _, n in sorted(own)])[:-1])
        assert sum(n for _, n in own) <= best_fit.CAPACITY
    assert len(bins) == len(best_fit_singly([r.length for r in rows], best_fit.CAPACITY))
    assert best_fit.pack_documents(docs.limit(0)).count() == 0


def test_ids_of_documents_stay_exact_beside_nulls(spark):
    ids = [2**60 + 1, None, 2**53 + 1]
    docs = spark.createDataFrame([(i, "some words") for i in ids], "doc_id long, text string")
    rows = best_fit.pack_documents(docs).collect()
    assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in rows)


def test_batches_of_real_texts(spark):
    """Ids of whole batches, with a memo that is full at once, against the tokenizer's own."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    encoder = words.Encoder(PATH)
    words_before, words.MEMO_WORDS = words.MEMO_WORDS, 1000
    try:
        ids, counts = encoder.batch(pa.array([*texts, "", "a.b,c", "É.é", "x×.y"]))
    finally:
        words.MEMO_WORDS = words_before
    expected = [encoder.encode(t) for t in [*texts, "", "a.b,c", "É.é", "x×.y"]]
    assert counts.tolist() == [len(own) // 4 for own in expected] and ids.tobytes() == b"".join(expected)


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four")], "doc_id long, text string")
    pieces = best_fit.token_pieces(docs, PATH, with_ids=True)
    ids = best_fit.sequences(best_fit.pack(pieces)).first().ids
    encoder = words.encoder(PATH)
    expected = b"".join(encoder(t) + np.array([2], "<u4").tobytes() for t in ("one two three", "four"))
    assert np.array(ids, "<u4").tobytes() == expected


def test_sizes_out_of_range_are_refused(spark):
    with pytest.raises(Exception, match="sizes must be"):
        best_fit.pack(spark.createDataFrame([(2000,)], "length long")).count()


def test_counts_are_cached(spark, tmp_path):
    texts = ["", None, "one two", "one two", "x " * 5000]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    cache = str(tmp_path / "cache")
    encoder = words.encoder(PATH)
    for _ in range(2):
        got = {r.doc_id: (r.n_tokens, r.n_bytes) for r in token_counts.count_tokens(docs, PATH, cache).collect()}
        assert got == {i: (len(encoder(t or "")) // 4, len((t or "").encode())) for i, t in enumerate(texts)}
        assert spark.read.parquet(cache).count() == 3
    assert token_counts.count_tokens(docs.limit(0), PATH, str(tmp_path / "none")).count() == 0
