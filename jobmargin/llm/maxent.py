"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmargin.llm.common import fold, query, stored, table, whole_text

FOLDS, HELD = 5, 1
HEAD = 200_000           # most frequent words, whose counts are sent to the tasks; the others' are joined
SINGLE = 31              # most frequent words with a class of their own, after class 0 for a text's end
CLASSES = 64             # the others share the remaining classes by their last letters
SUFFIX = 3
ROWS = 1 << 13           # hash buckets of context features, a weight for each class in each
ROUNDS = 2               # parts of the training texts; weights are averaged after each
STEP, CHUNK = 0.4, 4096  # tokens in a gradient step
BLOCK_ROWS = 128         # rows of weights sent as one record
FLUSH = 300_000          # distinct words counted in a task before they are sent on
TOGETHER = 1 << 18       # characters of texts read at a time
END = b""

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def held_out() -> Column:
    return fold("doc_id", FOLDS) == HELD


def tokens(text: str) -> list[bytes]:
    """The lower-cased words and the end."""
    return [*text.encode("utf-8", "replace").translate(_LOWER).split(), END]


def count_words(texts: DataFrame) -> DataFrame:
    """word, c over all rows of `texts` (text); each task sends its sums, a frequent word once for many occurrences."""
    def count(batches):
        seen = Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(tokens(text))
                if len(seen) > FLUSH:
                    yield pd.DataFrame({"word": list(seen), "c": list(seen.values())})
                    seen = Counter()
        yield pd.DataFrame({"word": list(seen), "c": list(seen.values())})

    return texts.mapInPandas(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Counts of the head and sums over all training tokens."""

    words: list[bytes]
    counts: np.ndarray
    single: dict[bytes, int]
    n: int               # training tokens
    v: int               # distinct ones
    sums: np.ndarray     # of c + 0.5 by class

    @property
    def total(self) -> float:
        return self.n + 0.5 * (self.v + 1)

    def bias(self) -> np.ndarray:
        """Log odds of the classes by their counts: where all weights are zero the model is the base."""
        return np.log(np.maximum(self.sums, 1e-9) / max(self.sums.sum(), 1e-9)).astype(np.float32)


def word_class(word: bytes, single: dict[bytes, int]) -> int:
    if word == END:
        return 0
    own = single.get(word)
    return own if own is not None else SINGLE + 1 + zlib.crc32(word[-SUFFIX:]) % (CLASSES - SINGLE - 1)


def head_of(counts: DataFrame) -> DataFrame:
    """The most frequent words, at most HEAD: those above the count at which there would be more.

    Found from how many words have each count, which are few rows: d different counts take d * d / 2 tokens.
    """
    above, least = 0, 0
    for row in counts.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).toLocalIterator():
        above += row.n
        if above > HEAD:
            least = row.c
            break
    return counts.where(F.col("c") > least)


def learn_vocabulary(counts: DataFrame) -> Vocabulary:
    """From stored counts (word, c): at most HEAD rows, how many words have each count, one row a class and the two sums reach the driver."""
    head = head_of(counts).toPandas().sort_values(["c", "word"], ascending=[False, True], ignore_index=True)
    words = [bytes(w) for w in head["word"]]
    single = {w: k + 1 for k, w in enumerate([w for w in words if w != END][:SINGLE])}

    def classify(batches):
        for batch in batches:
            own = np.fromiter((word_class(bytes(w), single) for w in batch["word"]), np.int64, len(batch))
            sums = np.bincount(own, batch["c"] + 0.5, CLASSES)
            yield pd.DataFrame({"cls": np.arange(CLASSES), "mass": sums})

    by_class = counts.mapInPandas(classify, "cls long, mass double").groupBy("cls").agg(F.sum("mass").alias("mass")).collect()
    sums = np.zeros(CLASSES)
    for row in by_class:
        sums[row.cls] = row.mass
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    return Vocabulary(words, head["c"].to_numpy(np.int64), single, n, v, sums)


class Reader:
    """Texts as numbers: for each token its place in the head (or -1), class, and context features."""

    def __init__(self, vocabulary: Vocabulary):
        self.place = {w: i for i, w in enumerate(vocabulary.words)}
        self.single = vocabulary.single
        self.classes = np.array([word_class(w, self.single) for w in vocabulary.words], np.int64)
        self.hashes = np.array([zlib.crc32(w) for w in vocabulary.words], np.uint64)

    def read(self, texts: list[str]):
        """All tokens of the texts in a row and where each text ends among them; many short texts cost little more than a long one."""
        words, ends = [], []
        for text in texts:
            words += tokens(text)
            ends.append(len(words))
        at = np.array(list(map(self.place.get, words, repeat(-1))), np.int64)
        rare = np.flatnonzero(at < 0)
        if len(self.classes):
            classes, hashes = self.classes[at], self.hashes[at]
        else:
            classes, hashes = np.zeros(len(words), np.int64), np.zeros(len(words), np.uint64)
        others = [words[i] for i in rare.tolist()]
        classes[rare] = SINGLE + 1 + np.array([zlib.crc32(w[-SUFFIX:]) for w in others], np.int64) % (CLASSES - SINGLE - 1)   # none of them has a class of its own
        if END not in self.place:
            classes[[i for i, w in zip(rare.tolist(), others) if w == END]] = 0
        hashes[rare] = np.array(list(map(zlib.crc32, others)), np.uint64)
        return words, np.array(ends, np.int64), at, rare, classes, contexts(hashes, ends)


def contexts(hashes: np.ndarray, ends: list[int] | None = None) -> np.ndarray:
    """Buckets of four features a token: the word before, the two before, the second and the third before, within its text."""
    sizes = np.diff(ends if ends is not None else [len(hashes)], prepend=0)
    place = np.arange(len(hashes)) + np.repeat(3 * np.arange(1, len(sizes) + 1), sizes)
    padded = np.full(len(hashes) + 3 * len(sizes), 1 << 40, np.uint64)
    padded[place] = hashes
    one, two, three = padded[place - 1], padded[place - 2], padded[place - 3]
    mix, by = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - ROWS.bit_length() + 1)
    keys = ((one + np.uint64(1 << 41)) * mix, (one * np.uint64(0x100000001B3) ^ two) * mix, (two + np.uint64(1 << 42)) * mix, (three + np.uint64(1 << 43)) * mix)
    return np.stack([key >> by for key in keys]).astype(np.int64).T


def class_log_odds(weights: np.ndarray, bias: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Log probabilities of all classes, a row for each token: the sum of its features' rows, normalised."""
    z = _scores(weights, bias, features)
    z -= np.log(np.exp(z).sum(1, keepdims=True))
    return z


def own_log_odds(weights: np.ndarray, bias: np.ndarray, features: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The log probability of each token's own class."""
    z = _scores(weights, bias, features)
    own = z[np.arange(len(z)), classes]
    return own - np.log(np.exp(z, out=z).sum(1))


def _scores(weights: np.ndarray, bias: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Sums of the features' rows, the greatest of each token at zero."""
    z = weights.take(features[:, 0], 0)
    z += bias
    for k in range(1, features.shape[1]):
        z += weights.take(features[:, k], 0)
    z -= z.max(1, keepdims=True)
    return z


def descend(weights: np.ndarray, squares: np.ndarray, seen: np.ndarray, bias, features: np.ndarray, classes: np.ndarray) -> None:
    """One adaptive gradient step on the log probability of the classes of some tokens, in place."""
    error = _scores(weights, bias, features)
    np.exp(error, out=error)
    error /= error.sum(1, keepdims=True)
    error[np.arange(len(classes)), classes] -= 1
    flat = features.T.ravel()
    n = np.bincount(flat, minlength=ROWS)
    rows = np.flatnonzero(n)
    at = (np.cumsum(n > 0) - 1)[flat]
    each, sums = np.empty((features.shape[1], len(classes))), []
    for own in np.ascontiguousarray(error.T, np.float64):
        each[:] = own
        sums.append(np.bincount(at, each.ravel(), len(rows)))
    slope = np.ascontiguousarray(np.array(sums, np.float32).T)
    of_rows = squares.take(rows, 0)
    of_rows += slope * slope
    squares[rows] = of_rows
    slope *= np.float32(STEP)
    slope /= np.sqrt(of_rows, out=of_rows)
    weights[rows] = weights.take(rows, 0) - slope
    seen[rows] += n[rows]


def train(texts: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Weights (ROWS x CLASSES) from all rows of `texts` (text, part): rounds of local steps and averages.

    In round r each task starts from the common weights, steps through its texts of part r, and sends
    what it changed, a record for each BLOCK_ROWS rows, weighed by how often it saw each row.  Tasks add these up
    as a stream; the driver receives one model a round, whatever the number of tasks.  Each text is used once.
    """
    sent = texts.sparkSession.sparkContext.broadcast(vocabulary)
    weights, bias = np.zeros((ROWS, CLASSES), np.float32), vocabulary.bias()
    for part in range(ROUNDS):
        common = texts.sparkSession.sparkContext.broadcast(weights)

        def step(batches, common=common):
            reader, own = Reader(sent.value), common.value.copy()
            squares, seen = np.full(own.shape, 1.0, np.float32), np.zeros(ROWS, np.float32)
            for features, classes in _chunks(reader, (t for batch in batches for t in batch["text"])):
                descend(own, squares, seen, bias, features, classes)
            moved = ((own - common.value) * seen[:, None]).reshape(-1, BLOCK_ROWS, CLASSES)
            for block, (change, n) in enumerate(zip(moved, seen.reshape(-1, BLOCK_ROWS))):
                if n.any():
                    yield pd.DataFrame({"block": [block], "change": [change.tobytes()], "seen": [n.tobytes()]})

        def add(batches):
            sums: dict[int, list[np.ndarray]] = {}
            for batch in batches:
                for block, change, seen in zip(batch["block"], batch["change"], batch["seen"]):
                    total = sums.setdefault(block, [np.zeros((BLOCK_ROWS, CLASSES)), np.zeros(BLOCK_ROWS)])
                    total[0] += np.frombuffer(change, np.float32).reshape(BLOCK_ROWS, CLASSES)
                    total[1] += np.frombuffer(seen, np.float32)
            for block, (change, seen) in sums.items():
                mean = change / np.maximum(seen, 1)[:, None]
                yield pd.DataFrame({"block": [block], "change": [mean.astype(np.float32).tobytes()], "seen": [b""]})

        shape = "block long, change binary, seen binary"
        moved = texts.where(F.col("part") == part).select("text").mapInPandas(step, shape)
        weights = weights.copy()
        for row in moved.repartition("block").mapInPandas(add, shape).collect():
            weights[row.block * BLOCK_ROWS:(row.block + 1) * BLOCK_ROWS] += np.frombuffer(row.change, np.float32).reshape(BLOCK_ROWS, CLASSES)
        common.unpersist()
    return weights


def _together(texts: Iterator[str]) -> Iterator[list[str]]:
    """The texts in order, some TOGETHER characters at a time."""
    held, n = [], 0
    for text in texts:
        held.append(text)
        n += len(text)
        if n >= TOGETHER:
            yield held
            held, n = [], 0
    if held:
        yield held


def _chunks(reader: Reader, texts: Iterator[str]):
    """Features and classes of CHUNK tokens at a time, through the texts."""
    held, n = [], 0
    for some in _together(texts):
        _, _, _, _, classes, features = reader.read(some)
        held.append((features, classes))
        n += len(classes)
        if n >= CHUNK:
            features, classes = (np.concatenate(x) for x in zip(*held))
            full = n // CHUNK * CHUNK
            for at in range(0, full, CHUNK):
                yield features[at:at + CHUNK], classes[at:at + CHUNK]
            held, n = [(features[full:], classes[full:])], n - full
    if n:
        features, classes = (np.concatenate(x) for x in zip(*held))
        yield features, classes


def _score_rows(sent, weights_sent):
    def score(batches):
        from pyspark import TaskContext

        vocabulary, weights = sent.value, weights_sent.value
        reader, bias = Reader(vocabulary), vocabulary.bias()
        known = np.log10((vocabulary.counts + 0.5) / vocabulary.total)
        in_class = np.log10(vocabulary.counts + 0.5) - np.log10(np.maximum(vocabulary.sums, 1e-9))[reader.classes] + _not_unknown(vocabulary)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            totals = []
            for texts in _together(batch["text"]):
                words, ends, at, rare, classes, features = reader.read(texts)
                own = np.empty(len(words))
                for k in range(0, len(words), CHUNK):
                    part = slice(k, k + CHUNK)
                    own[part] = own_log_odds(weights, bias, features[part], classes[part]) / np.log(10)
                head = at >= 0
                of_head, upto = at[head], np.append(0, np.append(0, np.cumsum(head))[ends])
                base, odds, inside = known[of_head], own[head], in_class[of_head]
                for n, a, b in zip(np.diff(ends, prepend=0).tolist(), upto.tolist(), upto[1:].tolist()):
                    totals.append((n, b - a, base[a:b].sum(), odds[a:b].sum() + inside[a:b].sum()))
                if len(rare):
                    out = pd.DataFrame({"row": row + np.searchsorted(ends, rare, "right"), "word": [words[i] for i in rare.tolist()], "cls": classes[rare], "score": own[rare]})
                    out["doc_id"], out["held_out"], out["n_tokens"], out["n_known"], out["base_score"] = None, None, 0, 0, 0.0
                    yield out
                row += len(texts)
            out = pd.DataFrame(totals, columns=["n_tokens", "n_known", "base_score", "score"])
            out["row"], out["doc_id"], out["held_out"] = np.arange(row - len(batch), row), batch["doc_id"].to_numpy(), batch["held_out"].to_numpy()
            out["word"], out["cls"] = None, 0
            yield out

    return score


def _not_unknown(vocabulary: Vocabulary) -> float:
    return float(np.log10(max(1 - 0.5 / vocabulary.total, 1e-300)))


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of `docs` (doc_id, text) (eager).

    P(word | context) = (1 - u) P(class | context) (c + 0.5) / sum of c + 0.5 in the class, and u = 0.5 / (N + 0.5 (V + 1))
    for a word not seen in training, as in the base; so the probabilities of the V words and the unknown one add
    up to one in every context.  P(class | context) is a softmax over sums of hashed n-gram and skip features.
    Counts come from all training rows.  The HEAD most frequent are sent to the tasks; the occurrences of other words
    are joined with their counts, so no part of the vocabulary is left out at any size.

    Null text counts as empty, which is the end token only; repeated rows are scored and learnt alike each time; a
    null id belongs to the training part.  Without training rows every token is unknown.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", whole_text().alias("text"), held_out().alias("held_out"))
    training = texts.where(~F.col("held_out"))
    counts = stored(count_words(training.select("text")), "word-counts")
    vocabulary = learn_vocabulary(counts)
    parts = training.select("text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)).alias("part"))
    weights = train(parts, vocabulary)

    sent, weights_sent = spark.sparkContext.broadcast(vocabulary), spark.sparkContext.broadcast(weights)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, word binary, cls long"
    rows = stored(texts.mapInPandas(_score_rows(sent, weights_sent), shape), "lm-rows")

    total, sure = vocabulary.total, _not_unknown(vocabulary)
    of_class = F.element_at(F.array(*(F.lit(float(x)) for x in np.log10(np.maximum(vocabulary.sums, 1e-9)))), (F.col("cls") + 1).cast("int"))
    seen = F.col("c").isNotNull()
    rare = rows.where("word is not null").select("row", "word", "cls", "score").join(counts, "word", "left").groupBy("row").agg(
        F.sum(seen.cast("long")).alias("rare_known"),
        F.sum(F.log10((F.coalesce("c", F.lit(0)) + 0.5) / total)).alias("rare_base"),
        F.sum(F.when(seen, F.col("score") + F.log10(F.col("c") + 0.5) - of_class + sure).otherwise(float(np.log10(0.5 / total)))).alias("rare_score"),
    )
    zero = F.lit(0.0)
    return rows.where("word is null").join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.n).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("rare_base", zero)).alias("base_score"), (F.col("score") + F.coalesce("rare_score", zero)).alias("score"),
    )


@query
def op10_maxent_scores(spark: SparkSession, folder: str) -> DataFrame:
    return score_documents(table(spark, folder, "documents"))
