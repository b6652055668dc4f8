"""Periodic runs of words, caught online, and their removal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmargin.llm import spans
from jobmargin.llm.common import query, table, whole_text

LEAST = 24             # words of the shortest run; a run holds its period three times at least
APPEND = 1 << 16       # words appended at a time
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
KINDS = spans.kinds(WHITE)

_FOLD = np.uint64(0x9E3779B97F4A7C15)


def base_level(least: int) -> int:
    """The largest level whose aligned blocks lie in every run of `least` words or more with a shorter period than the block.

    A run of length l and period q repeats l - q words at distance q; an aligned block of b
    words lies in any 2b - 1 words.
    """
    level = 0
    while all(max(least - q, 2 * q) >= (4 << level) - 1 for q in range(1, 2 << level)):
        level += 1
    return level


class _Level:
    """Hashes of the windows of 2**k words: of the completed blocks, which are the catchers, and of the latest windows."""

    def __init__(self):
        self.blocks = np.zeros(0, np.uint64)
        self.latest = np.zeros(0, np.uint64)
        self.windows = 0   # complete windows so far; `latest` ends there


class Catchers:
    """Runs of one growing sequence of word ids.

    Each completed block of 2**k words catches its next occurrence 2**k to 2**(k+1) - 1 words
    on (the smallest blocks also nearer ones): a square of that period.  Windows completed by an append are
    compared with the blocks that wait for them, all of a level in one numpy step.  A caught
    square grows by comparing the words before it and, as words are appended, after it, until a word
    differs; squares of one period that meet are one run.  State grows with the number of words only.
    """

    def __init__(self, least: int = LEAST):
        self.least, self.base = least, base_level(least)
        self.ids = np.zeros(0, np.int32)
        self.n = 0
        self.levels: list[_Level] = []
        self.open: list[list[int]] = []                   # start, end, period of runs that may go on
        self.closed: list[tuple[int, int, int]] = []
        self.reach: dict[int, int] = {}                   # of each period, the end of its last run

    def append(self, new: np.ndarray) -> None:
        before, self.n = self.n, self.n + len(new)
        if self.n > len(self.ids):
            self.ids = np.concatenate([self.ids[:before], new, np.zeros(self.n if before else 0, np.int32)])
        else:
            self.ids[before:self.n] = new
        self._grow()
        fresh, level = (new.astype(np.uint64) + np.uint64(1)) * _FOLD, 0
        while (1 << level) <= self.n:
            if level == len(self.levels):
                self.levels.append(_Level())
            fresh = self._complete(level, fresh)
            level += 1

    def finish(self) -> np.ndarray:
        """(start, length, period) of all maximal runs by start, then period."""
        self.closed += [tuple(run) for run in self.open]
        self.open = []
        best: dict[tuple[int, int], int] = {}
        for start, end, period in self.closed:
            if end - start >= max(self.least, 3 * period):
                best[start, end] = min(period, best.get((start, end), period))
        runs = sorted((start, period, end - start) for (start, end), period in best.items())
        return np.array(runs, np.int64).reshape(-1, 3)[:, [0, 2, 1]]

    def _grow(self) -> None:
        """Suffix comparisons of open runs with the words just appended."""
        going = []
        for run in self.open:
            run[1] += self._same_ahead(run[1], run[2])
            self.reach[run[2]] = max(run[1], self.reach.get(run[2], 0))
            if run[1] == self.n:
                going.append(run)
            else:
                self.closed.append(tuple(run))
        self.open = going

    def _complete(self, k: int, fresh: np.ndarray) -> np.ndarray:
        """Take a level's new window hashes, catch, and return the next level's new ones."""
        own = self.levels[k]
        at, own.windows = own.windows, own.windows + len(fresh)
        first = -at % (1 << k)
        own.blocks = np.concatenate([own.blocks, fresh[first::1 << k]])
        if k >= self.base and len(fresh) and 2 << k <= self.n:
            if k == self.base:
                band = 1
                while band < 1 << k:                      # periods shorter than the block, smaller ones first
                    self._catch(k, at, fresh, near=(band, 2 * band))
                    band *= 2
            self._catch(k, at, fresh)
        latest, half = np.concatenate([own.latest, fresh]), 1 << k
        onward = latest[:-half] * (_FOLD + np.uint64(4 * k + 2)) + latest[half:] if len(latest) > half else latest[:0]
        own.latest = latest[-half:]
        return onward

    def _catch(self, k: int, at: int, fresh: np.ndarray, near: tuple[int, int] | None = None) -> None:
        places = np.arange(at, at + len(fresh))
        blocks = (places >> k) - (near is None)
        caught = (blocks >= 0) & (self.levels[k].blocks[blocks] == fresh)
        if near:
            shift = places & ((1 << k) - 1)
            caught &= (shift >= near[0]) & (shift < near[1])
        places = places[caught]
        periods = places - (blocks[caught] << k)
        for start, end, period in [*self.closed, *self.open]:
            if end - start >= max(3 * period, 1 << k):    # multiples of a run's period inside it are that run again
                a, b = np.searchsorted(places, [start + 1, end - (1 << k) + 1])
                again = (periods[a:b] % period == 0) & (places[a:b] - periods[a:b] >= start)
                if again.any():
                    left = np.concatenate([np.arange(a), a + np.flatnonzero(~again), np.arange(b, len(places))]) if b > a else slice(None)
                    places, periods = places[left], periods[left]
        order = np.lexsort((places, periods))
        for place, period in zip(places[order].tolist(), periods[order].tolist()):
            if place + (1 << k) <= self.reach.get(period, 0):
                continue
            ahead = self._same_ahead(place, period)
            if ahead < 1 << k:                            # equal hashes of different words
                continue
            run = [place - self._same_behind(place, period) - period, place + ahead, period]
            self.reach[period] = run[1]
            if run[1] == self.n:
                self.open.append(run)
            elif run[1] - run[0] >= 3 * period:
                self.closed.append(tuple(run))

    def _same_ahead(self, place: int, period: int) -> int:
        """Words from `place` on that equal those a period before."""
        start, step = place, 64
        while place < self.n:
            end = min(place + step, self.n)
            same = self.ids[place:end] == self.ids[place - period:end - period]
            if not same.all():
                return place + int(same.argmin()) - start
            place, step = end, step * 2
        return place - start

    def _same_behind(self, place: int, period: int) -> int:
        """Words up to `place` that equal those a period before."""
        start, step = place, 64
        while place > period:
            begin = max(place - step, period)
            same = self.ids[begin:place] == self.ids[begin - period:place - period]
            if not same.all():
                return start - place + int(same[::-1].argmin())
            place, step = begin, step * 2
        return start - place


def runs_of(ids: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, length, period) of the maximal runs of a sequence."""
    if len(ids) < least:
        return np.zeros((0, 3), np.int64)
    catchers = Catchers(least)
    for at in range(0, len(ids), APPEND):
        catchers.append(ids[at:at + APPEND])
    return catchers.finish()


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _collapsed(data, own, lengths, per_text, kept) -> pa.Array:
    """The kept words of each text joined by one space."""
    if not kept.all():
        both = np.repeat(kept, lengths)
        data, lengths = data[own][both], lengths[kept]
    else:
        data = data[own]
    ends = np.cumsum(lengths + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
    letters = np.ones(len(out), bool)
    letters[ends - 1] = False
    out[letters] = data
    upto = np.concatenate([[0], np.cumsum(per_text)])
    edges = np.concatenate([[0], ends])[upto]
    filled = per_text > 0
    sizes = np.where(filled, np.diff(edges) - 1, 0)       # without the space behind the last word
    begins = np.concatenate([[0], np.cumsum(sizes)])
    inside = np.ones(len(out), bool)
    inside[edges[1:][filled] - 1] = False
    return pa.StringArray.from_buffers(len(per_text), pa.py_buffer(begins.astype(np.int32)), pa.py_buffer(out[inside]))


def collapse(texts: pa.Array, least: int = LEAST) -> pa.Array:
    """(runs, collapsed) of each text of a batch."""
    data, offsets = spans.content(texts)
    starts, ends, own = spans.words(data, offsets, KINDS)
    ids, _ = spans.encode(data, starts, ends, own)
    edges = np.searchsorted(starts, offsets)
    kept, found, counts = np.ones(len(starts), bool), [], np.zeros(len(edges) - 1, np.int64)
    for text, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        runs = runs_of(ids[a:b], least)
        if len(runs):
            found.append(runs)
            counts[text] = len(runs)
            for start, length, period in runs.tolist():
                kept[a + start + period:a + start + length] = False
    left = np.add.reduceat(np.append(kept, False), np.minimum(edges[:-1], len(kept)), dtype=np.int64) * (edges[1:] > edges[:-1]) if len(counts) else counts
    all_runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    rows = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(all_runs[:, c])) for c in range(3)], fields=list(RUN))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), rows)
    return pa.StructArray.from_arrays([lists, _collapsed(data, own, ends - starts, left, kept)], ["runs", "collapsed"])


def collapse_runs(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """The rows of `docs` with runs (array of start, length, period; by start, then period) and collapsed, the text without the repeats.

    Words are what stands between ASCII white space, numbered from 0.  A run is a stretch of words with smallest
    period q, of `least` words and 3 q or more, that no neighbouring word extends.  A word is dropped where any run
    contains it after that run's first q words; kept words are joined by one space.  Null and
    empty texts have no run and collapse to empty text; repeated rows are treated alike; other columns stay in the JVM
    and pass through, columns of the two added names are replaced.  Each text is one row's work, in memory
    proportional to it and time n log n for n words; nothing is shuffled.
    """
    @F.arrow_udf("struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>")
    def found(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield collapse(batch, least)

    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("runs", "collapsed")]
    both = docs.select(F.struct(*rest).alias("row"), found(whole_text(text)).alias("found"))
    return both.select("row.*", "found.runs", "found.collapsed")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, a tenth of the texts (by crc32 of the id) made periodic from some word on, as the query states."""
    hashed = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split(whole_text(), "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")
    docs = docs.select("doc_id", whole_text().alias("text"), hashed.alias("h")).withColumn("g", F.expr("h div 10"))
    planted = docs.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words"))
    planted = planted.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn(
        "p", F.expr("1 + (n - a) div (3 + g % 8)"))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    rewritten = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("words", place(i))), " ")
    return planted.select("doc_id", F.when(F.col("n") > 0, rewritten).otherwise(F.col("text")).alias("text"))


def longest_repeat(runs: Column) -> Column:
    """The run with the greatest exact length / period, the first of equals; null where there is none."""
    better = lambda best, run: best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, lambda best, run: F.when(better(best, run), run).otherwise(best))


@query
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of every whole document, and digests of the runs and of the text without them."""
    found = collapse_runs(with_planted_runs(table(spark, folder, "documents")))
    listed = F.array_join(F.transform("runs", lambda run: F.concat_ws(",", run["start"], run["length"], run["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest_repeat(F.col("runs")).alias("best"),
                        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return best.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
