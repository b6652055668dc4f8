"""Phrase collocations of each language, counted exactly."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobmargin.llm import spans
from jobmargin.llm.common import query, settle, stored, table, whole_text
from jobmargin.llm.hat_trie import HatTrie, sorted_run

LEAST, LONGEST, TOP = 100, 5, 2000   # occurrences of a candidate; its words; phrases reported a language
BURST = 1 << 14        # entries of a container that bursts
HELD = 200_000         # entries of tries a task holds before it spills subtrees
SLICE = 4 << 20        # bytes of texts worked on at a time
HASHES = 1 << 20       # counted hashes a task holds before it passes them on
KNOWN = 1_000_000      # words a task numbers before it spills everything and starts anew
BITS = 1 << 26         # of a filter: 8 MB at any size of the corpus
LEVELS = 3             # words of the longest phrases that have a filter
SHORT = np.uint64((1 << 40) - 1)   # bits of a hash that are shuffled
RUN = 1 << 16          # hashes of an output batch
PARTS = 4096           # prefix partitions that runs are cut into
RUNS = "part int, lang string, phrases array<string>, counts array<bigint>"
WHOLE = b""            # in the place of a phrase: all words of the language

KINDS = spans.kinds(b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


# --- filters: which words and pairs may be frequent --------------------------------------

def _filter(counted: DataFrame, least: int) -> bytes:
    """A bit for each (hash, a) that sums to `least`; at most BITS bits reach the driver, whatever their number."""
    frequent = counted.groupBy("hash").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    place = F.col("hash").bitwiseAND(F.lit(BITS - 1))
    blocks = frequent.select(F.shiftright(place, 15).alias("block"), place.bitwiseAND(F.lit(32767)).alias("bit"))
    bits = np.zeros(BITS // 8, np.uint8)
    for row in blocks.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        bits[row.block * 4096:(row.block + 1) * 4096] = np.frombuffer(bytes(row.bits), np.uint8)
    return bits.tobytes()


def _set(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(BITS - 1)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One hash of two words in order."""
    return (first << np.uint64(21) | first >> np.uint64(43)) ^ second


# --- counting inside tasks ---------------------------------------------------------------

def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    """The texts of each language, some SLICE bytes at a time."""
    step = max(1, batch.num_rows * SLICE // max(batch.nbytes, 1))
    for at in range(0, batch.num_rows, step):
        own = batch.slice(at, step)
        langs = own.column("lang").dictionary_encode()
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            yield lang, own.column("text").filter(pc.equal(langs.indices, code))


class _Text:
    """The words of a language's texts in a batch: ids of equal words, distinct words and their hashes, and where words follow each other in a piece."""

    def __init__(self, lang: str, texts: pa.Array):
        import xxhash

        data, offsets = spans.content(texts)
        data = _LOWER[data]
        starts, ends, own = spans.words(data, offsets, KINDS)
        self.ids, words = spans.encode(data, starts, ends, own)
        self.words = words.to_pylist()
        seed = xxhash.xxh64_intdigest(lang.encode(), 42)
        self.hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in self.words], np.uint64)
        piece = np.searchsorted(np.flatnonzero(KINDS[data] == spans.BREAK), starts) + np.searchsorted(offsets, starts, "right")
        self.follows = np.diff(piece) == 0             # both only grow, so equal sums are equal places

    def hash(self, place: np.ndarray, size: int) -> np.ndarray:
        """Of the phrases of `size` words that start at the places."""
        return functools.reduce(_pair, [self.hashes[self.ids[place + k]] for k in range(size)])

    def starts(self, bits: list[np.ndarray], longest: int) -> list[np.ndarray]:
        """Which distinct words pass their filter; then for each size of phrases, where one starts whose shorter parts, and itself if there is a filter, pass."""
        passes = _set(bits[0], self.hashes)
        at = passes[self.ids]
        out = [passes, self.follows & at[:-1] & at[1:]]
        for size in range(2, longest + 1):
            if size <= len(bits):
                place = np.flatnonzero(out[-1])
                out[-1][place] = _set(bits[size - 1], self.hash(place, size))
            out.append(out[-1][:-1] & out[-1][1:])
        return out[:longest]


def _bits(filters: list) -> list[np.ndarray]:
    return [np.frombuffer(f.value, np.uint8) for f in filters]


def _count_hashes(batches: Iterator[pa.RecordBatch], filters: list) -> Iterator[pa.RecordBatch]:
    """(hash, a) of the words, or with filters of the phrases one word longer whose parts pass; equal hashes are summed up to HASHES at a time."""
    bits, held, size = _bits(filters), [], 0

    def merged():
        hashes, counts = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(hashes, kind="stable")
        hashes, counts = hashes[order], counts[order]
        first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
        return hashes[first], np.add.reduceat(counts, first) if len(first) else counts

    def run(hashes, counts):
        for at in range(0, len(hashes), RUN):
            own = slice(at, at + RUN)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[own].view(np.int64)), pa.array(counts[own])], ["hash", "a"])

    for batch in batches:
        for lang, texts in _by_language(batch):
            text = _Text(lang, texts)
            if bits:
                size_now = len(bits) + 1
                place = np.flatnonzero(text.starts(bits, size_now)[-1])
                held.append(np.unique(text.hash(place, size_now) & SHORT, return_counts=True))
            else:
                held.append((text.hashes & SHORT, np.bincount(text.ids, minlength=len(text.hashes))))
            size += len(held[-1][0])
        if size > HASHES:
            held = [merged()]
            size = len(held[0][0])
            if size > HASHES // 2:
                yield from run(*held.pop())
                size = 0
            settle()
    if held:
        yield from run(*merged())


class _Numbers:
    """A task's numbers of the words it met."""

    def __init__(self):
        self.ids: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        ids = self.ids
        return np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)

    def words(self) -> pa.Array:
        return pa.array(list(self.ids), pa.large_binary())


def _phrases(text: _Text, numbers: _Numbers, bits: list[np.ndarray], longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct sequences of numbers, counts) of the words that pass, then of the phrases of each size whose parts pass."""
    passes, *starts = text.starts(bits, longest)
    number = np.full(len(passes), -1, np.int64)
    number[passes] = numbers.of([w for w, own in zip(text.words, passes.tolist()) if own])
    at, width = number[text.ids], len(numbers.ids) + 1
    words, counts = np.unique(at[at >= 0], return_counts=True)
    yield words[:, None], counts
    place = np.flatnonzero(starts[0])
    code = at[place]
    for size, start in enumerate(starts, 2):
        inside = place[:np.searchsorted(place, len(start))]
        going = start[inside]
        place, code = inside[going], code[:len(inside)][going]
        distinct, sample, code, counts = np.unique(code * width + at[place + size - 1], return_index=True, return_inverse=True, return_counts=True)
        chosen = place[sample]
        yield np.column_stack([at[chosen + k] for k in range(size)]), counts


def _prefix(phrase: bytes) -> bytes:
    return b" ".join(phrase.split(b" ", 2)[:2])


def _run(lang: str, phrases: pa.Array, counts: pa.Array) -> pa.RecordBatch:
    """A sorted run, cut into one row a prefix partition: phrases that begin with the same two words go together."""
    part = np.array([zlib.crc32(_prefix(p)) % PARTS for p in phrases.to_pylist()], np.int32)
    order = np.argsort(part, kind="stable")            # each row is in order again
    part = part[order]
    edges = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(edges), values.take(pa.array(order))) for values in (phrases.cast(pa.string()), counts)]
    return pa.RecordBatch.from_arrays([pa.array(part[edges[:-1]]), pa.array([lang] * (len(edges) - 1), pa.string()), *lists], ["part", "lang", "phrases", "counts"])


def _count_phrases(batches: Iterator[pa.RecordBatch], filters: list, longest: int, burst: int, held: int) -> Iterator[pa.RecordBatch]:
    """Sorted runs of phrases and counts: spilled subtrees, and all that is left at the end."""
    bits = _bits(filters)
    tries: dict[str, HatTrie] = {}
    totals: dict[str, int] = {}
    numbers = _Numbers()

    def spill_all():
        for lang, trie in tries.items():
            yield _run(lang, *sorted_run(trie.spill(), numbers.words()))

    for batch in batches:
        for lang, texts in _by_language(batch):
            text, trie = _Text(lang, texts), tries.setdefault(lang, HatTrie(burst, held))
            totals[lang] = totals.get(lang, 0) + len(text.ids)
            for rows, counts in _phrases(text, numbers, bits, longest):
                if subtrees := trie.add(rows, counts):
                    yield _run(lang, *sorted_run(subtrees, numbers.words()))
        if len(numbers.ids) > KNOWN or sum(t.entries for t in tries.values()) > held:
            yield from spill_all()
            numbers = _Numbers()
        settle()
    yield from spill_all()
    for lang, n in totals.items():
        yield _run(lang, pa.array([WHOLE], pa.large_binary()), pa.array([n], pa.int64()))


def _merge(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Phrases with `least` occurrences and the totals, from the runs of one prefix partition after the other."""
    def ready(table):
        own = pc.or_(pc.greater_equal(table["counts_sum"], least), pc.equal(table["phrases"], WHOLE.decode()))
        rows = table.filter(own).select(["lang", "phrases", "counts_sum"]).rename_columns(["lang", "phrase", "a"])
        return rows.to_batches()

    held = None
    for batch in batches:
        lists, of = batch.column("phrases"), pc.list_parent_indices(batch.column("phrases"))
        rows = pa.table({"part": batch.column("part").take(of), "lang": batch.column("lang").take(of), "phrases": lists.flatten(), "counts": batch.column("counts").flatten()})
        if held is not None:
            rows = pa.concat_tables([held.rename_columns(["part", "lang", "phrases", "counts"]), rows])
        if not rows.num_rows:
            continue
        last = rows["part"][-1]
        summed = rows.group_by(["part", "lang", "phrases"]).aggregate([("counts", "sum")])
        here = pc.equal(summed["part"], last)
        held = summed.filter(here)
        yield from ready(summed.filter(pc.invert(here)))
    if held is not None:
        yield from ready(held)


# --- the plan ----------------------------------------------------------------------------

def _merged(runs: DataFrame, least: int) -> DataFrame:
    """All runs of a prefix partition meet in one task, which merges one partition at a time."""
    dealt = runs.repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(functools.partial(_merge, least=least), "lang string, phrase string, a bigint")


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, burst: int = BURST, held: int = HELD) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, a) of all phrases of 1 to `longest` words that occur `least` times, and (lang, n) (eager).

    A phrase is never more frequent than its parts, so one scan counts hashes of words, one hashes of pairs
    of frequent words, one hashes of triples of frequent pairs, and the last counts the words and phrases themselves
    whose parts may all be frequent.  Bit filters of fixed size tell: a false bit costs counting, never
    a phrase.  In the last scan each task counts in tries of bounded size and spills whole subtrees as sorted runs.
    """
    texts = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), whole_text().alias("text"))
    context, filters = docs.sparkSession.sparkContext, []
    for _ in range(min(LEVELS, longest)):
        counted = texts.mapInArrow(functools.partial(_count_hashes, filters=list(filters)), "hash bigint, a bigint")
        filters.append(context.broadcast(_filter(counted, least)))
    count = functools.partial(_count_phrases, filters=filters, longest=longest, burst=burst, held=held)
    counts, whole = stored(_merged(texts.mapInArrow(count, RUNS), least), "phrases"), F.col("phrase") == WHOLE.decode()
    phrases = counts.where(~whole).select("lang", "phrase", F.size(F.split("phrase", " ")).alias("size"), "a")
    return phrases, counts.where(whole).select("lang", F.col("a").alias("n"))


def _part(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, burst: int = BURST, held: int = HELD) -> DataFrame:
    """The `top` phrases of each language by the score of their weakest cut: lang, rank, phrase, a, l, r, n, score (eager).

    `docs` has lang and text; other columns are left out, whatever their names.  A-Z count as lower case; texts
    fall into pieces at marks and line ends, pieces into words at spaces and tabs.  Candidates are phrases of 2 to
    `longest` words that occur `least` times.  A cut after k words has score floor(1000 a n / (l r)), in exact decimals; the
    lowest counts, ties to the smallest k.  A candidate goes where a longer one holds its words in a row and occurs as
    often.  Ties in rank go by a, then phrase.  Null lang is `und`, null text empty; repeated rows count each;
    empty tables have no phrases.
    """
    counts, totals = phrase_counts(docs, least, longest, burst, held)
    words, size = F.split("phrase", " "), F.col("size")
    candidates = counts.where(size > 1)
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"first": _part(words, F.lit(1), F.col("k")), "rest": _part(words, F.col("k") + 1, size - F.col("k"))})
    of = lambda part, name: counts.select("lang", F.col("phrase").alias(part), F.col("a").alias(name))
    cuts = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    wide = {c: F.col(c).cast("decimal(19,0)") for c in "anlr"}
    cuts = cuts.withColumns({"over": F.lit(1000) * wide["a"] * wide["n"], "under": wide["l"] * wide["r"]})
    weakest = F.min(F.struct(F.expr("over div under").alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(weakest)

    inside = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(
        F.sequence(F.lit(1), size - m + 1), lambda start: _part(words, start, m))))
    longer = counts.where(size > 2).select("lang", F.explode(inside).alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.coalesce("longer", F.lit(0)) * 100 < F.col("a") * 100)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    ranked = kept.withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


@query
def op12_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The strongest collocations of each language over all documents."""
    return collocations(table(spark, folder, "documents"))


ORACLE = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0b\\x0c\\r]')) AS piece FROM documents),
worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda w: w <> '') AS words FROM pieces),
totals AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM worded GROUP BY lang),
grams AS (SELECT lang, m, words, unnest(range(1, len(words) - m + 2)) AS i FROM worded, range(1, {LONGEST + 1}) AS sizes(m) WHERE len(words) >= m),
counts AS (
  SELECT lang, array_to_string(words[i:i + m - 1], ' ') AS phrase, m, count(*) AS a FROM grams GROUP BY 1, 2, 3 HAVING count(*) >= {LEAST}),
cuts AS (
  SELECT lang, phrase, string_split(phrase, ' ') AS words, m, a, unnest(range(1, m)) AS k FROM counts WHERE m > 1),
scored AS (
  SELECT c.lang, c.phrase, c.m, c.a, k, f.a AS l, s.a AS r, n,
    CAST((CAST(1000 AS HUGEINT) * c.a * n) // (CAST(f.a AS HUGEINT) * s.a) AS BIGINT) AS score
  FROM cuts c JOIN counts f ON f.lang = c.lang AND f.phrase = array_to_string(c.words[1:k], ' ')
  JOIN counts s ON s.lang = c.lang AND s.phrase = array_to_string(c.words[k + 1:c.m], ' ') JOIN totals t ON t.lang = c.lang),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM weakest w WHERE NOT EXISTS (
    SELECT 1 FROM counts c WHERE c.lang = w.lang AND c.m > w.m AND 100 * c.a >= 100 * w.a
      AND contains(' ' || c.phrase || ' ', ' ' || w.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= {TOP}
"""
