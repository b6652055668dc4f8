"""Deletion of repeated passages by winnowed line fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobmargin.llm.common import query, table, whole_text

WORDS = 50
BLANKS = " \t\r\f\x0b"


def _key() -> list[Column]:
    """A row by its id and its text; rows that agree in both are one passage bearer."""
    return [F.col("doc_id"), F.xxhash64(whole_text()).alias("key")]


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, key, pos, line (hash), words, before, until for each line that is not blank; words counted from the document's start."""
    lines = docs.select(*_key(), F.posexplode(F.split(whole_text(), "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(BLANKS))).where("line != ''")
    words = (F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1).cast("long")
    hashed = lines.select("doc_id", "key", "pos", words.alias("words"), F.xxhash64("line").alias("line"))
    whole = hashed.repartition("doc_id", "key").dropDuplicates(["doc_id", "key", "pos"])
    until = F.sum("words").over(Window.partitionBy("doc_id", "key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return whole.withColumn("until", until).withColumn("before", F.col("until") - F.col("words"))


def windows(lines: DataFrame, words: int) -> DataFrame:
    """doc_id, key, first, last, mark, content of each window: from each line on, and up to each line, the fewest lines with `words` words.

    Every run of lines with that many words holds such a window for each of its lines, and a window's
    choice depends on its content alone: the least line hash, its fingerprint.  So a repeated
    run shares its fingerprints with the earlier one, whatever stands around it.
    """
    own = Window.partitionBy("doc_id", "key")
    ahead = own.orderBy("before").rangeBetween(Window.currentRow, words - 1)
    behind = own.orderBy("until").rangeBetween(1 - words, Window.currentRow)

    def window(frame, first, last, begin, end):
        return F.when(end - begin >= words, F.struct(
            first.alias("first"), last.alias("last"), F.min("line").over(frame).alias("mark"),
            F.xxhash64(F.collect_list("line").over(frame)).alias("content"),
        ))

    pos, before, until = F.col("pos"), F.col("before"), F.col("until")
    seen = lines.select("doc_id", "key", F.array_compact(F.array(
        window(ahead, pos, F.last(pos).over(ahead), before, F.last(until).over(ahead)),
        window(behind, F.first(pos).over(behind), pos, F.first(before).over(behind), until),
    )).alias("both"))
    return seen.select("doc_id", "key", F.inline("both"))


def repeated_runs(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, key, runs (first, last line) for rows with runs of at least `words` words that stand earlier elsewhere.

    Positions meet by fingerprint and are extended both ways to the bounds of their windows: those
    with equal fingerprint and equal lines are one group, whose earliest position (by doc_id, nulls
    last, then text hash and line) stays.  No pairs are formed; a group is reduced to its earliest member
    before the exchange.  Windows of one row that overlap or touch join into maximal runs.
    """
    found = windows(line_table(docs), words)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "first")
    earliest = found.groupBy("mark", "content").agg(F.min(place).alias("earliest"), F.count("*").alias("n")).where("n > 1")
    later = found.join(earliest.drop("n"), ["mark", "content"]).where(place > F.col("earliest")).select("doc_id", "key", "first", "last").distinct()
    order = Window.partitionBy("doc_id", "key").orderBy("first", "last")
    reached = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = later.withColumn("starts", (reached.isNull() | (F.col("first") > reached + 1)).cast("int"))
    numbered = starts.withColumn("run", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy("doc_id", "key", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return runs.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


def delete_repeats(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows of `docs` without later repeated runs: text shortened, runs (array of first, last), n_lines and removed_lines added.

    Lines are compared without white space at their ends.  A run is lines in a row, blank ones aside,
    with `words` words or more (spaces inside lines, plus one for each line).  It may lie in the same document
    as the earlier one.  Null text counts as empty; texts without a repeated run stay as they are, null
    included; a text may become empty.  Rows of equal id and text are treated alike; other
    columns pass through, and columns of the added names are replaced.
    """
    runs = repeated_runs(docs, words).withColumnsRenamed({"doc_id": "_doc", "key": "_key", "runs": "_runs"})
    keyed = docs.withColumn("_own", F.xxhash64(whole_text()))
    joined = keyed.join(runs, keyed["doc_id"].eqNullSafe(runs["_doc"]) & (F.col("_own") == F.col("_key")), "left")
    lines = F.split(whole_text(), "\n", -1)
    kept = F.filter(lines, lambda _, i: ~F.exists("_runs", lambda run: (run["first"] <= i) & (run["last"] >= i)))
    removed = F.aggregate(F.coalesce("_runs", F.array()), F.lit(0), lambda n, run: n + run["last"] - run["first"] + 1)
    return joined.withColumns({
        "n_lines": F.size(lines), "removed_lines": removed, "runs": F.coalesce("_runs", F.array()),
        "text": F.when(F.col("_runs").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")),
    }).drop("_own", "_doc", "_key", "_runs")


@query
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return delete_repeats(table(spark, folder, "documents")).select("doc_id", "n_lines", "removed_lines", "text")


ORACLE = f"""
WITH whole AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
parts AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM whole),
lines AS (SELECT doc_id, text, unnest(range(len(lines))) AS pos, unnest(lines) AS line FROM parts),
trimmed AS (SELECT doc_id, text, pos, trim(line, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS line FROM lines),
counted AS (SELECT *, length(line) - length(replace(line, ' ', '')) + 1 AS words FROM trimmed WHERE line <> ''),
summed AS (SELECT *, CAST(sum(words) OVER (PARTITION BY doc_id, text ORDER BY pos) AS BIGINT) AS until FROM counted),
placed AS (SELECT *, until - words AS before FROM summed),
windows AS (
  SELECT doc_id, text, pos AS first, last(pos) OVER w AS last, array_to_string(list(line) OVER w, chr(10)) AS content,
    last(until) OVER w - before AS words
  FROM placed WINDOW w AS (PARTITION BY doc_id, text ORDER BY before RANGE BETWEEN CURRENT ROW AND {WORDS - 1} FOLLOWING)
  UNION ALL
  SELECT doc_id, text, first(pos) OVER w, pos, array_to_string(list(line) OVER w, chr(10)), until - first(before) OVER w
  FROM placed WINDOW w AS (PARTITION BY doc_id, text ORDER BY until RANGE BETWEEN {WORDS - 1} PRECEDING AND CURRENT ROW)),
ranked AS (SELECT *, dense_rank() OVER (PARTITION BY content ORDER BY doc_id, text, first) AS place FROM windows WHERE words >= {WORDS}),
later AS (SELECT DISTINCT doc_id, text, unnest(range(first, last + 1)) AS pos FROM ranked WHERE place > 1),
marked AS (SELECT l.doc_id, l.text, l.pos, l.line, d.pos IS NOT NULL AS gone
  FROM lines l LEFT JOIN later d ON l.doc_id = d.doc_id AND l.text = d.text AND l.pos = d.pos),
kept AS (SELECT doc_id, text, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS removed_lines,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept
  FROM marked GROUP BY doc_id, text)
SELECT d.doc_id, CAST(k.n_lines AS INT) AS n_lines, CAST(k.removed_lines AS INT) AS removed_lines, k.kept AS text
FROM documents d JOIN kept k ON d.doc_id = k.doc_id AND coalesce(d.text, '') = k.text
"""
