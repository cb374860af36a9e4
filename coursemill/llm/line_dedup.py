"""Line dedup with levelled sorted runs of line hashes.

A store keeps runs, tables sorted by line hash with the number of documents that hold the line and
the largest doc_id among them. Documents come in batches, those with the largest ids first. The
lines of a batch are summed up, merge-joined with the runs, and added as a run of level 0; a level
that has ``fanout`` runs is merged into one run of the next level.

As ids fall from batch to batch, the keeper of a line, its largest doc_id, is known when the line is
first seen. So a batch can drop its lines as soon as three documents hold them. Where two do so far,
the one that isn't the keeper waits: it is the only one that a later batch can still overtake, and
the finished runs decide it. DataFrame operations only; rows of one line are never brought together
but in joins, which adaptive execution splits.

Lines are compared by 128 bits of hash.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coursemill.session import new_path, release, stash

BLANKS = " \t\n\x0b\x0c\r"
LEAST_CHARS = 20
LEAST_DOCS = 3
NO_ID = -(2**63)
FIRST_BATCH = 1 << 14


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; pure ASCII takes the faster way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


class LineRuns:
    """Levelled sorted runs in the shared folder. Runs that were merged are removed by clean()."""

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = [[]]
        self.merged_away: list[DataFrame] = []

    def _write(self, run: DataFrame, level: int) -> DataFrame:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(stash(run.sortWithinPartitions("h1", "h2"), f"run-level{level}"))
        return self.levels[level][-1]

    @staticmethod
    def _union(runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for run in runs[1:]:
            out = out.unionByName(run)
        return out.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("keeper").alias("keeper")) if len(runs) > 1 else out

    def add(self, lines: DataFrame) -> DataFrame:
        """Add a batch's lines (h1, h2, did) as a sorted run, merge the levels that are full, and return the batch's run. No document may be in two batches."""
        held = lines.groupBy("h1", "h2", "did").agg(F.lit(1).alias("one"))
        own = self._write(held.groupBy("h1", "h2").agg(F.sum("one").alias("docs"), F.max("did").alias("keeper")), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self.merged_away += full
            self._write(self._union(full), level + 1)
            level += 1
        return own

    def merged(self) -> DataFrame | None:
        """All runs as one, a row for each line hash; None if there are none."""
        runs = [run for level in self.levels for run in level]
        return self._union(runs) if runs else None

    def clean(self) -> None:
        release(*self.merged_away)
        self.merged_away = []


def line_table(docs: DataFrame) -> DataFrame:
    """did, tie, pos, h1, h2 of every line whose key is long enough to count."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64(text).alias("tie"), F.posexplode(F.split(ascii_lower(text), "\n", -1)).alias("pos", "line"))
    key = F.btrim(F.col("line"), F.lit(BLANKS))
    return rows.withColumn("key", key).filter(F.char_length("key") >= LEAST_CHARS).select("did", "tie", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))


def batches_for(rows: int) -> int:
    """How many batches so many documents come in: four for some ten thousand, one more for each doubling, so that runs are merged up level by level as the corpus grows."""
    return max(4, (rows // FIRST_BATCH).bit_length() + 2)


def dropped_lines(docs: DataFrame, batches: int | None = None, fanout: int = 4, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(did, tie, pos) of every line that goes, batch by batch. batches: by default as batches_for() has it."""
    spark = docs.sparkSession
    batches = batches or batches_for(docs.count())
    edges = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [k / batches for k in range(1, batches)])).first()[0] or []
    path = new_path(spark, "lines")
    lines = line_table(docs)
    batch = F.lit(0)
    for edge in sorted(set(edges)):
        batch = batch + (F.col("did") < edge).cast("int")
    lines.withColumn("batch", batch).write.partitionBy("batch").option("compression", "zstd").parquet(path)
    lines = spark.read.schema("did long, tie long, pos int, h1 long, h2 long, batch int").parquet(path)
    runs, found = LineRuns(spark, fanout), []
    for k in range(len(set(edges)) + 1):
        own = lines.filter(F.col("batch") == k).drop("batch")
        before = runs.merged()
        run = runs.add(own.select("h1", "h2", "did"))
        if before is not None:
            earlier = before.select("h1", "h2", F.col("docs").alias("docs_before"), F.col("keeper").alias("keeper_before"))
            run = run.join(earlier.hint("merge"), ["h1", "h2"], "left").select("h1", "h2", (F.col("docs") + F.coalesce("docs_before", F.lit(0))).alias("docs"), F.coalesce("keeper_before", "keeper").alias("keeper"))
        held = own.join(run.filter("docs >= 2").hint("merge"), ["h1", "h2"]).filter("did <> keeper")
        found.append(stash(held.select("did", "tie", "pos", "h1", "h2", "docs"), "held"))
        runs.clean()
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    common = runs.merged().filter(F.col("docs") >= least_docs).select("h1", "h2")
    waiting = every.filter(F.col("docs") < least_docs).join(common.hint("merge"), ["h1", "h2"], "left_semi")
    return every.filter(F.col("docs") >= least_docs).unionByName(waiting).select("did", "tie", "pos")


def dedup_lines(docs: DataFrame, **params) -> DataFrame:
    """row (a struct of all columns of ``docs``), n_lines, n_dropped, kept (the text without repeated lines).

    A line's key is the line without blanks at both ends, A-Z lower-cased. Keys of at least 20 code
    points that stand in at least three documents lose all their lines, except in the largest doc_id
    that holds them. A null or empty text is one empty line. Rows with the same doc_id count as one
    document, rows without an id as one that is smaller than all others. Texts of any length are split
    whole; other columns stay as they are, whatever their names. An empty table gives no rows.
    """
    gone = dropped_lines(docs, **params).groupBy("did", "tie").agg(F.collect_set("pos").alias("gone"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64(text).alias("tie"))
    found = rows.join(gone, ["did", "tie"], "left").withColumn("body", F.coalesce("row.text", F.lit(""))).withColumn("all", F.split("body", "\n", -1))
    n = F.size("all")
    lost = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone"))
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.col("gone"))  # in ascending order
    kept = F.array_join(F.transform(stay, lambda p: F.get("all", p)), "\n")
    return found.select("row", n.cast("long").alias("n_lines"), lost.cast("long").alias("n_dropped"), F.when(F.col("gone").isNull(), F.col("body")).otherwise(kept).alias("kept"))


def dedup_digests(docs: DataFrame, **params) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of what stays of every document. Cases as in dedup_lines(); columns beside doc_id and text are ignored, whatever their names."""
    slim = docs.select("doc_id", "text")
    out = dedup_lines(slim, **params)
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def dedup_documents(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with the repeated lines gone from text, and n_chars set anew where it is a column."""
    out = dedup_lines(docs, **params)
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


ORACLE = """
WITH lines AS (
  SELECT doc_id, pos, ls[pos] AS line, translate(trim(ls[pos], chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
common AS (SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT l.doc_id, l.pos, l.line, (c.k IS NOT NULL AND l.doc_id <> c.keeper) AS dropped FROM lines l LEFT JOIN common c ON l.k = c.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (dropped))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
