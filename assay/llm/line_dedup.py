"""Line dedup over levelled sorted runs of line hashes.

A run is a Parquet table of (hash, docs, keeper), sorted by hash: how many
documents of a batch hold a line and the largest id among them. Each new batch
is a run of level 0; when a level has `fanout` runs they are merged into one of
the next, so a hash is rewritten once per level. `novel` anti-joins a batch to
the runs, `add` adds the batch's own, `repeated` merges all runs and tells the
lines that enough documents share.

* A null or empty text is one empty line. A line's key is the line without ASCII
  white space at both ends, A to Z in lower case; other characters are kept.
* Keys shorter than `least_chars` code points are never dropped.
* A document that repeats a line counts once; if it is the keeper, it keeps all.
* Rows of equal doc_id count as one document; each loses its own lines. Null
  ids count as one document too, below all others.
* An empty table gives an empty result. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm.common import cut_lineage, fresh, lower_ascii, partitions, shared_folder

LEAST_CHARS, LEAST_DOCS = 40, 5
BATCHES, FANOUT = 8, 4
BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return lower_ascii(F.trim(line, F.lit(BLANK)))


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """Levelled runs below a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.folder = folder or shared_folder(spark)
        self.levels: list[list[str]] = []
        self.written = 0

    def _write(self, rows: DataFrame, level: int) -> None:
        path = f"{self.folder}/level-{level}/run-{self.written}"
        self.written += 1
        ordered = rows.repartitionByRange(partitions(self.spark), "hash")
        ordered.sortWithinPartitions("hash").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def read(self) -> DataFrame | None:
        """The rows of all runs; a hash has one for each run that holds it."""
        paths = [p for level in self.levels for p in level]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else None

    @staticmethod
    def merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy("hash").agg(
            F.sum("docs").alias("docs"), F.max("keeper").alias("keeper")
        )

    def novel(self, batch: DataFrame) -> DataFrame:
        """Rows of `batch` (with a column hash) whose line no run holds."""
        held = self.read()
        return batch if held is None else batch.join(held.select("hash"), "hash", "left_anti")

    def add(self, batch: DataFrame) -> None:
        """Add a batch's lines (hash, doc_id, once for each document) as a run."""
        own = batch.groupBy("hash").agg(
            F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("keeper")
        )
        self._write(own, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            full = self.spark.read.schema(SCHEMA).parquet(*self.levels[level])
            self._write(self.merged(full), level + 1)
            self.levels[level] = []
            level += 1

    def repeated(self, least_docs: int = LEAST_DOCS) -> DataFrame:
        """hash, keeper of the lines that at least so many documents hold.

        Batches must not share documents, or those count more than once.
        """
        return self.merged(self.read()).where(F.col("docs") >= least_docs).drop("docs")


SCHEMA = "hash binary, docs long, keeper long"


def numbered_lines(documents: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc_id, text_hash, at (from 0), hash: the lines long enough to be dropped."""
    lines = documents.select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        F.posexplode(text_lines(F.col("text"))).alias("at", "line"),
    ).withColumn("key", line_key(F.col("line")))
    return lines.where(F.char_length("key") >= least_chars).select(
        "doc_id", "text_hash", "at", F.unhex(F.md5("key")).alias("hash")
    )


def dropped_lines(
    documents: DataFrame,
    least_chars: int = LEAST_CHARS,
    least_docs: int = LEAST_DOCS,
    batches: int = BATCHES,
    runs: LineRuns | None = None,
) -> DataFrame:
    """doc_id, text_hash, drops: per document the sorted places of the lines it loses."""
    spark = documents.sparkSession
    runs = runs or LineRuns(spark)
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).alias("batch")
    folder = shared_folder(spark)
    lines = numbered_lines(documents, least_chars).select("*", batch)
    lines.write.partitionBy("batch").parquet(folder)
    kept = "doc_id long, text_hash long, at int, hash binary, batch int"
    lines = spark.read.schema(kept).parquet(folder)
    for number in range(batches):
        runs.add(lines.where(F.col("batch") == number).select("hash", "doc_id").distinct())
    # Written out: both sides of the join are then shuffled as they are, and Spark can
    # split the line that many documents hold.
    doubled = lines.drop("batch").join(cut_lineage(runs.repeated(least_docs)), "hash")
    lost = doubled.where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    places = F.array_sort(F.collect_set("at")).alias("drops")
    return lost.groupBy("doc_id", "text_hash").agg(places)


def without(lines: Column, drops: Column) -> Column:
    """The lines but those at the sorted places: slices between them, in linear time."""
    ends = F.concat(drops, F.array(F.size(lines)))
    starts = F.concat(F.array(F.lit(0)), F.transform(drops, lambda at: at + 1))
    pairs = F.arrays_zip(starts.alias("a"), ends.alias("b"))
    return F.flatten(F.transform(pairs, lambda p: F.slice(lines, p.a + 1, p.b - p.a)))


def dedup_lines(
    documents: DataFrame,
    least_chars: int = LEAST_CHARS,
    least_docs: int = LEAST_DOCS,
    batches: int = BATCHES,
    n_lines: str = "n_lines",
    n_dropped: str = "n_dropped",
) -> DataFrame:
    """The documents, text without repeated lines, with counts of lines and dropped ones.

    A text that loses nothing is left as it is, null included. Where the documents have a column
    of the counts' names, case aside, it stays and the counts get names like them.
    """
    n_lines, n_dropped = fresh(documents, n_lines, n_dropped)
    digest, its_doc, its_text, drops = fresh(documents, "_digest", "_doc", "_text", "_drops")
    lost = dropped_lines(documents, least_chars, least_docs, batches).select(
        F.col("doc_id").alias(its_doc),
        F.col("text_hash").alias(its_text),
        F.col("drops").alias(drops),
    )
    rows = documents.withColumn(digest, F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col(its_doc)) & (F.col(digest) == F.col(its_text))
    joined = rows.join(lost, same, "left")
    cut = F.array_join(without(text_lines(F.col("text")), F.col(drops)), "\n")
    text = F.when(F.col(drops).isNull(), F.col("text")).otherwise(cut)
    others = [
        text.alias(c) if c == "text" else F.col(f"`{c}`") for c in documents.columns
    ]
    return joined.select(
        *others,
        F.size(text_lines(F.col("text"))).cast("long").alias(n_lines),
        F.coalesce(F.size(F.col(drops)), F.lit(0)).cast("long").alias(n_dropped),
    )
