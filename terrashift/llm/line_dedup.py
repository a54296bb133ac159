"""Line deduplication over levelled sorted runs of line hashes.

A run is a Parquet table of (h1, h2, n_docs, last): the 128-bit hash of a
line's key, in how many documents it was found and the largest document id
that holds it, range-partitioned and sorted by the hash. A batch of documents
adds one run to level 0; when a level holds ``fanout`` runs they are merged
into one run of the next level, so b batches keep about fanout * log(b) runs
and every hash is rewritten log(b) times. A document batch meets the runs in
an equi-join on the hash: its lines are anti-joined by those that the runs
hold (``unseen``), or by those that other documents keep (``deduplicate``).

Only hashes and positions move between executors until the end, when the
positions to drop return to the documents' texts. Counting is pre-aggregated
before every shuffle, so a line that fills a third of all documents costs one
row for each task. Everything is DataFrame code.

Defined results: a null or empty text is one empty line; a key is the line
without ASCII white space at its ends, A-Z lower-cased; keys of fewer than
``min_chars`` code points never count. A line that occurs several times in a
document counts once, and goes or stays as a whole. Rows that repeat a
document id count as documents of their own and, at the largest id, all keep
the line. A null id is smaller than any other. Other columns pass through
``strip_lines`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrashift.llm.storage import fresh_path
from terrashift.llm.url_filter import ascii_lower

BLANK = " \t\n\u000b\u000c\r"
LEAST_ID = -(1 << 63)
RUN_SCHEMA = "h1 bigint, h2 bigint, n_docs bigint, last bigint"


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANK)))


def _ordered_id(key: str) -> Column:
    return F.coalesce(F.col(key).cast("bigint"), F.lit(LEAST_ID))


def line_hashes(docs: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """id, t, pos, h1, h2 of every line whose key is long enough to count; t tells apart texts with one id."""
    rows = docs.select(_ordered_id(key).alias("id"), F.xxhash64(text).alias("t"), text_lines(F.col(text)).alias("lines"))
    lines = rows.select("id", "t", F.posexplode("lines").alias("pos", "line"))
    keyed = lines.where(F.length("line") >= min_chars).select("id", "t", "pos", line_key(F.col("line")).alias("k"))
    return keyed.where(F.length("k") >= min_chars).select(
        "id", "t", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(1), "k").alias("h2")
    )


def run_rows(docs: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """The rows that a batch of documents adds: one for each hash."""
    keys = F.array_distinct(
        F.transform(
            F.filter(
                F.transform(F.filter(text_lines(F.col(text)), lambda x: F.length(x) >= min_chars), line_key),
                lambda k: F.length(k) >= min_chars,
            ),
            lambda k: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2")),
        )
    )
    found = docs.select(_ordered_id(key).alias("id"), F.inline(keys))
    return found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("last"))


class LineRuns:
    """The levels of sorted runs, in the cluster's shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = 4, path: str | None = None):
        self.spark, self.fanout = spark, fanout
        self.path = path or fresh_path(spark, "line-runs")
        self.levels: list[list[str]] = [[]]
        self._next = 0

    def add(self, rows: DataFrame) -> None:
        """Write a batch's rows as a run of level 0, then compact the levels that are full."""
        self._write(rows, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._write(self._merged(self.levels[level]), level + 1)
            self.levels[level] = []
            level += 1

    def _write(self, rows: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        path = f"{self.path}/L{level}-{self._next}"
        self._next += 1
        rows.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2").write.option("compression", "zstd").parquet(path)
        self.levels[level].append(path)

    def _merged(self, paths: list[str]) -> DataFrame:
        rows = self.spark.read.schema(RUN_SCHEMA).parquet(*paths)
        if len(paths) == 1:
            return rows
        return rows.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("last").alias("last"))

    def merged(self) -> DataFrame:
        """One row for each hash over all runs."""
        paths = [p for level in self.levels for p in level]
        return self._merged(paths) if paths else self.spark.createDataFrame([], RUN_SCHEMA)

    def unseen(self, lines: DataFrame) -> DataFrame:
        """Of a batch's lines (h1, h2, ...) those that no run holds yet."""
        return lines.join(self.merged().select("h1", "h2"), ["h1", "h2"], "left_anti")


def add_in_batches(
    runs: LineRuns, docs: DataFrame, batches: int, key: str = "doc_id", text: str = "text", min_chars: int = 40
) -> LineRuns:
    """Add the documents to the runs, dealt into ``batches`` by a hash of their id."""
    for k in range(batches):
        part = docs.where(F.pmod(F.xxhash64(_ordered_id(key)), F.lit(batches)) == k) if batches > 1 else docs
        runs.add(run_rows(part, key, text, min_chars))
    return runs


def dropped_positions(
    docs: DataFrame, runs: LineRuns, key: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5
) -> DataFrame:
    """id, t, drop: of each document that loses lines, the positions of those lines."""
    common = runs.merged().where(F.col("n_docs") >= min_docs).select("h1", "h2", "last")
    lines = line_hashes(docs, key, text, min_chars)
    gone = lines.join(common, ["h1", "h2"]).where("id <> last").select("id", "t", "pos").distinct()
    return gone.groupBy("id", "t").agg(F.collect_list("pos").alias("drop"))


def strip_lines(
    docs: DataFrame,
    runs: LineRuns,
    key: str = "doc_id",
    text: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
    lines: str | None = "n_lines",
    dropped: str | None = "n_dropped",
) -> DataFrame:
    """The documents with ``text`` as it stays, and the columns ``lines`` and ``dropped`` (None: without it).

    A document that keeps all its lines keeps its very text (null too). The
    other columns are packed away meanwhile, so no name of theirs matters, but
    for columns that have the names of the counts: those replace them.
    """
    docs = docs.drop(*(c for c in (lines, dropped) if c is not None))
    drop = dropped_positions(docs, runs, key, text, min_chars, min_docs)
    rows = docs.select(
        _ordered_id(key).alias("id"), F.xxhash64(text).alias("t"), F.col(text).alias("text"), F.struct(*(c for c in docs.columns if c != text)).alias("rest")
    )
    split = rows.join(drop, ["id", "t"], "left").withColumn("lines", text_lines(F.col("text")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    left = F.array_join(F.transform(kept, lambda i: F.get(F.col("lines"), i)), "\n")
    counts = {lines: F.size("lines").cast("bigint"), dropped: F.coalesce(F.size("drop"), F.lit(0)).cast("bigint")}
    return split.select(
        *(F.when(F.col("drop").isNull(), F.col("text")).otherwise(left).alias(c) if c == text else F.col("rest")[c].alias(c) for c in docs.columns),
        *(value.alias(name) for name, value in counts.items() if name is not None),
    )


def deduplicate(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
    batches: int = 4,
    fanout: int = 4,
    lines: str | None = "n_lines",
    dropped: str | None = "n_dropped",
) -> DataFrame:
    """Fold all documents into runs, then take from each text the lines that a later document keeps."""
    runs = add_in_batches(LineRuns(docs.sparkSession, fanout), docs, batches, key, text, min_chars)
    return strip_lines(docs, runs, key, text, min_chars, min_docs, lines, dropped)
