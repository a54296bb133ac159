"""Importance resampling towards a target: hashed n-gram weights, a seeded Gumbel draw without replacement.

Words are runs of letters, digits and code points beyond ASCII, after A-Z are
lower-cased; features are all runs of 1 to ``n`` consecutive words, joined by
one space, and a feature's bucket is the CRC-32 of its UTF-8 bytes modulo
``buckets``. One scan over a text keeps a ring of running CRC states, one for
each of the last ``n`` starts, extends each by a space and the next word and
emits its bucket, so a run is never put together and no byte is hashed for
each run that holds it from its start. The scan runs once for each document;
its buckets are written, and counts and weights read them.

A bucket's gain is the logarithm of its smoothed share in the target over that
in the corpus, in thousandths, rounded down. A document's weight is the mean
gain of its features, rounded down; its score adds Gumbel noise that follows
from the seed and the id, and the highest scores are drawn.

Scale. Counts are summed in each task before they are shuffled; what is
gathered are ``buckets`` numbers for the corpus and as many for the target.
Ranks need no sort of all documents: documents are counted by score (a whole
number between about -60,000 and 80,000, whatever the number of documents),
which says where each score's ranks begin and where the draw ends; only
documents of drawn scores are sorted, each score by itself.

Defined results: null and empty texts have no features and the weight 0.
Repeated rows each take a rank. A null id is hashed as the empty string and
comes last among equal scores. Without documents there are no rows; without
target texts all target counts are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrashift.llm.storage import written

#: Every byte as itself, A-Z in small letters, ASCII that is neither letter nor digit as a space.
SMALL = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
PIECE = 1 << 20


def word_pieces(text: str | None, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists from about ``size`` bytes each."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(SMALL)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + size)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def ring_buckets(pieces: Iterator[list[bytes]], n: int, buckets: int) -> tuple[int, np.ndarray]:
    """The number of words, and the bucket of every run of 1 to ``n`` of them."""
    count, found, ring = 0, [np.zeros(0, np.uint32)], []
    for words in pieces:
        count += len(words)
        out: list[int] = []
        for word in words:
            ring = [crc32(word, crc32(b" ", state)) for state in ring]
            ring.append(crc32(word))
            out += ring
            if len(ring) == n:
                del ring[0]  # a run of n words grows no further
        found.append((np.array(out, np.uint32) % np.uint32(buckets)).astype(np.uint32))
    return count, np.concatenate(found)


def bucketed(docs: DataFrame, key: str, text: str, n: int, buckets: int) -> DataFrame:
    """id, n_words and buckets (little-endian, two or four bytes each) of every row."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                counts, found = zip(*(ring_buckets(word_pieces(t.as_py()), n, buckets) for t in part.column(1)))
                cols = [part.column(0), pa.array(counts, pa.int64()), pa.array([x.astype(kind).tobytes() for x in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "n_words", "buckets"])

    held = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {held}, n_words bigint, buckets binary")


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """How many features each bucket has over all ``rows``: one partial count a task, summed by bucket."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), kind), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in rows.select("buckets").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(share in the target / share in the corpus)) of each bucket, one added to every count."""
    size = float(len(corpus))
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size)))).astype(np.int64)


def noise(seed: int, key: str) -> Column:
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of SHA-256 of ``seed:id``."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def importance_scores(
    docs: DataFrame,
    target: DataFrame,
    n: int = 1,
    buckets: int = 10_000,
    seed: int = 2024,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """``key``, n_words, n_features, weight and score of every row of ``docs``, from a written table."""
    rows = written(bucketed(docs, key, text, n, buckets), "resample-buckets")
    wanted = bucketed(target, target_text, target_text, n, buckets)
    gain = gains(bucket_counts(rows, buckets), bucket_counts(wanted, buckets))
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [gain[np.frombuffer(x.as_buffer(), kind)] for x in batch.column(2)]
            size = [len(x) for x in found]
            weight = [int(x.sum()) // len(x) if len(x) else 0 for x in found]
            cols = [batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(weight, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n_words", "n_features", "weight"])

    held = docs.schema[key].dataType.simpleString()
    weighed = rows.mapInArrow(run, f"id {held}, n_words bigint, n_features bigint, weight bigint")
    scored = weighed.withColumn("score", F.col("weight") + noise(seed, "id"))
    return written(scored.withColumnRenamed("id", key), "resample-scores")


def with_ranks(scored: DataFrame, percent: int = 10, min_words: int = 20, key: str = "doc_id") -> DataFrame:
    """``scored`` with rank: 1, 2, 3, ... by falling score for the ``percent`` hundredths drawn of the documents with ``min_words``."""
    held = scored.where(F.col("n_words") >= min_words)
    counted = sorted(((r.score, r.n) for r in held.groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    drawn = sum(n for _, n in counted) * percent // 100
    begins, before = [], 0
    for score, n in counted:
        if before >= drawn:
            break
        begins.append((score, before))
        before += n
    if not begins:
        return scored.withColumn("rank", F.lit(None).cast("bigint"))
    cut = begins[-1][0]
    chosen = (F.col("n_words") >= min_words) & (F.col("score") >= cut)
    starts = scored.sparkSession.createDataFrame(begins, "score bigint, before bigint")
    place = F.col("before") + F.row_number().over(Window.partitionBy("score").orderBy(F.col(key).asc_nulls_last()))
    ranked = scored.where(chosen).join(starts, "score").withColumn("rank", place)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).select(*scored.columns, "rank")
    return ranked.unionByName(scored.where(~chosen).withColumn("rank", F.lit(None).cast("bigint")))


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, key: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs``, all columns, that are drawn; rows that share an id are drawn if one of them is."""
    ranks = with_ranks(importance_scores(docs, target, key=key, **how), percent, min_words, key)
    chosen = ranks.where("rank is not null").select(F.col(key).alias("chosen")).distinct()
    return docs.join(chosen, F.col(key).eqNullSafe(F.col("chosen")), "left_semi")
