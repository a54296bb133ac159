"""Order MinHash fingerprints, in DataFrame functions only.

A text becomes tokens (runs without white space, long ones cut every
``token_chars`` characters, so unspaced text has tokens too) and the k-mers of
``k`` neighbouring tokens. A k-mer is numbered by its occurrence, which makes
the multiset a set. The hashes of the numbered k-mers lie on a circle. Each of
the ``functions`` is a point of it, and orders all k-mers of any text by their
distance behind that point; it takes the ``tuple_size`` least of all k-mers of
the text, which are put back into text order and hashed together. So one hash
and one sort serve all functions and each of them is min-wise over every k-mer
(on texts with fewer k-mers than points, neighbouring functions often agree:
the estimate is as right on average and varies more). The fingerprint is the
list of these ``functions`` values, and the likeness of two fingerprints the
share of equal values: an estimate that falls with the edit distance, since a
moved passage changes the order within tuples and not only the set.

Everything happens within the row, on arrays: hashing, numbering (only where
a k-mer repeats: a sort of the upper half of the hash and the place packed into one BIGINT, then run starts by pointer doubling,
log2 of the longest possible run steps), selection and tuples. Rows with hot
texts or copies need no grouping.

``with_next`` pairs each row with its successor by key without a global
window: keys alone are range-partitioned, the successor is found inside a
partition and the last of each looks up the next partition's first.

Defined results: null, empty and blank texts have no k-mers and one common
fingerprint, as alike as any equal texts; a text of fewer than ``k`` tokens is
one k-mer; fewer than ``tuple_size`` k-mers make shorter tuples. Keys are whole
numbers (they are compared as BIGINT). A null key comes before all others. Of rows that repeat a key, the one with the least
(text, fingerprint) is the successor of the key before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEAST_KEY = -(1 << 63)
PLACE_BITS = 32  # a text has fewer than 2^31 tokens
MASK = (1 << PLACE_BITS) - 1


def kmers(text: Column, k: int, token_chars: int) -> Column:
    """The hashes of a text's k-mers, in text order."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S{1,%d}" % token_chars), F.lit(0))
    return F.transform(
        F.array(tokens),
        lambda t: F.when(F.size(t) == 0, F.array().cast("array<bigint>"))
        .when(F.size(t) < k, F.array(F.xxhash64(t)))
        .otherwise(
            F.transform(F.sequence(F.lit(0), F.size(t) - k), lambda i: F.xxhash64(*(F.get(t, i + j) for j in range(k))))
        ),
    )[0]


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once: a lambda's variable instead of a repeated expression."""
    return F.transform(F.array(value), body)[0]


def _kmer(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(~MASK))


def _place(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(MASK))


def numbered(hashes: Column) -> Column:
    """A text's numbered k-mers, each one BIGINT: the upper bits hash k-mer and occurrence, the lower are its place."""

    def finished(packed: Column, occurrence: Column) -> Column:
        return F.xxhash64(_kmer(packed), occurrence).bitwiseAND(F.lit(~MASK)).bitwiseOR(_place(packed))

    def repeated(packed: Column, repeats: Column) -> Column:
        """Sorted, equal k-mers stand together in text order; a run's start comes to its members by pointer doubling."""

        def number(s: Column) -> Column:
            first = F.transform(s, lambda x, i: F.when((i == 0) | (_kmer(F.get(s, i - 1)) != _kmer(x)), i).otherwise(F.lit(-1)))
            steps = F.sequence(F.lit(0), F.ceil(F.log2((repeats + 1).cast("double"))).cast("int"))
            starts = F.aggregate(
                steps,
                first,
                lambda held, t: F.transform(
                    held, lambda x, i: F.greatest(x, F.coalesce(F.get(held, i - F.call_function("shiftleft", F.lit(1), t)), F.lit(-1)))
                ),
            )
            return _let(starts, lambda begin: F.transform(s, lambda x, i: finished(x, i - F.get(begin, i))))

        return _let(F.sort_array(packed), number)

    def choose(packed: Column) -> Column:
        repeats = F.size(packed) - F.size(F.array_distinct(F.transform(packed, _kmer)))
        return _let(
            repeats, lambda n: F.when(n == 0, F.transform(packed, lambda x: finished(x, F.lit(0)))).otherwise(repeated(packed, n))
        )

    return _let(F.transform(hashes, lambda h, i: _kmer(h).bitwiseOR(i.cast("bigint"))), choose)


def fingerprint(text: Column, k: int = 3, tuple_size: int = 2, functions: int = 32, token_chars: int = 8) -> Column:
    """The Order MinHash of a text: ARRAY<INT> of ``functions`` values (a power of two)."""
    step = (1 << 64) // functions
    points = F.array(*(F.lit((j * step | MASK) - (1 << 63)) for j in range(functions)))  # no k-mer has this place

    def is_point(x: Column) -> Column:
        return _place(x) == MASK

    def circle(marked: Column) -> Column:
        before = F.filter(F.transform(marked, lambda x, i: F.when(is_point(x), i).otherwise(F.lit(-1))), lambda i: i >= 0)

        def tuples(s: Column) -> Column:
            def value(at: Column, j: Column) -> Column:
                chosen = F.transform(F.sequence(F.lit(0), F.least(F.size(s), F.lit(tuple_size)) - 1), lambda t: F.get(s, F.pmod(at - j + t, F.size(s))))
                ordered = F.sort_array(F.transform(chosen, _by_place))
                return F.hash(F.transform(ordered, _place))

            return F.when(F.size(s) == 0, F.array_repeat(F.hash(F.array().cast("array<bigint>")), functions)).otherwise(F.transform(before, value))

        return _let(F.filter(marked, lambda x: ~is_point(x)), tuples)

    return _let(F.sort_array(F.concat(numbered(kmers(text, k, token_chars)), points)), circle)


def _by_place(packed: Column) -> Column:
    """The halves exchanged: sorting goes by place; twice gives the same again."""
    return F.shiftleft(packed, PLACE_BITS).bitwiseOR(F.shiftrightunsigned(packed, PLACE_BITS))


def to_hex(prints: Column) -> Column:
    return F.array_join(F.transform(prints, lambda x: F.lpad(F.lower(F.hex(x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal values of two fingerprints."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same.cast("double") / F.size(a)


def successors(keys: DataFrame) -> DataFrame:
    """key, next: every distinct key with the next greater one; after the last comes the first.

    ``keys`` has the BIGINT column key. The partition numbers are written
    down, so a recomputed task can't move a key.
    """
    ranged = keys.select("key").distinct().repartitionByRange("key").withColumn("part", F.spark_partition_id()).checkpoint()
    inside = ranged.withColumn("next", F.lead("key").over(W.partitionBy("part").orderBy("key")))
    firsts = ranged.groupBy("part").agg(F.min("key").alias("first"))  # one row for each task of the range exchange
    order = W.orderBy("part")
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    after = firsts.select("part", F.coalesce(F.lead("first").over(order), F.first("first").over(whole)).alias("after"))
    return inside.join(after, "part").select("key", F.coalesce("next", "after").alias("next"))


def with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", share: int = 4, **parameters: int) -> DataFrame:
    """Every row's text and fingerprint beside those of its edited text, and its successor's fingerprint.

    The edit replaces the last floor(n / ``share``) code points by the first
    as many of the successor's text. The texts are shuffled once: both joins
    are on the key and share the exchange; only the successors' beginnings
    and fingerprints move a second time.
    """
    rows = docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(LEAST_KEY)).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumn("print", fingerprint(F.col("text"), **parameters))  # the same columns for both joins: one exchange
    cuts = docs.select(
        F.coalesce(F.col(key).cast("bigint"), F.lit(LEAST_KEY)).alias("key"),
        F.floor(F.coalesce(F.length(text), F.lit(0)) / share).cast("int").alias("cut"),
    )
    cuts = cuts.groupBy("key").agg(F.max("cut").alias("cut"))
    pairs = successors(cuts).join(cuts, "key").select(F.col("key").alias("before"), F.col("next").alias("key"), "cut")
    starts = rows.join(pairs, "key").select(
        F.col("before").alias("key"), F.struct(F.substring("text", F.lit(1), F.col("cut")).alias("start"), F.col("print")).alias("after")
    )
    starts = starts.groupBy("key").agg(F.min("after").alias("after"))
    joined = rows.join(starts, "key").withColumn("n_chars", F.length("text"))
    cut = F.floor(F.col("n_chars") / share).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), F.col("n_chars") - cut), F.substring("after.start", F.lit(1), cut)
    )
    own = F.nullif("key", F.lit(LEAST_KEY)).cast(docs.schema[key].dataType).alias(key)
    done = joined.select(own, "text", "n_chars", "print", edited.alias("edited"), F.col("after.print").alias("next_print"))
    return done.withColumn("edited_print", fingerprint(F.col("edited"), **parameters))
