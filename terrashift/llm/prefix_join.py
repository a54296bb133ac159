"""Similarity join of shingle sets by grouped prefixes: links at a Jaccard similarity of ``percent`` hundredths and more.

A document's set is its distinct shingles of ``width`` words (fewer words: the
whole sequence), known by XXH64. All shingles have one order, those that many
documents hold last, and a set's prefix is its first ``n - ceil(t n) + 1``. Two
similar sets share a shingle of their prefixes: the first that they have in
common stands that early in both, and in the smaller set among the first
``n - ceil(2 t n / (1 + t)) + 1``.

Grouped prefix join. Equal sets are one vertex; sets with the same prefix and
the same size are one group, and only groups meet. Groups that share a prefix
shingle are a candidate pair, which the sizes and the places of the first
shared shingle must allow (what comes after it bounds the intersection). What
is left is expanded into pairs of members, as are the members of one group,
and each pair is decided by its exact intersection.

The order. Documents are counted by a hash of each shingle, over all rows;
each task adds up one array of ``2^bits`` counts, these are summed in two
steps and turned into a level for each bucket, whose size has a bound whatever
the number of documents. The levels decide how many candidates there are, and
never which links are found: any order gives the same links.

Hot shingles. A shingle in more than ``hot`` prefixes, a group with more than
``hot`` members and a pair of groups with more than ``hot`` squared pairs of
members are not expanded. The shingles of a family have nearly the same
holders, so holders gather around the least of them, their hub, in one crowd
for all shingles that share it. A crowd meets two of its members first and
then, cell by cell, what is in other components (``simhash.similar_links``).
That returns links which connect whatever all links connect.

Defined results: a null text and a text without words have the empty set,
which is linked with nothing, so its component is its own id. Repeated rows
keep one row each. A row without an id gets the component of its text, whose
id is the smallest that is not null. Without rows there are none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrashift.llm.simhash import _lists, _mixed, _possible, _set_name, _Sets, _texts, _verified, components, shingle_set, similar_links, sketch
from terrashift.llm.storage import written

SLICE = 4096  # counts in a row of the summed arrays
PARTS = 128  # partial sums of a slice
SALTS = 32


def required(n: int, percent: int) -> int:
    """The least intersection of a set of ``n`` with any set that is similar enough."""
    return -(-percent * n // 100)


def prefix_size(n: int, percent: int) -> int:
    return n - required(n, percent) + 1


def smaller_prefix_size(n: Column, percent: int) -> Column:
    """The same for a column of sizes, where the other set is at least as large."""
    return n - F.ceil(2.0 * percent * n / (100 + percent)).cast("bigint") + 1


def count_bits(docs: int) -> int:
    """Buckets for about a hundred shingles each, at most 2^22."""
    return max(12, min(22, (max(1, docs) * 4).bit_length()))


def shingle_levels(docs: DataFrame, text: str, width: int, bits: int) -> np.ndarray:
    """A level for each bucket of shingles: 0 where it has the usual number of documents, one more for each quarter of an octave above."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, met = np.zeros(1 << bits, np.int64), set()
        for batch in batches:
            for t in _texts(batch.column(0)):
                hashes = shingle_set(t, width)
                if not len(hashes) or (name := _set_name(hashes)) in met:
                    continue
                met.add(name)
                np.add.at(total, (hashes >> np.uint64(64 - bits)).astype(np.int64), 1)
        slices = total.reshape(-1, SLICE)
        held = np.flatnonzero(slices.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([slices[k].tobytes() for k in held], pa.binary())], names=["slice", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(SLICE, np.int64)
        for x in group.column("counts"):
            total += np.frombuffer(x.as_buffer(), np.int64)
        return pa.table({"slice": pa.array([group.column("slice")[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    kind = "slice int, counts binary"
    counted = docs.select(F.col(text).alias("text")).mapInArrow(count, kind).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    parts = counted.groupBy("slice", "part").applyInArrow(add, kind)
    total = np.zeros((1 << bits) // SLICE * SLICE, np.int64).reshape(-1, SLICE)
    for r in parts.groupBy("slice").applyInArrow(add, kind).toLocalIterator():
        total[r.slice] = np.frombuffer(bytes(r.counts), np.int64)
    usual = 2 * max(1.0, float(np.median(total)))
    return np.clip(4 * np.log2(np.maximum(total.ravel(), 1) / usual), 0, 255).astype(np.uint8)


def in_order(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The shingles as keys whose order is the common one: by level, then by a mixed hash."""
    bits = len(levels).bit_length() - 1
    level = levels[(hashes >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64)
    return level << np.uint64(56) | _mixed(hashes) >> np.uint64(8)


def prefix(hashes: np.ndarray, percent: int, levels: np.ndarray) -> np.ndarray:
    """The first keys of a set in the common order, sorted."""
    keys, p = in_order(hashes, levels), prefix_size(len(hashes), percent)
    return np.sort(np.partition(keys, p - 1)[:p]) if p < len(keys) else np.sort(keys)


def keyed_sets(docs: DataFrame, key: str, text: str, width: int, percent: int, levels: np.ndarray) -> DataFrame:
    """``key``, fp (a hash of the set, its name), n, sketch, grp (of prefix and size) and prefix; a task gives each set's prefix once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        none = np.zeros(0, np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                names, sizes, sketches, groups, found = [], [], [], [], []
                for t in _texts(part.column(1)):
                    hashes = shingle_set(t, width)
                    first = prefix(hashes, percent, levels) if len(hashes) else none
                    grp = _set_name(np.append(first, np.uint64(len(hashes))))
                    names.append(_set_name(hashes))
                    sizes.append(len(hashes))
                    sketches.append(sketch(hashes))
                    groups.append(grp)
                    found.append(none if grp in met else first)
                    met.add(grp)
                cols = [part.column(0), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(groups, pa.int64()), _lists(found)]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "fp", "n", "sketch", "grp", "prefix"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, fp bigint, n bigint, sketch binary, grp bigint, prefix array<bigint>").withColumnRenamed("key", key)


def group_pairs(held: DataFrame, percent: int) -> DataFrame:
    """g, h (n of g not above that of h): groups that share a prefix shingle and whose sizes and places allow a link.

    ``held`` has k, grp, n and place. The least places are those of the first
    shared shingle of ``held``; where an earlier one is hot, the pair meets by it.
    """
    one = held.select("k", F.col("grp").alias("g"), "n", F.col("place").alias("i")).where(F.col("i") < smaller_prefix_size(F.col("n"), percent))
    two = held.select("k", F.col("grp").alias("h"), F.col("n").alias("m"), F.col("place").alias("j"))
    sized = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("g") < F.col("h")))
    met = one.join(two, "k").where(sized & (F.col("n") * 100 >= F.col("m") * percent))
    first = met.groupBy("g", "h", "n", "m").agg(F.min("i").alias("i"), F.min("j").alias("j"))
    most = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))
    return first.where(most * (100 + percent) >= (F.col("n") + F.col("m")) * percent).select("g", "h")


def set_links(prints: DataFrame, reps: DataFrame, sets: _Sets, percent: int, hot: int, cell: int) -> DataFrame:
    """a, b (a < b): links that connect what all pairs of that similarity connect. ``reps`` has fp, n, sketch and grp of each set."""
    members = reps.select("grp", "fp")
    groups = prints.groupBy("grp", "n").agg(F.max("prefix").alias("prefix"))  # the empty array is the least
    entries = groups.select("grp", "n", F.posexplode("prefix").alias("place", "k"))
    holders = entries.groupBy("k").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1")
    held = written(entries.join(holders, "k"), "prefix-entries")
    sizes = written(members.groupBy("grp").agg(F.count(F.lit(1)).alias("members")), "prefix-groups")

    near = group_pairs(held.where(F.col("holders") <= hot), percent)
    near = near.join(sizes.select(F.col("grp").alias("g"), F.col("members").alias("x")), "g").join(sizes.select(F.col("grp").alias("h"), F.col("members").alias("y")), "h")
    near = written(near.withColumn("many", F.col("x") * F.col("y") > hot * hot), "prefix-pairs")
    one, two = (members.select(F.col("grp").alias(g), F.col("fp").alias(c)) for g, c in (("g", "a"), ("h", "b")))
    between = near.where("not many").join(one, "g").join(two, "h").select("a", "b")

    small = members.join(sizes.where((F.col("members") > 1) & (F.col("members") <= hot)), "grp").select("grp", F.col("fp").alias("a"))
    within = small.join(small.select("grp", F.col("a").alias("b")), "grp").where("a < b").select("a", "b")
    pairs = between.unionByName(within).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = written(_possible(pairs, reps, percent), "prefix-candidates")
    known = sets.of(pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct())
    edges = written(_verified(pairs, known, percent), "prefix-links")

    by_shingle = held.where(F.col("holders") > hot).join(members, "grp").select("k", "fp")
    by_group = members.join(sizes.where(F.col("members") > hot), "grp").select(F.col("grp").alias("k"), "fp")
    both = near.where("many").select(F.xxhash64("g", "h").alias("k"), F.explode(F.array("g", "h")).alias("grp"))
    many = written(by_shingle.unionByName(by_group).unionByName(both.join(members, "grp").select("k", "fp")), "prefix-many")
    hubs = many.groupBy("k").agg(F.min("fp").alias("hub"))
    crowds = written(many.join(hubs, "k").select(F.col("hub").alias("k"), "fp").distinct(), "prefix-crowds")
    if crowds.isEmpty():
        return edges
    return edges.unionByName(similar_links(reps.select("fp", "n", "sketch"), crowds, sets, percent, hot, cell)).distinct()


def labelled(prints: DataFrame, reps: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """``key``, n and component_id of every row; a set with very many copies is spread over ``SALTS`` keys of the last join."""
    linked = components(edges).withColumnRenamed("node", "fp").join(reps.select("fp", "first"), "fp")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    label = linked.join(least, "root").select("fp", "component_id")
    names = reps.join(label, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    rows = prints.select(key, "fp", "n", F.pmod(F.xxhash64(key), F.lit(SALTS)).alias("salt"))
    spread = rows.groupBy("fp", "salt").agg(F.count(F.lit(1)).alias("rows")).select("fp", "salt").join(names, "fp")
    return rows.join(spread, ["fp", "salt"]).select(key, "n", "component_id")


def jaccard_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, percent: int = 85, hot: int = 8, cell: int = 2048
) -> DataFrame:
    """``key``, n (the size of its set) and component_id (the smallest key that links reach) of every row of ``docs``."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    levels = shingle_levels(docs, text, width, count_bits(docs.count()))
    prints = written(keyed_sets(docs, key, text, width, percent, levels), "prefix-sets")
    some = prints.where("n > 0")
    same = [F.first(x).alias(x) for x in ("n", "sketch", "grp")]
    reps = written(some.groupBy("fp").agg(F.min(key).alias("first"), *same), "prefix-reps")
    edges = set_links(some, reps, _Sets(docs, reps.select("fp", "first"), key, text, width), percent, hot, cell)
    alone = prints.where("n = 0").select(key, "n", F.col(key).alias("component_id"))
    return labelled(some, reps, edges, key).unionByName(alone)
