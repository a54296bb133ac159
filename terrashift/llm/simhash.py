"""SimHash near-duplicates: fingerprints, links within a Hamming radius, components; and exact links of similar texts.

Fingerprint. Words are maximal runs of anything but ASCII white space, after
A-Z are lower-cased; a shingle is ``width`` words joined by one space (fewer
words: the whole sequence; none: fingerprint zero). A bit of the fingerprint
is 1 if it is set in more than half of the shingles' XXH64 values (seed 42),
repeats included.

Links. The 64 bits are cut into ``radius + m`` blocks, so two fingerprints
that differ in at most ``radius`` bits agree on at least ``m`` whole blocks.
Each choice of ``m`` blocks is a key and close pairs meet on some key; a pair
counts only after its Hamming distance is verified. ``m`` follows from the
number of distinct fingerprints (2 below 2^24 of them, then 3, then 4), so a
key holds a few fingerprints on average at any size, and each ``m`` is exact.

Hot keys. Copies share a fingerprint and are one vertex. Keys that more than
``hot`` fingerprints share (a large family of near copies) are not joined pair
by pair: their members are dealt into cells of ``cell`` and every two cells
meet in a task of their own, which compares them by vectorised popcounts and
passes on only a spanning forest of the links it verified. No link between
components is lost and a family of B fingerprints yields about B * B / cell
rows, not B * B.

Similar documents. ``similar_documents`` compares sets of shingles. It cuts the range of the shingles' hashes into blocks, about two
shingles of a set to a block. Two sets with a Jaccard similarity of 0.8 differ
in so few shingles that they must share whole blocks, and one of those is
among the first few of each (``block_keys``). So every pair meets on a key at
any number of texts, and each candidate is decided by its exact similarity.
Blocks that a sample of the texts often has come last in the order: the sample
decides how many candidates there are, and never which links are found.

Both. With a ``radius``, ``similar_documents`` links by fingerprints first, as
``near_duplicates`` does, and adds the similar sets that they miss (texts that
share 0.8 of their shingles differ in about 10 of 64 bits); components are those
of all links together.

Components. Alternating large-star and small-star rounds over the forest,
each written to the shared folder, until nothing changes.

Defined results: null or blank text has fingerprint zero and is linked like
any other; repeated rows keep one row each; a null doc_id gets the component
of its fingerprint, whose id is the smallest doc_id that is not null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrashift.llm.storage import written

SEED = 42
BITS = 64
HOT_SHARE = 10_000


def text_fingerprint(text: str | None, width: int = 4) -> int:
    """The fingerprint of one text, unsigned."""
    hashes = shingle_hashes(text, width)
    return int(_majority(hashes)) if len(hashes) else 0


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """The XXH64 of each shingle, repeats included."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= width:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    joined = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps[: len(words) - width] + 1).tolist()]
    ends = [*gaps[width - 1 :].tolist(), len(joined)]
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(starts))


def _majority(hashes: np.ndarray) -> np.uint64:
    """The bits that more than half of the hashes have."""
    return np.packbits(_bit_counts(hashes) * 2 > len(hashes)).view(">u8")[0].astype(np.uint64)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the values have each bit set, the highest bit first."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for a very long text
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return counts


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """``key`` and fp (the fingerprint as a signed BIGINT) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((text_fingerprint(t, width) for t in _texts(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, fp bigint").select(F.col("key").alias(key), "fp")


def _texts(column: pa.Array) -> Iterator[str | None]:
    """The values one at a time, so that one batch is never held twice as Python strings."""
    return (x.as_py() for x in column)


def block_masks(radius: int, agree: int) -> list[int]:
    """For each choice of ``agree`` of ``radius + agree`` blocks, the mask of their bits."""
    blocks = radius + agree
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(masks, agree)]


def blocks_to_agree(n: int) -> int:
    """How many blocks a key takes for ``n`` distinct fingerprints."""
    return 2 if n < 1 << 24 else 3 if n < 1 << 30 else 4


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, radius: int = 4, hot: int = 64, cell: int = 2048, n: int | None = None) -> DataFrame:
    """a, b (a < b): verified links that connect what all links within ``radius`` connect.

    ``fps`` holds distinct fingerprints in column fp. Below ``hot`` members of
    a key all its links are returned, above it a spanning forest of them.
    """
    n = fps.count() if n is None else n
    masks = block_masks(radius, blocks_to_agree(n))
    keys = F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v")) for k, m in enumerate(masks)))
    keyed = fps.select("fp", F.explode(keys).alias("key")).select("fp", "key.k", "key.v")
    sizes = keyed.groupBy("k", "v").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sized = keyed.join(sizes, ["k", "v"])

    cold = sized.where(F.col("size") <= hot)
    other = cold.select("k", "v", F.col("fp").alias("other"))
    near = (
        cold.select("k", "v", "fp")
        .join(other, ["k", "v"])
        .where((F.col("fp") < F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius))
        .select(F.col("fp").alias("a"), F.col("other").alias("b"))
    )

    spread = _in_cells(sized.where(F.col("size") > hot), cell).select("k", "v", "fp", "mine", "lo", "hi")

    def forest(group: pa.Table) -> pa.Table:
        fp, side = group.column("fp").to_numpy().view(np.uint64), group.column("mine").to_numpy()
        lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        a, b = spanning_links(np.sort(fp[side == lo]), np.sort(fp[side == hi]) if hi != lo else None, radius)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    dense = spread.groupBy("k", "v", "lo", "hi").applyInArrow(forest, "a bigint, b bigint")
    dense = dense.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return near.unionByName(dense).distinct()


def _in_cells(sized: DataFrame, cell: int) -> DataFrame:
    """Members of hot keys, dealt into cells and repeated for every cell that theirs has to meet."""
    cells = F.ceil(F.col("size") / cell).cast("int")
    dealt = sized.withColumns({"cells": cells, "mine": F.pmod(F.xxhash64("fp"), cells).cast("int")})
    met = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    return met.withColumns({"lo": F.least("mine", "with"), "hi": F.greatest("mine", "with")})


def spanning_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within ``left``, or between ``left`` and ``right``, as pairs of fingerprints."""
    a, b = spanning_places(left[:, None], None if right is None else right[:, None], radius)
    nodes = left if right is None else np.concatenate([left, right])
    return nodes[a], nodes[b]


def spanning_places(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for fingerprints of several words, (rows, words); the places count through left, then right.

    Rows of the comparison are taken in slabs of bounded size; of each slab's
    links only those that join two trees are kept.
    """
    others = left if right is None else right
    slab = max(1, (1 << 20) // max(1, len(others)))

    def near() -> Iterator[np.ndarray]:
        for at in range(0, len(left), slab):
            apart = np.zeros((len(left[at : at + slab]), len(others)), np.uint16)
            for j in range(left.shape[1]):
                apart += np.bitwise_count(left[at : at + slab, None, j] ^ others[None, :, j])
            yield apart <= radius

    return _spanning(near(), len(left), None if right is None else len(right))


def _spanning(near: Iterator[np.ndarray], n: int, m: int | None, joined: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links in slabs of a matrix: ``n`` rows by themselves, or by ``m`` others.

    ``joined`` names the components that hold already; links inside one are not repeated.
    """
    parent = list(range(n + (m or 0)))
    if joined is not None and parent:
        _, place, where = np.unique(joined, return_index=True, return_inverse=True)
        parent = place[where].tolist()

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept_a, kept_b = [], []
    at = 0
    for slab in near:
        rows, cols = np.nonzero(slab)
        rows, cols = rows + at, cols + (0 if m is None else n)
        at += len(slab)
        if m is None:
            rows, cols = rows[rows < cols], cols[rows < cols]
        for a, b in _first_links(rows, cols, parent):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                kept_a.append(a)
                kept_b.append(b)
    return np.array(kept_a, np.int64), np.array(kept_b, np.int64)


def _first_links(rows: np.ndarray, cols: np.ndarray, parent: list[int]) -> Iterator[tuple[int, int]]:
    """The links without those whose ends are in one tree already when the slab begins."""
    if not len(rows):
        return iter(())
    roots = np.array(parent)
    while not np.array_equal(up := roots[roots], roots):
        roots = up
    new = roots[rows] != roots[cols]
    pairs = np.unique(roots[rows[new]] * len(roots) + roots[cols[new]], return_index=True)[1]
    return zip(rows[new][pairs].tolist(), cols[new][pairs].tolist())


def components(edges: DataFrame) -> DataFrame:
    """node, root: for every node of an edge the smallest node that it reaches.

    Large-star and small-star rounds: each node hands its larger neighbours,
    then its smaller ones, to its smallest neighbour. A round is two grouped
    minima and two joins on the node, no group is gathered, and the number of
    rounds grows with the logarithm of the longest chain.
    """
    held = written(edges.select("a", "b").where("a <> b"), "edges")
    mark = _mark(held)
    while mark[0]:
        both = held.unionByName(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(smallest.select("a", F.col("m").alias("b"))).distinct()
        held = written(small, "star")
        was, mark = mark, _mark(held)
        if was == mark:
            break
    nodes = held.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())


def _mark(edges: DataFrame) -> tuple:
    """Rows and an order-free digest of them: equal marks mean that a round changed nothing."""
    return tuple(
        edges.agg(
            F.count(F.lit(1)),
            F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).cast("string"),
        ).first()
    )


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct XXH64 values of a text's shingles, sorted."""
    return np.unique(shingle_hashes(text, width))


def _set_name(hashes: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(hashes.tobytes(), SEED)).astype(np.int64))


MIXER = np.uint64(0x9E3779B97F4A7C15)
SMALL = 4  # sets of fewer than 2^SMALL shingles have blocks of one shingle


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIXER
    return x ^ (x >> np.uint64(29))


def _may_differ(n: int, percent: int) -> int:
    """At most so many shingles are in one only of a set of ``n`` and any other that is similar enough."""
    return n * (100 - percent) // percent


def block_contents(hashes: np.ndarray, level: int) -> np.ndarray:
    """A hash of each block that isn't empty: the range of shingles is cut into 2^(level + 1) / 3 equal blocks."""
    blocks = (2 << level) // 3
    at = ((hashes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    start = np.flatnonzero(np.diff(at, prepend=at[0] + np.uint64(1)) != 0)
    return _mixed(np.add.reduceat(_mixed(hashes), start) ^ (at[start] << np.uint64(6)) ^ np.uint64(level))


def all_blocks(hashes: np.ndarray, percent: int) -> list[np.ndarray]:
    """The block contents of a set (sorted, not empty), for each size of blocks by which it may meet a similar one.

    Two sets meet by the size of the larger, so a set takes part by its own
    size and by that of the largest set that is similar to it.
    """
    n = len(hashes)
    levels = {n.bit_length() - 1, (n * 100 // percent).bit_length() - 1}
    out = [block_contents(hashes, level) for level in sorted(levels) if level >= SMALL]
    if min(levels) < SMALL or any(len(x) <= _may_differ(n, percent) for x in out):
        out.append(_mixed(hashes))  # too few blocks for the pigeonhole: each shingle is a block
    return out


def block_keys(hashes: np.ndarray, percent: int, known: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Keys of which two sets with a similarity of ``percent`` hundredths and more have one in common.

    If d shingles are in one of two sets only, at most d blocks of each aren't
    blocks of the other. So in any order of blocks that holds for all sets,
    the first that they share is among the first d + 1 of each. The order is
    by hash, frequent blocks (``known``, sorted) last by their ``ranks``.
    """
    if not len(hashes):
        return hashes
    need = _may_differ(len(hashes), percent) + 1
    out = []
    for blocks in all_blocks(hashes, percent):
        if len(known):
            at = np.minimum(np.searchsorted(known, blocks), len(known) - 1)
            blocks = blocks[np.lexsort((blocks, np.where(known[at] == blocks, ranks[at], 0)))]
        elif len(blocks) > need:
            blocks = np.partition(blocks, need - 1)
        out.append(blocks[:need])
    return np.concatenate(out)


BUCKETS = 128  # of a sketch, or as many as bring 8 to 16 shingles to each


def sketch(hashes: np.ndarray) -> bytes:
    """How many of a set's hashes each bucket has, up to 255: two sketches differ by no more than their sets do."""
    bits = max(BUCKETS.bit_length() - 1, len(hashes).bit_length() - 4)
    return np.minimum(np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def _folded(sketches: list[bytes], buckets: int) -> np.ndarray:
    """Sketches with neighbouring buckets added up, so that each has ``buckets``."""
    return np.array([np.frombuffer(x, np.uint8).reshape(buckets, -1).sum(axis=1, dtype=np.int32) for x in sketches], np.int32)


def _may_be_near(apart: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of ``n`` and ``m`` shingles can be that similar if at least ``apart`` are in one of them only."""
    return apart * (100 + percent) <= (n.astype(np.int64) + m) * (100 - percent)


def _pairs_near(x: list[bytes], y: list[bytes], n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The same for pairs of sketches, each by the coarser of its two."""
    buckets = np.array([min(len(a), len(b)) for a, b in zip(x, y)], np.int64)
    near = np.zeros(len(x), bool)
    for size in np.unique(buckets):
        at = np.flatnonzero(buckets == size)
        for part in np.array_split(at, -(-len(at) * size // (1 << 22))):
            apart = np.abs(_folded([x[k] for k in part], size) - _folded([y[k] for k in part], size)).sum(axis=1, dtype=np.int64)
            near[part] = _may_be_near(apart, n[part], m[part], percent)
    return near


class _Marks:
    """The sketches of a group, for one against many."""

    def __init__(self, sketches: list[bytes], n: np.ndarray, percent: int):
        self.n, self.percent = n, percent
        self.length = np.array([len(x) for x in sketches], np.int64)
        self.folded = {size: _folded([x if len(x) >= size else bytes(size) for x in sketches], size) for size in np.unique(self.length).tolist()}

    def near(self, x: int, y: np.ndarray) -> np.ndarray:
        """Those of ``y`` that may be near ``x``."""
        n = self.n
        y = y[np.minimum(n[y], n[x]) * 100 >= np.maximum(n[y], n[x]) * self.percent]
        size = np.minimum(self.length[y], self.length[x])
        out = []
        for t in np.unique(size).tolist():
            at, marks = y[size == t], self.folded[t]
            apart = np.abs(marks[at] - marks[x]).sum(axis=1, dtype=np.int64)
            out.append(at[_may_be_near(apart, n[at], n[x], self.percent)])
        return np.concatenate(out) if out else y


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
    flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def frequent_blocks(docs: DataFrame, text: str, width: int, percent: int, texts: int = 5_000, most: int = 50_000) -> np.ndarray:
    """Blocks that 4 and more of about ``texts`` sampled texts hold, the rarest first; at most ``most``."""
    every = max(1, docs.count() // texts)
    rows = docs.select(F.col(text).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                sets = (shingle_set(t, width) for t in _texts(batch.column(0).slice(at, 500)))
                found = [x for hashes in sets if len(hashes) for x in all_blocks(hashes, percent)]
                yield pa.RecordBatch.from_arrays([_lists(found).flatten()], names=["k"])

    counted = rows.mapInArrow(run, "k bigint").groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n >= 4")
    top = counted.orderBy(F.desc("n"), "k").limit(most).collect()
    return np.array([r.k for r in reversed(top)], np.int64).view(np.uint64)


def keyed_sets(docs: DataFrame, key: str, text: str, width: int, percent: int, last: np.ndarray) -> DataFrame:
    """``key``, fp (a hash of the text's set of shingles, its name in links and components), bits (its fingerprint), n (their number), sketch and keys.

    A set that a task has met before in its rows gets no keys again, so copies
    yield a row for each task and not for each copy.
    """
    order = np.argsort(last)
    known, ranks = last[order], order + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        none = np.zeros(0, np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                names, bits, sizes, sketches, found = [], [], [], [], []
                for t in _texts(part.column(1)):
                    every = shingle_hashes(t, width)
                    hashes = np.unique(every)
                    name = _set_name(hashes)
                    names.append(name)
                    bits.append(_majority(every) if len(every) else np.uint64(0))
                    sizes.append(len(hashes))
                    sketches.append(sketch(hashes))
                    found.append(none if name in met else block_keys(hashes, percent, known, ranks))
                    met.add(name)
                prints = pa.array(np.array(bits, np.uint64).view(np.int64))
                cols = [part.column(0), pa.array(names, pa.int64()), prints, pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), _lists(found)]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "fp", "bits", "n", "sketch", "keys"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, fp bigint, bits bigint, n int, sketch binary, keys array<bigint>").withColumnRenamed("key", key)


class _Sets:
    """The sets of shingles of some names, made again from the texts: only candidates' are ever written."""

    def __init__(self, docs: DataFrame, reps: DataFrame, key: str, text: str, width: int):
        self.docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
        self.reps, self.width = reps, width

    def of(self, names: DataFrame) -> DataFrame:
        """fp and shingles (sorted) for each fp of ``names``, which are distinct."""
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    found = [shingle_set(t, width) for t in _texts(batch.column(0).slice(at, 500))]
                    cols = [pa.array([_set_name(x) for x in found], pa.int64()), _lists(found)]
                    yield pa.RecordBatch.from_arrays(cols, names=["fp", "shingles"])

        wanted = self.reps.join(names, "fp").select(F.col("first").alias("wanted")).distinct()
        texts = self.docs.join(wanted, F.col("key").eqNullSafe(F.col("wanted")), "left_semi").select("text")
        made = texts.mapInArrow(run, "fp bigint, shingles array<bigint>").join(names, "fp", "left_semi")
        return written(made.dropDuplicates(["fp"]), "simhash-sets")


def _possible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b without those whose sizes or sketches rule that similarity out."""
    one = reps.select(F.col("fp").alias("a"), F.col("sketch").alias("x"), "n")
    two = reps.select(F.col("fp").alias("b"), F.col("sketch").alias("y"), F.col("n").alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, n, m = (batch.column(k) for k in range(2, 6))
            near = _pairs_near(x.to_pylist(), y.to_pylist(), n.to_numpy(), m.to_numpy(), percent)
            yield batch.select(["a", "b"]).filter(pa.array(near))

    sized = pairs.join(one, "a").join(two, "b").where(F.least("n", "m") * 100 >= F.greatest("n", "m") * percent)
    return sized.select("a", "b", "x", "y", "n", "m").mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose sets of shingles are similar by ``percent`` hundredths and more."""
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("fp").alias("b"), F.col("shingles").alias("y")), "b"
    )
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common * (100 + percent) >= (F.size("x") + F.size("y")) * percent).select("a", "b")


def _near_sets(sets: list[np.ndarray], n: int, percent: int) -> Iterator[np.ndarray]:
    """Slabs of the matrix that says which of the first ``n`` sets are near which others (or each other, if there are none)."""
    size = np.array([len(x) for x in sets])
    others = np.arange(n, len(sets)) if n < len(sets) else np.arange(n)
    _, where, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1  # a shingle of one set only is in no intersection
    row = np.repeat(np.arange(len(sets)), size)
    keep = count[where] > 1
    row, col = row[keep], shared[where[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    step = 2048
    for at in range(0, n, 512):
        mine = np.arange(at, min(n, at + 512))
        common = np.zeros((len(mine), len(others)), np.float32)
        for first in range(0, int(col[-1]) + 1 if len(col) else 0, step):
            a, b = np.searchsorted(col, [first, first + step])
            part = np.zeros((len(sets), step), np.float32)
            part[row[a:b], col[a:b] - first] = 1
            common += part[mine] @ part[others].T
        yield common * (100 + percent) >= (size[mine, None] + size[None, others]) * percent


def similar_links(reps: DataFrame, entries: DataFrame, sets: _Sets, percent: int, hot: int, cell: int) -> DataFrame:
    """a, b (a < b): links that connect what all pairs of that similarity connect.

    ``reps`` has fp, n and sketch of each set, ``entries`` its keys (k, fp).
    Holders of a key meet in pairs where they are at most ``hot``, so the rows
    of that join are in proportion to the entries. The holders of a hot key are
    held against two of them first, which joins a tight family by few rows;
    those that aren't in one component by then go by cells, twice: by sketches,
    which leaves the holders that may have a link, and by their sets.
    """
    shared = entries.groupBy("k").agg(F.min("fp").alias("hub"), F.max("fp").alias("high")).where("hub <> high")
    held = written(entries.join(shared, "k").distinct(), "simhash-shared")
    sizes = held.groupBy("k").agg(F.count(F.lit(1)).alias("size"))
    held = written(held.join(sizes, "k"), "simhash-sized")

    hot = max(hot, 2)  # two holders are one pair
    cold = held.where(F.col("size") <= hot).select("k", F.col("fp").alias("a"))
    near = cold.join(cold.select("k", F.col("a").alias("b")), "k").where("a < b").select("a", "b")
    many = held.where(F.col("size") > hot)
    star = many.select(F.explode(F.array("hub", "high")).alias("h"), "fp").where("h <> fp").select(F.least("h", "fp").alias("a"), F.greatest("h", "fp").alias("b"))
    pairs = written(_possible(near.unionByName(star).distinct(), reps, percent), "simhash-pairs")
    found = sets.of(pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct())
    edges = written(_verified(pairs, found, percent), "simhash-links")
    if many.isEmpty():
        return edges.distinct()

    joined = components(edges).select(F.col("node").alias("fp"), F.col("root").alias("c"))
    named = many.select("k", "fp", "size").join(joined, "fp", "left").withColumn("c", F.coalesce("c", "fp"))
    apart = named.groupBy("k").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("k")
    spread = _in_cells(named.join(apart, "k"), cell).join(reps.select("fp", "n", "sketch"), "fp")

    def possible(group: pa.Table) -> pa.Table:
        n, side, c = (group.column(x).to_numpy() for x in ("n", "mine", "c"))
        marks = _Marks(group.column("sketch").to_pylist(), n, percent)
        lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        left, right = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
        kept = np.zeros(len(n), bool)
        for x in left:
            y = marks.near(x, right[c[right] != c[x]])
            kept[y] = True
            kept[x] |= len(y) > 0
        return group.select(["k", "fp", "c", "mine", "lo", "hi"]).filter(pa.array(kept))

    kind = "k bigint, fp bigint, c bigint, mine int, lo int, hi int"
    spread = spread.select("k", "fp", "n", "c", "mine", "lo", "hi", "sketch")
    spread = written(spread.groupBy("k", "lo", "hi").applyInArrow(possible, kind), "simhash-holders")
    spread = spread.join(sets.of(spread.select("fp").distinct()), "fp")

    def forest(group: pa.Table) -> pa.Table:
        fp, side, c = (group.column(x).to_numpy() for x in ("fp", "mine", "c"))
        lists = group.column("shingles").combine_chunks()
        shingles, ends = lists.flatten().to_numpy(), np.cumsum([0, *lists.value_lengths().to_pylist()])
        lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        left, right = np.flatnonzero(side == lo), np.flatnonzero(side == hi) if hi != lo else np.zeros(0, np.int64)
        at = np.concatenate([left, right])
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(left) and (hi == lo or len(right)):
            near = _near_sets([shingles[ends[i] : ends[i + 1]] for i in at], len(left), percent)
            a, b = _spanning(near, len(left), len(right) if hi != lo else None, c[at])
        return pa.table({"a": pa.array(fp[at][a], pa.int64()), "b": pa.array(fp[at][b], pa.int64())})

    spread = spread.select("k", "fp", "shingles", "c", "mine", "lo", "hi")
    dense = spread.groupBy("k", "lo", "hi").applyInArrow(forest, "a bigint, b bigint")
    return edges.unionByName(dense).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _grouped(prints: DataFrame, reps: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """``prints`` with component_id: the smallest key among all rows of a component; ``reps`` has fp, first and copies.

    A text with more than a ``HOT_SHARE``th of all rows is no key of the
    shuffle: there are fewer than ``HOT_SHARE`` of those, so they are broadcast.
    """
    linked = components(edges)
    labelled = linked.join(reps.select(F.col("fp").alias("node"), "first"), "node")
    least = labelled.groupBy("root").agg(F.min("first").alias("least"))
    label = labelled.join(least, "root").select(F.col("node").alias("fp"), "least")
    names = reps.join(label, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"), "copies")
    names = written(names, "simhash-names")
    most = prints.count() / HOT_SHARE
    hot = names.where(F.col("copies") > max(1, most)).select("fp", F.col("component_id").alias("hot_id"), F.lit(True).alias("is_hot"))
    marked = prints.join(F.broadcast(hot), "fp", "left")
    rest = marked.where("is_hot is null").drop("hot_id", "is_hot").join(names.select("fp", "component_id"), "fp", "left")
    return marked.where("is_hot").select(key, "fp", F.col("hot_id").alias("component_id")).unionByName(rest.select(key, "fp", "component_id"))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4, hot: int = 64, cell: int = 2048
) -> DataFrame:
    """``key``, fp and component_id of every row of ``docs``: links within ``radius`` of 64 bits, none missed."""
    prints = written(fingerprints(docs, key, text, width), "simhash")
    reps = written(prints.groupBy("fp").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("copies")), "simhash-reps")
    edges = links(reps.select("fp"), radius, hot, cell, n=reps.count())
    return _grouped(prints, reps, edges, key).select(key, "fp", "component_id")


def fingerprint_links(prints: DataFrame, radius: int) -> DataFrame:
    """a, b (a < b): sets whose fingerprints link within ``radius`` bits; ``prints`` has fp (a set's name) and bits (a fingerprint of it).

    Sets with one fingerprint are linked with the smallest of them, and those
    with each other as ``links`` finds them.
    """
    held = written(prints.select("fp", "bits").distinct(), "simhash-bits")
    hubs = written(held.groupBy("bits").agg(F.min("fp").alias("hub")), "simhash-hubs")
    near = links(hubs.select(F.col("bits").alias("fp")), radius)
    one, two = (hubs.select(F.col("bits").alias(side), F.col("hub").alias(name)) for side, name in (("a", "x"), ("b", "y")))
    across = near.join(one, "a").join(two, "b").select("x", "y")
    star = held.join(hubs, "bits").select(F.col("hub").alias("x"), F.col("fp").alias("y"))
    return across.unionByName(star).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def similar_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, hot: int = 8, cell: int = 2048, radius: int | None = None
) -> DataFrame:
    """``key``, fp and component_id: links where the sets of shingles have a Jaccard similarity of ``percent`` hundredths and more.

    fp names the set of shingles; no such link is missed and no other is made,
    but with a ``radius`` the links of ``near_duplicates``: fingerprints that
    differ in at most so many of 64 bits, none missed either.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    prints = written(keyed_sets(docs, key, text, width, percent, frequent_blocks(docs, text, width, percent)), "simhash-keys")
    same = [F.first(x).alias(x) for x in ("n", "sketch")]
    reps = written(prints.groupBy("fp").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("copies"), *same), "simhash-reps")
    entries = prints.select(F.explode("keys").alias("k"), "fp")
    edges = similar_links(reps.select("fp", "n", "sketch"), entries, _Sets(docs, reps.select("fp", "first"), key, text, width), percent, hot, cell)
    if radius is not None:
        edges = fingerprint_links(prints, radius).unionByName(edges)
    return _grouped(prints.select(key, "fp"), reps, edges, key).select(key, "fp", "component_id")


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
