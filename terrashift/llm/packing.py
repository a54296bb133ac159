"""Best-fit packing of documents into bins, with conflicts.

A document of n words takes ceil(n / capacity) pieces: all but the last fill a
bin of their own, the last is packed. Pieces are taken longest first and each
goes to the open bin with the least room that is enough and that holds neither
its source nor its duplicate cluster; if there is none, a bin is opened.

Bins are ordered by residual. Every bin carries a bitmap of its sources and
one of its duplicate clusters. The successor search walks the residuals from
the piece's length upwards along a bitmap of the residuals that occur. Bins of
one residual are grouped by their source bitmap, so a residual whose bins all
hold the piece's source is passed over at once and a common source costs at
most ``capacity`` steps, not one for each bin; within a group the clusters'
bitmaps are tested. The search goes on until the tightest compatible bin is
found or the residuals end.

Documents are dealt into packs of about ``pack_rows`` by a hash of id and
text, which spreads a source or a family of copies evenly, and every pack is
one task's group: only id, length, source and cluster move, and what a task
holds is bounded at any size of the table. The loss against one global packing
is below a bin for each pack.

Defined results: a null or blank text has length 0, takes one piece and rides
in a bin without using room; a null source is no source and never conflicts;
copies (same words after A-Z lower-casing) are one cluster, the texts without
words are no cluster. Repeated rows are packed as rows of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrashift.llm.url_filter import ascii_lower

PIECES = "key bigint, piece int, n_pieces int, pack int, bin int, position int, offset int, length int, room int"


class Bins:
    """Open bins of one capacity."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.levels = 0  # bit r: some bin has residual r
        self.by_residual: dict[int, dict[int, list[int]]] = {}  # residual -> source bitmap -> bins
        self.residual: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.pieces: list[int] = []

    def place(self, length: int, source: int, cluster: int) -> int:
        """The bin for a piece; ``source`` and ``cluster`` are bits, 0 for none."""
        found = self._successor(length, source, cluster)
        if found is None:
            found = len(self.residual)
            self.residual.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
            self.pieces.append(0)
        else:
            self._take_out(found)
        self.residual[found] -= length
        self.sources[found] |= source
        self.clusters[found] |= cluster
        self.pieces[found] += 1
        self._put_in(found)
        return found

    def _successor(self, length: int, source: int, cluster: int) -> int | None:
        left = self.levels >> length << length
        while left:
            r = (left & -left).bit_length() - 1
            for held, bins in self.by_residual[r].items():
                if held & source:
                    continue
                for b in reversed(bins):
                    if not self.clusters[b] & cluster:
                        return b
            left &= left - 1
        return None

    def _take_out(self, b: int) -> None:
        r, held = self.residual[b], self.sources[b]
        groups = self.by_residual[r]
        groups[held].remove(b)
        if not groups[held]:
            del groups[held]
            if not groups:
                del self.by_residual[r]
                self.levels &= ~(1 << r)

    def _put_in(self, b: int) -> None:
        r = self.residual[b]
        self.by_residual.setdefault(r, {}).setdefault(self.sources[b], []).append(b)
        self.levels |= 1 << r


def _bits(values: list) -> list[int]:
    """Each value's bit in a bitmap; 0 for null. Values that occur once can't conflict and need none."""
    seen: dict = {}
    for v in values:
        seen[v] = seen.get(v, 0) + 1
    place = {v: k for k, v in enumerate(v for v, n in seen.items() if v is not None and n > 1)}
    return [1 << place[v] if v in place else 0 for v in values]


def pack(lengths: list[int], sources: list, clusters: list, capacity: int) -> list[list[tuple[int, int]]]:
    """For each document its pieces' (bin, length), in text order."""
    bins = Bins(capacity)
    source, cluster = _bits(sources), _bits(clusters)
    out: list[list[tuple[int, int]]] = [[] for _ in lengths]
    rest = []
    for k, n in enumerate(lengths):
        for _ in range((n - 1) // capacity if n else 0):
            out[k].append((bins.place(capacity, source[k], cluster[k]), capacity))
        rest.append(n - len(out[k]) * capacity)
    for k in sorted(range(len(lengths)), key=lambda k: (-rest[k], k)):
        out[k].append((bins.place(rest[k], source[k], cluster[k]), rest[k]))
    return out


def best_fit(
    docs: DataFrame,
    capacity: int = 2048,
    pack_rows: int = 2048,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    rows: int | None = None,
) -> DataFrame:
    """One row for each piece: ``key``, piece, n_pieces, bin_id, position, offset, length, room (left in the bin).

    ``offset`` is the first word of the piece in its document, ``position``
    its place in the bin.
    """
    words = F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"))
    plain = F.regexp_replace(ascii_lower(F.col(text)), r"[\x20\x09-\x0D]+", " ")
    n = docs.count() if rows is None else rows
    packs = max(1, -(-n // pack_rows))
    length = F.coalesce(words, F.lit(0)).cast("int")
    thin = docs.select(
        F.col(key).cast("bigint").alias("key"),
        length.alias("length"),
        F.col(source).cast("string").alias("source"),
        F.when(length > 0, F.xxhash64(plain)).alias("cluster"),
        F.pmod(F.xxhash64(F.col(key), F.col(text), F.lit(7)), F.lit(packs)).cast("int").alias("pack"),
    )

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("key", "ascending"), ("cluster", "ascending")])
        keys = group.column("key").to_pylist()
        placed = pack(group.column("length").to_pylist(), group.column("source").to_pylist(), group.column("cluster").to_pylist(), capacity)
        number = group.column("pack")[0].as_py()
        cols: list[list] = [[] for _ in range(9)]
        filled: dict[int, int] = {}
        count: dict[int, int] = {}
        for k, pieces in zip(keys, placed):
            at = 0
            for piece, (b, size) in enumerate(pieces):
                filled[b] = filled.get(b, 0) + size
                count[b] = count.get(b, 0) + 1
                for col, v in zip(cols, (k, piece, len(pieces), number, b, count[b] - 1, at, size)):
                    col.append(v)
                at += size
        cols[8] = (capacity - np.array([filled[b] for b in cols[4]], np.int64)).tolist() if cols[4] else []
        kinds = [pa.int64()] + [pa.int32()] * 8
        names = [x.split()[0] for x in PIECES.split(", ")]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    placed = thin.groupBy("pack").applyInArrow(run, PIECES)
    bin_id = F.shiftleft(F.col("pack").cast("bigint"), 32) + F.col("bin")
    return placed.select(F.col("key").alias(key), "piece", "n_pieces", bin_id.alias("bin_id"), "position", "offset", "length", "room")
