"""Benchmark decontamination by pigeonhole edit matching.

A test item of L normalised characters is looked for with up to
``floor(rate * L)`` edits. It is cut into one piece more than that, so any
occurrence leaves at least one piece intact. An Aho-Corasick automaton finds
the exact piece hits of all items in one pass over a text. A hit is verified
upwards in a binary tree over the pieces: a node of m pieces may have m - 1
edits, and by the same pigeonhole some intact piece has only such nodes above
it, so a chance hit is rejected after a comparison of two pieces and nothing
is missed. The least of an item's root distances is the result. Distances are Myers' bit-parallel
ones, for a pattern anywhere in the window.

Both sides are lower-cased and every run of characters that are not letters or
digits becomes one space. The items are a stated query set, held against all
texts in blocks of ``block_chars`` characters, which bounds what travels to
the executors; each text stays in its task and nothing is shuffled.

Defined results: a null or empty text matches nothing; an item whose
normalised text is empty can't be found and is ignored; repeated items count
once for each id; repeated document rows each have their matches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OTHER = re.compile(r"[\W_]+")


def normalised(text: str | None) -> str:
    return OTHER.sub(" ", (text or "").lower()).strip()


def char_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for k, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << k
    return masks


def best_distance(masks: dict[str, int], size: int, text: str) -> int:
    """The least edit distance between the pattern and any substring of ``text`` (Myers 1999)."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    pv, mv, score, best = full, 0, size, size
    get = masks.get
    for c in text:
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph = ph << 1  # an occurrence may begin anywhere: no 1 is shifted in
        pv = ((mh << 1) | ~(xv | ph)) & full
        mv = ph & xv & full
    return best


class Matcher:
    """The pieces of a block of items, and the check of their hits."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        import ahocorasick

        self.items = items
        self.rate = rate
        self.cuts: list[list[int]] = []
        self.masks: dict[tuple[int, int, int], dict[str, int]] = {}
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text) in enumerate(items):
            n = int(rate * len(text)) + 1
            cuts = [len(text) * j // n for j in range(n + 1)]
            self.cuts.append(cuts)
            for j in range(n):
                pieces.setdefault(text[cuts[j] : cuts[j + 1]], []).append((k, j))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if pieces:
            self.automaton.make_automaton()

    def _distance(self, text: str, item: int, lo: int, hi: int, start: int) -> int:
        """Distance of the pieces lo..hi of the item near the place where the item would begin at ``start``."""
        cuts, whole = self.cuts[item], self.items[item][1]
        a, b, slack = cuts[lo], cuts[hi], hi - lo - 1
        if (item, lo, hi) not in self.masks:
            self.masks[item, lo, hi] = char_masks(whole[a:b])
        return best_distance(self.masks[item, lo, hi], b - a, text[max(0, start + a - slack) : start + b + slack])

    def matches(self, text: str, first: bool = False) -> dict[int, tuple[int, int]]:
        """item -> (least distance, where about it begins); with ``first`` only until something is found.

        Hits that put the item at one place have one window, which is verified once.
        """
        found: dict[int, tuple[int, int]] = {}
        seen: set[tuple[int, int]] = set()
        if not self.cuts:
            return found
        for end, (size, owners) in self.automaton.iter(text):
            for item, piece in owners:
                cuts = self.cuts[item]
                start = end + 1 - size - cuts[piece]
                if (item, start) in seen or item in found and found[item][0] == 0:
                    continue
                path = self._path(len(cuts) - 1, piece)
                for lo, hi in path[1:]:
                    distance = self._distance(text, item, lo, hi, start)
                    if distance > hi - lo - 1:
                        break
                else:
                    distance = distance if len(path) > 1 else 0
                    seen.add((item, start))
                    if item not in found or distance < found[item][0]:
                        found[item] = (distance, max(0, start))
                    if first:
                        return found
        return found

    def _path(self, n: int, piece: int) -> list[tuple[int, int]]:
        """The nodes above a piece, from its leaf to the root."""
        lo, hi, path = 0, n, [(0, n)]
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if piece < mid else (mid, hi)
            path.append((lo, hi))
        return path[::-1]


def item_blocks(
    benchmark: DataFrame, key: str = "item_id", text: str = "text", block_chars: int = 1 << 20
) -> Iterator[list[tuple[object, str]]]:
    """The normalised items in blocks of bounded size; only one block is on the driver at a time."""
    block, size = [], 0
    rows = benchmark.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null").distinct().orderBy("k", "t")
    for row in rows.toLocalIterator():
        item = normalised(row.t)
        if not item:
            continue
        if block and size + len(item) > block_chars:
            yield block
            block, size = [], 0
        block.append((row.k, item))
        size += len(item)
    if block:
        yield block


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    rate: float = 0.1,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    block_chars: int = 1 << 20,
) -> DataFrame:
    """``key``, ``item_key``, distance, budget and place (in the normalised text) of each pair that matches."""
    kind = docs.schema[key].dataType.simpleString()
    item_kind = benchmark.schema[item_key].dataType.simpleString()
    schema = f"k {kind}, item {item_kind}, distance int, budget int, place int"
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def search(items: list[tuple[object, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, rate)
            for batch in batches:
                at, out = [], []
                for k, value in enumerate(batch.column(1)):
                    for item, (distance, place) in sorted(matcher.matches(normalised(value.as_py())).items()):
                        at.append(k)
                        out.append((items[item][0], distance, len(matcher.cuts[item]) - 2, place))
                cols = list(zip(*out)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at, pa.int64())),
                        pa.array(cols[0], item_type),
                        *(pa.array(c, pa.int32()) for c in cols[1:]),
                    ],
                    names=["k", "item", "distance", "budget", "place"],
                )

        return run

    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(benchmark.schema[item_key].dataType)
    found = None
    for items in item_blocks(benchmark, item_key, item_text, block_chars):
        part = rows.mapInArrow(search(items), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    best = found.select(F.col("k").alias(key), F.col("item").alias(item_key), "distance", "budget", "place")
    return best


def without_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    rate: float = 0.1,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    block_chars: int = 1 << 20,
) -> DataFrame:
    """The rows of ``docs``, all columns, that no item matches; no shuffle."""
    at = docs.columns.index(text)

    def drop(items: list[tuple[object, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, rate)
            for batch in batches:
                clean = [not matcher.matches(normalised(x.as_py()), first=True) for x in batch.column(at)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    for items in item_blocks(benchmark, item_key, item_text, block_chars):
        docs = docs.mapInArrow(drop(items), docs.schema)
    return docs
