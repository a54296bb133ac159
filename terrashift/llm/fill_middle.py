"""Fill-in-the-middle: each text is cut at two of its units and written with its middle last.

Units are runs of ASCII letters and single other code points. Where the n-th
unit ends is found from events only: one Aho-Corasick automaton reports the
ASCII characters that end or follow a run of letters, and the sentinels. Every
event is one unit and a gap between two events is one more, so a cumulative sum
over the events ranks all units and a binary search finds any of them; letters
are never looked at. Code points beyond ASCII are one event each: the scan runs
over an image of the text in which each of them is one ``?``.

The two cuts, the form and the order of its parts follow from SHA-256 of
``seed:id`` and from nothing else, so a lost task gives the same rows again.
Rows are changed in place, nothing is shuffled.

Defined results: a null text counts as empty; an empty text and a text that
holds a sentinel keep their form (``plain``), and so does the stated share of
all others. A null id is hashed as the empty string. Repeated rows have equal
results. Columns of the input that are named like a result are replaced.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTINELS = ("<P>", "<S>", "<M>")
RESULTS = {"n_units": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output": "string"}


def event_automaton(sentinels: tuple[str, str, str]):
    """One automaton for the characters that are units of their own (value 1) and for the sentinels (value 0)."""
    import ahocorasick

    if any(len(s) < 2 or not s.isascii() for s in sentinels):
        raise ValueError("a sentinel has at least two characters, all of them ASCII")
    found = ahocorasick.Automaton()
    for c in map(chr, range(128)):
        if c not in string.ascii_letters:
            found.add_word(c, 1)
    for s in sentinels:
        found.add_word(s, 0)
    found.make_automaton()
    return found


class Units:
    """The units of one text, known by their events."""

    def __init__(self, text: str, automaton):
        self.size = len(text)
        image = text if text.isascii() else text.encode("ascii", "replace").decode("ascii")
        events = np.fromiter((end << 1 | kind for end, kind in automaton.iter(image)), np.int64)
        single = (events & 1).astype(bool)
        self.holds_sentinel = not single.all()
        self.at = events[single] >> 1
        after_letters = np.diff(self.at, prepend=-1) > 1
        self.through = np.cumsum(after_letters) + np.arange(1, len(self.at) + 1)
        last = int(self.at[-1]) if len(self.at) else -1
        self.n = (int(self.through[-1]) if len(self.at) else 0) + (last < self.size - 1)

    def end_of(self, rank: int) -> int:
        """How many code points the first ``rank`` units have."""
        if rank == 0:
            return 0
        k = int(np.searchsorted(self.through, rank))
        if k == len(self.at):
            return self.size
        return int(self.at[k]) + int(self.through[k] == rank)


def arranged(key: str, text: str, automaton, seed: int, sentinels, plain_from: int, spm_below: int) -> tuple:
    """n_units, form, prefix_chars, middle_chars and output of one text."""
    units = Units(text, automaton)
    digest = hashlib.sha256(f"{seed}:{key}".encode("utf-8", "surrogatepass")).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or units.holds_sentinel or h3 % 100 >= plain_from:
        return units.n, "plain", None, None, text
    low, high = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
    a, b = units.end_of(low), units.end_of(high)
    p, s, m = sentinels
    if h4 % 100 < spm_below:
        return units.n, "spm", a, b - a, "".join((s, text[b:], p, text[:a], m, text[a:b]))
    return units.n, "psm", a, b - a, "".join((p, text[:a], s, text[b:], m, text[a:b]))


def fill_middle(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    seed: int = 1,
    sentinels: tuple[str, str, str] = SENTINELS,
    rate: int = 90,
    spm_rate: int = 20,
    batch_chars: int = 1 << 24,
) -> DataFrame:
    """The rows of ``docs``, all columns, with n_units, form, prefix_chars, middle_chars and output.

    ``rate`` hundredths of the texts are rearranged, ``spm_rate`` hundredths of
    those with the suffix first. ``batch_chars`` bounds what a task holds
    besides its batch.
    """
    kept = [c for c in docs.columns if c not in RESULTS]
    if key not in kept or text not in kept:
        raise ValueError("the key and the text can't be named like a result")
    rows = docs.select(*kept, F.coalesce(F.col(key).cast("string"), F.lit("")).alias("output"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema), *(f"{c} {kind}" for c, kind in RESULTS.items())])
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = event_automaton(sentinels)

        def done(part: pa.RecordBatch, out: list[tuple]) -> pa.RecordBatch:
            n, form, before, middle, output = zip(*out)
            made = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())]
            return pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=[*kept, *RESULTS])

        for batch in batches:
            out, chars, start = [], 0, 0
            for k, (name, value) in enumerate(zip(batch.column(len(kept)), batch.column(at))):
                whole = value.as_py() or ""
                out.append(arranged(name.as_py(), whole, automaton, seed, sentinels, rate, spm_rate))
                chars += len(whole)
                if chars > batch_chars:
                    yield done(batch.slice(start, k + 1 - start), out)
                    out, chars, start = [], 0, k + 1
            if out:
                yield done(batch.slice(start), out)

    return rows.mapInArrow(run, schema)


def restored(output: str = "output", form: str = "form", sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text again, from an output and its form; no part of a rearranged text can hold or complete a sentinel."""
    whole = F.col(output)
    p, s, m = (F.locate(x, whole) for x in sentinels)
    long_p, long_s, long_m = map(len, sentinels)
    middle = F.substring(whole, m + long_m, F.length(whole))
    psm = F.concat(F.substring(whole, p + long_p, s - p - long_p), middle, F.substring(whole, s + long_s, m - s - long_s))
    spm = F.concat(F.substring(whole, p + long_p, m - p - long_p), middle, F.substring(whole, s + long_s, p - s - long_s))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(whole)
