"""Token-id files: a static range asymmetric numeral system over independent blocks.

``write_tokens`` makes a folder of three Parquet tables, so it lives in any
store that Spark writes to and survives lost executors by Spark's own commit:

* ``segments``: one binary segment for about ``segment_tokens`` ids of whole
  documents, in ascending key order. A segment is
  header | document keys | document lengths | block table | blocks, and a block is
  checkpoints | 32-bit words. All integers are little-endian.
* ``table``: the frequency table that all blocks share, quantised to 2^20.
* ``index``: for each segment the number of ids before it.

A block holds ``lanes`` interleaved coders; lane k codes every ids[k::lanes].
Blocks don't depend on each other, and each has a checkpoint (the lanes'
states and the place in the words) every ``every`` steps, so that a reader may
start at any of them: the decoder here runs all checkpoints of all blocks of a
segment side by side. Every block carries the CRC-32 of its ids, which the
decoder verifies; a mismatch raises.

Encoding is by the given tokenizer. A text is cut at ASCII white space, which
the vocabularies used here never cross, and each distinct word is encoded once
by the library and remembered up to a bound. A tokenizer for which that fails
on samples gets whole texts.

The document order needs one range exchange of the ids. Starts are prefix sums
in two levels (within a partition, then over partitions). Only the frequency
table (at most the vocabulary) and the tokenizer file go through the driver.

Defined results: a null or empty text is the end id alone; repeated keys are
stored in the order of their ids; a null key comes first; an empty table gives
empty files that read back as no rows.
"""

from __future__ import annotations

import struct
import sys
import zlib
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrashift.llm.storage import fresh_path, written

SCALE = 20  # bits of the frequency table
LOW = 1 << 31  # a state stays in [2^31, 2^63)
HEADER = "<4sHHIIQII"  # magic, version, lanes, steps of a block, checkpoint every, ids, documents, blocks
BLOCK = "<IIIIQ"  # ids, words, checkpoints, CRC-32 of the ids, byte offset in the blocks
MAGIC = b"TSRA"


# --- the coder ---------------------------------------------------------------


def quantised(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to sum to 2^SCALE, at least 1 where there is any."""
    total, scale = int(counts.sum()), 1 << SCALE
    if total == 0:
        return np.zeros(len(counts), np.int64)
    if np.count_nonzero(counts) > scale:
        raise ValueError("more distinct ids than the frequency table has slots")
    freq = np.where(counts > 0, np.maximum(1, counts.astype(np.float64) * scale / total), 0).astype(np.int64)
    excess = int(freq.sum()) - scale
    if excess < 0:
        freq[int(np.argmax(freq))] -= excess
    for k in np.argsort(-freq, kind="stable") if excess > 0 else ():
        taken = min(excess, int(freq[k]) - 1)
        freq[k] -= taken
        excess -= taken
        if not excess:
            break
    return freq


class Coder:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray, every: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """ids (blocks, steps, lanes) -> words of each block, states and word places at each checkpoint.

        The states are (blocks, checkpoints, lanes); checkpoint 0 is the beginning.
        """
        blocks, steps, lanes = ids.shape
        state = np.full((blocks, lanes), LOW, np.uint64)
        words = np.zeros((steps, blocks, lanes), np.uint32)
        spilled = np.zeros((steps, blocks, lanes), bool)
        held = np.zeros((blocks, -(-steps // every), lanes), np.uint64)
        for t in range(steps - 1, -1, -1):
            f, c = self.freq[ids[:, t]], self.start[ids[:, t]]
            over = state >= f << np.uint64(63 - SCALE)
            words[t], spilled[t] = state, over  # the low 32 bits
            state = np.where(over, state >> np.uint64(32), state)
            whole = state // f
            state = (whole << np.uint64(SCALE)) + (state - whole * f) + c
            if t % every == 0:
                held[:, t // every] = state
        out = [words[:, b][spilled[:, b]] for b in range(blocks)]
        before = np.concatenate([np.zeros((1, blocks), np.int64), np.cumsum(spilled.sum(axis=2), axis=0)])
        return out, held, before[0:steps:every].T.astype(np.uint32)

    def decode(self, steps: np.ndarray, states: np.ndarray, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Runs of (runs, lanes) states, each from its place ``at`` in ``words``: ids (runs, max steps, lanes)."""
        state, at = states.copy(), at.astype(np.int64)
        ids = np.zeros((len(steps), int(steps.max(initial=0)), states.shape[1]), np.uint32)
        mask = np.uint64((1 << SCALE) - 1)
        padded = np.append(words, np.zeros(states.shape[1], np.uint32))
        for t in range(ids.shape[1]):
            slot = state & mask
            s = self.symbol[slot]
            ids[:, t] = s
            state = self.freq[s] * (state >> np.uint64(SCALE)) + slot - self.start[s]
            low = (state < LOW) & (steps > t)[:, None]
            place = np.minimum(at[:, None] + np.cumsum(low, axis=1) - 1, len(padded) - 1)
            state = np.where(low, state << np.uint64(32) | padded[np.maximum(place, 0)], state)
            at += low.sum(axis=1)
        return ids


def encode_segment(
    coder: Coder, keys: np.ndarray, known: np.ndarray, lengths: np.ndarray, ids: np.ndarray, lanes: int, steps: int, every: int
) -> bytes:
    """One segment: ``ids`` of whole documents, with their keys (``known`` is false for a null key)."""
    size = lanes * steps
    full = len(ids) // size
    groups = [(ids[: full * size], full, steps)] if full else []
    if rest := len(ids) - full * size:
        rows = -(-rest // lanes)
        tail = np.full(rows * lanes, ids[-1], ids.dtype)  # filled up with an id that certainly has a frequency
        tail[:rest] = ids[full * size :]
        groups.append((tail, 1, rows))
    table, body, offset = [], [], 0
    at = 0
    for part, n, rows in groups:
        words, states, places = coder.encode(part.reshape(n, rows, lanes), every)
        for b in range(n):
            here = ids[at : at + size] if rows == steps and n == full else ids[at:]
            points = b"".join(places[b, k].tobytes() + states[b, k].astype("<u8").tobytes() for k in range(states.shape[1]))
            block = points + words[b].astype("<u4").tobytes()
            crc = zlib.crc32(here.astype("<u4").tobytes())
            table.append(struct.pack(BLOCK, len(here), len(words[b]), states.shape[1], crc, offset))
            body.append(block)
            offset += len(block)
            at += len(here)
    head = struct.pack(HEADER, MAGIC, 1, lanes, steps, every, len(ids), len(keys), len(table))
    docs = keys.astype("<i8").tobytes() + known.astype(np.uint8).tobytes() + lengths.astype("<u4").tobytes()
    return b"".join([head, docs, *table, *body])


def decode_segment(coder: Coder, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """keys, known, lengths and ids of a segment."""
    magic, version, lanes, steps, every, n, docs, blocks = struct.unpack_from(HEADER, data)
    if magic != MAGIC or version != 1:
        raise ValueError("not a token segment of version 1")
    at = struct.calcsize(HEADER)
    keys = np.frombuffer(data, "<i8", docs, at)
    known = np.frombuffer(data, np.uint8, docs, at + 8 * docs).astype(bool)
    lengths = np.frombuffer(data, "<u4", docs, at + 9 * docs)
    at += 13 * docs
    table = [struct.unpack_from(BLOCK, data, at + k * struct.calcsize(BLOCK)) for k in range(blocks)]
    at += blocks * struct.calcsize(BLOCK)
    point = 4 + 8 * lanes
    run_steps, states, starts, words, base = [], [], [], [], 0
    for size, n_words, points, _, offset in table:
        rows = -(-size // lanes)
        for k in range(points):
            p = at + offset + k * point
            starts.append(base + int.from_bytes(data[p : p + 4], "little"))
            states.append(np.frombuffer(data, "<u8", lanes, p + 4))
            run_steps.append(min(every, rows - k * every))
        words.append(np.frombuffer(data, "<u4", n_words, at + offset + points * point))
        base += n_words
    if not table:
        return keys, known, lengths, np.zeros(0, np.uint32)
    got = coder.decode(np.array(run_steps), np.array(states, np.uint64), np.concatenate(words), np.array(starts))
    out, run = [], 0
    for k, (size, _, points, crc, _) in enumerate(table):
        ids = np.concatenate([got[run + j, : run_steps[run + j]].ravel() for j in range(points)])[:size]
        run += points
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {k}: its ids don't have the checksum that was stored")
        out.append(ids)
    return keys, known, lengths, np.concatenate(out)


# --- tokens -----------------------------------------------------------------


def _worker() -> ModuleType:
    """A place that outlives a task: tokenizers and word caches are made once for each worker."""
    return sys.modules.setdefault("_terrashift_worker", ModuleType("_terrashift_worker"))


PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_letters() -> dict[int, int]:
    """How byte-level vocabularies spell bytes: visible ones as themselves, the rest by letters from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: 256 + k for k, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()


def _letters(word: bytes) -> str | None:
    """The byte-level spelling of a word of small Latin letters, which no normaliser changes and nothing parts; else None."""
    if word.isalpha() and word.islower():  # ASCII
        return word.decode()
    text = word.decode("utf-8", "replace")
    if text.isalpha() and max(text) < "\u0250" and text == text.lower():
        return word.decode("latin-1").translate(BYTE_LETTERS)
    return None


def _ends_word(stem: bytes) -> bool:
    """Whether the last character is a letter or digit, and stays one when it is lower-cased."""
    last = stem[-4:].decode("utf-8", "ignore")[-1:]
    return last.isalnum() and last.lower()[-1:].isalnum()


class _Memory(dict):
    """Words to ids; a word that is in neither generation is encoded once, when it is asked for."""

    def __init__(self, older: dict[bytes, bytes], encoded: Callable[[bytes], bytes]):
        self.older, self.encoded = older, encoded

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.encoded(word)
        self[word] = ids
        return ids


class WordEncoder:
    """Texts to ids through a bounded memory of words.

    A word is what lies between ASCII white space, A-Z lower-cased if the
    tokenizer lower-cases. Only words that are not in memory reach the
    library: words of small Latin letters its model, others the whole of it. A
    word that ends in ASCII punctuation after a letter or digit is its stem's
    ids and theirs, as the pre-tokenizer parts them there. These shortcuts are
    tried on samples when the encoder is made and dropped if the tokenizer
    disagrees.

    The memory is two generations of ``most / 2`` words and those of one call:
    what was not used since the last one was full is forgotten.
    """

    TRIALS = (
        "Stem, word. A.B, x.. it's 12,5. \u00e9t\u00e9., don't,. ***, e\u0301.",
        "ONE, two,three ,. three. (four), five!! a%%% b&&&' c-- dogs' 'tis' it's'",
        "plain words unaccountably stra\u00dfe \u00f1and\u00fa \u0153uvre \u00aa\u00ba na\u00efvet\u00e9 \u00c9T\u00c9 zzzqxj",
    )

    def __init__(self, tokenizer_json: str, end_id: int | None, most: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model = self.tokenizer.model
        self.kind = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.pack = struct.Struct("<H" if self.kind == "<u2" else "<I").pack
        self.end = b"" if end_id is None else np.array([end_id], self.kind).tobytes()
        self.most = most
        self.lower = self._ids("ABC xYz") == self._ids("abc xyz")
        self.words_apart = self.parts = self.direct = True
        self.words = _Memory({}, self._encoded)
        for flag in ("direct", "parts", "words_apart"):
            for t in self.TRIALS:
                if self.encode([t])[0] != self._bytes(self._ids(t)) + self.end:
                    setattr(self, flag, False)
                self.words.clear()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _cut(self, text: str | None) -> list[bytes]:
        data = (text or "").encode("utf-8", "surrogatepass")
        if self.lower and b"<|" not in data:  # a special token is spelt in one case only
            data = data.lower()
        return data.split()

    def _encoded(self, word: bytes) -> bytes:
        if self.direct and (letters := _letters(word)):
            return b"".join([self.pack(t.id) for t in self.model.tokenize(letters)])
        if self.parts and word[-1] < 128 and not word[-1:].isalnum() and b"<|" not in word:
            stem = word.rstrip(PUNCTUATION)
            if stem and len(stem) < len(word) and (stem[-1:].isalnum() or _ends_word(stem)):
                return self.words[stem] + self.words[word[len(stem) :]]
        return self._bytes(self._ids(word.decode("utf-8", "replace")))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids, little-endian, with the end id."""
        if not self.words_apart:
            found = self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
            return [self._bytes(e.ids) + self.end for e in found]
        if len(self.words) > self.most // 2:
            self.words = _Memory(dict(self.words), self._encoded)
        known = self.words.__getitem__
        return [b"".join(map(known, self._cut(t))) + self.end for t in texts]


def worker_encoder(tokenizer_json: str, end_id: int | None) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
    held = _worker().__dict__.setdefault("encoders", {})
    name = (hash(tokenizer_json), end_id)
    if name not in held:
        held[name] = WordEncoder(tokenizer_json, end_id)
    return held[name]


def tokenised(docs: DataFrame, tokenizer_json: str, end_id: int | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ids (BINARY, the tokenizer's id width) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared.value, end_id)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = pa.array(encoder.encode(part.column(1).to_pylist()), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["key", "ids"])

    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "key bigint, ids binary")


def id_counts(tokens: DataFrame, width: int, size: int) -> np.ndarray:
    """How often each id occurs; a row for each id and task is shuffled, a row for each id reaches the driver."""
    kind = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            joined = b"".join(x.as_py() for x in batch.column(0))
            counts += np.bincount(np.frombuffer(joined, kind), minlength=size)
        (found,) = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(counts[found])], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[rows.column("id").to_numpy()] = rows.column("n").to_numpy()
    return out


# --- the files --------------------------------------------------------------


def write_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    path: str | None = None,
    end_id: int | None = 1,
    key: str = "doc_id",
    text: str = "text",
    segment_tokens: int = 1 << 19,
    lanes: int = 64,
    steps: int = 512,
    every: int = 128,
) -> str:
    """Encode every whole text and write the folder; returns its path."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    path = path or fresh_path(spark, "tokens")
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    size = max(Tokenizer.from_str(tokenizer_json).get_vocab_size(with_added_tokens=True), (end_id or 0) + 1)
    width = 2 if size <= 1 << 16 else 4
    tokens = written(tokenised(docs, tokenizer_json, end_id, key, text), "ids")
    freq = quantised(id_counts(tokens, width, size))
    spark.createDataFrame(pa.table({"id": np.arange(size, dtype=np.int32), "freq": freq})).coalesce(1).write.parquet(f"{path}/table")
    kind = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        keys, ids, held, number, part = [], [], 0, 0, -1
        for batch in batches:
            for k, x in zip(batch.column(0), batch.column(1)):
                keys.append(k.as_py())
                ids.append(np.frombuffer(x.as_py(), kind))
                held += len(ids[-1])
                if held >= segment_tokens:
                    yield segment(coder, keys, ids, batch.column(2)[0].as_py(), number)
                    keys, ids, held, number = [], [], 0, number + 1
            if batch.num_rows:
                part = batch.column(2)[0].as_py()
        if keys:
            yield segment(coder, keys, ids, part, number)

    def segment(coder: Coder, keys: list, ids: list[np.ndarray], part: int, number: int) -> pa.RecordBatch:
        known = np.array([k is not None for k in keys])
        lengths = np.array([len(x) for x in ids], np.uint32)
        data = encode_segment(
            coder, np.array([k or 0 for k in keys], np.int64), known, lengths, np.concatenate(ids).astype(np.uint32), lanes, steps, every
        )
        cols = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([int(lengths.sum())], pa.int64())]
        return pa.RecordBatch.from_arrays([*cols, pa.array([data], pa.binary())], names=["part", "number", "n_tokens", "data"])

    ordered = tokens.repartitionByRange("key").sortWithinPartitions("key", "ids").withColumn("part", F.spark_partition_id())
    segments = ordered.mapInArrow(run, "part int, number int, n_tokens bigint, data binary")
    segments.write.option("compression", "none").parquet(f"{path}/segments")
    sizes = spark.read.parquet(f"{path}/segments").select("part", "number", "n_tokens")
    within = F.sum("n_tokens").over(W.partitionBy("part").orderBy("number")) - F.col("n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row for each task of the range exchange
    before = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    index = sizes.withColumn("within", within).join(before, "part")
    index.select("part", "number", (F.col("before") + F.col("within")).alias("start")).write.parquet(f"{path}/index")
    return path


def decoded(spark: SparkSession, path: str) -> DataFrame:
    """part, number, key, local (start in the segment), n_tokens and ids of every document in the files."""
    held = spark.read.parquet(f"{path}/table").toArrow()  # at most a row for each id of the vocabulary
    freq = np.zeros(held.num_rows, np.int64)
    freq[held.column("id").to_numpy()] = held.column("freq").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        for batch in batches:
            for part, number, data in zip(*batch.columns):
                keys, known, lengths, ids = decode_segment(coder, data.as_py())
                ends = np.cumsum(lengths, dtype=np.int64)
                plain = ids.astype("<u4").tobytes()
                for at in range(0, len(keys), 2000):
                    sel = slice(at, at + 2000)
                    cut = [plain[4 * (e - n) : 4 * e] for e, n in zip(ends[sel].tolist(), lengths[sel].tolist())]
                    rows = len(cut)
                    cols = [
                        pa.array(np.full(rows, part.as_py(), np.int32)),
                        pa.array(np.full(rows, number.as_py(), np.int32)),
                        pa.array(keys[sel], pa.int64(), mask=~known[sel]),
                        pa.array(ends[sel] - lengths[sel]),
                        pa.array(lengths[sel].astype(np.int64)),
                        pa.array(cut, pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(cols, names=["part", "number", "key", "local", "n_tokens", "ids"])

    segments = spark.read.parquet(f"{path}/segments").select("part", "number", "data")
    return segments.mapInArrow(run, "part int, number int, key bigint, local bigint, n_tokens bigint, ids binary")


def with_starts(docs: DataFrame, path: str, key: str) -> DataFrame:
    """The rows of ``decoded`` (any columns of it) with key and start instead of their place in the files."""
    index = docs.sparkSession.read.parquet(f"{path}/index")
    rest = [c for c in docs.columns if c not in ("part", "number", "key", "local")]
    start = (F.col("start") + F.col("local")).alias("start")
    return docs.join(index, ["part", "number"]).select(F.col("key").alias(key), start, *rest)


def read_tokens(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """``key``, start, n_tokens and ids (BINARY, little-endian unsigned 32-bit) of every document."""
    return with_starts(decoded(spark, path), path, key)


def read_checksums(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """``key``, start, n_tokens and ids_crc32 of every document; the ids don't leave the task that decodes them."""
    thin = decoded(spark, path).select("part", "number", "key", "local", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return with_starts(thin, path, key)
