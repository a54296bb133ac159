"""GeoTIFF bands: headers from a few bytes, blocks decoded in the executors, only what a band list and a window need.

A file is a row of (path, content), from Spark's ``binaryFile`` reader or from
a table of blobs. A band list prunes files while they are listed, a window
prunes blocks before they are inflated, and a task holds one file and one
decoded block at a time; blocks become pixel rows as they are decoded.

Classic and big TIFF, both byte orders, strips and tiles, chunky and separate
planes, no compression or DEFLATE, predictors 1 to 3. Anything else is an error
that names the file. A pixel that holds the file's nodata value, or no finite
number, is not observed: its value is NULL.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrashift.config import BANDS

Read = Callable[[int, int], bytes]

# Tags of the format, the sizes and codes of its field types, and the two geo keys that hold an EPSG code.
WIDTH, HEIGHT, BITS, COMPRESSION, SAMPLES, ROWS_PER_STRIP, PLANAR, PREDICTOR = 256, 257, 258, 259, 277, 278, 284, 317
STRIP_OFFSETS, STRIP_BYTES, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 273, 279, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, TRANSFORM, GEO_KEYS, NODATA = 33550, 33922, 34264, 34735, 42113
FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
PROJECTED, GEOGRAPHIC, RASTER_TYPE = 3072, 2048, 1025
PLAIN, DEFLATE, OLD_DEFLATE = 1, 8, 32946

#: What describes a grid; the places of the blocks are fetched only to decode them.
GRID_TAGS = frozenset({WIDTH, HEIGHT, BITS, COMPRESSION, SAMPLES, ROWS_PER_STRIP, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, SAMPLE_FORMAT, PIXEL_SCALE, TIE_POINT, TRANSFORM, GEO_KEYS, NODATA})
BLOCK_TAGS = frozenset({STRIP_OFFSETS, STRIP_BYTES, TILE_OFFSETS, TILE_BYTES})
GRID = (
    "width int, height int, bands int, sample string, epsg int, west double, north double, step_x double, step_y double, "
    "rotated boolean, nodata double"
)
PATH = r"([^/]+)/imgs_([12])(?:_rect)?/(?:[^/]*_)?([^/_]+)\.tif$"


@dataclass(frozen=True)
class Tiff:
    """The first directory of a file: byte order and the values of its tags."""

    order: str
    tags: dict[int, tuple]

    def one(self, tag: int, default=None):
        return self.tags[tag][0] if tag in self.tags else default

    @property
    def dtype(self) -> np.dtype:
        kinds = {1: "u", 2: "i", 3: "f"}
        bits, kind = set(self.tags.get(BITS, (1,))), set(self.tags.get(SAMPLE_FORMAT, (1,)))
        if len(bits) > 1 or len(kind) > 1 or not bits <= {8, 16, 32, 64} or not kind <= set(kinds):
            raise ValueError(f"samples of {sorted(bits)} bits and formats {sorted(kind)} are not supported")
        return np.dtype(f"{self.order}{kinds[kind.pop()]}{bits.pop() // 8}")

    @property
    def nodata(self) -> float | None:
        text = self.tags.get(NODATA, (b"",))[0].split(b"\0")[0].strip()
        return float(text) if text else None

    def grid(self) -> dict:
        """The columns of GRID; no place on the ground where the file states none."""
        epsg, point = None, False
        keys = self.tags.get(GEO_KEYS, ())
        held = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
        epsg = held.get(PROJECTED, held.get(GEOGRAPHIC))
        point = held.get(RASTER_TYPE) == 2
        west = north = step_x = step_y = None
        rotated = False
        if TRANSFORM in self.tags:
            m = self.tags[TRANSFORM]
            step_x, step_y, west, north, rotated = m[0], -m[5], m[3], m[7], abs(m[1]) > 1e-9 or abs(m[4]) > 1e-9
        elif PIXEL_SCALE in self.tags and TIE_POINT in self.tags:
            (step_x, step_y), tie = self.tags[PIXEL_SCALE][:2], self.tags[TIE_POINT]
            west, north = tie[3] - tie[0] * step_x, tie[4] + tie[1] * step_y
        if west is not None and point:  # the place is a pixel's centre
            west, north = west - step_x / 2, north + step_y / 2
        return {
            "width": self.one(WIDTH), "height": self.one(HEIGHT), "bands": self.one(SAMPLES, 1), "sample": self.dtype.newbyteorder("=").name,
            "epsg": epsg, "west": west, "north": north, "step_x": step_x, "step_y": step_y, "rotated": rotated, "nodata": self.nodata,
        }


def read_tiff(read: Read, wanted: frozenset[int] = GRID_TAGS) -> Tiff:
    """The first directory by range reads: its entries, and of long values only the ``wanted`` ones."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(bytes(head[:2]))
    if order is None or len(head) < 8:
        raise ValueError("not a TIFF file")
    magic = struct.unpack(order + "H", head[2:4])[0]
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    at, (count, offset, room) = (struct.unpack(order + "I", head[4:8])[0], ("H", "I", 4)) if magic == 42 else (struct.unpack(order + "Q", head[8:16])[0], ("Q", "Q", 8))
    size = struct.calcsize(order + count)
    n = struct.unpack(order + count, read(at, size))[0]
    entry = struct.Struct(f"{order}HH{offset}{room}s")
    tags = {}
    for tag, kind, many, raw in entry.iter_unpack(read(at + size, n * entry.size)):
        if tag not in wanted or kind not in FIELD:
            continue
        code = f"{order}{many}s" if kind == 2 else f"{order}{many}{FIELD[kind]}"
        length = struct.calcsize(code)
        tags[tag] = struct.unpack(code, raw[:length] if length <= room else read(struct.unpack(order + offset, raw)[0], length))
    if WIDTH not in tags or HEIGHT not in tags:
        raise ValueError("the file states no size")
    return Tiff(order, tags)


def _inflated(raw: bytes, compression: int) -> bytes:
    if compression == PLAIN:
        return raw
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(raw)
    raise ValueError(f"compression {compression} is not supported")


def _block(raw: bytes, tiff: Tiff, rows: int, width: int, samples: int) -> np.ndarray:
    """(rows, width, samples) of an inflated block, its predictor undone."""
    kind, predictor = tiff.dtype, tiff.one(PREDICTOR, 1)
    if predictor == 3:
        # bytes of a row by significance, each the difference to the one a pixel before
        planes = np.frombuffer(raw, np.uint8).reshape(rows, kind.itemsize * width, samples)
        planes = np.add.accumulate(planes, axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, width * samples)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{kind.itemsize}").reshape(rows, width, samples)
    block = np.frombuffer(raw, kind).reshape(rows, width, samples)
    if predictor == 2:
        return np.add.accumulate(block.astype(kind.newbyteorder("=")), axis=1, dtype=kind.newbyteorder("="))
    if predictor != 1:
        raise ValueError(f"predictor {predictor} is not supported")
    return block


def blocks(read: Read, window: tuple[int, int, int, int] | None = None, band: int = 1) -> Iterator[tuple[int, int, np.ndarray]]:
    """(y, x, values) of one band (from 1), block by block, cut to the ``window`` (y, x, height, width)."""
    tiff = read_tiff(read, GRID_TAGS | BLOCK_TAGS)
    height, width, samples = tiff.one(HEIGHT), tiff.one(WIDTH), tiff.one(SAMPLES, 1)
    if not 1 <= band <= samples:
        raise ValueError(f"band {band} of {samples}")
    y0, x0, h, w = window or (0, 0, height, width)
    y1, x1 = min(height, y0 + h), min(width, x0 + w)
    y0, x0 = max(0, y0), max(0, x0)
    tiled = TILE_OFFSETS in tiff.tags
    rows = tiff.one(TILE_HEIGHT) if tiled else min(tiff.one(ROWS_PER_STRIP, height), height)
    cols = tiff.one(TILE_WIDTH) if tiled else width
    offsets, sizes = (tiff.tags[t] for t in ((TILE_OFFSETS, TILE_BYTES) if tiled else (STRIP_OFFSETS, STRIP_BYTES)))
    down, across = -(-height // rows), -(-width // cols)
    separate = tiff.one(PLANAR, 1) == 2
    first, held, plane = ((band - 1) * down * across, 1, 0) if separate else (0, samples, band - 1)
    for i in range(y0 // rows, -(-y1 // rows)):
        for j in range(x0 // cols, -(-x1 // cols)):
            k = first + i * across + j
            tall = rows if tiled else min(rows, height - i * rows)
            raw = _inflated(read(offsets[k], sizes[k]), tiff.one(COMPRESSION, PLAIN))
            block = _block(raw, tiff, tall, cols, held)[:, :, plane]
            top, left = max(y0, i * rows), max(x0, j * cols)
            cut = block[top - i * rows : y1 - i * rows, left - j * cols : x1 - j * cols]
            if cut.size:
                yield top, left, cut


def values(tiff_nodata: float | None, block: np.ndarray, scale: float, offset: float) -> pa.Array:
    """The block as doubles, (raw - offset) / scale, NULL where nothing was observed."""
    flat = block.astype(np.float64).ravel()
    seen = np.isfinite(flat)
    if tiff_nodata is not None:
        seen &= flat != tiff_nodata
    return pa.array((flat - offset) / scale, pa.float64(), mask=~seen)


def decoded(files: DataFrame, keys: list[str], scale: float = 10_000.0, offset: float = 0.0, window: tuple[int, int, int, int] | None = None, band: str | None = None) -> DataFrame:
    """``keys``, y, x and value of every pixel of the files (content), of the window if there is one.

    ``band`` names a column with the index of the band in its file (from 1);
    without it the first band is read. y and x count from the file's first
    pixel; a block never becomes more rows than it has pixels in the window.
    """
    schema = ", ".join(f"{k} {files.schema[k].dataType.simpleString()}" for k in keys) + ", y int, x int, value double"
    index = F.col(band) if band else F.lit(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                data = memoryview(row.column(len(keys))[0].as_buffer())
                read = lambda at, n, data=data: bytes(data[at : at + n])
                nodata = read_tiff(read).nodata
                for y, x, block in blocks(read, window, row.column(len(keys) + 1)[0].as_py()):
                    ys, xs = np.mgrid[y : y + block.shape[0], x : x + block.shape[1]].astype(np.int32)
                    same = pa.array(np.zeros(block.size, np.int64))
                    cols = [c.take(same) for c in row.columns[: len(keys)]]
                    cols += [pa.array(ys.ravel()), pa.array(xs.ravel()), values(nodata, block, scale, offset)]
                    yield pa.RecordBatch.from_arrays(cols, names=[*keys, "y", "x", "value"])

    return files.select(*keys, "content", index.cast("int").alias("_band")).mapInArrow(run, schema)


def headers(files: DataFrame) -> DataFrame:
    """``files`` (path) with the columns of GRID, bytes_read and problem, by range reads of each file: no pixel is read.

    A file that is no raster of a supported kind has its problem and no grid.
    Paths are opened in the tasks by Arrow's file systems (local, HDFS, S3, GCS).
    """
    schema = f"path string, {GRID}, bytes_read bigint, problem string"
    names = [part.split()[0] for part in GRID.split(", ")]

    def one(path: str) -> dict:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
        seen = 0
        with store.open_input_file(inner) as stream:

            def read(at: int, n: int) -> bytes:
                nonlocal seen
                got = stream.read_at(n, at)
                seen += len(got)
                return got

            try:
                return {"path": path, **read_tiff(read).grid(), "bytes_read": seen, "problem": None}
            except (ValueError, struct.error) as err:
                return {"path": path, **dict.fromkeys(names), "bytes_read": seen, "problem": str(err)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([one(p.as_py()) for p in batch.column(0)], schema=arrow)

    arrow = pa.schema([("path", pa.string()), *((n, _arrow(t)) for n, t in (p.split() for p in GRID.split(", "))), ("bytes_read", pa.int64()), ("problem", pa.string())])
    return files.select("path").mapInArrow(run, schema)


def _arrow(kind: str) -> pa.DataType:
    return {"int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}[kind]


def blob_headers(files: DataFrame, keys: list[str], head_bytes: int = 4096) -> DataFrame:
    """``keys`` and the columns of GRID of blobs (content); a task gets the first ``head_bytes`` of each, which must hold the directory."""
    schema = ", ".join(f"{k} {files.schema[k].dataType.simpleString()}" for k in keys) + f", {GRID}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grids = []
            for raw in batch.column(len(keys)):
                data = raw.as_py()
                grids.append(read_tiff(lambda at, n, data=data: data[at : at + n]).grid())
            made = pa.RecordBatch.from_pylist(grids, schema=arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made.columns], names=[*keys, *made.schema.names])

    arrow = pa.schema([(n, _arrow(t)) for n, t in (p.split() for p in GRID.split(", "))])
    return files.select(*keys, F.substring("content", 1, head_bytes).alias("content")).mapInArrow(run, schema)


# --- files of a scene


def band_files(files: DataFrame, bands: tuple[str, ...] = BANDS) -> DataFrame:
    """scene, t, band and path: for each band of a folder ``B04.tif``, else ``b04.tif``, else the first ``*_B04.tif``; rectified folders win.

    ``files`` has path. An unknown band name is an error.
    """
    if unknown := [b for b in bands if not (b[:1] == "B" and b[1:].isalnum())]:
        raise ValueError(f"unknown bands: {unknown}")
    scene, t, band = (F.regexp_extract("path", PATH, k) for k in (1, 2, 3))
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select("path", scene.alias("scene"), t.alias("t"), F.upper(band).alias("band"), band.alias("written"), name.alias("name"))
    rows = rows.where((F.col("scene") != "") & ~F.col("scene").startswith("_") & F.col("band").isin(*bands))
    plain = F.col("name") == F.concat("written", F.lit(".tif"))
    rank = F.when(plain & (F.col("written") == F.col("band")), 0).when(plain, 1).when(F.col("written") == F.col("band"), 2)
    raw = (~F.col("path").contains("_rect/")).cast("int")
    best = rows.withColumn("rank", rank).where("rank is not null").groupBy("scene", "t", "band").agg(F.min(F.struct(raw.alias("raw"), "rank", "path")).alias("b"))
    return best.select("scene", F.col("t").cast("int").alias("t"), "band", "b.path")


def read_bands(spark: SparkSession, root: str, bands: tuple[str, ...] = BANDS, scale: float = 10_000.0, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """scene, y, x and each band at both dates (``B041``, ``B042``): scenes below ``root`` as one row a pixel.

    The listing reads no content and decides which files are opened. A scene
    that lacks a band at a date is an error, as a gate over fewer bands would
    be another gate.
    """

    def source(names: list[str] | str):
        found = "{" + ",".join(f"*{b},*{b.lower()}" for b in bands) + "}.tif"
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", found).load(names)

    chosen = band_files(source(root).select("path"), bands)
    gone = chosen.groupBy("scene").agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.concat("band", F.lit(" at date "), "t")).alias("held")).where(F.col("n") < 2 * len(bands))
    if lacking := gone.head():
        raise FileNotFoundError(f"{lacking.scene} has only {sorted(lacking.held)}")
    pixels = decoded(source(root).join(chosen, "path"), ["scene", "t", "band"], scale, window=window)
    return paired(pixels, bands)


def paired(pixels: DataFrame, bands: tuple[str, ...]) -> DataFrame:
    """scene, y, x and every band at both dates, in one aggregation of (scene, t, band, y, x, value)."""
    cells = [F.max(F.when((F.col("t") == t) & (F.col("band") == b), F.col("value"))).alias(f"{b}{t}") for t in (1, 2) for b in bands]
    return pixels.groupBy("scene", "y", "x").agg(*cells)


# --- writing


def encoded_block(block: np.ndarray, order: str = "<", deflate: bool = True, predictor: int = 1) -> bytes:
    """(rows, width, samples) as the bytes of a block."""
    if predictor == 2:
        block = np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1]))
    raw = block.astype(block.dtype.newbyteorder(order)).tobytes()
    return zlib.compress(raw) if deflate else raw


def assembled(
    parts: list[bytes], height: int, width: int, dtype: np.dtype, rows: int, cols: int | None = None, order: str = "<", deflate: bool = True,
    predictor: int = 1, samples: int = 1, west: float | None = None, north: float | None = None, step: float = 10.0, epsg: int | None = None, nodata: float | None = None,
) -> bytes:
    """A file of encoded blocks in raster order: strips of ``rows``, or tiles of ``rows`` by ``cols``. The directory comes first."""
    kind = {"u": 1, "i": 2, "f": 3}[dtype.kind]
    tags: dict[int, tuple[int, tuple | bytes]] = {
        WIDTH: (4, (width,)), HEIGHT: (4, (height,)), BITS: (3, (dtype.itemsize * 8,) * samples), COMPRESSION: (3, (DEFLATE if deflate else PLAIN,)),
        262: (3, (1,)), SAMPLES: (3, (samples,)), PLANAR: (3, (1,)), PREDICTOR: (3, (predictor,)), SAMPLE_FORMAT: (3, (kind,) * samples),
    }
    if cols:
        tags |= {TILE_WIDTH: (4, (cols,)), TILE_HEIGHT: (4, (rows,)), TILE_BYTES: (4, tuple(map(len, parts)))}
    else:
        tags |= {ROWS_PER_STRIP: (4, (rows,)), STRIP_BYTES: (4, tuple(map(len, parts)))}
    if west is not None:
        tags |= {PIXEL_SCALE: (12, (step, step, 0.0)), TIE_POINT: (12, (0.0, 0.0, 0.0, west, north, 0.0))}
    if epsg is not None:
        tags[GEO_KEYS] = (3, (1, 1, 0, 2, RASTER_TYPE, 0, 1, 1, PROJECTED, 0, 1, epsg))
    if nodata is not None:
        tags[NODATA] = (2, f"{nodata:g}".encode() + b"\0")
    places = TILE_OFFSETS if cols else STRIP_OFFSETS
    tags[places] = (4, (0,) * len(parts))

    def packed(field: int, content: tuple | bytes) -> bytes:
        return content if field == 2 else struct.pack(f"{order}{len(content)}{FIELD[field]}", *content)

    long = {t: packed(*v) for t, v in tags.items() if len(packed(*v)) > 4}
    at = 8 + 2 + 12 * len(tags) + 4
    where = {}
    for t in sorted(long):
        where[t] = at
        at += len(long[t]) + len(long[t]) % 2
    offsets = []
    for part in parts:
        offsets.append(at)
        at += len(part)
    tags[places] = (4, tuple(offsets))
    out = [struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, 8), struct.pack(f"{order}H", len(tags))]
    for t in sorted(tags):
        field, content = tags[t]
        inline = struct.pack(f"{order}I", where[t]) if t in where else packed(field, content).ljust(4, b"\0")
        out.append(struct.pack(f"{order}HHI", t, field, len(content)) + inline)
    out.append(struct.pack(f"{order}I", 0))
    for t in sorted(long):
        data = packed(*tags[t])
        out.append(data + b"\0" * (len(data) % 2))
    return b"".join(out + parts)


def written_blobs(pixels: DataFrame, keys: list[str], layout: DataFrame, tile: int = 16, nodata: int = 65535) -> DataFrame:
    """``keys`` and content: a file of unsigned 16-bit values for each group of pixels (keys, y, x, value).

    Blocks are encoded each by itself, in tasks of their own; a file's blocks
    meet only as compressed bytes. ``layout`` has, for each group, height,
    width, west, north, epsg, big_endian, tiled, deflate and predictor, and
    rows below ``height`` and ``width`` that no pixel names hold nodata.
    """
    form = ["height", "width", "west", "north", "epsg", "big_endian", "tiled", "deflate", "predictor"]
    kinds = ", ".join(f"{k} {pixels.schema[k].dataType.simpleString()}" for k in keys)

    def block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        f = rows.iloc[0]
        at_y, at_x = int(key[-2]) * tile, int(key[-1]) * tile if f.tiled else 0
        tall, wide = (tile, tile) if f.tiled else (min(tile, int(f.height) - at_y), int(f.width))
        cells = np.full((tall, wide, 1), nodata, np.uint16)
        held = rows[rows["value"].notna()]
        cells[held["y"].to_numpy() - at_y, held["x"].to_numpy() - at_x, 0] = np.rint(held["value"].to_numpy(dtype=float)).astype(np.uint16)
        data = encoded_block(cells, ">" if f.big_endian else "<", bool(f.deflate), int(f.predictor))
        return pd.DataFrame({**{k: [v] for k, v in zip(keys, key)}, "row": [int(key[-2])], "col": [int(key[-1])], "data": [data]})

    def whole(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        f = rows.iloc[0]
        height, width = int(f.height), int(f.width)
        order, across = ">" if f.big_endian else "<", -(-width // tile) if f.tiled else 1
        held = dict(zip(zip(rows["row"], rows["col"]), rows["data"]))
        parts = []
        for i in range(-(-height // tile)):
            for j in range(across):
                tall, wide = (tile, tile) if f.tiled else (min(tile, height - i * tile), width)
                empty = np.full((tall, wide, 1), nodata, np.uint16)
                parts.append(held.get((i, j)) or encoded_block(empty, order, bool(f.deflate), int(f.predictor)))
        place = {"west": float(f.west), "north": float(f.north), "epsg": int(f.epsg), "nodata": nodata}
        data = assembled(parts, height, width, np.dtype(np.uint16), tile, tile if f.tiled else None, order, bool(f.deflate), int(f.predictor), **place)
        return pd.DataFrame({**{k: [v] for k, v in zip(keys, key)}, "content": [data]})

    col = F.when(F.col("tiled"), F.floor(F.col("x") / tile)).otherwise(0).cast("int")
    rows = pixels.select(*keys, "y", "x", "value").join(layout, keys).withColumns({"row": F.floor(F.col("y") / tile).cast("int"), "col": col})
    encoded = rows.groupBy(*keys, "row", "col").applyInPandas(block, f"{kinds}, row int, col int, data binary")
    return encoded.join(layout.select(*keys, *form), keys).groupBy(*keys).applyInPandas(whole, f"{kinds}, content binary")
