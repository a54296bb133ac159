"""Cached embedding blocks: NPY files of (height, width, dimensions), a file for each place and year.

A header states type, order and shape; the values behind it become one
ARRAY<FLOAT> a pixel, a row of pixels at a time. A file of another shape is an
error that names it, a block on another grid is resized to the nearest pixel,
and a place and year without a file has one row without pixels.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"\x93NUMPY"  # fixed value


def header(data: memoryview) -> tuple[np.dtype, bool, tuple[int, ...], int]:
    """(type, Fortran order, shape, where the values begin)."""
    if bytes(data[:6]) != MAGIC:
        raise ValueError("not an NPY file")
    wide = data[6] >= 2
    size = int.from_bytes(data[8 : 12 if wide else 10], "little")
    begin = 12 if wide else 10
    said = ast.literal_eval(bytes(data[begin : begin + size]).decode("latin-1"))
    return np.dtype(said["descr"]), bool(said["fortran_order"]), tuple(said["shape"]), begin + size


def pixels(data: memoryview, name: str, dims: int, height: int | None = None, width: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(y, (width, dims) as 32-bit floats) of each row of the block on a grid of that size."""
    kind, fortran, shape, begin = header(data)
    if len(shape) != 3 or shape[2] != dims or kind.kind != "f":
        raise ValueError(f"{name}: expected floats of (height, width, {dims}), got {kind} of {shape}")
    block = np.frombuffer(data[begin:], kind, count=int(np.prod(shape))).reshape(shape, order="F" if fortran else "C")
    h, w = height or shape[0], width or shape[1]
    ys = np.rint(np.linspace(0, shape[0] - 1, h)).astype(int)
    xs = np.rint(np.linspace(0, shape[1] - 1, w)).astype(int)
    for y, source in enumerate(ys):
        yield y, block[source][xs].astype(np.float32)


def decoded(files: DataFrame, keys: list[str], dims: int) -> DataFrame:
    """``keys``, y, x and embedding of every pixel of the blocks (content, height, width); content NULL gives one row of NULLs.

    A pixel with a value that is no finite number has the embedding NULL.
    """
    schema = ", ".join(f"{k} {files.schema[k].dataType.simpleString()}" for k in keys) + ", y int, x int, embedding array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                heads, content = row.columns[: len(keys)], row.column(len(keys))[0]
                if not content.is_valid:
                    nothing = [pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.list_(pa.float32()))]
                    yield pa.RecordBatch.from_arrays([*heads, *nothing], names=[*keys, "y", "x", "embedding"])
                    continue
                height, width = (row.column(len(keys) + j)[0].as_py() for j in (1, 2))
                name = " ".join(str(c[0].as_py()) for c in heads)
                for y, values in pixels(memoryview(content.as_buffer()), name, dims, height, width):
                    n = len(values)
                    good = np.isfinite(values).all(axis=1)
                    ends = pa.array(np.arange(0, n * dims + 1, dims, dtype=np.int32))
                    lists = pa.ListArray.from_arrays(ends, pa.array(values.ravel()), mask=pa.array(~good))
                    same = pa.array(np.zeros(n, np.int64))
                    cols = [*(c.take(same) for c in heads), pa.array(np.full(n, y, np.int32)), pa.array(np.arange(n, dtype=np.int32)), lists]
                    yield pa.RecordBatch.from_arrays(cols, names=[*keys, "y", "x", "embedding"])

    return files.select(*keys, "content", F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width")).mapInArrow(run, schema)


def cached_blocks(spark: SparkSession, root: str, wanted: DataFrame, dims: int = 64) -> DataFrame:
    """city, year, y, x and embedding for ``wanted`` (city, year, height, width) from ``<root>/<city>_<year>.npy``.

    Only the wanted files are read; one that is not there gives NULLs.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(root)
    named = found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    asked = wanted.withColumn("name", F.concat("city", F.lit("_"), F.col("year").cast("string"), F.lit(".npy")))
    return decoded(asked.join(named, "name", "left"), ["city", "year"], dims)


def encoded(values: np.ndarray) -> bytes:
    """An NPY file (version 1) of an array in C order."""
    text = f"{{'descr': '{values.dtype.str}', 'fortran_order': False, 'shape': {values.shape}, }}"
    text += " " * (-(len(text) + 11) % 64) + "\n"
    return MAGIC + b"\x01\x00" + len(text).to_bytes(2, "little") + text.encode() + np.ascontiguousarray(values).tobytes()


def blobs(vectors: DataFrame, keys: list[str], height: int, width: int, dims: int) -> DataFrame:
    """``keys``, content, height and width: a block for each group of vectors (keys, y, x, embedding); cells without one are NaN."""
    kinds = ", ".join(f"{k} {vectors.schema[k].dataType.simpleString()}" for k in keys)

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        block = np.full((height, width, dims), np.nan, np.float32)
        block[rows["y"].to_numpy(), rows["x"].to_numpy()] = np.stack(rows["embedding"].to_numpy())
        return pd.DataFrame({**{k: [v] for k, v in zip(keys, key)}, "content": [encoded(block)], "height": [height], "width": [width]})

    return vectors.select(*keys, "y", "x", "embedding").groupBy(*keys).applyInPandas(one, f"{kinds}, content binary, height int, width int")
