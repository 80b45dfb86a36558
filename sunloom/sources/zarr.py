"""Zarr stores (formats 2 and 3) as long tables: one row per cell, one task's work per chunk.

Axes are read by the driver (a grid has as many coordinates as pixels along a side); chunks are listed as a table, met
with their files by name, and decoded on the executors.  Any file system that Spark reads will do.  Codecs: none, zlib,
gzip, bz2, lzma, zstd, and whatever `numcodecs` knows where it is installed.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import readers

#: Cells of one Arrow batch.
_CELLS = 1 << 20
_UNITS = {"nanosecond": 1e-3, "microsecond": 1, "millisecond": 1e3, "second": 1e6, "minute": 6e7, "hour": 3.6e9, "day": 8.64e10}


def _system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _fetch(spark: SparkSession, path: str) -> bytes | None:
    """A small file's bytes; None if it isn't there."""
    fs, p = _system(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def expand(spark: SparkSession, paths: str | Sequence[str]) -> list[str]:
    """The stores that paths and globs name, sorted; none is an error."""
    found: set[str] = set()
    for path in [paths] if isinstance(paths, str) else paths:
        fs, p = _system(spark, path)
        found |= {str(s.getPath().toString()) for s in fs.globStatus(p) or ()}
    if not found:
        raise FileNotFoundError(f"no store at {paths}")
    return sorted(found)


def decoder(codecs: list[dict]) -> Callable[[bytes], bytes]:
    """What undoes a chain of bytes-to-bytes codecs; an unknown one is an error."""
    steps: list[Callable[[bytes], bytes]] = []
    for c in reversed(codecs):
        name = c.get("id") or c.get("name")
        if name in ("zlib", "gzip"):
            import zlib

            steps.append(lambda b: zlib.decompress(b, 47))  # 47: either header
        elif name == "bz2":
            import bz2

            steps.append(bz2.decompress)
        elif name == "lzma":
            import lzma

            steps.append(lzma.decompress)
        elif name == "zstd":
            import zstandard

            steps.append(lambda b: zstandard.ZstdDecompressor().decompressobj().decompress(b))
        elif name != "crc32c":
            try:
                import numcodecs
            except ImportError:
                raise NotImplementedError(f"codec {name} needs numcodecs, which is not installed") from None
            steps.append(numcodecs.get_codec(c if "id" in c else {"id": name, **c.get("configuration", {})}).decode)
        else:
            steps.append(lambda b: b[:-4])

    def run(data: bytes) -> bytes:
        for step in steps:
            data = step(data)
        return bytes(data)

    return run


class Array:
    """One array's metadata, of either format."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.name = path, path.rstrip("/").rpartition("/")[2]
        three, two = _fetch(spark, f"{path}/zarr.json"), _fetch(spark, f"{path}/.zarray")
        if three is not None:
            m = json.loads(three)
            if m.get("node_type") != "array":
                raise ValueError(f"{path} is no array")
            self.attrs, self.dims = m.get("attributes", {}), list(m.get("dimension_names") or [])
            self.chunks, self.order = tuple(m["chunk_grid"]["configuration"]["chunk_shape"]), "C"
            key = m.get("chunk_key_encoding", {"name": "default"})
            separator = key.get("configuration", {}).get("separator", "/" if key["name"] == "default" else ".")
            self.prefix, self.separator = ("c" + separator if key["name"] == "default" else ""), separator
            little, self.codecs = "<", []
            for c in m.get("codecs", []):
                if c["name"] == "bytes":
                    little = ">" if c.get("configuration", {}).get("endian") == "big" else "<"
                elif c["name"] in ("sharding_indexed", "transpose"):
                    raise NotImplementedError(f"{path}: codec {c['name']}")
                else:
                    self.codecs.append(c)
            self.dtype = np.dtype(m["data_type"]).newbyteorder(little)
        elif two is not None:
            m = json.loads(two)
            attrs = _fetch(spark, f"{path}/.zattrs")
            self.attrs = json.loads(attrs) if attrs else {}
            self.dims = list(self.attrs.get("_ARRAY_DIMENSIONS", []))
            self.chunks, self.order, self.dtype = tuple(m["chunks"]), m["order"], np.dtype(m["dtype"])
            self.prefix, self.separator = "", m.get("dimension_separator", ".")
            self.codecs = [*(m.get("filters") or []), *([m["compressor"]] if m.get("compressor") else [])]
        else:
            raise FileNotFoundError(f"no array at {path}")
        self.shape, fill = tuple(m["shape"]), m.get("fill_value")
        self.fill = float(fill) if isinstance(fill, str) and re.fullmatch(r"-?(NaN|Infinity)", fill) else (math.nan if self.dtype.kind == "f" and fill is None else fill or 0)
        decoder(self.codecs)  # an unknown codec is told before anything is read

    @property
    def grid(self) -> tuple[int, ...]:
        """Chunks along each dimension."""
        return tuple(-(-n // c) for n, c in zip(self.shape, self.chunks, strict=True))

    def key(self, place: Sequence[int]) -> str:
        return (self.prefix + self.separator.join(map(str, place))) if place else self.prefix.rstrip(self.separator) or "0"

    def cells(self, data: bytes | None) -> np.ndarray:
        """A chunk's values; those of a chunk without a file are the fill value."""
        if data is None:
            return np.full(self.chunks, self.fill, self.dtype)
        return np.frombuffer(decoder(self.codecs)(data), self.dtype)[: math.prod(self.chunks)].reshape(self.chunks, order=self.order)

    def whole(self, spark: SparkSession) -> np.ndarray:
        """All values of a one-dimensional array (an axis), times as microseconds since 1970."""
        parts = [self.cells(_fetch(spark, f"{self.path}/{self.key((k,))}")) for k in range(self.grid[0])]
        return self.times(np.concatenate(parts)[: self.shape[0]]) if parts else np.zeros(0)

    def times(self, values: np.ndarray) -> np.ndarray:
        if self.dtype.kind == "M":
            return values.astype("datetime64[us]")
        if self.dtype.kind == "m":
            return values.astype("timedelta64[us]").astype(np.int64) // 60_000_000
        units = re.fullmatch(r"(\w+?)s?(?: since (.+))?", str(self.attrs.get("units", "")))
        if not units or units[1] not in _UNITS:
            return values
        micros = np.round(values.astype(np.float64) * _UNITS[units[1]]).astype(np.int64)
        if units[2]:
            start = datetime.fromisoformat(units[2].strip().replace("T", " ").split("+")[0].rstrip("Z"))
            return (np.datetime64(start, "us") + micros).astype("datetime64[us]")
        return micros // 60_000_000  # a length of time, in minutes


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _system(spark, path)
    return sorted(str(s.getPath().toString()) for s in fs.listStatus(p) if s.isDirectory())


def _type(values: np.ndarray) -> tuple[str, pa.DataType]:
    kind = values.dtype.kind
    if kind == "M":
        return "timestamp_ntz", pa.timestamp("us")
    return ("double", pa.float64()) if kind == "f" else ("string", pa.string()) if kind in "USO" else ("long", pa.int64())


def read_store(spark: SparkSession, path: str, variable: str | None = None) -> DataFrame:
    """(dimensions ..., value): every cell of a store's variable, with its coordinates.

    variable may be left out if the store has one array that is no axis.  Arrays that are stored scaled (scale_factor,
    add_offset) are refused: their values would be read as they stand.  A dimension without an axis counts from 0.  A
    chunk without a file has the fill value in all its cells.
    """
    arrays = {}
    for child in _children(spark, path):
        try:
            a = Array(spark, child)
        except (FileNotFoundError, ValueError):
            continue
        arrays[a.name] = a
    data = {n: a for n, a in arrays.items() if a.dims != [n]}
    if variable is None:
        data = {n: a for n, a in data.items() if len(a.dims) == max((len(x.dims) for x in data.values()), default=0)}
        if len(data) != 1:
            raise ValueError(f"{path}: expected one variable, found {sorted(data)}")
        variable = next(iter(data))
    if variable not in arrays:
        raise KeyError(f"{path}: variable {variable} is missing")
    a = arrays[variable]
    if scaled := [k for k in ("scale_factor", "add_offset") if k in a.attrs]:
        raise ValueError(f"{path}: {variable} is stored with {scaled}")
    dims = a.dims or [f"dim_{k}" for k in range(len(a.shape))]
    axes = [arrays[d].whole(spark) if d in arrays and arrays[d].dims == [d] else np.arange(n) for d, n in zip(dims, a.shape, strict=True)]
    axes = [x.astype(str) if x.dtype.kind in "SO" else x for x in axes]
    kinds = [_type(x) for x in axes]
    grid, total = a.grid, math.prod(a.grid)
    folder = a.path.rstrip("/")
    # Every chunk's place, and the files that are there, met by their name inside the array's folder.
    place = [F.pmod(F.floor(F.col("id") / math.prod(grid[k + 1 :])), F.lit(grid[k])).cast("string") for k in range(len(grid))]
    wanted = spark.range(total).select("id", F.concat(F.lit(a.prefix), F.concat_ws(a.separator, *place)).alias("key"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.substring_index("path", f"/{a.name}/", -1)
    met = wanted.join(files.select(name.alias("key"), "content"), "key", "left").select("id", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                place = np.unravel_index(at, grid)
                low = [int(p) * c for p, c in zip(place, a.chunks, strict=True)]
                size = [min(c, n - x) for c, n, x in zip(a.chunks, a.shape, low, strict=True)]
                cells = a.cells(content.as_py())[tuple(slice(0, s) for s in size)].ravel()
                for k in range(0, len(cells), _CELLS):
                    index = np.unravel_index(np.arange(k, min(k + _CELLS, len(cells))), size)
                    columns = [pa.array(x[i + o], t) for x, i, o, (_, t) in zip(axes, index, low, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(cells[k : k + _CELLS].astype(np.float64))], names=[*dims, "value"])

    schema = ", ".join([f"`{d}` {k}" for d, (k, _) in zip(dims, kinds, strict=True)] + ["value double"])
    return met.mapInArrow(run, schema)


def open_stores(spark: SparkSession, paths: str | Sequence[str], variable: str | None = None, same: Sequence[str] = ()) -> DataFrame:
    """The cells of one or several stores (paths or globs) as one table.

    same: dimensions that all stores share; where a store's coordinates differ from the first one's, they are reported
    and replaced by those (readers.concat).
    """
    return readers.concat([read_store(spark, p, variable) for p in expand(spark, paths)], same)
