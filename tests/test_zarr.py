"""Zarr stores of both formats against the arrays that they hold."""

import gzip
import json
import zlib
from datetime import datetime, timedelta

import numpy as np
import pytest
import zstandard

from sunloom.sources import readers, zarr


def write_two(path, name, x, chunks, dims, codec=None, attrs=(), skip=(), order="C", separator="."):
    folder = path / name
    folder.mkdir(parents=True)
    compressor = {"zlib": {"id": "zlib", "level": 1}, "zstd": {"id": "zstd", "level": 1}, None: None}[codec]
    folder.joinpath(".zarray").write_text(json.dumps({"zarr_format": 2, "shape": x.shape, "chunks": chunks, "dtype": x.dtype.str, "order": order, "fill_value": "NaN" if x.dtype.kind == "f" else 0, "filters": None, "compressor": compressor, "dimension_separator": separator}))
    folder.joinpath(".zattrs").write_text(json.dumps({"_ARRAY_DIMENSIONS": dims, **dict(attrs)}))
    grid = [-(-n // c) for n, c in zip(x.shape, chunks)]
    for place in np.ndindex(*grid):
        if place in skip:
            continue
        full = np.zeros(chunks, x.dtype)
        part = x[tuple(slice(p * c, (p + 1) * c) for p, c in zip(place, chunks))]
        full[tuple(slice(0, n) for n in part.shape)] = part
        data = full.tobytes(order)
        data = zlib.compress(data) if codec == "zlib" else zstandard.compress(data) if codec == "zstd" else data
        file = folder.joinpath(separator.join(map(str, place)))
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(data)


def write_three(path, name, x, chunks, dims):
    folder = path / name
    folder.mkdir(parents=True)
    folder.joinpath("zarr.json").write_text(json.dumps({"zarr_format": 3, "node_type": "array", "shape": x.shape, "data_type": str(x.dtype), "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunks}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "gzip", "configuration": {"level": 1}}], "fill_value": 0, "dimension_names": dims, "attributes": {}}))
    for place in np.ndindex(*[-(-n // c) for n, c in zip(x.shape, chunks)]):
        full = np.zeros(chunks, x.dtype)
        part = x[tuple(slice(p * c, (p + 1) * c) for p, c in zip(place, chunks))]
        full[tuple(slice(0, n) for n in part.shape)] = part
        file = folder.joinpath("c", *map(str, place))
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(gzip.compress(full.tobytes()))


@pytest.mark.parametrize(("codec", "order", "separator"), [(None, "C", "."), ("zlib", "F", "/"), ("zstd", "C", ".")])
def test_format_two(spark, tmp_path, codec, order, separator):
    x = np.random.default_rng(0).random((5, 4, 7)).astype(np.float32)
    store = tmp_path / "a.zarr"
    write_two(store, "t2m", x, (2, 4, 3), ["time", "y", "x"], codec, skip=[(1, 0, 2)], order=order, separator=separator)
    write_two(store, "time", np.arange(5, dtype="<i8") * 3, (5,), ["time"], attrs={"units": "hours since 2023-01-01 00:00:00"})
    write_two(store, "y", np.array([3.0, 2.0, 1.0, 0.0]), (3,), ["y"])
    got = {(r["time"], r["y"], r["x"]): r["value"] for r in zarr.read_store(spark, str(store)).collect()}
    assert len(got) == x.size
    for i, j, k in np.ndindex(*x.shape):
        v = got[datetime(2023, 1, 1) + timedelta(hours=3 * i), 3.0 - j, k]
        assert np.isnan(v) if i in (2, 3) and k == 6 else v == x[i, j, k]


def test_format_three_and_concatenation(spark, tmp_path):
    x = np.arange(24, dtype="int32").reshape(4, 6)
    for n in (1, 2):
        write_three(tmp_path / f"s{n}.zarr", "v", x + 100 * n, (3, 4), ["step", "x"])
        write_three(tmp_path / f"s{n}.zarr", "step", np.arange(4, dtype="int64") + 4 * n, (4,), ["step"])
        write_three(tmp_path / f"s{n}.zarr", "x", np.arange(6) * 1.0 + 1e-9 * n, (6,), ["x"])
    with pytest.warns(UserWarning, match="other coordinates"):
        out = zarr.open_stores(spark, str(tmp_path / "s*.zarr"), "v", same=["x"])
    got = {(r["step"], round(r["x"])): r["value"] for r in out.collect()}
    assert len(got) == 48 and all(got[4 * n + i, j] == x[i, j] + 100 * n for n in (1, 2) for i, j in np.ndindex(4, 6))
    assert out.select("x").distinct().count() == 6
    with pytest.raises(FileNotFoundError):
        zarr.open_stores(spark, str(tmp_path / "none*.zarr"))
    with pytest.raises(KeyError):
        zarr.read_store(spark, str(tmp_path / "s1.zarr"), "w")


def test_refusals(spark, tmp_path):
    x = np.zeros((2, 2), "float32")
    write_two(tmp_path / "a", "v", x, (2, 2), ["a", "b"], attrs={"scale_factor": 0.1})
    with pytest.raises(ValueError, match="scale_factor"):
        zarr.read_store(spark, str(tmp_path / "a"))
    write_two(tmp_path / "b", "v", x, (2, 2), ["a", "b"])
    write_two(tmp_path / "b", "w", x, (2, 2), ["a", "b"])
    with pytest.raises(ValueError, match="one variable"):
        zarr.read_store(spark, str(tmp_path / "b"))
    meta = tmp_path / "b" / "v" / ".zarray"
    meta.write_text(meta.read_text().replace('"compressor": null', '"compressor": {"id": "blosc"}'))
    with pytest.raises(NotImplementedError, match="blosc"):
        zarr.read_store(spark, str(tmp_path / "b"), "v")


def test_satellite_from_zarr(spark, tmp_path):
    x = np.random.default_rng(1).random((2, 1, 3, 3)).astype(np.float32)
    store = tmp_path / "sat.zarr"
    write_two(store, "data", x, (1, 1, 3, 3), ["time", "variable", "y_geostationary", "x_geostationary"])
    write_two(store, "time", np.arange(2, dtype="<i8"), (2,), ["time"], attrs={"units": "minutes since 2023-01-01"})
    write_two(store, "variable", np.array(["IR_016"]), (1,), ["variable"])
    write_two(store, "x_geostationary", np.arange(3.0)[::-1].copy(), (3,), ["x_geostationary"])
    write_two(store, "y_geostationary", np.arange(3.0), (3,), ["y_geostationary"])
    out = readers.open_satellite(spark, str(store))
    assert {(r["time_utc"], r["channel"]) for r in out.select("time_utc", "channel").distinct().collect()} == {(datetime(2023, 1, 1, 0, k), "IR_016") for k in range(2)}
    assert out.count() == 18
