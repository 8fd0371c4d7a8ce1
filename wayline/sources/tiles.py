"""Tile sources: line features of vector tiles and heights of terrain tiles, one tile per row, read in Arrow-fed
pandas batches; what follows (clipping, joins, classification) is relational."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: varints as integers, everything else as bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def _packed(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        value, at = _varint(data, at)
        out.append(value)
    return out


def _signed(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def _value(data: bytes) -> str | None:
    for number, v in _fields(data):
        if number == 1:
            return v.decode()
        if number in (2, 3):
            return repr(struct.unpack("<f" if number == 2 else "<d", v)[0])
        if number == 4:
            return str(v - (1 << 64) if v >> 63 else v)
        if number in (5, 6, 7):
            return {5: str(v), 6: str(_signed(v)), 7: "true" if v else "false"}[number]
    return None


def _parts(commands: list[int]) -> list[list[tuple[int, int]]]:
    """Lines of a geometry: the cursor runs on from part to part; parts of one point are left out."""
    parts: list[list[tuple[int, int]]] = []
    x = y = i = 0
    while i < len(commands):
        code, count = commands[i] & 7, commands[i] >> 3
        i += 1
        if code == 7:
            if parts and parts[-1]:
                parts[-1].append(parts[-1][0])
            continue
        for _ in range(count):
            x, y = x + _signed(commands[i]), y + _signed(commands[i + 1])
            i += 2
            if code == 1:
                parts.append([])
            parts[-1].append((x, y))
    return [p for p in parts if len(p) > 1]


def line_features(data: bytes, layer: str) -> list[tuple[int, dict[str, str | None], list[list[tuple[int, int]]]]]:
    """(extent, properties, lines) of a layer's line features. Keys and values may follow the features."""
    out = []
    for number, body in _fields(data):
        if number != 3:
            continue
        fields = list(_fields(body))
        if next((v for n, v in fields if n == 1), b"").decode() != layer:
            continue
        keys, values = [v.decode() for n, v in fields if n == 3], [_value(v) for n, v in fields if n == 4]
        extent = next((v for n, v in fields if n == 5), 4096)
        for feature in (dict(_fields(v)) for n, v in fields if n == 2):
            if feature.get(3) == 2:
                tags = _packed(feature.get(2, b""))
                out.append((extent, {keys[k]: values[v] for k, v in zip(tags[::2], tags[1::2])}, _parts(_packed(feature.get(4, b"")))))
    return out


LINES_AT_ONCE = 2048  # lines that a task decodes before it hands them on


def decode_lines(tiles: DataFrame, layer: str) -> DataFrame:
    """(x, y, feature, line, props, coords) of tiles (x, y, data); a damaged tile gives no rows. A task holds one tile's lines
    and up to `LINES_AT_ONCE` of those before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for x, y, data in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), b.column("data")):
                try:
                    found = line_features(data.as_py(), layer) if data.is_valid else []
                except (IndexError, KeyError, UnicodeDecodeError, struct.error):
                    found = []
                for f, (_, props, lines) in enumerate(found):
                    rows += [(x, y, f, i, list(props.items()), [{"x": a, "y": b} for a, b in line]) for i, line in enumerate(lines)]
                    if len(rows) >= LINES_AT_ONCE:
                        yield _lines(rows)
                        rows = []
        if rows:
            yield _lines(rows)

    return tiles.select("x", "y", "data").mapInArrow(run, "x long, y long, feature long, line long, props map<string,string>, coords array<struct<x:long,y:long>>")


_LINES = pa.schema([*[(c, pa.int64()) for c in ("x", "y", "feature", "line")], ("props", pa.map_(pa.string(), pa.string())), ("coords", pa.list_(pa.struct([("x", pa.int64()), ("y", pa.int64())])))])


def _lines(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _LINES.types)], schema=_LINES)


def terrain_heights(tiles: DataFrame, size: int = 256) -> DataFrame:
    """(gx, gy, height) of terrain tiles (x, y, data), data as rows of blue, green, red bytes: metres above sea level
    are red * 256 + green + blue / 256 - 32768. A tile of another size gives no rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for x, y, data in zip(pdf["x"], pdf["y"], pdf["data"]):
                if data is None or len(data) != size * size * 3:
                    continue
                b, g, r = np.frombuffer(bytes(data), np.uint8).reshape(-1, 3).T.astype(float)
                i = np.arange(size * size)
                yield pd.DataFrame({"gx": x * size + i % size, "gy": y * size + i // size, "height": r * 256 + g + b / 256 - 32768})

    return tiles.select("x", "y", "data").mapInPandas(run, "gx long, gy long, height double")


# Writing tiles, and a store of them that reads only what is asked for


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return _number(number << 3) + _number(value)
    return _number(number << 3 | 2) + _number(len(value)) + value


def _unsigned(n: int) -> int:
    return (n << 1) ^ (n >> 63)


def encoded(features: list[tuple[dict[str, str], list[list[tuple[int, int]]]]], layer: str, extent: int = 4096) -> bytes:
    """A tile of one layer with line features (properties as texts, lines); what `line_features` reads."""
    keys: dict[str, int] = {}
    values: dict[str, int] = {}
    body = b""
    for props, lines in features:
        tags = [n for k, v in props.items() if v is not None for n in (keys.setdefault(k, len(keys)), values.setdefault(v, len(values)))]
        geometry, x, y = [], 0, 0
        for line in lines:
            for i, (px, py) in enumerate(line):
                if i < 2:
                    geometry.append(1 << 3 | 1 if i == 0 else len(line) - 1 << 3 | 2)
                geometry += [_unsigned(px - x), _unsigned(py - y)]
                x, y = px, py
        body += _field(2, _field(2, b"".join(map(_number, tags))) + _field(3, 2) + _field(4, b"".join(map(_number, geometry))))
    body = _field(1, layer.encode()) + body + b"".join(_field(3, k.encode()) for k in keys) + b"".join(_field(4, _field(1, v.encode())) for v in values) + _field(5, extent)
    return _field(3, body)


def line_tiles(lines: DataFrame, layer: str, extent: int = 4096) -> DataFrame:
    """Tiles (x, y, data) of lines (x, y, feature, line, props, coords) as `decode_lines` gives them; a task holds a tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: tuple | None = None
        features: dict[int, tuple[dict, list]] = {}
        tile = lambda: pa.RecordBatch.from_arrays([pa.array([own[0]], pa.int64()), pa.array([own[1]], pa.int64()), pa.array([encoded(list(features.values()), layer, extent)], pa.binary())], names=["x", "y", "data"])
        for whole in batches:
            for k in range(0, whole.num_rows, LINES_AT_ONCE):
                b = whole.slice(k, LINES_AT_ONCE)
                for x, y, feature, props, xs, ys in zip(*[b.column(c).to_pylist() for c in ("x", "y", "feature", "props", "xs", "ys")]):
                    if (x, y) != own:
                        if own is not None:
                            yield tile()
                        own, features = (x, y), {}
                    features.setdefault(feature, (dict(props or ()), []))[1].append(list(zip(xs, ys)))
        if own is not None:
            yield tile()

    known = lines.dropna(subset=["x", "y", "feature", "line", "coords"])
    flat = known.select("x", "y", "feature", "line", "props", *[F.col(f"coords.{c}").cast("array<long>").alias(f"{c}s") for c in "xy"])
    return flat.repartition(F.xxhash64("x", "y")).sortWithinPartitions("x", "y", "feature", "line").mapInArrow(run, "x long, y long, data binary")


def terrain_tiles(heights: DataFrame, size: int = 256) -> DataFrame:
    """Tiles (x, y, data) of heights (gx, gy, height) as `terrain_heights` reads them; tiles that lack a height are left out.
    Heights are kept to 1 / 256 of a metre, from -32768 to 32767 metres."""
    h = heights.dropna(subset=["gx", "gy", "height"]).withColumns({"x": F.floor(F.col("gx") / size), "y": F.floor(F.col("gy") / size)})
    code = F.least(F.greatest(F.round((F.col("height") + 32768) * 256).cast("long"), F.lit(0)), F.lit((1 << 24) - 1))
    h = h.groupBy("x", "y", F.pmod("gy", F.lit(size)).alias("r"), F.pmod("gx", F.lit(size)).alias("c")).agg(F.max(code).alias("v"))
    three = F.concat(*[F.lpad(F.hex(F.shiftright("v", s).bitwiseAND(255)), 2, "0") for s in (0, 8, 16)])
    cells = h.groupBy("x", "y").agg(F.array_sort(F.collect_list(F.struct("r", "c", three.alias("b")))).alias("l")).where(F.size("l") == size * size)
    return cells.select("x", "y", F.unhex(F.array_join(F.transform("l", lambda q: q["b"]), "")).alias("data"))


BLOCK = 16  # columns of tiles that share a folder
ROWS = 256  # rows of tiles that share a file of it


def store(tiles: DataFrame, path: str, zoom: int) -> None:
    """Tiles (x, y, data) written by zoom and by blocks of columns, sorted by row within them. A block's bands of rows are
    dealt to many tasks."""
    t = tiles.withColumns({"zoom": F.lit(zoom), "block": F.floor(F.col("x") / BLOCK)})
    t.repartition("block", F.floor(F.col("y") / ROWS)).sortWithinPartitions("block", "y", "x").write.mode("append").partitionBy("zoom", "block").parquet(path)


def stored(tiles: DataFrame, zoom: int, west: int, east: int, north: int, south: int) -> DataFrame:
    """The tiles (x, y, data) of a store that lie in a box, both ends included. Folders of other zooms and blocks are not
    listed, and row groups of other rows are not read."""
    inside = (F.col("zoom") == zoom) & F.col("block").between(west // BLOCK, east // BLOCK) & F.col("x").between(west, east) & F.col("y").between(north, south)
    return tiles.where(inside).select("x", "y", "data")
