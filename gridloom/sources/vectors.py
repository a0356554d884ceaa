"""Polygon files: shapefiles as a Spark data source, and well-known binary in columns.

Both give rings as rows (feature, part, seq, x, y), the form that ``operators.polygons`` joins.  A shapefile's index tells
where its records lie, so a partition is a range of records fetched at once; a folder may hold any number of files.
Attributes come from the table beside it.  Records are numbered over all files in the order of their names.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from gridloom.sources.raster import opened

#: Bytes of records in a partition, and in a file that a task writes (it is held until its bounds are known).
PARTITION_BYTES, FILE_BYTES = 1 << 24, 1 << 26
# The format's file code and shape types (polygons; with measures; with heights), and those of well-known binary.
FILE_CODE, VERSION, POLYGON, POLYGON_M, POLYGON_Z = 9994, 1000, 5, 25, 15
WKB_POLYGON, WKB_MULTIPOLYGON, WKB_COLLECTION = 3, 6, 7


def layers_of(path: str) -> list[str]:
    """Shapefiles below ``path`` (or itself), without their suffix."""
    store, at = opened(path)
    if store.get_file_info(at).type == fs.FileType.File:
        return [at.removesuffix(".shp")]
    return sorted(f.path.removesuffix(".shp") for f in store.get_file_info(fs.FileSelector(at)) if f.path.endswith(".shp"))


def whole(store: fs.FileSystem, file: str) -> bytes:
    with store.open_input_file(file) as f:
        return f.read()


def record_count(store: fs.FileSystem, layer: str) -> int:
    """Records of a file by the size of its index: eight bytes a record."""
    return (store.get_file_info(f"{layer}.shx").size - 100) // 8


def record_places(store: fs.FileSystem, layer: str, first: int, until: int) -> np.ndarray:
    """(offset, bytes) of the records from ``first`` to before ``until``, from the index."""
    with store.open_input_file(f"{layer}.shx") as f:
        f.seek(100 + 8 * first)
        own = np.frombuffer(f.read(8 * (until - first)), ">i4").reshape(-1, 2).astype(np.int64) * 2
    return own + np.array([0, 8])


def ring_columns(records: list[tuple[int, list[np.ndarray]]]) -> list[pa.Array]:
    """Arrays feature, part, seq, x, y of (feature, its rings)."""
    rings = [(f, p, r) for f, own in records for p, r in enumerate(own) if len(r)]
    sizes = np.array([len(r) for _, _, r in rings], np.int64)
    points = np.concatenate([np.empty((0, 2)), *(r for _, _, r in rings)])
    seq = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    each = lambda i: np.repeat(np.array([r[i] for r in rings], np.int64), sizes)
    return [pa.array(each(0)), pa.array(each(1).astype(np.int32)), pa.array(seq.astype(np.int32)), pa.array(points[:, 0].copy()), pa.array(points[:, 1].copy())]


RING_NAMES = ["feature", "part", "seq", "x", "y"]


def opened_rings(points: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Rings without the repetition of their first vertex at the end."""
    out = []
    for a, b in zip(starts, [*starts[1:], len(points)]):
        ring = points[a:b]
        out.append(ring[:-1] if len(ring) > 1 and (ring[0] == ring[-1]).all() else ring)
    return out


def shape_rings(content: bytes) -> list[np.ndarray]:
    """Rings of one record; a null shape has none."""
    kind = struct.unpack("<i", content[:4])[0]
    if kind == 0:
        return []
    if kind not in (POLYGON, POLYGON_M, POLYGON_Z):
        raise ValueError(f"shape type {kind} is no polygon")
    parts, points = struct.unpack("<2i", content[36:44])
    starts = np.frombuffer(content, "<i4", parts, 44)
    return opened_rings(np.frombuffer(content, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2), starts)


@dataclass
class Records(InputPartition):
    layer: str
    number: int  # of the first record over all files
    first: int  # of the first record in its file
    until: int


class ShapeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.most = options["path"], int(options.get("partitionBytes", PARTITION_BYTES))

    def partitions(self) -> list[Records]:
        """Ranges of records by the files' sizes alone; tasks read their part of the index."""
        store, _ = opened(self.path)
        out, number = [], 0
        for layer in layers_of(self.path):
            n = record_count(store, layer)
            step = max(1, n * self.most // max(1, store.get_file_info(f"{layer}.shp").size))
            out += [Records(layer, number + a, a, min(n, a + step)) for a in range(0, n, step)]
            number += n
        return out

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing to read is one empty task
            return
        store, _ = opened(self.path)
        places = record_places(store, partition.layer, partition.first, partition.until)
        ends = places.sum(axis=1)
        with store.open_input_file(f"{partition.layer}.shp") as f:
            at = 0
            while at < len(places):  # long records are fetched a few at a time
                start = int(places[at, 0])
                n = max(1, int(np.searchsorted(ends[at:], start + self.most, side="right")))
                f.seek(start)
                data = f.read(int(ends[at + n - 1]) - start)
                held, size = [], 0
                for i in range(at, at + n):
                    rings = shape_rings(data[places[i, 0] - start + 8 : ends[i] - start])
                    held.append((partition.number + i, rings))
                    size += sum(map(len, rings))
                    if size > 1 << 16:
                        yield pa.RecordBatch.from_arrays(ring_columns(held), RING_NAMES)
                        held, size = [], 0
                yield pa.RecordBatch.from_arrays(ring_columns(held), RING_NAMES)
                at += n


@dataclass
class Shapes(WriterCommitMessage):
    layers: list[str]


class ShapeWriter(DataSourceArrowWriter):
    """Rows (feature, rings: array of arrays of (x, y)); a task writes files of its own, with the feature in the table beside."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.overwrite, self.most = options["path"], overwrite, int(options.get("fileBytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Shapes:
        store, at = opened(self.path)
        store.create_dir(at, recursive=True)
        layers: list[str] = []
        shapes, index, keys, number = bytearray(), bytearray(), bytearray(), 0
        low, high = np.full(2, np.inf), np.full(2, -np.inf)

        def put() -> None:
            nonlocal shapes, index, keys, number, low, high
            if number:
                head = lambda words: struct.pack(">7i2i", FILE_CODE, 0, 0, 0, 0, 0, words, 0, 0)[:28] + struct.pack("<2i8d", VERSION, POLYGON, *low, *high, 0, 0, 0, 0)
                table = struct.pack("<4BIHH20x", 3, 100, 1, 1, number, 65, 21) + struct.pack("<11sc4xBB14x", b"feature", b"N", 20, 0) + b"\r"
                layer = f"{at}/.shapes-{uuid.uuid4().hex}"
                for suffix, parts in (("shp", (head(50 + len(shapes) // 2), shapes)), ("shx", (head(50 + len(index) // 2), index)), ("dbf", (table, keys, b"\x1a"))):
                    with store.open_output_stream(f"{layer}.{suffix}.part") as f:
                        for part in parts:
                            f.write(part)
                layers.append(layer)
            shapes, index, keys, number = bytearray(), bytearray(), bytearray(), 0
            low, high = np.full(2, np.inf), np.full(2, -np.inf)

        for batch in iterator:
            for key, rings in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                closed = [np.array([(p["x"], p["y"]) for p in [*r, r[0]]]) for r in rings if r]
                points = np.concatenate(closed)
                box = points.min(0), points.max(0)
                starts = np.cumsum([0, *map(len, closed[:-1])])
                content = struct.pack("<i4d2i", POLYGON, *box[0], *box[1], len(closed), len(points)) + starts.astype("<i4").tobytes() + points.astype("<f8").tobytes()
                index += struct.pack(">2i", 50 + len(shapes) // 2, len(content) // 2)
                number += 1
                shapes += struct.pack(">2i", number, len(content) // 2) + content
                keys += b" " + str(key).rjust(20).encode()
                low, high = np.minimum(low, box[0]), np.maximum(high, box[1])
                if len(shapes) + 100 >= self.most:
                    put()
        put()
        return Shapes(layers)

    def commit(self, messages) -> None:
        store, at = opened(self.path)
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
                if old.path.endswith((".shp", ".shx", ".dbf")):
                    store.delete_file(old.path)
        for layer in (x for m in messages if m for x in m.layers):
            folder, name = layer.rsplit("/", 1)
            for suffix in ("shx", "dbf", "shp"):
                store.move(f"{layer}.{suffix}.part", f"{folder}/{name.removeprefix('.')}.{suffix}")

    def abort(self, messages) -> None:
        store, _ = opened(self.path)
        for layer in (x for m in messages if m for x in m.layers):
            for suffix in ("shx", "dbf", "shp"):
                store.delete_file(f"{layer}.{suffix}.part")


class ShapeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gridloom_shapes"

    def schema(self) -> str:
        return "feature long, part int, seq int, x double, y double"

    def reader(self, schema) -> ShapeReader:
        return ShapeReader(self.options)

    def writer(self, schema, overwrite: bool) -> ShapeWriter:
        return ShapeWriter(self.options, overwrite)


def read_shapes(spark: SparkSession, path: str, **options) -> DataFrame:
    """(feature, part, seq, x, y) of all polygons of a shapefile or a folder of them; feature is the record's number from 0."""
    spark.dataSource.register(ShapeSource)
    return spark.read.format("gridloom_shapes").options(**options).load(path)


def write_shapes(vertices: DataFrame, path: str, **options) -> None:
    """Rings (feature, part, seq, x, y) as shapefiles, a few for each task; ``shape_attributes`` gives the features back."""
    vertices.sparkSession.dataSource.register(ShapeSource)
    point = F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    ring = vertices.groupBy("feature", "part").agg(F.array_sort(F.collect_list(F.struct("seq", point.alias("p")))).alias("r"))
    shapes = ring.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("part", F.col("r.p").alias("r")))).alias("rings"))
    shapes.select(F.col("feature").cast("long").alias("feature"), F.col("rings.r").alias("rings")).write.format("gridloom_shapes").options(**options).mode("overwrite").save(path)


def table_fields(head: bytes) -> tuple[int, int, int, list[tuple[str, str, int, int]]]:
    """(records, where they begin, bytes of each, fields (name, kind, place in the record, bytes)) of an attribute table's head."""
    records, begin, size = struct.unpack("<IHH", head[4:12])
    out, at, place = [], 32, 1
    while head[at : at + 1] not in (b"\r", b""):
        name, kind, width = head[at : at + 11].split(b"\0")[0].decode("latin-1"), chr(head[at + 11]), head[at + 16]
        out.append((name, kind, place, width))
        at, place = at + 32, place + width
    return records, begin, size, out


def shape_attributes(spark: SparkSession, path: str) -> DataFrame:
    """(feature, name, value) of every attribute of every record, as text; blanks are null.

    Records have one width, so tasks read ranges of them; the files' heads alone are read while the plan is made.
    """
    store, _ = opened(path)
    ranges, number = [], 0
    for layer in layers_of(path):
        with store.open_input_file(f"{layer}.dbf") as f:
            begin = struct.unpack("<H", f.read(12)[8:10])[0]
            f.seek(0)
            records, _, size, _ = table_fields(f.read(begin))
        step = max(1, PARTITION_BYTES // size)
        ranges += [(layer, number + a, a, min(records, a + step)) for a in range(0, records, step)]
        number += records

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = opened(path)
        for batch in batches:
            for layer, first, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                with own.open_input_file(f"{layer}.dbf") as f:
                    begin = struct.unpack("<H", f.read(12)[8:10])[0]
                    f.seek(0)
                    _, _, size, fields = table_fields(f.read(begin))
                    f.seek(begin + a * size)
                    data = np.frombuffer(f.read((b - a) * size), np.uint8).reshape(-1, size)
                for name, _, place, width in fields:
                    text = [bytes(v).decode("utf-8", "replace").strip(" \0") or None for v in data[:, place : place + width]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + b - a)), pa.array([name] * (b - a)), pa.array(text, pa.string())], ["feature", "name", "value"])

    if not ranges:
        return spark.createDataFrame([], "feature long, name string, value string")
    rows = spark.createDataFrame(ranges, "layer string, first long, a long, b long")
    return rows.repartition(len(ranges)).mapInArrow(run, "feature long, name string, value string")


def layer_profile(spark: SparkSession, path: str) -> DataFrame:
    """(layer, records, x_min, y_min, x_max, y_max, crs): what heads and projection files state, a row a file."""
    store, _ = opened(path)
    out = []
    for layer in layers_of(path):
        with store.open_input_file(f"{layer}.shp") as f:
            box = struct.unpack("<4d", f.read(68)[36:68])
        crs = whole(store, f"{layer}.prj").decode("utf-8", "replace") if store.get_file_info(f"{layer}.prj").type == fs.FileType.File else None
        out.append((layer.rsplit("/", 1)[-1], record_count(store, layer), *box, crs))
    return spark.createDataFrame(out, "layer string, records long, x_min double, y_min double, x_max double, y_max double, crs string")


def wkb_rings(data: bytes) -> list[np.ndarray]:
    """Rings of a polygon, several polygons or a collection of them; heights, measures and reference numbers are skipped."""
    rings: list[np.ndarray] = []

    def shape(at: int) -> int:
        order = "<" if data[at] else ">"
        kind = struct.unpack_from(f"{order}I", data, at + 1)[0]
        at += 5
        if kind & 0x20000000:
            at += 4
        extra = bool(kind & 0x80000000) + bool(kind & 0x40000000)
        kind &= 0x0FFFFFFF
        extra += (0, 1, 1, 2)[kind // 1000]
        kind %= 1000
        n = struct.unpack_from(f"{order}I", data, at)[0]
        at += 4
        if kind in (WKB_MULTIPOLYGON, WKB_COLLECTION):
            for _ in range(n):
                at = shape(at)
        elif kind == WKB_POLYGON:
            for _ in range(n):
                m = struct.unpack_from(f"{order}I", data, at)[0]
                points = np.frombuffer(data, f"{order}f8", m * (2 + extra), at + 4).reshape(m, -1)[:, :2]
                rings.extend(opened_rings(points.astype(np.float64), np.zeros(1, int)))
                at += 4 + 8 * m * (2 + extra)
        else:
            raise ValueError(f"geometry type {kind} is no polygon")
        return at

    shape(0)
    return rings


def rings_of_wkb(df: DataFrame, key: str = "feature", wkb: str = "wkb") -> DataFrame:
    """(feature, part, seq, x, y) of a column of well-known binary; nulls and empty shapes have no rows, broken ones fail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(k, wkb_rings(d)) for k, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if d]
            yield pa.RecordBatch.from_arrays(ring_columns(own), RING_NAMES)

    return df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("feature"), F.col(wkb).alias("wkb")).mapInArrow(run, "feature long, part int, seq int, x double, y double")
