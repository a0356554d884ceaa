"""Rasters as a Spark data source: TIFF files of one band, read and written by blocks.

A raster is one file or a folder of files, each a block of it; the writer puts row and column of a block into its file's
description, so a folder needs no list.  Reading yields (row, col, value), null for no data.  A written block's place is in its
name, other files' headers are read while the plan is made; a partition is a block or a few tiles, whose bytes its task fetches by range.  Comparisons of row and col with
numbers reach the source and leave out tiles.  Files are opened by ``pyarrow.fs``, so a path may name any store it knows.

Writing takes (row, col, value) dealt by block: a task fills one block at a time and writes it as a file of its own; nothing
passes through the driver.  A later write to the same folder replaces it.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from gridloom.sources import tiff

#: Cells of a partition; side of a written block and of its tiles.
PARTITION_CELLS, BLOCK, TILE = 1 << 22, 2_048, 256
SUFFIXES = (".tif", ".tiff")
NAMED = re.compile(r"/block-(\d+)-(\d+)-(\d+)-(\d+)-[0-9a-f]+-[0-9a-f]+\.tif$")
COMPRESSIONS = {"none": tiff.PLAIN, "lzw": tiff.LZW, "deflate": tiff.DEFLATE}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[str]:
    """The raster's files below ``path``, as the file system names them."""
    store, at = opened(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [at]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return sorted(f.path for f in store.get_file_info(fs.FileSelector(at)) if f.path.endswith(SUFFIXES))


def header_of(store: fs.FileSystem, file: str) -> tuple[tiff.Header, int, int]:
    """(header, row and column of the file's first cell in the whole raster)."""
    with store.open_input_file(file) as f:

        def read(at: int, size: int) -> bytes:
            f.seek(at)
            return f.read(size)

        head = tiff.header(read)
    try:
        place = json.loads(head.description)
        return head, int(place["row"]), int(place["col"])
    except (ValueError, KeyError, TypeError):
        return head, 0, 0


@dataclass
class Tiles(InputPartition):
    """Some tiles of one file, each (row, rows, column, columns, offset, bytes); None: those in the bounds, found by the task."""

    file: str
    head: tiff.Header | None
    tiles: list[tuple[int, int, int, int, int, int]] | None


def tiles_in(head: tiff.Header, row: int, col: int, bounds: dict[str, list[int]]) -> list[tuple[int, int, int, int, int, int]]:
    (top, bottom), (left, right) = bounds["row"], bounds["col"]
    out = []
    for i, (offset, size) in enumerate(zip(head.offsets, head.sizes)):
        r0, r1, c0, c1 = head.window(i)
        if size and row + r0 < bottom and row + r1 > top and col + c0 < right and col + c1 > left:
            out.append((row + r0, r1 - r0, col + c0, c1 - c0, offset, size))
    return out


class RasterReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.cells = int(options.get("partitionCells", PARTITION_CELLS))
        self.bounds = {"row": [0, 1 << 31], "col": [0, 1 << 31]}  # first, and the one after the last

    def pushFilters(self, filters):
        for f in filters:
            name, value = (f.attribute[0] if len(f.attribute) == 1 else None, f.value) if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) else (None, None)
            if name in self.bounds and isinstance(value, (int, float)):
                low, high = self.bounds[name]
                if isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                    low = max(low, int(np.floor(value)) + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThanOrEqual, LessThan)):
                    high = min(high, int(np.ceil(value)) + (not isinstance(f, LessThan)))
                self.bounds[name] = [low, high]
            yield f  # tiles are left out; cells inside them are compared by Spark

    def partitions(self) -> list[Tiles]:
        store, _ = opened(self.path)
        (top, bottom), (left, right) = self.bounds["row"], self.bounds["col"]
        out = []
        for file in files_of(self.path):
            named = NAMED.search(file)
            if named:  # written here: its place is in its name, so its header is left to the task
                row, col, rows, columns = map(int, named.groups())
                if row < bottom and row + rows > top and col < right and col + columns > left:
                    out.append(Tiles(file, None, None))
                continue
            head, row, col = header_of(store, file)
            tiles = tiles_in(head, row, col, self.bounds)
            step = max(1, self.cells // (head.block_height * head.block_width))
            out += [Tiles(file, head, tiles[a : a + step]) for a in range(0, len(tiles), step)]
        return out

    def read(self, partition: Tiles) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing to read is one empty task
            return
        store, _ = opened(self.path)
        head, tiles = partition.head, partition.tiles
        if head is None:
            head, row, col = header_of(store, partition.file)
            tiles = tiles_in(head, row, col, self.bounds)
        with store.open_input_file(partition.file) as f:
            for row, rows, col, columns, offset, size in tiles:
                f.seek(offset)
                # tiles are whole, the last strip ends with the raster
                block = tiff.decoded(f.read(size), head.compression, head.predictor, head.dtype, head.block_height if head.tiled else rows, head.block_width)
                values = block[:rows, :columns].astype(np.float64).ravel()
                empty = ~np.isfinite(values) | (values == head.nodata if head.nodata is not None else False)
                r, c = np.repeat(np.arange(row, row + rows, dtype=np.int32), columns), np.tile(np.arange(col, col + columns, dtype=np.int32), rows)
                for a in range(0, len(values), 1 << 16):
                    cut = slice(a, a + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(r[cut]), pa.array(c[cut]), pa.array(values[cut], mask=empty[cut])], ["row", "col", "value"])


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class RasterWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.options, self.overwrite, self.run = dict(options), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        o = self.options
        size, tile, dtype, nodata = int(o.get("block", BLOCK)), int(o.get("tile", TILE)), np.dtype(o["dtype"]), float(o["nodata"])
        height, width = int(o["height"]), int(o["width"])
        step, origin = (float(o.get("step_x", 1)), float(o.get("step_y", 1))), (float(o.get("origin_x", 0)), float(o.get("origin_y", 0)))
        predictor = 1 if o.get("predictor") == "none" else 3 if dtype.kind == "f" else 2
        store, at = opened(o["path"])
        files: list[str] = []
        store.create_dir(at, recursive=True)

        def put(block: tuple[int, int], values: np.ndarray) -> None:
            r, c = block[0] * size, block[1] * size
            data = tiff.file_bytes(values, tile, COMPRESSIONS[o.get("compression", "lzw")], predictor, nodata, step, (origin[0] + c * step[0], origin[1] - r * step[1]), json.dumps({"row": r, "col": c}))
            name = f"{at}/.block-{r}-{c}-{values.shape[0]}-{values.shape[1]}-{self.run}-{uuid.uuid4().hex}.tif.part"
            with store.open_output_stream(name) as f:
                f.write(data)
            files.append(name)

        now, values = None, None
        for batch in iterator:
            row, col, value = (batch.column(i) for i in (0, 1, 2))
            row, col = row.to_numpy(), col.to_numpy()
            value = np.nan_to_num(value.to_numpy(zero_copy_only=False).astype(np.float64), nan=nodata)
            block = np.stack([row // size, col // size])
            cuts = np.flatnonzero(np.append(True, (block[:, 1:] != block[:, :-1]).any(axis=0))) if len(row) else []
            for a, b in zip(cuts, [*cuts[1:], len(row)]):
                own = (int(block[0, a]), int(block[1, a]))
                if own != now:
                    if now is not None:
                        put(now, values)
                    now = own
                    values = np.full((min(size, height - own[0] * size), min(size, width - own[1] * size)), nodata, dtype)
                values[row[a:b] - own[0] * size, col[a:b] - own[1] * size] = value[a:b].astype(dtype)
        if now is not None:
            put(now, values)
        return Written(files)

    def commit(self, messages) -> None:
        store, at = opened(self.options["path"])
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
                if old.path.endswith(SUFFIXES):
                    store.delete_file(old.path)
        for file in (f for m in messages if m for f in m.files):
            folder, name = file.rsplit("/", 1)
            store.move(file, f"{folder}/{name.removeprefix('.').removesuffix('.part')}")

    def abort(self, messages) -> None:
        store, _ = opened(self.options["path"])
        for file in (f for m in messages if m for f in m.files):
            store.delete_file(file)


class RasterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gridloom_raster"

    def schema(self) -> str:
        return "row int, col int, value double"

    def reader(self, schema) -> RasterReader:
        return RasterReader(self.options)

    def writer(self, schema, overwrite: bool) -> RasterWriter:
        return RasterWriter(self.options, overwrite)


def read_raster(spark: SparkSession, path: str, name: str = "value", **options) -> DataFrame:
    """(row, col, ``name``) of a raster; a filter on row or col reads only the tiles it needs."""
    spark.dataSource.register(RasterSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("gridloom_raster").options(**options).load(path).withColumnRenamed("value", name)


def write_raster(df: DataFrame, path: str, value: str, shape: tuple[int, int], dtype: str = "uint8", nodata: float = 255, block: int = BLOCK, **options) -> None:
    """``df`` (row, col, ``value``) as tiled files of one block each; nulls and cells that are missing are ``nodata``.

    ``shape`` is (height, width); options: tile, compression (lzw, deflate, none), predictor (none), step_x, step_y, origin_x, origin_y.
    """
    df.sparkSession.dataSource.register(RasterSource)
    dealt = df.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col(value).cast("double").alias("value"))
    by = [F.floor(F.col("row") / block), F.floor(F.col("col") / block)]
    dealt = dealt.repartition(*by).sortWithinPartitions(*by)
    dealt.write.format("gridloom_raster").options(dtype=dtype, nodata=nodata, block=block, height=shape[0], width=shape[1], **options).mode("overwrite").save(path)


def raster_profile(spark: SparkSession, path: str) -> DataFrame:
    """One row from the files' headers: shape, tile size, sample type, no-data value, cell size, upper left corner, files and tiles."""
    store, _ = opened(path)
    heads = [header_of(store, f) for f in files_of(path)]
    first = min(heads, key=lambda h: (h[1], h[2]))
    row = (
        max(h.height + r for h, r, _ in heads), max(h.width + c for h, _, c in heads), first[0].block_height, first[0].block_width, first[0].dtype.name, first[0].nodata,
        *(first[0].scale or (None, None)), *(first[0].corner or (None, None)), len(heads), sum(len(h.offsets) for h, _, _ in heads),
    )
    return spark.createDataFrame([row], "height int, width int, tile_height int, tile_width int, dtype string, nodata double, step_x double, step_y double, origin_x double, origin_y double, files int, tiles int")
