"""Polygon tables against the literal form, raster and vector files against bytes written by hand."""

from __future__ import annotations

import pickle
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import GreaterThanOrEqual, LessThan

from gridloom.operators.polygons import CROWDED, WORD, covered_cells, covered_counts, edges, last_features, meeting, polygon_members, span_counts, validation, written_spans
from gridloom.operators.zones import members, polygons_table
from gridloom.plans.zonal import POLYGONS
from gridloom.sources import tiff
from gridloom.sources.raster import RasterReader, raster_profile, read_raster, write_raster
from gridloom.sources.vectors import ShapeReader, ShapeWriter, layer_profile, read_shapes, rings_of_wkb, shape_attributes, wkb_rings, write_shapes


def grid_of(spark, height, width):
    rows = spark.range(height).select(F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("col"))
    return rows.withColumn("cluster", F.when((F.col("row") + F.col("col")) % 5 > 0, (F.col("row") * 7 + F.col("col")) % 4).cast("int"))


def places(df):
    return sorted(map(tuple, df.select("feature", "row", "col").collect()))


def inside(rings, x, y):
    hits = 0
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
            if y1 != y2 and (y1 <= y) != (y2 <= y) and x < x1 + (y - y1) * ((x2 - x1) / (y2 - y1)):
                hits += 1
    return hits % 2 == 1


def test_polygon_tables_equal_the_literal_form(spark):
    cells = grid_of(spark, 16, 30)
    want = places(members(cells, POLYGONS))
    table = polygons_table(spark, POLYGONS)
    assert places(polygon_members(cells, table)) == want
    # tiles and salts of any size change nothing
    assert places(polygon_members(cells, table, tile=4, crowded=1)) == want
    assert places(polygon_members(cells, table, tile=1, crowded=2)) == want


def test_polygons_that_cross_themselves_overlap_or_are_broken(spark):
    rng = random.Random(3)
    shapes = [(f, [[(rng.uniform(-3, 23), rng.uniform(-3, 15)) for _ in range(rng.randint(3, 8))] for _ in range(rng.randint(1, 2))]) for f in range(60)]
    shapes += [(100, [[(2.0, 2.0), (8.0, 8.0), (8.0, 2.0), (2.0, 8.0)]]), (101, [[(1.0, 1.0), (9.0, 1.0), (9.0, 9.0), (1.0, 9.0)], [(3.0, 3.0), (6.0, 3.0), (6.0, 6.0), (3.0, 6.0)]]), (102, [[(0.5, 0.5), (5.5, 0.5), (5.5, 5.5), (0.5, 5.5)]])]
    cells = grid_of(spark, 12, 20)
    want = sorted((f, r, c) for f, rings in shapes for r in range(12) for c in range(20) if inside(rings, c + 0.5, r + 0.5))
    assert places(polygon_members(cells, polygons_table(spark, shapes), tile=8, crowded=3)) == want
    none = spark.createDataFrame([(1, 0, 0, 1.0, 1.0), (1, 0, 1, 5.0, 1.0), (None, 0, 0, 1.0, 1.0), (2, 0, 0, float("nan"), 1.0), (3, 0, None, 1.0, 1.0)], "feature int, part int, seq int, x double, y double")
    assert polygon_members(cells, none).count() == 0
    assert polygon_members(cells.limit(0), polygons_table(spark, shapes)).count() == 0
    assert edges(polygons_table(spark, POLYGONS)).count() == sum(len(r) for _, rings in POLYGONS for r in rings)


def test_validation_adds_up(spark):
    cells = grid_of(spark, 16, 30)
    attributes = spark.createDataFrame([(f, f"u{f % 2}", "a" if f < 3 else "b") for f, _ in POLYGONS], "feature int, unit string, category string")
    found = validation(cells, polygons_table(spark, POLYGONS), attributes)
    polygons = {r["feature"]: r for r in found["polygons"].collect()}
    assert 6 not in polygons  # outside the grid
    pooled = found["pooled"].first()
    assert pooled["valid"] == sum(r["valid"] for r in polygons.values()) == sum(r["valid"] for r in found["categories"].collect())
    assert found["dissolved"].first()["valid"] < pooled["valid"]
    for f, r in polygons.items():
        assert abs(sum(r[f"pct{k}"] for k in range(4)) - 100) < 1e-5 and r["purity"] == max(r[f"pct{k}"] for k in range(4))
    assert {r["feature"] for r in meeting(polygons_table(spark, POLYGONS), (0, 15, 0, 29)).collect()} == {1, 2, 3, 4, 5}


def test_lzw_and_predictors():
    # the example of the format's description
    assert tiff.packed_lzw(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])).hex() == "8001e0408044080c068080"
    rng = random.Random(1)
    for data in (b"", b"a", b"ab" * 5_000, bytes(rng.randrange(256) for _ in range(30_000)), bytes(rng.randrange(3) for _ in range(70_000))):
        assert tiff.unpacked_lzw(tiff.packed_lzw(data)) == data
    for dtype, predictor in (("u1", 2), ("<i2", 2), ("<f4", 3), ("<f8", 3), ("<f4", 1)):
        block = (np.arange(35 * 20).reshape(35, 20) * 1.37 % 251).astype(dtype)
        for compression in (tiff.PLAIN, tiff.LZW, tiff.DEFLATE):
            assert (tiff.decoded(tiff.encoded(block, compression, predictor), compression, predictor, np.dtype(dtype), 35, 20) == block).all()


def strips(order: str, large: bool) -> bytes:
    """A file by hand: 5 x 3 cells of 16 bits in strips of two rows, the second compressed rows apart; values row * 10 + column."""
    rows = [struct.pack(f"{order}3H", *(r * 10 + c for c in range(3))) for r in range(5)]
    blocks = [zlib.compress(b"".join(rows[a : a + 2])) for a in (0, 2, 4)]
    word, start = ("Q", 16) if large else ("I", 8)
    at = start + np.cumsum([0, *map(len, blocks)])
    arrays_at = int(at[-1])
    kind = 16 if large else 4
    body = b"".join(blocks) + struct.pack(f"{order}3{word}", *at[:3].tolist()) + struct.pack(f"{order}3{word}", *map(len, blocks))
    size = struct.calcsize(word)
    tags = [(256, 3, 1, 3), (257, 3, 1, 5), (258, 3, 1, 16), (259, 3, 1, 8), (273, kind, 3, arrays_at), (277, 3, 1, 1), (278, 3, 1, 2), (279, kind, 3, arrays_at + 3 * size)]
    entry = lambda t, k, n, v: struct.pack(f"{order}HH{word}", t, k, n) + (struct.pack(f"{order}H", v).ljust(size, b"\0") if k == 3 else struct.pack(f"{order}{word}", v))
    directory = start + len(body)
    head = (b"II" if order == "<" else b"MM") + (struct.pack(f"{order}HHHQ", 43, 8, 0, directory) if large else struct.pack(f"{order}HI", 42, directory))
    return head + body + struct.pack(f"{order}{'Q' if large else 'H'}", len(tags)) + b"".join(entry(*t) for t in tags) + struct.pack(f"{order}{word}", 0)


@pytest.mark.parametrize("order,large", [("<", False), (">", False), ("<", True), (">", True)])
def test_a_file_written_by_hand(spark, tmp_path, order, large):
    (tmp_path / "a.tif").write_bytes(strips(order, large))
    got = sorted(map(tuple, read_raster(spark, str(tmp_path / "a.tif"), partitionCells=1).collect()))
    assert got == [(r, c, float(r * 10 + c)) for r in range(5) for c in range(3)]
    (tmp_path / "bad.tif").write_bytes(b"no raster at all")
    with pytest.raises(Exception, match="not a TIFF"):
        read_raster(spark, str(tmp_path / "bad.tif")).collect()


def test_raster_round_trip_and_pruned_window(spark, tmp_path):
    cells = grid_of(spark, 70, 50)
    path = f"file://{tmp_path}/bytes"
    write_raster(cells, path, "cluster", (70, 50), block=32, tile=16, compression="lzw", step_x=2.0, step_y=3.0, origin_x=-50.0, origin_y=90.0)
    back = read_raster(spark, path, "cluster")
    want = sorted(cells.select("row", "col", F.col("cluster").cast("double")).collect())
    assert sorted(back.collect(), key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])
    window = (F.col("row") >= 40) & (F.col("row") < 60) & (F.col("col") < 10)
    assert sorted(map(tuple, back.where(window).select("row", "col").collect())) == [(r, c) for r in range(40, 60) for c in range(10)]
    one = raster_profile(spark, path).first().asDict()
    assert (one["height"], one["width"], one["dtype"], one["nodata"], one["step_x"], one["origin_y"], one["files"]) == (70, 50, "uint8", 255.0, 2.0, 90.0, 6)

    reader = RasterReader({"path": path})
    assert len(reader.partitions()) == 6
    list(reader.pushFilters([GreaterThanOrEqual(("row",), 40), LessThan(("row",), 60), LessThan(("col",), 10)]))
    blocks = reader.partitions()
    assert len(blocks) == 1 and sum(b.num_rows for b in reader.read(blocks[0])) == 2 * 16 * 16  # two of its four tiles

    # a second write replaces the first; missing cells are no data
    write_raster(cells.where("row < 5").withColumn("v", F.col("col") / 4), path, "v", (70, 50), "float32", -9999, block=32, tile=16, compression="deflate")
    again = read_raster(spark, path, "v").where("v is not null")
    assert sorted(map(tuple, again.collect())) == [(r, c, c / 4) for r in range(5) for c in range(50)]


def shapefile(folder, name, polygons, texts):
    """By hand: main file, index and a table with one attribute."""
    records, index, at = b"", b"", 50
    for i, rings in enumerate(polygons):
        if rings is None:
            content = struct.pack("<i", 0)
        else:
            points = [p for r in rings for p in r]
            starts = np.cumsum([0, *map(len, rings[:-1])])
            content = struct.pack("<i4d2i", 5, 0, 0, 9, 9, len(rings), len(points)) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        records += struct.pack(">2i", i + 1, len(content) // 2) + content
        index += struct.pack(">2i", at, len(content) // 2)
        at += 4 + len(content) // 2
    head = struct.pack(">i20xi", 9994, at) + struct.pack("<2i8d", 1000, 5, 0, 0, 9, 9, 0, 0, 0, 0)
    (folder / f"{name}.shp").write_bytes(head + records)
    (folder / f"{name}.shx").write_bytes(head + index)
    field = b"name".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([6]) + b"\0" * 15
    table = b"\x03" + b"\0" * 3 + struct.pack("<IHH", len(texts), 65, 7) + b"\0" * 20 + field + b"\r" + b"".join(b" " + t.encode().ljust(6) for t in texts) + b"\x1a"
    (folder / f"{name}.dbf").write_bytes(table)
    (folder / f"{name}.prj").write_text("LOCAL")


SQUARE, TRIANGLE = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (1.5, 2.0)]


def test_shapefiles_written_by_hand(spark, tmp_path):
    shapefile(tmp_path, "a", [[[*SQUARE, SQUARE[0]], [*TRIANGLE, TRIANGLE[0]]], None], ["one", ""])
    shapefile(tmp_path, "b", [[[*TRIANGLE, TRIANGLE[0]]]], ["three"])
    want = [(0, 0, i, *p) for i, p in enumerate(SQUARE)] + [(0, 1, i, *p) for i, p in enumerate(TRIANGLE)] + [(2, 0, i, *p) for i, p in enumerate(TRIANGLE)]
    for most in (1, 1 << 20):
        assert sorted(map(tuple, read_shapes(spark, str(tmp_path), partitionBytes=most).collect())) == want
    assert sorted(shape_attributes(spark, str(tmp_path)).collect()) == [(0, "name", "one"), (1, "name", None), (2, "name", "three")]
    assert [tuple(r) for r in layer_profile(spark, str(tmp_path)).select("layer", "records", "x_max", "crs").collect()] == [("a", 2, 9.0, "LOCAL"), ("b", 1, 9.0, "LOCAL")]


def test_shapefiles_round_trip(spark, tmp_path):
    table = polygons_table(spark, POLYGONS)
    write_shapes(table, f"file://{tmp_path}/s", fileBytes=200)
    key = shape_attributes(spark, f"file://{tmp_path}/s").select("feature", F.col("value").cast("int").alias("key"))
    back = read_shapes(spark, f"file://{tmp_path}/s").join(key, "feature").select(F.col("key").alias("feature"), "part", "seq", "x", "y")
    assert sorted(back.collect()) == sorted(table.collect())
    assert places(polygon_members(grid_of(spark, 16, 30), back)) == places(members(grid_of(spark, 16, 30), POLYGONS))


def wkb(order, rings, kind=3, extra=()):
    out = struct.pack(f"{order}BI", order == "<", kind) + struct.pack(f"{order}I", len(rings))
    return out + b"".join(struct.pack(f"{order}I", len(r)) + b"".join(struct.pack(f"{order}{2 + len(extra)}d", *p, *extra) for p in r) for r in rings)


def test_well_known_binary(spark):
    closed = [*SQUARE, SQUARE[0]]
    same = lambda data, rings: [[tuple(p) for p in r] for r in wkb_rings(data)] == rings
    assert same(wkb("<", [closed]), [SQUARE]) and same(wkb(">", [closed, [*TRIANGLE, TRIANGLE[0]]]), [SQUARE, TRIANGLE])
    assert same(wkb("<", [closed], 1003, (7.0,)), [SQUARE]) and same(wkb(">", [closed], 3 | 0x80000000, (7.0,)), [SQUARE])
    several = struct.pack("<BII", 1, 6, 2) + wkb("<", [closed]) + wkb(">", [TRIANGLE])
    assert same(several, [SQUARE, TRIANGLE])
    numbered = struct.pack("<BII", 1, 3 | 0x20000000, 4326) + wkb("<", [closed])[5:]
    assert same(numbered, [SQUARE])
    df = spark.createDataFrame([(5, bytearray(several)), (6, None), (None, bytearray(several)), (7, bytearray(wkb("<", [])))], "feature long, wkb binary")
    assert sorted(map(tuple, rings_of_wkb(df).collect())) == [(5, 0, i, *p) for i, p in enumerate(SQUARE)] + [(5, 1, i, *p) for i, p in enumerate(TRIANGLE)]
    with pytest.raises(ValueError, match="no polygon"):
        wkb_rings(struct.pack("<BI2d", 1, 1, 0, 0))


def test_counts_by_bits_equal_counts_of_members(spark):
    rng = random.Random(5)
    shapes = [(f, [[(rng.uniform(-9, 159), rng.uniform(-3, 13)) for _ in range(rng.randint(3, 7))] for _ in range(rng.randint(1, 2))]) for f in range(30)]
    shapes.append((90, [[(-5.0, -5.0), (200.0, -5.0), (200.0, 50.0), (-5.0, 50.0)]]))  # whole words
    cells, table = grid_of(spark, 10, 150).withColumn("col", F.col("col") - 3), polygons_table(spark, shapes)
    met = [r.asDict() for r in polygon_members(cells, table).collect()]
    tally = lambda rows: tuple(sum(r["cluster"] == k if k is not None else r["cluster"] is not None for r in rows) for k in (None, 0, 1, 2, 3))
    of = lambda key: {v: [r for r in met if key(r) == v] for v in {key(r) for r in met}}
    for crowded in (1, CROWDED):
        got = {r["feature"]: tuple(r)[1:] for r in span_counts(cells, written_spans(cells, table, WORD), crowded).collect()}
        assert got == {f: tally(rows) for f, rows in of(lambda r: r["feature"]).items()}
    once = {at: rows[0] for at, rows in of(lambda r: (r["row"], r["col"])).items()}
    assert tuple(covered_counts(cells, written_spans(cells, table, WORD)).first()) == tally(once.values())
    assert sorted((r["row"], r["col"]) for r in covered_cells(cells, table).collect()) == sorted(once)
    last = {at: max(r["feature"] for r in rows) for at, rows in of(lambda r: (r["row"], r["col"])).items()}
    assert {(r["row"], r["col"]): r["feature"] for r in last_features(cells, table).collect()} == last


def test_joins_of_exploded_rows_are_not_broadcast(spark):
    vertices = spark.range(50).select(F.col("id").alias("feature"), F.lit(0).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("seq"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    assert "Broadcast" not in edges(vertices)._jdf.queryExecution().executedPlan().toString()


def test_planning_holds_ranges_of_records_not_records(spark, tmp_path):
    path = f"file://{tmp_path}/shapes"
    write_shapes(polygons_table(spark, [(f, [[(float(f), 0.0), (f + 1.0, 0.0), (f + 1.0, 1.0)]]) for f in range(2_000)]).repartition(1), path, fileBytes=40_000)
    whole_parts, parts = ShapeReader({"path": path}).partitions(), ShapeReader({"path": path, "partitionBytes": "10000"}).partitions()
    assert max(len(pickle.dumps(p)) for p in whole_parts) < 1_000 and len(parts) > len(whole_parts) > 4
    back = read_shapes(spark, path, partitionBytes=10_000)
    assert back.count() == 6_000 and back.select("feature").distinct().count() == 2_000
    assert layer_profile(spark, path).agg(F.sum("records"), F.min("x_min"), F.max("x_max")).first()[:] == (2_000, 0.0, 2_000.0)


def test_shapefile_writer_holds_one_bounded_file():
    assert ShapeWriter({"path": "file:///nowhere"}, True).most <= 1 << 26


def test_small_features_are_dealt_once_and_large_ones_as_before(spark, monkeypatch):
    import gridloom.operators.polygons as polygons

    table = polygons_table(spark, POLYGONS)
    plan = polygons.spans(polygons.short_edges(polygons.usable(table)), (0, 9, 0, 9))._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("Exchange hashpartitioning") == 1
    gap = spark.createDataFrame([(90, 0, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (6.0, 0.0), (float("nan"), 3.0), (6.0, 6.0), (0.0, 6.0)])], table.schema)
    cells = spark.range(100).selectExpr("cast(id div 10 as int) as row", "cast(id % 10 as int) as col")
    runs = lambda: sorted(map(tuple, polygons.written_spans(cells, table.union(gap), WORD).collect()))
    small = runs()
    monkeypatch.setattr(polygons, "RING", 4)
    mixed = runs()
    monkeypatch.setattr(polygons, "RINGS", 0)
    assert small == mixed == runs() and small
