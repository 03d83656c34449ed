"""Reading and writing."""

import datetime as dt
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyflux.operators import raster
from canopyflux.sources import images, tables, tiff
from canopyflux.streaming import append


def test_tiff_round_trip(spark, tmp_path):
    grid = np.arange(12, dtype=np.uint16).reshape(3, 4)
    (tmp_path / "a.tif").write_bytes(tiff.encode(grid, 100.0, 200.0, 10.0, 65535))
    (tmp_path / "b.txt").write_text("no image")
    cube, place = tiff.decode((tmp_path / "a.tif").read_bytes())
    assert np.array_equal(cube[0], grid) and place == (100.0, 200.0, 10.0)
    got = {(r.x, r.y): r.v for r in tiff.read_pixels(spark, str(tmp_path), ["v"]).collect()}
    assert len(got) == 12 and got[105.0, 195.0] == 0 and got[135.0, 175.0] == 11
    cells = spark.createDataFrame([(0, 1, 7), (2, 3, 9)], "row int, col int, value int")
    out, _ = tiff.decode(tiff.grid_bytes(cells, 3, 4, 0, 30))
    assert out[0, 0, 1] == 7 and out[0, 2, 3] == 9 and (out == -9999).sum() == 10


def packed_lzw(raw):
    """The writer's side of LZW, with a new table when it is full."""
    out, bits, table, now, width = 0, 0, None, b"", 9

    def put(code, w):
        nonlocal out, bits
        out, bits = out << w | code, bits + w

    for i in range(len(raw)):
        if table is None:
            put(256, width)
            table, width = {bytes([k]): k for k in range(256)}, 9
        c = raw[i : i + 1]
        if now + c in table:
            now += c
            continue
        put(table[now], width)
        table[now + c] = len(table) + 2
        now = c
        width = 9 if len(table) + 1 < 511 else 10 if len(table) + 1 < 1023 else 11 if len(table) + 1 < 2047 else 12
        if len(table) + 2 == 4094:
            put(table[now], width)
            put(256, width)
            table, width, now = {bytes([k]): k for k in range(256)}, 9, b""
    if now:
        put(table[now], width)
    put(257, width)
    return (out << (-bits % 8)).to_bytes((bits + 7) // 8, "big")


def test_unpacking():
    # codes 256 7 258 8 8 258 6 6 257 of 9 bits stand for 7 7 7 8 8 7 7 6 6
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    assert tiff.lzw(int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert tiff.pack_bits(bytes([254, 0xAA, 2, 0x80, 0, 0x2A, 253, 0xAA, 128, 0, 1])) == bytes([0xAA, 0xAA, 0xAA, 0x80, 0, 0x2A, 0xAA, 0xAA, 0xAA, 0xAA, 1])
    rng = np.random.default_rng(3)
    for raw in (b"", b"a", bytes(rng.integers(0, 3, 900, dtype=np.uint8)), bytes(rng.integers(0, 256, 9000, dtype=np.uint8)), b"ab" * 5000):
        assert tiff.lzw(packed_lzw(raw)) == raw


def test_packed_tiled_and_differenced_files(spark):
    grid = np.arange(30, dtype=np.int32).reshape(5, 6) * 1000 - 7
    packed = tiff.encode(grid, pack=True)
    assert np.array_equal(tiff.decode(packed)[0][0], grid)
    # tiles of 4 by 4 that go over the edges, differences along the rows, two samples of a pixel side by side
    cube = np.stack([grid, -grid]).astype("<i4")
    full = np.zeros((2, 8, 8), "<i4")
    full[:, :5, :6] = cube
    blocks = []
    for r in (0, 4):
        for c in (0, 4):
            b = full[:, r : r + 4, c : c + 4].transpose(1, 2, 0)
            blocks.append(zlib.compress(np.diff(b, axis=1, prepend=np.zeros((4, 1, 2), "<i4")).astype("<i4").tobytes()))
    tags = [(256, 6), (257, 5), (258, 32), (259, 8), (277, 2), (284, 1), (317, 2), (322, 4), (323, 4), (324, None), (325, None), (339, 2)]
    head = 8 + 2 + 12 * len(tags) + 4
    at = np.cumsum([head + 32, *map(len, blocks)])
    raw = b"II*\0" + struct.pack("<IH", 8, len(tags))
    for tag, v in tags:
        raw += struct.pack("<HHII", tag, 4, 4, head if tag == 324 else head + 16) if v is None else struct.pack("<HHII", tag, 4, 1, v)
    raw += struct.pack("<I", 0) + struct.pack("<4I", *at[:4]) + struct.pack("<4I", *map(len, blocks)) + b"".join(blocks)
    assert np.array_equal(tiff.decode(raw)[0], cube)


def test_tiles_of_a_large_grid(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0, 1), (999, 5, 2), (5000, 70000, 3)], "row int, col int, value int")
    for _ in range(2):  # a second run writes the same files
        wrote = tiff.write_files(tiff.tile_files(cells, 1000, 0.0, 100000.0), f"file://{tmp_path}/g").collect()
    assert sorted(r.path for r in wrote) == ["tile_0_0.tif", "tile_5_70.tif"] == sorted(f for f in os.listdir(tmp_path / "g") if not f.startswith("."))
    got = tiff.read_pixels(spark, f"file://{tmp_path}/g", ["v"]).filter("v <> -9999").collect()
    assert sorted((r.x, r.y, r.v) for r in got) == [(5.0, 99995.0, 1.0), (55.0, 90005.0, 2.0), (700005.0, 49995.0, 3.0)]


def test_list_results_with_odd_numbers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,rmse,tBreak\n1,"[1.5, NaN]","[10, 20]"\n2,"[]","[]"\n3,,\n')
    rows = tables.read_list_results(spark, str(tmp_path / "a.csv"), ["rmse", "tBreak"], ["tBreak"]).orderBy("id", "tBreak").collect()
    assert [(r.id, str(r.rmse), r.tBreak) for r in rows] == [("1", "1.5", 10), ("1", "nan", 20), ("2", "None", None), ("3", "None", None)]


def test_broken_tiff():
    with pytest.raises(ValueError):
        tiff.decode(b"II\x2b\0\0\0\0\0")


def test_file_lists(spark, tmp_path):
    for n in ("Theia_T29TNE_20180105-1.tif", "Theia_T29TNE_20160105-1.tif", "S2SR_image_1514764800000_x.tif", "other.txt"):
        (tmp_path / n).write_text("x")
    files = images.list_files(spark, str(tmp_path))
    assert [r.acq_date for r in images.list_theia(files, "T29TNE", 2017).collect()] == [dt.date(2018, 1, 5)]
    assert [r.acq_date for r in images.list_epoch(files, "T29TNE").collect()] == [dt.date(2018, 1, 1)]
    assert images.most_recent(files, "S2SR").first().path.endswith(("tif", "txt"))
    assert spark.range(1).select(images.dated_name(F.lit("S2SR_image_1514764800000_x.tif"))).first()[0] == "S2SR_image_20180101_x.tif"


def test_run_names():
    name = images.format_run_name("ccd", 12, 2.0, dt.date(2017, 1, 1), dt.date(2021, 9, 30), "north")
    assert images.parse_run_name(name) == {"prefix": "ccd", "meow": "12", "alpha": "2", "first": "20170101", "last": "20210930", "roi": "north"}
    with pytest.raises(ValueError):
        images.parse_run_name("nothing")


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k;v\n1;x,y\n")
    assert [tuple(r) for r in tables.read_delimited(spark, str(tmp_path / "a.csv")).collect()] == [("1", "x,y")]


def test_cube_and_cache(spark, tmp_path):
    rows = spark.createDataFrame([("t", 1, 2, 10, 5), ("u", 1, 2, 11, 6)], "tile string, x int, y int, date int, green int")
    folder = str(tmp_path / "cube")
    tables.write_cube(rows, folder)
    tables.write_cube(rows, folder, append=True)
    assert tables.read_cube(spark, folder, "t").count() == 2
    built = []

    def build():
        built.append(1)
        return rows

    for _ in range(2):
        assert tables.check_or_build(spark, str(tmp_path / "cache"), build).count() == 2
    assert built == [1]


def test_grid_and_colours(spark):
    seg = spark.createDataFrame([(0, 0, 1514764800000), (10, 10, 1546300800000)], "x_coord long, y_coord long, tBreak long")
    lines = {r.row: r.line for r in tables.grid_lines(raster.break_grid(seg), 2).collect()}
    assert lines == {0: "-9999 20190101", 1: "20180101 -9999"}
    entries = [r.line for r in tables.colour_table(raster.palette(seg)).orderBy("value").collect()]
    assert entries[0].startswith('<paletteEntry value="20180101" label="2018-01-01" color="#')


def test_append_stream(spark, tmp_path):
    rows = spark.createDataFrame([("t", 1, 2, 10, 5)], "tile string, x int, y int, date int, green int")
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        stream = append.observation_stream(spark, str(tmp_path / "in"), rows.schema)
        append.append_to_cube(stream, str(tmp_path / "cube"), str(tmp_path / "check")).awaitTermination()
    assert tables.read_cube(spark, str(tmp_path / "cube")).count() == 1


def test_sampling(spark):
    px = spark.createDataFrame([(i * 10 + 5.0, 5.0, i) for i in range(5)], "x double, y double, v int")
    pt = spark.createDataFrame([(1, 12.0, 3.0)], "id int, x double, y double")
    assert [(r.id, r.v) for r in tables.sample_points(px, pt, 10).collect()] == [(1, 1)]
    a = tables.seeded_sample(spark.range(100).repartition(7), 10, F.col("id")).collect()
    assert a == tables.seeded_sample(spark.range(100), 10, F.col("id")).collect() and len(a) == 10
