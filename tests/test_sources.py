"""GeoTIFF files and pixel streams."""

import struct
import zlib

import numpy as np
import pytest

from gridloom.sources import geotiff as gt
from gridloom.streaming import indexes as st


@pytest.mark.parametrize(("kind", "compress"), [("uint16", True), ("uint8", False), ("float32", True), ("int16", False)])
def test_geotiff_round_trip(spark, tmp_path, kind, compress):
    values = (np.arange(2 * 70 * 9).reshape(2, 70, 9) % 200).astype(kind)
    gt.write_geotiff(str(tmp_path / "a.tif"), values, 10.0, -10.0, 500.0, 900.0, 7, rows=16, compress=compress)
    spark.dataSource.register(gt.GeoTiffSource)
    rows = spark.read.format("geotiff").load(str(tmp_path)).collect()
    back = np.full(values.shape, -1.0)
    for r in rows:
        back[r.band - 1, r.row_off : r.row_off + r.height, r.col_off : r.col_off + r.width] = np.array(r.data).reshape(r.height, r.width)
    assert (back == values).all()
    meta = spark.read.format("geotiff").option("metadata", "true").load(str(tmp_path / "*.tif")).first()
    assert (meta.width, meta.height, meta.band_count, meta.dtype) == (9, 70, 2, kind)
    assert (meta.a, meta.e, meta.c, meta.f, meta.nodata) == (10.0, -10.0, 500.0, 900.0, 7.0)


def test_tiled_chunky_big_endian(tmp_path):
    """Two interleaved bands in tiles of 16 x 16, high byte first, differences stored."""
    image = (np.arange(20 * 18 * 2).reshape(20, 18, 2) * 3 % 251).astype(">u2")
    tiles = []
    for r in (0, 16):
        for c in (0, 16):
            tile = np.zeros((16, 16, 2), dtype=">u2")
            part = image[r : r + 16, c : c + 16]
            tile[: part.shape[0], : part.shape[1]] = part
            diff = tile.copy()
            diff[:, 1:] = tile[:, 1:] - tile[:, :-1]
            tiles.append(zlib.compress(diff.tobytes()))
    places, at = [], 8
    for t in tiles:
        places.append(at)
        at += len(t)
    fields = [(256, "H", [18]), (257, "H", [20]), (258, "H", [16, 16]), (259, "H", [8]), (277, "H", [2]), (284, "H", [1]), (317, "H", [2]), (322, "H", [16]), (323, "H", [16]), (324, "I", places), (325, "I", [len(t) for t in tiles])]
    entries, extra, end = b"", b"", at + 2 + 12 * len(fields) + 4
    for tag, code, data in fields:
        raw = struct.pack(f">{len(data)}{code}", *data)
        entries += struct.pack(">HHI", tag, 3 if code == "H" else 4, len(data)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(">I", end + len(extra)))
        extra += raw if len(raw) > 4 else b""
    path = tmp_path / "big.tif"
    path.write_bytes(struct.pack(">2sHI", b"MM", 42, at) + b"".join(tiles) + struct.pack(">H", len(fields)) + entries + struct.pack(">I", 0) + extra)
    back = np.zeros((2, 20, 18))
    tags = gt.header(str(path))
    for block in gt.blocks(str(path)):
        for _, _, band, r, c, h, w, data in gt.read_block(str(path), tags, block):
            back[band - 1, r : r + h, c : c + w] = np.array(data).reshape(h, w)
    assert (back == np.moveaxis(image.astype(float), 2, 0)).all()


def test_not_a_tiff(tmp_path):
    (tmp_path / "x.tif").write_bytes(b"hello world")
    with pytest.raises(ValueError):
        gt.header(str(tmp_path / "x.tif"))


def stored(path, raw, fields, pixels=b"", order="<", magic=42):
    """A hand-made classic file of one block with the given tags."""
    at = 8 + len(raw)
    fields = sorted([*fields, (273, "I", [8]), (279, "I", [len(raw)])])
    entries, extra, end = b"", b"", at + 2 + 12 * len(fields) + 4
    for tag, code, data in fields:
        packed = data if code == "s" else struct.pack(f"{order}{len(data)}{code}", *data)
        kind = {"H": 3, "I": 4, "d": 12, "s": 2}[code]
        entries += struct.pack(order + "HHI", tag, kind, len(data)) + (packed.ljust(4, b"\0") if len(packed) <= 4 else struct.pack(order + "I", end + len(extra)))
        extra += packed if len(packed) > 4 else b""
    path.write_bytes(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", magic, at) + raw + struct.pack(order + "H", len(fields)) + entries + struct.pack(order + "I", 0) + extra)
    return str(path)


def lzw(data):
    """Codes as the format describes them, with a table that is cleared when it is full."""
    out, held, bits = bytearray(), 0, 0

    def put(code, width):
        nonlocal held, bits
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            out.append((held >> (bits - 8)) & 255)
            bits -= 8
            held &= (1 << bits) - 1

    table, width, word = {bytes([i]): i for i in range(256)}, 9, b""
    free = 258
    put(256, 9)
    for byte in data:
        more = word + bytes([byte])
        if more in table:
            word = more
            continue
        put(table[word], width)
        table[more] = free
        free += 1
        width = 10 if free - 1 == 511 else 11 if free - 1 == 1023 else 12 if free - 1 == 2047 else width
        if free == 4094:
            put(256, width)
            table, width, free = {bytes([i]): i for i in range(256)}, 9, 258
        word = bytes([byte])
    put(table[word], width)
    put(257, width if free < 511 or width > 9 else 10)
    put(0, 7)
    return bytes(out)


def packbits(data):
    return b"".join(bytes([min(127, len(data) - i - 1)]) + data[i : i + 128] for i in range(0, len(data), 128)) + b"\x80"


def image(path):
    tags, got = gt.header(path), None
    for block in gt.blocks(path):
        for _, _, band, r, c, h, w, data in gt.read_block(path, tags, block):
            got = np.zeros((tags.get(277, (1,))[0], tags[257][0], tags[256][0])) if got is None else got
            got[band - 1, r : r + h, c : c + w] = np.array(data).reshape(h, w)
    return got


BASE = [(256, "H", [70]), (257, "H", [90]), (277, "H", [1]), (278, "H", [90])]


@pytest.mark.parametrize("packing", [5, 32773, 50000])
def test_packings(tmp_path, packing):
    rng = np.random.default_rng(3)
    values = np.where(rng.random((90, 70)) < 0.6, 5, rng.integers(0, 60_000, (90, 70))).astype("<u2")
    import zstandard

    raw = {5: lzw, 32773: packbits, 50000: zstandard.ZstdCompressor().compress}[packing](values.tobytes())
    path = stored(tmp_path / "a.tif", raw, [*BASE, (258, "H", [16]), (259, "H", [packing])])
    assert (image(path)[0] == values).all()


@pytest.mark.parametrize("kind", ["f4", "f8", "f2"])
def test_floating_point_predictor(tmp_path, kind):
    values = np.random.default_rng(1).normal(0, 50, (90, 70)).astype("<" + kind)
    size = values.dtype.itemsize
    planes = values.astype(">" + kind).view(np.uint8).reshape(90, 70, size).transpose(0, 2, 1).reshape(90, -1)
    diff = np.concatenate([planes[:, :1], np.diff(planes.astype(np.int16), axis=1).astype(np.uint8)], axis=1)
    path = stored(tmp_path / "a.tif", zlib.compress(diff.tobytes()), [*BASE, (258, "H", [size * 8]), (339, "H", [3]), (259, "H", [8]), (317, "H", [3])])
    assert (image(path)[0] == values).all()


@pytest.mark.parametrize("fields", [[(258, "H", [16]), (259, "H", [7])], [(258, "H", [12])], [(258, "H", [16]), (317, "H", [9])], [(258, "H", [32]), (339, "H", [3]), (317, "H", [2])]])
def test_unsupported_files_raise(tmp_path, fields):
    path = stored(tmp_path / "odd.tif", bytes(90 * 70 * 4), [*BASE, *fields])
    with pytest.raises(ValueError):
        image(path)


def test_places_and_systems(tmp_path):
    bare = [*BASE, (258, "H", [8])]
    keys = lambda *k: (34735, "H", [1, 1, 0, len(k), *(v for q in k for v in q)])
    tie = [(33550, "d", [10.0, 20.0, 0.0]), (33922, "d", [0.0, 0.0, 0.0, 500.0, 900.0, 0.0])]
    told = lambda *more: dict(zip([c.split(" ")[0] for c in gt.METADATA.split(", ")], gt.metadata(stored(tmp_path / "x.tif", bytes(6300), [*bare, *more]))))
    assert [told()[k] for k in ("crs", "a", "e", "c", "nodata")] == [None] * 5
    m = told(*tie, keys((1025, 0, 1, 2), (3072, 0, 1, 32737)))
    assert (m["crs"], m["a"], m["e"], m["c"], m["f"]) == ("EPSG:32737", 10.0, -20.0, 495.0, 910.0)
    m = told(*tie, keys((2048, 0, 1, 4326)), (42113, "s", b"-9999\0"))
    assert (m["crs"], m["c"], m["f"], m["nodata"]) == ("EPSG:4326", 500.0, 900.0, -9999.0)
    m = told((34264, "d", [1.0, 2.0, 0.0, 3.0, 4.0, -5.0, 0.0, 6.0, *[0.0] * 7, 1.0]), keys((3072, 0, 1, 32767), (1026, 34737, 5, 0)), (34737, "s", b"Mine|\0"))
    assert ([m[k] for k in "abcdef"], m["crs"]) == ([1.0, 2.0, 3.0, 4.0, -5.0, 6.0], "Mine")


def test_jpeg_2000_metadata(tmp_path, spark):
    inner = tmp_path / "inner.tif"
    stored(inner, b"", [(256, "H", [1]), (257, "H", [1]), (33550, "d", [10.0, 10.0, 0.0]), (33922, "d", [0.0, 0.0, 0.0, 7.0, 8.0, 0.0]), (34735, "H", [1, 1, 0, 1, 3072, 0, 1, 32737])])
    box = lambda kind, data: struct.pack(">I4s", 8 + len(data), kind) + data
    data = box(b"jP  ", b"\r\n\x87\n") + box(b"jp2h", box(b"ihdr", struct.pack(">IIHBBBB", 30, 40, 1, 15, 7, 0, 0))) + box(b"uuid", gt._GEO_BOX + inner.read_bytes()) + box(b"jp2c", b"codestream")
    (tmp_path / "T37MBN_20170718T075211_B02_10m.jp2").write_bytes(data)
    inner.unlink()
    m = gt.read_grids(spark, str(tmp_path)).first()
    assert (m.driver, m.crs, m.width, m.height, m.band_count, m.dtype, m.a, m.e, m.c, m.f) == ("JP2", "EPSG:32737", 40, 30, 1, "uint16", 10.0, -10.0, 7.0, 8.0)
    with pytest.raises(Exception, match="JPEG 2000"):
        gt.read_rasters(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("big", [False, True])
def test_rasters_written_from_pixels(spark, tmp_path, big):
    """Several rasters, bands and tiles, gaps, casts and pixels that belong nowhere."""
    rng = np.random.default_rng(2)
    values = {"one": rng.integers(0, 60_000, (2, 70, 40)), "two": rng.integers(0, 300, (1, 16, 16))}
    rows = [(k, b + 1, r, c, float(v[b, r, c])) for k, v in values.items() for b in range(len(v)) for r in range(v.shape[1]) for c in range(v.shape[2]) if not (k == "one" and (r < 32 or (r, c) == (40, 5)))]
    rows += [("one", 1, 70, 0, 1.0), ("one", 1, -1, 0, 1.0), ("none", 1, 0, 0, 1.0), ("one", 2, 40, 5, None), ("two", 1, 3, 3, -1.0), ("two", 1, 3, 3, 70_000.0)]
    pixels = spark.createDataFrame(rows, "raster_id string, band int, row_idx long, col_idx long, value double").repartition(7)
    grids = spark.createDataFrame([("one", 40, 70, 10.0, -10.0, 5.0, 900.0, "EPSG:32737", 7.0, 2), ("two", 16, 16, 1.0, -1.0, 0.0, 0.0, None, None, 1), ("empty", 20, 20, 1.0, -1.0, 0.0, 0.0, "EPSG:4326", None, 1)], "raster_id string, width int, height int, a double, e double, c double, f double, crs string, nodata double, band_count int")
    gt.write_rasters(pixels, grids, str(tmp_path / "out"), "uint16", 32, most=-1 if big else gt.BIG)
    want = {k: v.astype(float) for k, v in values.items()} | {"empty": np.zeros((1, 20, 20))}
    want["one"][:, :32] = want["one"][:, 40, 5] = 7.0
    want["two"][0, 3, 3] = 65535.0
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["empty.tif", "one.tif", "two.tif"]
    assert ((tmp_path / "out" / "one.tif").read_bytes()[2] == 43) == big
    for k, v in want.items():
        assert (image(str(tmp_path / "out" / f"{k}.tif")) == v).all()
    meta = {m.raster_id: m for m in gt.read_grids(spark, str(tmp_path / "out")).collect()}
    assert (meta["one"].crs, meta["one"].a, meta["one"].f, meta["one"].nodata, meta["one"].band_count) == ("EPSG:32737", 10.0, 900.0, 7.0, 2)
    part = gt.pixels_of(gt.read_rasters(spark, str(tmp_path / "out" / "one*"), window="30,60,5,5", bands="2"))
    got = {(r.row_idx, r.col_idx): r.value for r in part.collect()}
    assert set(got) == {(r, c) for r in range(32, 70) for c in range(40)} and got[64, 33] == want["one"][1, 64, 33]


def test_no_files(spark, tmp_path):
    assert gt.read_rasters(spark, str(tmp_path)).count() == gt.read_grids(spark, str(tmp_path / "*.tif")).count() == 0


def test_class_map(spark, tmp_path):
    pixels = spark.createDataFrame([("m", r, c, (r + c) % 7) for r in range(9) for c in range(5)], "raster_id string, row_idx long, col_idx long, prediction int")
    grid = spark.createDataFrame([("m", 5, 9, 1.0, -1.0, 0.0, 0.0)], "raster_id string, width int, height int, a double, e double, c double, f double")
    gt.write_class_map(pixels, grid, f"file://{tmp_path}/maps")
    assert gt.metadata(str(tmp_path / "maps" / "m.tif"))[7] == "uint8"
    assert (image(str(tmp_path / "maps" / "m.tif"))[0] == np.add.outer(range(9), range(5)) % 7).all()


def test_stream_equals_batch(spark, tmp_path):
    schema = "row_idx bigint, col_idx bigint, red int, nir int, scl int"
    pixels = spark.createDataFrame([(i, j, i * 7 % 50, j * 11 % 60, (i + j) % 12) for i in range(20) for j in range(10)], schema)
    pixels.repartition(4).write.parquet(str(tmp_path / "in"))
    build = lambda df: st.indexed(df, ["red", "nir"], {"ndvi": ("ndvi", ["red", "nir"])}, "scl", [3, 8])
    query = st.write_stream(build(st.pixel_stream(spark, str(tmp_path / "in"), schema, 1)), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert query.exception() is None
    got, want = (sorted(map(tuple, df.collect())) for df in (spark.read.parquet(str(tmp_path / "out")), build(pixels)))
    assert got == want
