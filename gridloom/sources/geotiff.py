"""GeoTIFF files as a Spark data source: ``spark.read.format("geotiff").load(path)``.

Reads classic and big files, striped or tiled, chunky or planar, with integers of
8 to 64 bits or floats of 16 to 64, uncompressed or packed by LZW, deflate,
PackBits or Zstandard, with either predictor. Every strip or tile is a row
(raster_id, path, band, row_off, col_off, height, width, data); a task seeks
straight to its blocks, and a large file is read by many tasks. Options:
``metadata`` (one row of grid metadata a file), ``bands`` ("1,3") and ``window``
("col_off,row_off,width,height"), which leave out blocks that are not asked for.
What cannot be decoded is a ``ValueError`` that names the file.

Writes rows (raster_id, part, data) as :func:`write_rasters` makes them: the
header as part -1, then the packed tiles in order, so a task streams a file of
any size without seeking. JPEG 2000 files have their metadata read, not their
pixels.
"""

from __future__ import annotations

import os
import posixpath
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from gridloom.functions.numeric import wrap_cast

#: Sizes of TIFF field types, and the tags that are read.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8, 17: 8, 18: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, PER_PIXEL, ROWS, COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_W, TILE_H, TILE_OFFSETS, TILE_COUNTS, FORMAT, SCALE, TIE, MATRIX, KEYS, KEY_TEXT, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34264, 34735, 34737, 42113
#: Keys of the geographic directory, and the box that holds it in JPEG 2000 files.
_PROJECTED, _GEOGRAPHIC, _RASTER_TYPE, _CITATIONS = 3072, 2048, 1025, (1026, 2049, 3073)
_GEO_BOX = bytes.fromhex("b14bf8bd083d4b43a5ae8cd7d5a6ce03")

BLOCKS = "raster_id string, path string, band int, row_off bigint, col_off bigint, height int, width int, data array<double>"
METADATA = "raster_id string, path string, driver string, crs string, width int, height int, band_count int, dtype string, a double, b double, c double, d double, e double, f double, nodata double"
#: Stored bytes that one task reads, about.
TASK_BYTES = 8_000_000
#: Sizes from which a file is written with 64 bit offsets.
BIG = 4_000_000_000
#: Pixels that a task gathers by tiles at a time, and rows that it then passes on at once.
GATHERED, GATHERED_ROWS = 500_000, 10_000


def _fs(path: str):
    """File system and path within it, of a local path or a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]+:", path) else (fs.LocalFileSystem(), os.path.abspath(path))


def _open(path: str):
    fs, at = _fs(path)
    return fs.open_input_file(at)


def list_rasters(path: str, pattern: str = r"\.(tiff?|jp2)$") -> list[tuple[str, int]]:
    """``(path, bytes)`` of a file, of a folder's raster files, or of those that a wildcard in the last part fits."""
    from pyarrow import fs as pafs

    from gridloom.functions.names import wildcard

    fs, at = _fs(path)
    lead = path[: path.index(at)] if at in path else ""
    info = fs.get_file_info([at])[0]
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    if info.type == pafs.FileType.NotFound:
        at, pattern = posixpath.dirname(at), wildcard(posixpath.basename(at))
    found = fs.get_file_info(pafs.FileSelector(at, allow_not_found=True))
    return sorted((lead + f.path, f.size) for f in found if f.type == pafs.FileType.File and re.search(pattern, f.base_name))


def _tags(f, start: int = 0) -> dict:
    """Tags of the first image of an open file whose TIFF header stands at ``start``; its byte order under ``order``."""
    f.seek(start)
    head = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    magic = struct.unpack(order + "H", head[2:4])[0] if order and len(head) >= 8 else 0
    if magic not in (42, 43):
        raise ValueError("no TIFF file")
    big = magic == 43
    f.seek(start + struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0])
    n = struct.unpack(order + ("Q" if big else "H"), f.read(8 if big else 2))[0]
    width, inline = (20, 8) if big else (12, 4)
    entries = f.read(width * n)
    tags: dict = {"order": order}
    for at in range(0, len(entries), width):
        tag, kind, count = struct.unpack(order + ("HHQ" if big else "HHI"), entries[at : at + width - inline])
        size, raw = _SIZES.get(kind, 0) * count, entries[at + width - inline : at + width]
        if size > inline:
            f.seek(start + struct.unpack(order + ("Q" if big else "I"), raw)[0])
            raw = f.read(size)
        if kind == 2:
            tags[tag] = raw[:size].split(b"\0")[0].decode("latin-1")
        elif kind in _CODES:
            tags[tag] = struct.unpack(f"{order}{count}{_CODES[kind]}", raw[:size])
    return tags


def header(path: str) -> dict:
    """Tags of the first image of a file, and its byte order under ``order``."""
    with _open(path) as f:
        try:
            return _tags(f)
        except (ValueError, struct.error) as e:
            raise ValueError(f"{path} is no TIFF file") from e


def _dtype(tags: dict) -> np.dtype:
    kind, bits = tags.get(FORMAT, (1,))[0], tags.get(BITS, (1,))[0]
    if kind not in (1, 2, 3) or bits not in ((16, 32, 64) if kind == 3 else (8, 16, 32, 64)) or len({*tags.get(BITS, ())}) != 1:
        raise ValueError(f"samples of format {kind} and {tags.get(BITS)} bits are not supported")
    return np.dtype(f"{tags['order']}{'uif'[kind - 1]}{bits // 8}")


def geo_keys(tags: dict) -> dict:
    """Keys of the geographic directory: numbers and texts."""
    flat = tags.get(KEYS, ())
    keys = {}
    for at in range(4, len(flat) - 3, 4):
        key, where, count, value = flat[at : at + 4]
        keys[key] = value if where == 0 else tags.get(KEY_TEXT, "")[value : value + count].rstrip("|") if where == KEY_TEXT else None
    return keys


def crs_of(tags: dict) -> str | None:
    """``EPSG:n`` of a coded system, else its citation, None without either."""
    keys = geo_keys(tags)
    for key in (_PROJECTED, _GEOGRAPHIC):
        if keys.get(key) not in (None, 32767):
            return f"EPSG:{keys[key]}"
    return next((keys[k] for k in _CITATIONS if isinstance(keys.get(k), str) and keys[k]), None)


def transform_of(tags: dict) -> tuple | None:
    """``(a, b, c, d, e, f)`` from pixel corners to the plane, None if the file states none."""
    if MATRIX in tags:
        m = tags[MATRIX]
        a, b, c, d, e, f = m[0], m[1], m[3], m[4], m[5], m[7]
    elif SCALE in tags and TIE in tags:
        a, e, tie = tags[SCALE][0], -tags[SCALE][1], tags[TIE]
        b, d, c, f = 0.0, 0.0, tie[3] - tie[0] * a, tie[4] - tie[1] * e
    else:
        return None
    if geo_keys(tags).get(_RASTER_TYPE) == 2:  # the tie is a pixel's centre
        c, f = c - (a + b) / 2, f - (d + e) / 2
    return a, b, c, d, e, f


def metadata(path: str) -> tuple:
    """The row of METADATA of a file; places are null where the file states none."""
    if path.lower().endswith((".jp2", ".j2k")):
        return _jp2_metadata(path)
    tags = header(path)
    text = tags.get(NODATA, "").strip()
    return (_stem(path), path, "GTiff", crs_of(tags), tags[WIDTH][0], tags[HEIGHT][0], tags.get(PER_PIXEL, (1,))[0], _dtype(tags).name, *(transform_of(tags) or [None] * 6), float(text) if text else None)


def _jp2_metadata(path: str) -> tuple:
    """Size, bands and sample type from the image header box, the place from the embedded directory."""
    size, geo = None, {}
    with _open(path) as f:
        stack = [(0, f.size())]
        while stack:
            at, end = stack.pop()
            while at + 8 <= end:
                f.seek(at)
                head = f.read(16)
                length, kind = struct.unpack(">I4s", head[:8])
                skip = 8
                if length == 1:
                    length, skip = struct.unpack(">Q", head[8:16])[0], 16
                stop = end if length == 0 else at + length
                if kind == b"jp2h":
                    stack.append((at + skip, stop))
                elif kind == b"ihdr":
                    f.seek(at + skip)
                    size = struct.unpack(">IIHB", f.read(11))
                elif kind == b"uuid":
                    f.seek(at + skip)
                    if f.read(16) == _GEO_BOX:
                        geo = _tags(f, at + skip + 16)
                if stop <= at:
                    break
                at = stop
    if size is None:
        raise ValueError(f"{path} is no JPEG 2000 file")
    height, width, bands, depth = size
    kind = f"{'int' if depth & 128 else 'uint'}{8 if (depth & 127) < 8 else 16 if (depth & 127) < 16 else 32}"
    return (_stem(path), path, "JP2", crs_of(geo) if geo else None, width, height, bands, kind, *((geo and transform_of(geo)) or [None] * 6), None)


def _stem(path: str) -> str:
    return posixpath.splitext(posixpath.basename(path))[0]


def blocks(path: str) -> list[tuple]:
    """``(position, byte count, band or 0 for all, row_off, col_off, height, width of the stored block)``."""
    return _blocks(header(path))


def _blocks(t: dict) -> list[tuple]:
    width, height, bands = t[WIDTH][0], t[HEIGHT][0], t.get(PER_PIXEL, (1,))[0]
    tiled = TILE_OFFSETS in t
    bw, bh = (t[TILE_W][0], t[TILE_H][0]) if tiled else (width, min(t.get(ROWS, (height,))[0], height))
    across, down = -(-width // bw), -(-height // bh)
    out = []
    for i, (at, size) in enumerate(zip(t[TILE_OFFSETS if tiled else OFFSETS], t[TILE_COUNTS if tiled else COUNTS])):
        plane, k = divmod(i, across * down)
        row, col = divmod(k, across)
        band = plane + 1 if t.get(PLANAR, (1,))[0] == 2 and bands > 1 else 0
        stored = bh if tiled else min(bh, height - row * bh)
        out.append((at, size, band, row * bh, col * bw, stored, bw))
    return out


def unpack(raw: bytes, packing: int) -> bytes:
    """The bytes of a stored block; an unknown packing is a ``ValueError``."""
    if packing == 1:
        return raw
    if packing in (8, 32946):
        return zlib.decompress(raw)
    if packing == 5:
        return _lzw(raw)
    if packing == 32773:
        return _packbits(raw)
    if packing == 50000:
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    raise ValueError(f"compression {packing} is not supported")


def _packbits(raw: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += raw[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def _lzw(raw: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; 256 starts anew, 257 ends."""
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, last = list(base), [], b""
    width, held, bits = 9, 0, 0
    for byte in raw:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 256:
            table, width, last = list(base), 9, b""
            continue
        if code == 257:
            break
        if code < len(table):
            word = table[code]
        elif code == len(table) and last:
            word = last + last[:1]
        else:
            raise ValueError("broken LZW data")
        out.append(word)
        if last:
            table.append(last + word[:1])
        last = word
        # the width grows one code early
        width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return b"".join(out)


def read_block(path: str, tags: dict, block: tuple, wanted: set | None = None, file=None) -> Iterator[tuple]:
    """Rows of one block: one per (wanted) band, cut to the image. A block that is not stored holds nodata, else 0."""
    at, size, band, row_off, col_off, bh, bw = block
    bands = tags.get(PER_PIXEL, (1,))[0]
    depth, dtype = (1 if band else bands), _dtype(tags)
    if wanted is not None and not (wanted & ({band} if band else set(range(1, bands + 1)))):
        return
    if size:
        if file is None:
            with _open(path) as f:
                f.seek(at)
                raw = f.read(size)
        else:
            file.seek(at)
            raw = file.read(size)
        try:
            values = _decoded(unpack(raw, tags.get(COMPRESSION, (1,))[0]), dtype, bh, bw, depth, tags.get(PREDICTOR, (1,))[0])
        except (ValueError, zlib.error) as e:
            raise ValueError(f"{path}: {e}") from e
    else:
        text = tags.get(NODATA, "").strip()
        values = np.full((bh, bw, depth), float(text) if text else 0.0)
    values = values[: tags[HEIGHT][0] - row_off, : tags[WIDTH][0] - col_off]
    for k in range(depth):
        one = values[:, :, k]
        if wanted is None or (band or k + 1) in wanted:
            yield (_stem(path), path, band or k + 1, row_off, col_off, one.shape[0], one.shape[1], one.astype(float).ravel())


def _decoded(raw: bytes, dtype: np.dtype, bh: int, bw: int, depth: int, predictor: int) -> np.ndarray:
    size = bh * bw * depth
    if predictor == 3:
        if dtype.kind != "f":
            raise ValueError("predictor 3 needs floats")
        sums = np.cumsum(np.frombuffer(raw, np.uint8, size * dtype.itemsize).reshape(bh, -1, depth), axis=1, dtype=np.uint8)
        planes = sums.reshape(bh, dtype.itemsize, bw * depth)  # bytes of equal weight side by side, the highest first
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(bh, bw, depth)
    values = np.frombuffer(raw, dtype=dtype, count=size).reshape(bh, bw, depth)
    if predictor == 2:
        if dtype.kind == "f":
            raise ValueError("predictor 2 needs integers")
        return np.cumsum(values, axis=1, dtype=values.dtype)
    if predictor != 1:
        raise ValueError(f"predictor {predictor} is not supported")
    return values


class _Part(InputPartition):
    """The ``share``-th of ``shares`` parts of a file's blocks."""

    def __init__(self, path: str, share: int, shares: int):
        self.path, self.share, self.shares = path, share, shares


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.only_metadata = str(options.get("metadata", "false")).lower() == "true"
        self.path = options["path"]
        self.bands = {int(b) for b in options["bands"].split(",")} if options.get("bands") else None
        self.window = tuple(int(v) for v in options["window"].split(",")) if options.get("window") else None

    def partitions(self) -> list[InputPartition]:
        """Planned from the listing alone; headers are read by the tasks."""
        files = list_rasters(self.path)
        if self.only_metadata:
            return [_Part(p, 0, 1) for p, _ in files]
        return [_Part(p, k, n) for p, size in files for n in [max(1, -(-size // TASK_BYTES))] for k in range(n)]

    def read(self, part: _Part | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # there is no file
            return
        if self.only_metadata:
            kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
            columns = [c.split(" ") for c in METADATA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([v], kinds[k]) for v, (_, k) in zip(metadata(part.path), columns)], names=[c for c, _ in columns])
            return
        if part.path.lower().endswith((".jp2", ".j2k")):
            raise ValueError(f"{part.path}: pixels of JPEG 2000 files are not decoded, convert them to GeoTIFF")
        tags = header(part.path)
        every = [b for b in _blocks(tags) if self._meets(b)]
        lo, hi = (len(every) * k // part.shares for k in (part.share, part.share + 1))
        with _open(part.path) as file:
            for block in every[lo:hi]:
                for row in read_block(part.path, tags, block, self.bands, file):
                    *flat, data = row
                    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                    lists = pa.ListArray.from_arrays(pa.array([0, len(data)], pa.int32()), pa.array(data))
                    yield pa.RecordBatch.from_arrays([*(pa.array([v], k) for v, k in zip(flat, kinds)), lists], names=["raster_id", "path", "band", "row_off", "col_off", "height", "width", "data"])

    def _meets(self, block: tuple) -> bool:
        if self.window is None:
            return True
        col, row, width, height = self.window
        _, _, _, row_off, col_off, bh, bw = block
        return col_off < col + width and col < col_off + bw and row_off < row + height and row < row_off + bh


class _Done(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class _Writer(DataSourceWriter):
    """Parts of a file, in order, to a name of its own; files get their names when all are there."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> _Done:
        fs, folder = _fs(self.path)
        fs.create_dir(folder)
        files, out, now, last = [], None, None, -2
        try:
            for raster, part, data in iterator:
                if raster != now:
                    if out:
                        out.close()
                    now, last = raster, -2
                    files.append((f"{folder}/.{raster}-{uuid.uuid4().hex}.part", f"{folder}/{raster}.tif"))
                    out = fs.open_output_stream(files[-1][0])
                if part <= last or (last == -2 and part != -1):
                    raise ValueError(f"{raster}: parts out of order")
                last = part
                out.write(data)
        finally:
            if out:
                out.close()
        return _Done(files)

    def commit(self, messages) -> None:
        fs, _ = _fs(self.path)
        for m in messages:
            for part, final in m.files if m else ():
                fs.move(part, final)

    def abort(self, messages) -> None:
        fs, _ = _fs(self.path)
        for m in messages:
            for part, _ in m.files if m else ():
                fs.delete_file(part)


class GeoTiffSource(DataSource):
    """Register with ``spark.dataSource.register(GeoTiffSource)``."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return METADATA if str(self.options.get("metadata", "false")).lower() == "true" else BLOCKS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def read_rasters(spark, path: str, **options) -> DataFrame:
    """The data source, registered: blocks, or with ``metadata="true"`` grids."""
    spark.dataSource.register(GeoTiffSource)
    return spark.read.format("geotiff").options(**options).load(path)


def pixels_of(blocks: DataFrame) -> DataFrame:
    """``(raster_id, band, row_idx, col_idx, value)`` of blocks, without a shuffle."""
    out = blocks.select("raster_id", "band", "row_off", "col_off", "width", F.posexplode("data").alias("pos", "value"))
    row, col = F.col("row_off") + F.floor(F.col("pos") / F.col("width")), F.col("col_off") + F.col("pos") % F.col("width")
    return out.select("raster_id", "band", row.alias("row_idx"), col.alias("col_idx"), "value")


def read_grids(spark, path: str) -> DataFrame:
    """Grid metadata of the files, as the grid operators take it."""
    return read_rasters(spark, path, metadata="true")


def _head(width: int, height: int, bands: int, dtype: np.dtype, layout: list, counts: list[int], compress: bool, place: tuple | None, crs: str | None, nodata: float | None, most: int = BIG) -> bytes:
    """Header and directory that stand before the blocks of a planar, little-endian file."""
    big = sum(counts) > most
    offset, inline = ("Q", 8) if big else ("I", 4)
    text = b"" if nodata is None else f"{nodata:.17g}".encode() + b"\0"
    fields = [
        (WIDTH, "I", [width]), (HEIGHT, "I", [height]), (BITS, "H", [dtype.itemsize * 8] * bands), (COMPRESSION, "H", [8 if compress else 1]), (262, "H", [1]), (PER_PIXEL, "H", [bands]),
        (PLANAR, "H", [2]), (FORMAT, "H", [{"u": 1, "i": 2, "f": 3}[dtype.kind]] * bands), *layout,
    ]
    if place is not None:
        a, b, c, d, e, f = place
        fields += [(SCALE, "d", [a, -e, 0.0]), (TIE, "d", [0.0, 0.0, 0.0, c, f, 0.0])] if not b and not d and e < 0 < a else [(MATRIX, "d", [a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0])]
    code = re.fullmatch(r"\s*EPSG\s*:\s*(\d+)\s*", crs or "", re.I)
    if code:
        geographic = 4000 <= int(code[1]) < 5000
        fields += [(KEYS, "H", [1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, _RASTER_TYPE, 0, 1, 1, _GEOGRAPHIC if geographic else _PROJECTED, 0, 1, int(code[1])])]
    elif crs:
        name = crs.encode("ascii", "replace") + b"|\0"
        fields += [(KEYS, "H", [1, 1, 0, 2, _RASTER_TYPE, 0, 1, 1, _CITATIONS[0], KEY_TEXT, len(name) - 1, 0]), (KEY_TEXT, "s", name)]
    if text:
        fields.append((NODATA, "s", text))
    tiled = any(tag == TILE_W for tag, _, _ in layout)
    fields += [(TILE_OFFSETS if tiled else OFFSETS, offset, [0] * len(counts)), (TILE_COUNTS if tiled else COUNTS, offset, counts)]
    fields.sort()
    start = (16 + 8 + 20 * len(fields) + 8) if big else (8 + 2 + 12 * len(fields) + 4)
    size = lambda code, data: len(data) * {"H": 2, "I": 4, "d": 8, "Q": 8, "s": 1}[code]
    first = start + sum(size(c, v) + size(c, v) % 2 for _, c, v in fields if size(c, v) > inline)
    places = np.concatenate([[first], first + np.cumsum(counts, dtype=np.int64)[:-1]]) * (np.array(counts) > 0)
    entries, extra = b"", b""
    for tag, c, data in fields:
        data = places.tolist() if tag in (TILE_OFFSETS, OFFSETS) else data
        raw = data if c == "s" else struct.pack(f"<{len(data)}{c}", *data)
        kind = {"H": 3, "I": 4, "d": 12, "Q": 16, "s": 2}[c]
        value = raw.ljust(inline, b"\0") if len(raw) <= inline else struct.pack("<" + offset, start + len(extra))
        extra += b"" if len(raw) <= inline else raw + b"\0" * (len(raw) % 2)
        entries += struct.pack("<HHQ" if big else "<HHI", tag, kind, len(data)) + value
    lead = struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) + struct.pack("<Q", len(fields)) if big else struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", len(fields))
    return lead + entries + struct.pack("<" + offset, 0) + extra


def _some(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together until they have ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of ``values[ends[k] : ends[k + 1]]`` as one binary each."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def write_rasters(pixels: DataFrame, grids: DataFrame, path: str, dtype: str = "uint16", block: int = 256, compress: bool = True, most: int = BIG) -> None:
    """One tiled file ``<raster_id>.tif`` a raster, band by band.

    ``pixels`` is ``(raster_id, band, row_idx, col_idx, value)``, ``grids`` has
    raster_id, width, height, a, c, e, f and optionally b, d, crs, nodata and
    band_count (else the highest band of the pixels). Values are cast as a C
    compiler would; cells without a row or with a null hold nodata, else 0, and a
    tile without any is not stored. Pixels outside the grid or of no grid are
    left out; a grid without pixels is written empty. Of several rows of one cell
    the largest value is kept. Of more than ``most`` bytes a file has 64 bit
    offsets.

    Every task gathers the pixels of a tile that it has before they are moved.
    Tiles are packed where their pixels meet, side by side; only their sizes, one
    row a raster, go into the headers, and one task a raster streams header and
    tiles to the file.
    """
    from gridloom.session import cut, discard

    kind = np.dtype(dtype).newbyteorder("<")
    have = set(grids.columns)
    column = lambda c, t: (F.col(c) if c in have else F.lit(None)).cast(t).alias(c)
    grid = grids.select("raster_id", *[F.col(c).cast("int").alias(c) for c in ("width", "height")], *[column(c, "double") for c in "abcdef"], column("crs", "string"), column("nodata", "double"), column("band_count", "int"))
    grid = cut(grid, "grids")  # its size is known then, so a few grids are sent to the pixels and not these to one task a grid
    placed = pixels.select("raster_id", "band", "row_idx", "col_idx", "value").join(grid.select("raster_id", "width", "height", "nodata"), "raster_id").filter("row_idx >= 0 and col_idx >= 0 and row_idx < height and col_idx < width and band >= 1 and value is not null")
    across = F.ceil(F.col("width") / block)
    tile = F.floor(F.col("row_idx") / block) * across + F.floor(F.col("col_idx") / block)
    cell = ((F.col("row_idx") % block) * block + F.col("col_idx") % block).cast("int")
    value = F.col("value").cast("double") if kind.kind == "f" else wrap_cast(F.col("value"), dtype).cast("bigint")
    cells = placed.select("raster_id", F.col("band").cast("int").alias("band"), tile.cast("bigint").alias("tile"), cell.alias("cell"), value.alias("value"), "nodata")

    held = np.dtype("<i8") if kind.kind in "iu" and kind.itemsize == 8 else kind

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _some(batches, GATHERED):
            names = rows.column("raster_id").combine_chunks().dictionary_encode()
            raster, band, tile = (c.to_numpy(zero_copy_only=False) for c in (names.indices, rows.column("band").combine_chunks(), rows.column("tile").combine_chunks()))
            order = np.lexsort((tile, band, raster))
            new = np.flatnonzero(np.append(True, (np.diff(raster[order]) != 0) | (np.diff(band[order]) != 0) | (np.diff(tile[order]) != 0)))
            first, ends = pa.array(order[new]), np.append(new, len(order))
            lists = [_binaries(v.to_numpy()[order].astype(t), ends) for v, t in ((rows.column("cell"), "<i4"), (rows.column("value"), held))]
            for at in range(0, len(new), GATHERED_ROWS):
                own = first.slice(at, GATHERED_ROWS)
                keys = [names.take(own).cast(pa.string()), *(rows.column(c).combine_chunks().take(own) for c in ("band", "tile", "nodata"))]
                yield pa.RecordBatch.from_arrays([*keys, *(v.slice(at, GATHERED_ROWS) for v in lists)], names=["raster_id", "band", "tile", "nodata", "cells", "data"])

    def pack(table: pa.Table) -> pa.Table:
        fill = table.column("nodata")[0].as_py()
        data = np.full(block * block, 0 if fill is None else fill, dtype=kind)
        cell, value = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("cells", "<i4"), ("data", held)))
        order = np.argsort(value, kind="stable")
        data[cell[order]] = value[order].astype(kind)
        raw = zlib.compress(data.tobytes(), 6) if compress else data.tobytes()
        return pa.table({"raster_id": table.column("raster_id").slice(0, 1), "band": table.column("band").slice(0, 1), "tile": table.column("tile").slice(0, 1), "data": pa.array([raw], pa.binary())})

    met = cells.mapInArrow(gather, "raster_id string, band int, tile bigint, nodata double, cells binary, data binary")
    packed = cut(met.groupBy("raster_id", "band", "tile").applyInArrow(pack, "raster_id string, band int, tile bigint, data binary"), "tiles")
    sizes = packed.groupBy("raster_id").agg(F.max("band").alias("top"), F.collect_list(F.struct("band", "tile", F.length("data").alias("n"))).alias("sizes"))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for r in rows:
                bands = r["band_count"] or r["top"] or 1
                each = -(-r["width"] // block) * -(-r["height"] // block)
                counts = [0] * (bands * each)
                for s in r["sizes"] or ():
                    if s["band"] <= bands:
                        counts[(s["band"] - 1) * each + s["tile"]] = s["n"]
                place = None if r["a"] is None else (r["a"], r["b"] or 0.0, r["c"], r["d"] or 0.0, r["e"], r["f"])
                out.append((_head(r["width"], r["height"], bands, kind, [(TILE_W, "I", [block]), (TILE_H, "I", [block])], counts, compress, place, r["crs"], r["nodata"], most), bands, each))
            yield pa.RecordBatch.from_arrays([
                batch.column("raster_id"), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int64()), pa.array([o[0] for o in out], pa.binary())
            ], names=["raster_id", "bands", "each", "data"])

    made = cut(grid.join(sizes, "raster_id", "left").mapInArrow(heads, "raster_id string, bands int, each bigint, data binary"), "heads")
    body = packed.join(made.select("raster_id", "bands", "each"), "raster_id").filter("band <= bands").select("raster_id", ((F.col("band") - 1) * F.col("each") + F.col("tile")).alias("part"), "data")
    parts = made.select("raster_id", F.lit(-1).cast("bigint").alias("part"), "data").unionByName(body)
    grids.sparkSession.dataSource.register(GeoTiffSource)
    parts.repartition("raster_id").sortWithinPartitions("raster_id", "part").write.format("geotiff").mode("append").save(path)
    for made_here in (packed, made, grid):
        discard(made_here)


def write_class_map(pixels: DataFrame, grids: DataFrame, path: str, value: str = "prediction", block: int = 256) -> None:
    """A class map ``(raster_id, row_idx, col_idx, value)`` as a single band of unsigned bytes."""
    long = pixels.select("raster_id", F.lit(1).alias("band"), "row_idx", "col_idx", F.col(value).cast("double").alias("value"))
    write_rasters(long, grids.drop("band_count", "nodata"), path, "uint8", block)


def write_geotiff(path: str, values: np.ndarray, a: float = 1.0, e: float = -1.0, c: float = 0.0, f: float = 0.0, nodata: float | None = None, rows: int = 64, compress: bool = True, crs: str | None = None) -> None:
    """Write one ``(band, row, column)`` array as a planar, striped file."""
    bands, height, width = values.shape
    little = values.astype(values.dtype.newbyteorder("<"))
    strips = [little[b, r : r + rows].tobytes() for b in range(bands) for r in range(0, height, rows)]
    strips = [zlib.compress(s) for s in strips] if compress else strips
    fs, at = _fs(path)
    with fs.open_output_stream(at) as out:
        out.write(_head(width, height, bands, little.dtype, [(ROWS, "I", [rows])], [len(s) for s in strips], compress, (a, 0.0, c, 0.0, e, f), crs, nodata))
        for s in strips:
            out.write(s)
