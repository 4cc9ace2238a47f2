"""Vector files: GeoJSON and shapefiles as tables ``(feature_id, geometry, properties)``.

``geometry`` is GeoJSON or WKT text, which the point and region operators read;
``properties`` is a map of texts.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from gridloom.functions.geometry import parse_point, parse_polygon, ring_area
from gridloom.sources.geotiff import _fs, _open, list_rasters

FEATURES = "feature_id string, geometry string, properties map<string,string>"
#: Records of a shapefile that one task reads.
RECORDS = 200_000
#: Shape kinds by their number modulo 10 (the tens tell heights and measures).
POINT, LINE, POLYGON, MULTIPOINT = 1, 3, 5, 8


# --- GeoJSON ----------------------------------------------------------------------


def read_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Features of collections, one collection a file, or (``lines``) of files with a feature on every line.

    A collection is parsed as one document, so large sets belong into lines.
    Texts that are no features give no rows; a missing id is null.
    """
    one = "id string, geometry string, properties map<string,string>"
    if lines:
        rows = spark.read.text(path).select(F.from_json("value", f"type string, {one}").alias("f")).filter("f.type = 'Feature'")
    else:
        whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"features array<struct<{one.replace(' string', ':string').replace(' map', ':map')}>>").alias("c"))
        rows = whole.select(F.explode("c.features").alias("f"))
    return rows.select(F.col("f.id").alias("feature_id"), F.col("f.geometry").alias("geometry"), F.col("f.properties").alias("properties"))


def point_json(x: Column, y: Column) -> Column:
    """The GeoJSON text of a point."""
    return F.concat(F.lit('{"type":"Point","coordinates":['), x.cast("string"), F.lit(","), y.cast("string"), F.lit("]}"))


def box_json(left: Column, bottom: Column, right: Column, top: Column) -> Column:
    """The GeoJSON text of a box, from its lower left corner against the clock."""
    at = lambda x, y: F.concat(F.lit("["), x.cast("string"), F.lit(","), y.cast("string"), F.lit("]"))
    ring = F.concat_ws(",", at(left, bottom), at(right, bottom), at(right, top), at(left, top), at(left, bottom))
    return F.concat(F.lit('{"type":"Polygon","coordinates":[['), ring, F.lit("]]}"))


def feature_lines(features: DataFrame, geometry: str, properties: list[str]) -> DataFrame:
    """``(value,)``: one GeoJSON feature a row; a null geometry is written as null."""
    shape = F.coalesce(F.col(geometry), F.lit("null"))
    return features.select(F.concat(F.lit('{"type":"Feature","geometry":'), shape, F.lit(',"properties":'), F.to_json(F.struct(*properties), {"ignoreNullFields": "false"}), F.lit("}")).alias("value"))


def write_geojson(features: DataFrame, path: str, geometry: str, properties: list[str]) -> None:
    """A folder of files with one feature a line; ``geometry`` holds GeoJSON text."""
    feature_lines(features, geometry, properties).write.mode("overwrite").text(path)


# --- shapefiles -------------------------------------------------------------------


def read_shapefile(spark: SparkSession, path: str, records: int = RECORDS) -> DataFrame:
    """Features of a ``.shp`` file or of all of a folder, geometry as WKT; its table gives the properties.

    A task reads ``records`` records, which the index finds.
    """
    spark.dataSource.register(ShapefileSource)
    return spark.read.format("shapefile").option("records", str(records)).load(path)


def write_shapefile(features: DataFrame, path: str, geometry: str, properties: list[str], crs: str = "") -> None:
    """One shapefile a task in a folder. ``geometry`` holds WKT or GeoJSON, points or regions, one kind.

    Rows whose geometry cannot be read are written as null shapes.
    """
    features.sparkSession.dataSource.register(ShapefileSource)
    told = F.create_map(*[v for p in properties for v in (F.lit(p), F.col(p).cast("string"))]).cast("map<string,string>")
    rows = features.select(F.lit(None).cast("string").alias("feature_id"), F.col(geometry).alias("geometry"), told.alias("properties"))
    rows.write.format("shapefile").mode("append").option("fields", ",".join(properties)).option("crs", crs).save(path)


def _ring_text(ring: list[tuple]) -> str:
    return "(" + ", ".join(f"{x!r} {y!r}" for x, y in ring) + ")"


def shape_text(record: bytes) -> str | None:
    """WKT of a record's content, None for a null shape; an unknown kind is a ``ValueError``."""
    kind = struct.unpack("<i", record[:4])[0]
    if kind == 0:
        return None
    if kind % 10 == POINT:
        return "POINT ({!r} {!r})".format(*struct.unpack("<2d", record[4:20]))
    if kind % 10 == MULTIPOINT:
        n = struct.unpack("<i", record[36:40])[0]
        flat = struct.unpack(f"<{2 * n}d", record[40 : 40 + 16 * n])
        return "MULTIPOINT " + _ring_text(list(zip(flat[::2], flat[1::2])))
    if kind % 10 not in (LINE, POLYGON):
        raise ValueError(f"shapes of kind {kind} are not supported")
    parts, n = struct.unpack("<2i", record[36:44])
    starts = [*struct.unpack(f"<{parts}i", record[44 : 44 + 4 * parts]), n]
    flat = struct.unpack(f"<{2 * n}d", record[44 + 4 * parts : 44 + 4 * parts + 16 * n])
    points = list(zip(flat[::2], flat[1::2]))
    rings = [points[a:b] for a, b in zip(starts, starts[1:])]
    if kind % 10 == LINE:
        return "MULTILINESTRING (" + ", ".join(map(_ring_text, rings)) + ")"
    # outlines run with the clock, holes against it; a hole belongs to the outline around it
    outer = [r for r in rings if ring_area(r) <= 0] or rings[:1]
    pieces = [[r] for r in outer]
    for hole in (r for r in rings if r not in outer):
        next((p for p in pieces if _holds(p[0], hole[0])), pieces[0]).append(hole)
    texts = ["(" + ", ".join(map(_ring_text, p)) + ")" for p in pieces]
    return f"POLYGON {texts[0]}" if len(texts) == 1 else "MULTIPOLYGON (" + ", ".join(texts) + ")"


def _holds(ring: list[tuple], point: tuple) -> bool:
    odd, (x, y) = False, point
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        odd ^= (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
    return odd


def _table(path: str) -> tuple[int, int, list[tuple[str, int, int]]]:
    """``(start, width, fields (name, offset, size))`` of a table file."""
    with _open(path) as f:
        head = f.read(32)
        start, width = struct.unpack("<HH", head[8:12])
        fields, at = [], 1
        for k in range((start - 33) // 32):
            field = f.read(32)
            if field[:1] == b"\r":
                break
            fields.append((field[:11].split(b"\0")[0].decode("utf-8", "replace"), at, field[16]))
            at += field[16]
    return start, width, fields


class _Records(InputPartition):
    def __init__(self, path: str, first: int, end: int):
        self.path, self.first, self.end = path, first, end


class _Reader(DataSourceReader):
    def __init__(self, path: str, records: int):
        self.path, self.records = path, records

    def partitions(self) -> list[InputPartition]:
        """Ranges of records, as many as the index of each file counts."""
        out: list[InputPartition] = []
        for path, _ in list_rasters(self.path, r"\.shp$"):
            with _open(posixpath.splitext(path)[0] + ".shx") as f:
                n = (f.size() - 100) // 8
            out += [_Records(path, k, min(k + self.records, n)) for k in range(0, n, self.records)]
        return out

    def read(self, part: _Records | None) -> Iterator[tuple]:
        if part is None:  # there is no file
            return
        stem = posixpath.splitext(part.path)[0]
        fs, at = _fs(stem + ".dbf")
        start, width, fields = _table(stem + ".dbf") if fs.get_file_info([at])[0].is_file else (0, 0, [])
        with _open(stem + ".shx") as index, _open(part.path) as shapes:
            index.seek(100 + 8 * part.first)
            places = struct.unpack(f">{2 * (part.end - part.first)}i", index.read(8 * (part.end - part.first)))
            rows = _open(stem + ".dbf") if fields else None
            for k, (place, length) in enumerate(zip(places[::2], places[1::2])):
                shapes.seek(2 * place + 8)
                text, properties = shape_text(shapes.read(2 * length)), {}
                if rows is not None:
                    rows.seek(start + (part.first + k) * width)
                    row = rows.read(width)
                    for name, at, size in fields:
                        properties[name] = row[at : at + size].decode("utf-8", "replace").strip("\0 ") or None
                yield (f"{posixpath.basename(stem)}/{part.first + k + 1}", text, properties)


class _Done(WriterCommitMessage):
    def __init__(self, stem: str | None):
        self.stem = stem


def _shape(text: str | None) -> tuple[int, bytes, tuple | None]:
    """``(kind, content without the kind, bounds)`` of a geometry text."""
    if point := parse_point(text):
        return POINT, struct.pack("<2d", *point), (*point, *point)
    rings = []
    for piece in parse_polygon(text):
        for k, ring in enumerate(piece):
            closed = [*ring, ring[0]]
            rings.append(closed if (ring_area(closed) <= 0) == (k == 0) else closed[::-1])
    if not rings:
        return 0, b"", None
    points = [v for r in rings for v in r]
    xs, ys = [x for x, _ in points], [y for _, y in points]
    bounds = (min(xs), min(ys), max(xs), max(ys))
    starts = [sum(map(len, rings[:k])) for k in range(len(rings))]
    return POLYGON, struct.pack(f"<4d2i{len(rings)}i{2 * len(points)}d", *bounds, len(rings), len(points), *starts, *(c for v in points for c in v)), bounds


class _Writer(DataSourceWriter):
    def __init__(self, path: str, fields: list[str], crs: str):
        self.path, self.fields, self.crs = path, fields, crs

    def write(self, iterator) -> _Done:
        rows = [(_shape(g), [(p or {}).get(f) or "" for f in self.fields]) for _, g, p in iterator]
        if not rows:
            return _Done(None)
        kinds = {k for (k, _, _), _ in rows} - {0}
        if len(kinds) > 1:
            raise ValueError("points and regions do not fit into one shapefile")
        bounds = [b for (_, _, b), _ in rows if b] or [(0.0, 0.0, 0.0, 0.0)]
        box = (min(b[0] for b in bounds), min(b[1] for b in bounds), max(b[2] for b in bounds), max(b[3] for b in bounds))
        head = lambda size: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i4d4d", 1000, next(iter(kinds), 0), *box, 0, 0, 0, 0)
        shapes, index, at = [], [], 50
        for k, ((kind, content, _), _) in enumerate(rows):
            content = struct.pack("<i", kind) + content
            shapes.append(struct.pack(">2i", k + 1, len(content) // 2) + content)
            index.append(struct.pack(">2i", at, len(content) // 2))
            at += 4 + len(content) // 2
        values = [[v.encode()[:254] for v in row] for _, row in rows]
        widths = [max(1, *(len(r[k]) for r in values)) for k in range(len(self.fields))]
        names = [f.encode()[:10].ljust(11, b"\0") + b"C" + bytes(4) + bytes([w]) + bytes(15) for f, w in zip(self.fields, widths)]
        table = struct.pack("<4BIHH20x", 3, 126, 1, 1, len(rows), 33 + 32 * len(names), 1 + sum(widths)) + b"".join(names) + b"\r"
        table += b"".join(b" " + b"".join(v.ljust(w) for v, w in zip(r, widths)) for r in values) + b"\x1a"
        fs, folder = _fs(self.path)
        fs.create_dir(folder)
        stem = f"{folder}/.{uuid.uuid4().hex}"
        body = b"".join(shapes)
        for end, data in ((".shp", head(100 + len(body)) + body), (".shx", head(100 + 8 * len(index)) + b"".join(index)), (".dbf", table), (".cpg", b"UTF-8"), *([(".prj", self.crs.encode())] if self.crs else [])):
            with fs.open_output_stream(stem + end) as out:
                out.write(data)
        return _Done(stem)

    def commit(self, messages) -> None:
        fs, folder = _fs(self.path)
        for k, m in enumerate(m for m in messages if m and m.stem):
            for end in (".shx", ".dbf", ".cpg", *([".prj"] if self.crs else []), ".shp"):
                fs.move(m.stem + end, f"{folder}/part-{k:05d}{end}")

    def abort(self, messages) -> None:
        fs, _ = _fs(self.path)
        for m in messages:
            for end in (".shp", ".shx", ".dbf", ".cpg", ".prj") if m and m.stem else ():
                if fs.get_file_info([m.stem + end])[0].is_file:
                    fs.delete_file(m.stem + end)


class ShapefileSource(DataSource):
    """Register with ``spark.dataSource.register(ShapefileSource)``."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return FEATURES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("records", RECORDS)))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], [f for f in self.options.get("fields", "").split(",") if f], self.options.get("crs", ""))
