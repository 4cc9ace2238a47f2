"""Workflow documents and the composed pipelines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.names import output_name
from gridloom.operators import classify as cl
from gridloom.operators import sampling as sp
from gridloom.operators.grid import total_bounds
from gridloom.operators.raster import CLOUD_CLASSES, FILL, add_indexes, apply_mask, clip_raster, mask_by, mask_values, resample_nearest, select_bands, stack, unstack, window
from gridloom.session import cut
from gridloom.sources import catalog as ct
from gridloom.sources import documents as doc
from gridloom.sources import geotiff as gt

#: The tasks and attributes that a workflow document may name.
TASKS, ATTRIBUTES = ("mask_raster", "ndvi", "extract_pixel_values"), ("inp", "out", "operations")


class WorkflowSpec:
    """A validated document ``{task: {inp, out, operations: {name: {...}}}}``.

    ``strict`` checks every task; otherwise only the first attribute of the first
    task is checked, as older documents rely on. An empty document is valid.
    """

    def __init__(self, document: dict, strict: bool = True):
        self.document = document
        for task, attributes in document.items():
            if task not in TASKS:
                raise ValueError(f"unknown task {task}; known are {TASKS}")
            for name in attributes:
                if name not in ATTRIBUTES:
                    raise ValueError(f"unknown attribute {name} of {task}; known are {ATTRIBUTES}")
                if not strict:
                    return

    def tasks(self) -> list[str]:
        return list(self.document)

    def task(self, name: str) -> dict:
        return self.document[name]

    def source(self, name: str) -> str | None:
        return self.document[name].get("inp")

    def target(self, name: str) -> str | None:
        return self.document[name].get("out")

    def operations(self, name: str) -> list[str] | None:
        got = self.document[name].get("operations")
        return None if got is None else list(got)

    def operation(self, name: str, operation: str) -> dict | None:
        return (self.document[name].get("operations") or {}).get(operation)


class Pipeline:
    """Ordered steps ``DataFrame -> DataFrame``; running them only composes one plan."""

    def __init__(self, steps: list[Callable[[DataFrame], DataFrame]] | None = None):
        self.steps = list(steps or [])

    def add(self, step: Callable[[DataFrame], DataFrame]) -> Pipeline:
        return Pipeline([*self.steps, step])

    def run(self, source: DataFrame, write: Callable[[DataFrame, str], None] | None = None) -> DataFrame:
        """The composed plan; ``write`` is given what a step of a document asks to be written, with the name it asks for."""
        for step in self.steps:
            source = source.transform(step)
            if write is not None and getattr(step, "write", None):
                write(source, step.write)
        return source


#: Operation of a workflow document -> step; parameters come from the document.
STEPS: dict[str, Callable[..., Callable[[DataFrame], DataFrame]]] = {
    "resample": lambda scale=2, **_: lambda df: resample_nearest(df, scale),
    "resample_raster": lambda scale=2, **_: lambda df: resample_nearest(df, scale),
    "get_aoi": lambda window=(0, 0, 1, 1), **_: lambda df: _window(df, *window),
    "binarize": lambda values=(), band="scl", **_: lambda df: _binarize(df, band, list(values)),
}


def _window(df: DataFrame, col_off: int, row_off: int, width: int, height: int) -> DataFrame:
    return window(df, col_off, row_off, width, height)


def _binarize(df: DataFrame, band: str, values: list) -> DataFrame:
    return df.withColumn(band, mask_values(band, values).cast("int"))


def pipeline_of(spec: WorkflowSpec, task: str) -> Pipeline:
    """The steps of one task in document order; an unknown operation is a ``ValueError``."""
    steps = []
    for name in spec.operations(task) or []:
        if name not in STEPS:
            raise ValueError(f"unknown operation {name}; known are {sorted(STEPS)}")
        options = spec.operation(task, name) or {}
        step = STEPS[name](**options)
        step.write = options.get("write")
        steps.append(step)
    return Pipeline(steps)


def stack_scene(fine: DataFrame, coarse: DataFrame, mask: DataFrame | None, area: tuple[int, int, int, int] | None, polygon: Callable[[DataFrame], DataFrame] | None, indexes: dict, scale: float = 2) -> DataFrame:
    """One stack of a scene: coarse bands resampled, cut, masked with 9999, indexes added.

    A window and a polygon exclude each other. The window is cut from the coarse
    bands before they are resampled (its pixels of the coarse grid), so only
    what is needed expands. Masked pixels enter the indexes as values.
    """
    if area is not None and polygon is not None:
        raise ValueError("give a window or a polygon, not both")
    bands_fine = [c for c in fine.columns if c not in ("row_idx", "col_idx")]
    bands_coarse = [c for c in coarse.columns if c not in ("row_idx", "col_idx")]
    if area is not None:
        col_off, row_off, width, height = area
        k = int(scale)
        near = coarse.filter(coarse.row_idx.between(row_off // k, (row_off + height - 1) // k) & coarse.col_idx.between(col_off // k, (col_off + width - 1) // k))
        stacked = window(fine, *area).join(window(resample_nearest(near, scale), *area), ["row_idx", "col_idx"])
    else:
        stacked = fine.join(resample_nearest(coarse, scale), ["row_idx", "col_idx"])
        stacked = polygon(stacked) if polygon is not None else stacked
    if mask is not None:
        cut_mask = window(mask, *area) if area is not None else mask
        stacked = mask_by(stacked, cut_mask, [*bands_fine, *bands_coarse], FILL)
    return add_indexes(stacked, indexes)


# --- scenes on disk ---------------------------------------------------------------


def scene_catalogs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Catalogues of a scene's 10 m and 20 m files; a scene without any is a ``ValueError``."""
    fine, coarse = (ct.scene_catalog(ct.list_files(spark, f"{folder}/{name}")) for name in ("R10m", "R20m"))
    ct.require_matches(fine.unionByName(coarse))
    return fine, coarse


def read_band(spark: SparkSession, path: str, resolution: float, area: tuple[int, int, int, int] | None, region) -> tuple[DataFrame, dict]:
    """``(row_idx, col_idx, value)`` and grid of a single-band file at a resolution, cut to a window or a region.

    The window counts pixels of that resolution; only the stored blocks that it
    needs are read.
    """
    meta = dict(zip([c.split(" ")[0] for c in gt.METADATA.split(", ")], gt.metadata(path)))
    grid = {k: meta[k] for k in ("a", "e", "c", "f", "width", "height", "crs", "nodata", "dtype")}
    if grid["a"] is None:
        raise ValueError(f"{path} states no place")
    scale = grid["a"] / resolution if int(grid["a"]) != resolution else 1
    options = {}
    if area is not None:
        col_off, row_off, width, height = area
        lo = lambda v: int(v / scale)
        options["window"] = f"{lo(col_off)},{lo(row_off)},{lo(col_off + width - 1) - lo(col_off) + 1},{lo(row_off + height - 1) - lo(row_off) + 1}"
    pixels = gt.pixels_of(gt.read_rasters(spark, path, bands="1", **options)).select("row_idx", "col_idx", "value")
    if scale != 1:
        pixels = resample_nearest(pixels, scale, grid["height"], grid["width"])
        grid |= {"a": grid["a"] / scale, "e": grid["e"] / scale, "width": int(grid["width"] * scale), "height": int(grid["height"] * scale)}
    if area is not None:
        at, pixels = area, window(pixels, *area)
    elif region is not None:
        pixels, at = clip_raster(pixels, grid, region)
    else:
        return pixels, grid
    return pixels, grid | {"c": grid["c"] + at[0] * grid["a"], "f": grid["f"] + at[1] * grid["e"], "width": at[2], "height": at[3]}


def stack_of_scene(spark: SparkSession, folder: str, bands: list[str], resolution: float = 10, mask: DataFrame | None = None, area: tuple[int, int, int, int] | None = None, region=None, indexes: dict | None = None, order: list[int] | None = None, mask_indexes: bool = False) -> tuple[DataFrame, dict]:
    """``(pixels, grid)``: the named bands of a scene, each from its 10 m file or else from its 20 m file, on one grid.

    ``bands`` are keys such as B02_10m; each is brought to the resolution, cut to
    the window or region, and masked with 9999 by ``mask`` (row_idx, col_idx,
    masked), which must be of the cut grid. Indexes follow in order, over bands
    or earlier indexes. ``order`` numbers the columns of the result from 0, may
    drop and repeat them. Bands of different size are a ``ValueError``. All bands
    meet in one shuffle.
    """
    if area is not None and region is not None:
        raise ValueError("give a window or a region, not both")
    fine, coarse = scene_catalogs(spark, folder)
    long, grid = None, None
    for number, (key, path, _) in enumerate(ct.band_paths(fine, coarse, bands), 1):
        pixels, own = read_band(spark, path, resolution, area, region)
        if grid is not None and any(own[k] != grid[k] for k in ("crs", "a", "e", "width", "height")):
            raise ValueError(f"{key} is not of the same system, size and resolution as {bands[0]}")
        grid = grid or own
        one = pixels.select("row_idx", "col_idx", F.lit(number).alias("band"), "value")
        long = one if long is None else long.unionByName(one)
    wide = stack(long, list(range(1, len(bands) + 1))).withColumnsRenamed({f"b{k}": key for k, key in enumerate(bands, 1)})
    if mask is not None:
        wide = wide.join(mask.select("row_idx", "col_idx", "masked"), ["row_idx", "col_idx"])
        wide = apply_mask(wide, bands, F.col("masked"), FILL)
    wide = add_indexes(wide, indexes or {})
    if mask is not None:
        if mask_indexes:
            wide = apply_mask(wide, list(indexes or {}), F.col("masked"), FILL)
        wide = wide.drop("masked")
    if order is not None:
        wide = select_bands(wide, [*bands, *(indexes or {})], [k + 1 for k in order])
    return wide, grid


def scene_name(spark: SparkSession, folder: str, kind: str = "stack", key: str | None = None) -> str:
    """The name of a scene's output, from tile and date of its files."""
    fine, coarse = scene_catalogs(spark, folder)
    both = fine.unionByName(coarse)
    row = (both if key is None else both.filter(F.col("key") == key)).agg(F.max(F.struct("fpath", "tile_n", "date")).alias("r")).select(output_name(kind, tile=F.col("r.tile_n"), date=F.col("r.date")).alias("name")).first()
    return row.name


def write_stack(spark: SparkSession, pixels: DataFrame, grid: dict, folder: str, name: str) -> str:
    """A wide stack as one file, in the sample type of its first band; returns the path."""
    columns = [c for c in pixels.columns if c not in ("row_idx", "col_idx")]
    raster = name.removesuffix(".tif")
    row = {k: grid[k] for k in ("a", "e", "c", "f", "width", "height", "crs", "nodata")} | {"raster_id": raster, "band_count": len(columns)}
    schema = "raster_id string, width int, height int, a double, c double, e double, f double, crs string, nodata double, band_count int"
    grids = spark.createDataFrame([tuple(row[c.split(" ")[0]] for c in schema.split(", "))], schema)
    gt.write_rasters(unstack(pixels, columns).withColumn("raster_id", F.lit(raster)), grids, folder, grid["dtype"])
    return f"{folder}/{raster}.tif"


def stack_sent2_bands(spark: SparkSession, folder: str, bands: list[str], out: str, name: str | None = None, **options) -> str:
    """Builds a scene's stack (see :func:`stack_of_scene`) and writes it as tile_date.tif or under ``name``; returns the path."""
    pixels, grid = stack_of_scene(spark, folder, bands, **options)
    return write_stack(spark, pixels, grid, out, name or scene_name(spark, folder))


#: Bands and indexes of the classification stack by their place in it, and the order in which they are written.
CHARCOAL_BANDS = ["B08_10m", "B02_20m", "B03_20m", "B04_20m", "B05_20m", "B06_20m", "B07_20m", "B8A_20m", "B11_20m", "B12_20m"]
CHARCOAL_INDEXES = {"ndvi": ("ndvi", ["B04_20m", "B08_10m"]), "nbr": ("nbr", ["B08_10m", "B12_20m"]), "bsi": ("bsi", ["B02_20m", "B04_20m", "B08_10m", "B12_20m"]), "ndwi": ("ndwi", ["B03_20m", "B08_10m"])}
CHARCOAL_ORDER = [1, 2, 3, 4, 5, 6, 0, 7, 8, 9, 10, 11, 12, 13]


def classify_scene(spark: SparkSession, folder: str, points: DataFrame, out: str, bands: list[str] = CHARCOAL_BANDS, indexes: dict = CHARCOAL_INDEXES, order: list[int] | None = CHARCOAL_ORDER, scl: str = "SCL_20m", picture: str | None = "TCI_20m", resolution: float = 20,
                   drop: tuple[str, ...] = (), runs: int = 30, **options) -> tuple[DataFrame, str]:
    """From a scene and labelled points to class maps: ``(reports, path of the stack)``.

    The area is the box around the points (point_id, x, y, classname, id). A true
    colour picture of it is kept (if ``picture`` names one); the bands are stacked,
    clouded pixels masked in bands and indexes; the pixels under the points are
    the training set, to which a class of masked pixels is added and from which
    the classes of ``drop`` are taken, and which is written as documents. Every
    run trains a forest, reports it, and writes its map as JSON rows and as a
    raster of unsigned bytes, both named after the stack and the run.
    """
    box = total_bounds(points).first()
    ring = [(box.minx, box.miny), (box.maxx, box.miny), (box.maxx, box.maxy), (box.minx, box.maxy)]
    fine, coarse = scene_catalogs(spark, folder)
    every = fine.unionByName(coarse)
    if picture is not None:
        shown = dict(zip([c.split(" ")[0] for c in gt.METADATA.split(", ")], gt.metadata(path := ct.path_of(every, picture))))
        long = gt.pixels_of(gt.read_rasters(spark, path))
        clipped, at = clip_raster(long, shown, ring)
        wide = stack(clipped, list(range(1, shown["band_count"] + 1)))
        write_stack(spark, wide, shown | {"c": shown["c"] + at[0] * shown["a"], "f": shown["f"] + at[1] * shown["e"], "width": at[2], "height": at[3]}, out, scene_name(spark, folder, "area", picture))
    clouds, _ = read_band(spark, ct.path_of(every, scl), resolution, None, ring)
    mask = clouds.select("row_idx", "col_idx", mask_values("value", CLOUD_CLASSES).alias("masked"))
    pixels, grid = stack_of_scene(spark, folder, bands, resolution, mask, None, ring, indexes, order, mask_indexes=True)
    path = write_stack(spark, pixels, grid, out, scene_name(spark, folder, "masked_stack"))
    stem = path.rsplit("/", 1)[1].removesuffix(".tif")
    count = len(order if order is not None else [*bands, *indexes])
    names = [f"b{k}" for k in range(1, count + 1)]
    written = cut(stack(gt.pixels_of(gt.read_rasters(spark, path)), list(range(1, count + 1))), "stack")  # for the samples and every run's map

    transform = (grid["a"], grid["e"], grid["c"], grid["f"])
    samples = cut(sp.extract(points, written, names, transform), "samples")
    labels = sp.labels_map(points, "point_id")
    made, labels = sp.add_named_class(samples, labels, "masked", count, float(FILL))
    for name in drop:
        made, labels = sp.remove_named_class(made, labels, name)
    numbered = made.withColumn("key", F.xxhash64("features", "label", F.monotonically_increasing_id()))
    training = cut(numbered, "training")
    doc.write_text(doc.training_documents(training, "key", labels, 50_000), "document", f"{out}/{stem}_training_data.json")
    grids = spark.createDataFrame([(None, *(grid[k] for k in ("width", "height", "a", "c", "e", "f", "crs")))], "raster_id string, width int, height int, a double, c double, e double, f double, crs string")
    cells = written.select("row_idx", "col_idx", F.array(*[F.col(b).cast("double") for b in names]).alias("features"))

    def keep(run: int, model) -> None:
        map_name = f"{stem}_classification_map__{run}"
        predicted = cut(cl.predict_alike(cells, model).select("row_idx", "col_idx", "prediction"), "map")  # written twice
        doc.write_lines(doc.class_map_rows(predicted), "values", ["row_idx"], f"{out}/{map_name}.json")
        gt.write_class_map(predicted.withColumn("raster_id", F.lit(map_name)), grids.withColumn("raster_id", F.lit(map_name)), out)

    return cl.repeated_runs(training, "key", runs, then=keep, **options), path
