"""File names: scene bands, assets, wildcards, digits and sizes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: tile, date, band and attribute of a scene band's file name.
SCENE = r"^(T[0-9]{2}[^0-9]{3})_([0-9]{8}).*_(B02|B03|B04|B05|B06|B07|B08|B8A|B09|B11|B12|AOT|SCL|TCI|WVP)([A-Za-z0-9_]*)"


def scene_fields(name: Column) -> dict[str, Column]:
    """tile_n, date, band, attr and key of a scene file name, null if it is none.

    The pattern runs once per name: the parts are put side by side, then split.
    """
    parts = F.split(F.regexp_replace(name, SCENE + "(?s:.*)$", "\u0001$1\u0001$2\u0001$3\u0001$4"), "\u0001")
    part = lambda i: F.try_element_at(parts, F.lit(i + 1))
    return {"tile_n": part(1), "date": part(2), "band": part(3), "attr": part(4), "key": F.concat(part(3), part(4))}


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def asset_fields(name: Column) -> dict[str, Column]:
    """asset and info of ``d_t_sat_unit_asset[_asset].ext``.

    The first four parts are the info; two asset parts are joined, of more only
    the first counts; the asset ends at its first dot.
    """
    parts = F.split(name, "_")
    rest = F.slice(parts, 5, F.greatest(F.size(parts) - 4, F.lit(0)))
    asset = F.when(F.size(rest) == 2, F.array_join(rest, "_")).otherwise(F.try_element_at(rest, F.lit(1)))
    return {"asset": F.split_part(asset, F.lit("."), F.lit(1)), "info": F.array_join(F.slice(parts, 1, 4), "_")}


def digits(name: Column) -> Column:
    """All digits of a name as one number, null if it has none."""
    return F.regexp_replace(name, "[^0-9]", "").try_cast("bigint")


def wildcard(pattern: str) -> str:
    """A shell wildcard as a regular expression for ``rlike``."""
    import fnmatch

    return fnmatch.translate(pattern).replace(r"\Z", "$").replace(r"\z", "$")


#: Names of output files; what stands in braces are columns.
OUTPUTS = {
    "stack": "{tile}_{date}.tif", "masked_stack": "{tile}_{date}_stack.tif", "area": "{tile}_{date}_AOI.tif", "overlap": "poly_{poly}_{height}_{width}.tif", "named_overlap": "{stem}_poly_{poly}_{height}_{width}.tif",
    "tile_overlap": "poly_{poly}_{tile}.tif", "corrected": "{stem}Corr.tif", "training": "{stem}_training_data.json", "class_map": "{stem}_classification_map__{run}.json",
}


def output_name(kind: str, **columns: Column) -> Column:
    """The name of an output file; an unknown kind or a missing column is a ``ValueError``."""
    if kind not in OUTPUTS:
        raise ValueError(f"unknown output {kind}; known are {sorted(OUTPUTS)}")
    pieces = re.split(r"\{(\w+)\}", OUTPUTS[kind])
    if missing := [p for p in pieces[1::2] if p not in columns]:
        raise ValueError(f"{kind} needs {missing}")
    return F.concat(*[columns[p].cast("string") if k % 2 else F.lit(p) for k, p in enumerate(pieces) if p])


#: Binary prefixes in ascending order.
PREFIXES = ["", "Ki", "Mi", "Gi", "Ti", "Pi", "Ei", "Zi"]


def size_text(size: Column, suffix: str = "B") -> Column:
    """A size with one decimal and a binary prefix; null stays null."""
    value = size.cast("double")
    out = F.format_string(f"%.1fYi{suffix}", value / float(1024**8))
    for k in range(len(PREFIXES) - 1, -1, -1):
        out = F.when(F.abs(value) / float(1024**k) < 1024.0, F.format_string(f"%3.1f{PREFIXES[k]}{suffix}", value / float(1024**k))).otherwise(out)
    return F.when(size.isNotNull(), out)
