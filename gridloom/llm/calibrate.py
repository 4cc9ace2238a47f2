"""Samples whose category shares match given targets (problem 2).

Target shares are met by calibration: the dual of the exponential tilting
problem, minimise ``sum_c n_c exp(l_c) / N - sum_c t_c l_c`` over the
multipliers ``l`` of the category moments, is solved by Newton iterations. The
records enter only through the category moments ``n_c``, which one distributed
aggregation yields. Minimum counts are fixed first, categories whose inclusion
probability reaches one are fixed at all their records and the rest is
calibrated again, and what cannot be met is reported. Within the calibrated
probabilities a sample of exactly the wanted size is drawn by the pivotal
method.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.session import cut

#: Newton iterations and the largest remaining gradient.
ITERATIONS, TOLERANCE = 100, 1e-12
#: Records of one set that one task of the pivotal method walks through.
PIVOT_RECORDS = 200_000
#: Records beyond those wanted that thinning aims to leave: so many standard deviations, and so many.
SPARE = (6.0, 20.0)


def tilt(counts: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Weights per category that bring its share of the total to the target.

    Newton on the dual. With category indicators as moments the Hessian is
    diagonal; steps are damped to one unit, which keeps every iteration inside
    the region where the exponential is tame. Categories without records or
    with target 0 get weight 0.
    """
    w = np.zeros(len(counts))
    live = (counts > 0) & (targets > 0)
    if not live.any():
        return w
    n, t = counts[live] / counts[live].sum(), targets[live] / targets[live].sum()
    dual = np.zeros(len(n))
    for _ in range(ITERATIONS):
        moment = n * np.exp(dual)
        gradient = moment - t
        if np.abs(gradient).max() < TOLERANCE:
            break
        step = gradient / moment
        dual -= np.clip(step, -1.0, 1.0)
    w[live] = np.exp(dual)
    return w


def allocate(available: np.ndarray, share: np.ndarray, floor: np.ndarray, size: int) -> np.ndarray:
    """Expected number of records to take of each category.

    As near to ``share * size`` as the records and floors allow: floors first
    (as far as there are records), categories that run out taken whole, and the
    remaining categories calibrated to the remaining size. Sums to ``size``
    unless there are fewer records, or more floor records than ``size``.
    """
    low = np.minimum(floor, available).astype(float)
    room = min(float(size), float(available.sum()))
    fixed = np.full(len(available), np.nan)
    fixed[available == 0] = 0.0
    for _ in range(2 * len(available) + 1):
        free = np.isnan(fixed)
        if not free.any():
            break
        rest = max(room - np.nansum(fixed), 0.0)
        weight = tilt(np.where(free, available, 0).astype(float), np.where(free, share, 0.0))
        want = np.where(free, available * weight, 0.0)
        if want.sum() > 0:
            want *= rest / want.sum()
        short, over = free & (want < low - 1e-9), free & (want > available + 1e-9)
        if not short.any() and not over.any():
            fixed[free] = want[free]
            break
        # the larger violation decides which bounds are binding
        if (want - available)[over].sum() >= (low - want)[short].sum():
            fixed[over] = available[over]
        else:
            fixed[short] = low[short]
    return np.minimum(np.nan_to_num(fixed), available)


def whole(expected: np.ndarray) -> np.ndarray:
    """Integers with the rounded sum of ``expected``, each within one of it; equal remainders go by position."""
    base = np.floor(expected + 1e-9).astype(np.int64)
    extra = int(round(float(expected.sum()))) - int(base.sum())
    base[np.argsort(np.round(base - expected, 6), kind="stable")[: max(extra, 0)]] += 1
    return base


_PLAN = "target_set string, category string, share double, min_count bigint, sample_size bigint, available bigint, take bigint, lack bigint, gap bigint, excess bigint"


def plan(targets: DataFrame, records: DataFrame) -> DataFrame:
    """One row per target with what is available, taken and missed.

    ``targets``: target_set, category, share, min_count, sample_size;
    ``records``: category and id, one or more rows per record. ``available``
    counts distinct ids, ``take`` is the calibrated number of records. ``lack``
    is how many records there would have to be more for ``share * sample_size``
    and ``min_count``; ``gap`` is how many more the sample would have to hold for
    them, and ``excess`` how many it holds beyond the share; each is 0 if met.
    The sample misses a target that lacks no record where the minimum counts of
    others leave no room, and exceeds one whose minimum count is above its share
    or that fills up for others; less than one record either way is rounding.

    Null shares, counts and sizes count as 0; records without category or id are
    not available; with an empty table of records every positive target is a
    gap; repeated targets count once. The records are reduced to counts per
    category before anything is shuffled to the solver, which sees one row per
    target: a set's targets, however many records they stand for, are solved
    together in one task.
    """
    return _solved(targets, _available(records))


def _available(records: DataFrame) -> DataFrame:
    return records.select("category", "id").filter("category is not null and id is not null").distinct()


def _solved(targets: DataFrame, keep: DataFrame) -> DataFrame:
    counts = keep.groupBy("category").agg(F.count(F.lit(1)).alias("available"))
    wanted = targets.select("target_set", "category", F.coalesce("share", F.lit(0.0)).alias("share"), F.coalesce("min_count", F.lit(0)).cast("long").alias("min_count"), F.coalesce("sample_size", F.lit(0)).cast("long").alias("sample_size")).distinct()
    full = wanted.join(counts, "category", "left").select("target_set", "category", "share", "min_count", "sample_size", F.coalesce("available", F.lit(0)).alias("available"))
    columns = [c.split(" ")[0] for c in _PLAN.split(", ")]

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("category", kind="stable").reset_index(drop=True)
        available, share, floor = (pdf[c].to_numpy(float) for c in ("available", "share", "min_count"))
        size = float(pdf["sample_size"].max())
        pdf["take"] = take = whole(allocate(available, share, floor, int(size)))
        wish = share * pdf["sample_size"].to_numpy(float)
        pdf["lack"] = np.ceil(np.maximum(np.maximum(wish, floor) - available, 0)).astype("int64")
        pdf["gap"] = np.floor(np.maximum(np.maximum(wish, floor) - take, 0) + 1e-9).astype("int64")
        pdf["excess"] = np.floor(np.maximum(take - wish, 0) + 1e-9).astype("int64")
        return pdf[columns]

    return full.groupBy("target_set").applyInPandas(solve, _PLAN)


def pivot(p: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int, float]:
    """The pivotal method: chosen positions, and the last unit left undecided.

    Two units fight: with probabilities ``a + b < 1`` one of them goes out,
    otherwise one of them comes in, and the other carries what is left over.
    Returns the undecided unit (-1 if none) and its probability.
    """
    chosen, at, a = [], -1, 0.0
    draw = rng.random(len(p) + 1)
    for i, b in enumerate(p.tolist()):
        if b <= 1e-12:
            continue
        if b >= 1 - 1e-12:
            chosen.append(i)
            continue
        if at < 0:
            at, a = i, b
            continue
        total, u = a + b, draw[i]
        if total < 1:
            if u * total < b:
                at = i
            a = total
        else:
            if u * (2 - total) < 1 - b:
                chosen.append(at)
                at = i
            else:
                chosen.append(i)
            a = total - 1
            if a <= 1e-12:
                at, a = -1, 0.0
            elif a >= 1 - 1e-12:
                chosen.append(at)
                at, a = -1, 0.0
    return np.array(chosen, dtype=np.int64), at, a


def draw(targets: DataFrame, records: DataFrame, seed: int = 42) -> DataFrame:
    """``(target_set, category, id)``: a sample for every target set.

    Within a category every record has the calibrated probability
    ``take / available``: those whose hash lies below a limit a little above it
    are left, so that few of a hot category's records are shuffled, and of them
    every one has the same probability again. They are spread by another hash
    over blocks of bounded size; the pivotal method runs in every block and once
    more over the one undecided unit of each, so every category yields exactly
    ``take`` records and a hot category never sits in one task.
    A record enters a target set at most once per category; nulls are as in
    :func:`plan`.
    """
    keep = cut(_available(records), "p2-records")
    made = _solved(targets, keep).filter("take > 0").select("target_set", "category", "take", "available")
    # records are thinned first: of those whose hash is below a limit there are enough but for a chance of some 1e-9 a target
    limit = F.least((F.col("take") + SPARE[0] * F.sqrt("take") + SPARE[1]) / F.col("available"), F.lit(1.0))
    chance = F.shiftrightunsigned(F.xxhash64("id", "target_set", F.lit(seed + 1)), 11) / F.lit(float(1 << 53))
    made = cut(made.withColumn("limit", limit), "p2-plan")
    thin = keep.join(made, "category").withColumn("low", chance).filter("low < limit").select("target_set", "category", "id", "take")
    thin = cut(thin, "p2-thin")
    met = thin.groupBy("target_set", "category").agg(F.count(F.lit(1)).alias("n"))
    # a target for which chance left too few is drawn from all its records
    short = cut(made.join(met, ["target_set", "category"], "left").filter("coalesce(n, 0) < take").select("target_set", "category", "take", "available"), "p2-short")
    sizes = met.join(short.select("target_set", "category"), ["target_set", "category"], "left_anti").unionByName(short.select("target_set", "category", F.col("available").alias("n")))
    units = thin.join(short.select("target_set", "category"), ["target_set", "category"], "left_anti")
    if not short.isEmpty():
        units = units.unionByName(keep.join(short, "category").select("target_set", "category", "id", "take"))
    units = units.join(sizes, ["target_set", "category"]).withColumns({"p": F.col("take") / F.col("n"), "blocks": F.ceil(F.col("n") / PIVOT_RECORDS).cast("int")})
    units = units.withColumn("block", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("blocks")).cast("int"))
    kind = records.schema["id"].dataType.simpleString()
    columns = ["target_set", "category", "id", "p"]
    schema = f"target_set string, category string, id {kind}, p double"

    def fight(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
        rng = np.random.default_rng([seed, *"/".join(map(str, key)).encode()])
        order = rng.permutation(len(pdf))
        chosen, at, a = pivot(pdf["p"].to_numpy()[order], rng)
        out = pdf.iloc[order[chosen]][columns].assign(p=1.0)
        if at >= 0:
            out = pd.concat([out, pdf.iloc[order[[at]]][columns].assign(p=a)])
        return out

    def last(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
        rng = np.random.default_rng([seed, *"/".join(map(str, key)).encode()])
        chosen, at, a = pivot(pdf["p"].to_numpy(), rng)
        picked = [*chosen, *([at] if at >= 0 and a > 0.5 else [])]
        return pdf.iloc[picked][columns].assign(p=1.0)

    first = units.select(*columns, "block").groupBy("target_set", "category", "block").applyInPandas(fight, schema)
    # of every block at most one unit is undecided: rows as many as blocks, not as records
    ends = first.filter("p < 1").groupBy("target_set", "category").applyInPandas(last, schema)
    return first.filter("p = 1").unionByName(ends).drop("p")


def class_key(name: Column) -> Column:
    """A class name in its plain spelling: lower case, single blanks, no marks."""
    plain = F.lower(F.regexp_replace(name, r"[\s _-]+", " "))
    return F.trim(plain)


def slips(word: Column) -> Column:
    """The word and all it becomes by dropping one character.

    Two words share one of these exactly if dropping at most one character from
    each makes them equal: an added, lost, changed or swapped character.
    """
    drop = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))
    return F.array_union(F.array(word), drop)


def resolve_classes(points: DataFrame, labels: DataFrame, id_col: str, label_col: str, class_col: str) -> DataFrame:
    """``(id, category)``: the class of every point, one row per point and class.

    The class is the one that the label id stands for, or, with no id, the one
    that the class name names: after plain spelling an exact match, else the
    only class one slip away. Ids are read as integers in any spelling. A point
    with neither has no class and no row; an id no label has gives no class.

    Names are resolved once per distinct spelling, not per row.
    """
    labels = labels.select(F.col("classname").alias("category"), F.trim("id").try_cast("double").cast("long").alias("label"), class_key(F.col("classname")).alias("key")).filter("category is not null")
    rows = points.select(F.col(id_col).alias("id"), F.trim(label_col).try_cast("double").try_cast("long").alias("label"), class_key(F.col(class_col)).alias("key")).filter("id is not null").distinct()
    by_id = rows.filter("label is not null").join(labels.select("label", "category"), "label").select("id", "category")
    names = rows.filter("label is null and key is not null and key <> ''").select("id", "key")
    spelled = names.select("key").distinct().withColumn("slip", F.explode(slips(F.col("key"))))
    known = labels.filter("key is not null and key <> ''").select(F.col("key").alias("name"), "category", F.explode(slips(F.col("key"))).alias("slip"))
    match = spelled.join(known, "slip").groupBy("key").agg(F.max(F.when(F.col("key") == F.col("name"), F.col("category"))).alias("exact"), F.min("category").alias("a"), F.max("category").alias("b"))
    named = match.select("key", F.coalesce("exact", F.when(F.col("a") == F.col("b"), F.col("a"))).alias("category")).filter("category is not null")
    return by_id.unionByName(names.join(named, "key").select("id", "category")).distinct()
