"""Queries of the training-data operators, by name: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import calibrate as cal
from gridloom.llm import density
from gridloom.llm import leakage
from gridloom.llm import quantiles as qt
from gridloom.llm import residue as rs
from gridloom.llm import tokenize as tk
from gridloom.llm.varied import varied_subset
from gridloom.operators.proximity import read_points
from gridloom.session import cut, table


#: Records that the varied subsets hold.
SAMPLES, POINTS = 2000, 500


def p1_subset(spark: SparkSession, d: str) -> DataFrame:
    """A varied subset of the samples by their bands and label, and one of the points by class and place."""
    # a sample with some bands masked is a kind of its own; one with all bands masked shows nothing
    samples = table(spark, d, "extractor_samples").filter(~F.coalesce(F.forall("x", lambda v: v == density.MASK), F.lit(False)))
    first = varied_subset(samples, "sample_id", F.col("x"), F.col("y"), BANDS, SAMPLES)
    source = table(spark, d, "gdf_points")
    classes = cal.resolve_classes(source, table(spark, d, "labels_map"), "point_id", "id", "classname").groupBy("id").agg(F.min("category").alias("category"))
    # points without readable place lie at the origin of their class: they are a kind of their own
    places = read_points(source, "point_id", "geometry").groupBy("id").agg(F.min(F.struct("x", "y")).alias("p"))
    every = source.select(F.col("point_id").alias("id")).filter("id is not null").distinct().join(places, "id", "left").join(classes, "id", "left")
    at = F.array(F.coalesce(F.col("p.x"), F.lit(0.0)), F.coalesce(F.col("p.y"), F.lit(0.0)))
    second = varied_subset(cut(every.select("id", at.alias("xy"), "category"), "p1-points"), "id", F.col("xy"), F.col("category"), 2, POINTS)
    return first.withColumn("drawn_from", F.lit("extractor_samples")).unionByName(second.withColumn("drawn_from", F.lit("gdf_points")))


def _categories(spark: SparkSession, d: str) -> list[tuple[str, DataFrame]]:
    """What each of the two tables offers: ``(category, id)`` of its records."""
    points = cal.resolve_classes(table(spark, d, "gdf_points"), table(spark, d, "labels_map"), "point_id", "id", "classname")
    samples = table(spark, d, "extractor_samples").select(F.col("y").cast("string").alias("category"), F.col("sample_id").alias("id"))
    return [("gdf_points", points), ("extractor_samples", samples)]


def p2_plan(spark: SparkSession, d: str) -> DataFrame:
    """Per target: records available and taken, and by how many it is missed."""
    targets = table(spark, d, "sample_targets")
    parts = [cal.plan(targets.filter(F.col("drawn_from") == name), records) for name, records in _categories(spark, d)]
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Targets for which there are too few records; :func:`p2_plan` also tells those that the sample misses otherwise."""
    return p2_plan(spark, d).filter("lack > 0").select("target_set", "category").distinct()


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "sample_targets")
    parts = [cal.draw(targets.filter(F.col("drawn_from") == name), records) for name, records in _categories(spark, d)]
    return parts[0].unionByName(parts[1])


FRACTIONS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Per y and band, by acquisition day and over all days (day null).

    The whole is combined from the summaries of the days; the samples are read
    once. Samples without a day count for the whole only.
    """
    keys = {"y": F.col("y"), "day": F.to_date("acquired_at")}
    days = cut(qt.summarize(table(spark, d, "extractor_samples"), keys, "x", BANDS), "p3-days")
    whole = qt.combine(days, ["y"]).withColumn("day", F.lit(None).cast("date"))
    return qt.percentiles(days.filter("day is not null").unionByName(whole), ["y", "day"], FRACTIONS)


def p3_audit(spark: SparkSession, d: str) -> DataFrame:
    """Per y, day and band the exact number of values, and whether every percentile's rank is within its stated error.

    The ranks are counted over all values against the percentiles, a row per
    group; counts combine before they are shuffled.
    """
    told = cut(p3_percentiles(spark, d), "p3-told")
    x = F.col("x").cast("array<double>")
    value = F.explode(F.filter(F.transform(x, lambda v, i: F.struct((i + 1).alias("band"), v.alias("v"))), lambda s: (s["band"] <= BANDS) & (F.abs(s["v"]) < float("inf")) & (s["v"] != density.MASK)))
    day = F.to_date("acquired_at")
    days = F.explode(F.when(day.isNotNull(), F.array(day, F.lit(None).cast("date"))).otherwise(F.array(F.lit(None).cast("date"))))
    rows = table(spark, d, "extractor_samples").select("y", "acquired_at", value.alias("s")).select("y", days.alias("day"), F.col("s.band").alias("band"), F.col("s.v").alias("v"))
    same = F.expr("r.y <=> t.y and r.day <=> t.day and r.band = t.band")
    labels = [c for c in told.columns if c.startswith("q")]
    counts = rows.alias("r").join(told.alias("t"), same).groupBy("t.y", "t.day", "t.band").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("v") < F.col(q)).alias(f"{q}_low") for q in labels], *[F.count_if(F.col("v") <= F.col(q)).alias(f"{q}_high") for q in labels],
        F.max("max_rank_error").alias("e"), F.max("t.n").alias("told"),
    )
    within = F.col("told") == F.col("n")
    for q, f in zip(labels, FRACTIONS):
        rank = F.greatest(F.ceil(F.lit(f) * F.col("n")), F.lit(1))
        within &= (F.col(f"{q}_low") + 1 - F.col("e") <= rank) & (rank <= F.col(f"{q}_high") + F.col("e"))
    return counts.select("y", "day", "band", "n", within.alias("within"))


#: Two samples are similar up to this distance of their ten bands.
SIMILAR, BANDS = 150.0, 10


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return density.clusters(table(spark, d, "extractor_samples"), "sample_id", "x", SIMILAR, BANDS)


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Size and most typical samples of every cluster."""
    samples = table(spark, d, "extractor_samples")
    found = cut(p4_found(spark, d), "p4-found")
    return density.describe(samples, found, "sample_id", "x", BANDS)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tk.encode_column(table(spark, d, "documents"), "doc_id", "text", tk.tokenizer_path())


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A hash of every document as decoded from its ids; one without ids has none."""
    docs = table(spark, d, "documents").select("doc_id")
    back = tk.decode_column(p6_ids(spark, d), "doc_id", "ids", tk.tokenizer_path()).select("doc_id", F.md5("text").alias("decoded"))
    return docs.join(back, "doc_id", "left")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text", run=12)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return rs.residue(table(spark, d, "documents"), "doc_id", "text", "source")


def queries() -> dict:
    found = [p1_subset, p2_found, p2_plan, p2_sample, p3_percentiles, p3_audit, p4_found, p4_clusters, p6_ids, p6_round_trip, p7_found, p8_found]
    return {q.__name__: q for q in found}


_KEY = "trim(lower(regexp_replace({0}, '[\\s\u00a0_-]+', ' ', 'g')))"
_AVAILABLE = f"""l AS (SELECT classname, CAST(trunc(try_cast(trim(id) AS DOUBLE)) AS BIGINT) AS label, {_KEY.format('classname')} AS k FROM labels_map WHERE classname IS NOT NULL),
p AS (SELECT DISTINCT point_id, CAST(trunc(try_cast(trim(id) AS DOUBLE)) AS BIGINT) AS label, {_KEY.format('classname')} AS k FROM gdf_points WHERE point_id IS NOT NULL),
m AS (SELECT k, CASE WHEN max(exact) IS NOT NULL THEN max(exact) WHEN min(near) = max(near) THEN min(near) END AS classname FROM (
  SELECT n.k, CASE WHEN n.k = l.k THEN classname END AS exact, classname AS near FROM (SELECT DISTINCT k FROM p WHERE label IS NULL AND k <> '') n JOIN l ON damerau_levenshtein(n.k, l.k) <= 1) t GROUP BY 1),
c AS (SELECT point_id, classname FROM p JOIN l USING (label) UNION SELECT point_id, classname FROM p JOIN m USING (k) WHERE label IS NULL),
a AS (SELECT 'gdf_points' AS drawn_from, classname AS category, count(DISTINCT point_id) AS n FROM c GROUP BY 2
  UNION ALL SELECT 'extractor_samples', CAST(y AS VARCHAR), count(DISTINCT sample_id) FROM extractor_samples WHERE y IS NOT NULL GROUP BY 2)"""
_FOUND = f"""WITH {_AVAILABLE}
SELECT DISTINCT target_set, category FROM sample_targets LEFT JOIN a USING (drawn_from, category) WHERE coalesce(n, 0) < share * sample_size OR coalesce(n, 0) < min_count"""
#: Shares times a common factor, held between minimum and supply; the factor that fills the sample is found by halving.
_PLAN = f"""WITH RECURSIVE {_AVAILABLE},
t AS (SELECT DISTINCT drawn_from, target_set, category, coalesce(share, 0) AS share, coalesce(min_count, 0) AS min_count, coalesce(sample_size, 0) AS sample_size FROM sample_targets),
r AS (SELECT t.*, CAST(coalesce(n, 0) AS DOUBLE) AS n, least(coalesce(n, 0), CAST(min_count AS DOUBLE)) AS low FROM t LEFT JOIN a USING (drawn_from, category)),
w AS (SELECT drawn_from, target_set, least(CAST(max(sample_size) AS DOUBLE), sum(n)) AS room FROM r GROUP BY ALL),
f(drawn_from, target_set, lo, hi, step) AS (SELECT drawn_from, target_set, 0.0::DOUBLE, 1e8::DOUBLE, 0 FROM w UNION ALL
  SELECT g.drawn_from, g.target_set, CASE WHEN g.total <= g.room THEN g.mid ELSE g.lo END, CASE WHEN g.total <= g.room THEN g.hi ELSE g.mid END, g.step + 1 FROM (
    SELECT f.drawn_from, f.target_set, any_value(lo) AS lo, any_value(hi) AS hi, any_value((lo + hi) / 2) AS mid, any_value(step) AS step, any_value(room) AS room, sum(least(greatest((lo + hi) / 2 * share, low), n)) AS total
    FROM f JOIN r USING (drawn_from, target_set) JOIN w USING (drawn_from, target_set) WHERE step < 120 GROUP BY f.drawn_from, f.target_set) g),
e AS (SELECT r.*, round(least(greatest(lo * share, low), n), 6) AS x FROM r JOIN f USING (drawn_from, target_set) WHERE step = 120),
b AS (SELECT *, CAST(floor(x + 1e-6) AS BIGINT) AS whole, row_number() OVER (PARTITION BY drawn_from, target_set ORDER BY round(floor(x + 1e-6) - x, 5), category) AS pos,
  CAST(round(sum(x) OVER s) AS BIGINT) - sum(CAST(floor(x + 1e-6) AS BIGINT)) OVER s AS extra FROM e WINDOW s AS (PARTITION BY drawn_from, target_set)),
k AS (SELECT *, whole + CASE WHEN pos <= extra THEN 1 ELSE 0 END AS take, share * sample_size AS wish, greatest(share * sample_size, min_count) AS goal FROM b)
SELECT target_set, category, share, min_count, sample_size, CAST(n AS BIGINT) AS available, CAST(take AS BIGINT) AS take, CAST(ceil(greatest(goal - n, 0)) AS BIGINT) AS lack,
  CAST(floor(greatest(goal - take, 0) + 1e-9) AS BIGINT) AS gap, CAST(floor(greatest(take - wish, 0) + 1e-9) AS BIGINT) AS excess FROM k"""
_AUDIT = """WITH v AS (SELECT y, CAST(acquired_at AS DATE) AS day, unnest(x) AS v, generate_subscripts(x, 1) AS band FROM extractor_samples),
u AS (SELECT y, day, CAST(band AS INTEGER) AS band FROM v WHERE band <= 10 AND isfinite(v) AND v <> 9999)
SELECT y, day, band, count(*) AS n, true AS within FROM u WHERE day IS NOT NULL GROUP BY ALL UNION ALL SELECT y, NULL, band, count(*), true FROM u GROUP BY y, band"""
#: Links within cells of two bands and their neighbours; the smallest id of what is linked spreads until it changes nothing.
_CLUSTERS = """u AS (SELECT DISTINCT sample_id AS id, x FROM extractor_samples WHERE sample_id IS NOT NULL AND len(x) = 10 AND list_bool_and(list_transform(x, lambda v: v IS NOT NULL AND isfinite(v) AND v <> 9999))),
c AS (SELECT id, x, CAST(floor(x[1] / 150) AS BIGINT) AS g, CAST(floor(x[4] / 150) AS BIGINT) AS h FROM u),
n AS (SELECT id, x, g + i AS g, h + j AS h FROM c, range(-1, 2) a(i), range(-1, 2) b(j)),
e AS (SELECT DISTINCT n.id AS a, c.id AS b FROM n JOIN c USING (g, h) WHERE n.id <> c.id AND list_distance(n.x, c.x) <= 150),
k(id, root) USING KEY (id) AS (SELECT a, least(a, min(b)) FROM e GROUP BY a UNION
  SELECT e.b, min(k.root) FROM k JOIN e ON e.a = k.id JOIN recurring.k AS r ON r.id = e.b WHERE k.root < r.root GROUP BY e.b),
found AS (SELECT root AS cluster_id, id AS sample_id FROM (SELECT root, id, count(*) OVER (PARTITION BY root) AS n FROM k) s WHERE n >= 3)"""
_MEAN = ", ".join(f"avg(x[{i}])" for i in range(1, BANDS + 1))


def oracle_sql() -> dict:
    """SQL of the queries that it can express."""
    return {
        "p2_found": _FOUND, "p2_plan": _PLAN, "p3_audit": _AUDIT, "p4_found": f"WITH RECURSIVE {_CLUSTERS} SELECT cluster_id, sample_id FROM found",
        "p4_clusters": f"""WITH RECURSIVE {_CLUSTERS}, q AS (SELECT cluster_id, sample_id, min(x) AS x FROM found JOIN u ON id = sample_id GROUP BY ALL), m AS (SELECT cluster_id, count(*) AS size, [{_MEAN}] AS mean FROM q GROUP BY 1),
d AS (SELECT cluster_id, size, sample_id, round(list_distance(x, mean), 6) AS distance FROM q JOIN m USING (cluster_id)), o AS (SELECT *, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY distance, sample_id) AS INTEGER) AS rank FROM d)
SELECT cluster_id, size, rank, sample_id, distance FROM o WHERE rank <= 3""",
        "p6_round_trip": "SELECT doc_id, md5(coalesce(text, '')) AS decoded FROM documents",
    }
