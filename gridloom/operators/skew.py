"""Joins on keys of which a few may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that one task joins, about.
HOT_ROWS = 1_000_000


def split_join(rows: DataFrame, single: DataFrame, key: str, sizes: DataFrame, by: str, how: str = "inner", most: int = HOT_ROWS) -> DataFrame:
    """``rows`` joined with ``single`` (one row per key), hot keys split over several tasks.

    ``sizes`` is (key, n), the rows of every key. Keys of more than ``most`` rows
    are split by a hash of ``by`` into parts of about ``most``, and their single
    row is repeated for each part. There are at most rows / most such keys, so
    their list is sent to all tasks. Adds ``_salt``, the part, which is 0 for all
    other keys. Nulls meet nothing.
    """
    hot = F.broadcast(sizes.filter(F.col("n") > most).select(key, F.ceil(F.col("n") / most).cast("int").alias("_parts")))  # at most rows / most
    dealt = rows.join(hot, key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    repeated = single.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(repeated.hint("merge"), [key, "_salt"], how)  # there may be as many keys as rows: never sent whole
