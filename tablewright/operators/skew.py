"""Left joins against a table with one row per key that stay balanced when a key is hot.

AQE splits skewed partitions only when both join inputs come straight from a shuffle. A lookup table
that was just deduplicated or aggregated does not, so hot keys are spread here: rows of a hot key
get one of several numbers and its single lookup row is repeated once per number.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import SEED
from ..functions.naming import col, temp_name

# A key with at least this share of the rows is hot; there can be no more than 1 / share of them.
HOT_SHARE = 0.005
_SAMPLE_ROWS = 200_000


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's own estimate of the table's size."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def fits_broadcast(df: DataFrame) -> bool:
    """Whether that estimate is under the session's broadcast threshold."""
    limit = df.sparkSession._jvm.org.apache.spark.sql.internal.SQLConf.get().autoBroadcastJoinThreshold()
    return plan_bytes(df) <= int(limit)


def hot_key_salts(df: DataFrame, key_hash: Column) -> dict[int, int]:
    """Hash -> number of salts for the keys that hold a large share of the rows.

    A key gets its share of the shuffle partitions, so each salt is about as large as a usual partition.
    The shares come from a sample: a miss costs balance, never rows. At most 1 / HOT_SHARE keys come back.
    """
    hashes = df.select(key_hash.alias("h"))
    total = hashes.count()
    if total == 0:
        return {}
    fraction = min(1.0, _SAMPLE_ROWS / total)
    picked = hashes.sample(fraction=fraction, seed=SEED) if fraction < 1.0 else hashes
    floor = max(2.0, HOT_SHARE * total * fraction)
    rows = (
        picked.groupBy("h").count().where(F.col("count") >= floor)
        .orderBy(F.desc("count")).limit(int(1 / HOT_SHARE)).collect()
    )
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = {}
    for r in rows:
        wanted = r["count"] / (total * fraction) * partitions
        salts[r["h"]] = 1 << max(1, math.ceil(math.log2(max(wanted, 1))))
    return salts


def _salt_count(key_hash: Column, salts: dict[int, int]) -> Column:
    count = F.lit(1)
    for n in sorted(set(salts.values())):  # powers of two, so only a few cases
        count = F.when(key_hash.isin([h for h, k in salts.items() if k == n]), n).otherwise(count)
    return count


def join_lookup(
    left: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    *,
    salts: dict[int, int] | None = None,
    null_safe: bool = False,
) -> DataFrame:
    """Left join on the equally named columns ``on``; ``lookup`` holds each key at most once.

    ``null_safe`` lets a NULL key find a NULL key. The result has the left columns, then the lookup's.
    """
    keys = list(on)
    extra = [c for c in lookup.columns if c not in keys]
    renamed = {k: temp_name(left, f"key_{i}") for i, k in enumerate(keys)}
    right = lookup.select(*[col(k).alias(renamed[k]) for k in keys], *[col(c) for c in extra])

    def match(l: DataFrame, r: DataFrame) -> Column:
        same = None
        for k in keys:
            one = l[f"`{k}`"].eqNullSafe(r[renamed[k]]) if null_safe else l[f"`{k}`"] == r[renamed[k]]
            same = one if same is None else same & one
        return same

    left_hash = F.xxhash64(*[col(k) for k in keys])
    if salts is None:
        salts = {} if fits_broadcast(right) else hot_key_salts(left, left_hash)
    if not salts:
        joined = left.join(right, match(left, right), "left")
        return joined.select(*[col(c) for c in left.columns], *[col(c) for c in extra])

    salt = temp_name(left, "salt")
    other = temp_name(left, "salt_r")
    # Content and task number: equal on a retry, and copies of a row still spread over the tasks.
    spread = F.xxhash64(*[col(c) for c in left.columns], F.spark_partition_id())
    left_s = left.withColumn(salt, F.pmod(spread, _salt_count(left_hash, salts)).cast("int"))
    right_hash = F.xxhash64(*[col(renamed[k]) for k in keys])
    right_s = right.withColumn(other, F.explode(F.sequence(F.lit(0), _salt_count(right_hash, salts) - 1)))
    joined = left_s.join(right_s, match(left_s, right_s) & (left_s[salt] == right_s[other]), "left")
    return joined.select(*[col(c) for c in left.columns], *[col(c) for c in extra])


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The first row of every key in ``order_by`` order.

    The rank filter lets Spark keep one row per key and task before the shuffle, so a hot key is cheap.
    """
    rank = temp_name(df, "rank")
    window = Window.partitionBy(*[col(k) for k in keys]).orderBy(*[col(c) for c in order_by])
    return df.withColumn(rank, F.row_number().over(window)).where(col(rank) == 1).drop(rank)
