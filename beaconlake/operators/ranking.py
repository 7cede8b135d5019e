"""Row numbers and exact quantiles that hold when one key has most of the rows."""

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconlake.session import materialise

# Ranges that a key's values are cut into.
RANGES = 128
# Distinct values of a key up to which each is a cell of its own at once.
NARROW = 100_000
# Cells of values, coarse to fine; each is an interval: 64 to a factor of e, single precision, the value.
CELLS = ["signum(num) * rint(64 * log1p(abs(num) * 1e12D))", "CAST(num AS FLOAT)", "num"]


def bucketed_row_number(
    df: DataFrame, keys: Sequence[str], bucket: Column, order_by: Sequence, name: str
) -> DataFrame:
    """``row_number`` per key without bringing a whole key into one task.

    ``bucket`` must be non-decreasing in ``order_by``. Rows are ranked inside their bucket and
    shifted by the number of rows in earlier buckets, which comes from a pre-aggregated count.
    """
    rows = df.withColumn("_bucket", bucket)
    earlier = (
        Window.partitionBy(*keys)
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        rows.groupBy(*keys, "_bucket")
        .agg(F.count("*").alias("_n"))
        .select(*keys, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order_by)
    return (
        rows.join(offsets, [*keys, "_bucket"])
        .withColumn(name, F.col("_offset") + F.row_number().over(inside))
        .drop("_bucket", "_offset")
    )


def value_counts(
    df: DataFrame,
    keys: Sequence[str],
    numbers: dict[str, str],
    texts: dict[str, str] | None = None,
) -> DataFrame:
    """Long table ``keys, field, num, txt, n``: how often each non-null value occurs.

    ``numbers`` and ``texts`` name fields and give their SQL expressions. One pass and one shuffle
    serve all fields. Equal values are merged before the shuffle, so what moves grows with the
    number of distinct values of a key, not with its rows.
    """
    facts = [
        f"struct('{field}' AS field, CAST({value} AS DOUBLE) AS num, CAST(NULL AS STRING) AS txt)"
        for field, value in numbers.items()
    ] + [
        f"struct('{field}' AS field, CAST(NULL AS DOUBLE) AS num, CAST({value} AS STRING) AS txt)"
        for field, value in (texts or {}).items()
    ]
    return (
        df.selectExpr(*keys, f"inline(array({', '.join(facts)}))")
        .filter("(num IS NOT NULL AND NOT isnan(num)) OR txt IS NOT NULL")
        .groupBy(*keys, "field", "num", "txt")
        .agg(F.count("*").alias("n"))
    )


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys that may be null."""
    renamed = right.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    match = [F.col(k).eqNullSafe(F.col(f"_same_{k}")) for k in keys]
    return left.join(renamed, reduce(and_, match), "left").drop(*[f"_same_{k}" for k in keys])


def selected(counts: DataFrame, keys: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """Exact quantiles of ``num`` (weighted by ``n``) per key: one row per key with ``rows``.

    Selection instead of sorting: values are counted in cells, the cells that hold the wanted ranks are
    found from the counts, and only their values are cut finer, until a cell is one value. A
    key has at most some ten thousand coarse cells, so no task has all its values. Keys with few
    distinct values need one round, in which each value is its own cell. ``counts`` should be stored.
    """
    names = list(keys)
    widest = counts.groupBy(*names).count().agg(F.max("count")).first()[0] or 0
    levels = ["num"] if widest <= NARROW else CELLS
    places = [f"CAST({half}((rows - 1) * {float(p)}D) AS BIGINT)" for p in probs.values() for half in ("floor", "ceil")]
    whole = Window.partitionBy(*names)
    cells = counts.selectExpr(*names, f"{levels[0]} AS cell", "num", "n")
    if len(levels) > 1:
        cells = cells.groupBy(*names, "cell").agg(F.min("num").alias("num"), F.sum("n").alias("n"))
    ranked = (
        cells.withColumnRenamed("num", "low").withColumn("rows", F.sum("n").over(whole))
        .withColumn("_upto", F.sum("n").over(whole.orderBy("low").rowsBetween(Window.unboundedPreceding, 0)))
        .selectExpr("*", f"posexplode(array({', '.join(places)})) AS (target, place)")
        .filter("_upto - n <= place AND place < _upto")
    )
    found = ranked.selectExpr(*names, "target", "rows", "cell", "low", "place - (_upto - n) AS rank")
    for depth in range(1, len(levels)):
        found = materialise(found.withColumnRenamed("cell", f"_cell{depth - 1}").drop("low"), "selection")
        # Cells of one level may span two of the level before, so a cell is known by all of them.
        inside = counts.selectExpr(*names, "num", "n", *[f"{level} AS _cell{i}" for i, level in enumerate(levels[:depth])])
        at = [*names, *[f"_cell{i}" for i in range(depth)]]
        taken = same_keys(found, inside, at).withColumn("cell", F.expr(levels[depth]))
        finer = taken.groupBy(*at, "target", "rows", "rank", "cell").agg(F.min("num").alias("low"), F.sum("n").alias("n"))
        one = Window.partitionBy(*names, "target").orderBy("low").rowsBetween(Window.unboundedPreceding, 0)
        found = (
            finer.withColumn("_before", F.sum("n").over(one) - F.col("n"))
            .filter("_before <= rank AND rank < _before + n")
            .withColumn("rank", F.expr("rank - _before")).drop("_before", "n")
        )
    ends = [f"max(CASE WHEN target = {t} THEN low END) AS _end{t}" for t in range(len(places))]
    values = []
    for number, (name, prob) in enumerate(probs.items()):
        low, high, place = f"_end{2 * number}", f"_end{2 * number + 1}", f"((rows - 1) * {float(prob)}D)"
        values.append(f"{low} + ({high} - {low}) * ({place} - floor({place})) AS {name}")
    return found.groupBy(*names).agg(F.max("rows").alias("rows"), *map(F.expr, ends)).selectExpr(*names, "rows", *values)


def with_quantiles(counts: DataFrame, keys: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """Add to each value its key's linearly interpolated quantiles (weighted by ``n``) and ``rows``."""
    stored = materialise(counts, "value-counts")
    return same_keys(stored, selected(stored, keys, probs), keys)


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Exact quantiles of the SQL expression ``value`` per key, one row per key."""
    return selected(materialise(value_counts(df, keys, {"value": value}), "value-counts"), keys, probs).drop("rows")
