"""Time slices for hot keys, so that no sequential window is bound to one task.

A key with more than ``rows_per_slice`` rows is cut into time slices. Sequential operators then
partition by ``(key, slice)`` and receive the few earlier rows they look back to as halo rows.
Other keys have a null slice and stay whole. Slices end where the row count of fine time buckets
says so, so a burst is cut as finely as a steady flow.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beaconlake.schema import HISTORY, KEY, ORDER
from beaconlake.session import materialise

ROWS_PER_SLICE = 250_000
# Rows of one task, about: windows sort them twice and buffer them, some two kilobytes a row in all.
ROWS_PER_TASK = 62_500
BUCKET_US = 1_000_000
SLICED_KEY = [*KEY, "slice"]
CARRIED = [*ORDER, "seq_num", "beacon_timestamp"]


def hot_slices(
    df: DataFrame, rows_per_slice: int = ROWS_PER_SLICE, bucket_us: int = BUCKET_US
) -> DataFrame:
    """``key, bucket, slice`` for the buckets of keys with more than ``rows_per_slice`` rows.

    Consecutive buckets share a slice until they hold ``rows_per_slice`` rows, so a slice has at
    most that many and one bucket's. Keys are counted per bucket before anything is shuffled.
    """
    buckets = df.groupBy(*KEY, F.expr(f"capture_us div {bucket_us}").alias("bucket")).agg(
        F.count("*").alias("n")
    )
    whole = Window.partitionBy(*KEY)
    upto = F.sum("n").over(whole.orderBy("bucket"))
    return (
        buckets.withColumn("total", F.sum("n").over(whole))
        .withColumn("slice", ((upto - F.col("n")) / rows_per_slice).cast("bigint"))
        .filter(F.col("total") > rows_per_slice)
        .select(*KEY, "bucket", "slice")
    )


def with_slices(
    df: DataFrame, rows_per_slice: int = ROWS_PER_SLICE, bucket_us: int = BUCKET_US
) -> tuple[DataFrame, int]:
    """Add ``slice``, and tell the rows of the table if there is any, else 0: null for ordinary keys, a number for hot ones.

    Hot keys are found by one pass over the key columns, right away. Without any, the
    slice is a null literal and Catalyst removes every hot-key branch from later plans; only otherwise
    the time buckets are counted. The table of slices is joined without a hint: it is stored, so
    Catalyst knows its size.
    """
    sizes = df.groupBy(*KEY).count().agg(F.coalesce(F.max("count"), F.lit(0)), F.coalesce(F.sum("count"), F.lit(0)))
    largest, rows = sizes.first()
    if largest <= rows_per_slice:
        return df.withColumn("slice", F.lit(None).cast("bigint")), 0
    hot = materialise(hot_slices(df, rows_per_slice, bucket_us), "hot-slices")
    bucketed = df.withColumn("bucket", F.expr(f"capture_us div {bucket_us}"))
    return bucketed.join(hot, [*KEY, "bucket"], "left").drop("bucket"), rows


def dealt_by_slice(sliced: DataFrame, rows: int) -> DataFrame:
    """The rows of a sliced table in enough tasks, with a slice in one.

    The number is stated: otherwise adaptive execution joins tasks until they hold 64 MiB of compressed
    shuffle, which may be millions of rows, as neighbouring beacons differ little.
    """
    parts = max(sliced.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))
    return sliced.repartition(parts, *SLICED_KEY)


def halo(sliced: DataFrame) -> DataFrame:
    """Rows from earlier slices that a slice of a hot key looks back to.

    These are the last 20 rows before the slice and, for each sequence number in it, the last
    earlier row with that number: at most 20 + 4096 rows per slice.
    """
    hot = sliced.filter(F.col("slice").isNotNull()).select(*SLICED_KEY, *CARRIED)
    newest = [F.desc(c) for c in ORDER]
    ends = (
        hot.withColumn(
            "seq_age", F.row_number().over(Window.partitionBy(*SLICED_KEY, "seq_num").orderBy(*newest))
        )
        .withColumn("age", F.row_number().over(Window.partitionBy(*SLICED_KEY).orderBy(*newest)))
        .filter((F.col("age") <= HISTORY) | (F.col("seq_age") == 1))
    )
    next_use = F.lead("slice").over(Window.partitionBy(*KEY, "seq_num").orderBy("slice"))
    last_of_seq = (
        ends.filter("seq_age = 1")
        .withColumn("slice", next_use)
        .filter(F.col("slice").isNotNull())
        .select(*SLICED_KEY, *CARRIED)
    )
    # Every slice has a row, so a slice's last rows reach no more than 20 slices on. Each slice learns of the next
    # ones' sizes, which are few numbers, and hands its last rows to those that look back to them.
    following = Window.partitionBy(*KEY).orderBy("slice").rowsBetween(1, HISTORY)
    sizes = hot.groupBy(*SLICED_KEY).agg(F.count("*").alias("n"))
    reached = sizes.select(
        *SLICED_KEY, F.collect_list(F.struct("slice", "n")).over(following).alias("next")
    ).select(*SLICED_KEY, F.posexplode("next").alias("at", "to"), "next").select(
        *SLICED_KEY, F.col("to.slice").alias("_to"),
        F.expr("aggregate(slice(next, 1, at), 0L, (total, x) -> total + x.n)").alias("_between"),
    ).filter(F.col("_between") < HISTORY)
    last_rows = (
        ends.filter(F.col("age") <= HISTORY)
        .join(reached, SLICED_KEY)
        .filter(F.col("age") + F.col("_between") <= HISTORY)
        .withColumn("slice", F.col("_to"))
        .select(*SLICED_KEY, *CARRIED)
    )
    return last_of_seq.unionByName(last_rows).dropDuplicates([*SLICED_KEY, *ORDER])
