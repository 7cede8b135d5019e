"""Beacons laid out for sequential work: partitioned by capture date, bucketed and sorted by key.

Sequential windows run per ``(sensor_id, bssid)``. A table that is bucketed by these columns already has a
key's rows together, so features read it without an exchange, and a time range reads the files of its
dates only.
"""

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconlake.schema import KEY, ORDER
from beaconlake.session import materialise

DATE = "capture_date"
DAY_US = 86_400_000_000
#: Writers of one bucket and date: a quarter of a day each, so that a hot key is not one task.
PART_US = DAY_US // 4


def capture_date(capture_us: Column) -> Column:
    """The UTC date of a capture time, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(capture_us / DAY_US).cast("int"))


def store_beacons(beacons: DataFrame, table: str, path: str, buckets: int = 200) -> None:
    """Append beacons to the table ``table`` under ``path``, which is made if it is not there.

    ``buckets`` counts once for the table's life: about the number of tasks that should read it.
    """
    bucket = F.pmod(F.hash(*KEY), F.lit(buckets))
    dated = beacons.withColumn(DATE, capture_date(F.col("capture_us")))
    dealt = dated.repartition(bucket, DATE, F.expr(f"capture_us div {PART_US}"))
    (
        dealt.write.format("parquet").mode("append").option("path", path)
        .partitionBy(DATE).bucketBy(buckets, *KEY).sortBy(*KEY, *ORDER).saveAsTable(table)
    )


def compact_date(spark: SparkSession, table: str, date: datetime.date) -> None:
    """Rewrite one date of the table, so that many small appends become few files again."""
    rows = spark.table(table).filter(F.col(DATE) == F.lit(date))
    # What is being replaced cannot be read at the same time.
    staged = materialise(rows.drop(DATE), "compacted-date")
    buckets = int(next(r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect() if r["col_name"] == "Num Buckets"))
    bucket = F.pmod(F.hash(*KEY), F.lit(buckets))
    staged.repartition(bucket, F.expr(f"capture_us div {PART_US}")).createOrReplaceTempView(f"{table}_staged")
    names = ", ".join(f"`{c}`" for c in staged.columns)
    spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION ({DATE} = DATE'{date}') SELECT {names} FROM {table}_staged")
    spark.catalog.dropTempView(f"{table}_staged")


def captured_between(table: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Rows of a time range; only the files of its dates are read."""
    dates = F.col(DATE).between(capture_date(F.lit(start_us)), capture_date(F.lit(end_us - 1)))
    return table.filter(dates & (F.col("capture_us") >= start_us) & (F.col("capture_us") < end_us))
