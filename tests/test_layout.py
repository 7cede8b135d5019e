"""The bucketed and dated table of beacons."""

import datetime
import random
import uuid

import pytest
from pyspark.sql import functions as F

from beaconlake.operators.features import sequence_features
from beaconlake.sources import layout

DAY = 86_400_000_000


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(spark, make_beacons, path):
    """Beacons of three days in two appends, and the table that has them."""
    draw = random.Random(3)
    rows = make_beacons(
        [
            {"bssid": f"ap{draw.randrange(5)}", "seq_num": draw.randrange(40), "capture_us": draw.randrange(3 * DAY) // 1000 * 1000}
            for _ in range(400)
        ]
    )
    name = f"beacons_{uuid.uuid4().hex}"
    for half in (0, 1):
        layout.store_beacons(rows.filter(F.col("frame_id") % 2 == half), name, path("table"), buckets=4)
    yield rows, name
    spark.sql(f"DROP TABLE {name}")


def made(rows):
    return sorted(tuple(r) for r in sequence_features(rows).drop("slice", layout.DATE).collect())


def test_features_need_no_exchange(spark, stored):
    rows, name = stored
    features = sequence_features(spark.table(name))
    assert "Exchange" not in plan_of(features) and "Exchange" in plan_of(sequence_features(rows))
    assert made(spark.table(name)) == made(rows)


def test_a_time_range_reads_its_dates(spark, stored):
    rows, name = stored
    part = layout.captured_between(spark.table(name), DAY + 5, 2 * DAY)
    plan = plan_of(part)
    filters = plan[plan.index("PartitionFilters") :].split("]")[0]
    assert layout.DATE in filters and part.filter("capture_us < 86400005").count() == 0
    assert part.count() == rows.filter(F.col("capture_us").between(DAY + 5, 2 * DAY - 1)).count() > 50
    assert {r[0] for r in part.select(layout.DATE).distinct().collect()} == {datetime.date(1970, 1, 2)}
    assert layout.captured_between(spark.table(name), 2 * DAY - 1, 2 * DAY).count() in (0, 1)


def test_compaction_keeps_rows_and_layout(spark, stored):
    rows, name = stored
    before = spark.table(name).filter("capture_date = DATE'1970-01-02'")
    files, content = len(set(before.select(F.input_file_name()).distinct().collect())), made(spark.table(name))
    layout.compact_date(spark, name, datetime.date(1970, 1, 2))
    after = spark.table(name).filter("capture_date = DATE'1970-01-02'")
    assert len(set(after.select(F.input_file_name()).distinct().collect())) < files
    assert made(spark.table(name)) == content
    assert "Exchange" not in plan_of(sequence_features(spark.table(name)))
