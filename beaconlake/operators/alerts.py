"""From suspicious frames to confirmed, rate-limited, numbered alerts."""

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beaconlake.operators.ranking import bucketed_row_number
from beaconlake.operators.rules import with_reasons
from beaconlake.operators.slicing import SLICED_KEY
from beaconlake.schema import COOLDOWN_US, KEY, ORDER, REQUIRED_STREAK
from beaconlake.session import materialise


def suspicion_streaks(rows: DataFrame) -> DataFrame:
    """Add ``streak``: consecutive suspicious frames of the key up to and including this one.

    Partitioned like the sequential features, so it needs no further exchange. Slices of a hot key
    receive the length of the streak that is running when they start.
    """
    in_time = Window.partitionBy(*SLICED_KEY).orderBy(*ORDER)
    numbered = rows.withColumn("_at", F.row_number().over(in_time)).withColumn(
        "_clear_at", F.max(F.when(F.col("suspicious") == 0, F.col("_at"))).over(in_time)
    )
    ends = (
        numbered.filter(F.col("slice").isNotNull())
        .groupBy(*SLICED_KEY)
        .agg(F.max("_at").alias("rows"), F.max("_clear_at").alias("clear_at"))
        .withColumn("trailing", F.col("rows") - F.coalesce("clear_at", F.lit(0)))
    )
    earlier = (
        Window.partitionBy(*KEY).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        ends.withColumn("before", F.coalesce(F.sum("trailing").over(earlier), F.lit(0)))
        .withColumn(
            "base",
            F.coalesce(F.max(F.when(F.col("clear_at").isNotNull(), F.col("before"))).over(earlier), F.lit(0)),
        )
        .select(*SLICED_KEY, (F.col("before") - F.col("base")).alias("_carried"))
    )
    run = F.when(F.col("_clear_at").isNotNull(), F.col("_at") - F.col("_clear_at")).otherwise(
        F.col("_at") + F.coalesce("_carried", F.lit(0))
    )
    return (
        numbered.join(carried, SLICED_KEY, "left")
        .withColumn("streak", F.when(F.col("suspicious") == 1, run).otherwise(0).cast("int"))
        .drop("_at", "_clear_at", "_carried")
    )


def emitted(times: np.ndarray, last: int | None, cooldown: int = COOLDOWN_US) -> np.ndarray:
    """Positions in ascending ``times`` that are at least ``cooldown`` after the last emitted."""
    at = 0 if last is None else int(np.searchsorted(times, last + cooldown))
    found = []
    while at < len(times):
        found.append(at)
        at = int(np.searchsorted(times, times[at] + cooldown))
    return np.array(found, dtype=np.int64)


@dataclass
class Steps:
    """Last alert that a stretch of candidates ends with, as a step function of when it may first alert.

    A first allowed time of at most ``upto[i]``, and above ``upto[i - 1]``, ends with
    ``exits[i]``; one above all of them raises nothing. Only times up to one cooldown past the first
    candidate can matter, because whatever alerted before was earlier than that candidate: there are
    no more steps than one cooldown has candidates, and one.
    """

    first: int
    upto: np.ndarray
    exits: np.ndarray

    def merged(self) -> "Steps":
        """The same function with one step for each run of equal exits."""
        final = np.append(self.exits[1:] != self.exits[:-1], True)
        return Steps(self.first, self.upto[final], self.exits[final])

    def after(self, last: np.ndarray, cooldown: int = COOLDOWN_US) -> np.ndarray:
        """Last alert at the end, from the last one before the start."""
        at = np.searchsorted(self.upto, last + cooldown)
        return np.where(at < len(self.upto), self.exits[np.minimum(at, len(self.upto) - 1)], last)

    def then(self, later: "Steps", cooldown: int = COOLDOWN_US) -> "Steps":
        """The function of both stretches in turn. The operation is associative."""
        # What passes all steps of the first stretch meets the later one unchanged.
        before = np.append(self.upto[-1], np.maximum(later.upto[:-1], self.upto[-1]))
        needed = (later.upto > self.upto[-1]) & (before < self.first + cooldown)
        return Steps(
            self.first, np.append(self.upto, later.upto[needed]),
            np.append(later.after(self.exits, cooldown), later.exits[needed]),
        ).merged()


def slice_exits(times: np.ndarray, cooldown: int = COOLDOWN_US) -> Steps:
    """The step function of ascending candidate times."""
    following = np.searchsorted(times, times + cooldown)
    starts = np.arange(min(len(times), int(following[0]) + 1))
    last = starts.copy()
    while True:
        step = following[last]
        moving = step < len(times)
        if not moving.any():
            break
        last = np.where(moving, step, last)
    return Steps(int(times[0]), times[starts], times[last]).merged()


STEPS = "sensor_id string, bssid string, node bigint, first bigint, upto array<bigint>, exits array<bigint>"


def _steps_table(table: pa.Table, node: int, steps: Steps) -> pa.Table:
    lists = {n: pa.array([getattr(steps, n)], pa.list_(pa.int64())) for n in ("upto", "exits")}
    return pa.table({**{c: table[c].slice(0, 1) for c in KEY}, "node": [node], "first": [steps.first], **lists})


def _leaf(table: pa.Table) -> pa.Table:
    """The step function of one slice."""
    return _steps_table(table, table["slice"][0].as_py(), slice_exits(np.sort(table["capture_us"].to_numpy())))


def _steps_of(row: dict) -> Steps:
    return Steps(row["first"], np.array(row["upto"], np.int64), np.array(row["exits"], np.int64))


def _merge(table: pa.Table) -> pa.Table:
    """The step function of a node from those of its one or two children."""
    children = sorted(table.to_pylist(), key=lambda row: row["node"])
    steps = reduce(Steps.then, map(_steps_of, children))
    return _steps_table(table, children[0]["node"] // 2, steps)


def _entry_pair(children: pa.Table, parents: pa.Table) -> pa.Table:
    """Last alert before each child, from the one before their parent."""
    rows = sorted(children.to_pylist(), key=lambda row: row["node"])
    last = parents["last_alert_us"][0].as_py() if len(parents) else None
    entries = []
    for row in rows:
        entries.append(last)
        steps = _steps_of(row)
        last = int(steps.exits[0] if last is None else steps.after(np.array([last]))[0])
    return pa.table(
        {
            **{c: pa.chunked_array([children[c].slice(0, 1).combine_chunks()] * len(rows)) for c in KEY},
            "node": [row["node"] for row in rows],
            "last_alert_us": pa.array(entries, pa.int64()),
        }
    )


def slice_entries(exits: DataFrame) -> DataFrame:
    """``KEY, slice, last_alert_us``: the last alert before each slice, from the slices' step functions.

    An up-sweep merges the functions of neighbours pairwise, level by level, until a key has one; a
    down-sweep hands the last alert before a node on to its children. No group holds more than
    two nodes, and ``n`` slices take ``log2(n)`` levels, each stored as a table.
    """
    levels = [exits]
    top = exits.agg(F.max("node")).first()[0] or 0
    while top:
        above = levels[-1].groupBy(*KEY, F.expr("node div 2").alias("parent")).applyInArrow(_merge, STEPS)
        levels.append(materialise(above, "cooldown-nodes"))
        top //= 2
    entries = levels.pop().select(*KEY, "node", F.lit(None).cast("bigint").alias("last_alert_us"))
    parent = F.expr("node div 2").alias("parent")
    while levels:
        children = levels.pop()
        handed = (
            children.groupBy(*KEY, parent)
            .cogroup(entries.withColumnRenamed("node", "parent").groupBy(*KEY, "parent"))
            .applyInArrow(_entry_pair, "sensor_id string, bssid string, node bigint, last_alert_us bigint")
        )
        entries = materialise(handed, "cooldown-entries")
    return entries.withColumnRenamed("node", "slice")


def _emit(table: pa.Table) -> pa.Table:
    ordered = table.sort_by([(c, "ascending") for c in ORDER])
    last = ordered["last_alert_us"][0].as_py()
    return ordered.take(emitted(ordered["capture_us"].to_numpy(), last)).drop(["last_alert_us"])


def cool_down(candidates: DataFrame) -> DataFrame:
    """Keep a candidate only when its key's previous kept one is at least 10 s older.

    The choice depends on earlier choices, so it is a fold. Groups are keys, or single slices of
    hot keys; for the latter a first pass reduces each slice to a small step function, from which
    the state at every slice start follows exactly.
    """
    exits = (
        candidates.filter(F.col("slice").isNotNull())
        .select(*SLICED_KEY, "capture_us")
        .groupBy(*SLICED_KEY)
        .applyInArrow(_leaf, STEPS)
    )
    exits = materialise(exits, "cooldown-exits")
    if exits.isEmpty():
        before = candidates.withColumn("last_alert_us", F.lit(None).cast("bigint"))
    else:
        before = candidates.join(slice_entries(exits), SLICED_KEY, "left")
    return before.groupBy(*SLICED_KEY).applyInArrow(_emit, candidates.schema)


def confirmed_alerts(
    streaks: DataFrame, required: int = REQUIRED_STREAK, numbering_bucket_us: int = COOLDOWN_US
) -> DataFrame:
    """Alert records: confirmed by streak, rate-limited, numbered in time order, with reasons.

    Candidates and alerts are each read twice below, so both are written as tables first.
    """
    candidates = materialise(streaks.filter(F.col("streak") >= required), "alert-candidates")
    alerts = materialise(cool_down(candidates), "alerts")
    numbered = bucketed_row_number(
        alerts, [], F.expr(f"capture_us div {numbering_bucket_us}"), [*ORDER, *KEY], "alert_number"
    )
    return with_reasons(numbered).select(
        "alert_number", "frame_id", *KEY,
        F.timestamp_micros("capture_us").alias("alert_time"), "capture_us", "ssid", "channel",
        "rssi", F.round(F.col("threat_score") * 100, 1).alias("threat_score_100"), "streak",
        "reasons",
    )


def alert_log(alerts: DataFrame) -> DataFrame:
    """Text log: one headline per alert followed by one line per reason."""
    headline = F.format_string(
        "[%s] ALERT #%d | SSID: %s | BSSID: %s | Threat Score: %.1f/100",
        F.date_format("alert_time", "yyyy-MM-dd HH:mm:ss"), "alert_number", "ssid", "bssid",
        "threat_score_100",
    )
    lines = F.concat(F.array(headline), F.transform("reasons", lambda r: F.concat(F.lit("  - "), r)))
    return alerts.select("alert_number", F.posexplode(lines).alias("line", "text"))
