"""Live detection: one stateful operator per access point from frames to alerts."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from beaconlake.operators import inventory
from beaconlake.operators.alerts import alert_log, emitted
from beaconlake.operators.decode import decode_frames, observations
from beaconlake.operators.deviations import with_profile
from beaconlake.operators.iforest import BROADCAST_NODES, Forest, packed_models, path_scores, unpack_model
from beaconlake.operators.ranking import bucketed_row_number
from beaconlake.operators.rules import with_reasons
from beaconlake.schema import (
    BEACON_SCHEMA, COOLDOWN_US, COUNT_TOLERANCE, DUPLICATE_GAP_US, EVIDENCE_WEIGHTS, FRAME_SCHEMA, HISTORY, KEY,
    MIN_HISTORY, MODEL_THRESHOLD, ORDER, REQUIRED_STREAK, SECURITY_CODES, SEQ_MODULUS, SKEW_FLOOR,
    SKEW_GAP_US, SKEW_SIGMAS, STRONG_EVIDENCE, SUSPICION_THRESHOLD, UNKNOWN,
)
from beaconlake.session import materialise, path_exists
from beaconlake.sources.merged import MergedTable

# Without it a backlog would be one batch, and one key's share of it held by one worker. Bytes, because files have any
# size; a beacon takes about 18 of them in a file and 500 in a worker, so all of a batch would fit one worker.
BATCH_LIMIT = {"maxBytesPerTrigger": str(64 << 20)}
# Rows of a file that ``arrive_in_order`` adds, less than a batch.
FILE_ROWS, GROUP_BYTES = 2_000_000, 4 << 20
# Rows of a key that features are computed for at once: as a frame, with its texts and what is made of
# it, a row takes some kilobytes in passing.
STEP_ROWS = 1 << 14
# Configuration of a session whose streams keep models in their state.
SEEDED_STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
STATE_SCHEMA = (
    "last_us bigint, last_id bigint, last_seq int, last_tsf bigint, gaps array<double>, "
    "seqs array<int>, seq_us array<bigint>, streak bigint, last_alert_us bigint"
)
FEATURE_FIELDS = [
    T.StructField("is_late", T.BooleanType()),
    T.StructField("seq_jump", T.IntegerType()),
    T.StructField("seq_anomaly_score", T.DoubleType()),
    T.StructField("is_seq_duplicate", T.IntegerType()),
    T.StructField("seq_dup_delta", T.DoubleType()),
    T.StructField("clock_skew", T.DoubleType()),
    T.StructField("valid_skew", T.IntegerType()),
    T.StructField("inter_beacon_ms", T.DoubleType()),
    T.StructField("timing_variance", T.DoubleType()),
    T.StructField("security_encoded", T.IntegerType()),
]
DETECTION_FIELDS = (
    [T.StructField("model_score", T.DoubleType())]
    + [T.StructField(f"ev_{rule}", T.IntegerType()) for rule in EVIDENCE_WEIGHTS]
    + [
        T.StructField("suspicious", T.IntegerType()),
        T.StructField("threat_score", T.DoubleType()),
        T.StructField("streak", T.IntegerType()),
        T.StructField("is_alert", T.BooleanType()),
    ]
)


def _steps(values: pd.Series, last: int | None) -> tuple[np.ndarray, ...]:
    """The values, which are there, the steps from one to the next, and where both ends are there."""
    there = values.notna().to_numpy()
    numbers = values.fillna(0).to_numpy(dtype=np.int64)
    steps = np.diff(numbers, prepend=numbers[0] if last is None else last)
    return numbers, there, steps, there & np.append(last is not None, there[:-1])


def _features(rows: pd.DataFrame, past: dict, tiers: int) -> pd.DataFrame:
    """Sequential features of time-ordered rows of one key, continuing from its state."""
    first = past["last_us"] is None
    us = rows["capture_us"].to_numpy()
    tsf, has_tsf, tsf_gap, both_tsf = _steps(rows["beacon_timestamp"], past["last_tsf"])
    seq, has_seq, seq_step, both_seq = _steps(rows["seq_num"], past["last_seq"])
    gap = np.diff(us, prepend=us[0] if first else past["last_us"])
    jump = np.where(both_seq, seq_step % SEQ_MODULUS, 0)
    seen = np.ones(len(rows), dtype=bool)
    seen[0] = not first

    valid = seen & (gap >= SKEW_GAP_US[0]) & (gap <= SKEW_GAP_US[1])
    skew = np.where(valid & ~both_tsf, np.nan, 0.0)
    measured = valid & both_tsf
    skew[measured] = (tsf_gap[measured] - gap[measured]) / gap[measured]
    score = np.where(jump > 100, np.minimum(1.0, jump / 1000), 0.0)
    if tiers == 3:
        score = np.where((jump > 10) & (jump <= 100), 0.3, score)

    known = dict(zip(past["seqs"], past["seq_us"]))
    before = rows["capture_us"].groupby(rows["seq_num"]).shift()
    before = before.fillna(rows["seq_num"].map(known)).to_numpy(dtype=float)
    seq_gap = us - before
    low, high = DUPLICATE_GAP_US

    gap_ms = np.where(seen, gap / 1000.0, np.nan)
    padded = np.concatenate([np.full(HISTORY, np.nan), past["gaps"], gap_ms])
    recent = np.lib.stride_tricks.sliding_window_view(padded, HISTORY)[-len(rows):]
    enough = np.sum(~np.isnan(recent), axis=1) >= MIN_HISTORY
    variance = np.zeros(len(rows))
    variance[enough] = np.nanvar(recent[enough], axis=1)

    known.update(zip(seq[has_seq].tolist(), us[has_seq].tolist()))
    kept = padded[~np.isnan(padded)][-HISTORY:]
    past.update(
        last_us=int(us[-1]), last_id=int(rows["frame_id"].iloc[-1]), last_seq=int(seq[-1]) if has_seq[-1] else None,
        last_tsf=int(tsf[-1]) if has_tsf[-1] else None, gaps=kept.tolist(), seqs=list(known), seq_us=list(known.values()),
    )
    return rows.assign(
        is_late=False,
        seq_jump=jump.astype(np.int32),
        seq_anomaly_score=np.round(score, 4),
        is_seq_duplicate=((seq_gap > low) & (seq_gap < high)).astype(np.int32),
        seq_dup_delta=np.nan_to_num(np.round(seq_gap / 1e6, 6)),
        clock_skew=np.round(skew, 8),
        valid_skew=valid.astype(np.int32),
        inter_beacon_ms=np.nan_to_num(gap_ms),
        timing_variance=np.round(variance, 6),
        security_encoded=rows["security"].map(SECURITY_CODES).fillna(0).astype(np.int32),
    )


def _evidence(rows: pd.DataFrame, past: dict) -> pd.DataFrame:
    """Rules, streak and alert decision for rows that already have their features."""
    known = rows["p_known"].fillna(False).astype(bool)
    std = rows["p_clock_skew_std"].astype(float).fillna(0.0)
    mean = rows["p_clock_skew_mean"].astype(float).fillna(0.0)
    valid = rows["valid_skew"] == 1
    z = (rows["clock_skew"] - mean).abs() / std.where(std > 0, np.nan)
    fired = {
        "duplicate_sequence": rows["is_seq_duplicate"] == 1,
        "ie_count": (rows["ie_count"] - rows["p_ie_count"]).abs() >= COUNT_TOLERANCE,
        "security": ~(
            (rows["security"] == rows["p_security"]) | (rows["security"].isna() & rows["p_security"].isna())
        ),
        "timing": valid & (z > SKEW_SIGMAS) & (rows["clock_skew"].abs() > SKEW_FLOOR),
        "rate_count": (rows["rate_count"] - rows["p_rate_count"]).abs() >= COUNT_TOLERANCE,
        "model": valid & (rows["model_score"].astype(float) < MODEL_THRESHOLD),
    }
    flags = {rule: (known & hit.fillna(False)).astype(np.int32) for rule, hit in fired.items()}
    points = sum(flags[rule] * weight for rule, weight in EVIDENCE_WEIGHTS.items())
    strong = sum(flags[rule] for rule in STRONG_EVIDENCE) > 0
    suspicious = (strong | (points >= SUSPICION_THRESHOLD)).to_numpy()

    at = np.arange(len(rows))
    cleared = np.maximum.accumulate(np.where(suspicious, -1, at))
    streak = np.where(cleared >= 0, at - cleared, at + 1 + past["streak"])
    streak = np.where(suspicious, streak, 0)
    candidates = np.flatnonzero(streak >= REQUIRED_STREAK)
    us = rows["capture_us"].to_numpy()
    alert = np.zeros(len(rows), dtype=bool)
    alert[candidates[emitted(us[candidates], past["last_alert_us"])]] = True
    if alert.any():
        past["last_alert_us"] = int(us[alert][-1])
    past["streak"] = int(streak[-1])
    return rows.assign(
        **{f"ev_{rule}": flag for rule, flag in flags.items()},
        suspicious=suspicious.astype(np.int32),
        threat_score=np.minimum(100, points) / 100.0,
        streak=streak.astype(np.int32),
        is_alert=alert,
    )


EMPTY_PAST = {
    "last_us": None, "last_id": None, "last_seq": None, "last_tsf": None, "gaps": [], "seqs": [],
    "seq_us": [], "streak": 0, "last_alert_us": None,
}


def _model_scores(made: pd.DataFrame, model: dict, features: tuple[str, ...]) -> np.ndarray:
    """Decision scores of one access point's rows; missing where the skew is not valid."""
    points = np.column_stack(
        [np.nan_to_num(made[f].astype(float)) if f in made else np.zeros(len(made)) for f in features]
    )
    scores = path_scores((points - model["means"]) / model["scales"], model) - model["offset"]
    return np.where(made["valid_skew"] == 1, scores, np.nan)


def _held(batches: Iterator[pd.DataFrame], schema: T.StructType) -> pa.Table:
    """One key's frames of a batch in columns, texts as numbers into their few distinct values.

    This is about a tenth of what pandas needs for the same rows, and only steps of it become pandas frames.
    """
    parts = []
    for frame in batches:
        columns = {}
        for field in schema.fields:
            if field.name in frame.columns:
                column = pa.array(frame[field.name], to_arrow_type(field.dataType), from_pandas=True, safe=False)
                columns[field.name] = column.dictionary_encode() if pa.types.is_string(column.type) else column
        parts.append(pa.table(columns))
    return pa.concat_tables(parts).unify_dictionaries()


def _frame(table: pa.Table, at: np.ndarray) -> pd.DataFrame:
    """Some rows as a frame."""
    part = table.take(pa.array(at))
    plain = [c.cast(c.type.value_type) if pa.types.is_dictionary(c.type) else c for c in part.columns]
    return pa.table(plain, names=part.column_names).to_pandas()


def _advance(
    held: pa.Table, past: dict, tiers: int, detect: bool, model: dict | None, features: tuple[str, ...]
) -> Iterator[pd.DataFrame]:
    """What one key's frames of a batch add to its past: late frames, then the rest in time order, in steps."""
    us, ids = held["capture_us"].to_numpy(), held["frame_id"].to_numpy()
    order = np.lexsort((ids, us))
    if past["last_us"] is not None:
        newer = (us > past["last_us"]) | ((us == past["last_us"]) & (ids > past["last_id"]))
        late, order = order[~newer[order]], order[newer[order]]
        for at in range(0, len(late), STEP_ROWS):
            # Late frames are reported, and leave the state alone.
            yield _frame(held, late[at : at + STEP_ROWS]).assign(is_late=True)
    for at in range(0, len(order), STEP_ROWS):
        made = _features(_frame(held, order[at : at + STEP_ROWS]), past, tiers)
        if detect:
            made["model_score"] = np.nan if model is None else _model_scores(made, model, features)
            made = _evidence(made, past)
        yield made


def _per_key(schema: T.StructType, detect: bool, tiers: int, packed=None, features=()):
    names = schema.fieldNames()

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # One key's frames of one micro-batch; the source's batch limit bounds them.
        rows = _held(batches, schema)
        past = dict(zip(EMPTY_PAST, state.get, strict=True)) if state.exists else dict(EMPTY_PAST)
        model = packed.value.get(key[1]) if packed is not None else None
        for made in _advance(rows, past, tiers, detect, model, features):
            yield made.reindex(columns=names)
        state.update(tuple(past.values()))

    return step


class SeededDetection(StatefulProcessor):
    """Detection whose state holds the access point's own model, seeded before the first batch.

    Groups are access points, because a model belongs to one; the past of each sensor that hears it is
    kept apart. A model is read from the state once in a batch, so no task holds more than one.
    """

    def __init__(self, schema: T.StructType, features: tuple[str, ...], tiers: int = 2):
        self.schema, self.features, self.tiers = schema, features, tiers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.model = handle.getValueState("model", "model binary")
        self.past = handle.getMapState("past", "sensor_id string", STATE_SCHEMA)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.model.update((bytes(initialState["model"].iloc[0]),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        model = unpack_model(self.model.get()[0]) if self.model.exists() else None
        held = _held(rows, self.schema)
        for sensor in pc.unique(held["sensor_id"]).to_pylist():
            # A missing sensor is a sensor too; the map needs a text for it.
            mine = pc.is_null(held["sensor_id"]) if sensor is None else pc.equal(held["sensor_id"], sensor)
            name = ("" if sensor is None else f"={sensor}",)
            past = dict(EMPTY_PAST)
            if self.past.containsKey(name):
                past = dict(zip(EMPTY_PAST, self.past.getValue(name), strict=True))
            for made in _advance(held.filter(mine), past, self.tiers, True, model, self.features):
                yield made.reindex(columns=self.schema.fieldNames())
            self.past.updateValue(name, tuple(past.values()))

    def close(self) -> None:
        pass


def _stateful(rows: DataFrame, added: list[T.StructField], detect: bool, tiers: int, **model) -> DataFrame:
    schema = T.StructType(rows.schema.fields + added)
    return rows.groupBy(*KEY).applyInPandasWithState(
        _per_key(schema, detect, tiers, **model), schema, STATE_SCHEMA, "append",
        GroupStateTimeout.NoTimeout,
    )


def stream_features(beacons: DataFrame, tiers: int = 3) -> DataFrame:
    """Sequential features on a stream of beacons."""
    return _stateful(beacons, FEATURE_FIELDS, False, tiers)


def stream_detection(
    beacons: DataFrame, profiles: DataFrame, forest: Forest | None = None,
    broadcast_nodes: int = BROADCAST_NODES,
) -> DataFrame:
    """Features, evidence, streak and alert decision on a stream of beacons.

    Uses capture time, so a replay gives the same alerts. A forest of up to ``broadcast_nodes`` nodes is
    broadcast. A larger one becomes the initial state of the stream: every access point's model goes to
    the partition that holds its state, so a fleet may have models of any size together. That state
    needs a session with ``SEEDED_STATE`` in its configuration.
    """
    joined = with_profile(beacons.select(*BEACON_SCHEMA.fieldNames()), profiles)
    added = FEATURE_FIELDS + DETECTION_FIELDS
    if forest is None:
        return _stateful(joined, added, True, 2)
    features = tuple(forest.features)
    if forest.node_count() <= broadcast_nodes:
        models = {r.model_key: unpack_model(r.model) for r in packed_models(forest).collect()}
        packed = joined.sparkSession.sparkContext.broadcast(models)
        return _stateful(joined, added, True, 2, packed=packed, features=features)
    schema = T.StructType(joined.schema.fields + added)
    # The stored models are read again by the stream's own session.
    models = packed_models(forest).withColumnRenamed("model_key", "bssid")
    stored = materialise(models, "stream-models").inputFiles()[0].rsplit("/", 1)[0]
    seeds = joined.sparkSession.read.schema(models.schema).parquet(stored)
    return joined.groupBy("bssid").transformWithStateInPandas(
        SeededDetection(schema, features), schema, "append", "none", seeds.groupBy("bssid")
    )


def alerts_of(detected: DataFrame) -> DataFrame:
    """The alert rows of a detection stream, with their reasons."""
    return with_reasons(detected.filter("is_alert")).select(
        "frame_id", *KEY, F.timestamp_micros("capture_us").alias("alert_time"), "capture_us",
        "ssid", "channel", "rssi", F.round(F.col("threat_score") * 100, 1).alias("threat_score_100"),
        "streak", "reasons",
    )


def _limited(options: dict) -> dict:
    """Spark takes either a limit of bytes or one of files."""
    return options if "maxFilesPerTrigger" in options else BATCH_LIMIT | options


def read_frames(spark: SparkSession, path: str, **options) -> DataFrame:
    """Stream of captured frames from a folder of Parquet files, up to 64 MiB of files to a batch."""
    return spark.readStream.schema(FRAME_SCHEMA).options(**_limited(options)).parquet(path)


def read_beacons(spark: SparkSession, path: str, **options) -> DataFrame:
    """Stream of beacon rows from a folder of Parquet files, up to 64 MiB of files to a batch."""
    return spark.readStream.schema(BEACON_SCHEMA).options(**_limited(options)).parquet(path)


def arrive_in_order(rows: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """Add stored rows to a folder that a stream reads, so that no frame comes in a later batch than one captured after it.

    Streams take files by their time of writing. Files of a table written in parallel hold any times, so a
    stream that needs more than one batch for them would find most frames late.
    """
    parts = -(-rows.count() // file_rows)
    files = [rows]
    if parts > 1:
        ranged = materialise(rows.repartitionByRange(parts, "capture_us"), "capture-order")
        files = [rows.sparkSession.read.schema(ranged.schema).parquet(file) for file in sorted(ranged.inputFiles())]
    for file in files:
        # One file, because a batch may end between two; in small row groups, so that many tasks read it.
        file.coalesce(1).write.mode("append").option("parquet.block.size", GROUP_BYTES).parquet(path)


def networks_table(spark: SparkSession, path: str) -> MergedTable:
    """The merged partial rows of every network that a live list or a collection has heard."""
    return MergedTable(spark, path, ["bssid"], inventory.NETWORK_PARTIALS)


def live_networks(beacons: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep a list of all networks up to date while beacons arrive; ``network_list`` reads it.

    Every batch stores the partial rows of the networks it heard, whatever the number of those heard before.
    """

    def write(batch: DataFrame, number: int) -> None:
        networks_table(batch.sparkSession, path).add(inventory.network_partials(batch), number)

    return (
        beacons.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def network_list(spark: SparkSession, path: str) -> DataFrame:
    """The networks of a live list as of its last batch."""
    return inventory.inventory_of(networks_table(spark, path).read())


def session_totals(spark: SparkSession, path: str) -> DataFrame:
    """The running counters of a collection that was given ``totals``: exact, also after a restart."""
    return inventory.collection_totals(networks_table(spark, path).read())


def collect_baseline(
    frames: DataFrame, table: str, checkpoint: str, totals: str | None = None, **trigger
) -> StreamingQuery:
    """Decode frames, add features and append them to a table, exactly once.

    Each batch reports its beacons, access points and latest capture time; ``CollectionTotals`` adds up.
    With ``totals`` every batch has its own folder in the table, ``batch=<id>``, and adds to a table of
    networks, from which ``session_totals`` has the counters of the whole session.
    """
    rows = stream_features(observations(decode_frames(frames), UNKNOWN))
    counted = rows.observe(
        "collection",
        F.count("*").alias("beacons"), F.approx_count_distinct("bssid").alias("access_points"),
        F.max("capture_us").alias("latest_us"),
    ).withColumn("label", F.lit(0))

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            batch.write.mode("overwrite").parquet(f"{table}/batch={number}")
            networks_table(batch.sparkSession, totals).add(inventory.network_partials(batch), number)
        finally:
            batch.unpersist()

    writer = counted.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    if totals is not None:
        return writer.foreachBatch(write).start()
    return writer.format("parquet").option("path", table).outputMode("append").start()


def _numbered(alerts: DataFrame, ledger: str, batch: int) -> DataFrame:
    """Continue the running alert number from the batch before, whose last one the ledger holds."""
    spark = alerts.sparkSession
    earlier = 0
    if batch > 0 and path_exists(spark, f"{ledger}/batch={batch - 1}"):
        earlier = spark.read.parquet(f"{ledger}/batch={batch - 1}").first()["alerts"]
    bucket = F.expr(f"capture_us div {COOLDOWN_US}")
    ranked = bucketed_row_number(alerts, [], bucket, [*ORDER, *KEY], "alert_number")
    return ranked.withColumn("alert_number", F.col("alert_number") + earlier)


def _note_total(spark: SparkSession, written: DataFrame, ledger: str, batch: int) -> None:
    """One row per batch in the ledger: the alerts up to and including it."""
    earlier = 0
    if batch > 0 and path_exists(spark, f"{ledger}/batch={batch - 1}"):
        earlier = spark.read.parquet(f"{ledger}/batch={batch - 1}").first()["alerts"]
    total = spark.range(1).select(F.lit(earlier + written.count()).cast("bigint").alias("alerts"))
    total.write.mode("overwrite").parquet(f"{ledger}/batch={batch}")


def run_detection(
    detected: DataFrame, alerts_path: str, checkpoint: str, log_path: str | None = None,
    late_path: str | None = None, **trigger,
) -> StreamingQuery:
    """Append each micro-batch's alerts, and on request their log text and the late frames.

    Every batch has its own folder, ``batch=<id>``, so a batch that is run again after a failure
    replaces its output instead of adding to it. A ledger beside the checkpoint holds the number of
    alerts up to each batch, so numbering reads one row and not the earlier alerts.
    """
    ledger = f"{checkpoint.rstrip('/')}-ledger"

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            path = f"{alerts_path}/batch={number}"
            _numbered(alerts_of(batch), ledger, number).write.mode("overwrite").parquet(path)
            written = batch.sparkSession.read.parquet(path)
            _note_total(batch.sparkSession, written, ledger, number)
            if log_path is not None:
                log = alert_log(written).orderBy("alert_number", "line")
                log.select("text").write.mode("overwrite").text(f"{log_path}/batch={number}")
            if late_path is not None:
                late = batch.filter("is_late").select(*BEACON_SCHEMA.fieldNames())
                late.write.mode("overwrite").parquet(f"{late_path}/batch={number}")
        finally:
            batch.unpersist()

    observed = detected.observe(
        "detection",
        F.count(F.when(~F.col("is_late"), 1)).alias("frames_evaluated"),
        F.count(F.when(F.col("is_alert"), 1)).alias("alerts"),
        F.count(F.when(F.col("is_late"), 1)).alias("late_frames"),
    )
    return (
        observed.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


class SessionTotals(StreamingQueryListener):
    """Running totals of a detection query, and a line for every batch."""

    def __init__(self, report=print):
        self.totals = {"frames_evaluated": 0, "alerts": 0, "late_frames": 0}
        self.report = report

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get("detection")
        if row is not None:
            for name in self.totals:
                self.totals[name] += row[name] or 0
            self.report(" | ".join(f"{k}: {v}" for k, v in self.totals.items()))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


class CollectionTotals(StreamingQueryListener):
    """Running counters of a collector: beacons so far, access points of the batch, latest time."""

    def __init__(self, report=print):
        self.totals = {"beacons": 0, "access_points": 0, "latest_us": 0}
        self.report = report

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get("collection")
        if row is not None:
            self.totals["beacons"] += row["beacons"] or 0
            self.totals["access_points"] = row["access_points"] or 0
            self.totals["latest_us"] = max(self.totals["latest_us"], row["latest_us"] or 0)
            self.report(" | ".join(f"{k}: {v}" for k, v in self.totals.items()))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
