"""Importing and storing observation, profile and alert tables."""

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beaconlake.operators.profiles import profile_counts, profiles_of, upsert_profiles
from beaconlake.operators.supervised import drop_header_rows
from beaconlake.schema import PROFILE_SCHEMA
from beaconlake.session import materialise, new_path, numbered_folders
from beaconlake.sources.merged import MergedTable

# The columns that an import must have and those that hold numbers.
PROFILE_COLUMNS = [
    "ssid", "bssid", "rssi", "channel", "seq_jump", "clock_skew", "ie_count", "rate_count",
    "capabilities", "beacon_interval", "security", "supported_rates",
]
PROFILE_NUMBERS = [
    "rssi", "channel", "seq_jump", "clock_skew", "inter_beacon_ms", "timing_variance", "ie_count",
    "rate_count", "capabilities", "beacon_interval",
]
MODEL_COLUMNS = ["ssid", "bssid"]
MODEL_NUMBERS = [
    "rssi", "channel", "seq_jump", "seq_anomaly_score", "clock_skew", "inter_beacon_ms",
    "timing_variance", "ie_count", "rate_count", "capabilities", "beacon_interval",
    "security_encoded", "is_seq_duplicate", "seq_dup_delta",
]


def read_csv(spark: SparkSession, path: str, columns: Iterable[str] | None = None) -> DataFrame:
    """A CSV table with every column as text.

    Only empty cells are missing, so a network called ``NA`` keeps its name. Without ``columns``
    the header row names them.
    """
    reader = spark.read.option("header", True).option("nullValue", "")
    if columns is not None:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return reader.csv(path)


def require_columns(rows: DataFrame, required: Iterable[str]) -> DataFrame:
    """The rows, or an error that lists the missing columns."""
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return rows


def coerce_numbers(rows: DataFrame, columns: Iterable[str], fill: float | None = None) -> DataFrame:
    """Text to numbers; what is not a number becomes null, or ``fill``."""
    made = {}
    for name in columns:
        if name in rows.columns:
            number = F.nanvl(F.expr(f"try_cast({name} AS DOUBLE)"), F.lit(None).cast("double"))
            made[name] = number if fill is None else F.coalesce(number, F.lit(fill))
    return rows.withColumns(made)


def normalise_bssid(rows: DataFrame) -> DataFrame:
    """Lower-case addresses. Rows without one are left out; ``missing_bssid`` finds them."""
    return rows.filter(F.col("bssid").isNotNull()).withColumn("bssid", F.lower("bssid"))


def missing_bssid(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("bssid").isNull())


def clean_for_profiles(rows: DataFrame) -> DataFrame:
    """Checked observations for profile building; bad numbers stay missing."""
    checked = drop_header_rows(require_columns(rows, PROFILE_COLUMNS))
    return coerce_numbers(normalise_bssid(checked), PROFILE_NUMBERS)


def clean_for_models(rows: DataFrame) -> DataFrame:
    """Checked observations for model building; bad numbers become 0."""
    checked = drop_header_rows(require_columns(rows, MODEL_COLUMNS))
    return coerce_numbers(normalise_bssid(checked), MODEL_NUMBERS, 0.0)


def read_profiles_json(spark: SparkSession, path: str) -> DataFrame:
    """Profiles from JSON files that map an address to its profile; keys are lower-cased."""
    texts = spark.read.text(path, wholetext=True).select("value")
    entry = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in PROFILE_SCHEMA)
    parsed = F.from_json("value", F.lit(f"map<string, struct<{entry}>>"))
    return texts.select(F.explode(parsed).alias("key", "profile")).select(
        *[
            F.lower("key").alias(c) if c == "bssid" else F.col(f"profile.{c}").alias(c)
            for c in PROFILE_SCHEMA.fieldNames()
        ]
    )


def profile_entries_json(profiles: DataFrame) -> DataFrame:
    """One JSON member per access point, ``bssid`` and ``entry``; any number of profiles."""
    return profiles.select(
        "bssid", F.to_json(F.struct(*[F.col(c) for c in profiles.columns])).alias("entry")
    )


def write_profiles_json(profiles: DataFrame, path: str, per_document: int = 100_000) -> None:
    """Profiles as JSON maps, one complete document per output file, readable again as above.

    Access points are spread over documents by hash, about ``per_document`` to each. A document
    is a folder ``file=<n>`` with one file, so that two never share one.
    """
    files = F.pmod(F.xxhash64("bssid"), F.lit(max(1, -(-profiles.count() // per_document))))
    entry = F.struct(F.col("bssid"), F.struct(*profiles.columns))
    documents = profiles.groupBy(files.alias("file")).agg(
        F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")
    )
    documents.write.partitionBy("file").text(path)


def store_profile(spark: SparkSession, new: DataFrame, current: str | None = None) -> str:
    """Replace or add profiles and write the result as a new table version; returns its path."""
    merged = new if current is None else upsert_profiles(spark.read.parquet(current), new)
    path = new_path(spark, "profile-store")
    merged.write.parquet(path)
    return path


def add_session(spark: SparkSession, session: DataFrame, store: str, number: int) -> DataFrame:
    """Add a session's observations to the profiles in ``store``; returns all profiles.

    The store keeps value counts, which add up. The session's counts become a delta, and only the profiles of
    its access points are derived again, from counts; no earlier observation is read. ``number`` rises
    from session to session; the same number again replaces the session it had.
    """
    counts = MergedTable(spark, f"{store}/counts", ["bssid", "field", "num", "txt"], {"n": "sum(n)"})
    delta = counts.add(profile_counts(session), number)
    changed = counts.read().join(delta.select("bssid").distinct(), "bssid", "left_semi")
    derived = profiles_of(materialise(changed, "changed-counts"))
    earlier = [n for n in numbered_folders(spark, f"{store}/profiles", "version") if n < number]
    if earlier:
        derived = upsert_profiles(spark.read.parquet(f"{store}/profiles/version={max(earlier)}"), derived)
    path = f"{store}/profiles/version={number}"
    derived.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def append_table(rows: DataFrame, path: str) -> None:
    """Append a batch of rows to a stored table."""
    rows.write.mode("append").parquet(path)
