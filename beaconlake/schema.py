"""Table schemas and the fixed values the computations depend on."""

from pyspark.sql import types as T

# One access point as heard by one receiver. Every sequential feature is kept per key.
KEY = ["sensor_id", "bssid"]
# Arrival order inside a key; frame_id breaks ties and is unique per sensor.
ORDER = ["capture_us", "frame_id"]

FRAME_SCHEMA = T.StructType(
    [
        T.StructField("frame_id", T.LongType(), False),
        T.StructField("sensor_id", T.StringType(), False),
        T.StructField("session_id", T.StringType(), False),
        T.StructField("capture_us", T.LongType(), False),
        T.StructField("rssi", T.IntegerType(), True),
        T.StructField("frame", T.BinaryType(), True),
    ]
)

BEACON_SCHEMA = T.StructType(
    [
        T.StructField("frame_id", T.LongType(), False),
        T.StructField("sensor_id", T.StringType(), False),
        T.StructField("session_id", T.StringType(), False),
        T.StructField("capture_us", T.LongType(), False),
        T.StructField("ssid", T.StringType(), True),
        T.StructField("bssid", T.StringType(), False),
        T.StructField("rssi", T.IntegerType(), True),
        T.StructField("channel", T.IntegerType(), True),
        T.StructField("seq_num", T.IntegerType(), True),
        T.StructField("beacon_timestamp", T.LongType(), True),
        T.StructField("beacon_interval", T.IntegerType(), True),
        T.StructField("capabilities", T.IntegerType(), True),
        T.StructField("supported_rates", T.StringType(), True),
        T.StructField("rate_count", T.IntegerType(), True),
        T.StructField("security", T.StringType(), True),
        T.StructField("ie_count", T.IntegerType(), True),
    ]
)

PROFILE_SCHEMA = T.StructType(
    [
        T.StructField("ssid", T.StringType()),
        T.StructField("bssid", T.StringType()),
        T.StructField("ie_count", T.IntegerType()),
        T.StructField("rate_count", T.IntegerType()),
        T.StructField("security", T.StringType()),
        T.StructField("capabilities", T.IntegerType()),
        T.StructField("channel", T.IntegerType()),
        T.StructField("beacon_interval", T.IntegerType()),
        T.StructField("supported_rates", T.StringType()),
        T.StructField("clock_skew_mean", T.DoubleType()),
        T.StructField("clock_skew_std", T.DoubleType()),
        T.StructField("clock_skew_min", T.DoubleType()),
        T.StructField("clock_skew_max", T.DoubleType()),
        T.StructField("rssi_mean", T.DoubleType()),
        T.StructField("rssi_std", T.DoubleType()),
        T.StructField("rssi_min", T.DoubleType()),
        T.StructField("rssi_max", T.DoubleType()),
        T.StructField("seq_jump_mean", T.DoubleType()),
        T.StructField("seq_jump_std", T.DoubleType()),
        T.StructField("total_beacons", T.LongType()),
        T.StructField("profile_built", T.StringType()),
    ]
)

HIDDEN = "<Hidden>"
UNKNOWN = "<Unknown>"

# Sequence space, timing gates (microseconds), history length.
SEQ_MODULUS = 4096
SKEW_GAP_US = (50_000, 250_000)
DUPLICATE_GAP_US = (1_000, 500_000)
HISTORY = 20
MIN_HISTORY = 5

# Security classes and their ordinals.
SECURITY_CODES = {"Open": 0, "WEP": 1, "WPA": 2, "WPA2/WPA3": 3}

# Evidence weights in hundredths, thresholds, alert policy.
EVIDENCE_WEIGHTS = {
    "duplicate_sequence": 90,
    "ie_count": 70,
    "security": 60,
    "timing": 35,
    "rate_count": 30,
    "model": 25,
}
STRONG_EVIDENCE = ("duplicate_sequence", "ie_count", "security")
COUNT_TOLERANCE = 3
SKEW_SIGMAS = 10.0
SKEW_FLOOR = 0.0005
MODEL_THRESHOLD = -0.12
SUSPICION_THRESHOLD = 75
REQUIRED_STREAK = 2
COOLDOWN_US = 10_000_000

# Profile and model sizes.
MIN_PROFILE_ROWS = 10
MIN_MODEL_ROWS = 20
MIN_USABLE_ROWS = 10
PROGRESS_SAMPLES = 50
PROFILE_SECONDS = 60
CONTAMINATION = 0.05
SEED = 42

# Channels heard, 2.4 GHz then 5 GHz.
CHANNELS = list(range(1, 12)) + [
    36, 40, 44, 48, 52, 56, 60, 64, 100, 104, 108, 112, 116, 149, 153, 157, 161,
]

# Model feature lists, in order.
AP_MODEL_FEATURES = ["clock_skew", "rssi", "seq_jump", "inter_beacon_ms"]
GLOBAL_MODEL_FEATURES = [
    "rssi", "channel", "seq_jump", "seq_anomaly_score", "clock_skew", "beacon_interval",
    "ie_count", "capabilities", "security_encoded", "rate_count", "clock_skew_deviation",
    "rssi_deviation", "ie_count_match", "rate_count_match", "security_match", "channel_match",
]
SUPERVISED_FEATURES = [
    "rssi", "channel", "seq_jump", "seq_anomaly_score", "clock_skew", "beacon_interval",
    "ie_count", "capabilities", "rate_count", "security_encoded",
]
