"""802.11 beacon frames to typed rows.

The fixed header and the element list are read a batch at a time with array arithmetic over the
Arrow buffers; everything derived from the elements stays in Spark expressions.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beaconlake.functions import frames as X
from beaconlake.schema import BEACON_SCHEMA, HIDDEN, UNKNOWN

# Byte offsets in a management frame and the length of its fixed part.
ADDRESS_AT, SEQUENCE_AT, TSF_AT, INTERVAL_AT, CAPABILITY_AT, ELEMENTS_AT = 10, 22, 24, 32, 34, 36

HEADER_FIELDS = [
    T.StructField("seq_num", T.IntegerType()),
    T.StructField("beacon_timestamp", T.LongType()),
    T.StructField("beacon_interval", T.IntegerType()),
    T.StructField("capabilities", T.IntegerType()),
    T.StructField(
        "ies",
        T.ArrayType(
            T.StructType(
                [T.StructField("id", T.IntegerType()), T.StructField("info", T.BinaryType())]
            )
        ),
    ),
]


def _little_endian(data: np.ndarray, at: np.ndarray, width: int, dtype) -> np.ndarray:
    value = np.zeros(len(at), dtype=dtype)
    for i in range(width):
        value |= data[at + i].astype(dtype) << dtype(8 * i)
    return value


def _walk_elements(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Walk all frames' id-length-value lists side by side.

    Returns frame number, id, and value bounds of every element in frame order. A length that
    runs past the frame is cut to what is there; a lone trailing byte is no element.
    """
    frame, position = np.arange(len(starts)), starts.copy()
    found = []
    while len(frame):
        more = position + 2 <= ends[frame]
        frame, position = frame[more], position[more]
        if not len(frame):
            break
        begin = position + 2
        end = np.minimum(begin + data[position + 1], ends[frame])
        found.append((frame, data[position].astype(np.int32), begin, end))
        position = end
    if not found:
        empty = np.array([], dtype=np.int64)
        return empty, empty.astype(np.int32), empty, empty
    columns = [np.concatenate(parts) for parts in zip(*found)]
    order = np.argsort(columns[0], kind="stable")
    return tuple(c[order] for c in columns)


def _decode_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    # Frames have at least ELEMENTS_AT bytes here. Batches stay far below 2 GiB of frames.
    column = batch.column("frame").cast(pa.binary())
    frames = pa.concat_arrays([column])
    offsets = np.frombuffer(frames.buffers()[1], dtype=np.int32)[
        frames.offset : frames.offset + len(frames) + 1
    ].astype(np.int64)
    data = np.frombuffer(frames.buffers()[2], dtype=np.uint8)
    at, ends = offsets[:-1], offsets[1:]
    frame, ids, begin, end = _walk_elements(data, at + ELEMENTS_AT, ends)

    lengths = end - begin
    info_offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    picked = np.repeat(begin - info_offsets[:-1], lengths) + np.arange(info_offsets[-1])
    info = pa.Array.from_buffers(
        pa.binary(), len(ids),
        [None, pa.py_buffer(info_offsets.tobytes()), pa.py_buffer(data[picked].tobytes())],
    )
    per_frame = np.bincount(frame, minlength=len(at)) if len(at) else np.array([], np.int64)
    list_offsets = pa.array(np.concatenate([[0], np.cumsum(per_frame)]).astype(np.int32))
    elements = pa.StructArray.from_arrays([pa.array(ids, pa.int32()), info], names=["id", "info"])

    sequence = _little_endian(data, at + SEQUENCE_AT, 2, np.int32) >> 4
    tsf = _little_endian(data, at + TSF_AT, 8, np.uint64).view(np.int64)
    decoded = {
        "seq_num": pa.array(sequence, pa.int32()),
        "beacon_timestamp": pa.array(tsf, pa.int64()),
        "beacon_interval": pa.array(_little_endian(data, at + INTERVAL_AT, 2, np.int32)),
        "capabilities": pa.array(_little_endian(data, at + CAPABILITY_AT, 2, np.int32)),
        "ies": pa.ListArray.from_arrays(list_offsets, elements),
    }
    kept = [n for n in batch.schema.names if n != "frame"]
    return pa.RecordBatch.from_arrays(
        [batch.column(n) for n in kept] + list(decoded.values()), names=kept + list(decoded)
    )


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _decode_batch(batch)


def quarantined_frames(frames: DataFrame) -> DataFrame:
    """Frames that give no observation, with the reason."""
    reason = _header_problem()
    return frames.withColumn("problem", reason).filter(F.col("problem").isNotNull())


def _header_problem():
    return (
        F.when(F.col("frame").isNull(), F.lit("empty"))
        .when(~F.coalesce(X.is_beacon(F.col("frame")), F.lit(False)), F.lit("not a beacon"))
        .when(F.length("frame") < ELEMENTS_AT, F.lit("truncated header"))
        .when(F.length("frame") < ELEMENTS_AT + 2, F.lit("no elements"))
    )


def decode_frames(frames: DataFrame, keep_bare: bool = False) -> DataFrame:
    """Header fields, ``bssid`` and the ordered element list ``ies`` of every beacon frame.

    Filtering happens before the Python workers. ``keep_bare`` keeps beacons without elements, as
    the network scan does.
    """
    problem = _header_problem()
    usable = problem.isNull() | (problem == "no elements") if keep_bare else problem.isNull()
    address = F.lower(F.hex(F.substring(F.col("frame"), ADDRESS_AT + 1, 6)))
    bssid = F.regexp_replace(address, "(..)(?=.)", "$1:")
    beacons = frames.filter(usable).withColumn("bssid", bssid)
    kept = [f for f in beacons.schema.fields if f.name != "frame"]
    return beacons.mapInArrow(_decode, T.StructType(kept + HEADER_FIELDS))


def observations(
    decoded: DataFrame, missing_name: str = HIDDEN, keep: list[str] | None = None
) -> DataFrame:
    """Beacon rows from decoded frames; ``missing_name`` stands for an unreadable name."""
    ies, bare = F.col("ies"), F.size("ies") == 0
    rates = X.rates_of(ies)
    # A beacon without elements is reported as open, whatever its privacy bit says.
    security = F.when(bare, F.lit("Open")).otherwise(X.security_of(ies, F.col("capabilities")))
    built = decoded.withColumns(
        {
            "ssid": X.ssid_of(ies, missing=missing_name),
            "rssi": F.coalesce("rssi", F.lit(0)),
            "channel": X.channel_of(ies),
            "supported_rates": X.rates_text(rates),
            "rate_count": F.size(rates),
            "security": security,
            "ie_count": F.size(ies),
        }
    )
    return built.select(*BEACON_SCHEMA.fieldNames(), *(keep or []))


def collector_observations(frames: DataFrame) -> DataFrame:
    """Frames to beacon rows as the collector names them."""
    return observations(decode_frames(frames), UNKNOWN)


def element_table(decoded: DataFrame) -> DataFrame:
    """One row per information element, with its position in the frame."""
    return decoded.select(
        "frame_id", "bssid", F.posexplode("ies").alias("position", "element")
    ).select("frame_id", "bssid", "position", "element.id", "element.info")
