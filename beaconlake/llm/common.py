"""What the operators share: table readers, row numbering and bounded chunks of work."""

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name of the row number that operators add inside; no input column may bear it.
UID = "__row_uid"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(name: str, taken: list[str]) -> str:
    """A column name that no input column bears, whatever the letter case."""
    used = {c.lower() for c in taken}
    name = f"__{name}"
    while name.lower() in used:
        name += "_"
    return name


def text_bytes(text) -> bytes:
    """UTF-8 of a text; missing text has no bytes."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def digest(text: Column) -> Column:
    """A key that stands for the whole text; null for a missing text."""
    return F.sha2(text, 256)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a missing id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def batch_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut incoming batches, without a copy, so that each holds about ``limit`` bytes of the text ``column``.

    A single longer text comes alone. Only such a part then becomes Python strings at once.
    """
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        group = (np.cumsum(lengths) - lengths) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(lengths)]
        for at, end in pairwise(cuts):
            if end > at:
                yield batch.slice(at, end - at)


def slices(frames: Iterator[pd.DataFrame], column: str, limit: int) -> Iterator[pd.DataFrame]:
    """Cut incoming frames so that each holds about ``limit`` characters of ``column``.

    A single longer text comes alone. This bounds what a vectorised step holds at once.
    """
    for frame in frames:
        lengths = frame[column].str.len().fillna(0).to_numpy(dtype=np.int64) + 1
        group = (np.cumsum(lengths) - lengths) // limit
        starts = np.flatnonzero(np.r_[True, np.diff(group) != 0]) if len(frame) else []
        for at, end in zip(starts, [*starts[1:], len(frame)], strict=True):
            yield frame.iloc[at:end]
