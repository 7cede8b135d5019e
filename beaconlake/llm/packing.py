"""Token sequences of bounded length by bounded-space online packing.

Each partition reads its documents once and keeps a fixed number of open windows. A document's
full-length pieces are sequences at once; its rest goes into the open window where the least
space remains after it. When it fits nowhere, the fullest window is emitted, filled up with the head
of the rest, since pieces may be cut freely. What the partitions leave open is merged level
by level in the same way, until one task has the last windows and closes them.
"""

import base64
import json
import zlib
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconlake.llm.common import batch_slices
from beaconlake.session import materialise

LENGTH = 1024
OPEN_WINDOWS = 32
END_ID = 0
#: Partitions whose open windows one task merges.
FAN_IN = 32
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long,"
    " closed boolean, lane long, serial long, offset long, ids array<int>"
)
COLUMNS = [c.split()[0] for c in PIECES.split(", ")]
KINDS = {"closed": pa.bool_(), "ids": pa.list_(pa.int32())}
BATCH = pa.schema([(c, KINDS.get(c, pa.int64())) for c in COLUMNS])
#: Bytes of text that become Python strings at once.
AT_ONCE = 1 << 21

_ENCODERS: dict = {}


@cache
def library(name: str):
    """The library's own tokenizer, which takes more memory than all else here."""
    import public_tokenizers
    import tokenizers

    return tokenizers.Tokenizer.from_file(public_tokenizers.path(name))


def encoder(name: str):
    """``text -> uint32 ids`` as the library has them for a byte-level file ``name``.

    The rank file of the same vocabulary is used, which encodes several times faster; the
    special strings stand for their ids, as they do by default in the library. The library itself is loaded
    when a text first needs it.
    """
    if name not in _ENCODERS:
        import public_tokenizers
        import regex
        import tiktoken

        with open(public_tokenizers.path(name)) as file:
            special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"] if t["special"]}
        with open(public_tokenizers.path(name.replace(".json", ".tiktoken")), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        plain = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        split = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

        def part_ids(part: str) -> list[int]:
            try:
                return plain.encode(part, disallowed_special=())
            except ValueError:  # the pattern gives up on very long runs of white space
                return library(name).encode(part, add_special_tokens=False).ids

        def encode(text: str) -> np.ndarray:
            if split is None or not any(s in text for s in special):
                return np.array(part_ids(text), dtype="<u4")
            parts = ([special[p]] if p in special else part_ids(p) for p in split.split(text))
            return np.array([i for part in parts for i in part], dtype="<u4")

        _ENCODERS[name] = encode
    return _ENCODERS[name]


class Lane:
    """The open windows of one task. A window is a list of pieces ``(doc_id, start, doc_tokens, ids)``."""

    def __init__(self, lane: int, length: int, windows: int, keep_ids: bool):
        self.lane, self.length, self.limit, self.keep_ids = lane, length, windows, keep_ids
        self.open: list[list] = []
        self.used: list[int] = []
        self.serial = 0
        self.done: list[tuple] = []

    def emit(self, pieces: list, closed: bool = True) -> None:
        offset = 0
        for doc_id, start, total, ids in pieces:
            kept = ids.view("<i4") if self.keep_ids or not closed else None
            crc = zlib.crc32(ids.tobytes())
            self.done.append((doc_id, start, len(ids), crc, total, closed, self.lane, self.serial, offset, kept))
            offset += len(ids)
        self.serial += 1

    def document(self, doc_id, ids: np.ndarray) -> None:
        total, full = len(ids), len(ids) - len(ids) % self.length
        for at in range(0, full, self.length):
            self.emit([(doc_id, at, total, ids[at : at + self.length])])
        if full < total:
            self.place([(doc_id, full, total, ids[full:])])

    def place(self, pieces: list) -> None:
        """Best fit of the pieces together; if none fits, fill and emit the fullest window."""
        size = sum(len(p[3]) for p in pieces)
        fits = [i for i, used in enumerate(self.used) if used + size <= self.length]
        if fits:
            best = max(fits, key=self.used.__getitem__)
            self.open[best] += pieces
            self.used[best] += size
            if self.used[best] == self.length:
                self.close(best)
        elif len(self.open) < self.limit:
            self.open.append(list(pieces))
            self.used.append(size)
        else:
            fullest = max(range(len(self.used)), key=self.used.__getitem__)
            head, rest = cut(pieces, self.length - self.used[fullest])
            self.open[fullest] += head
            self.close(fullest)
            self.place(rest)

    def close(self, at: int) -> None:
        self.emit(self.open.pop(at))
        self.used.pop(at)

    def finish(self) -> None:
        """Close what is open: full windows, then the last ids in sequences of powers of two."""
        rest = [piece for window in self.open for piece in window]
        left = sum(self.used)
        self.open, self.used = [], []
        while left:
            size = self.length if left >= self.length else 1 << (left.bit_length() - 1)
            head, rest = cut(rest, size)
            self.emit(head)
            left -= size

    def batch(self) -> pa.RecordBatch:
        done, self.done = self.done, []
        columns = zip(*done, strict=True) if done else [()] * len(COLUMNS)
        arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, BATCH, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, schema=BATCH)

    def take(self) -> pd.DataFrame:
        done, self.done = self.done, []
        frame = pd.DataFrame(done, columns=COLUMNS)
        numbers = {c: "int64" for c in COLUMNS if c not in ("ids", "closed", "doc_id")}
        return frame.astype(numbers | {"doc_id": "Int64", "closed": bool})


def cut(pieces: list, size: int) -> tuple[list, list]:
    """The first ``size`` ids of the pieces, and the rest."""
    head, rest = [], []
    for doc_id, start, total, ids in pieces:
        if size > 0:
            head.append((doc_id, start, total, ids[:size]))
        if len(ids) > size:
            taken = max(size, 0)
            rest.append((doc_id, start + taken, total, ids[taken:]))
        size -= len(ids)
    return head, rest


def _pack(name: str, length: int, windows: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(name)
        lane = Lane(TaskContext.get().partitionId(), length, windows, keep_ids)
        for batch in batch_slices(batches, "text", AT_ONCE):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lane.document(doc_id, np.append(encode(text or ""), END_ID).astype("<u4"))
            yield lane.batch()
        for pieces in lane.open:
            lane.emit(pieces, closed=False)
        yield lane.batch()

    return run


def _merge(length: int, windows: int, keep_ids: bool, last: bool):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        lane = Lane(int(frame["merged"].iloc[0]), length, windows, keep_ids)
        frame = frame.sort_values(["lane", "serial", "offset"])
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        for _, window in frame.groupby(["lane", "serial"], sort=False):
            rows = window[["doc_id", "start", "doc_tokens", "ids"]].itertuples(index=False, name=None)
            lane.place([(d, s, n, np.asarray(ids, dtype="<i4").view("<u4")) for d, s, n, ids in rows])
        if last:
            lane.finish()
        for pieces in lane.open:
            lane.emit(pieces, closed=False)
        return lane.take()

    return run


def pack(
    documents: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    length: int = LENGTH,
    windows: int = OPEN_WINDOWS,
    keep_ids: bool = True,
) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids`` per piece.

    A document is its ids and an end id; a missing text is an empty one, with the end id alone.
    Repeated rows are packed each; a missing ``doc_id`` stays missing. Pieces of a sequence follow
    each other from offset 0 without a gap, in sequences of at most ``length`` ids. All sequences
    are full but the last task's final ones, whose lengths are powers of two. An empty table
    gives no rows; columns other than ``doc_id`` and ``text`` are ignored. ``ids`` is null
    without ``keep_ids``.
    """
    rows = documents.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    level, found = 0, []
    made = materialise(rows.mapInArrow(_pack(tokenizer, length, windows, keep_ids), PIECES), "packed")
    while True:
        number = F.shiftleft(F.lit(level).cast("long"), 58) + F.shiftleft("lane", 33) + F.col("serial")
        found.append(made.filter("closed").withColumn("sequence_id", number))
        opened = made.filter("NOT closed")
        lanes = opened.agg(F.max("lane")).first()[0]
        if lanes is None:
            break
        merge = _merge(length, windows, keep_ids, last=lanes < FAN_IN)
        made = materialise(
            opened.withColumn("merged", F.expr(f"lane div {FAN_IN}")).groupBy("merged").applyInPandas(merge, PIECES),
            "packed",
        )
        level += 1
    return reduce(DataFrame.unionByName, found).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"
    )
