"""SimHash near-duplicates through an inverted index on byte positions with count filtering.

Fingerprints of 64 bits that differ in at most three bits differ in at most three of their eight
bytes, so they share at least five positional bytes. A posting list of a single positional
byte would hold one fingerprint in 256, which grows with the square of the input. The index
therefore takes four positional bytes at a time. The fourteen sets of four positions whose
numbers XOR to zero are such that any three positions miss one set: a linked pair meets in
at least one list. In a list the shared positional bytes are tallied, pairs below five are let
go, and the rest is verified by the Hamming distance.

A list of many near copies does not give all its pairs. It is walked from link to link and gives
one edge for each fingerprint reached, which leaves the components as they are. Long lists are cut
into chunks and every two chunks are walked together.
"""

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconlake.llm.common import UID, text_bytes
from beaconlake.llm.components import components
from beaconlake.session import materialise

BITS, BYTES, SEED = 64, 8, 42
MAX_DISTANCE = 3
LEAST_SHARED = BYTES - MAX_DISTANCE
POSITION_SETS = [s for s in combinations(range(BYTES), 4) if s[0] ^ s[1] ^ s[2] ^ s[3] == 0]
#: Fingerprints of a posting list that one walk takes at most, twice.
CHUNK = 4096
#: Shingles whose bits are counted at once.
COUNTED = 1 << 15


def fingerprint(text: bytes, width: int = 3) -> int:
    """64-bit SimHash of the word shingles, repeats included; zero without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), COUNTED):
        part = hashes[at : at + COUNTED].view(np.uint8).reshape(-1, BYTES)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            prints = [fingerprint(text_bytes(t), width) for t in frame["text"]]
            yield frame.drop(columns="text").assign(
                fp=np.array(prints, dtype=np.uint64).view(np.int64)
            )

    return run


def fingerprints(documents: DataFrame, carry: Sequence[str] = ("doc_id",), width: int = 3) -> DataFrame:
    """The carried columns and ``fp``, the fingerprint as a signed long, one row per document."""
    rows = documents.select(*carry, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInPandas(_fingerprints(width), f"{schema}, fp long")


def postings(nodes: DataFrame) -> DataFrame:
    """``fp, key``: a row for each position set; equal keys share the set's four bytes."""
    keys = []
    for number, positions in enumerate(POSITION_SETS):
        taken = [
            f"shiftleft(shiftrightunsigned(fp, {8 * p}) & 255L, {8 * i})" for i, p in enumerate(positions)
        ]
        keys.append(f"({' | '.join(taken)} | shiftleft({number}L, 32))")
    return nodes.selectExpr("fp", f"explode(array({', '.join(keys)})) AS key")


def walk(prints: np.ndarray) -> tuple[list, list]:
    """Edges that connect all linked fingerprints of a list: one for each one reached."""
    left, sources, targets = prints[1:], [], []
    waiting = [prints[0]]
    while len(left):
        if not waiting:
            waiting.append(left[0])
            left = left[1:]
        here = waiting.pop()
        differing = np.ascontiguousarray(left ^ here)
        shared = (differing.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
        linked = shared >= LEAST_SHARED
        linked[linked] = np.bitwise_count(differing[linked]) <= MAX_DISTANCE
        found = left[linked]
        if len(found):
            sources += [here] * len(found)
            targets += found.tolist()
            waiting += found.tolist()
            left = left[~linked]
    return sources, targets


def _walks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk each list of a partition that is sorted by list; a list may go on in the next frame."""

    def edges(frame: pd.DataFrame) -> pd.DataFrame:
        prints = frame["fp"].to_numpy(dtype=np.int64).view(np.uint64)
        change = (frame[["key", "a", "b"]].diff() != 0).any(axis=1).to_numpy()
        starts = np.flatnonzero(change)
        sources, targets = [], []
        for at, end in zip(starts, [*starts[1:], len(frame)], strict=True):
            if end - at > 1:
                u, v = walk(np.unique(prints[at:end]))
                sources += u
                targets += v
        return pd.DataFrame(
            {n: np.array(x, dtype=np.uint64).view(np.int64) for n, x in (("u", sources), ("v", targets))}
        )

    rest = None
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        if len(frame):
            last = frame[["key", "a", "b"]].iloc[-1]
            open_from = (frame[["key", "a", "b"]] == last).all(axis=1).to_numpy().argmax()
            rest = frame.iloc[open_from:].reset_index(drop=True)
            yield edges(frame.iloc[:open_from].reset_index(drop=True))
    if rest is not None:
        yield edges(rest)


def links(nodes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``u, v``: linked fingerprints, enough of them to connect whatever is connected."""
    index = postings(nodes)
    busy = index.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    listed = index.join(busy, "key").selectExpr(
        "key", "fp", f"CAST(ceil(n / {chunk}) AS INT) AS chunks"
    ).selectExpr("key", "fp", "chunks", "CAST(pmod(xxhash64(fp), chunks) AS INT) AS c")
    partner = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("o")
    paired = listed.select("key", "fp", "c", partner).selectExpr(
        "key", "least(c, o) AS a", "greatest(c, o) AS b", "fp"
    )
    grouped = paired.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    return grouped.mapInPandas(_walks, "u long, v long")


def near_duplicates(
    documents: DataFrame, carry: Sequence[str] = ("doc_id",), width: int = 3, chunk: int = CHUNK
) -> DataFrame:
    """The carried columns (``doc_id`` among them), ``fingerprint`` and ``component_id``.

    Words are lower-cased (A-Z) and split at ASCII white space; missing and empty texts have
    fingerprint zero and link like any other. ``component_id`` is the smallest ``doc_id`` that is
    reachable over links of at most three differing bits; missing ids are passed over, and a
    component of missing ids only has a missing id. Repeated rows each get a row. ``root`` is the
    component's own number. Other columns are ignored; an empty table gives no rows.
    """
    prints = materialise(fingerprints(documents, carry, width), "simhash-prints")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    stars = components(links(nodes, chunk))
    rooted = nodes.join(stars.withColumnRenamed("node", "fp"), "fp", "left").selectExpr(
        "fp", "first", "coalesce(root, fp) AS root"
    )
    rooted = materialise(rooted, "simhash-roots")
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = rooted.join(ids, "root").select("fp", "root", "component_id")
    return prints.join(of_print, "fp").select(
        *carry, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root"
    )


def keep_one(documents: DataFrame, width: int = 3) -> DataFrame:
    """The rows of ``documents`` without all but one of each component.

    The row with the smallest ``doc_id`` stays, one without an id only if all lack it; of rows with
    equal ids one stays. Columns are those of ``documents``.
    """
    rows = materialise(documents.withColumn(UID, F.monotonically_increasing_id()), "simhash-rows")
    found = materialise(near_duplicates(rows, ("doc_id", UID), width), "simhash-found")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", UID)
    first = found.groupBy("root").agg(F.min(order).alias("first")).select(F.col(f"first.{UID}").alias(UID))
    dropped = found.join(first, UID, "left_anti").select(UID)
    return rows.join(dropped, UID, "left_anti").select(*documents.columns)
