"""Near copies by the Jaccard similarity of word shingles, verified exactly.

Candidates come from two indexes. The first is that of ``simhash``: fingerprints of the five-word shingles,
linked over posting lists of byte positions with count filtering. Texts of five-word similarity 0.8 have
fingerprints about ten of 64 bits apart, often more than fifteen, which touch every byte: no index on byte positions
finds all of them. So a second index, bands of minimum hashes, adds what lies beyond its radius. Texts that
either connects are candidates; candidates are joined to groups over one edge for each text and band, each group gets
its texts' shingle sets once, and there a link is a similarity of the sets themselves. Within a group
links are walked as in ``simhash``: one edge for each text reached. Groups are cut into chunks by size and
every two chunks are walked together.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconlake.llm.common import UID, batch_slices, text_bytes
from beaconlake.llm.components import components
from beaconlake.llm.simhash import fingerprint, links
from beaconlake.session import materialise

WIDTH, SEED = 5, 42
#: Linked from this similarity on, as a fraction: 4 / 5.
LEAST = (4, 5)
#: A pair of similarity s shares a band but for (1 - s ** BAND) ** BANDS: 1.5e-4 at 0.8, 2.3e-7 at 0.85.
BANDS, BAND = 48, 8
#: Shingles that are hashed at once, and that a chunk of a group has, about.
HASHED, CHUNK = 1 << 12, 1 << 20
#: Bytes of text whose shingles are held at once.
AT_ONCE = 1 << 21
_RANDOM = np.random.default_rng(SEED)
FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MASKS = _RANDOM.integers(0, 1 << 63, BANDS * BAND, dtype=np.uint64)


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle, or none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype="<u8")
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype="<u8"))


def band_keys(hashes: np.ndarray) -> list[int]:
    """One key for each band of minimum hashes; none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), HASHED):
        part = hashes[at : at + HASHED].astype(np.uint64)
        for first in range(0, len(FACTORS), BAND):
            now = slice(first, first + BAND)
            mixed = (part[None, :] ^ MASKS[now, None]) * FACTORS[now, None]
            least[now] = np.minimum(least[now], mixed.min(axis=1))
    bands = np.ascontiguousarray(least.reshape(BANDS, BAND))
    keys = [xxhash.xxh64_intdigest(band.tobytes(), number) for number, band in enumerate(bands)]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def _with_texts(made: dict):
    """All columns but the text, the last one, and those that the functions of ``made`` make of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_slices(batches, "text", AT_ONCE):
            texts = [text_bytes(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            sets = [shingle_set(t) for t in texts]
            new = [pa.array([make(t, s) for t, s in zip(texts, sets, strict=True)], kind) for make, kind in made.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=[*batch.schema.names[:-1], *made])

    return run


def _signed(number: int) -> int:
    return number - (number >> 63 << 64)


MARKS = {
    "node": (lambda text, hashes: _signed(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)), pa.int64()),
    "keys": (lambda text, hashes: band_keys(hashes), pa.list_(pa.int64())),
    "fp": (lambda text, hashes: _signed(fingerprint(text, WIDTH)), pa.int64()),
}
SETS = {
    "n": (lambda text, hashes: len(hashes), pa.int64()),
    "shingles": (lambda text, hashes: hashes.tobytes(), pa.binary()),
}


def walk_sets(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Edges, as numbers of sets, that connect all linked sets: one for each one reached."""
    sizes = np.array([len(s) for s in sets])
    ids = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(sizes)[:-1])
    marked = np.zeros(int(sizes.sum()), dtype=bool)
    left, waiting, flat = np.arange(1, len(sets)), [0], None
    sources, targets = [], []
    while len(left):
        if not waiting:
            waiting.append(int(left[0]))
            left, flat = left[1:], None
            continue
        here = waiting.pop()
        if flat is None:
            flat = np.concatenate([ids[i] for i in left])
            starts = np.cumsum(sizes[left]) - sizes[left]
        marked[ids[here]] = True
        shared = np.add.reduceat(marked[flat].astype(np.int64), starts)
        marked[ids[here]] = False
        linked = shared * LEAST[1] >= LEAST[0] * (sizes[left] + sizes[here] - shared)
        found = left[linked].tolist()
        if found:
            sources += [here] * len(found)
            targets += found
            waiting += found
            left, flat = left[~linked], None
    return sources, targets


def _walk_chunks(frame: pd.DataFrame) -> pd.DataFrame:
    nodes = frame["node"].to_numpy(dtype=np.int64)
    sources, targets = walk_sets([np.frombuffer(s, dtype="<u8") for s in frame["shingles"]])
    return pd.DataFrame({"u": nodes[np.array(sources, dtype=int)], "v": nodes[np.array(targets, dtype=int)]})


def candidate_groups(nodes: DataFrame) -> DataFrame:
    """``node, root``: the groups of two and more nodes that near fingerprints or shared bands connect."""
    prints = nodes.groupBy("fp").agg(F.min("node").alias("one"))
    same = nodes.join(prints, "fp").filter("node <> one").selectExpr("one AS u", "node AS v")
    ends = prints.withColumnsRenamed({"fp": "u", "one": "_u"}), prints.withColumnsRenamed({"fp": "v", "one": "_v"})
    near = links(prints).distinct().join(ends[0], "u").join(ends[1], "v").selectExpr("_u AS u", "_v AS v")
    index = materialise(nodes.select("node", F.explode("keys").alias("key")), "near-index")
    least = index.groupBy("key").agg(F.min("node").alias("u"), F.count("*").alias("n")).filter("n > 1")
    edges = index.join(least, "key").filter("node <> u").select("u", F.col("node").alias("v")).distinct()
    others = components(edges.unionByName(same).unionByName(near).distinct())
    return others.unionByName(others.select(F.col("root").alias("node"), "root").distinct())


def verified_links(rows: DataFrame, nodes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``u, v``: nodes of similar sets, enough of them to connect whatever is connected.

    ``rows`` has the texts by row number, ``nodes`` a row number for each ``node``.
    """
    groups = candidate_groups(nodes).join(nodes.select("node", UID), "node")
    texts = rows.select(UID, "text").join(groups, UID).select("node", F.col("root").alias("grp"), "text")
    sets = materialise(texts.mapInArrow(_with_texts(SETS), "node long, grp long, n long, shingles binary"), "near-sets")
    sizes = sets.groupBy("grp").agg(F.ceil(F.sum("n") / chunk).cast("int").alias("chunks"))
    dealt = sets.join(sizes, "grp").withColumn("c", F.expr("CAST(pmod(xxhash64(node), chunks) AS INT)"))
    partner = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("o")
    paired = dealt.select("grp", "node", "shingles", "c", partner).selectExpr(
        "grp", "least(c, o) AS a", "greatest(c, o) AS b", "node", "shingles"
    )
    return paired.groupBy("grp", "a", "b").applyInPandas(_walk_chunks, "u long, v long")


def keep_one_of_near_copies(documents: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The rows of ``documents`` without all but one of each group of linked texts.

    Words are lower-cased (A-Z) and split at ASCII white space. Texts are linked if the sets of their
    five-word shingles have a Jaccard similarity of 0.8 or more; groups are what links connect. Texts
    of fewer words are one shingle; missing and empty texts are equal. The row with the smallest
    ``doc_id`` stays, one without an id only if all lack it; of rows with equal ids one stays. Columns
    are those of ``documents``; an empty table gives no rows.
    """
    rows = materialise(documents.withColumn(UID, F.monotonically_increasing_id()), "near-rows")
    kind = rows.schema["doc_id"].dataType.simpleString()
    marks = rows.select("doc_id", UID, "text").mapInArrow(
        _with_texts(MARKS), f"doc_id {kind}, `{UID}` long, node long, keys array<long>, fp long"
    )
    marks = materialise(marks, "near-marks")
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", UID)
    nodes = marks.groupBy("node").agg(F.min(order).alias("first"), F.first("keys").alias("keys"), F.min("fp").alias("fp"))
    nodes = materialise(nodes.select("node", "first", F.col(f"first.{UID}").alias(UID), "keys", "fp"), "near-nodes")
    stars = components(verified_links(rows, nodes, chunk))
    rooted = nodes.join(stars, "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    first = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col(f"first.{UID}").alias(UID))
    return rows.join(first, UID, "left_semi").select(*documents.columns)
