"""Document fingerprints: SimHash of weighted terms, searched through permuted block tables.

The terms of a text are its runs of six characters, each weighted by the number of binary digits of
its count. A term's 128 hash bits vote with that weight, and a bit of the fingerprint is one if more
than half the weight votes for it. The likeness of two fingerprints is their share of equal bits.

To find all fingerprints within a radius of k bits, the 128 bits are cut into k + 2 blocks: k bits
touch k of them at most, so two blocks at least are equal. There is a table for each pair of blocks, in
which these two are permuted to the front and serve as key. Within a key all pairs are compared by
their bits; a pair counts in the first of the tables that it shares, so it counts once.
"""

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconlake.session import materialise

BITS, BYTES, TERM = 128, 16, 6
RADIUS = 4
#: Fingerprints of one key that a task compares with as many others, and pairs of them at a time.
CHUNK, PAIRS = 4096, 1 << 18
#: Terms of a text that are counted at once.
COUNTED = 1 << 20
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(float)
#: Odd constants that spread the bits of a product.
SPREAD = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
SHIFT = np.uint64(32)


def _mixed(values: np.ndarray, start: np.uint64) -> np.ndarray:
    h = values + start
    for factor in SPREAD:
        h = (h ^ (h >> SHIFT)) * factor
    return h ^ (h >> SHIFT)


def _terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the distinct terms and how often each occurs."""
    found, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    for at in range(0, max(1, len(text) - TERM + 1), COUNTED):
        part = text[at : at + COUNTED + TERM - 1]
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        if len(codes) < TERM:  # a short text is one term
            codes = np.r_[codes, np.zeros(TERM - len(codes), np.uint64)]
        size = len(codes) - TERM + 1
        numbers = np.zeros(size, np.uint64)
        for i in range(TERM):
            numbers = numbers * SPREAD[0] + codes[i : i + size] + np.uint64(1)
        new, times = np.unique(numbers, return_counts=True)
        if len(found):
            found, inverse = np.unique(np.r_[found, new], return_inverse=True)
            counts = np.bincount(inverse, weights=np.r_[counts, times]).astype(np.int64)
        else:
            found, counts = new, times
    return found, counts


def fingerprint(text: str) -> tuple[int, int]:
    """The fingerprint as two signed 64-bit halves; zero for an empty text."""
    if not text:
        return 0, 0
    numbers, counts = _terms(text.lower())
    weights = np.frexp(counts.astype(float))[1].astype(float)  # binary digits of the count
    hashes = np.stack([_mixed(numbers, SPREAD[1]), _mixed(numbers, SPREAD[2])], axis=1).view(np.uint8)
    votes = np.concatenate(
        [np.bincount(hashes[:, i], weights=weights, minlength=256) @ BYTE_BITS for i in range(BYTES)]
    )
    low, high = np.packbits(votes * 2 > weights.sum(), bitorder="little").view("<i8")
    return int(high), int(low)


def likeness(a: tuple[int, int], b: tuple[int, int]) -> float:
    """Share of equal bits."""
    mask = (1 << 64) - 1
    return 1 - sum(((x ^ y) & mask).bit_count() for x, y in zip(a, b, strict=True)) / BITS


def edited(text: str, following: str) -> str:
    """The text with its last half of code points replaced by as many of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


COMPARED = (
    "n_chars long, edited_sha256 string, high long, low long, edited_high long, edited_low long, "
    "near_edited double, near_next double"
)
#: ``head``: a row that stands for the first document of its partition; ``text`` only at the edges.
ROW = f"doc_id string, {COMPARED}, part int, head boolean, text string"


def _compared(text: str, own: tuple[int, int], following: str, theirs: tuple[int, int]) -> tuple:
    other = edited(text, following)
    changed = fingerprint(other)
    digest = hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest()
    return len(text), digest, *own, *changed, likeness(own, changed), likeness(own, theirs)


def _walk(columns: list[str]):
    """Compare each document of a sorted partition with the next; the last one waits for its next."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last = TaskContext.get().partitionId(), None
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"].tolist(), frame["text"].tolist(), strict=True):
                text = text if isinstance(text, str) else ""
                own = fingerprint(text) if last is None or text != last[1] else last[2]
                if last is None:
                    rows.append((doc_id, len(text), None, *own, None, None, None, None, part, True, text))
                else:
                    rows.append((last[0], *_compared(last[1], last[2], text, own), part, False, None))
                last = doc_id, text, own
            yield pd.DataFrame(rows, columns=columns, dtype=object)
        if last is not None:
            row = (last[0], len(last[1]), None, *last[2], None, None, None, None, part, False, last[1])
            yield pd.DataFrame([row], columns=columns, dtype=object)

    return run


def _edges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for r in frame.itertuples(index=False):
            rows.append((r.doc_id, *_compared(r.text, (r.high, r.low), r.next_text, (r.next_high, r.next_low))))
        yield pd.DataFrame(rows, columns=["doc_id", *[c.split()[0] for c in COMPARED.split(", ")]], dtype=object)


def compared_with_next(documents: DataFrame) -> DataFrame:
    """``doc_id`` and the columns of ``COMPARED``: each document, its edited text and its next one.

    One exchange by ranges of ``doc_id``. The last document of a range meets the first of the next in a
    join that has one row for each range.
    """
    spark = documents.sparkSession
    kind = documents.schema["doc_id"].dataType.simpleString()
    ordered = documents.select("doc_id", "text").orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    # Ids pass pandas as text: a column of numbers with gaps would turn into floats.
    ordered = ordered.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    names = [c.split()[0] for c in ROW.split(", ")]
    rows = materialise(ordered.mapInPandas(_walk(names), ROW), "fingerprint-rows")
    heads = rows.filter("head").selectExpr(
        "part AS next_part", "text AS next_text", "high AS next_high", "low AS next_low"
    )
    parts = sorted(r.part for r in rows.filter("head").select("part").collect())  # a number for each range
    following = spark.createDataFrame(
        list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next_part int"
    )
    waiting = rows.filter("NOT head AND edited_sha256 IS NULL").select("doc_id", "text", "high", "low", "part")
    met = waiting.join(following, "part").join(heads, "next_part")
    done = rows.filter("NOT head AND edited_sha256 IS NOT NULL").drop("part", "head", "text")
    both = done.unionByName(met.mapInPandas(_edges, f"doc_id string, {COMPARED}"))
    return both.withColumn("doc_id", F.col("doc_id").cast(kind))


def block_edges(radius: int) -> list[tuple[int, int]]:
    """Start and width of the ``radius + 2`` blocks of bits."""
    cuts = [BITS * i // (radius + 2) for i in range(radius + 3)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def block(high: np.ndarray, low: np.ndarray, start: int, width: int) -> np.ndarray:
    """The bits of one block, of both halves of the fingerprints."""
    out = low >> np.uint64(start) if start < 64 else high >> np.uint64(start - 64)
    if start < 64 < start + width:
        out = out | (high << np.uint64(64 - start))
    return out & np.uint64((1 << width) - 1)


def _postings(radius: int):
    """A row for each table: equal keys share the table's two blocks."""
    edges = block_edges(radius)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            high, low = (frame[c].to_numpy(dtype=np.int64).view(np.uint64) for c in ("high", "low"))
            for number, (i, j) in enumerate(combinations(range(radius + 2), 2)):
                bits = block(high, low, *edges[i]) << np.uint64(edges[j][1]) | block(high, low, *edges[j])
                yield frame.assign(chosen=np.int32(number), key=bits.view(np.int64))

    return run


def _matches(radius: int):
    edges, tables = block_edges(radius), list(combinations(range(radius + 2), 2))
    asked = ["chosen", "key", "a", "b"]

    def pairs(run: pd.DataFrame) -> pd.DataFrame | None:
        """Number and smallest id of the partners of each fingerprint of one key's two chunks."""
        i, j = tables[run["chosen"].iloc[0]]
        same = run["a"].iloc[0] == run["b"].iloc[0]
        left = run[run["c"] == run["a"]]
        right = left if same else run[run["c"] == run["b"]]
        sides = [tuple(x[c].to_numpy(dtype=np.int64).view(np.uint64) for c in ("high", "low")) for x in (left, right)]
        docs = [x["docs"].to_numpy(dtype=float) for x in (left, right)]
        links = [np.zeros(len(left)), np.zeros(len(right))]
        # Rows are in the order of their smallest ids, so the first partner has the smallest of all.
        least = [np.full(len(left), len(right)), np.full(len(right), len(left))]
        step = max(1, PAIRS // len(right))
        for at in range(0, len(left), step):
            rows = slice(at, at + step)
            high = sides[0][0][rows, None] ^ sides[1][0]
            low = sides[0][1][rows, None] ^ sides[1][1]
            near = np.bitwise_count(high) + np.bitwise_count(low) <= radius  # at most 128, which a byte holds
            near &= (high | low) != 0
            for k in range(j):
                if k != i and near.any():
                    near &= block(high, low, *edges[k]) != 0
            if near.any():
                for side, hits in enumerate((near, near.T)[: 1 if same else 2]):
                    some = np.flatnonzero(hits.any(axis=1))
                    mine, shift = (some + at, 0) if side == 0 else (some, at)
                    links[side][mine] += hits[some] @ docs[1 - side] if side == 0 else hits[some] @ docs[0][rows]
                    least[side][mine] = np.minimum(least[side][mine], hits[some].argmax(axis=1) + shift)
        out = []
        for side, frame in enumerate((left, right) if not same else (left,)):
            hit = np.flatnonzero(links[side])
            if len(hit):
                other = (right, left)[side]["first"].iloc[least[side][hit]]
                counted = links[side][hit].astype(np.int64)
                out.append(frame[["high", "low"]].iloc[hit].assign(links=counted, first=other.to_numpy()))
        return pd.concat(out) if out else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
            starts = np.flatnonzero((frame[asked].diff() != 0).any(axis=1).to_numpy())
            for at, end in zip(starts, [*starts[1:], len(frame)], strict=True):
                if end - at > 1 and (found := pairs(frame.iloc[at:end])) is not None:
                    yield found

        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            if len(frame):
                open_from = (frame[asked] == frame[asked].iloc[-1]).all(axis=1).to_numpy().argmax()
                rest = frame.iloc[open_from:].reset_index(drop=True)
                if open_from:
                    yield from done(frame.iloc[:open_from].reset_index(drop=True))
        if rest is not None:
            yield from done(rest)

    return run


def within_radius(nodes: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """``high, low, links, first`` of the fingerprints that have others within the radius.

    ``nodes`` has distinct fingerprints ``high, low`` with ``docs`` and ``first``, the number and the
    smallest id of their documents; ``links`` and ``first`` are the sum and the minimum over all others within
    ``radius`` bits. A key with many fingerprints is cut into chunks and every two chunks are compared
    in a task of their own.
    """
    kind = nodes.schema["first"].dataType.simpleString()
    # Ids pass pandas as text: a column of numbers with gaps would turn into floats.
    plain = nodes.select("high", "low", "docs", F.col("first").cast("string").alias("first"))
    prints = "high long, low long, docs long, first string"
    listed = plain.mapInPandas(_postings(radius), f"{prints}, chosen int, key long")
    keys = plain.select("high", "low").mapInPandas(_postings(radius), "high long, low long, chosen int, key long")
    busy = keys.groupBy("chosen", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = listed.join(materialise(busy, "fingerprint-keys"), ["chosen", "key"]).withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))
    met = met.withColumn("c", F.pmod(F.xxhash64("high", "low"), F.col("chunks")).cast("int"))
    paired = met.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "chosen", "key", F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b"), "c", "high", "low", "docs", "first"
    )
    by_id = F.col("first").cast(kind).asc_nulls_last()
    # Few bytes are much work here, so the number of tasks does not follow from the bytes.
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = paired.repartition(tasks, "chosen", "key", "a", "b").sortWithinPartitions("chosen", "key", "a", "b", by_id)
    found = runs.mapInPandas(_matches(radius), "high long, low long, links long, first string")
    return found.groupBy("high", "low").agg(
        F.sum("links").alias("links"), F.min(F.col("first").cast(kind)).alias("first")
    )


def document_fingerprints(documents: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """A fingerprint for each document, its likeness to two others, and what lies within the radius.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``: the
    edited text has its last half of code points replaced by the beginning of the next document in ascending
    order of ``doc_id`` (after the last: the first). ``n_near`` counts the other rows whose fingerprint
    differs in ``radius`` bits at most, ``first_near`` is their smallest ``doc_id``, the row's own included.

    Missing text counts as empty; an empty text has fingerprint zero and is near like any other. Rows
    without an id come last and are passed over in ``first_near``; rows with equal ids follow each other in
    an order of their texts, and each gets a row. A single document is its own next. Other columns are
    ignored; an empty table gives no rows.
    """
    rows = compared_with_next(documents)
    nodes = rows.groupBy("high", "low").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first"))
    nodes = materialise(nodes, "fingerprint-nodes")
    links = within_radius(nodes, radius, chunk).withColumnRenamed("first", "other")
    # A fingerprint of one document without others near needs no partner in the join.
    company = nodes.join(links, ["high", "low"], "left").filter("docs > 1 OR links IS NOT NULL").select(
        "high", "low", (F.col("docs") - 1 + F.coalesce("links", F.lit(0))).alias("n_near"),
        F.least("first", "other").alias("first_near"),
    )
    company = materialise(company, "fingerprint-company")

    def text(high: str, low: str):
        return F.lower(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in (high, low)]))

    return rows.join(company, ["high", "low"], "left").select(
        "doc_id", "n_chars", "edited_sha256", text("high", "low").alias("fingerprint"),
        text("edited_high", "edited_low").alias("edited_fingerprint"), "near_edited", "near_next",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(F.col("n_near").isNull(), F.col("doc_id")).otherwise(F.col("first_near")).alias("first_near"),
    )
