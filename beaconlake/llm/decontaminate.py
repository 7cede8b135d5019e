"""Benchmark decontamination by a prefix-filtered set join.

An item gives windows of ``width`` consecutive words. A window is contained in a document only if
each of its words is, so any of them is a necessary prefix. Words are ordered by how often they
occur in all documents; the two rarest words of a window, with their distance, are its prefix.
A document position that bears such a prefix proposes the span around it, if the span lies within
the document, and an equality join of the spans with the windows verifies them.
"""

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconlake.llm.common import UID, digest, slices, text_bytes
from beaconlake.session import materialise

#: Prefixes or words that one pass over the documents broadcasts at most.
BLOCK = 300_000
#: Characters that are tokenised at once.
AT_ONCE = 1 << 23
#: Lower-cases A-Z and turns every other ASCII byte that is no letter or digit into a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)


def words_of(text) -> list[bytes]:
    return text_bytes(text).translate(WORD_BYTES).split()


def _windows(width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for item, text in zip(frame["item_id"], frame["text"], strict=True):
                words = words_of(text)
                for at in range(max(1, len(words) - width + 1) if words else 0):
                    rows.append((item, b" ".join(words[at : at + width]).decode("utf-8", "replace")))
            yield pd.DataFrame(rows, columns=["item_id", "window"]).drop_duplicates()

    return run


def item_windows(items: DataFrame, width: int) -> DataFrame:
    """``item_id, window``: the distinct windows of each item, words joined by a space."""
    rows = items.selectExpr("CAST(item_id AS STRING) AS item_id", "text").filter("item_id IS NOT NULL")
    return rows.mapInPandas(_windows(width), "item_id string, window string").distinct()


def _counts(vocabulary: frozenset):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, "text", AT_ONCE):
            counts = Counter()
            for text in frame["text"]:
                counts.update(words_of(text))
            known = vocabulary & counts.keys()
            rows = [(w.decode("utf-8", "replace"), counts[w]) for w in known]
            yield pd.DataFrame(rows, columns=["word", "n"])

    return run


def _in_blocks(df: DataFrame, key: str) -> Iterator[list]:
    """The rows of ``df`` in driver-side blocks of bounded size."""
    blocks = max(1, math.ceil(df.count() / BLOCK))
    for block in range(blocks):
        yield df.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == block).collect()


def word_counts(documents: DataFrame, words: DataFrame) -> DataFrame:
    """``word, n``: how often each of ``words`` occurs in all documents; absent ones have no row."""
    parts = [
        documents.select("text").mapInPandas(
            _counts(frozenset(r.word.encode() for r in rows)), "word string, n long"
        )
        for rows in _in_blocks(words, "word")
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("word").agg(F.sum("n").alias("n"))


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """``word, other, delta, at, size`` of the windows whose words all occur in the documents.

    ``word`` is the rarest, at place ``at`` of ``size``; ``other`` is the next one, ``delta``
    words further on. A window of one word has itself as the other.
    """
    placed = windows.select("window", F.split("window", " ").alias("words")).select(
        "window", F.size("words").alias("size"), F.posexplode("words").alias("place", "word")
    )
    ranked = (
        placed.join(counts, "word")
        .groupBy("window", "size")
        .agg(F.sort_array(F.collect_list(F.struct("n", "word", "place"))).alias("by_rarity"))
        .filter("size(by_rarity) = size")
    )
    second = "by_rarity[least(1, size - 1)]"
    return ranked.selectExpr(
        "by_rarity[0].word AS word", f"{second}.word AS other",
        f"{second}.place - by_rarity[0].place AS delta", "by_rarity[0].place AS at", "size",
    ).distinct()


def _spans(rows: list, carry: Sequence[str], with_documents: bool):
    index: dict[bytes, list] = {}
    for r in rows:
        index.setdefault(r["word"].encode(), []).append((r["delta"], r["other"].encode(), r["at"], r["size"]))
    columns = [UID, *carry, "n_words", "start", "size", "window"]

    def proposed(words: list[bytes]) -> Iterator[tuple[int, int]]:
        for at, word in enumerate(words):
            for delta, other, place, size in index.get(word, ()):
                start = at - place
                if 0 <= start <= len(words) - size and words[at + delta] == other:
                    yield start, size

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, "text", AT_ONCE):
            documents, found = [], []
            for uid, text, *carried in frame[[UID, "text", *carry]].itertuples(index=False, name=None):
                words = words_of(text)
                documents.append((uid, *carried, len(words), None, None, None))
                for start, size in set(proposed(words)):
                    span = b" ".join(words[start : start + size]).decode("utf-8", "replace")
                    found.append((uid, *[None] * len(carry), None, start, size, span))
            out = pd.DataFrame((documents if with_documents else []) + found, columns=columns)
            yield out.astype({n: "Int64" for n in ("n_words", "start", "size")})

    return run


def contamination(
    documents: DataFrame, items: DataFrame, width: int = 10, carry: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """The carried columns, ``n_words, n_hit, n_items, items_sha256, contaminated`` per document.

    Words are letters, digits and non-ASCII characters, A-Z lower-cased. A window is ``width``
    consecutive words of an item; an item with fewer words, but not none, is one window. A document
    word inside any occurrence of a window is hit. ``n_items`` counts the items with occurring
    windows, ``items_sha256`` is taken from their ids, sorted as strings and joined by commas.

    Missing and empty texts have no words; items without words or id have no windows; ids that
    several items share stand for one item. Repeated rows each get a row, other columns are
    ignored, and without documents there are no rows.
    """
    owned = materialise(item_windows(items, width), "item-windows")
    windows = owned.select("window").distinct()
    words = materialise(windows.select(F.explode(F.split("window", " ")).alias("word")).distinct(), "item-words")
    counts = materialise(word_counts(documents, words), "item-word-counts")
    needed = materialise(prefixes(windows, counts), "item-prefixes")

    rows = documents.select(F.monotonically_increasing_id().alias(UID), "text", *carry)
    blocks = list(_in_blocks(needed, "word")) if needed.count() <= BLOCK else None
    if blocks is None:  # several passes need row numbers that stay
        rows, blocks = materialise(rows, "decontaminate-rows"), _in_blocks(needed, "word")
    carried = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*carry).schema)
    schema = f"{UID} long, {carried}, n_words long, start long, size long, window string"
    parts = [
        materialise(rows.mapInPandas(_spans(block, carry, number == 0), schema), "decontaminate-spans")
        for number, block in enumerate(blocks)
    ]
    spans = reduce(DataFrame.unionByName, parts)
    hits = materialise(
        spans.filter("window IS NOT NULL").select(UID, "start", "size", "window").join(windows, "window"),
        "decontaminate-hits",
    )
    places = F.collect_set(F.struct("start", "size")).alias("spans")
    hit_words = hits.groupBy(UID).agg(places).selectExpr(
        UID, "size(array_distinct(flatten(transform(spans, s -> sequence(s.start, s.start + s.size - 1))))) AS hit"
    )
    hit_items = (
        hits.select(UID, "window").distinct().join(owned, "window").groupBy(UID)
        .agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    )
    found = hit_words.join(hit_items, UID)
    no_items = F.coalesce("items", F.array().cast("array<string>"))
    result = spans.filter("n_words IS NOT NULL").select(UID, *carry, "n_words").join(found, UID, "left")
    return result.select(
        *carry, "n_words",
        F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(no_items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", no_items), 256).alias("items_sha256"),
        (F.coalesce("hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(documents: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """The documents in which no window of an item occurs, with their columns; missing texts stay."""
    key = "__text_digest"
    keyed = documents.select("doc_id", "text", digest(F.col("text")).alias(key))
    bad = contamination(keyed, items, width, (key,)).filter("contaminated").select(key).distinct()
    marked = documents.withColumn(key, digest(F.col("text")))
    return marked.join(bad, key, "left_anti").select(*documents.columns)
