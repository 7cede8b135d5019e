"""Spelling variants: words one code point apart, found through pivotal grams.

The bigrams of the vocabulary are ordered by how many words have them. The prefix of a word are its
three rarest bigrams (and those as rare as the third). Of the prefix, dynamic programming picks two
disjoint bigrams with the least number of words, the pivots: one edit leaves one of them whole.
Of two words at distance one, the one whose prefix ends rarer has its whole pivot within the other's
prefix (ties at the end of a prefix belong to it, so this holds for repeated bigrams too).

An edit lies before, between or behind the pivots, or hits one of them, and position limits follow from that:
what precedes the edit stays at its place from the start, what follows it at its place from the end.
The index therefore keys a prefix bigram by the head of the word up to it and by the tail from it on, two
disjoint ones by head and tail. Where the edit hits one pivot, the whole one still has its head or tail
and the far end of the word (or, if the hit one is that end, all the rest). The pivots ask under
the same keys, with lengths that differ by one at most; what meets is verified by the edit distance itself.
"""

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconlake.session import materialise

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: The runs of letters that count as words, and the letters that are lower-cased.
RUN = "[A-Za-zÀ-ÿ]"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: One occurrence in so many loses a code point.
NOISE = 97
#: Distinct words that a counting task holds before it hands on its sums.
HELD = 1 << 19
GRAM, EDITS = 2, 1
PREFIX = GRAM * EDITS + 1
#: Places of one bigram that the index needs. Pivots are the first places of least cost, so at most three
#: places of a pivot's bigram precede it (those that overlap the other pivot); an edit adds two at most.
PLACES = 6


def noisy(doc_id: str, run: str) -> str:
    """The run, or what is left of it where the hash of document and run says so."""
    h = zlib.crc32(f"{doc_id}:{run}".encode("utf-8", "surrogatepass"))
    if h % NOISE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count(least: int):
    runs = re.compile(f"{RUN}{{{least},}}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[str] = Counter()

        def flush() -> pd.DataFrame:
            words = list(total)
            out = pd.DataFrame({"word": pd.Series(words, dtype=object), "n": np.fromiter(total.values(), np.int64, len(words))})
            total.clear()
            return out

        for frame in frames:
            for doc_id, text in zip(frame["id"].tolist(), frame["text"].tolist(), strict=True):
                if not isinstance(text, str):
                    continue
                for raw, n in Counter(runs.findall(text)).items():
                    word = noisy(doc_id, raw.translate(LOWER))
                    if len(word) >= least:
                        total[word] += n
                if len(total) >= HELD:
                    yield flush()
        yield flush()

    return run


def vocabulary(documents: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n``: words of at least ``least_length`` code points and ``least_count`` occurrences."""
    rows = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    counts = rows.filter("text IS NOT NULL").mapInPandas(_count(least_length), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _grams(word: str) -> list[str]:
    return [word[i : i + GRAM] for i in range(len(word) - GRAM + 1)]


def _gram_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: Counter[str] = Counter()
    for frame in frames:
        for word in frame["word"]:
            total.update(set(_grams(word)))
    yield pd.DataFrame({"gram": pd.Series(list(total), dtype=object), "n": np.fromiter(total.values(), np.int64, len(total))})


def prefix_of(word: str, counts: dict[str, int]) -> list[tuple[int, int]]:
    """``(words with the gram, position)`` of the prefix: the rarest grams, ties at its end included.

    Of a gram that occurs often in the word, its first places are enough.
    """
    # Counts order the grams, the gram itself breaks ties between different ones.
    ranked = sorted((counts[g], g, at) for at, g in enumerate(_grams(word)))
    last = ranked[min(PREFIX, len(ranked)) - 1][:2]
    kept: dict[str, list[tuple[int, int]]] = {}
    for n, g, at in ranked:
        if (n, g) <= last and len(kept.setdefault(g, [])) < PLACES:
            kept[g].append((n, at))
    return [place for places in kept.values() for place in places]


def pivots_of(prefix: list[tuple[int, int]]) -> tuple[int, ...]:
    """Positions of the ``EDITS + 1`` disjoint prefix grams with the least sum of counts.

    Dynamic programming over the grams by position: the best choice of k grams among the first j either
    leaves gram j out, or takes it after the best choice of k - 1 that ends before it.
    """
    by_place = sorted((at, n) for n, at in prefix)
    need = EDITS + 1
    best: list[list[tuple[int, tuple[int, ...]] | None]] = [[(0, ()), *[None] * need]]
    for j, (at, n) in enumerate(by_place):
        before = max((i + 1 for i in range(j) if by_place[i][0] + GRAM <= at), default=0)
        row = list(best[j])
        for k in range(1, need + 1):
            if (so_far := best[before][k - 1]) is not None:
                taken = (so_far[0] + n, (*so_far[1], at))
                if row[k] is None or taken < row[k]:
                    row[k] = taken
        best.append(row)
    return best[-1][need][1]


def _key(*parts: str) -> int:
    h = xxhash.xxh64_intdigest("\0".join(parts).encode())
    return h - (1 << 64) if h >> 63 else h


def index_keys(word: str, places: list[int]) -> set[int]:
    """Keys under which a word's prefix grams, and its ends, stand in the index."""
    length = str(len(word))
    found = {_key("start", word[k:]) for k in (1, 2, 3)} | {_key("end", word[:-k]) for k in (1, 2, 3)}
    for i in places:
        head, tail = word[: i + GRAM], word[i:]
        found |= {_key("head", head), _key("tail", tail)}
        found |= {_key("first", length, word[0], tail), _key("last", length, head, word[-1])}
        found |= {_key("both", head, word[j:]) for j in places if j >= i + GRAM}
    return found


def pivot_keys(word: str, pivots: tuple[int, ...]) -> set[int]:
    """Keys under which a word's pivots ask, one or three for each place where the edit may be."""
    first, last = pivots
    lengths = [str(len(word) + d) for d in (-EDITS, 0, EDITS)]
    head, tail = word[: first + GRAM], word[last:]
    found = {_key("tail", word[first:]), _key("both", head, tail), _key("head", word[: last + GRAM])}
    if first:  # the first pivot is hit, the second is whole
        found |= {_key("first", length, word[0], tail) for length in lengths}
    else:
        found.add(_key("start", word[GRAM:]))
    if last + GRAM < len(word):  # the other way round
        found |= {_key("last", length, head, word[-1]) for length in lengths}
    else:
        found.add(_key("end", word[:last]))
    return found


def _postings(counts: dict[str, int]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys, words, asks = [], [], []
            for word in frame["word"]:
                prefix = prefix_of(word, counts)
                probes, listed = pivot_keys(word, pivots_of(prefix)), index_keys(word, [at for _, at in prefix])
                for key in probes | listed:
                    keys.append(key)
                    words.append(word)
                    asks.append((key in probes) + 2 * (key in listed))
            columns = {"key": np.array(keys, np.int64), "word": pd.Series(words, dtype=object), "role": np.array(asks, np.int8)}
            yield pd.DataFrame(columns)

    return run


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, b`` with ``a < b``: all words of ``word`` that one inserted, deleted or replaced code point tells apart.

    Words have at least five code points of the letters above, so their bigrams are at most 8,100: their
    counts fit every task.
    """
    sums = words.mapInPandas(_gram_counts, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = {r.gram: r.n for r in sums.collect()}
    postings = materialise(words.select("word").mapInPandas(_postings(counts), "key long, word string, role byte"), "spelling-postings")
    asking = postings.filter("role & 1 = 1").select("key", F.col("word").alias("x"))
    listed = postings.filter("role & 2 = 2").select("key", F.col("word").alias("y"))
    close = "x <> y AND abs(length(x) - length(y)) <= 1 AND levenshtein(x, y, 1) = 1"
    pairs = asking.join(listed, "key").filter(close)
    return pairs.selectExpr("least(x, y) AS a", "greatest(x, y) AS b").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of all words that have a form: pointers jump twice as far each round."""
    at = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = at.join(onward, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
        )
        moved = materialise(moved, "spelling-roots")
        at = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return at


def spelling_variants(
    documents: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = 2
) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: each word of the vocabulary with its standard form.

    Words are runs of letters, A-Z lower-cased; where the crc32 of ``doc_id:run`` is divisible by 97 the
    run loses a code point (a missing id counts as an empty one). A word's form is the near word with
    the largest count, ties to the smaller in code-point order, if that count is at least ``times`` its
    own; ``root`` follows the forms to the end. Missing and empty texts have no words; repeated
    rows count each; other columns are ignored; an empty table gives no rows.
    ``least_length`` is at least 5, below which a word may lack two disjoint bigrams.
    """
    if least_length < 2 * GRAM + 1:
        raise ValueError("words need at least five code points")
    words = materialise(vocabulary(documents, least_length, least_count), "spelling-words")
    pairs = materialise(near_pairs(words), "spelling-pairs")
    both = pairs.union(pairs.select("b", "a")).toDF("word", "near")
    counts = words.withColumnsRenamed({"word": "near", "n": "near_n"})
    # Code-point order of UTF-8 text is its byte order, so the smallest struct is the wanted word.
    best = both.join(counts, "near").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best")
    )
    suits = -F.col("best.minus") >= times * F.col("n")
    found = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(suits, F.col("best.near")).alias("form"), F.when(suits, -F.col("best.minus")).alias("form_n"),
    )
    found = materialise(found, "spelling-forms")
    roots = _roots(found.filter("form IS NOT NULL"))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
