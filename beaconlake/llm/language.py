"""Language identification by Bayesian fusion of several kinds of evidence.

* Text: naive Bayes over character trigrams, tempered because trigrams overlap.
* Declared language (markup or a column): how often each language is declared as each value.
* Address suffix: how often each language occurs under it.
* Host: a prior smoothed from the whole corpus to the domain to the host.

The tables of declarations, suffixes, domains and hosts are grouped sums of the texts' own posterior
weights over all rows; a row's own weight is taken out again before they judge it.
"""

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconlake.llm.common import fresh_name, slices, text_bytes
from beaconlake.session import materialise

#: Labelled rows that the trigram model is fitted on, about, and how many more each rarer language may
#: have, so that it gets this many at least; fewer if there are fewer.
FIT_ROWS, FIT_LEAST = 4000, 1000
#: Parts in which the share of the rows that are drawn is counted.
DRAWN = 1 << 20
BUCKETS = 1 << 16
#: Every character lies in three trigrams.
TEMPER = 1 / 3
#: Rows' worth of trust in the wider level, and in a declaration being true.
SMOOTHING, DECLARED_TRUST = 8.0, 4.0
#: Accepted from this probability on, if the text is not less likely than letters at random by this.
LEAST_PROBABILITY, LEAST_EVIDENCE = 0.5, -0.5
AT_ONCE = 1 << 22
#: Lower-cases A-Z; digits, punctuation and white space become spaces.
LETTER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
SPACES = re.compile(rb" +")
HIDDEN = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
LANG = re.compile(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]+)")


def letters(text) -> bytes:
    """The letters of a text in lower case (A-Z), words apart by one space, spaces around."""
    found = SPACES.sub(b" ", text_bytes(text).translate(LETTER_BYTES)).strip()
    return b" " + found + b" " if found else b""


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams of the texts, and where each text's trigrams end."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.empty(0, np.intp), np.zeros(len(texts), np.int64)
    codes = (data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * np.uint32(2654435761) >> np.uint32(16)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    inside = np.ones(len(data), dtype=bool)
    inside[np.concatenate([ends[sizes > 0] - 1, ends[sizes > 1] - 2])] = False
    return codes[inside[:-2]].astype(np.intp), np.cumsum(np.maximum(sizes - 2, 0))


class TrigramModel:
    """Log probabilities of trigram buckets per language, and of bytes for the background."""

    def __init__(self, languages: list[str], counts: np.ndarray, octets: np.ndarray):
        self.languages = languages
        smooth = counts + 0.5
        self.logs = np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32).T.copy()
        letters_seen = octets + 0.5
        self.octets = np.log(letters_seen / letters_seen.sum()).astype(np.float32)

    def score(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log likelihood per language, of the background, and number of trigrams, for each text."""
        clean = [letters(t) for t in texts]
        codes, ends = trigrams(clean)
        starts = np.r_[0, ends[:-1]]
        filled = np.flatnonzero(ends > starts)
        result = np.zeros((len(texts), len(self.languages)))
        for i in range(len(self.languages)):
            if len(filled):
                result[filled, i] = np.add.reduceat(self.logs[:, i][codes].astype(np.float64), starts[filled])
        octets = np.array([self.octets[np.frombuffer(t, np.uint8)].sum(dtype=np.float64) if t else 0.0 for t in clean])
        return result, octets, ends - starts


def _trigram_counts(languages: list[str]):
    number_of = {name: i for i, name in enumerate(languages)}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[int, np.ndarray] = {}
        octets = np.zeros(256, dtype=np.int64)
        for frame in slices(frames, "text", AT_ONCE):
            for language, group in frame.groupby("lang")["text"]:
                texts = [letters(t) for t in group]
                seen = np.bincount(trigrams(texts)[0], minlength=BUCKETS)
                number = number_of[language]
                counts[number] = counts[number] + seen if number in counts else seen
                octets += np.bincount(np.frombuffer(b"".join(texts), np.uint8), minlength=256)
        for number, counted in counts.items():
            seen = np.flatnonzero(counted)
            yield pd.DataFrame({"language": number, "bucket": seen, "n": counted[seen]})
        yield pd.DataFrame({"language": -1, "bucket": np.arange(256), "n": octets})

    return run


def fit_trigrams(labelled: DataFrame, rows: int = FIT_ROWS, least: int = FIT_LEAST) -> TrigramModel:
    """Fit on rows with ``lang`` and ``text``, chosen by a hash of the text: about ``rows`` of all.

    All values of ``lang`` are told apart. Of each value about ``least`` rows are taken at least, all if
    there are fewer, and never none.
    """
    draw = F.pmod(F.xxhash64("text"), F.lit(DRAWN))
    known = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"), F.min(draw).alias("lowest")).collect()
    names = sorted(r["lang"] for r in sizes)
    share = min(1.0, rows / max(1, sum(r["n"] for r in sizes)))
    below = {r["lang"]: max(math.ceil(min(1.0, max(share, least / r["n"])) * DRAWN), r["lowest"] + 1) for r in sizes}
    chosen = known.limit(0)
    if names:
        bounds = labelled.sparkSession.createDataFrame(list(below.items()), "lang string, below long")
        chosen = known.join(F.broadcast(bounds), "lang").filter(draw < F.col("below")).select("lang", "text")  # a row a language
    counted = chosen.mapInPandas(_trigram_counts(names), "language int, bucket long, n long")
    counts, octets = np.zeros((len(names), BUCKETS)), np.zeros(256)
    for r in counted.groupBy("language", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        if r["language"] < 0:
            octets[r["bucket"]] = r["n"]
        else:
            counts[r["language"], r["bucket"]] = r["n"]
    return TrigramModel(names, counts, octets)


def page_parts(page, url) -> tuple[str | None, str | None, str | None, str | None, str | None]:
    """``text, declared, suffix, domain, host`` of a page; what is missing is null."""
    text = declared = None
    if isinstance(page, str):
        found = LANG.search(page)
        declared = found[1].lower() if found else None
        text = html.unescape(HIDDEN.sub(" ", page))
    host = re.match(r"(?i)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url) if isinstance(url, str) else None
    if not host:
        return text, declared, None, None, None
    labels = host[1].lower().strip(".").split(".")
    return text, declared, labels[-1], ".".join(labels[-2:]), ".".join(labels)


def _score(model: TrigramModel, carry: list[str], pages: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, "text", AT_ONCE):
            out = frame[carry].copy()
            if pages:
                parts = [page_parts(*row) for row in zip(frame["text"], frame["host"], strict=True)]
                texts = [p[0] for p in parts]
                for i, name in enumerate(("declared", "suffix", "domain", "host"), start=1):
                    out[name] = [p[i] for p in parts]
            else:
                texts = frame["text"].tolist()
                for name in ("declared", "suffix", "domain", "host"):
                    out[name] = frame[name]
            scores, background, sizes = model.score(texts)
            weights = normalised(TEMPER * scores) * (sizes > 0)[:, None] if len(frame) else scores
            for i in range(len(model.languages)):
                out[f"s{i}"], out[f"w{i}"] = TEMPER * scores[:, i], weights[:, i]
            excess = TEMPER * (scores.max(axis=1, initial=-np.inf) - 3 * background)
            out["evidence"] = np.where(sizes > 0, excess / np.maximum(sizes, 1), -np.inf)
            out["trigrams"] = sizes
            yield out

    return run


LEVELS = ("declared", "suffix", "domain", "host")


def normalised(logs: np.ndarray) -> np.ndarray:
    """Probabilities from log weights, row by row."""
    weights = np.exp(logs - logs.max(axis=1, keepdims=True))
    return weights / weights.sum(axis=1, keepdims=True)


def posterior(own: np.ndarray, scores: np.ndarray, sums: dict[str, np.ndarray], corpus: np.ndarray, declared: np.ndarray):
    """Fuse the evidence of some rows.

    ``own`` are the rows' text weights, ``sums`` the summed weights of their level values with NaN where
    the value is missing, ``corpus`` those of all rows; ``declared`` marks the declared language.
    """
    languages = len(corpus)
    others = np.maximum(corpus - own, 0)
    logs = scores.copy()
    prior = (others + 1) / (others.sum(axis=1, keepdims=True) + languages)
    for level in ("domain", "host"):
        rest = np.maximum(np.nan_to_num(sums[level] - own), 0)
        prior = (rest + SMOOTHING * prior) / (rest.sum(axis=1, keepdims=True) + SMOOTHING)
    logs += np.log(prior)
    said = (np.maximum(sums["declared"] - own, 0) + 0.5 + DECLARED_TRUST * declared) / (others + DECLARED_TRUST + languages)
    below = (np.maximum(sums["suffix"] - own, 0) + 0.5) / (others + languages)
    return normalised(logs + np.nan_to_num(np.log(said)) + np.nan_to_num(np.log(below)))


def _judge(languages: list[str], corpus: np.ndarray, carry: list[str]):
    each = range(len(languages))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own = frame[[f"w{i}" for i in each]].to_numpy(dtype=float)
            scores = frame[[f"s{i}" for i in each]].to_numpy(dtype=float)
            sums = {level: frame[[f"{level}_{i}" for i in each]].to_numpy(dtype=float) for level in LEVELS}
            declared = (frame["declared"].to_numpy()[:, None] == np.array(languages, dtype=object)[None, :]).astype(float)
            found = posterior(own, scores, sums, corpus, declared.reshape(len(frame), len(languages)))
            best = found.argmax(axis=1) if len(frame) else np.empty(0, int)
            out = frame[[*carry, "declared"]].copy()
            out["language"] = np.array(languages, dtype=object)[best]
            out["probability"] = found[np.arange(len(frame)), best]
            sound = (frame["trigrams"] > 0) & (frame["evidence"] >= LEAST_EVIDENCE)
            out["accepted"] = sound & (out["probability"] >= LEAST_PROBABILITY)
            yield out

    return run


def fuse(scored: DataFrame, languages: list[str], carry: list[str], kinds: str) -> DataFrame:
    """Posterior of each row from its text scores and weights and its other evidence."""
    each = range(len(languages))
    rows = materialise(scored, "language-text")
    sums = rows.agg(*[F.coalesce(F.sum(f"w{i}"), F.lit(0.0)) for i in each]).first()
    joined = rows
    for level in LEVELS:
        counted = [F.sum(f"w{i}").alias(f"{level}_{i}") for i in each]
        joined = joined.join(rows.filter(F.col(level).isNotNull()).groupBy(level).agg(*counted), level, "left")
    judge = _judge(languages, np.array([float(x) for x in sums]), carry)
    return joined.mapInPandas(judge, f"{kinds}, declared string, language string, probability double, accepted boolean")


def identify(rows: DataFrame, model: TrigramModel, carry: list[str], pages: bool = False) -> DataFrame:
    """The carried columns, ``declared, language, probability, accepted`` for every row.

    ``rows`` has ``text, declared, suffix, domain, host``, or with ``pages`` the markup as ``text`` and
    the address as ``host``. Missing evidence of any kind does not count. A row without letters has
    only its other evidence and is not accepted. Repeated rows each count; an empty table gives
    no rows. Without any language known nothing is identified and nothing accepted.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*carry).schema)
    known = model.languages
    if not known:
        return rows.select(
            *carry, F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("language"),
            F.lit(None).cast("double").alias("probability"), F.lit(False).alias("accepted"),
        )
    scores = ", ".join(f"s{i} double, w{i} double" for i in range(len(known)))
    schema = f"{kinds}, declared string, suffix string, domain string, host string, {scores}, evidence double, trigrams long"
    return fuse(rows.mapInPandas(_score(model, carry, pages), schema), known, carry, kinds)


def identify_documents(documents: DataFrame, carry: list[str]) -> DataFrame:
    """Languages of documents, whose ``lang`` is a declaration and whose ``source`` is a host."""
    none = F.lit(None).cast("string")
    rows = documents.select(
        *carry, "text", F.col("lang").alias("declared"), none.alias("suffix"), none.alias("domain"), F.col("source").alias("host")
    )
    return identify(rows, fit_trigrams(documents), carry)


def identify_pages(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """Languages of web pages from text, markup, suffix and host; fitted on labelled documents."""
    rows = pages.select("page_id", F.col("html").alias("text"), F.col("url").alias("host"))
    return identify(rows, fit_trigrams(labelled), ["page_id"], pages=True)


def keep_identified(documents: DataFrame) -> DataFrame:
    """The documents whose language is accepted, with their columns.

    A decision depends on text, ``lang`` and ``source`` alone (and on sums over all rows), so rows are
    told apart by a digest of these and neither numbered nor copied: rejected digests are stored, and
    the input is filtered by them. Missing and empty texts have no letters and go, repeated rows
    fare alike, and an empty table gives no rows. Other columns, whatever their names, are kept.
    """
    name = fresh_name("digest", documents.columns)
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in ("text", "lang", "source")]
    marked = documents.withColumn(name, F.sha2(F.concat_ws("\u0000", *parts), 256))
    found = identify_documents(marked.select(name, "text", "lang", "source"), [name])
    rejected = materialise(found.filter("NOT accepted").select(name).distinct(), "language-rejected")
    return marked.join(rejected, name, "left_anti").select(*documents.columns)
