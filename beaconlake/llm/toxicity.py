"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

Voters are lexicon entries and patterns: a stated list of insults, shouting, and words and word
beginnings found in labelled rows of the learning folds. A generative label model is fitted to the
votes on all documents by expectation-maximisation: it estimates how often each voter fires on toxic
and on clean texts, and how strongly voters agree beyond what the label explains. The log odds of
correlated voters are shrunk by that. A voter that does not fire abstains; that none fires is a vote
of its own. A logistic regression is trained on the posteriors, and gives the score.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconlake.llm.common import fold_of, slices
from beaconlake.session import materialise

#: Folds by crc32 of the id; labels of the last one are never looked at.
FOLDS, HELD_OUT = 3, 1
#: Labelled rows that voters and classifier are learned from, about.
FIT_ROWS = 12_000
#: Features of the classifier, and voters (one bit of a long each).
FEATURES, VOTERS = 2048, 48
#: Texts a feature must occur in, and voters a toxic text should have.
LEAST_TEXTS, COVER = 3, 4
#: How many times as often a voter must fire on toxic texts as on clean ones.
LEAST_RATIO = 20
#: Voters that agree beyond the label by this much share their weight.
CORRELATED = 0.5
PREFIXES = (3, 4, 5, 6)
ROUNDS = 12
THRESHOLD = 0.7
AT_ONCE = 1 << 22
WORD = re.compile(r"[^\W\d_]+")
LEXICON = frozenset(
    """idiot stupid moron loser trash scum clown pathetic worthless disgusting imbecile dumb
    idiota estúpido imbécil basura dumm dummkopf abschaum widerlich crétin débile ordure minable""".split()
)
STATED = ("lexicon", "shouting", "bangs")


def features_of(text) -> set[str]:
    """Words (``=``), beginnings of words (``^``) and the stated patterns of a text."""
    if not isinstance(text, str):
        return set()
    words = set(WORD.findall(text.lower()))
    found = {"=" + w for w in words}
    for size in PREFIXES:
        found |= {"^" + w[:size] for w in words if len(w) >= size}
    return found | stated(text, words)


def stated(text: str, words: set[str]) -> set[str]:
    found = set()
    if not LEXICON.isdisjoint(words):
        found.add("lexicon")
    if sum(map(str.isupper, text)) * 2 > sum(map(str.isalpha, text)) > 20:
        found.add("shouting")
    if "!!" in text:
        found.add("bangs")
    return found


class Features:
    """The chosen features, looked up without spelling out those that are not chosen."""

    def __init__(self, names: list[str]):
        self.names = names
        self.number = {n: i for i, n in enumerate(names)}
        self.words = {n[1:]: i for i, n in enumerate(names) if n[0] == "="}
        self.prefixes = {n[1:]: i for i, n in enumerate(names) if n[0] == "^"}
        self.openings = {p[: PREFIXES[0]] for p in self.prefixes}

    def of(self, text) -> list[int]:
        if not isinstance(text, str):
            return []
        words = set(WORD.findall(text.lower()))
        found = {self.words[w] for w in words & self.words.keys()}
        for word in words:
            if word[: PREFIXES[0]] in self.openings:
                for size in PREFIXES:
                    at = self.prefixes.get(word[:size]) if len(word) >= size else None
                    if at is not None:
                        found.add(at)
        found |= {self.number[s] for s in stated(text, words) if s in self.number}
        return sorted(found)


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in slices(frames, "text", AT_ONCE):
        counts = {0: Counter(), 1: Counter()}
        for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
            counts[int(toxic)].update(features_of(text))
        rows = [(n, counts[1][n], counts[0][n]) for n in counts[0].keys() | counts[1].keys()]
        yield pd.DataFrame(rows, columns=["feature", "toxic", "clean"])


def learning_rows(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id, text, toxic``: about ``rows`` labelled documents of the learning folds, by a hash.

    Several labels of a document count as toxic if at least half of them do.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(
        (F.avg("toxic") >= 0.5).cast("int").alias("toxic")
    )
    known = materialise(known.filter(fold_of(F.col("doc_id"), FOLDS) != HELD_OUT), "toxicity-labels")
    share = min(1.0, rows / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    # The hash bounds the broadcast side at about ``rows`` rows of two numbers.
    return materialise(documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "toxicity-rows")


def choose_features(learning: DataFrame, toxic: int, clean: int, limit: int = FEATURES) -> list[str]:
    """The features that tell the classes apart best, by the share's difference in deviations."""
    counted = learning.mapInPandas(_counted, "feature string, toxic long, clean long")
    totals = counted.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    pooled = f"((toxic + clean) / {toxic + clean}D)"
    spread = f"sqrt({pooled} * (1 - {pooled}) * {1 / max(1, toxic) + 1 / max(1, clean)}D + 1e-12D)"
    scored = totals.filter(f"toxic + clean >= {LEAST_TEXTS}").selectExpr(
        "feature", f"abs(toxic / {max(1, toxic)}D - clean / {max(1, clean)}D) / {spread} AS score"
    )
    best = scored.orderBy(F.desc("score"), "feature").limit(limit - len(STATED)).collect()
    return [*STATED, *(r["feature"] for r in best if r["feature"] not in STATED)]


def choose_voters(active: list[list[int]], toxic: np.ndarray, features: int, limit: int = VOTERS) -> list[int]:
    """Features that fire on toxic texts: each next one covers most texts that lack voters."""
    matrix = np.zeros((len(active), features), dtype=bool)
    for row, ids in enumerate(active):
        matrix[row, ids] = True
    of_toxic, of_clean = matrix[toxic == 1], matrix[toxic == 0]
    false = of_clean.sum(axis=0)
    share_toxic = (of_toxic.sum(axis=0) + 0.5) / (len(of_toxic) + 1)
    share_clean = (false + 0.5) / (len(of_clean) + 1)
    usable = share_toxic > LEAST_RATIO * share_clean
    voters = [i for i in range(len(STATED)) if usable[i]]
    cover = of_toxic[:, voters].sum(axis=1)
    while len(voters) < limit:
        gain = np.where(usable, of_toxic[cover < COVER].sum(axis=0) - 3.0 * false, 0.0)
        gain[voters] = 0
        best = int(gain.argmax()) if len(gain) else 0
        if not len(gain) or gain[best] <= 0:
            break
        voters.append(best)
        cover += of_toxic[:, best]
    return voters


class LabelModel:
    """Firing rates of the voters on clean and toxic texts, and how far correlated ones are shrunk.

    The last rate is that of a text on which no voter fires.
    """

    def __init__(self, rates: np.ndarray, prior: float):
        self.rates = np.clip(rates, 1e-4, 1 - 1e-4)
        self.prior = min(max(prior, 1e-3), 1 - 1e-3)
        self.anchor = self.rates, self.prior
        self.trust = np.ones(rates.shape[1])

    def weights(self) -> tuple[list[float], float]:
        """Log odds that each vote adds to those of the prior."""
        clean, toxic = self.rates
        return (self.trust * np.log(toxic / clean)).tolist(), math.log(self.prior / (1 - self.prior))

    def fired_sql(self) -> list[str]:
        return [f"votes & {1 << i}L <> 0" for i in range(self.rates.shape[1] - 1)] + ["votes = 0"]

    def posterior_sql(self) -> str:
        weights, base = self.weights()
        votes = [f"IF({fired}, {w!r}D, 0D)" for fired, w in zip(self.fired_sql(), weights, strict=True)]
        return f"1D / (1D + exp(-({' + '.join([f'{base!r}D', *votes])})))"

    def posterior(self, fires: np.ndarray) -> np.ndarray:
        weights, base = self.weights()
        none = fires.sum(axis=1, keepdims=True) == 0
        return 1 / (1 + np.exp(-np.clip(np.hstack([fires, none]) @ np.array(weights) + base, -30, 30)))

    def step(self, patterns: DataFrame) -> float:
        """One round of expectation-maximisation over ``votes, n``; returns the change of the prior."""
        fired = self.fired_sql()
        rows = patterns.selectExpr("votes", "n", f"n * ({self.posterior_sql()}) AS t")
        sums = rows.selectExpr(
            "sum(n)", "sum(t)", *[f"sum(IF({f}, n, 0))" for f in fired], *[f"sum(IF({f}, t, 0D))" for f in fired]
        ).first()
        whole, toxic = float(sums[0] or 0), float(sums[1] or 0)
        if not whole:
            return 0.0
        fires, on_toxic = np.array(sums[2 : 2 + len(fired)], float), np.array(sums[2 + len(fired) :], float)
        estimate = np.vstack([(fires - on_toxic) / max(whole - toxic, 1.0), on_toxic / max(toxic, 1.0)])
        # Labelled rows count as much as all others, so that the classes keep their meaning.
        before, self.prior = self.prior, min(max((toxic / whole + self.anchor[1]) / 2, 1e-3), 1 - 1e-3)
        self.rates = np.clip((estimate + self.anchor[0]) / 2, 1e-4, 1 - 1e-4)
        return abs(self.prior - before)

    def correlate(self, patterns: DataFrame) -> None:
        """Shrink voters that agree on toxic texts beyond what the label explains."""
        size = self.rates.shape[1] - 1
        fires = f"filter(sequence(0, {size - 1}), i -> shiftright(votes, i) & 1 = 1)"
        rows = patterns.selectExpr(f"n * ({self.posterior_sql()}) AS t", f"{fires} AS a", f"{fires} AS b")
        total = rows.agg(F.sum("t")).first()[0] or 0.0
        pairs = rows.select("t", F.explode("a").alias("i"), "b").select("t", "i", F.explode("b").alias("j"))
        together = np.zeros((size, size))
        for r in pairs.groupBy("i", "j").agg(F.sum("t").alias("t")).collect():
            together[r["i"], r["j"]] = r["t"]
        rate = self.rates[1, :-1]
        deviation = np.sqrt(rate * (1 - rate))
        correlation = (together / max(total, 1.0) - np.outer(rate, rate)) / np.outer(deviation, deviation)
        np.fill_diagonal(correlation, 0)
        strong = np.where(correlation >= CORRELATED, np.minimum(correlation, 1), 0)
        self.trust[:-1] = 1 / (1 + strong.sum(axis=1))


def fit_labels(patterns: DataFrame, model: LabelModel, rounds: int = ROUNDS) -> LabelModel:
    for _ in range(rounds):
        if model.step(patterns) < 1e-6:
            break
    model.correlate(patterns)
    for _ in range(rounds):
        if model.step(patterns) < 1e-6:
            break
    return model


def logistic_regression(active: list[list[int]], target: np.ndarray, features: int, rounds: int = 400) -> np.ndarray:
    """Weights and, last, the intercept; sparse rows, soft targets, a little shrinkage."""
    rows = np.repeat(np.arange(len(active)), [len(a) for a in active])
    columns = np.array([i for a in active for i in a], dtype=np.int64)
    weights, velocity, square = np.zeros(features + 1), np.zeros(features + 1), np.zeros(features + 1)
    for step in range(1, rounds + 1):
        logit = np.bincount(rows, weights[columns], minlength=len(active)) + weights[-1]
        error = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - target
        gradient = np.r_[np.bincount(columns, error[rows], minlength=features), error.sum()] / max(1, len(active))
        gradient[:-1] += 1e-5 * weights[:-1]
        velocity = 0.9 * velocity + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        weights -= 0.1 * (velocity / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return weights


def _active(features: Features, voters: list[int]):
    bits = {v: 1 << i for i, v in enumerate(voters)}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, "text", AT_ONCE):
            active = [features.of(t) for t in frame["text"]]
            votes = [sum(bits[i] for i in a if i in bits) for a in active]
            yield frame.drop(columns="text").assign(active=active, votes=votes)

    return run


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``documents``.

    ``score`` rises with the chance that a text is toxic and follows from the text alone; missing and
    empty texts have the score of a text without any feature. ``predicted`` is 1 from a score of 0.7
    on. Labels with a missing id or value and those of the held-out fold are not used; without
    labels of both kinds only the stated voters are left. Repeated rows each get a row; other columns
    are ignored; an empty table gives no rows.
    """
    learning = learning_rows(documents, labels)
    sizes = {r["toxic"]: r["count"] for r in learning.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    names = choose_features(learning, toxic, clean)
    features = Features(names)
    kind = documents.schema["doc_id"].dataType.simpleString()
    seen = learning.mapInPandas(_active(features, []), f"doc_id {kind}, toxic int, active array<int>, votes long")
    sample = seen.select("toxic", "active").collect()  # about FIT_ROWS rows of few numbers
    active = [list(r["active"]) for r in sample]
    truth = np.array([r["toxic"] for r in sample], dtype=int)
    voters = choose_voters(active, truth, len(names))

    fires = np.zeros((len(active), len(voters)))
    place = {v: i for i, v in enumerate(voters)}
    for row, ids in enumerate(active):
        fires[row, [place[i] for i in ids if i in place]] = 1
    votes = np.hstack([fires, fires.sum(axis=1, keepdims=True) == 0])
    rates = np.vstack(
        [(votes[truth == y].sum(axis=0) + guess) / ((truth == y).sum() + 1) for y, guess in ((0, 0.02), (1, 0.2))]
    )
    scanned = documents.select("doc_id", "text").mapInPandas(
        _active(features, voters), f"doc_id {kind}, active array<int>, votes long"
    )
    scanned = materialise(scanned, "toxicity-active")
    patterns = materialise(scanned.groupBy("votes").agg(F.count("*").alias("n")), "toxicity-votes")
    model = fit_labels(patterns, LabelModel(rates, (toxic + 1) / (toxic + clean + 10)))
    weights = logistic_regression(active, model.posterior(fires), len(names))

    terms = F.array(*[F.lit(float(w)) for w in weights[:-1]])
    logit = F.aggregate("active", F.lit(float(weights[-1])), lambda total, i: total + F.get(terms, i))
    return scanned.select(
        "doc_id",
        (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        (1 / (1 + F.exp(-F.greatest(F.lit(-500.0), logit)))).alias("score"),
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
