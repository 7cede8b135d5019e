"""Isolation forests per access point, or one for all rows.

Isolation Forest: Liu, Ting and Zhou, ICDM 2008. Every tree draws its own uniform sample from all
rows of its key; Spark shuffles the samples to the tasks that grow a key's trees, some to a
task, and scores all rows in parallel.
"""

import io
import math
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconlake.operators.ranking import quantiles
from beaconlake.schema import (
    AP_MODEL_FEATURES, CONTAMINATION, GLOBAL_MODEL_FEATURES, MIN_MODEL_ROWS, MIN_USABLE_ROWS, SEED,
)
from beaconlake.session import materialise

SAMPLE = 256
TREES_PER_TASK = 25
ROWS_PER_GROUP = 500_000
# Rows without a model are spread over this many keys, so that none of them is hot.
SPREAD = 1024
# A forest up to this many nodes is broadcast (about 30 bytes each); a larger one is joined.
BROADCAST_NODES = 2_000_000
NODE_FIELDS = ["feature", "threshold", "left", "right", "size", "depth"]
TREE_SCHEMA = (
    "model_key string, tree_id int, sample int, feature array<int>, threshold array<double>, "
    "left array<int>, right array<int>, size array<int>, depth array<int>"
)


def average_path(size: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of ``size`` points."""
    n = np.asarray(size, dtype=float)
    big = np.maximum(n, 3)
    path = 2 * (np.log(big - 1) + np.euler_gamma) - 2 * (big - 1) / big
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, path))


def grow_trees(points: np.ndarray, trees: int, rng: np.random.Generator) -> list[dict]:
    """Grow all trees together, one level at a time.

    Each tree takes its own sample without replacement. A node splits on a random feature that
    still varies in it, at a uniform point of that feature's range.
    """
    sample = min(SAMPLE, len(points))
    chosen = np.concatenate([rng.permutation(len(points))[:sample] for _ in range(trees)])
    return grow_sampled(points[chosen], np.full(trees, sample), rng)


def grow_sampled(x: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> list[dict]:
    """Grow trees from their samples, which follow each other in ``x``."""
    trees, width = len(sizes), x.shape[1]
    samples = sizes
    limit = math.ceil(math.log2(max(int(sizes.max()), 2)))
    node = np.repeat(np.arange(trees), sizes)  # the node each sampled point is in
    tree = np.arange(trees)
    levels, first = [], 0
    for depth in range(limit + 1):
        order = np.argsort(node, kind="stable")
        starts = np.searchsorted(node[order], np.arange(first, first + len(tree)))
        sizes = np.diff(np.append(starts, len(order)))
        low = np.minimum.reduceat(x[order], starts, axis=0)
        high = np.maximum.reduceat(x[order], starts, axis=0)
        varies = high > low
        splits = varies.any(axis=1) & (depth < limit)
        feature = np.where(varies, rng.random((len(tree), width)), -1.0).argmax(axis=1)
        at = np.arange(len(tree))
        low, high = low[at, feature], high[at, feature]
        cut = low + rng.random(len(tree)) * (high - low)
        cut = np.where(cut >= high, low, cut)
        # Children of the n-th splitting node follow this level, two by two.
        child = first + len(tree) + 2 * (np.cumsum(splits) - 1)
        own = first + at
        levels.append(
            {
                "tree": tree,
                "feature": np.where(splits, feature, -1),
                "threshold": np.where(splits, cut, np.inf),
                "left": np.where(splits, child, own),
                "right": np.where(splits, child + 1, own),
                "size": sizes,
                "depth": np.full(len(tree), depth),
            }
        )
        if not splits.any():
            break
        inside = node - first
        moves = splits[inside]
        x, inside = x[moves], inside[moves]
        right = x[np.arange(len(x)), feature[inside]] > cut[inside]
        node = child[inside] + right
        first += len(tree)
        tree = np.repeat(tree[splits], 2)
    nodes = {name: np.concatenate([level[name] for level in levels]) for name in levels[0]}
    grown = []
    for number in range(trees):
        mine = np.flatnonzero(nodes["tree"] == number)
        grown.append(
            {
                "tree_id": number,
                "sample": int(samples[number]),
                "feature": nodes["feature"][mine],
                "threshold": nodes["threshold"][mine],
                # Node numbers become positions inside the tree.
                "left": np.searchsorted(mine, nodes["left"][mine]),
                "right": np.searchsorted(mine, nodes["right"][mine]),
                "size": nodes["size"][mine],
                "depth": nodes["depth"][mine],
            }
        )
    return grown


def _grow_block(table: pa.Table, features: list[str], seed: int) -> pa.Table:
    """The trees of one block of a key, each from the lowest of its own draws."""
    ordered = table.sort_by([("tree_id", "ascending"), ("draw", "ascending"), ("row_id", "ascending")])
    key = ordered["model_key"][0].as_py()
    numbers, starts = np.unique(ordered["tree_id"].to_numpy(), return_index=True)
    sizes = np.minimum(np.diff(np.append(starts, len(ordered))), SAMPLE)
    taken = np.concatenate([np.arange(at, at + n) for at, n in zip(starts, sizes)])
    points = np.column_stack([ordered[f].to_numpy()[taken] for f in features])
    rng = np.random.default_rng([seed, zlib.crc32(key.encode()), int(numbers[0])])
    grown = grow_sampled(points, sizes, rng)
    return pa.table(
        {
            "model_key": [key] * len(grown),
            "tree_id": pa.array(numbers, pa.int32()),
            "sample": pa.array([t["sample"] for t in grown], pa.int32()),
            **{
                n: pa.array(
                    [t[n] for t in grown],
                    pa.list_(pa.float64() if n == "threshold" else pa.int32()),
                )
                for n in NODE_FIELDS
            },
        }
    )


def trees_by_key(table: pa.Table) -> dict[str, list[dict]]:
    """Rows of the tree table as NumPy views, grouped by key and ordered by tree."""
    table = table.sort_by([("model_key", "ascending"), ("tree_id", "ascending")])
    ends = np.cumsum(pc.list_value_length(table["feature"]).to_numpy())
    flat = {n: pc.list_flatten(table[n]).to_numpy() for n in NODE_FIELDS}
    keys, samples = table["model_key"].to_pylist(), table["sample"].to_pylist()
    found: dict[str, list[dict]] = {}
    for row, (start, end) in enumerate(zip(np.append(0, ends[:-1]), ends)):
        tree = {n: values[start:end] for n, values in flat.items()} | {"sample": samples[row]}
        found.setdefault(keys[row], []).append(tree)
    return found


def pack_trees(trees: list[dict]) -> dict:
    """The trees of one key as flat arrays for scoring."""
    width = max(len(t["feature"]) for t in trees)
    shape = (len(trees), width)
    feature, target = np.zeros(shape, np.intp), np.zeros((*shape, 2), np.intp)
    threshold, path = np.full(shape, np.inf), np.zeros(shape)
    for row, tree in enumerate(trees):
        n = len(tree["feature"])
        feature[row, :n] = np.maximum(tree["feature"], 0)
        threshold[row, :n] = tree["threshold"]
        target[row, :n, 0] = tree["left"] + row * width
        target[row, :n, 1] = tree["right"] + row * width
        path[row, :n] = tree["depth"] + average_path(tree["size"])
    return {
        "feature": feature.ravel(),
        "threshold": threshold.ravel(),
        "target": target.ravel(),
        "path": path.ravel(),
        "roots": np.arange(len(trees)) * width,
        "depth": max(int(np.max(t["depth"])) for t in trees),
        "sample": int(trees[0]["sample"]),
    }


def path_scores(points: np.ndarray, packed: dict, block: int = 1024) -> np.ndarray:
    """Anomaly score of each point: near -1 for isolated points, towards 0 for ordinary ones.

    All trees of a block of points are walked together; blocks are small enough for the cache.
    """
    scores, trees = np.empty(len(points)), len(packed["roots"])
    norm = max(float(average_path(packed["sample"])), 1e-12)
    for start in range(0, len(points), block):
        x = np.ascontiguousarray(points[start : start + block])
        flat, row = x.ravel(), np.repeat(np.arange(len(x)) * x.shape[1], trees)
        node = np.tile(packed["roots"], len(x))
        for _ in range(packed["depth"]):
            value = flat.take(packed["feature"].take(node) + row)
            right = value > packed["threshold"].take(node)
            node = packed["target"].take(2 * node + right)
        mean = packed["path"].take(node).reshape(len(x), trees).mean(axis=1)
        scores[start : start + block] = -np.exp2(-mean / norm)
    return scores


def _score_frame(keys: pd.Series, points: pd.DataFrame, packed: dict) -> np.ndarray:
    scores, matrix = np.full(len(keys), np.nan), points.to_numpy(float)
    for key, rows in keys.groupby(keys).indices.items():
        if key in packed:
            scores[rows] = path_scores(matrix[rows], packed[key])
    return scores


@dataclass
class Forest:
    """Model tables: one row per tree, and one row per key with its scaling and offset."""

    trees: DataFrame
    params: DataFrame
    features: list[str]
    key: str | None

    def save(self, path: str) -> None:
        self.trees.write.parquet(f"{path}/trees")
        self.params.write.parquet(f"{path}/params")
        spark = self.params.sparkSession
        about = [(self.features, self.key, "IsolationForest", CONTAMINATION)]
        spark.createDataFrame(
            about, "features array<string>, key string, model_type string, contamination double"
        ).write.parquet(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Forest":
        about = spark.read.parquet(f"{path}/about").first()
        return cls(
            spark.read.parquet(f"{path}/trees"), spark.read.parquet(f"{path}/params"),
            list(about["features"]), about["key"],
        )

    def score(
        self, rows: DataFrame, where: Column | None = None, into: str = "model_score",
        broadcast_nodes: int = BROADCAST_NODES,
    ) -> DataFrame:
        """Add the decision score: below 0 for the most isolated twentieth of training rows.

        Null where the key has no model or ``where`` is false. A missing feature counts as 0.
        """
        key = F.lit("all") if self.key is None else F.col(self.key)
        no_model = F.concat(F.lit("\u0000"), F.pmod(_row_hash(rows), F.lit(SPREAD)).cast("string"))
        chosen = F.when(F.lit(True) if where is None else where, key)
        keyed = rows.withColumn("model_key", F.coalesce(chosen, no_model))
        raw = _raw_scores(self, keyed, broadcast_nodes)
        decision = F.col("raw_score") - F.col("offset")
        return raw.withColumn(into, decision).drop("model_key", "raw_score", "offset")

    def node_count(self) -> int:
        return self.trees.agg(F.sum(F.size("feature"))).first()[0] or 0

    def nodes(self) -> DataFrame:
        """The forest as a node table."""
        return self.trees.select(
            "model_key", "tree_id",
            F.posexplode(F.arrays_zip(*NODE_FIELDS)).alias("node_id", "node"),
        ).select("model_key", "tree_id", "node_id", "node.*")


def packed_models(forest: Forest) -> DataFrame:
    """``model_key, model``: all that scoring a key needs, packed into one binary value per key."""

    def pack(trees: pa.Table, params: pa.Table) -> pa.Table:
        if not len(trees) or not len(params):
            return pa.table({"model_key": pa.array([], pa.string()), "model": pa.array([], pa.binary())})
        ((key, grown),) = trees_by_key(trees).items()
        (row,) = params.to_pylist()
        packed = pack_trees(grown) | {n: np.array(row[n]) for n in ("means", "scales", "offset")}
        content = io.BytesIO()
        np.savez(content, **packed)
        return pa.table({"model_key": [key], "model": pa.array([content.getvalue()], pa.binary())})

    params = forest.params.select("model_key", "means", "scales", "offset")
    return (
        forest.trees.groupBy("model_key").cogroup(params.groupBy("model_key"))
        .applyInArrow(pack, "model_key string, model binary")
    )


def unpack_model(content: bytes) -> dict:
    """A packed model as ``path_scores`` takes it, with its scaling and offset."""
    with np.load(io.BytesIO(content)) as arrays:
        return {n: arrays[n] if arrays[n].ndim else arrays[n].item() for n in arrays.files}


def _row_hash(rows: DataFrame) -> Column:
    """A hash of what tells rows apart, to spread them."""
    return F.xxhash64(F.lit(0), *[c for c in ("row_id", "sensor_id", "frame_id", "capture_us") if c in rows.columns])


def _scaled(features: list[str], have: list[str]) -> list[Column]:
    return [
        (
            (F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in have else F.lit(0.0))
            - F.element_at("means", i + 1)
        )
        / F.element_at("scales", i + 1)
        for i, f in enumerate(features)
    ]


def _raw_scores(forest: Forest, keyed: DataFrame, broadcast_nodes: int) -> DataFrame:
    """Add ``raw_score``, and the key's ``offset`` once the forest has one."""
    known = [c for c in ("means", "scales", "offset") if c in forest.params.columns]
    scaling = forest.params.select("model_key", *known)
    points = [f"_x{i}" for i in range(len(forest.features))]
    scaled = _scaled(forest.features, keyed.columns)
    ready = (
        keyed.join(scaling, "model_key", "left")
        .withColumns(dict(zip(points, scaled)))
        .drop("means", "scales")
    )
    if forest.node_count() <= broadcast_nodes:
        return _score_by_broadcast(forest, ready, points)
    return _score_by_cogroup(forest, ready, points)


def _score_by_broadcast(forest: Forest, ready: DataFrame, points: list[str]) -> DataFrame:
    grown = trees_by_key(forest.trees.toArrow())
    packed = ready.sparkSession.sparkContext.broadcast({k: pack_trees(t) for k, t in grown.items()})

    @F.pandas_udf("double")
    def raw_score(key: pd.Series, point: pd.DataFrame) -> pd.Series:
        return pd.Series(_score_frame(key, point, packed.value)).replace(np.nan, None)

    scored = ready.withColumn("raw_score", raw_score("model_key", F.struct(*points)))
    return scored.drop(*points)


def _score_group(left: pa.Table, right: pa.Table, points: list[str]) -> pa.Table:
    raw = pa.nulls(len(left), pa.float64())
    if len(left) and len(right):
        (trees,) = trees_by_key(right).values()
        packed = pack_trees(trees)
        matrix = np.column_stack([left[p].to_numpy() for p in points])
        raw = pa.array(path_scores(matrix, packed))
    return left.drop(points + ["salt"]).append_column("raw_score", raw)


def _score_by_cogroup(
    forest: Forest, ready: DataFrame, points: list[str], rows_per_group: int = ROWS_PER_GROUP
) -> DataFrame:
    """Bring rows and trees together by key; hot keys are salted and their trees repeated.

    The table of salts grows with rows / ``rows_per_group`` and is joined without a hint.
    """
    salts = materialise(
        ready.groupBy("model_key")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > rows_per_group)
        .select("model_key", F.ceil(F.col("n") / rows_per_group).alias("salts")),
        "model-salts",
    )
    names = [c for c in ready.columns if c not in points]
    spread = F.coalesce("salts", F.lit(1))
    salted = (
        ready.join(salts, "model_key", "left")
        .withColumn("salt", F.pmod(_row_hash(ready), spread))
        .select(*names, *points, "salt")
    )
    trees = (
        forest.trees.join(salts, "model_key", "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), spread - 1)))
        .drop("salts")
    )
    schema = ready.select(*names).schema.add("raw_score", "double")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        return _score_group(left, right, points)

    return (
        salted.groupBy("model_key", "salt")
        .cogroup(trees.groupBy("model_key", "salt"))
        .applyInArrow(score, schema)
    )


def finite(column: Column) -> Column:
    """Null for NaN and infinities."""
    value = column.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def available_features(candidates: list[str], rows: DataFrame) -> list[str]:
    found = [f for f in candidates if f in rows.columns]
    if not found:
        raise ValueError("no training feature is present in the data")
    return found


def _drawn_trees(trees: int) -> str:
    """SQL for the trees whose sample a row is in, each with the chance ``share`` of its own.

    The first one follows from one geometric draw, so that most rows of a large key cost one hash.
    """
    uniform = f"(shiftrightunsigned(draw, 11) / {float(1 << 53)}D)"
    first = f"CAST(least(ln(1D - {uniform}) / ln(1D - share), {trees}D) AS INT)"
    other = f"shiftrightunsigned(xxhash64(draw, t), 11) / {float(1 << 53)}D < share"
    return (
        f"CASE WHEN share >= 1 THEN sequence(0, {trees - 1}) WHEN {first} < {trees} THEN "
        f"concat(array({first}), filter(sequence({first} + 1, {trees}), t -> t < {trees} AND {other})) END"
    )


def _fit(
    rows: DataFrame, features: list[str], key: str | None, trees: int, fill_zero: bool,
    min_rows: int, min_usable: int, seed: int, contamination: float, broadcast_nodes: int,
) -> Forest:
    values = [finite(F.col(f)) for f in features]
    if fill_zero:
        values = [F.coalesce(v, F.lit(0.0)) for v in values]
    model_key = F.lit("all") if key is None else F.col(key)
    # Draws come from a hash, so a row gets the same ones whatever the partitioning.
    draw = F.xxhash64("sensor_id", "frame_id", F.lit(seed))
    usable = F.lit(True)
    for f in features:
        usable = usable & F.col(f).isNotNull()
    training = materialise(
        rows.select(
            model_key.alias("model_key"), draw.alias("draw"),
            F.concat_ws("/", "sensor_id", F.col("frame_id").cast("string")).alias("row_id"),
            *[v.alias(f) for v, f in zip(values, features)],
        ).withColumn("usable", usable),
        "forest-training",
    )
    spreads = [F.stddev_pop(F.when(F.col("usable"), F.col(f))) for f in features]
    params = materialise(
        training.groupBy("model_key")
        .agg(
            F.count("*").alias("observations"),
            F.count(F.when(F.col("usable"), 1)).alias("rows"),
            F.array(*[F.avg(F.when(F.col("usable"), F.col(f))) for f in features]).alias("means"),
            F.array(*[F.when(s > 0, s).otherwise(1.0) for s in spreads]).alias("scales"),
        )
        .filter((F.col("observations") >= min_rows) & (F.col("rows") >= min_usable)),
        "forest-scaling",
    )
    scaled = [c.alias(f) for c, f in zip(_scaled(features, features), features)]
    chances = training.filter("usable").join(params, "model_key").withColumn(
        "share", F.lit(SAMPLE + 6 * math.sqrt(SAMPLE)) / F.col("rows")
    )
    sampled = (
        chances.withColumn("tree_id", F.explode(F.expr(_drawn_trees(trees))))
        .withColumn("draw", F.xxhash64("draw", "tree_id", F.lit("order")))
        .select("model_key", "tree_id", "draw", "row_id", *scaled)
    )

    def grow(table: pa.Table) -> pa.Table:
        return _grow_block(table, features, seed)

    block = F.floor(F.col("tree_id") / TREES_PER_TASK).alias("block")
    tree_table = materialise(sampled.groupBy("model_key", block).applyInArrow(grow, TREE_SCHEMA), "forest-trees")
    unset = Forest(tree_table, params, features, "model_key")
    raw = _raw_scores(unset, training.filter("usable").drop("draw", "usable"), broadcast_nodes)
    scores = materialise(raw.filter("raw_score IS NOT NULL").select("model_key", "raw_score"), "forest-scores")
    offsets = quantiles(scores, ["model_key"], "raw_score", {"offset": contamination})
    ranges = scores.groupBy("model_key").agg(
        F.min("raw_score").alias("low"), F.max("raw_score").alias("high")
    )
    fitted = materialise(
        params.join(offsets, "model_key").join(ranges, "model_key")
        .withColumn("score_min", F.col("low") - F.col("offset"))
        .withColumn("score_max", F.col("high") - F.col("offset"))
        .drop("low", "high"),
        "forest-params",
    )
    return Forest(tree_table, fitted, features, key)


def fit_per_ap(
    observations: DataFrame, profiles: DataFrame, trees: int = 100, seed: int = SEED,
    contamination: float = CONTAMINATION, broadcast_nodes: int = BROADCAST_NODES,
) -> Forest:
    """One forest per profiled access point with enough rows; rows with bad values are left out."""
    features = available_features(AP_MODEL_FEATURES, observations)
    profiled = observations.join(profiles.select("bssid"), "bssid", "left_semi")
    return _fit(
        profiled, features, "bssid", trees, False, MIN_MODEL_ROWS, MIN_USABLE_ROWS, seed,
        contamination, broadcast_nodes,
    )


def fit_global(
    deviations: DataFrame, trees: int = 200, seed: int = SEED, contamination: float = CONTAMINATION,
    broadcast_nodes: int = BROADCAST_NODES,
) -> Forest:
    """One forest over all rows and all available features; bad values count as 0."""
    features = available_features(GLOBAL_MODEL_FEATURES, deviations)
    return _fit(deviations, features, None, trees, True, 1, 1, seed, contamination, broadcast_nodes)


def score_range(forest: Forest) -> DataFrame:
    """Lowest and highest decision score over the training rows, per key."""
    return forest.params.select("model_key", "rows", "score_min", "score_max")
