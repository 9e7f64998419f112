"""Isolation forest: trees grown one per group, rows scored by Arrow batches.

A tree needs at most 256 rows whatever the table holds, so growing is cheap and parallel
over trees. The grown forest is bounded by its parameters (trees × 511 nodes) and travels
to the scoring tasks inside the function.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.joins import join_small
from tidemark.session import cut_lineage

EULER = 0.5772156649015329


def expected_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    depth = 2.0 * (np.log(safe - 1.0) + EULER) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, depth, np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class Forest:
    """Flat node arrays; children of a leaf point to itself, so a walk of max_depth steps
    always ends on a leaf."""

    features: list[str]
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    depth: np.ndarray
    max_depth: int
    sample: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """2^(−mean path / expected path): towards 1 is more isolated."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.max_depth):
                below = x[rows, self.feature[node]] < self.cut[node]
                node = np.where(below, self.left[node], self.right[node])
            total += self.depth[node]
        scale = max(float(expected_path(np.array([self.sample]))[0]), 1e-12)
        return np.power(2.0, -(total / len(self.roots)) / scale)


_NODES = T.StructType(
    [
        T.StructField("part", T.StringType()),
        T.StructField("tree", T.IntegerType()),
        T.StructField("node", T.IntegerType()),
        T.StructField("feature", T.IntegerType()),
        T.StructField("cut", T.DoubleType()),
        T.StructField("left", T.IntegerType()),
        T.StructField("right", T.IntegerType()),
        T.StructField("depth", T.DoubleType()),
        T.StructField("rows", T.IntegerType()),
    ]
)


def _grow(features: list[str], max_depth: int, seed: int):
    def grow(tree_rows: pd.DataFrame) -> pd.DataFrame:
        part, tree = str(tree_rows["part"].iloc[0]), int(tree_rows["tree"].iloc[0])
        x = tree_rows.sort_values("pick")[features].to_numpy(dtype=float)
        rng = np.random.default_rng([seed, tree])
        nodes: list[list] = []
        pending = [(np.arange(len(x)), 0, -1, 0)]
        while pending:
            members, depth, parent, side = pending.pop()
            index = len(nodes)
            if parent >= 0:
                nodes[parent][5 + side] = index
            block = x[members]
            low, high = block.min(axis=0), block.max(axis=0)
            splittable = np.flatnonzero(high > low)
            if depth >= max_depth or len(members) <= 1 or len(splittable) == 0:
                ends = depth + float(expected_path(np.array([len(members)]))[0])
                nodes.append([part, tree, index, 0, 0.0, index, index, ends, len(x)])
                continue
            feature = int(rng.choice(splittable))
            cut = float(rng.uniform(low[feature], high[feature]))
            if cut <= low[feature]:
                cut = float(np.nextafter(low[feature], high[feature]))
            below = block[:, feature] < cut
            nodes.append([part, tree, index, feature, cut, index, index, 0.0, len(x)])
            pending.append((members[~below], depth + 1, index, 1))
            pending.append((members[below], depth + 1, index, 0))
        return pd.DataFrame(nodes, columns=_NODES.names)

    return grow


def tree_samples(
    rows: DataFrame, features: list[str], key: list[str], trees: int, sample: int, seed: int
) -> DataFrame:
    """``sample`` rows per part and tree without replacement: the smallest hashes.

    rows carry ``part`` and the part's row count ``part_rows``. A row is first kept only for
    the trees whose hash falls under a rate twice what is needed, so about 2 × trees × sample
    rows per part are ever shuffled, whatever the table holds.
    """
    span = float(1 << 31)
    rate = F.least(F.lit(1.0), F.lit(2.0 * sample) / F.col("part_rows"))
    picks = F.filter(
        F.transform(
            F.sequence(F.lit(0), F.lit(trees - 1)),
            lambda t: F.struct(
                t.alias("tree"),
                F.pmod(F.xxhash64(*key, t, F.lit(seed)), F.lit(1 << 31)).alias("pick"),
            ),
        ),
        lambda s: s["pick"] < rate * F.lit(span),
    )
    chosen = rows.select("part", *key, *features, F.explode(picks).alias("p")).select(
        "part", F.col("p.tree").alias("tree"), F.col("p.pick").alias("pick"), *key, *features
    )
    order = Window.partitionBy("part", "tree").orderBy("pick", *key)
    return (
        chosen.withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= sample)
        .drop("_n", *key)
    )


def _assemble(features: list[str], nodes: pd.DataFrame, max_depth: int) -> Forest:
    nodes = nodes.sort_values(["tree", "node"]).reset_index(drop=True)
    sizes = nodes.groupby("tree").size()
    base = nodes["tree"].map(sizes.cumsum().shift(fill_value=0)).to_numpy()
    return Forest(
        features=features,
        roots=np.unique(base),
        feature=nodes["feature"].to_numpy(),
        cut=nodes["cut"].to_numpy(),
        left=nodes["left"].to_numpy() + base,
        right=nodes["right"].to_numpy() + base,
        depth=nodes["depth"].to_numpy(),
        max_depth=max_depth,
        sample=int(nodes["rows"].max()),
    )


def _fit_parts(
    rows: DataFrame, features: list[str], key: list[str], trees: int, sample: int, seed: int
) -> dict[str, Forest]:
    max_depth = int(np.ceil(np.log2(max(sample, 2))))
    samples = tree_samples(rows, features, key, trees, sample, seed)
    nodes = samples.groupBy("part", "tree").applyInPandas(
        _grow(features, max_depth, seed), _NODES
    )
    return {
        part: _assemble(features, group, max_depth)
        for part, group in nodes.toPandas().groupby("part")
    }


def fit(
    rows: DataFrame,
    features: list[str],
    key: list[str],
    trees: int = 200,
    sample: int = 256,
    seed: int = 0,
) -> Forest:
    """Grows one forest. Two jobs; the driver receives at most trees × (2 × sample − 1) nodes."""
    whole = rows.withColumn("part", F.lit("")).withColumn("part_rows", F.lit(rows.count()))
    return _fit_parts(whole, features, key, trees, sample, seed)[""]


PARTS_AT_ONCE = 64  # forests of parts held by the driver and by a scoring task at a time


def fit_score_parts(
    rows: DataFrame,
    by: str,
    features: list[str],
    key: list[str],
    trees: int = 200,
    sample: int = 256,
    seed: int = 0,
    name: str = "forest",
) -> DataFrame:
    """A forest per value of ``by``, scoring that value's rows. Runs two jobs per 64 values.

    A part's rows stay spread over all tasks, in training and in scoring.
    """
    counts = cut_lineage(rows.groupBy(by).agg(F.count(F.lit(1)).alias("part_rows")))
    batches = -(-counts.count() // (PARTS_AT_ONCE // 2)) or 1
    sized = join_small(rows, counts, [by]).withColumn("part", F.col(by).cast("string"))
    out = None
    for batch in range(batches):
        part = sized.where(F.pmod(F.xxhash64("part"), F.lit(batches)) == batch)
        forests = _fit_parts(part, features, key, trees, sample, seed)
        shared = rows.sparkSession.sparkContext.broadcast(forests)
        scored = part.withColumn(
            name, _part_scorer(shared)(F.col("part"), F.array(*[F.col(c) for c in features]))
        ).drop("part", "part_rows")
        out = scored if out is None else out.unionByName(scored)
    return out


def _part_scorer(shared):
    @F.pandas_udf(T.DoubleType())
    def isolation(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        forests = shared.value
        for parts, values in batches:
            scores = pd.Series(np.zeros(len(parts)))
            for part, positions in parts.groupby(parts).indices.items():
                x = np.stack(values.to_numpy()[positions]).astype(float)
                scores.iloc[positions] = forests[part].score(x)
            yield scores

    return isolation


def score(rows: DataFrame, forest: Forest, name: str = "forest") -> DataFrame:
    """Adds the anomaly score of each row (higher is more anomalous)."""
    shared = rows.sparkSession.sparkContext.broadcast(forest)
    arrays = F.array(*[F.col(c).cast("double") for c in forest.features])

    @F.pandas_udf(T.DoubleType())
    def isolation(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for batch in batches:
            yield pd.Series(model.score(np.stack(batch.to_numpy())) if len(batch) else [])

    return rows.withColumn(name, isolation(arrays))


def shapley(
    rows: DataFrame, forest: Forest, key: list[str], background: DataFrame, top_k: int = 3
) -> DataFrame:
    """Exact Shapley values of the forest score over all feature coalitions.

    ``background`` is a fixed number of rows (a parameter, 50 by default); the rows to
    explain stay distributed. Returns key, metric, shapley, position — ``top_k`` rows per key.
    """
    features = forest.features
    n = len(features)
    reference = background.select(*[F.col(c).cast("double") for c in features]).toPandas()
    shared = rows.sparkSession.sparkContext.broadcast((forest, reference.to_numpy()))
    fields = T.ArrayType(T.DoubleType())

    masks = np.array([[(m >> f) & 1 for f in range(n)] for m in range(2**n)], dtype=bool)
    sizes = masks.sum(axis=1)
    factorial = np.cumprod([1, *range(1, n + 1)])
    weights = np.zeros((n, 2**n))
    for f in range(n):
        for m in range(2**n):
            s = sizes[m] - masks[m, f]
            weight = factorial[s] * factorial[n - s - 1] / factorial[n]
            weights[f, m] = weight if masks[m, f] else -weight

    @F.pandas_udf(fields)
    def attribute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, reference_rows = shared.value
        for batch in batches:
            out = []
            for row in batch:
                x = np.asarray(row, dtype=float)
                mixed = np.where(masks[:, None, :], x, reference_rows[None, :, :])
                value = model.score(mixed.reshape(-1, n)).reshape(len(masks), -1).mean(axis=1)
                out.append(weights @ value)
            yield pd.Series(out)

    values = attribute(F.array(*[F.col(c).cast("double") for c in features]))
    entries = F.array(
        *[
            F.struct(
                (-F.abs(F.col("_v")[i])).alias("size"),
                F.lit(i).alias("place"),
                F.lit(f.removeprefix("z_")).alias("metric"),
                F.col("_v")[i].alias("shapley"),
            )
            for i, f in enumerate(features)
        ]
    )
    return (
        rows.withColumn("_v", values)
        .select(*key, F.posexplode(F.slice(F.array_sort(entries), 1, top_k)).alias("position", "e"))
        .select(*key, F.col("e.metric").alias("metric"), F.col("e.shapley").alias("shapley"), "position")
    )


def background_rows(rows: DataFrame, key: list[str], size: int = 50, seed: int = 0) -> DataFrame:
    """``size`` rows chosen by hash: a top-k, not a collect of the table."""
    return rows.orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(size)
