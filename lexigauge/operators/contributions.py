"""What each feature contributes to a tree model's score, row by row, and what that says about the feature.

Path-dependent Shapley values: a feature that is not in the coalition follows both branches by the share of training rows
that took them. A leaf depends only on the features of its path, so its part of a row's values is a sum over subsets of
these, which a polynomial in the coalition's size gives for whole batches of rows at once. Trees are bounded by the model
and travel to the workers as a few arrays.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigauge.operators.ordering import rank_correlation


@dataclass
class Tree:
    """Arrays over nodes, node 0 is the root; ``feature`` is -1 in leaves. Rows at or below ``threshold`` go left, and
    those whose value is in ``groups`` where a node has one. ``cover`` counts training rows."""

    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    value: list[float]
    cover: list[float]
    groups: dict[int, frozenset[float]]

    def goes_left(self, node: int, values: np.ndarray) -> np.ndarray:
        group = self.groups.get(node)
        return values <= self.threshold[node] if group is None else np.isin(values, list(group))

    def leaves(self) -> Iterator[tuple[int, list[tuple[int, bool]]]]:
        """Every leaf with the turns that lead to it: (node, whether left)."""
        stack: list[tuple[int, list[tuple[int, bool]]]] = [(0, [])]
        while stack:
            node, path = stack.pop()
            if self.feature[node] < 0:
                yield node, path
            else:
                stack += [(self.left[node], [*path, (node, True)]), (self.right[node], [*path, (node, False)])]

    def expected(self) -> float:
        return sum(self.value[n] * self.cover[n] for n, _ in self.leaves()) / (self.cover[0] or 1.0)


def shapley(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Contributions (rows x features) to the tree's value; with ``expected`` they add up to it."""
    out = np.zeros(x.shape)
    for leaf, path in tree.leaves():
        follows: dict[int, np.ndarray] = {}
        share: dict[int, float] = {}
        for node, left in path:
            f, child = tree.feature[node], tree.left[node] if left else tree.right[node]
            goes = tree.goes_left(node, x[:, f]) == left
            follows[f] = follows[f] & goes if f in follows else goes
            share[f] = share.get(f, 1.0) * (tree.cover[child] / tree.cover[node] if tree.cover[node] else 0.0)
        names = list(share)
        d = len(names)
        for f in names:
            # coefficient k: sum over coalitions of k other features of the product of what they and the rest let through
            size = np.zeros((d, len(x)))
            size[0] = 1.0
            for g in names:
                if g != f:
                    size[1:] = size[1:] * share[g] + size[:-1] * follows[g]
                    size[0] *= share[g]
            weighted = sum(size[k] * (math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d)) for k in range(d))
            out[:, f] += tree.value[leaf] * (follows[f] - share[f]) * weighted
    return out


def fitted_trees(model: PipelineModel) -> tuple[list[Tree], list[float], list[str]]:
    """Trees, their weights in log odds, and the names of the model's inputs, read from the model's saved form."""
    from pyspark.sql import SparkSession

    spark, last = SparkSession.active(), model.stages[-1]
    base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="lexigauge-")
    path = f"{base}/model-{uuid.uuid4().hex}"
    last.write().save(path)
    nodes: dict[int, list] = {}
    for r in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect():  # bounded by trees and depth
        nodes.setdefault(r.treeID, []).append(r)
    trees = []
    for k in sorted(nodes):
        rows = sorted(nodes[k], key=lambda r: r.id)
        inner = [r.leftChild >= 0 for r in rows]
        split = [r.split for r in rows]
        groups = {i: frozenset(s.leftCategoriesOrThreshold) for i, s in enumerate(split) if inner[i] and s.numCategories >= 0}
        trees.append(Tree(
            [s.featureIndex if i else -1 for s, i in zip(split, inner, strict=True)], [s.leftCategoriesOrThreshold[0] if i and s.numCategories < 0 else 0.0 for s, i in zip(split, inner, strict=True)],
            [r.leftChild for r in rows], [r.rightChild for r in rows], [r.prediction for r in rows], [float(r.rawCount) for r in rows], groups,
        ))
    names = next(s for s in model.stages if s.__class__.__name__ == "VectorAssembler").getInputCols()
    return trees, [2.0 * w for w in last.treeWeights], names  # the classifier's margin is half the log odds


def contributions(rows: DataFrame, vector: str, keys: list[str], trees: list[Tree], weights: list[float]) -> DataFrame:
    """keys, expected double, parts array<double>: each feature's contribution to the weighted sum of the trees.

    ``vector``: an array<double> column with the features in the model's order. expected plus the parts is the sum. An
    empty table gives an empty result.
    """
    expected = float(sum(w * t.expected() for t, w in zip(trees, weights, strict=True)))
    kept = rows.select(*keys, F.col(vector).alias("_x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(len(keys)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            parts = sum((w * shapley(t, x) for t, w in zip(trees, weights, strict=True)), np.zeros(x.shape))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(parts.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.full(len(x), expected)), lists], names=[*keys, "expected", "parts"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "_x")
    return kept.mapInArrow(run, f"{schema}, expected double, parts array<double>")


def counted_covers(trees: list[Tree], rows: DataFrame, vector: str, times: str) -> list[Tree]:
    """``trees`` with the covers of rows that stand for several: each leaf's are counted, the others are their sums."""
    leaves = [[n for n, _ in t.leaves()] for t in trees]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [dict.fromkeys(own, 0) for own in leaves]
        for batch in batches:
            if not batch.num_rows:
                continue
            m = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for t, own in zip(trees, sums, strict=True):
                for leaf, path in t.leaves():
                    inside = np.ones(len(x), bool)
                    for node, left in path:
                        inside &= t.goes_left(node, x[:, t.feature[node]]) == left
                    own[leaf] += int(m[inside].sum())
        flat = [(k, leaf, n) for k, own in enumerate(sums) for leaf, n in own.items()]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in flat], pa.int64()) for i in range(3)], names=["tree", "leaf", "n"])

    found = rows.select(F.col(times).cast("long"), vector).mapInArrow(run, "tree long, leaf long, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n"))
    covers = {(r.tree, r.leaf): float(r.n) for r in found.collect()}  # bounded by trees and depth
    out = []
    for k, t in enumerate(trees):
        cover = [covers.get((k, node), 0.0) if t.feature[node] < 0 else 0.0 for node in range(len(t.feature))]
        for leaf, path in t.leaves():
            for node, _ in path:
                cover[node] += cover[leaf]
        out.append(replace(t, cover=cover))
    return out


def model_contributions(model: PipelineModel, rows: DataFrame, keys: list[str], trained: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """``contributions`` of a fitted pipeline of boosted trees in log odds, and the names of its inputs.

    ``trained``: where the model was fitted on cells, these with the number m of rows that each stands for.
    """
    trees, weights, names = fitted_trees(model)
    vector = vector_to_array(F.col(model.stages[-1].getFeaturesCol()))

    def ready(table: DataFrame) -> DataFrame:
        return model.transform(table if "y" in table.columns else table.withColumns({"y": F.lit(0.0), "w": F.lit(1.0)})).withColumn("_v", vector)

    if trained is not None:
        trees = counted_covers(trees, ready(trained), "_v", "m")
    return contributions(ready(rows), "_v", keys, trees, weights), names


def by_feature(parts: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """keys, feature, contribution: one row per feature, and one for expected_value; what a held-out explanation lists."""
    pairs = [F.struct(F.lit(n).alias("feature"), F.get("parts", F.lit(i)).alias("contribution")) for i, n in enumerate(names)]
    return parts.select(*keys, F.inline(F.array(*pairs, F.struct(F.lit("expected_value").alias("feature"), F.col("expected").alias("contribution")))))


def shares(long: DataFrame, by: list[str], times: str | None = None) -> DataFrame:
    """by, feature, share: a feature's part of the mean absolute contribution; 0 where there is none at all.

    ``times``: a column that says how many rows a row stands for.
    """
    size = F.abs("contribution")
    mean = long.where("feature <> 'expected_value'").groupBy(*by, "feature").agg((F.sum(size * F.col(times)) / F.sum(times) if times else F.avg(size)).alias("a"))
    total = mean.groupBy(*by).agg(F.sum("a").alias("t"))
    return mean.join(total, by).select(*by, "feature", F.round(F.coalesce(F.try_divide("a", "t"), F.lit(0.0)), 6).alias("share"))


def directions(long: DataFrame, values: DataFrame | None, keys: list[str], by: list[str], times: str | None = None) -> DataFrame:
    """by, feature, direction: rank correlation of a feature's values with its contributions over the comparable rows.

    ``values``: keys, by, feature, value of the rows that are comparable for a feature; without it ``long`` has value, null
    for others. Null for a constant one. ``times`` as in ``shares``.
    """
    both = long if values is None else values.join(long, [*keys, "feature"])
    both = both.select(*by, "feature", F.round("value", 9).alias("value"), F.round("contribution", 9).alias("contribution"), *([times] if times else []))
    return rank_correlation(both, [*by, "feature"], "value", "contribution", times).select(*by, "feature", F.col("correlation").alias("direction"))


def grown(rows: DataFrame, features: list[str], splits: list[tuple[str, float] | None], label: str, times: str | None = None) -> Tree:
    """A tree of given splits, fitted in one aggregation: covers are counted, a leaf's value is the mean label.

    ``splits`` in heap order (the children of i are 2 i + 1 and 2 i + 2); None is a leaf. A leaf without rows has value 0.
    """
    at = F.lit(0)
    for _ in range(int(math.log2(len(splits)))):
        step = at
        for i, split in enumerate(splits):
            if split:
                step = F.when(at == i, F.when(F.col(split[0]) <= split[1], 2 * i + 1).otherwise(2 * i + 2)).otherwise(step)
        at = step
    y = F.col(label).cast("double")
    n, v = (F.sum(times), F.sum(y * F.col(times)) / F.sum(times)) if times else (F.count(F.lit(1)), F.avg(y))
    found = {r.leaf: r for r in rows.groupBy(at.alias("leaf")).agg(n.alias("n"), v.alias("v")).collect()}  # a row for each leaf
    cover, value = [0.0] * len(splits), [0.0] * len(splits)
    for i in reversed(range(len(splits))):
        if splits[i]:
            cover[i] = cover[2 * i + 1] + cover[2 * i + 2]
        elif i in found:
            cover[i], value[i] = float(found[i].n), float(found[i].v)
    inner = [s is not None for s in splits]
    return Tree([features.index(s[0]) if s else -1 for s in splits], [s[1] if s else 0.0 for s in splits], [2 * i + 1 if x else -1 for i, x in enumerate(inner)], [2 * i + 2 if x else -1 for i, x in enumerate(inner)], value, cover, {})
