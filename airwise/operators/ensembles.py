"""Saved tree ensembles as column expressions (ML-13, ML-16, ML-03).

A fitted pipeline (string index, one-hot, assembler, boosted trees or forest) is reduced to a bundle of
plain rows: one per tree node, and one line of metadata with the feature list, where a one-hot feature names its column and
category.  Scoring compiles the bundle to Column expressions, so it is part of the plan: no model object on executors, no vectors, and
only the columns that the trees split on are read.  The node table is bounded by the model (trees x 2^depth), not by the data.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.ml.feature import OneHotEncoderModel, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "tree int, node int, feature int, threshold double, left_categories array<double>, `left` int, `right` int, value array<double>, weight double"


@dataclass
class Bundle:
    """``features``: column name, or (column, category) of a one-hot feature, category None for all unseen ones, whose
    known categories are in ``known``; ``nodes``: rows of NODES; ``kind``: "boosted" (binary, values are margins) or "forest" (class
    probabilities)."""

    kind: str
    features: list
    known: dict[str, list[str]]
    nodes: list[tuple]
    meta: dict


def from_pipeline(model: PipelineModel, path: str, meta: dict | None = None) -> Bundle:
    """The bundle of a fitted pipeline of ``models.make_pipeline``; ``path`` is a new folder that Spark can write."""
    spark = SparkSession.getActiveSession()
    index = {m.getOutputCol() if not m.isSet("outputCols") else m.getOutputCols()[0]: m for m in model.stages if isinstance(m, StringIndexerModel)}
    hot = {o: i for m in model.stages if isinstance(m, OneHotEncoderModel) for i, o in zip(m.getInputCols(), m.getOutputCols())}
    sizes = {o: n for m in model.stages if isinstance(m, OneHotEncoderModel) for o, n in zip(m.getOutputCols(), m.categorySizes)}
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    features, known = [], {}
    for c in assembler.getInputCols():
        if c not in hot:
            features.append(c)
            continue
        indexer = index[hot[c]]
        column, labels = indexer.getInputCol(), list(indexer.labelsArray[0])
        known[column] = labels
        features += [(column, x) for x in [*labels, None][:sizes[c]]]
    trees = model.stages[-1]
    trees.write().overwrite().save(path)
    weights = [float(w) for w in trees.treeWeights]
    boosted = isinstance(trees, GBTClassificationModel)
    if not boosted and not isinstance(trees, RandomForestClassificationModel):
        raise ValueError("only boosted trees and random forests for classification can be compiled")
    nodes = []
    for r in spark.read.parquet(f"{path}/data").toDF("treeID", "nodeData").select("treeID", "nodeData.*").orderBy("treeID", "id").collect():
        inner, stats = r.leftChild >= 0, [float(x) for x in r.impurityStats or ()]
        value = [r.prediction] if boosted else [x / (sum(stats) or 1.0) for x in stats]
        split = r.split
        nodes.append((r.treeID, r.id, split.featureIndex if inner else None,
                      split.leftCategoriesOrThreshold[0] if inner and split.numCategories < 0 else None,
                      list(split.leftCategoriesOrThreshold) if inner and split.numCategories >= 0 else None,
                      r.leftChild if inner else None, r.rightChild if inner else None, None if inner else value, weights[r.treeID]))
    return Bundle("boosted" if boosted else "forest", features, known, nodes, meta or {})


def save(bundle: Bundle, path: str) -> str:
    """ML-16: node table and one line of metadata below ``path``."""
    spark = SparkSession.getActiveSession()
    spark.createDataFrame(bundle.nodes, NODES).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    meta = {"kind": bundle.kind, "features": bundle.features, "known": bundle.known, "meta": bundle.meta}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    return path


def load(path: str) -> Bundle:
    spark = SparkSession.getActiveSession()
    m = json.loads(spark.read.text(f"{path}/meta").first()[0])
    nodes = [tuple(r) for r in spark.read.parquet(f"{path}/nodes").collect()]
    return Bundle(m["kind"], [tuple(f) if isinstance(f, list) else f for f in m["features"]], m["known"], nodes, m["meta"])


def _feature(bundle: Bundle, i: int) -> Column:
    """A feature as a double; null counts as NaN, which goes right at every threshold."""
    f = bundle.features[i]
    if isinstance(f, str):
        return F.coalesce(F.col(f).cast("double"), F.lit(float("nan")))
    column, category = f
    hit = F.col(column) == category if category is not None else ~F.col(column).isin(bundle.known[column])
    return F.coalesce(hit, F.lit(category is None)).cast("double")


def _tree(bundle: Bundle, nodes: dict[int, tuple], at: int, k: int) -> Column:
    _, _, feature, threshold, categories, left, right, value, _ = nodes[at]
    if feature is None:
        return F.lit(float(value[k]))
    x = _feature(bundle, feature)
    goes_left = x <= F.lit(threshold) if threshold is not None else x.isin([float(c) for c in categories])
    return F.when(goes_left, _tree(bundle, nodes, left, k)).otherwise(_tree(bundle, nodes, right, k))


def class_scores(bundle: Bundle) -> list[Column]:
    """One probability per class."""
    trees: dict[int, dict[int, tuple]] = {}
    for n in bundle.nodes:
        trees.setdefault(n[0], {})[n[1]] = n
    width = max(len(n[7]) for n in bundle.nodes if n[7] is not None)
    sums = []
    for k in range(width):
        total: Column = F.lit(0.0)
        for t in sorted(trees):
            total = total + F.lit(float(trees[t][0][8])) * _tree(bundle, trees[t], 0, k)
        sums.append(total)
    if bundle.kind == "boosted":
        p = 1.0 / (1.0 + F.exp(-2.0 * sums[0]))
        return [1.0 - p, p]
    every = sum(sums[1:], sums[0])
    return [s / every for s in sums]


def score(bundle: Bundle, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """ML-13: batch scoring -> probability array, probability of the last class and prediction (the first class of the highest probability)."""
    scored = df.select(*keep, F.array(*class_scores(bundle)).alias("probs"))
    best = F.array_position("probs", F.array_max("probs")).cast("int") - 1
    return scored.select(*keep, "probs", F.element_at("probs", -1).alias("p"), best.alias("prediction"))


def used_columns(bundle: Bundle) -> list[str]:
    """Columns that some split reads."""
    found = {bundle.features[n[2]] for n in bundle.nodes if n[2] is not None}
    return sorted({f if isinstance(f, str) else f[0] for f in found})
