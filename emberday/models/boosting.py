"""Choice of the best number of boosting rounds in one pass over validation rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberday.session import shared_folder

# Probabilities of a round are counted in steps of a millionth, so that a round has a bounded
# number of distinct scores at any number of rows.
SCORE_STEPS = 1_000_000
# Scores (rows x rounds) of so many cells are held at a time.
_CELLS = 4 << 20


@dataclass
class Forest:
    """Nodes of all trees in flat arrays: children by position, leaves point at themselves."""

    roots: np.ndarray
    weights: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    # for splits by category, which categories go left; a row of no use for other nodes
    category_row: np.ndarray
    goes_left: np.ndarray
    depth: int

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Margin of every row (columns: after 1, 2, ... rounds)."""
        out = np.empty((len(x), len(self.roots)))
        rows = np.arange(len(x))
        total = np.zeros(len(x))
        for k, root in enumerate(self.roots.tolist()):
            node = np.full(len(x), root)
            for _ in range(self.depth):
                seen = x[rows, self.feature[node]]
                row = self.category_row[node]
                left = seen <= self.threshold[node]
                named = row >= 0
                if named.any():
                    left[named] = self.goes_left[row[named], seen[named].astype(np.int64)]
                node = np.where(left, self.left[node], self.right[node])
            total = total + self.weights[k] * self.value[node]
            out[:, k] = total
        return out


def forest_of(model: GBTClassificationModel, spark: SparkSession) -> Forest:
    """The nodes of a model, read from its stored form: at most rounds x 2^(depth + 1) rows."""
    path = f"{shared_folder(spark)}/emberday/forest-{uuid.uuid4().hex}"
    model.write().save(path)
    node = F.col("nodeData")
    nodes = (
        spark.read.parquet(f"{path}/data")
        .select(
            F.col("treeID").alias("tree"), node["id"].alias("id"), node["prediction"].alias("value"),
            node["leftChild"].alias("left"), node["rightChild"].alias("right"),
            node["split"]["featureIndex"].alias("feature"), node["split"]["numCategories"].alias("categories"),
            node["split"]["leftCategoriesOrThreshold"].alias("bound"),
        )
        .toPandas()
        .sort_values(["tree", "id"], kind="stable", ignore_index=True)
    )
    sizes = nodes.groupby("tree").size().to_numpy()
    roots = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    start = np.repeat(roots, sizes)
    here = np.arange(len(nodes))
    inner = nodes["left"].to_numpy() >= 0
    categories = nodes["categories"].to_numpy()
    category_row, tables = np.full(len(nodes), -1), []
    threshold = np.full(len(nodes), np.inf)
    for i in np.flatnonzero(inner).tolist():
        bound = nodes["bound"][i]
        if categories[i] < 0:
            threshold[i] = bound[0]
        else:
            category_row[i] = len(tables)
            table = np.zeros(int(categories[i]), bool)
            table[np.asarray(bound, np.int64)] = True
            tables.append(table)
    width = max(map(len, tables), default=1)
    goes_left = np.array([np.pad(t, (0, width - len(t))) for t in tables]).reshape(-1, width)
    return Forest(
        roots=roots,
        weights=np.array(list(model.treeWeights)),
        feature=np.where(inner, nodes["feature"].to_numpy(), 0),
        threshold=threshold,
        left=np.where(inner, start + nodes["left"].to_numpy(), here),
        right=np.where(inner, start + nodes["right"].to_numpy(), here),
        value=nodes["value"].to_numpy(),
        category_row=category_row,
        goes_left=goes_left,
        depth=max(tree.depth for tree in model.trees),
    )


def round_counts(forest: Forest, validation: DataFrame, label: str) -> DataFrame:
    """``(rounds, score, pos, neg)``: label counts by score in steps, after every round.

    Trees run over arrays of rows; equal scores of a batch are added up before they leave the task.
    """
    shared = validation.sparkSession.sparkContext.broadcast(forest)  # rounds x 2^(depth + 1) nodes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        rounds = len(forest.roots)
        step = max(1, _CELLS // rounds)
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False)
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
            x = flat.reshape(len(batch), -1)
            for at in range(0, len(x), step):
                p = 1.0 / (1.0 + np.exp(-2.0 * forest.margins(x[at : at + step])))
                score = np.rint(p * SCORE_STEPS).astype(np.int64)
                key = (score + np.arange(rounds) * (SCORE_STEPS + 1)).ravel()
                keys, where = np.unique(key, return_inverse=True)
                positive = np.repeat(y[at : at + step] == 1, rounds)
                pos = np.bincount(where, positive, minlength=len(keys)).astype(np.int64)
                both = np.bincount(where, minlength=len(keys))
                yield pa.RecordBatch.from_pydict(
                    {
                        "rounds": pa.array(keys // (SCORE_STEPS + 1) + 1, pa.int32()),
                        "score": pa.array(keys % (SCORE_STEPS + 1), pa.int32()),
                        "pos": pa.array(pos, pa.int64()), "neg": pa.array(both - pos, pa.int64()),
                    }
                )

    rows = validation.select(F.col(label).cast("double").alias("y"), vector_to_array("features").alias("x"))
    counts = rows.mapInArrow(count, "rounds int, score int, pos bigint, neg bigint")
    return counts.groupBy("rounds", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def round_precision(counts: DataFrame) -> DataFrame:
    """``(rounds, pr_auc)``: average precision per round, null without positives.

    A round has at most ``SCORE_STEPS + 1`` scores, so its window is bounded.
    """
    ahead = W.partitionBy("rounds").orderBy(F.desc("score"))
    tp, fp = F.sum("pos").over(ahead), F.sum("neg").over(ahead)
    terms = counts.select("rounds", "pos", (F.col("pos") * tp / (tp + fp)).alias("term"))
    return terms.groupBy("rounds").agg(F.try_divide(F.sum("term"), F.sum("pos")).alias("pr_auc"))


def best_round(model: GBTClassificationModel, validation: DataFrame, label: str) -> int:
    """Number of rounds with the highest average precision on ``validation``, ties to the fewest.

    All rounds where no validation row is positive.
    """
    forest = forest_of(model, validation.sparkSession)
    top = (
        round_precision(round_counts(forest, validation, label))
        .where("pr_auc is not null").orderBy(F.desc("pr_auc"), "rounds").first()
    )
    return len(forest.roots) if top is None else top.rounds


def first_rounds(model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The model of the first ``rounds`` rounds, all other parameters kept."""
    spark = SparkSession.getActiveSession()
    java, gateway = model._java_obj, spark.sparkContext._gateway
    trees, weights = java.trees()[:rounds], list(java.treeWeights())[:rounds]
    kind = spark._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    array = gateway.new_array(kind, len(trees))
    numbers = gateway.new_array(gateway.jvm.double, len(trees))
    for i, (tree, weight) in enumerate(zip(trees, weights)):
        array[i], numbers[i] = tree, float(weight)
    shorter = gateway.jvm.org.apache.spark.ml.classification.GBTClassificationModel(java.uid(), array, numbers)
    return model._copyValues(GBTClassificationModel(java.copyValues(shorter, java.extractParamMap())))
