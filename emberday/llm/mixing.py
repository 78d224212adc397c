"""Mixing sources to target weights by hierarchical budgets and seeded epochs.

A token budget goes down a tree of domain, language and source. Siblings share their parent's
budget by weight; a node can take at most what its leaves hold, each document once per
allowed epoch. What a node can't take goes to its siblings by their weights; only what all
siblings together can't take goes back to the siblings of their parent. Shares are found in
closed form: of siblings ordered by capacity / weight a prefix is full, the others share the
rest, so one running sum per family gives every share.

A leaf's quota is filled from whole epochs and a prefix of one more. Each epoch has its own
seeded order of the leaf's documents; the prefix ends inside one document. The end is found
from sums over 4096 hash cells of each leaf and the order inside one of them, then each
document decides for itself, so no task orders the documents of a leaf.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberday.llm.names import free_names
from emberday.session import written

CELL_DIGITS = 3
_NONE = "(none)"


@dataclass(frozen=True)
class Level:
    """A level of the tree: its name, the node of a document, the weight of a node among siblings.

    ``node`` is a column of the documents, ``weight`` one of the columns named by the levels.
    """

    name: str
    node: Column
    weight: Column


def word_count(text: Column) -> Column:
    """Tokens of a text for budgeting: runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def budgets(leaves: DataFrame, levels: list[Level], budget: int, max_epochs: int) -> DataFrame:
    """``leaves`` (level names, ``tokens``) with ``quota``, whole tokens a leaf is to give.

    A node with a null, zero or negative weight gets nothing. A budget beyond the capacity of
    all leaves fills every leaf.
    """
    names = [level.name for level in levels]
    for level in levels:
        leaves = leaves.withColumn(f"w_{level.name}", F.coalesce(level.weight.cast("double"), F.lit(0.0)))
    alive = F.lit(True)
    for name in names:
        alive = alive & (F.col(f"w_{name}") > 0)
    leaves = leaves.withColumn("room", F.when(alive, F.col("tokens") * max_epochs).otherwise(0).cast("double"))
    given = leaves.withColumn("given", F.lit(float(budget)))
    for depth, name in enumerate(names):
        given = _share(given, names[:depth], name)
    return given.select(*names, "tokens", F.floor(F.least(F.col("given"), "room") + 1e-6).alias("quota"))


def _share(leaves: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Replace ``given``, the budget of each leaf's ancestor, by that of its node one level down."""
    nodes = leaves.groupBy(*parent, name).agg(
        F.sum("room").alias("cap"), F.max(f"w_{name}").alias("w"), F.max("given").alias("b")
    )
    family = [F.coalesce(F.col(p), F.lit("")) for p in parent] or [F.lit(0)]
    live = nodes.where("w > 0").withColumn("fill", F.col("cap") / F.col("w"))
    by_fill = W.partitionBy(*family).orderBy("fill", name)
    up = by_fill.rowsBetween(W.unboundedPreceding, -1)
    down = by_fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    whole = W.partitionBy(*family).orderBy("fill", name).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = live.withColumn(
        "full", F.coalesce(F.sum("cap").over(up), F.lit(0.0)) + F.col("fill") * F.sum("w").over(down) <= F.col("b")
    )
    ranked = ranked.withColumn("taken", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(whole))
    ranked = ranked.withColumn("shared", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(whole))
    share = F.when(F.col("full"), F.col("cap")).otherwise((F.col("b") - F.col("taken")) * F.col("w") / F.col("shared"))
    shares = ranked.select(*parent, name, share.alias("share"))
    return (
        leaves.join(shares, [*parent, name], "left")
        .withColumn("given", F.coalesce("share", F.lit(0.0)))
        .drop("share")
    )


def _order_key(seed: int, epoch: Column) -> Column:
    """Place of a document in an epoch's order, the same on every run."""
    return F.md5(F.concat_ws(":", F.lit(seed), epoch, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def plan(rows: DataFrame, levels: list[Level], share: float, max_epochs: int, seed: int) -> DataFrame:
    """One row per leaf: ``quota``, whole ``epochs``, and where the last epoch ends.

    ``rows`` holds (doc_id, level names, tokens). The last epoch takes documents whose key is
    below ``cut``, and ``cut_left`` tokens of the one at it.
    """
    names = [level.name for level in levels]
    leaves = written(rows.groupBy(*names).agg(F.sum("tokens").alias("tokens")), "mixing-leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    quotas = budgets(leaves, levels, int(total * share), max_epochs).where("tokens > 0 and quota > 0")
    quotas = written(
        quotas.withColumn("epochs", F.floor(F.col("quota") / F.col("tokens")))
        .withColumn("rest", F.col("quota") - F.col("epochs") * F.col("tokens")),
        "mixing-quotas",
    )
    keyed = (
        rows.where("tokens > 0")
        .join(quotas.where("rest > 0").select(*names, "epochs", "rest"), names)
        .withColumn("key", _order_key(seed, F.col("epochs")))
        .withColumn("cell", F.substring("key", 1, CELL_DIGITS))
    )
    cells = keyed.groupBy(*names, "rest", "cell").agg(F.sum("tokens").alias("n"))
    running = W.partitionBy(*names).orderBy("cell")
    last = cells.withColumn("before", F.sum("n").over(running) - F.col("n")).where(
        "before < rest and before + n >= rest"
    )
    inside = (
        keyed.join(last.select(*names, "cell", "before"), [*names, "cell"])
        .groupBy(*names, "rest", "before", "key").agg(F.sum("tokens").alias("n"))
    )
    order = W.partitionBy(*names).orderBy("key")
    ends = (
        inside.withColumn("start", F.col("before") + F.sum("n").over(order) - F.col("n"))
        .where("start < rest and start + n >= rest")
        .select(*names, F.col("key").alias("cut"), (F.col("rest") - F.col("start")).alias("cut_left"), F.col("n").alias("cut_tokens"))
    )
    return written(quotas.join(ends, names, "left"), "mixing-plan")


def _tree_rows(docs: DataFrame, levels: list[Level]) -> DataFrame:
    nodes = [F.coalesce(level.node.cast("string"), F.lit(_NONE)).alias(level.name) for level in levels]
    return docs.select("doc_id", *nodes, word_count(F.col("text")).alias("tokens"))


def _taken(seed: int) -> Column:
    """Tokens an epoch takes of a document: all in whole epochs, by the cut in the last one."""
    key = _order_key(seed, F.col("epoch"))
    at_cut = F.floor(F.col("cut_left") * F.col("tokens") / F.col("cut_tokens"))
    return (
        F.when(F.col("epoch") < F.col("epochs"), F.col("tokens"))
        .when(key < F.col("cut"), F.col("tokens"))
        .when(key == F.col("cut"), at_cut)
        .otherwise(0)
        .cast("bigint")
    )


def mixture(docs: DataFrame, levels: list[Level], share: float, max_epochs: int, seed: int = 17) -> DataFrame:
    """``(doc_id, levels, epoch, tokens, taken)``: a row per document row and epoch that uses it.

    The budget is ``share`` of all tokens. ``taken`` is below ``tokens`` only for the document
    at which a leaf's last epoch ends; rows repeating that doc_id split its part. A null level
    is a node ``(none)``; a null doc_id is an id of its own. Documents without tokens are never
    used. An empty table gives no rows. Other columns are not read.
    """
    names = [level.name for level in levels]
    rows = written(_tree_rows(docs, levels), "mixing-rows")
    leaf_plan = plan(rows, levels, share, max_epochs, seed)
    return (
        rows.where("tokens > 0").join(leaf_plan.drop("tokens", "quota", "rest"), names)
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("epochs"))))
        .withColumn("taken", _taken(seed)).where("taken > 0")
        .select("doc_id", *names, F.col("epoch").cast("int").alias("epoch"), "tokens", "taken")
    )


def mixed(docs: DataFrame, levels: list[Level], share: float, max_epochs: int, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` with all their columns, once per epoch that uses them.

    The document at which a leaf's last epoch ends stays whole, its text is not cut.
    """
    rows = written(_tree_rows(docs, levels), "mixing-rows")
    leaf_plan = plan(rows, levels, share, max_epochs, seed)
    names = [level.name for level in levels]
    own = free_names(docs, *[f"level_{k}" for k in range(len(names))], "plan", "times", "copy")
    inner, (held, uses, copy) = dict(zip(names, own)), own[len(names) :]
    side = leaf_plan.select(
        *[F.col(name).alias(inner[name]) for name in names],
        F.struct("epochs", "cut", "cut_left", "cut_tokens").alias(held),
    )
    match = F.lit(True)
    for level in levels:
        match = match & (F.coalesce(level.node.cast("string"), F.lit(_NONE)) == F.col(inner[level.name]))
    joined = docs.join(side, match)
    of = {c: F.col(held)[c] for c in ("epochs", "cut")}
    last = _order_key(seed, of["epochs"]) <= of["cut"]
    times = of["epochs"] + F.when(F.coalesce(last, F.lit(False)), 1).otherwise(0)
    used = joined.where(word_count(F.col("text")) > 0).withColumn(uses, times).where(F.col(uses) > 0)
    copies = used.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(uses))))
    return copies.select(*[docs[c] for c in docs.columns])
