"""Contributions of tree models along their decision paths.

A stored forest or boosted ensemble is a table of nodes. A row walks each tree from the root; every
split on its way changes the expected score from that of the node to that of the child taken, and
the change belongs to the feature that was asked. Summed over splits and trees, the contributions
and the base (the scores of the roots) give the model's raw score exactly.

The trees are one value, sent to the rows' tasks: its size is the model's, whatever the data. A row
becomes one row per split on its paths, and sums are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nextcover.operators.quantiles import with_fitted

#: deepest tree that Spark ML grows
MOST_SPLITS = 30
#: numbers of the trees of one class of a one-vs-rest model
PER_CLASS = 1_000_000


def _stage_folder(model, path: str) -> str:
    """Where a stored pipeline keeps its last stage."""
    n = len(model.stages)
    return f"{path.rstrip('/')}/stages/{n - 1:0{len(str(n))}d}_{model.stages[-1].uid}"


def depth(model) -> int:
    """Splits on the longest path of a fitted pipeline's trees."""
    last = model.stages[-1]
    return max(tree.depth for part in getattr(last, "models", [last]) for tree in part.trees)


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    node = spark.read.parquet(f"{folder}/data").select(F.col("treeID").cast("long").alias("tree"), "nodeData.*")
    return node.select(
        "tree", F.col("id").alias("node"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature"), F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        "prediction", "impurityStats")


def forest_nodes(model, path: str) -> DataFrame:
    """Nodes of a stored random forest: (tree, node, left, right, feature, threshold, class, value),
    a row per class, where the value is the class's share of the node's rows."""
    nodes = _nodes(SparkSession.active(), _stage_folder(model, path))
    total = F.aggregate("impurityStats", F.lit(0.0), lambda a, x: a + x)
    return nodes.select(
        "tree", "node", "left", "right", "feature", "threshold",
        F.posexplode(F.transform("impurityStats", lambda x: x / total)).alias("class", "value"))


def boosted_nodes(model, path: str) -> DataFrame:
    """Nodes of a stored one-vs-rest model of boosted trees, in the same form: the value is the
    node's prediction times its tree's weight, the class that of the tree's model."""
    spark, folder = SparkSession.active(), _stage_folder(model, path)
    parts = None
    for i in range(len(model.stages[-1].models)):
        nodes = _nodes(spark, f"{folder}/model_{i}")
        about = spark.read.parquet(f"{folder}/model_{i}/treesMetadata")
        weights = about.select(F.col(about.columns[0]).cast("long").alias("tree"), F.col(about.columns[2]).alias("weight"))
        part = nodes.join(F.broadcast(weights), "tree").select(  # a row per tree of the model
            (F.col("tree") + i * PER_CLASS).alias("tree"), "node", "left", "right", "feature", "threshold",
            F.lit(i).alias("class"), (F.col("prediction") * F.col("weight")).alias("value"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def base_scores(nodes: DataFrame) -> DataFrame:
    """(class, base): what the model gives before any split."""
    return nodes.filter("node = 0").groupBy("class").agg(F.sum("value").alias("base"))


def split_changes(nodes: DataFrame) -> DataFrame:
    """(tree, node, class, feature, change): what reaching a node by its parent's split changes."""
    children = nodes.filter("left >= 0").select(
        "tree", F.explode(F.array("left", "right")).alias("node"), "class", "feature", F.col("value").alias("before"))
    own = nodes.select("tree", "node", "class", "value")
    return children.join(own, ["tree", "node", "class"]).select(
        "tree", "node", "class", "feature", (F.col("value") - F.col("before")).alias("change"))


def visited(df: DataFrame, key: list[str], nodes: DataFrame, features: list[str], depth: int = MOST_SPLITS) -> DataFrame:
    """(key, tree, node): the nodes below the root that each row passes. A missing value goes right,
    as the models do with it."""
    shape = nodes.select("tree", F.struct("node", "left", "right", "feature", "threshold").alias("n")).distinct()
    trees = shape.groupBy("tree").agg(F.sort_array(F.collect_list("n")).alias("nodes"))
    whole = trees.agg(F.collect_list(F.struct("tree", "nodes")).alias("trees"))
    values = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features])

    def path(tree: Column) -> Column:
        def step(so_far: Column, _: Column) -> Column:
            at = F.get(tree["nodes"], F.element_at(so_far, -1))
            child = F.when(F.get("_x", at["feature"]) <= at["threshold"], at["left"]).otherwise(at["right"])
            return F.when(at["left"] < 0, so_far).otherwise(F.concat(so_far, F.array(child)))

        start = F.array(F.lit(0))
        nodes_ = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), start, step)
        return F.transform(F.slice(nodes_, 2, depth), lambda n: F.struct(tree["tree"].alias("tree"), n.alias("node")))

    rows = with_fitted(df.select(*key, values.alias("_x")), whole)
    return rows.select(*key, F.explode(F.flatten(F.transform(F.col("_fit.trees"), path))).alias("v")).select(*key, "v.tree", "v.node")


def tree_contributions(df: DataFrame, key: list[str], nodes: DataFrame, features: list[str],
                       depth: int = MOST_SPLITS) -> DataFrame:
    """(key, class, feature, contribution) for the features on the row's paths. ``features`` are the
    model's in its order, ``nodes`` a table as of :func:`forest_nodes`."""
    names = F.array(*map(F.lit, features))
    changes = split_changes(nodes)
    passed = visited(df, key, nodes, features, depth)
    return (passed.join(changes, ["tree", "node"]).groupBy(*key, "class", "feature").agg(F.sum("change").alias("contribution"))
            .withColumn("feature", F.get(names, "feature")))
