"""Why a forest says what it says: contributions of features to one verdict, by walking its trees.

A forest's probability of a class is the mean, over its trees, of the class's share in the leaf that a row comes to.  On
the way down a tree the share changes at every split; the change goes to the feature that is tested there.  The shares at
the roots (the base value) and all changes add up to the probability, but for rounding.

The trees are a small table, at most ``trees * 2 ** (depth + 1)`` nodes, that is a constant of the expression; a row
walks it in the JVM.
"""

from __future__ import annotations

import json
from typing import TypedDict

from pyspark.ml import PipelineModel
from pyspark.sql import Column
from pyspark.sql import functions as F

_FOREST = "array<array<struct<f:int,t:double,l:int,r:int,p:array<double>>>>"


class Node(TypedDict):
    """A node of a tree: feature and threshold (left if the value is at most that), places of its children, class shares;
    a leaf has the feature -1."""

    f: int
    t: float
    l: int  # noqa: E741
    r: int
    p: list[float]


Forest = list[list[Node]]


def forest_of(model: PipelineModel, n_classes: int) -> Forest:
    """The nodes of a fitted forest, each tree from its root at place 0."""
    out: Forest = []
    for tree in model.stages[-1].trees:
        nodes: Forest = [[]]
        waiting = [(tree._java_obj.rootNode(), -1, "l")]
        while waiting:
            node, parent, side = waiting.pop()
            stats = [float(x) for x in node.impurityStats().stats()]
            total = sum(stats) or 1.0
            nodes[0].append({"f": -1, "t": 0.0, "l": -1, "r": -1, "p": [x / total for x in stats] + [0.0] * (n_classes - len(stats))})
            at = len(nodes[0]) - 1
            if parent >= 0:
                nodes[0][parent][side] = at
            if node.subtreeDepth() > 0:
                nodes[0][at] |= {"f": node.split().featureIndex(), "t": node.split().threshold()}
                waiting += [(node.rightChild(), at, "r"), (node.leftChild(), at, "l")]
        # a tree whose draw of the rows was empty knows no shares and has no vote
        if sum(nodes[0][0]["p"]):
            out += nodes
    return out


def given(columns: list[str], *trees: tuple) -> Forest:
    """A forest of trees written as (feature, threshold, shares, left, right), where a leaf is a list of shares."""

    def put(tree: tuple | list, nodes: list[Node]) -> int:
        at = len(nodes)
        nodes.append({"f": -1, "t": 0.0, "l": -1, "r": -1, "p": tree if isinstance(tree, list) else tree[2]})
        if not isinstance(tree, list):
            nodes[at] |= {"f": columns.index(tree[0]), "t": tree[1]}
            nodes[at]["l"] = put(tree[3], nodes)
            nodes[at]["r"] = put(tree[4], nodes)
        return at

    out: Forest = [[] for _ in trees]
    for tree, nodes in zip(trees, out, strict=True):
        put(tree, nodes)
    return out


def _depth(tree: list[Node], at: int = 0) -> int:
    return 0 if tree[at]["f"] < 0 else 1 + max(_depth(tree, tree[at]["l"]), _depth(tree, tree[at]["r"]))


def shares(x: Column, forest: Forest) -> Column:
    """Class probabilities of a row of features: the mean of the shares in the leaves."""
    trees, steps = F.from_json(F.lit(json.dumps(forest)), _FOREST), max(map(_depth, forest))
    leaf = F.transform(trees, lambda tree: F.get(tree, _walk(tree, x, steps, lambda s, node, to: to, F.lit(0), lambda s: s))["p"])
    n = len(forest[0][0]["p"])
    return F.transform(F.aggregate(leaf, F.array(*[F.lit(0.0)] * n), lambda a, p: F.zip_with(a, p, lambda u, v: u + v)), lambda u: u / len(forest))


def _walk(tree: Column, x: Column, steps: int, move, start: Column, at) -> Column:
    """Folds ``move`` over the splits that a row passes; ``at`` tells the node from the state."""

    def step(s: Column, _: Column) -> Column:
        node = F.get(tree, at(s))
        to = F.when(F.get(x, node["f"]) <= node["t"], node["l"]).otherwise(node["r"])
        return F.when(node["f"] < 0, s).otherwise(move(s, node, to))

    return F.aggregate(F.sequence(F.lit(1), F.lit(max(steps, 1))), start, step)


def contributions(x: Column, of: Column, forest: Forest, n_features: int) -> Column:
    """struct(base, contributions by feature) for class ``of`` (from 0): base + sum(contributions) is its probability."""
    trees, steps = F.from_json(F.lit(json.dumps(forest)), _FOREST), max(map(_depth, forest))
    kind = "struct<at:int,moves:array<struct<f:int,by:double>>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<f:int,by:double>>").alias("moves")).cast(kind)

    def path(tree: Column) -> Column:
        def move(s: Column, node: Column, to: Column) -> Column:
            change = F.get(F.get(tree, to)["p"], of) - F.get(node["p"], of)
            return F.struct(to.alias("at"), F.concat(s["moves"], F.array(F.struct(node["f"].alias("f"), change.alias("by")))).alias("moves")).cast(kind)

        return _walk(tree, x, steps, move, start, lambda s: s["at"])["moves"]

    moves = F.flatten(F.transform(trees, path))
    # `by` of all moves at once: the moves are computed once, in an array of one element
    summed = lambda own: F.transform(F.sequence(F.lit(0), F.lit(n_features - 1)), lambda i: F.aggregate(F.filter(own, lambda m: m["f"] == i), F.lit(0.0), lambda a, m: a + m["by"]) / len(forest))
    base = F.aggregate(trees, F.lit(0.0), lambda a, tree: a + F.get(F.get(tree, F.lit(0))["p"], of)) / len(forest)
    return F.struct(base.alias("base"), F.get(F.transform(F.array(moves), summed), F.lit(0)).alias("contributions"))
