"""Merkle manifest of a dataset: a tree a group, a tree over the groups, and a proof for each row, by exchange of subtrees."""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace

FAN = 3
NODE = "no_name boolean, name string, i bigint, n bigint, h string"
PATH = "no_name boolean, name string, i bigint, places array<int>, others array<array<string>>, subroot string, root string"
NAME = ["no_name", "name"]


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    s = value.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*(field(c) for c in fields)).cast("binary"), 256)


def numbered(df: DataFrame, group: list[str], order: list[str], ws: Workspace, name: str, small: int = 50_000) -> DataFrame:
    """df with i, a row's place in its group from 0, and n, the group's size. No task holds a whole group.

    Rows are sorted over all partitions and written; what the earlier partitions hold of a group comes from counts by
    (partition, group), of which there is a row a partition and group.
    """
    ordered = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    ordered = ordered.withColumn("part", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id())
    ordered = ws.save(ordered, name)
    held = ordered.groupBy("part", *group).agg(F.count("*").alias("held"), F.min("pos").alias("first"))
    held = ws.save(held, f"{name}_held")
    key = ", ".join(group) or "1"
    before = f"coalesce(sum(held) over (partition by {key} order by part rows between unbounded preceding and 1 preceding), 0)"
    held = held.selectExpr("part", *group, f"first - {before} as start", f"sum(held) over (partition by {key}) as n")
    held = F.broadcast(held) if ws.spark.read.parquet(ws.path(f"{name}_held")).limit(small + 1).count() <= small else held
    return ordered.join(held, ["part", *group]).withColumn("i", F.col("pos") - F.col("start")).drop("part", "pos", "start")


def reduced(level: list[str]) -> list[str]:
    return [digest(level[k : k + FAN]) for k in range(0, len(level), FAN)]


def steps(n: int, height: int) -> int:
    """Levels that a subtree of `height` levels reduces where its tree has n nodes."""
    k = 0
    while n > 1 and k < height:
        n, k = -(-n // FAN), k + 1
    return k


def levels_of(h: list[str], n: int, height: int) -> list[list[str]]:
    """A superblock's nodes, level by level up to its one outer node; n nodes are in the whole tree."""
    out = [h]
    for _ in range(steps(n, height)):
        out.append(reduced(out[-1]))
    return out


def place(levels: list[list[str]], j: int) -> tuple[list[int], list[list[str]]]:
    """Where node j stands in its run at each level, and the run's others."""
    places, others = [], []
    for level in levels[:-1]:
        start = j - j % FAN
        places.append(j % FAN)
        others.append([x for k, x in enumerate(level[start : start + FAN]) if start + k != j])
        j //= FAN
    return places, others


def fold(h: str, places: list[int], others: list[list[str]]) -> str:
    for p, rest in zip(places, others, strict=True):
        h = digest([*rest[:p], h, *rest[p:]])
    return h


class Forest:
    """Trees, one a name, over rows (no_name, name, i, n, h): i is a node's place among its tree's n.

    A superblock is FAN**height consecutive nodes of a tree. A round reduces each superblock in one task to its outer node;
    outer nodes go on likewise until each tree has its root. A tree of N leaves takes log(N)/(height log FAN) rounds.
    """

    def __init__(self, nodes: DataFrame, ws: Workspace, name: str, height: int):
        self.ws, self.name, self.height, self.size = ws, name, height, FAN**height
        self.stages = [nodes]
        while self.stages[-1].filter("n > 1").limit(1).count() or len(self.stages) == 1:
            self.stages.append(ws.save(self._round(self.stages[-1]), f"{name}_{len(self.stages)}"))
            if not self.stages[-1].limit(1).count():
                break
        # A tree that is reduced to one node at a stage is in no later one.
        self.roots = self._union([s.filter("n = 1").select(*NAME, "h") for s in self.stages[1:]])

    @staticmethod
    def _union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _blocks(self, nodes: DataFrame) -> DataFrame:
        return nodes.withColumn("block", F.floor(F.col("i") / F.lit(self.size)).cast("bigint"))

    def _round(self, nodes: DataFrame) -> DataFrame:
        height, size = self.height, self.size

        def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("i")
            n = int(pdf["n"].iloc[0])
            top = levels_of(pdf["h"].tolist(), n, height)[-1]
            return pd.DataFrame({"no_name": pdf["no_name"].iloc[0], "name": pdf["name"].iloc[0], "i": [int(pdf["block"].iloc[0])], "n": -(-n // size), "h": top})

        first = nodes is self.stages[0]
        todo = self._blocks(nodes if first else nodes.filter("n > 1")).select(*NAME, "block", "i", "n", "h")
        return todo.groupBy(*NAME, "block").applyInPandas(reduce, NODE)

    def outer_paths(self, ends: DataFrame) -> DataFrame:
        """The way from each outer node of the first round to the end of ends: rows like PATH, of which ends has one a tree,
        for its root."""
        height, path = self.height, None

        def extend(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
            nodes, end = nodes.sort_values("i"), outer.iloc[0]
            levels = levels_of(nodes["h"].tolist(), int(nodes["n"].iloc[0]), height)
            rows = []
            for j, i in enumerate(nodes["i"]):
                places, others = place(levels, j)
                rows.append((end["no_name"], end["name"], i, [*places, *end["places"]], [*others, *(list(o) for o in end["others"])], end["subroot"], end["root"]))
            return pd.DataFrame(rows, columns=["no_name", "name", "i", "places", "others", "subroot", "root"])

        for k in range(len(self.stages) - 1, 0, -1):
            stage = self.stages[k]
            here = stage.filter("n = 1").select(*NAME, "i").join(ends.drop("i"), NAME)
            if path is not None:
                inner, outer = self._blocks(stage.filter("n > 1")), path.withColumnRenamed("i", "block")
                here = here.unionByName(inner.groupBy(*NAME, "block").cogroup(outer.groupBy(*NAME, "block")).applyInPandas(extend, PATH))
            path = self.ws.save(here, f"{self.name}_path_{k}")
        return path


def manifest(rows: DataFrame, group_col: str, order_col: str, leaf: Column, changed: Column, height: int = 8, ws: Workspace | None = None) -> DataFrame:
    """(key, leaf, subroot, root, proof, n_proof, folded_root, verified): a row for each row of rows, key being order_col.

    leaf is the digest of a row, changed that of the row as it is found when it is verified. The leaves of a group, by rising
    order_col, are reduced in runs of three until one node is left, its subroot; subroots, by group, likewise give the root.
    proof is the digest of the siblings on the way up, n_proof their number; folded_root is what changed and the siblings
    give, verified whether that is the root.

    Subtrees are exchanged: superblocks of 3**height leaves are reduced in a task each, the outer nodes likewise, then the
    ways of outer nodes are handed down; last, leaves and the outer nodes that they need are cogrouped by superblock, where
    the local reduction, the proofs and the folding are done together. A hot group is many superblocks, so none waits for it.

    A null group comes first and is told apart from ''. Null orders come first; rows equal in order_col go by leaf, so
    repeated rows have a leaf each. A lone leaf is its own subroot. An empty table gives an empty result. Other columns,
    whatever their names, have no influence.
    """
    ws = ws or Workspace(rows.sparkSession, "merkle")
    group = F.col(f"`{group_col}`").cast("string")
    leaves = rows.select(group.isNull().alias("no_name"), F.coalesce(group, F.lit("")).alias("name"), F.col(f"`{order_col}`").alias("key"), leaf.alias("h"), changed.alias("changed"))
    leaves = ws.save(leaves, "digests").withColumn("turn", F.monotonically_increasing_id())  # the written table's order stands
    leaves = ws.save(numbered(leaves, NAME, ["key", "h", "turn"], ws, "ordered").drop("turn"), "leaves")

    trees = Forest(leaves, ws, "tree", height)
    subroots = ws.save(trees.roots, "subroots").withColumn("later", ~F.col("no_name"))  # null first
    tops = numbered(subroots, [], ["later", "name"], ws, "tops").drop("later").withColumnsRenamed({"no_name": "own", "name": "own_name"})
    tops = ws.save(tops.withColumns({"no_name": F.lit(False), "name": F.lit("")}), "top_leaves")
    crown = Forest(tops, ws, "crown", height)
    none = {"places": F.array().cast("array<int>"), "others": F.array().cast("array<array<string>>")}
    end = crown.roots.select(*NAME, F.lit(0).cast("bigint").alias("i"), *(c.alias(k) for k, c in none.items()), F.lit("").alias("subroot"), F.col("h").alias("root"))
    tops_out = crown.outer_paths(end).withColumnRenamed("i", "block")

    def finish_tops(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes, top = nodes.sort_values("i"), outer.iloc[0]
        levels, out = levels_of(nodes["h"].tolist(), int(nodes["n"].iloc[0]), height), []
        for j, r in enumerate(nodes.itertuples()):
            places, others = place(levels, j)
            out.append((r.own, r.own_name, 0, [*places, *top["places"]], [*others, *(list(o) for o in top["others"])], r.h, top["root"]))
        return pd.DataFrame(out, columns=["no_name", "name", "i", "places", "others", "subroot", "root"])

    ends = ws.save(crown._blocks(tops).groupBy(*NAME, "block").cogroup(tops_out.groupBy(*NAME, "block")).applyInPandas(finish_tops, PATH), "ends")
    outer = trees.outer_paths(ends).withColumnRenamed("i", "block")

    kind = leaves.schema["key"].dataType.simpleString()

    def finish(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes, top = nodes.sort_values("i"), outer.iloc[0]
        out_places, out_others = [int(p) for p in top["places"]], [list(o) for o in top["others"]]
        tail, n_tail = "".join(x for o in out_others for x in o), sum(map(len, out_others))
        levels = levels_of(nodes["h"].tolist(), int(nodes["n"].iloc[0]), height)
        proofs, sizes, folded = [], [], []
        for j, h in enumerate(nodes["changed"]):
            places, others = place(levels, j)
            proofs.append(digest([x for o in others for x in o] + [tail]))
            sizes.append(sum(map(len, others)) + n_tail)
            folded.append(fold(h, places + out_places, others + out_others))
        out = nodes[["key", "h"]].rename(columns={"h": "leaf"})
        out = out.assign(subroot=top["subroot"], root=top["root"], proof=proofs, n_proof=sizes, folded_root=folded)
        return out.assign(verified=out["folded_root"] == top["root"])

    ddl = "key string, leaf string, subroot string, root string, proof string, n_proof int, folded_root string, verified boolean"
    leaves = leaves.withColumn("key", F.col("key").cast("string"))  # pandas would make numbers with nulls floats
    out = trees._blocks(leaves).groupBy(*NAME, "block").cogroup(outer.groupBy(*NAME, "block")).applyInPandas(finish, ddl)
    return out.withColumn("key", F.col("key").cast(kind))
