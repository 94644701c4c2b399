"""The tree of blocks over a partitioned graph, and the block graph of each level.

Level 0 are the blocks of the vertices. A level's quotient graph (which blocks
have edges between them) is partitioned along a search order into parents of a
few blocks each, so siblings are near each other in the graph; the parents are
the next level, up to one root.

    tree       level, block, parent (null at the root)
    quotients  level, src_block, dst_block
    members    id, block (level 0)
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.graph import Graph, vertex_rows
from meshwork.operators.layout import block_partition
from meshwork.operators.topology import block_adjacency
from meshwork.runtime import materialise

#: Children of a parent, and the share of them to which building fills one.
FANOUT, FILL = 8, 0.6


@dataclass(frozen=True)
class BlockIndex:
    tree: DataFrame
    quotients: DataFrame
    members: DataFrame
    fanout: int = FANOUT

    def blocks(self, level: int, parent: int | None = None) -> DataFrame:
        """(block) of a level, or the children of one parent on the level above."""
        rows = self.tree.where(F.col("level") == level)
        return (rows if parent is None else rows.where(F.col("parent") == parent)).select("block")

    def parent(self, level: int, block: int) -> int | None:
        row = self.tree.where((F.col("level") == level) & (F.col("block") == block)).first()
        return None if row is None else row["parent"]

    def neighbor_blocks(self, level: int, block: int) -> DataFrame:
        """(block) of those that the given one has edges to, ascending."""
        return self.quotients.where((F.col("level") == level) & (F.col("src_block") == block)).select(F.col("dst_block").alias("block")).orderBy("block")

    def block_adjacency(self, level: int) -> DataFrame:
        """(block, neighbors) of a level, with empty lists."""
        lists = self.quotients.where(F.col("level") == level).groupBy(F.col("src_block").alias("block")).agg(F.sort_array(F.collect_list("dst_block")).alias("l"))
        return self.blocks(level).join(lists, "block", "left").select("block", F.coalesce("l", F.array().cast("array<long>")).alias("neighbors"))

    def insert_edge(self, src_block: int, dst_block: int) -> "BlockIndex":
        """With an edge between two blocks of level 0, and between those above them that differ, both ways."""
        a, b, rows = src_block, dst_block, []
        for level in range(self.tree.agg(F.max("level")).first()[0] + 1):
            if a == b or a is None or b is None:
                break
            rows += [(level, a, b), (level, b, a)]
            a, b = self.parent(level, a), self.parent(level, b)
        if not rows:
            return self
        more = self.tree.sparkSession.createDataFrame(rows, "level int, src_block long, dst_block long")
        return replace(self, quotients=self.quotients.unionByName(more).distinct())

    def replace_block(self, old: int, new: list[int], moved: DataFrame, edges: DataFrame) -> "BlockIndex":
        """After a block was written anew as one or several: ``moved`` has the (id, block) of its vertices.

        The new blocks go below the old one's parent, whose children stay
        together; a parent that is then over ``fanout`` is split, which is done
        by forming the levels above anew. ``edges`` are those of the graph now.
        """
        members = materialise(self.members.join(moved.select("id"), "id", "left_anti").unionByName(moved.select("id", "block")), "members")
        spark = self.tree.sparkSession
        above = self.parent(0, old)
        level0 = block_adjacency(edges, members).select(F.lit(0).alias("level"), "src_block", "dst_block")
        children = self.blocks(0, above).count() if above is not None else 1
        if above is None or children - 1 + len(new) > self.fanout:
            return build(edges, members, self.fanout)
        fresh = spark.createDataFrame([(0, b, above) for b in new], "level int, block long, parent long")
        tree = self.tree.where(~((F.col("level") == 0) & (F.col("block") == old))).unionByName(fresh)
        quotients = self.quotients.where("level > 0").unionByName(level0)
        return replace(self, tree=materialise(tree, "tree"), quotients=materialise(quotients, "quotients"), members=members)


def build(edges: DataFrame, members: DataFrame, fanout: int = FANOUT, max_levels: int = 32) -> BlockIndex:
    """The index of a partition: ``members`` (id, block), ``edges`` (src, dst)."""
    cap = max(2, int(fanout * FILL))
    ids = materialise(members.select("block").distinct(), "blocks")
    quotient = materialise(block_adjacency(edges, members.select("id", "block")), "quotient")
    level, n, tree, quotients = 0, ids.count(), [], []
    while True:
        quotients.append(quotient.select(F.lit(level).alias("level"), "src_block", "dst_block"))
        if n <= 1 or level >= max_levels:
            tree.append(ids.select(F.lit(level).alias("level"), "block", F.lit(None).cast("long").alias("parent")))
            break
        graph = Graph(vertex_rows(ids.select(F.col("block").alias("id"))), quotient.select(F.col("src_block").alias("src"), F.col("dst_block").alias("dst")), True)
        parents = materialise(block_partition(graph, cap), "parents")
        tree.append(parents.select(F.lit(level).alias("level"), F.col("id").alias("block"), F.col("block").alias("parent")))
        quotient = materialise(block_adjacency(quotient.select(F.col("src_block").alias("src"), F.col("dst_block").alias("dst")), parents), "quotient")
        ids = materialise(parents.select("block").distinct(), "blocks")
        level, n = level + 1, ids.count()

    def union(tables):
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    return BlockIndex(union(tree), union(quotients), members.select("id", "block"), fanout)
