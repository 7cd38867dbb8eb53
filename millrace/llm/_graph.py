"""Connected components on shared tables: alternating stars, never on the driver."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared
from ._shared import materialize, release, spread_join


#: Edges (16 bytes each) that one task joins, whatever the number of rounds they would take.
TASK_EDGES = 100_000


class Forest:
    """Union-find over ids; the root of a set is its smallest id."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (p := self.parent.get(root, root)) != root:
            root = p
        while (p := self.parent.get(x, x)) != root:
            self.parent[x] = root
            x = p
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True

    def stars(self) -> Iterable[tuple[int, int]]:
        return [(x, r) for x in list(self.parent) if (r := self.find(x)) != x]


def _local_stars(batches):
    """Edges of one task shortened to stars: as many as joined ids at most."""
    import numpy as np
    import pyarrow as pa

    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            forest.join(a, b)
    stars = np.array(forest.stars(), np.int64).reshape(-1, 2)
    yield pa.RecordBatch.from_arrays([pa.array(stars[:, 0]), pa.array(stars[:, 1])], ["a", "b"])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) of every id that an edge (a, b) touches; component is the smallest id.

    At most TASK_EDGES edges are joined in one task. Else, each round: large star and small star, after joining what each task holds.
    The least neighbour of an id is a grouped minimum, pre-aggregated in the map
    tasks; the edges of a hub are dealt over several tasks when they meet it.
    """
    now = materialize(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").mapInArrow(_local_stars, "a long, b long"), "edges")
    for _ in range(most_rounds):
        n_edges = now.count()
        if n_edges <= TASK_EDGES:  # one task joins them all
            whole = materialize(now.coalesce(1).mapInArrow(_local_stars, "a long, b long"), "edges")
            release(now)
            now = whole
            break
        meet = spread_join if n_edges > _shared.SMALL_ROWS else (lambda rows, table, keys, *_: rows.join(F.broadcast(table.drop("n")), keys, "left"))  # as many rows as ids at most
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = meet(both.filter("b > a"), low, ["a"], F.col("b"), "n", 2 * n_edges).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = meet(down, least, ["a"], F.col("b"), "n", n_edges).select(F.col("b").alias("x"), "m", "a")
        stars = small.select(F.col("x").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).filter("a <> b")
        after = materialize(stars.mapInArrow(_local_stars, "a long, b long"), "edges")
        # settled: every id points at one root, and no root points on
        roots = after.select(F.col("b").alias("a")).distinct()
        open_ = after.groupBy("a").agg(F.min("b").alias("l"), F.max("b").alias("h")).filter("l < h").select("a").union(after.join(roots, "a", "left_semi").select("a")).limit(1).count()
        release(now)
        now = after
        if not open_:
            break
    else:
        raise RuntimeError("components did not settle")
    now = now.distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
