"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .io import released, saved

#: a node with more than a HOT-th part of all neighbours is hot: there are fewer than HOT of them
HOT = 500


def _star(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """One step: each node links its larger (large) or smaller (small) neighbours to the least of its neighbourhood.

    The neighbours of a hot node meet its minimum by a broadcast of fewer than HOT rows, so they stay where they are; those of the others by a shuffle.
    """
    around = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    if large:
        around = around.unionByName(edges.select(F.col("dst").alias("u"), F.col("src").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("m", "u").alias("m"), "n")
    hot = F.broadcast(least.where(F.col("n") > max(1000, (1 + large) * rows / HOT)).select("u", "m"))
    joined = around.join(hot, "u").unionByName(around.join(hot, "u", "left_anti").join(least.select("u", "m"), "u"))
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("src"), F.col("m").alias("dst"))
    else:
        moved = joined.select(F.col("v").alias("src"), F.col("m").alias("dst")).unionByName(
            least.select(F.col("u").alias("src"), F.col("m").alias("dst"))
        )
    return moved.where("src <> dst").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(src long, dst long) undirected links -> (id, component): the smallest id reachable, for every id that has a link.

    Nulls and self-links are ignored; repeated links count once. Each star's edges go to the shared folder, so the plan
    stays short and lost executors cost one star. The number of rounds grows with the logarithm of the longest chain.
    """
    now = saved(
        edges.where("src is not null and dst is not null and src <> dst")
        .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        .distinct()
    )
    mark, rows = None, now.count()
    for _ in range(most_rounds):
        if not rows:
            break
        # each star reads a table: a star names its edges some ten times, so a plan of both has a hundred of the first one's inputs
        before, large = now, saved(_star(now, True, rows))
        now = saved(_star(large, False, rows))
        released(before, large)
        # done when no node has both ends; the sum over the roots shows whether a round has moved anything
        ends = now.select(F.explode(F.array(F.struct(F.col("src").alias("v"), F.lit(1).alias("end")), F.struct(F.col("dst").alias("v"), F.lit(2).alias("end")))).alias("x")).select("x.*")
        nodes = ends.groupBy("v").agg(F.bit_or("end").alias("ends"), F.count_if(F.col("end") == 2).alias("below"))
        seen = nodes.agg(F.count_if(F.col("ends") == 3), F.sum("below"), F.sum(F.col("v").cast("decimal(38,0)") * F.col("below"))).first()
        if not seen[0] or tuple(seen) == mark:
            break
        mark, rows = tuple(seen), seen[1]
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("dst").alias("id"), F.col("dst").alias("component")).distinct()
    return now.select(F.col("src").alias("id"), F.col("dst").alias("component")).unionByName(roots)
