"""Connected components by alternating large and small stars, in rounds of DataFrame joins.

Each round writes its links to the shared folder, so lineage stays short and a lost executor costs one round at most. Minima are
aggregated before they meet. Hubs, the nodes with a HUBS-th of all links or more, of which there are at most 2 * HUBS, are broadcast, so their links meet the minimum
where they lie; only other nodes' links are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, written

ROUNDS = 60
HUBS = 64


def meet_least(rows: DataFrame, least: DataFrame, key: str, total: int) -> DataFrame:
    """`rows` with the minimum m of their key; `least` is (key, m, n) with the number of rows of each key, `total` rows in all."""
    hubs = least.where(F.col("n") >= max(HUBS, total // HUBS)).select(key, F.col("m").alias("hub_m"))
    both = rows.join(F.broadcast(hubs), key, "left")
    at_hubs = both.where("hub_m is not null").select(*rows.columns, F.col("hub_m").alias("m"))
    return at_hubs.union(both.where("hub_m is null").select(*rows.columns).join(least.select(key, "m"), key).select(*rows.columns, "m"))


def large_star(links: DataFrame, total: int) -> DataFrame:
    """Each larger neighbour of a node is linked to the node's smallest neighbour (itself included)."""
    both = links.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("x")).select("x.u", "x.v")
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return meet_least(both.where("v > u"), least, "u", 2 * total).select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b")


def small_star(links: DataFrame, total: int) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them. Links come as a < b."""
    least = links.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n"))
    return meet_least(links, least, "b", total).select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) for each id that a link names; root is the smallest id reachable. Repeated, reversed and self links are fine; null ends are ignored."""
    links = written(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(a).isNotNull().alias("x"), F.col(b).isNotNull().alias("y")).where("x and y and a <> b").select("a", "b").distinct(), "links")
    state = lambda rows: tuple(rows.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    last = state(links)
    for _ in range(ROUNDS):
        if not last[0]:
            break
        links, old = written(small_star(large_star(links, last[0]), last[0]), "links"), links
        removed(old)
        now = state(links)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return links.select(F.col("b").alias("id"), F.col("a").alias("root")).union(links.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct())
