"""Operators over link graphs and functional graphs, as loops over DataFrames with their lineage cut.

Edges carry `seq`, the order in which they were seen; ties are broken by it, never by arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.components import Cut, checkpointed

DAMPING, MAX_ROUNDS, SETTLED = 0.85, 200, 1e-10
#: Rounds between two cuts of the lineage in power iteration.
CUT_EVERY = 5


def page_rank(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, max_rounds: int = MAX_ROUNDS, settled: float = SETTLED, cut: Cut = checkpointed) -> DataFrame:
    """nodes: node; edges: src, dst (parallel ones count, loops don't).  node, score; the scores sum to 1.

    A node without edges out gives its score to all.  Ends of edges that aren't among the nodes are nodes too.
    """
    links = edges.where("src <> dst").select("src", "dst")
    every = cut(nodes.select("node").unionByName(links.select(F.col("src").alias("node"))).unionByName(links.select(F.col("dst").alias("node"))).where("node is not null").distinct())
    n = every.count()
    if not n:
        return every.select("node", F.lit(0.0).alias("score")).limit(0)
    out = links.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    # Parallel edges become one with a weight, so a hub's targets are as many rows as it has distinct targets.
    weighted = cut(links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("k")).join(out, "src").select("src", "dst", (F.col("k") / F.col("out")).alias("w")))
    dangling = cut(every.join(out, every.node == out.src, "left_anti"))
    ranks = every.select("node", F.lit(1.0 / n).alias("score"))
    for turn in range(max_rounds):
        lost = ranks.join(dangling, "node", "left_semi").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("lost"))
        given = ranks.join(weighted, ranks.node == weighted.src).groupBy("dst").agg(F.sum(F.col("score") * F.col("w")).alias("given"))
        new = ranks.join(given, ranks.node == given.dst, "left").crossJoin(F.broadcast(lost)).select("node", F.col("score").alias("old"), ((1 - damping) / n + damping * (F.coalesce("given", F.lit(0.0)) + F.col("lost") / n)).alias("score"))
        if turn % CUT_EVERY == CUT_EVERY - 1 or turn == max_rounds - 1:
            new = cut(new)
            moved = new.agg(F.max(F.abs(F.col("score") - F.col("old")))).first()[0]
            ranks = new.select("node", "score")
            if moved < settled:
                break
        else:
            ranks = new.select("node", "score")
    return ranks


def discovery(edges: DataFrame, seeds: DataFrame, max_hops: int | None = None, cut: Cut = checkpointed) -> DataFrame:
    """edges: src, dst, seq; seeds: node, place (their order).  node, hops, parent, place of all that is reached.

    Breadth first: of several ways of the same length the one through the earlier reached source, then the
    earlier edge.  `place` is a node's place in the order of reaching within its level.
    """
    frontier = cut(seeds.select("node", F.lit(0).alias("hops"), F.lit(None).cast("string").alias("parent"), F.col("place").cast("bigint")))
    seen = frontier
    hops = 0
    while max_hops is None or hops < max_hops:
        hops += 1
        step = frontier.select(F.col("node").alias("src"), "place").join(edges, "src")
        best = step.groupBy("dst").agg(F.min(F.struct("place", "seq", "src")).alias("via")).join(seen.select(F.col("node").alias("dst")), "dst", "left_anti")
        # (place, seq) orders the level; a running number isn't needed, only an order that the next level can compare.
        ordered = best.select(F.col("dst").alias("node"), F.lit(hops).alias("hops"), F.col("via.src").alias("parent"), "via.place", "via.seq").orderBy("place", "seq", "node").withColumn("place", F.monotonically_increasing_id()).drop("seq")
        frontier = cut(ordered)
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier)) if hops % CUT_EVERY == 0 else seen.unionByName(frontier)
    return seen


def paths(found: DataFrame, targets: DataFrame, max_hops: int = 64) -> DataFrame:
    """node and path (from the seed on) for the targets, by following parents."""
    walk = targets.select("node").join(found.select("node", "parent"), "node").select("node", F.array("node").alias("path"), F.col("parent").alias("at"))
    done = walk.where("at is null")
    open_ = walk.where("at is not null")
    step = found.select(F.col("node").alias("at"), F.col("parent").alias("up"))
    for _ in range(max_hops):
        if open_.isEmpty():
            break
        grown = open_.join(step, "at").select("node", F.concat(F.array("at"), "path").alias("path"), F.col("up").alias("at"))
        done = done.unionByName(grown.where("at is null"))
        open_ = grown.where("at is not null").checkpoint()
    return done.select("node", "path")


def path_state(edges: DataFrame, nodes: DataFrame, seed: str | None, target: str, max_hops: int) -> DataFrame:
    """One row: state (unavailable, seed_unobserved, found, limit_reached, unreachable_in_observed_graph), hops, path."""
    spark = edges.sparkSession
    schema = "state string, hops int, path array<string>"
    if seed is None:
        return spark.createDataFrame([("unavailable", None, None)], schema)
    if nodes.where(F.col("node") == seed).isEmpty():
        return spark.createDataFrame([("seed_unobserved", None, None)], schema)
    found = discovery(edges, spark.createDataFrame([(seed, 0)], "node string, place bigint"), max_hops)
    hit = found.where(F.col("node") == target)
    if not hit.isEmpty():
        return paths(found, hit.select("node")).select(F.lit("found").alias("state"), (F.size("path") - 1).alias("hops"), "path")
    at_edge = found.where(F.col("hops") == max_hops).select(F.col("node").alias("src"))
    more = edges.join(at_edge, "src").join(found.select(F.col("node").alias("dst")), "dst", "left_anti")
    return spark.createDataFrame([("unreachable_in_observed_graph" if more.isEmpty() else "limit_reached", None, None)], schema)


def chains(edges: DataFrame, cap: int, cut: Cut = checkpointed) -> DataFrame:
    """edges: src, dst, one for each src.  src, path, state: `end` (the last of the path leads nowhere), `loop` (it leads back
    into the path) or `capped` (more than cap steps)."""
    step = edges.where("src is not null and dst is not null").groupBy("src").agg(F.min("dst").alias("dst")).select(F.col("src").alias("at"), F.col("dst").alias("to"))
    walk = step.select(F.col("at").alias("src"), F.array("at", "to").alias("path"))
    walk = walk.select("src", "path", F.when(F.col("path")[0] == F.col("path")[1], "loop").alias("state"))
    done = walk.where("state is not null")
    open_ = walk.where("state is null")
    for turn in range(1, cap):
        nexts = open_.join(step, F.element_at("path", -1) == step.at, "left")
        grown = nexts.select("src", F.when(F.col("to").isNull(), F.col("path")).otherwise(F.concat("path", F.array("to"))).alias("path"), F.when(F.col("to").isNull(), "end").when(F.array_contains("path", F.col("to")), "loop").alias("state"))
        done = done.unionByName(grown.where("state is not null"))
        open_ = grown.where("state is null")
        if turn % 4 == 0:
            done, open_ = cut(done), cut(open_)
            if open_.isEmpty():
                return done
    last = open_.join(step, F.element_at("path", -1) == step.at, "left").select("src", "path", F.when(F.col("to").isNull(), "end").when(F.array_contains("path", F.col("to")), "loop").otherwise("capped").alias("state"))
    return done.unionByName(last)


def loops(edges: DataFrame, cut: Cut = checkpointed) -> DataFrame:
    """edges: src, dst, one for each src.  node and loop (its least node) of each node on a cycle, by pointer doubling."""
    step = cut(edges.where("src is not null and dst is not null").groupBy("src").agg(F.min("dst").alias("dst")))
    n = step.count()
    jump, reach = step.select("src", "dst", F.least("src", "dst").alias("low")), 1
    while reach < n:  # after it, dst is at least n steps on: on a cycle, if at all
        ahead = jump.select(F.col("src").alias("dst"), F.col("dst").alias("far"), F.col("low").alias("low2"))
        jump = cut(jump.join(ahead, "dst").select("src", F.col("far").alias("dst"), F.least("low", "low2").alias("low")))
        reach *= 2
        if jump.isEmpty():
            break
    on = jump.select(F.col("dst").alias("src")).distinct()
    # All on cycles now: the image of the doubled map. Its own doubled minimum is the cycle's least node.
    around = jump.join(on, "src", "left_semi").select(F.col("src").alias("node"), F.col("low").alias("loop"))
    return around.distinct()


def series(edges: DataFrame, cap: int = 64) -> DataFrame:
    """head, path of each chain that begins at a node nothing leads to."""
    heads = edges.select("src").join(edges.select(F.col("dst").alias("src")), "src", "left_anti").distinct()
    return chains(edges, cap).join(heads, "src", "left_semi").select(F.col("src").alias("head"), F.when(F.col("state") == "loop", F.slice("path", 1, F.size("path") - 1)).otherwise(F.col("path")).alias("path"), "state")


def link_totals(links: DataFrame, key: str = "destination") -> DataFrame:
    """Links and distinct sources of each destination."""
    return links.groupBy(key).agg(F.count(F.lit(1)).alias("inlinks"), F.countDistinct("source").alias("unique_inlinks"))


def united_links(static: DataFrame, rendered: DataFrame) -> DataFrame:
    """All static links, and the last of the rendered ones between two pages that no static one joins."""
    last = Window.partitionBy("source", "destination").orderBy(F.col("seq").desc())
    extra = rendered.join(static.select("source", "destination").distinct(), ["source", "destination"], "left_anti").withColumn("k", F.row_number().over(last)).where("k = 1").drop("k")
    return static.withColumn("representation", F.lit("static")).unionByName(extra.withColumn("representation", F.lit("rendered")))


#: Places of links that every page shares.
BOILERPLATE = ("nav", "header", "sidebar", "footer")


def composition(links: DataFrame) -> DataFrame:
    """destination, by_position (distinct sources by place), unclassified (sources only without a place), boilerplate_only."""
    placed = links.where("position is not null and position <> ''").select("destination", "source", "position").distinct()
    by_place = placed.groupBy("destination", "position").agg(F.count(F.lit(1)).alias("n"))
    folded = by_place.groupBy("destination").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("position", "n")))).alias("by_position"), F.bool_and(F.col("position").isin(*BOILERPLATE)).alias("shared"))
    without = links.where("position is null or position = ''").select("destination", "source").distinct().groupBy("destination").agg(F.count(F.lit(1)).alias("unclassified"))
    both = folded.join(without, "destination", "full_outer")
    return both.select("destination", "by_position", F.coalesce("unclassified", F.lit(0)).cast("bigint").alias("unclassified"), (F.coalesce("shared", F.lit(False)) & F.col("unclassified").isNull()).alias("boilerplate_only"))


def position_totals(links: DataFrame) -> DataFrame:
    """position ('' where unknown), links; and the classified share in each row."""
    totals = links.groupBy(F.coalesce("position", F.lit("")).alias("position")).agg(F.count(F.lit(1)).alias("links"))
    whole = totals.agg(F.sum("links").alias("all"), F.sum(F.when(F.col("position") != "", F.col("links")).otherwise(0)).alias("known"))
    return totals.crossJoin(F.broadcast(whole)).select("position", "links", F.bround(F.col("known") / F.col("all"), 4).alias("classified_share"))


def duplicate_links(links: DataFrame, shown: int = 20) -> DataFrame:
    """source, extra (links beyond the first to one destination with one anchor), repeats (the most frequent ones)."""
    repeated = links.groupBy("source", "destination", F.coalesce("anchor", F.lit("")).alias("anchor")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rank = Window.partitionBy("source").orderBy(F.col("n").desc(), "destination", "anchor")
    top = repeated.withColumn("k", F.row_number().over(rank))
    return top.groupBy("source").agg(F.sum(F.col("n") - 1).alias("extra"), F.sort_array(F.collect_list(F.when(F.col("k") <= shown, F.struct("k", "destination", "anchor", "n")))).alias("repeats"))


def depth_histogram(pages: DataFrame, found: DataFrame) -> DataFrame:
    """hops (null: not reached), pages; pages: node."""
    return pages.join(found.select("node", "hops"), "node", "left").groupBy("hops").agg(F.count(F.lit(1)).alias("pages"))
