"""Bounded breadth-first search over relationships, level by level: the frontier joins the edges, and windows in
discovery order apply the caps. Only the frontier and the reached nodes move; the edges are read with their filters pushed
down, and every level is cut off by a checkpoint in the shared folder."""

from __future__ import annotations

import tempfile
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions import scalars as X
from quillgraph.model import CONFIDENCES, Graph


#: Frontiers are broadcast, and levels cut by a top-k, where the caps keep them below this.
SMALL = 100_000
#: So few nodes are a filter on the edges, which goes down to the scans, and below what is aggregated there.
FEW = 1000


@dataclass(frozen=True)
class Caps:
    """Bounds of a search. There is none on its time unless one is given: the answer must not depend on the clock."""

    depth: int = 10
    nodes: int = 500
    edges: int = 2000
    seconds: float = float("inf")


@dataclass
class Outcome:
    """reached(symbol_id, depth, pos, via_kind, via_confidence, via_provenance, predecessor); found: whether the target was; truncated: the cap that stopped the search, if one did."""

    reached: DataFrame
    found: bool
    truncated: str | None


REACHED = "symbol_id string, depth int, pos long, via_kind string, via_confidence string, via_provenance string, predecessor string"


def checkpoint_dir(spark) -> None:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not base:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="quill-graph-")
        sc.setCheckpointDir(base)


def cut(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def adjacency(g: Graph, reverse: bool = False) -> DataFrame:
    """(node, neighbour, kind, confidence, provenance, edge_id) of every relationship with a target."""
    r = g.relationships.where(F.col("target_symbol_id").isNotNull())
    a, b = ("target_symbol_id", "source_symbol_id") if reverse else ("source_symbol_id", "target_symbol_id")
    return r.select(F.col(a).alias("node"), F.col(b).alias("neighbour"), "kind", "confidence", "provenance", F.col("id").alias("edge_id"))


def leaving(edges: DataFrame, nodes: DataFrame, most: int = FEW) -> DataFrame:
    """Edges that may leave one of nodes(node): no other ones where there are up to `most`, else all."""
    ids = [r[0] for r in nodes.select("node").distinct().limit(most + 1).collect()]
    return edges.where(F.col("node").isin(ids)) if len(ids) <= most else edges


def bfs(edges: DataFrame, start: str, target: str | None = None, caps: Caps = Caps(), kinds: tuple[str, ...] | None = None, min_confidence: str | None = None) -> Outcome:
    """Search from start, in the order kind, neighbour, edge_id within a node.

    Edges that a filter keeps out don't count; edges to reached nodes do. The edge after the last that may be examined,
    or the node after the last that may be reached, stops the search; a node at the greatest depth is not expanded, and
    truncates the search if it has any edge at all. The target ends the search at once, without truncation.
    """
    spark = edges.sparkSession
    seed = spark.createDataFrame([(start, 0, 0, None, None, None, None)], REACHED)
    if target == start:
        return Outcome(seed, True, None)
    allowed = edges
    if kinds:
        allowed = allowed.where(F.col("kind").isin(*kinds))
    if min_confidence and min_confidence != CONFIDENCES[0]:
        allowed = allowed.where(X.confidence_rank(F.col("confidence")) >= CONFIDENCES.index(min_confidence))
    small = F.broadcast if caps.nodes <= SMALL else (lambda df: df)
    reached, frontier, examined, count, depth, began = seed, seed, 0, 1, 0, time.monotonic()
    while True:
        nodes = frontier.select(F.col("symbol_id").alias("node"), F.col("pos").alias("from"))
        if depth >= caps.depth:
            rest = leaving(edges, nodes).join(small(nodes.select("node")), "node", "left_semi")
            return Outcome(reached, False, None if rest.isEmpty() else "max_depth")
        if time.monotonic() - began > caps.seconds:
            return Outcome(reached, False, "max_duration")
        out = leaving(allowed, nodes).join(small(nodes), "node")
        # in order, no more than the cap of edges and the one that breaks it: a top-k, not a sort of all
        some = out.orderBy("from", "kind", "neighbour", "edge_id").limit(caps.edges - examined + 1) if caps.edges <= SMALL else out
        known = small(reached.select(F.col("symbol_id").alias("neighbour"), F.lit(True).alias("known")))
        order = W.orderBy("from", "kind", "neighbour", "edge_id")
        # one small partition: the limit above holds it to caps.edges rows
        level = some.withColumn("seq", F.row_number().over(order)).join(known, "neighbour", "left").withColumn("first", F.min("seq").over(W.partitionBy("neighbour")))
        level = level.withColumn("new", F.col("known").isNull() & (F.col("seq") == F.col("first")))
        level = level.withColumn("n_new", F.sum(F.col("new").cast("long")).over(W.orderBy("seq")))
        level = cut(level)
        stats = level.agg(
            F.min(F.when(F.col("seq") + examined > caps.edges, F.col("seq"))).alias("edge_stop"),
            F.min(F.when(F.col("new") & (F.col("n_new") + count > caps.nodes), F.col("seq"))).alias("node_stop"),
            F.min(F.when(F.col("new") & (F.col("neighbour") == F.lit(target)), F.col("seq"))).alias("hit"),
            F.count("*").alias("n"),
        ).first()
        big = 1 << 62
        edge_stop, node_stop, hit = (big if stats[k] is None else stats[k] for k in ("edge_stop", "node_stop", "hit"))
        stop = min(edge_stop, node_stop)
        upto = hit + 1 if hit < stop else stop
        fresh = level.where(F.col("new") & (F.col("seq") < upto)).select(
            F.col("neighbour").alias("symbol_id"), F.lit(depth + 1).alias("depth"), (F.col("n_new") + count - 1).alias("pos"), F.col("kind").alias("via_kind"), F.col("confidence").alias("via_confidence"), F.col("provenance").alias("via_provenance"), F.col("node").alias("predecessor")
        )
        reached = reached.unionByName(fresh)
        if hit < stop:
            return Outcome(cut(reached), True, None)
        if stop < big:
            return Outcome(cut(reached), False, "max_edges" if edge_stop <= node_stop else "max_nodes")
        grown = fresh.count()
        if not grown:
            return Outcome(cut(reached), False, None)
        reached = cut(reached)
        frontier = reached.where(F.col("depth") == depth + 1)
        examined, count, depth = examined + stats["n"], count + grown, depth + 1


def path_to(reached: DataFrame, target: str, depth: int) -> DataFrame:
    """(hop, symbol_id, via_kind, via_confidence, via_provenance) from the start to target, by steps back over predecessors."""
    step = reached.where(F.col("symbol_id") == target)
    out = step
    for _ in range(depth):
        step = reached.join(F.broadcast(step.select(F.col("predecessor").alias("symbol_id")).where("symbol_id is not null")), "symbol_id", "left_semi")
        out = out.unionByName(step)
    return out.select(F.col("depth").alias("hop"), "symbol_id", "via_kind", "via_confidence", "via_provenance").distinct().orderBy("hop")


def traced(g: Graph, source: str, target: str, caps: Caps = Caps(), **filters) -> tuple[DataFrame, str | None]:
    """The shortest path from source to target, a row for each node, and the cap that stopped the search, if one did: without rows and without a cap, there is no path."""
    got = bfs(adjacency(g), source, target, caps, **filters)
    return path_to(got.reached if got.found else got.reached.limit(0), target, caps.depth), got.truncated


def trace(g: Graph, source: str, target: str, caps: Caps = Caps(), **filters) -> DataFrame:
    """The path of traced() alone."""
    return traced(g, source, target, caps, **filters)[0]


def impact(g: Graph, symbol: str, caps: Caps = Caps(), **filters) -> Outcome:
    """What depends on a symbol: a search against the direction of the relationships."""
    return bfs(adjacency(g, reverse=True), symbol, None, caps, **filters)


def reached_rows(g: Graph, reached: DataFrame) -> DataFrame:
    """Reached nodes with the place of their symbol, which is null where it is not known."""
    s = g.symbols.select(F.col("id").alias("symbol_id"), "file_id", "start_line", "end_line")
    f = g.files.select(F.col("id").alias("file_id"), F.col("relative_path").alias("path"))
    small = F.broadcast(reached)  # at most caps.nodes rows
    places = s.join(small.select("symbol_id"), "symbol_id", "left_semi").join(f, "file_id", "left")
    return small.join(places, "symbol_id", "left").select("symbol_id", "depth", "path", "start_line", "end_line", F.col("via_confidence").alias("confidence"), F.col("via_provenance").alias("provenance"), "via_kind", "predecessor")


def neighbourhood(g: Graph, symbol: str, depth: int = 2, caps: Caps | None = None, **filters) -> tuple[DataFrame, DataFrame]:
    """Nodes (symbol_id, depth) and tree edges (source, target, kind, confidence) within depth in either direction, each edge in its own direction and once."""
    caps = caps or Caps(depth=depth)
    there = bfs(adjacency(g), symbol, None, caps, **filters).reached
    back = bfs(adjacency(g, reverse=True), symbol, None, caps, **filters).reached
    nodes = there.unionByName(back).groupBy("symbol_id").agg(F.min("depth").alias("depth"))
    e1 = there.where("predecessor is not null").select(F.col("predecessor").alias("source"), F.col("symbol_id").alias("target"), F.col("via_kind").alias("kind"), F.col("via_confidence").alias("confidence"))
    e2 = back.where("predecessor is not null").select(F.col("symbol_id").alias("source"), F.col("predecessor").alias("target"), F.col("via_kind").alias("kind"), F.col("via_confidence").alias("confidence"))
    return nodes, e1.unionByName(e2).groupBy("source", "target", "kind").agg(F.max_by("confidence", X.confidence_rank(F.col("confidence"))).alias("confidence"))


def radial_layout(nodes: DataFrame) -> DataFrame:
    """x and y of nodes(symbol_id, depth): a ring for each depth, wide enough for its nodes and 210 further out than the one before."""
    rings = nodes.groupBy("depth").agg(F.count("*").alias("n"))
    base = F.greatest(F.col("depth") * 210.0, F.col("n") * 58 / F.lit(X.TAU))
    # radius = max(base, radius of the ring before + 210): the running maximum of base - 210 depth, back in place
    rings = rings.withColumn("radius", F.when(F.col("depth") == 0, 0.0).otherwise(F.max(F.when(F.col("depth") > 0, base - F.col("depth") * 210.0)).over(W.orderBy("depth")) + F.col("depth") * 210.0))
    placed = nodes.withColumn("i", F.row_number().over(W.partitionBy("depth").orderBy("symbol_id")) - 1).join(F.broadcast(rings), "depth")  # a row for each depth
    angle = -F.lit(X.TAU / 4) + F.lit(X.TAU) * F.col("i") / F.col("n")
    return placed.select("symbol_id", "depth", (F.round(F.col("radius") * F.cos(angle), 6) + 0.0).alias("x"), (F.round(F.col("radius") * F.sin(angle), 6) + 0.0).alias("y"))
