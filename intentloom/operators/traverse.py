"""Traversals: hops, shortest chains, all simple paths, neighbourhoods.

A hop is an edge, or (event hop) an Emits edge with a Handles edge of the same event, which counts as two.
``closure`` settles nodes level by level: each level is a join of the last one with the hops, written once to the shared
folder as (node, node before, edge, rank), and never written again. Chains are built at the end, for the nodes asked for.
Graphs of up to ``SMALL`` edges are searched in the driver's memory (``operators.local``), which gives the same chains: of
equally long ones the least by edge_id in the order of the walk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import shared
from ..graph import IntentGraph

#: edges of a graph that is searched in the driver's memory: some 100 MB
SMALL = 1_000_000
HITS = "qname string, hops int, via array<bigint>"


#: begins the names of the places within event hops, which no node has
WITHIN = "\x00"


def hops(graph: IntentGraph, kinds: list[str], events: bool, reverse: bool = False, paired: bool = False) -> DataFrame:
    """(src, dst, segment): segment holds the edge ids in the order of the walk; reverse: from an edge's end to its start.

    An event hop goes by way of a place of its own for each event, so there are as many rows as edges, and not emitters x
    handlers. paired: in one row from emitter to handler, for walks that count what they pass.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    out = graph.edges_of(*kinds).select(F.col(a).alias("src"), F.col(b).alias("dst"), F.array("edge_id").alias("segment"))
    if events and not paired:
        place = F.concat(F.lit(WITHIN), "dst")
        enter, leave = ("Handles", "Emits") if reverse else ("Emits", "Handles")
        out = out.unionByName(graph.edges_of(enter).select("src", place.alias("dst"), F.array("edge_id").alias("segment")))
        out = out.unionByName(graph.edges_of(leave).select(place.alias("_from"), "src", "edge_id").select(F.col("_from").alias("src"), F.col("src").alias("dst"), F.array("edge_id").alias("segment")))
    elif events:
        emits = graph.edges_of("Emits").select(F.col("src").alias("x"), F.col("dst").alias("e"), F.col("edge_id").alias("i"))
        handles = graph.edges_of("Handles").select(F.col("src").alias("y"), F.col("dst").alias("e"), F.col("edge_id").alias("j"))
        walk = ("y", "x", "j", "i") if reverse else ("x", "y", "i", "j")
        out = out.unionByName(emits.join(handles, "e").select(F.col(walk[0]).alias("src"), F.col(walk[1]).alias("dst"), F.array(walk[2], walk[3]).alias("segment")))
    return out.filter("src <> dst")


_ORDER = "struct<a: int, b: array<bigint>, c: bigint>"
#: levels of chains that are joined in one plan
_LEVELS = 6


def _empty(table: DataFrame) -> bool:
    return table.limit(1).count() == 0


def closure(hop: DataFrame, starts: DataFrame, limit: int | None = None, goal: str | None = None, chains: bool = True) -> DataFrame:
    """(qname, hops, via): all that ``starts`` (qname, via) reach, without themselves; via in the order of the walk, null without ``chains``.

    Hops are of one edge. goal: the search ends with the level that holds it, and only it is reported. In a level nodes are ranked by the rank of the node
    before and the edge, starts before others, so the least candidate of a node has the least chain.
    """
    spark = hop.sparkSession
    hop = shared.written(hop.select(F.col("src").alias("before"), "dst", F.col("segment")[0].alias("edge")), "hops")
    first = starts.groupBy("qname").agg(F.min(F.struct(F.size("via").alias("n"), F.col("via"))).alias("s")).select("qname", F.col("s.n").alias("n"), F.col("s.via").alias("via"))
    first = shared.written(first, "starts")
    last_start = first.agg(F.max("n")).first()[0]
    if last_start is None:
        return spark.createDataFrame([], HITS)
    cost, frontier = first.agg(F.min("n")).first()[0], None
    levels: list[tuple[int, DataFrame]] = []
    while limit is None or cost <= limit:
        level = first.filter(F.col("n") == cost).select("qname", F.lit(None).cast("string").alias("before"), F.lit(None).cast("bigint").alias("edge"), "via", F.lit(None).cast(_ORDER).alias("_r"))
        if frontier is not None:
            # starts with the same chain are equal in order
            start = F.col("before").isNull()
            place = F.struct(F.when(start, 0).otherwise(1).alias("a"), F.when(start, F.col("via")).alias("b"), F.when(~start, F.col("rank")).alias("c"))
            step = frontier.select(place.alias("_r"), F.col("qname").alias("before")).join(hop, "before").select(F.col("dst").alias("qname"), "before", "edge", "_r")
            for done in (first, *(x for _, x in levels)):
                step = step.join(done.select("qname"), "qname", "left_anti")
            best = step.groupBy("qname").agg(F.min(F.struct("_r", "edge", "before")).alias("b"))
            level = level.unionByName(best.select("qname", F.col("b.before").alias("before"), F.col("b.edge").alias("edge"), F.lit(None).cast("array<bigint>").alias("via"), F.col("b._r").alias("_r")))
        frontier = shared.written(level.sort("_r", "via", "edge", "before").withColumn("rank", F.monotonically_increasing_id()).drop("_r"), "level")
        if not _empty(frontier):
            levels.append((cost, frontier))
            if goal is not None and not _empty(frontier.filter(F.col("qname") == goal)):
                break
        elif cost >= last_start:
            break
        cost += 1
    return _chained(spark, levels, goal, chains)


def _chained(spark, levels: list[tuple[int, DataFrame]], goal: str | None, chains: bool) -> DataFrame:
    """The chains of the levels' nodes, from the last level back to the starts."""
    out = None
    for i, (cost, level) in enumerate(reversed(levels)):
        own = level.filter(F.col("before").isNotNull() & (F.col("qname") == goal if goal is not None else ~F.startswith("qname", F.lit(WITHIN))))
        own = own.select("qname", F.lit(cost).alias("hops"), F.col("qname").alias("at"), F.expr("cast(array() as array<bigint>)").alias("via"))
        out = own if out is None else out.unionByName(own)
        if chains:
            here = level.select(F.col("qname").alias("at"), "before", F.coalesce("via", F.array("edge")).alias("_own"))
            out = out.join(here, "at", "left").select("qname", "hops", F.when(F.col("_own").isNull(), F.col("at")).otherwise(F.coalesce("before", F.lit(WITHIN))).alias("at"), F.when(F.col("_own").isNull(), F.col("via")).otherwise(F.concat("_own", "via")).alias("via"))
            if i % _LEVELS == _LEVELS - 1:
                out = shared.written(out, "chains")
    if out is None:
        return spark.createDataFrame([], HITS)
    return out.select("qname", F.col("hops").cast("int").alias("hops"), F.col("via") if chains else F.lit(None).cast("array<bigint>").alias("via"))


def start_at(graph: IntentGraph, qname: str) -> DataFrame:
    return graph.spark.createDataFrame([(qname, [])], "qname string, via array<bigint>")


def one_hop(graph: IntentGraph, qname: str, kinds: list[str], reverse: bool = False) -> DataFrame:
    """(qname, hops, via) at the other ends of the node's edges; of parallel edges the first."""
    near, far = ("dst", "src") if reverse else ("src", "dst")
    found = graph.edges_of(*kinds).filter((F.col(near) == qname) & (F.col(far) != qname))
    return found.groupBy(F.col(far).alias("qname")).agg(F.array(F.min("edge_id")).alias("via")).select("qname", F.lit(1).alias("hops"), "via")


def shorter(*hits: DataFrame, without: str | None = None) -> DataFrame:
    """The union of hits; of a node's chains the shortest, then the first branch's."""
    tagged = [h.select("qname", F.struct(F.col("hops"), F.lit(i).alias("branch"), F.col("via")).alias("h")) for i, h in enumerate(hits)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    out = out.groupBy("qname").agg(F.min("h").alias("h")).select("qname", "h.hops", "h.via")
    return out if without is None else out.filter(F.col("qname") != without)


def backwards(hits: DataFrame) -> DataFrame:
    """The chains of a reverse walk in causal order."""
    return hits.withColumn("via", F.reverse("via"))


def simple_paths(hop: DataFrame, start: str, goal: str, max_len: int) -> DataFrame:
    """(qname, hops, via): all paths of at most ``max_len`` edges that visit no node twice."""
    spark = hop.sparkSession
    hop = shared.written(hop, "hops")
    frontier = spark.createDataFrame([(start, [start], [])], "at string, seen array<string>, via array<bigint>")
    found = None
    for _ in range(max_len):
        step = frontier.join(hop, frontier["at"] == hop["src"]).filter(~F.array_contains("seen", F.col("dst"))).select(F.col("dst").alias("at"), F.concat("seen", F.array("dst")).alias("seen"), F.concat("via", "segment").alias("via")).filter(F.size("via") <= max_len)
        step = shared.written(step, "paths")
        hit = step.filter(F.col("at") == goal).select(F.col("at").alias("qname"), F.size("via").alias("hops"), "via")
        found = hit if found is None else found.unionByName(hit)
        frontier = step.filter(F.col("at") != goal)
    return found if found is not None else spark.createDataFrame([], HITS)


def neighbourhood(graph: IntentGraph, qname: str, depth: int, small: int = SMALL) -> DataFrame:
    """(qname, hops) of all nodes within ``depth`` edges of any kind and direction, itself included."""
    if (local := graph.local(small)) is not None:
        return graph.spark.createDataFrame(local.neighbourhood(qname, depth), "qname string, hops int")
    both = [graph.edges.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.array("edge_id").alias("segment")) for a, b in (("src", "dst"), ("dst", "src"))]
    near = closure(both[0].unionByName(both[1]).filter("src <> dst"), start_at(graph, qname), depth, chains=False)
    return near.select("qname", "hops").unionByName(graph.nodes.filter(F.col("qname") == qname).select("qname", F.lit(0).alias("hops")))

