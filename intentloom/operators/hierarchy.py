"""Containment by dotted names: prefixes are exploded and joined by equality, so no pair of nodes is compared in vain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.names import last_segment, prefixes, segments


def ancestry(names: DataFrame, nodes: DataFrame, kinds: list[str], own: bool, key: str = "qname") -> DataFrame:
    """(key, ancestor, depth): nodes of ``kinds`` that are a prefix of the key; ``own``: the key itself too."""
    exploded = names.select(key).distinct().select(key, F.explode(prefixes(F.col(key))).alias("ancestor"))
    if not own:
        exploded = exploded.filter(F.col("ancestor") != F.col(key))
    holders = nodes.filter(F.col("kind").isin(kinds)).select(F.col("qname").alias("ancestor"))
    return exploded.join(holders, "ancestor").select(key, "ancestor", F.size(segments(F.col("ancestor"))).alias("depth"))


def containers(nodes: DataFrame) -> DataFrame:
    """(qname, container): the longest proper prefix that is a module, service or workflow."""
    return ancestry(nodes, nodes, schema.SCOPES, False).groupBy("qname").agg(F.max_by("ancestor", "depth").alias("container"))


def nearest_modules(nodes: DataFrame) -> DataFrame:
    """(qname, module): the node itself if it is a module, else its longest prefix that is."""
    return ancestry(nodes, nodes, ["module"], True).groupBy("qname").agg(F.max_by("ancestor", "depth").alias("module"))


def owner_chains(nodes: DataFrame) -> DataFrame:
    """(qname, ancestor, depth): modules, services and externals that hold the node, itself included."""
    return ancestry(nodes, nodes, schema.OWNERS, True)


def inside(hits: DataFrame, holder: str) -> DataFrame:
    """Hits that are ``holder`` or lie in it."""
    return hits.filter((F.col("qname") == holder) | F.startswith(F.col("qname"), F.lit(holder + ".")))


def effective_owners(nodes: DataFrame, clauses: DataFrame) -> DataFrame:
    """(qname, owner): the declared owner; a state's or event's is that of its nearest module which declares one."""
    declared = clauses.filter("clause = 'owner'").groupBy("qname").agg(F.min_by("value", "ord").alias("owner"))
    heirs = nodes.filter(F.col("kind").isin("state", "event"))
    up = ancestry(heirs, nodes, ["module"], False).join(declared.withColumnRenamed("qname", "ancestor"), "ancestor")
    inherited = up.groupBy("qname").agg(F.max_by("owner", "depth").alias("inherited"))
    both = nodes.select("qname", "kind").join(declared, "qname", "left").join(inherited, "qname", "left")
    return both.select("qname", F.coalesce("owner", "inherited").alias("owner")).filter("owner IS NOT NULL")


def merge_nodes(declared: DataFrame, ambient: DataFrame, derived: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, rejected (qname) and duplicates (qname, file, line) of the three layers.

    The first declaration of a name wins. Ambient modules fill in what isn't declared. A derived node that begins on the
    declaration's file and line joins it (origin Both); on any other it is rejected.
    """
    place = Window.partitionBy("qname").orderBy(F.split("file", "/"), "line", "ord")
    ranked = declared.withColumn("_n", F.row_number().over(place))
    first, duplicates = ranked.filter("_n = 1").drop("_n"), ranked.filter("_n > 1").select("qname", "file", "line")
    new_modules = ambient.join(first.select("qname"), "qname", "left_anti").dropDuplicates(["qname"])
    known = first.select("qname", F.col("file").alias("_f"), F.col("line").alias("_l"), F.lit(True).alias("_declared")).unionByName(new_modules.select("qname", F.lit(None).cast("string").alias("_f"), F.lit(None).cast("int").alias("_l"), F.lit(True).alias("_declared")))
    met = derived.join(known, "qname", "left")
    same = F.col("_declared") & F.col("file").eqNullSafe(F.col("_f")) & F.col("line").eqNullSafe(F.col("_l"))
    rejected = met.filter(F.col("_declared") & ~same).select("qname").distinct()
    both = met.filter(same).select("qname").distinct().withColumn("_both", F.lit(True))
    base = first.unionByName(new_modules).join(both, "qname", "left").withColumn("origin", F.when(F.col("_both"), "Both").otherwise("Declared")).drop("_both")
    fresh = met.filter("_declared IS NULL").dropDuplicates(["qname"]).withColumn("origin", F.lit("Derived")).select(base.columns)
    return base.unionByName(fresh), rejected, duplicates


def drop_rejected(edges: DataFrame, rejected: DataFrame) -> DataFrame:
    """Derived edges that touch no rejected name."""
    for end in ("src", "dst"):
        edges = edges.join(rejected.select(F.col("qname").alias(end)), end, "left_anti")
    return edges


def contains_edges(nodes: DataFrame) -> DataFrame:
    return containers(nodes).select(F.col("container").alias("src"), F.col("qname").alias("dst"), F.lit("Contains").alias("kind"))


def sequence_edges(nodes: DataFrame) -> DataFrame:
    """Each step to the next one of its workflow, in the order of ``ord``."""
    steps = nodes.filter("kind = 'step'").join(ancestry(nodes.filter("kind = 'step'"), nodes, ["workflow"], False).groupBy("qname").agg(F.max_by("ancestor", "depth").alias("workflow")), "qname")
    before = F.lag("qname").over(Window.partitionBy("workflow").orderBy("ord", "qname"))
    return steps.select(before.alias("src"), F.col("qname").alias("dst"), F.lit("Sequence").alias("kind")).filter("src IS NOT NULL")


def host_identifiers(nodes: DataFrame, bound: DataFrame) -> DataFrame:
    """(qname, identifier): the bound one, else a derived node's last segment, else null."""
    return nodes.join(bound, "qname", "left").select("qname", F.coalesce("identifier", F.when(F.col("origin") == "Derived", last_segment(F.col("qname")))).alias("identifier"))
