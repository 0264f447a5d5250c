"""An intent graph out of the sales tables: places are modules, customers and suppliers functions, brands states, kinds of events events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared
from .graph import IntentGraph, clauses_of, edges_of, nodes_of


#: rows of a table that one task of its joins gets
ROWS = 300_000


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._tasks: dict[str, int] = {}

    def tasks(self, name: str) -> int:
        """Tasks for joins of this table, by its rows: settings and merged partitions would let a task's memory grow with the table."""
        if name not in self._tasks:
            self._tasks[name] = max(self.spark.sparkContext.defaultParallelism, -(-getattr(self, name).count() // ROWS))
        return self._tasks[name]

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def _name(*parts) -> F.Column:
    return F.concat_ws("", *(F.col(p) if "_" in p else F.lit(p) for p in parts))


def places(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").alias("nk"), _name("R", "n_regionkey", ".N", "n_nationkey").alias("nation"), "n_regionkey")


def customers(t: Tables) -> DataFrame:
    return t.customer.join(places(t), F.col("c_nationkey") == F.col("nk")).select("c_custkey", "nation", F.concat("nation", F.lit(".C"), "c_custkey").alias("cust"))


def suppliers(t: Tables) -> DataFrame:
    return t.supplier.join(places(t), F.col("s_nationkey") == F.col("nk")).select("s_suppkey", F.concat("nation", F.lit(".S"), "s_suppkey").alias("supp"), F.col("nation").alias("supp_nation"))


def brand(c: str = "p_brand") -> F.Column:
    return F.concat(F.lit("P."), F.regexp_replace(c, "[^A-Za-z0-9]", ""))


def nodes(t: Tables) -> DataFrame:
    kinds = [
        (t.region.select(_name("R", "r_regionkey").alias("qname")), "module"),
        (places(t).select(F.col("nation").alias("qname")), "module"),
        (customers(t).select(F.col("cust").alias("qname")), "function"),
        (suppliers(t).select(F.col("supp").alias("qname")), "function"),
        (t.part.select(brand().alias("qname")).distinct(), "state"),
        (t.events.select(F.concat(F.lit("E."), "event_type").alias("qname")).distinct(), "event"),
        (t.spark.createDataFrame([("P",), ("E",)], "qname string"), "module"),
    ]
    out = None
    for df, kind in kinds:
        part = df.select("qname", F.lit(kind).alias("kind"), F.lit("Declared").alias("origin"), F.concat(F.element_at(F.split("qname", r"\."), 1), F.lit(".src")).alias("file"), F.lit(True).alias("annotated"))
        out = part if out is None else out.unionByName(part)
    return nodes_of(out)


def sales(t: Tables) -> DataFrame:
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers(t), F.col("o_custkey") == F.col("c_custkey"))


def _named(t: Tables, tasks: int, key: str, name: str) -> DataFrame:
    """The names of customers by key, where joins of so many tasks need them."""
    return customers(t).select(F.col("c_custkey").alias(key), F.col("cust").alias(name)).repartition(tasks, key).distinct()


def _effects(t: Tables) -> DataFrame:
    n = t.tasks("lineitem")
    lines = t.lineitem.select("l_orderkey", "l_partkey", F.when(F.col("l_returnflag") == "R", "Affects").otherwise("Reads").alias("kind")).repartition(n, "l_orderkey")
    orders = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").repartition(n, "l_orderkey")
    brands = t.part.select(F.col("p_partkey").alias("l_partkey"), brand().alias("dst")).repartition(n, "l_partkey")
    bought = lines.join(orders, "l_orderkey").select("o_custkey", "l_partkey", "kind").repartition(n, "l_partkey").join(brands, "l_partkey")
    once = bought.select("o_custkey", "dst", "kind").repartition(n, "o_custkey").distinct()
    return once.join(_named(t, n, "o_custkey", "src"), "o_custkey").select("src", "dst", "kind", F.lit("Derived").alias("layer"))


def _calls(t: Tables) -> DataFrame:
    n = t.tasks("orders")
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", F.trunc("o_orderdate", "month").alias("month")).repartition(n, "month", "o_orderpriority")
    turn = Window.partitionBy("month", "o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    pairs = orders.select("o_custkey", F.lag("o_custkey").over(turn).alias("before")).filter("before <> o_custkey").repartition(n, "before").distinct()
    after = pairs.join(_named(t, n, "before", "src"), "before").select("src", "o_custkey").repartition(n, "o_custkey")
    return after.join(_named(t, n, "o_custkey", "dst"), "o_custkey").select("src", "dst", F.lit("Calls").alias("kind"), F.lit("Derived").alias("layer"))


def edges(t: Tables) -> DataFrame:
    """Distinct (src, dst, kind, layer). A filter by kind leaves only the parts that make these.

    No two parts make edges of the same kind, so each removes its own repeated ones, where it can by keys before it names them.
    """
    urgent = sales(t).join(suppliers(t), F.col("l_suppkey") == F.col("s_suppkey")).filter((F.col("o_orderpriority") == "1-URGENT") & (F.col("l_quantity") >= 50))
    triggers = urgent.select(F.col("cust").alias("src"), F.col("supp").alias("dst"), F.lit("Triggers").alias("kind"), F.lit("Declared").alias("layer")).distinct()
    depends = urgent.filter("l_returnflag = 'R' AND l_discount >= 0.08 AND nation <> supp_nation").select(F.col("nation").alias("src"), F.col("supp_nation").alias("dst"), F.lit("DependsOn").alias("kind"), F.lit("Declared").alias("layer")).distinct()
    n = t.tasks("events")
    sent = t.events.select("user_id", "event_type").repartition(n, "user_id").distinct().join(_named(t, n, "user_id", "src"), "user_id")
    emits = sent.select("src", F.concat(F.lit("E."), "event_type").alias("dst"), F.lit("Emits").alias("kind"), F.lit("Declared").alias("layer"))
    types = t.events.select("event_type").distinct().withColumn("i", F.row_number().over(Window.orderBy("event_type")) - 1)  # five rows
    handles = suppliers(t).join(F.broadcast(types), F.col("s_suppkey") % 7 == F.col("i")).select(F.col("supp").alias("src"), F.concat(F.lit("E."), "event_type").alias("dst"), F.lit("Handles").alias("kind"), F.lit("Declared").alias("layer")).distinct()
    out = _effects(t)
    for e in (_calls(t), triggers, depends, emits, handles):
        out = out.unionByName(e)
    return edges_of(out.withColumn("edge_id", F.xxhash64("src", "dst", "kind")))


def clauses(t: Tables, depends: DataFrame) -> DataFrame:
    """purpose of regions; owner of every nation whose key isn't divisible by 4; unknown of customers in debt; depends_on as the edges have it."""
    purpose = t.region.select(_name("R", "r_regionkey").alias("qname"), F.lit("purpose").alias("clause"), F.col("r_name").alias("value"))
    owner = places(t).filter("nk % 4 <> 0").select(F.col("nation").alias("qname"), F.lit("owner").alias("clause"), F.concat(F.lit("team"), F.col("nk") % 3).alias("value"))
    debt = t.customer.filter("c_acctbal < 0").join(customers(t), "c_custkey").select(F.col("cust").alias("qname"), F.lit("unknown").alias("clause"), F.lit("will they pay?").alias("value"))
    states = t.spark.createDataFrame([("P", "owner", "stock")], "qname string, clause string, value string")
    needs = depends.filter("kind = 'DependsOn'").select(F.col("src").alias("qname"), F.lit("depends_on").alias("clause"), F.col("dst").alias("value"))
    return clauses_of(purpose.unionByName(owner).unionByName(debt).unionByName(states).unionByName(needs).withColumn("ord", F.lit(0)))


def graph(spark: SparkSession, folder: str, kinds: Sequence[str] = ()) -> IntentGraph:
    """With edges of these kinds (none named: of all), written once to the shared folder, as a query reads them several times."""
    t = Tables(spark, folder)
    some = edges(t).filter(F.col("kind").isin(list(kinds))) if kinds else edges(t)
    table = shared.written(some, "edges")
    return IntentGraph(nodes(t), table, clauses(t, table if not kinds or "DependsOn" in kinds else edges(t)))
