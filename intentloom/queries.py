"""Queries over the driver's tables, one for each operator, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import corpus
from .functions import names as N
from .graph import IntentGraph, clauses_of, edges_of, nodes_of
from .operators import hierarchy as H
from .operators import lint as L
from .operators import resolution as R
from .operators import scan as S
from .operators import stats
from .operators import traverse as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_PLACES = "places AS (SELECT n_nationkey AS nk, concat('R', n_regionkey, '.N', n_nationkey) AS nation FROM nation)"
_CUST = "cust AS (SELECT c_custkey, nation, concat(nation, '.C', c_custkey) AS cust, c_acctbal FROM customer JOIN places ON c_nationkey = nk)"
_SUPP = "supp AS (SELECT s_suppkey, nation AS supp_nation, concat(nation, '.S', s_suppkey) AS supp FROM supplier JOIN places ON s_nationkey = nk)"
_NODES = """nodes AS (
SELECT concat('R', r_regionkey) AS qname, 'module' AS kind FROM region UNION ALL SELECT nation, 'module' FROM places UNION ALL SELECT cust, 'function' FROM cust
UNION ALL SELECT supp, 'function' FROM supp UNION ALL SELECT DISTINCT concat('P.', regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')), 'state' FROM part
UNION ALL SELECT DISTINCT concat('E.', event_type), 'event' FROM events UNION ALL SELECT 'P', 'module' UNION ALL SELECT 'E', 'module')"""
_EDGES = """sold AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN cust ON o_custkey = c_custkey),
urgent AS (SELECT * FROM sold JOIN supp ON l_suppkey = s_suppkey WHERE o_orderpriority = '1-URGENT' AND l_quantity >= 50),
turns AS (SELECT o_custkey, lag(o_custkey) OVER (PARTITION BY date_trunc('month', o_orderdate), o_orderpriority ORDER BY o_orderdate, o_orderkey) AS before FROM orders),
types AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS i FROM (SELECT DISTINCT event_type FROM events) q),
edges AS (SELECT cust AS src, concat('P.', regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) AS dst, CASE WHEN l_returnflag = 'R' THEN 'Affects' ELSE 'Reads' END AS kind, 'Derived' AS layer FROM sold JOIN part ON l_partkey = p_partkey
UNION SELECT a.cust, b.cust, 'Calls', 'Derived' FROM turns JOIN cust a ON a.c_custkey = before JOIN cust b ON b.c_custkey = o_custkey WHERE before <> o_custkey
UNION SELECT cust, supp, 'Triggers', 'Declared' FROM urgent
UNION SELECT nation, supp_nation, 'DependsOn', 'Declared' FROM urgent WHERE l_returnflag = 'R' AND l_discount >= 0.08 AND nation <> supp_nation
UNION SELECT cust, concat('E.', event_type), 'Emits', 'Declared' FROM events JOIN cust ON user_id = c_custkey
UNION SELECT supp, concat('E.', event_type), 'Handles', 'Declared' FROM supp JOIN types ON s_suppkey % 7 = i)"""
_CLAUSES = """clauses AS (SELECT concat('R', r_regionkey) AS qname, 'purpose' AS clause, r_name AS value FROM region
UNION ALL SELECT nation, 'owner', concat('team', nk % 3) FROM places WHERE nk % 4 <> 0 UNION ALL SELECT 'P', 'owner', 'stock'
UNION ALL SELECT cust, 'unknown', 'will they pay?' FROM cust WHERE c_acctbal < 0 UNION ALL SELECT src, 'depends_on', dst FROM edges WHERE kind = 'DependsOn')"""
_EVENTS = "SELECT a.src, b.src AS dst, 2 AS cost FROM edges a JOIN edges b ON a.dst = b.dst WHERE a.kind = 'Emits' AND b.kind = 'Handles'"
_WITH = f"WITH RECURSIVE {_PLACES}, {_CUST}, {_SUPP}, {_NODES}, {_EDGES}, {_CLAUSES}"


def _graph(spark: SparkSession, folder: str, *kinds: str) -> IntentGraph:
    return corpus.graph(spark, folder, kinds)


def _ask(g: IntentGraph, question: str, node: str | None, **options) -> DataFrame:
    """The answer about ``node``, which stands for {} in the question; none if there is no such node."""
    if node is None:
        return g.spark.createDataFrame([], T.HITS)
    return g.ask(question.format(node), **options)


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def _least(df: DataFrame, column: str) -> str:
    """The first name in order, so that the question has an answer."""
    return df.agg(F.min(column)).first()[0]


def _register_hops() -> None:
    """Single hops around a fixed node: the least one that has such an edge."""
    forms = {"affects": ("dst", ["Affects"]), "reads": ("dst", ["Reads"]), "touches": ("src", ["Affects", "Reads"]), "callers": ("dst", ["Triggers", "Calls"]), "callees": ("src", ["Triggers", "Calls"]), "emits": ("dst", ["Emits"]), "handlers": ("dst", ["Handles"]), "depends": ("src", ["DependsOn"]), "dependents": ("dst", ["DependsOn"])}
    for form, (near, kinds) in forms.items():
        far, listed = "src" if near == "dst" else "dst", ", ".join(f"'{k}'" for k in kinds)

        def run(spark, folder, form=form, near=near, kinds=kinds):
            g = _graph(spark, folder, *kinds)
            return _ask(g, form + "({})", _least(g.edges, near)).select("qname", "hops")

        name = f"{form}_1hop"
        QUERIES[name] = run
        ORACLES[name] = f"{_WITH}, e AS (SELECT * FROM edges WHERE kind IN ({listed})) SELECT DISTINCT {far} AS qname, 1 AS hops FROM e WHERE {near} = (SELECT min({near}) FROM e) AND {far} <> {near}"


_register_hops()


def _closed(hops: str, seed: str, levels: int = 24) -> str:
    """Least costs from ``seed`` (node, c) over ``hops`` (src, dst, cost)."""
    return f"{_WITH}, hops AS ({hops}), walk(node, c) AS ({seed} UNION SELECT dst, c + cost FROM walk JOIN hops ON src = node WHERE c + cost <= {levels}), best AS (SELECT node AS qname, min(c) AS hops FROM walk GROUP BY node)"


_CAUSE = "SELECT src, dst, 1 AS cost FROM edges WHERE kind IN ('Triggers', 'Calls') AND src <> dst UNION "
_BACK = f"SELECT dst AS src, src AS dst, cost FROM ({_CAUSE}{_EVENTS})"
_REACH = f"SELECT src, dst, 1 AS cost FROM edges WHERE kind IN ('Triggers', 'Calls', 'Affects', 'Reads', 'DependsOn') UNION {_EVENTS}"
_STATE = "(SELECT min(qname) FROM nodes WHERE kind = 'state')"
_LIMIT = 10
_CAUSES = ["Triggers", "Calls", "Emits", "Handles"]


def _register_closures() -> None:
    for form, kind in (("affects", "Affects"), ("reads", "Reads")):

        def run(spark, folder, form=form, kind=kind):
            g = _graph(spark, folder, kind, *_CAUSES)
            return _ask(g, form + "*({})", _least(g.of_kind("state"), "qname")).select("qname", "hops")

        QUERIES[f"{form}_star"] = run
        ORACLES[f"{form}_star"] = _closed(_BACK, f"SELECT src, 1 FROM edges WHERE kind = '{kind}' AND dst = {_STATE}", _LIMIT) + f" SELECT qname, hops FROM best WHERE qname <> {_STATE}"
    for form, near, kinds in (("callers", "dst", "'Triggers', 'Calls'"), ("callees", "src", "'Triggers', 'Calls'"), ("depends", "src", "'DependsOn'"), ("dependents", "dst", "'DependsOn'")):
        far, names = "src" if near == "dst" else "dst", [k.strip("' ") for k in kinds.split(",")]

        def run_star(spark, folder, form=form, near=near, names=names):
            g = _graph(spark, folder, *names)
            return _ask(g, form + "*({})", _least(g.edges, near)).select("qname", "hops")

        start = f"(SELECT min({near}) FROM edges WHERE kind IN ({kinds}))"
        QUERIES[f"{form}_star"] = run_star
        ORACLES[f"{form}_star"] = _closed(f"SELECT {near} AS src, {far} AS dst, 1 AS cost FROM edges WHERE kind IN ({kinds})", f"SELECT {start}, 0") + f" SELECT qname, hops FROM best WHERE qname <> {start}"


_register_closures()
_EMITTER = "(SELECT min(src) FROM edges WHERE kind = 'Emits')"


@query(_closed(_CAUSE + _EVENTS, f"SELECT {_EMITTER}, 0", _LIMIT) + " SELECT dst AS qname, min(hops) + 1 AS hops FROM best JOIN edges ON src = qname WHERE kind IN ('Affects', 'Reads') GROUP BY dst")
def touches_star(spark, folder):
    g = _graph(spark, folder, "Affects", "Reads", *_CAUSES)
    return _ask(g, "touches*({})", _least(g.edges_of("Emits"), "src")).select("qname", "hops")


@query(_closed(_REACH, f"SELECT {_EMITTER}, 0", _LIMIT) + f" SELECT qname, hops FROM best WHERE qname <> {_EMITTER}")
def reaches(spark, folder):
    g = _graph(spark, folder)
    return _ask(g, "reaches({})", _least(g.edges_of("Emits"), "src")).select("qname", "hops")


@query(_closed(_REACH, f"SELECT {_EMITTER}, 0", _LIMIT) + " SELECT qname, hops FROM best WHERE qname = (SELECT max(supp) FROM supp)")
def path_shortest(spark, folder):
    g = _graph(spark, folder)
    goal = corpus.suppliers(corpus.Tables(spark, folder)).agg(F.max("supp")).first()[0]
    return _ask(g, f"path({{}}, {goal})", _least(g.edges_of("Emits"), "src")).select("qname", "hops")


@query(f"""{_WITH}, h AS (SELECT src, dst FROM edges WHERE kind = 'DependsOn'), w(place, seen, n) AS (SELECT (SELECT min(src) FROM h), [(SELECT min(src) FROM h)], 0
UNION ALL SELECT dst, list_append(seen, dst), n + 1 FROM w JOIN h ON src = place WHERE n < 5 AND NOT list_contains(seen, dst) AND (n = 0 OR place <> (SELECT max(dst) FROM h)))
SELECT array_to_string(seen, '>') AS route, n AS hops FROM w WHERE place = (SELECT max(dst) FROM h) AND n > 0""")
def paths_all(spark, folder):
    """All simple paths of dependencies of at most 5 edges, as routes."""
    g = _graph(spark, folder, "DependsOn")
    h = g.edges
    start, goal = h.agg(F.min("src"), F.max("dst")).first()
    if start is None:
        return spark.createDataFrame([], "route string, hops int")
    found = T.simple_paths(T.hops(g, ["DependsOn"], False), start, goal, 5).withColumn("id", F.monotonically_increasing_id())
    steps = found.select("id", "hops", F.posexplode("via").alias("at", "edge_id")).join(h.select("edge_id", "dst"), "edge_id")
    routes = steps.groupBy("id", "hops").agg(F.array_sort(F.collect_list(F.struct("at", "dst"))).alias("s"))
    return routes.select(F.concat_ws(">", F.lit(start), F.transform("s", lambda x: x["dst"])).alias("route"), "hops")


@query(_closed("SELECT src, dst, 1 AS cost FROM edges UNION SELECT dst, src, 1 FROM edges", "SELECT (SELECT min(src) FROM edges WHERE kind = 'DependsOn'), 0", 2) + " SELECT qname, hops FROM best WHERE qname IS NOT NULL")
def neighbourhood_2(spark, folder):
    g = _graph(spark, folder)
    start = _least(g.edges_of("DependsOn"), "src")
    return T.neighbourhood(g, start, 2) if start else spark.createDataFrame([], "qname string, hops int")


_UP = "a AS (SELECT n.qname, m.qname AS holder, m.kind AS holder_kind, length(m.qname) - length(replace(m.qname, '.', '')) + 1 AS depth FROM nodes n JOIN nodes m ON n.qname = m.qname OR starts_with(n.qname, m.qname || '.'))"


@query(f"{_WITH}, {_UP} SELECT arg_max(holder, depth) AS src, qname AS dst, 'Contains' AS kind FROM a WHERE holder <> qname AND holder_kind IN ('module', 'service', 'workflow') GROUP BY qname")
def contains_edges(spark, folder):
    return H.contains_edges(corpus.nodes(corpus.Tables(spark, folder)))


@query(f"{_WITH}, {_UP} SELECT qname, arg_max(holder, depth) AS module FROM a WHERE holder_kind = 'module' GROUP BY qname")
def nearest_module(spark, folder):
    return H.nearest_modules(corpus.nodes(corpus.Tables(spark, folder)))


@query(f"{_WITH}, {_UP} SELECT qname, holder AS ancestor, depth::INT AS depth FROM a WHERE holder_kind IN ('module', 'service', 'external')")
def owner_chain(spark, folder):
    return H.owner_chains(corpus.nodes(corpus.Tables(spark, folder)))


_OWNERS = f"""{_UP}, o AS (SELECT qname, value FROM clauses WHERE clause = 'owner'),
own AS (SELECT n.qname, coalesce(d.value, i.value) AS owner FROM nodes n LEFT JOIN o d ON d.qname = n.qname LEFT JOIN (SELECT a.qname, arg_max(o.value, depth) AS value FROM a JOIN nodes m ON m.qname = a.qname JOIN o ON o.qname = holder
WHERE m.kind IN ('state', 'event') AND holder <> a.qname AND holder_kind = 'module' GROUP BY a.qname) i ON i.qname = n.qname)"""


@query(f"{_WITH}, {_OWNERS} SELECT qname, owner FROM own WHERE owner IS NOT NULL")
def effective_owner(spark, folder):
    g = _graph(spark, folder, "DependsOn")
    return H.effective_owners(g.nodes, g.clauses)


@query(f"{_WITH}, {_OWNERS} SELECT qname FROM own WHERE owner = 'stock'")
def owner_form(spark, folder):
    return _graph(spark, folder, "DependsOn").ask('owner("stock")').select("qname")


@query(f"{_WITH} SELECT DISTINCT qname FROM clauses WHERE clause = 'unknown' AND starts_with(qname, 'R1.')")
def unknown_in_module(spark, folder):
    return _graph(spark, folder, "DependsOn").ask("unknown in module(R1)").select("qname")


@query(_closed(_BACK, f"SELECT src, 1 FROM edges WHERE kind = 'Affects' AND dst = {_STATE}", _LIMIT) + " SELECT qname, hops FROM best JOIN nodes USING (qname) WHERE starts_with(qname, 'R2.') AND kind = 'function'")
def filtered_closure(spark, folder):
    """Filters by module and kind after the closure."""
    g = _graph(spark, folder, "Affects", *_CAUSES)
    return _ask(g, "affects*({}) in module(R2) kind(function)", _least(g.of_kind("state"), "qname")).select("qname", "hops")


@query(_closed("SELECT src, dst, 1 AS cost FROM edges WHERE kind = 'DependsOn'", "SELECT (SELECT min(src) FROM edges WHERE kind = 'DependsOn'), 0") .replace("best AS", f"{_OWNERS}, best AS") + " SELECT best.qname, hops FROM best JOIN own USING (qname) WHERE owner = 'team2' AND hops > 0")
def filter_owned_by(spark, folder):
    g = _graph(spark, folder, "DependsOn")
    return _ask(g, 'depends*({}) owned_by("team2")', _least(g.edges, "src")).select("qname", "hops")


@query(f"{_WITH}, k AS (SELECT (SELECT min(src) FROM edges WHERE kind = 'DependsOn') AS q) SELECT 'node' AS side, kind FROM nodes, k WHERE qname = q UNION ALL SELECT 'clause', clause FROM clauses, k WHERE qname = q UNION ALL SELECT 'out', kind FROM edges, k WHERE src = q UNION ALL SELECT 'in', kind FROM edges, k WHERE dst = q")
def show_card(spark, folder):
    g = _graph(spark, folder)
    node = _least(g.edges_of("DependsOn"), "src")
    return g.ask(f"show({node})").select("side", "kind") if node else spark.createDataFrame([], "side string, kind string")


def _steps(spark, folder):
    """Workflows: users; steps: their events in order."""
    e = corpus.Tables(spark, folder).events
    users = e.select(F.concat(F.lit("U"), "user_id").alias("qname")).distinct().select("qname", F.lit("workflow").alias("kind"), F.lit(0).alias("ord"))
    return users.unionByName(e.select(F.concat(F.lit("U"), "user_id", F.lit(".e"), "event_id").alias("qname"), F.lit("step").alias("kind"), "event_id").withColumnRenamed("event_id", "ord"))


@query("SELECT concat('U', user_id, '.e', before) AS src, concat('U', user_id, '.e', event_id) AS dst, 'Sequence' AS kind FROM (SELECT *, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS NOT NULL")
def sequence_edges(spark, folder):
    return H.sequence_edges(_steps(spark, folder))


@query(f"""WITH d AS (SELECT concat('B', o_custkey) AS qname, o_orderstatus AS file, (o_orderkey % 5)::INT AS line, o_orderkey AS ord FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY qname ORDER BY file, line, ord) AS n FROM d), f AS (SELECT * FROM r WHERE n = 1),
x AS (SELECT DISTINCT concat('B', l_suppkey) AS qname, min(l_linestatus) AS file, 1 AS line FROM lineitem GROUP BY l_suppkey)
SELECT coalesce(f.qname, x.qname) AS qname, CASE WHEN f.qname IS NULL THEN 'Derived' WHEN x.qname IS NOT NULL AND x.file = f.file AND x.line = f.line THEN 'Both' ELSE 'Declared' END AS origin FROM f FULL JOIN x ON f.qname = x.qname""")
def node_merge(spark, folder):
    """Layers of nodes united: customers' orders declare, suppliers derive."""
    t = corpus.Tables(spark, folder)
    columns = ["qname", "file", "line", "ord"]
    declared = t.orders.select(F.concat(F.lit("B"), "o_custkey").alias("qname"), F.col("o_orderstatus").alias("file"), (F.col("o_orderkey") % 5).cast("int").alias("line"), F.col("o_orderkey").alias("ord"))
    derived = t.lineitem.groupBy("l_suppkey").agg(F.min("l_linestatus").alias("file")).select(F.concat(F.lit("B"), "l_suppkey").alias("qname"), "file", F.lit(1).alias("line"), F.lit(0).cast("bigint").alias("ord"))
    nodes, _, _ = H.merge_nodes(declared, derived.filter("false").select(columns), derived)
    return nodes.select("qname", "origin")


@query("SELECT concat('B', o_custkey) AS qname, count(*) - 1 AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def duplicate_names(spark, folder):
    t = corpus.Tables(spark, folder)
    declared = t.orders.select(F.concat(F.lit("B"), "o_custkey").alias("qname"), F.col("o_orderstatus").alias("file"), F.lit(1).alias("line"), F.col("o_orderkey").alias("ord"))
    _, _, duplicates = H.merge_nodes(declared, declared.filter("false"), declared.filter("false"))
    return duplicates.groupBy("qname").agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT DISTINCT n_name FROM nation), w AS (SELECT DISTINCT concat(substr(r_name, 1, 3), n_name) AS wanted FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT wanted, arg_min(n_name, struct_pack(d := levenshtein(wanted, n_name), n := n_name)) AS nearest FROM w, s GROUP BY wanted")
def nearest_name(spark, folder):
    t = corpus.Tables(spark, folder)
    wanted = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.substring("r_name", 1, 3), "n_name").alias("wanted"))
    return N.nearest(wanted, t.nation, "wanted", "n_name")


@query("SELECT doc_id, list_contains(regexp_extract_all(text, '[A-Za-z0-9_]+'), 'the') AS has FROM documents")
def token_occurrence(spark, folder):
    return corpus.Tables(spark, folder).documents.select("doc_id", N.has_token(F.col("text"), F.lit("the")).alias("has"))


_CLAIMS = """e AS (SELECT n_chars, concat('D', doc_id) AS src, concat('T', i) AS dst, CASE i WHEN 0 THEN 'Affects' WHEN 1 THEN 'Triggers' ELSE 'Emits' END AS kind, source AS file, text, CASE i WHEN 0 THEN 'the' WHEN 1 THEN 'and' END AS ident FROM documents, (SELECT unnest([0, 1, 2]) AS i))"""


@query(f"""WITH {_CLAIMS} SELECT src, dst, CASE WHEN kind = 'Emits' OR file = 'src1' THEN 'Unverifiable' WHEN n_chars > 1000 AND kind IN ('Affects', 'Triggers') THEN 'Verified'
WHEN NOT list_contains(regexp_extract_all(text, '[A-Za-z0-9_]+'), ident) THEN 'Contradicted' ELSE 'Unverified' END AS status FROM e""")
def claim_status(spark, folder):
    """Three claims a document: its text is the source's span, identifiers are words."""
    d = corpus.Tables(spark, folder).documents
    table = spark.createDataFrame([("T0", "Affects", "Affects", "the"), ("T1", "Triggers", "Calls", "and"), ("T2", "Emits", "Emits", None)], "dst string, kind string, seen_as string, identifier string")
    every = d.select(F.concat(F.lit("D"), "doc_id").alias("src"), "n_chars", F.col("source").alias("file"), "text").crossJoin(F.broadcast(table))  # three rows
    derived = every.filter("n_chars > 1000 AND dst <> 'T2'").select("src", "dst", F.col("seen_as").alias("kind"))
    scope = d.filter("source <> 'src1'").select(F.col("source").alias("file"))
    spans = d.select(F.concat(F.lit("D"), "doc_id").alias("qname"), F.col("text").alias("span_text"))
    out = L.claim_statuses(every.select("src", "dst", "kind", "file"), derived, scope, table.select(F.col("dst").alias("qname"), "identifier"), spans)
    return out.select("src", "dst", "status")


@query(f"{_WITH} SELECT 'E0201' AS code, qname, clause FROM nodes CROSS JOIN (VALUES ('purpose'), ('owner')) v(clause) WHERE kind = 'module' AND NOT EXISTS (SELECT 1 FROM clauses c WHERE c.qname = nodes.qname AND c.clause = v.clause) UNION ALL SELECT 'E0201', qname, 'purpose' FROM nodes WHERE kind = 'event' UNION ALL SELECT 'W0209', qname, 'purpose' FROM nodes WHERE kind = 'state'")
def missing_clauses(spark, folder):
    g = _graph(spark, folder, "DependsOn")
    found = L.applicability(g).filter("code IN ('E0201', 'W0209')")
    return found.select("code", F.col("node").alias("qname"), F.regexp_extract("message", r"lacks a (\w+) clause", 1).alias("clause"))


@query(f"""{_WITH}, u AS (SELECT DISTINCT src, dst, kind FROM edges WHERE layer = 'Declared' AND kind IN ('Triggers', 'Emits')),
o AS (SELECT u.*, m.qname AS holder FROM u JOIN nodes m ON m.kind = 'module' AND (dst = m.qname OR starts_with(dst, m.qname || '.'))),
f AS (SELECT src, dst, kind, bool_or(src = holder OR starts_with(src, holder || '.') OR EXISTS (SELECT 1 FROM clauses c WHERE clause = 'depends_on' AND value = holder AND (src = c.qname OR starts_with(src, c.qname || '.')))) AS fine FROM o GROUP BY ALL)
SELECT src AS qname, count(*) AS n FROM f WHERE NOT fine GROUP BY src""")
def undeclared_dependency(spark, folder):
    g = _graph(spark, folder, "DependsOn", "Triggers", "Emits")
    declared = IntentGraph(g.nodes, g.edges.filter("kind <> 'Handles'"), g.clauses)
    return L.undeclared_dependencies(declared).groupBy(F.col("node").alias("qname")).agg(F.count("*").alias("n"))


@query(f"""{_WITH}, u AS (SELECT src, dst FROM edges WHERE kind = 'Triggers') SELECT qname, value FROM clauses c WHERE clause = 'depends_on'
AND NOT EXISTS (SELECT 1 FROM u WHERE (src = c.qname OR starts_with(src, c.qname || '.')) AND (dst = c.value OR starts_with(dst, c.value || '.')))
UNION ALL SELECT concat('R', r_regionkey), 'E' FROM region WHERE NOT EXISTS (SELECT 1 FROM edges WHERE kind IN ('Emits', 'Handles') AND starts_with(src, concat('R', r_regionkey, '.')))
UNION ALL SELECT concat('R', r_regionkey), 'P' FROM region""")
def unused_dependency(spark, folder):
    """Besides the dependencies that triggers gave rise to, each region depends on all states (which none affects or reads by declaration) and all events."""
    g = _graph(spark, folder, "DependsOn", "Triggers", "Emits", "Handles")
    more = corpus.Tables(spark, folder).region.select(F.concat(F.lit("R"), "r_regionkey").alias("qname"), F.explode(F.array(F.lit("P"), F.lit("E"))).alias("value"))
    more = more.select("qname", F.lit("depends_on").alias("clause"), F.lit(1).alias("ord"), "value", F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"))
    found = L.unused_dependencies(IntentGraph(g.nodes, g.edges, g.clauses.unionByName(more)))
    return found.select(F.col("node").alias("qname"), F.regexp_extract("message", r"depends on (\S+) but", 1).alias("value"))


@query(f"""{_WITH}, i AS (SELECT dst, bool_or(kind IN ('Affects', 'Reads')) AS used, bool_or(kind = 'Emits') AS emitted, bool_or(kind = 'Handles') AS handled FROM edges GROUP BY dst), more AS (SELECT concat('E.', event_type, '.', k) AS qname, 'event' AS kind, k FROM (SELECT DISTINCT event_type FROM events), (VALUES ('sent'), ('taken')) v(k))
SELECT qname, CASE WHEN kind = 'state' THEN 'W0210' WHEN emitted THEN 'W0211' ELSE 'W0212' END AS code FROM nodes LEFT JOIN i ON dst = qname
WHERE kind = 'state' AND NOT coalesce(used, false) OR kind = 'event' AND coalesce(emitted, false) <> coalesce(handled, false)
UNION ALL SELECT qname, CASE k WHEN 'sent' THEN 'W0211' ELSE 'W0212' END FROM more UNION ALL SELECT DISTINCT concat('P.', p_type), 'W0210' FROM part""")
def hygiene(spark, folder):
    """Besides the graph's own states and events: types of parts as states that nothing uses, and of each event a part that is only sent and one that is only taken."""
    g, t = _graph(spark, folder, "Affects", "Reads", "Emits", "Handles"), corpus.Tables(spark, folder)
    halves = t.events.select("event_type").distinct().select(F.concat(F.lit("E."), "event_type").alias("event"), F.explode(F.array(F.lit("sent"), F.lit("taken"))).alias("k"))
    nodes = halves.select(F.concat_ws(".", "event", "k").alias("qname"), F.lit("event").alias("kind")).unionByName(t.part.select(F.concat(F.lit("P."), "p_type").alias("qname"), F.lit("state").alias("kind")).distinct())
    edges = halves.select(F.lit("E").alias("src"), F.concat_ws(".", "event", "k").alias("dst"), F.when(F.col("k") == "sent", "Emits").otherwise("Handles").alias("kind"))
    return L.hygiene(IntentGraph(g.nodes.unionByName(nodes_of(nodes)), g.edges.unionByName(edges_of(edges)), g.clauses)).select(F.col("node").alias("qname"), "code")


@query(f"{_WITH} SELECT src, dst FROM edges WHERE kind = 'Affects' AND NOT EXISTS (SELECT 1 FROM cust t WHERE t.cust = src AND t.c_acctbal < 0)")
def undeclared_effect(spark, folder):
    """Customers in debt declare all their effects."""
    g = _graph(spark, folder, "Affects")
    debt = g.clauses.filter("clause = 'unknown'").select(F.col("qname").alias("src"))
    declared = g.edges_of("Affects").join(debt, "src", "left_semi").withColumn("layer", F.lit("Declared"))
    found = L.undeclared_effects(IntentGraph(g.nodes, g.edges.unionByName(declared), g.clauses))
    return found.select(F.col("node").alias("src"), F.regexp_extract("message", r"writes (\S+) without", 1).alias("dst"))


_RULES = [("*", ["all"]), ("/en/", ["english"]), ("*.html", ["web"]), ("/de/**", ["german"]), ("/fr/*", [])]
_PATH = r"regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/', ''), '[?#].*$', '')"


@query(f"SELECT page_id, CASE WHEN starts_with(p, 'fr/') AND instr(substr(p, 4), '/') = 0 THEN '' WHEN starts_with(p, 'de/') THEN 'german' WHEN ends_with(p, '.html') THEN 'web' WHEN starts_with(p, 'en/') THEN 'english' ELSE 'all' END AS owner FROM (SELECT page_id, {_PATH} AS p FROM pages)")
def ownership_last_match(spark, folder):
    rules = spark.createDataFrame([(i, N.owner_rule_regex(p), o) for i, (p, o) in enumerate(_RULES)], "ord int, regex string, owners array<string>")
    pages = corpus.Tables(spark, folder).pages.select("page_id", F.expr(_PATH).alias("file"))
    return L.owner_rule(pages, rules).select("page_id", F.concat_ws(",", "owners").alias("owner"))


@query(f"SELECT page_id, CASE WHEN regexp_matches(p, '^[^/]*/[^/]*[.]html$') THEN 'Html' WHEN starts_with(p, 'en/') THEN 'En' WHEN ends_with(p, '/') THEN 'Folder' END AS module, starts_with(p, 'en/') AND (ends_with(p, '/') OR ends_with(p, '.html')) AS ambiguous FROM (SELECT page_id, {_PATH} AS p FROM pages) WHERE regexp_matches(p, '^[^/]*/[^/]*[.]html$') OR starts_with(p, 'en/') OR ends_with(p, '/')")
def module_first_match(spark, folder):
    globs = spark.createDataFrame([(i, N.glob_regex(g), m) for i, (g, m) in enumerate((("*/*.html", "Html"), ("en/**", "En"), ("**/", "Folder")))], "ord int, regex string, module string")
    pages = corpus.Tables(spark, folder).pages.select("page_id", F.expr(_PATH).alias("file"))
    return L.first_glob(pages, globs).filter("module IS NOT NULL").select("page_id", "module", "ambiguous")


@query("SELECT concat('U', user_id) AS qname, arg_max(floor(epoch(ts))::BIGINT, struct_pack(t := floor(epoch(ts))::BIGINT, i := -event_id)) AS time, arg_max(event_type, struct_pack(t := floor(epoch(ts))::BIGINT, i := -event_id)) AS hash FROM events GROUP BY user_id")
def newest_change(spark, folder):
    """Each user's events are a file's lines, blamed with their time and type."""
    e = corpus.Tables(spark, folder).events
    blame = e.select(F.concat(F.lit("f"), "user_id").alias("file"), F.col("event_id").cast("int").alias("line"), F.unix_timestamp("ts").alias("time"), F.col("event_type").alias("hash"))
    spans = e.groupBy("user_id").agg(F.min("event_id").cast("int").alias("line"), F.max("event_id").cast("int").alias("end_line")).select(F.concat(F.lit("U"), "user_id").alias("qname"), F.concat(F.lit("f"), "user_id").alias("file"), "line", "end_line")
    return L.newest_change(spans, blame)


@query("WITH b AS (SELECT user_id, max(floor(epoch(ts))::BIGINT) AS t FROM events WHERE event_id % 2 = 0 GROUP BY user_id), s AS (SELECT user_id, max(floor(epoch(ts))::BIGINT) AS t FROM events WHERE event_id % 2 = 1 GROUP BY user_id) SELECT concat('U', user_id) AS qname FROM b JOIN s USING (user_id) WHERE s.t > b.t")
def staleness(spark, folder):
    """Blocks: the lines of even events; subjects: those of odd ones."""
    e = corpus.Tables(spark, folder).events.select("user_id", F.pmod("event_id", F.lit(2)).alias("odd"), F.unix_timestamp("ts").alias("time"), F.row_number().over(Window.partitionBy("user_id", F.pmod("event_id", F.lit(2))).orderBy("event_id")).alias("line"))
    blame = e.select(F.concat(F.lit("f"), "user_id", F.lit("/"), "odd").alias("file"), "line", "time", F.lit("h").alias("hash"))
    spans = e.groupBy("user_id", "odd").agg(F.min("line").alias("line"), F.max("line").alias("end_line")).select("odd", F.concat(F.lit("U"), "user_id").alias("qname"), F.concat(F.lit("f"), "user_id", F.lit("/"), "odd").alias("file"), "line", "end_line")
    return L.stale(spans.filter("odd = 0"), spans.filter("odd = 1"), blame).select(F.col("node").alias("qname"))


@query(f"{_WITH} SELECT qname AS node, CASE WHEN starts_with(qname, 'R1.N') AND nation.n_nationkey % 2 = 0 THEN 'error' ELSE 'warning' END AS severity FROM clauses JOIN cust ON cust = qname JOIN places USING (nation) JOIN nation ON n_nationkey = nk WHERE clause = 'unknown'")
def strict_promotion(spark, folder):
    """Nations of region 1 with an even key are strict."""
    g = _graph(spark, folder, "DependsOn")
    places = corpus.places(corpus.Tables(spark, folder)).filter("n_regionkey = 1 AND nk % 2 = 0")
    strict = places.select(F.col("nation").alias("qname"), F.lit("enforcement").alias("clause"), F.lit(0).alias("ord"), F.lit("strict").alias("value"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"))
    g = IntentGraph(g.nodes, g.edges, g.clauses.unionByName(strict))
    return L.promote_strict(g, L.unknowns(g)).select("node", "severity")


@query(f"{_WITH} SELECT 'W0213' AS code, 'error' AS severity, count(*) AS n FROM clauses WHERE clause = 'unknown' HAVING count(*) > 0 UNION ALL SELECT 'E0201', 'error', count(*) FROM nodes CROSS JOIN (VALUES ('purpose'), ('owner')) v(clause) WHERE (kind = 'module' OR kind = 'event' AND clause = 'purpose') AND NOT EXISTS (SELECT 1 FROM clauses c WHERE c.qname = nodes.qname AND c.clause = v.clause)")
def policy(spark, folder):
    """Open questions are errors, missing recommended clauses are switched off."""
    g = _graph(spark, folder, "DependsOn")
    found = L.apply_policy(L.unknowns(g).unionByName(L.applicability(g)), unknown="error", off=["W0209"])
    return found.groupBy("code", "severity").agg(F.count("*").alias("n"))


@query(f"{_WITH} SELECT kind, count(*) AS declared, 0 AS derived, 0 AS both, count(*) FILTER (WHERE qname IN (SELECT qname FROM clauses)) AS with_intent FROM nodes GROUP BY kind")
def nodes_by_kind(spark, folder):
    return stats.nodes_by_kind(_graph(spark, folder, "DependsOn"))


@query(f"{_WITH} SELECT layer, count(*) AS n FROM edges GROUP BY layer")
def edges_by_layer(spark, folder):
    return stats.edges_by_layer(_graph(spark, folder))


@query(f"{_WITH} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges")
def totals(spark, folder):
    return stats.totals(_graph(spark, folder))


def _facts(spark, folder):
    """Sources as files: customers declare their nation key's functions; orders call."""
    t = corpus.Tables(spark, folder)
    files = t.nation.select(F.concat(F.lit("f"), "n_nationkey").alias("file"), F.concat(F.lit("M"), "n_nationkey").alias("module"), F.concat(F.lit("p"), "n_regionkey").alias("package"))
    decls = t.customer.select(F.concat(F.lit("f"), "c_nationkey").alias("file"), F.col("c_custkey").alias("idx"), F.concat(F.lit("g"), F.floor(F.col("c_custkey") / 2)).alias("name"), F.lit("function").alias("kind"), F.lit(None).cast("bigint").alias("parent"))
    calls = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.concat(F.lit("f"), "c_nationkey").alias("file"), F.col("o_orderkey").alias("idx"), F.lit("Bare").alias("shape"), F.lit(None).cast("string").alias("obj"), F.concat(F.lit("g"), F.pmod(F.col("o_orderkey"), F.lit(1000))).alias("name"), F.lit(None).cast("bigint").alias("class_decl"), F.col("c_custkey").alias("enclosing"), F.lit(1).alias("line"))
    imports = t.supplier.select(F.concat(F.lit("f"), "s_nationkey").alias("file"), F.col("s_suppkey").alias("idx"), F.lit("Named").alias("form"), F.concat(F.lit("g"), F.pmod("s_suppkey", F.lit(40))).alias("alias"), F.concat(F.lit("f"), F.pmod("s_suppkey", F.lit(25))).alias("target_file"), F.concat(F.lit("g"), F.col("s_suppkey")).alias("name"))
    return files, decls, calls, imports


_FACTS = """f AS (SELECT concat('f', n_nationkey) AS file, concat('M', n_nationkey) AS module, concat('p', n_regionkey) AS package FROM nation),
d0 AS (SELECT concat('f', c_nationkey) AS file, c_custkey AS idx, concat('g', c_custkey // 2) AS name FROM customer),
d1 AS (SELECT d0.*, concat(module, '.', name) AS qname, package, count(*) OVER (PARTITION BY concat(module, '.', name)) AS n FROM d0 JOIN f USING (file)), d AS (SELECT * FROM d1 WHERE n = 1),
c AS (SELECT o_orderkey AS idx, concat('f', c_nationkey) AS file, concat('g', o_orderkey % 1000) AS name FROM orders JOIN customer ON o_custkey = c_custkey),
i AS (SELECT concat('f', s_nationkey) AS file, concat('g', s_suppkey % 40) AS alias, arg_max(concat('f', s_suppkey % 25), s_suppkey) AS target_file, arg_max(concat('g', s_suppkey), s_suppkey) AS name FROM supplier GROUP BY ALL)"""


@query(f"""WITH {_FACTS}, r AS (SELECT c.idx, coalesce(s.qname, t.qname, CASE WHEN (SELECT count(*) FROM d x WHERE x.package = f.package AND x.name = c.name AND x.file <> c.file) = 1 THEN (SELECT min(x.qname) FROM d x WHERE x.package = f.package AND x.name = c.name AND x.file <> c.file) END) AS target,
s.qname IS NOT NULL AS exact FROM c JOIN f ON f.file = c.file LEFT JOIN d s ON s.file = c.file AND s.name = c.name LEFT JOIN i ON i.file = c.file AND i.alias = c.name LEFT JOIN d t ON t.file = i.target_file AND t.name = i.name)
SELECT idx, target, CASE WHEN target IS NULL THEN NULL WHEN exact THEN 'Exact' ELSE 'Resolved' END AS confidence FROM r""")
def call_resolution(spark, folder):
    files, decls, calls, imports = _facts(spark, folder)
    return R.resolve_calls(calls, imports, decls, files).select("idx", "target", "confidence")


@query(f"WITH {_FACTS} SELECT count(*) FILTER (WHERE n > 1) AS ambiguous_names FROM d1")
def ambiguous_names(spark, folder):
    files, decls, _, _ = _facts(spark, folder)
    return R.ambiguous_count(decls, files)


@query("SELECT concat('f', s_nationkey) AS file, concat('g', s_suppkey % 40) AS alias, arg_max(concat('g', s_suppkey), s_suppkey) AS name FROM supplier GROUP BY ALL")
def import_last_wins(spark, folder):
    return R.last_imports(_facts(spark, folder)[3], "Named").select("file", "alias", "name")


@query("SELECT concat('C', o_custkey) AS src, concat('P', l_partkey) AS dst, CASE WHEN l_returnflag = 'R' THEN 'Affects' ELSE 'Reads' END AS kind, arg_min(l_linenumber, struct_pack(f := concat('o', l_orderkey), n := l_linenumber)) AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3")
def touch_first(spark, folder):
    t = corpus.Tables(spark, folder)
    touches = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("C"), "o_custkey").alias("src"), F.concat(F.lit("P"), "l_partkey").alias("dst"), (F.col("l_returnflag") == "R").alias("write"), F.concat(F.lit("o"), "l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), F.lit(0).alias("idx"))
    return R.touch_edges(touches).select("src", "dst", "kind", "line")


def _with_kind(g: IntentGraph, spark, folder) -> IntentGraph:
    """The nations of ASIA as services."""
    t = corpus.Tables(spark, folder)
    asia = corpus.places(t).join(t.region.filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("nation").alias("qname"), F.lit("service").alias("_k"))
    nodes = g.nodes.join(asia, "qname", "left").withColumn("kind", F.coalesce("_k", "kind")).drop("_k")
    return IntentGraph(nodes_of(nodes), g.edges, g.clauses)


def _given(df: DataFrame, clause: str, value: str = "value", qname: str = "cust") -> DataFrame:
    return clauses_of(df.select(F.col(qname).alias("qname"), F.lit(clause).alias("clause"), F.lit(0).alias("ord"), F.col(value).alias("value")))


_ASIA = "asia AS (SELECT concat('R', n_regionkey, '.N', n_nationkey) AS nation FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')"


@query(f"{_WITH}, {_ASIA} SELECT cust AS qname FROM cust WHERE c_acctbal < 0 AND nation NOT IN (SELECT nation FROM asia)")
def stray_routes(spark, folder):
    """Customers in debt have a route; only those in the services of ASIA may."""
    g = _with_kind(_graph(spark, folder, "DependsOn"), spark, folder)
    routes = _given(g.clauses.filter("clause = 'unknown'").withColumn("value", F.lit("/pay")), "route", qname="qname")
    return L.stray_routes(IntentGraph(g.nodes, g.edges, routes)).select(F.col("node").alias("qname"))


@query(f"{_WITH}, {_ASIA}, s AS (SELECT min(nation) AS q FROM asia) SELECT DISTINCT qname FROM clauses, s WHERE clause = 'unknown' AND starts_with(qname, q || '.')")
def unknown_in_service(spark, folder):
    g = _with_kind(_graph(spark, folder, "DependsOn"), spark, folder)
    service = _least(g.of_kind("service"), "qname")
    return g.ask(f"unknown in service({service})").select("qname") if service else spark.createDataFrame([], "qname string")


@query("SELECT concat('U', user_id, '.e', event_id) AS qname FROM events WHERE event_type = (SELECT min(event_type) FROM events)")
def empty_steps(spark, folder):
    """Steps emit what they are, but for those of the first type, which do nothing."""
    e = corpus.Tables(spark, folder).events
    least = e.agg(F.min("event_type").alias("least"))
    acts = e.join(F.broadcast(least), F.col("event_type") > F.col("least")).select(F.concat(F.lit("U"), "user_id", F.lit(".e"), "event_id").alias("qname"), F.concat(F.lit("E."), "event_type").alias("value"))
    nodes = nodes_of(_steps(spark, folder).withColumn("annotated", F.lit(True)))
    return L.empty_steps(IntentGraph(nodes, edges_of(spark.createDataFrame([], "src string")), _given(acts, "emits", qname="qname"))).select(F.col("node").alias("qname"))


@query(f"{_WITH} SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'E0306' ELSE 'E0307' END AS code, cust AS qname, CASE c_mktsegment WHEN 'BUILDING' THEN 'P' END AS nearest FROM cust JOIN customer USING (c_custkey) WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE')")
def bad_references(spark, folder):
    """Customers affect a brand, what doesn't exist (BUILDING) or a module (AUTOMOBILE)."""
    g, t = _graph(spark, folder, "DependsOn"), corpus.Tables(spark, folder)
    brand = t.part.agg(F.min(corpus.brand()).alias("brand"))
    target = F.when(F.col("c_mktsegment") == "BUILDING", "Pq").when(F.col("c_mktsegment") == "AUTOMOBILE", "P").otherwise(F.col("brand"))
    given = corpus.customers(t).join(t.customer.select("c_custkey", "c_mktsegment"), "c_custkey").crossJoin(F.broadcast(brand)).select("cust", target.alias("value"))  # one row
    found = L.bad_references(IntentGraph(g.nodes, g.edges, _given(given, "affects")))
    return found.select("code", F.col("node").alias("qname"), F.nullif(F.regexp_extract("message", r"nearest: (\S+)", 1), F.lit("")).alias("nearest"))


@query(f"{_WITH} SELECT cust AS qname, count(*) AS n FROM edges JOIN cust ON cust = src JOIN supp ON supp = dst WHERE kind = 'Triggers' AND nation = supp_nation GROUP BY cust")
def redundant_triggers(spark, folder):
    """What customers trigger, as references."""
    g = _graph(spark, folder, "Triggers")
    given = _given(g.edges.select(F.col("src").alias("cust"), F.col("dst").alias("value")), "triggers")
    return L.redundant_triggers(IntentGraph(g.nodes, g.edges, given)).groupBy(F.col("node").alias("qname")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT concat('P.', regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) AS qname, 'owner' AS clause FROM part UNION ALL SELECT concat('R', r_regionkey), 'affects' FROM region")
def misplaced_clauses(spark, folder):
    """Brands name an owner, which states inherit; regions affect something, which modules can't."""
    g, t = _graph(spark, folder, "DependsOn"), corpus.Tables(spark, folder)
    owners = _given(t.part.select(corpus.brand().alias("cust")).distinct().withColumn("value", F.lit("me")), "owner")
    affects = _given(t.region.select(F.concat(F.lit("R"), "r_regionkey").alias("cust"), F.lit("P").alias("value")), "affects")
    found = L.applicability(IntentGraph(g.nodes, g.edges, owners.unionByName(affects))).filter("code = 'E0203'")
    return found.select(F.col("node").alias("qname"), F.regexp_extract("message", r"^(\w+) may", 1).alias("clause"))


@query("SELECT n_name AS qname FROM nation WHERE false")
def tagged(spark, folder):
    """Tags are a form of the language that no clause gives an answer to yet."""
    return _graph(spark, folder, "DependsOn").ask('tagged("x")').select("qname")


@query(ORACLES["claim_status"].replace("SELECT src, dst, CASE", "SELECT status, count(*) AS n FROM (SELECT CASE") + ") GROUP BY status")
def claims_by_status(spark, folder):
    claims = claim_status(spark, folder).withColumn("layer", F.lit("Declared"))
    return stats.claims_by_status(IntentGraph(nodes_of(spark.createDataFrame([], "qname string")), edges_of(claims), clauses_of(spark.createDataFrame([], "qname string"))))


@query(f"""WITH {_FACTS}, r AS (SELECT c.idx, c.file, s.qname IS NOT NULL OR t.qname IS NOT NULL OR (SELECT count(*) FROM d x WHERE x.package = f.package AND x.name = c.name AND x.file <> c.file) = 1 AS found
FROM c JOIN f ON f.file = c.file LEFT JOIN d s ON s.file = c.file AND s.name = c.name LEFT JOIN i ON i.file = c.file AND i.alias = c.name LEFT JOIN d t ON t.file = i.target_file AND t.name = i.name)
SELECT count(*) - count(*) FILTER (WHERE found AND d.idx IS NOT NULL) AS unresolved_calls FROM r JOIN orders ON o_orderkey = r.idx LEFT JOIN d ON d.file = r.file AND d.idx = o_custkey""")
def unresolved_calls(spark, folder):
    files, decls, calls, imports = _facts(spark, folder)
    return R.unresolved_count(R.resolve_calls(calls, imports, decls, files), decls, files)


@query("""WITH d0 AS (SELECT concat('f', c_nationkey) AS file, concat('M', c_nationkey) AS module, c_custkey AS idx, concat('g', c_custkey // 2) AS name, c_mktsegment = 'BUILDING' AS inner FROM customer),
d AS (SELECT * FROM (SELECT *, concat(module, '.', name) AS qname, count(*) OVER (PARTITION BY module, name) AS n FROM d0) WHERE n = 1),
c AS (SELECT o_orderkey AS idx, c_nationkey AS nk, concat('f', c_nationkey) AS file, o_orderstatus = 'O' AS attr, CAST(substr(o_orderpriority, 1, 1) AS INT) AS k, concat('g', o_orderkey % 1000) AS name FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT c.idx, d.qname AS target, CASE WHEN d.qname IS NULL THEN NULL WHEN attr THEN 'Resolved' ELSE 'Exact' END AS confidence
FROM c LEFT JOIN d ON d.name = c.name AND d.file = CASE WHEN attr THEN concat('f', (nk + k) % 25) ELSE c.file END AND (attr OR d.inner)""")
def calls_on_objects(spark, folder):
    """Open orders call on an imported file, the others a method of their file's class, in which BUILDING customers are."""
    files, decls, calls, _ = _facts(spark, folder)
    t = corpus.Tables(spark, folder)
    inner = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("idx"), F.lit(True).alias("inner"))
    class_of = lambda file: F.regexp_extract(file, "[0-9]+", 0).cast("bigint") - 1000
    decls = decls.join(inner, "idx", "left").withColumn("parent", F.when(F.col("inner"), class_of("file"))).drop("inner")
    classes = files.select("file", class_of("file").alias("idx"), F.lit("Desk").alias("name"), F.lit("type").alias("kind"), F.lit(None).cast("bigint").alias("parent"))
    order = t.orders.select(F.col("o_orderkey").alias("idx"), (F.col("o_orderstatus") == "O").alias("attr"), F.substring("o_orderpriority", 1, 1).alias("k"))
    calls = calls.drop("shape", "obj", "class_decl").join(order, "idx").withColumn("shape", F.when(F.col("attr"), "Attr").otherwise("Method"))
    calls = calls.withColumn("obj", F.when(F.col("attr"), F.concat(F.lit("m"), "k"))).withColumn("class_decl", F.when(~F.col("attr"), class_of("file"))).drop("attr", "k")
    nation = F.regexp_extract("file", "[0-9]+", 0).cast("int")
    whole = files.select("file", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("idx")).select("file", "idx", F.lit("Whole").alias("form"), F.concat(F.lit("m"), "idx").alias("alias"), F.concat(F.lit("f"), F.pmod(nation + F.col("idx"), F.lit(25))).alias("target_file"), F.lit(None).cast("string").alias("name"))
    return R.resolve_calls(calls, whole, decls.unionByName(classes), files).select("idx", "target", "confidence")


@query("""WITH f AS (SELECT n_nationkey AS nk, r_name AS dir, n_name AS n, concat(r_name, '/', n_name, '.py') AS file FROM nation JOIN region ON n_regionkey = r_regionkey), i AS (SELECT a.file, a.dir, b.dir AS bdir, b.n, b.file AS bfile, form FROM f a CROSS JOIN f b CROSS JOIN (VALUES ('relative'), ('root'), ('beside'), ('package'), ('up')) v(form))
SELECT file, form, n AS wanted, CASE form WHEN 'root' THEN bfile WHEN 'up' THEN bfile WHEN 'package' THEN concat(bdir, '/__init__.py') ELSE CASE WHEN dir = bdir THEN bfile END END AS target_file FROM i""")
def import_paths(spark, folder):
    """Each nation's file imports all of them, as ./x, region.x, x, region and ../region/x."""
    t = corpus.Tables(spark, folder)
    f = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat("r_name", F.lit("/"), "n_name", F.lit(".py")).alias("file"), F.col("r_name").alias("dir"), F.col("n_name").alias("n"))
    forms = F.array(*(F.struct(F.lit(k).alias("form"), m.alias("module")) for k, m in (("relative", F.concat(F.lit("./"), "n")), ("root", F.concat("dir", F.lit("."), "n")), ("beside", F.col("n")), ("package", F.col("dir")), ("up", F.concat(F.lit("../"), "dir", F.lit("/"), "n")))))
    wanted = f.select("n", F.explode(forms).alias("x")).select(F.col("n").alias("wanted"), "x.form", "x.module")
    imports = f.select("file").crossJoin(F.broadcast(wanted)).withColumn("idx", F.xxhash64("form", "wanted"))  # 25 x 125 rows
    files = f.select("file").unionByName(f.select(F.concat("dir", F.lit("/__init__.py")).alias("file")).distinct())
    return R.import_targets(imports, files, [".py"], "__init__").select("file", "form", "wanted", "target_file")


@query("""WITH i AS (SELECT concat('f', s_nationkey) AS file, concat('v', s_suppkey % 3) AS visible, arg_max(s_suppkey % 25, s_suppkey) AS k FROM supplier GROUP BY ALL)
SELECT concat('f', n_nationkey) AS file, n_name AS visible, concat('M', n_nationkey, '.', n_name) AS state FROM nation UNION ALL SELECT file, visible, concat('M', n_nationkey, '.', n_name) FROM i JOIN nation ON n_nationkey = k""")
def visible_states(spark, folder):
    """A state in each nation's file, which suppliers import under other names: the last import counts."""
    t = corpus.Tables(spark, folder)
    files = _facts(spark, folder)[0]
    home = t.nation.select(F.concat(F.lit("f"), "n_nationkey").alias("file"), F.concat(F.lit("M"), "n_nationkey").alias("module"), F.col("n_name").alias("identifier"), F.concat(F.lit("M"), "n_nationkey", F.lit("."), "n_name").alias("state"))
    imports = t.supplier.join(t.nation, F.pmod("s_suppkey", F.lit(25)) == F.col("n_nationkey")).select(F.concat(F.lit("f"), "s_nationkey").alias("file"), F.col("s_suppkey").alias("idx"), F.lit("Named").alias("form"), F.concat(F.lit("v"), F.pmod("s_suppkey", F.lit(3))).alias("alias"), F.concat(F.lit("f"), "n_nationkey").alias("target_file"), F.col("n_name").alias("name"))
    return R.visible_states(home, files, imports)


_MARKED = "regexp_replace(regexp_replace(coalesce(text, ''), '(?m)^A[^\\n]*', '# @intent', 'g'), '(?m)^([B-M])', '#  \\1', 'g')"


@query(f"""WITH t AS (SELECT doc_id, string_split(regexp_replace({_MARKED}, '\\n$', ''), chr(10)) AS s FROM documents), l AS (SELECT doc_id, unnest(range(1, len(s) + 1)) AS line, ltrim(unnest(s), ' ') AS text FROM t),
c AS (SELECT *, CASE WHEN starts_with(text, '#') THEN CASE WHEN substr(text, 2, 1) = ' ' THEN substr(text, 3) ELSE substr(text, 2) END END AS said FROM l),
r AS (SELECT *, sum(CASE WHEN said IS NULL OR before IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS run FROM (SELECT *, lag(said) OVER (PARTITION BY doc_id ORDER BY line) AS before FROM c)),
m AS (SELECT *, rtrim(said, ' ') = '@intent' AS marker, row_number() OVER w = 1 AS first, max(CASE WHEN trim(said, ' ') = '' THEN 1 ELSE 0 END) OVER w = 1 AS ended FROM r WHERE said IS NOT NULL WINDOW w AS (PARTITION BY doc_id, run ORDER BY line)),
b AS (SELECT *, CASE WHEN NOT ended THEN max(CASE WHEN first AND marker THEN line END) OVER (PARTITION BY doc_id, run ORDER BY line) END AS block FROM m)
SELECT doc_id, line, block, marker AND NOT first AND block IS NULL AS ignored FROM b WHERE block IS NOT NULL OR marker""")
def marked_lines(spark, folder):
    """Documents as sources: lines that begin with A are markers, those with B to M comments."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?md)^A[^\n]*", "# @intent"), r"(?md)^([B-M])", "#  $1")
    d = corpus.Tables(spark, folder).documents
    found = S.marked_lines(d.select(F.concat("doc_id", F.lit(".py")).alias("file"), text.alias("text")))
    long = lambda c: F.col(c).cast("bigint").alias(c)
    return found.filter("block IS NOT NULL OR ignored").select(F.regexp_extract("file", "[0-9]+", 0).cast("bigint").alias("doc_id"), long("line"), long("block"), "ignored")
