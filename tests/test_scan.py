import random
import subprocess

import pytest
from pyspark.sql import functions as F

from intentloom import sinks
from intentloom.functions.names import glob_regex, normal_path, owner_rule_regex
from intentloom.operators import clauses as C
from intentloom.operators import lint as L
from intentloom.operators import resolution as R
from intentloom.operators import scan as S
from intentloom.sources import extract, files

from .graphs import build

SOURCE = '''"""doc"""
# @intent
# kind: module
# name: Pay
# purpose: "all
#   payments"

# @intent
# owner: "x"
# triggers: User.notify, Pay.audit
# unknwn: "?"
def charge():
    ghost()

# plain comment
# @intent
# reads: Pay.x
balance = 0

# @intent
# name: lonely
'''


def test_clauses():
    good, bad = C.parse([(1, 'purpose: "a \\"b\\" \\x"'), (2, "affects: A.b, C"), (3, 'route: POST "/x"'), (4, 'purpose: "again"'), (5, "reads: A.b, 9"), (6, "nonsense"), (7, "ownr: x"), (8, "enforcement: strict"), (9, 'because: "two'), (10, 'lines"')])
    assert [(c, v) for c, _, v, _ in good] == [("purpose", 'a "b" \\x'), ("affects", "A.b"), ("affects", "C"), ("route", "POST /x"), ("enforcement", "strict"), ("because", "two\nlines")]
    assert [(c, n) for c, n, _ in bad] == [("E0206", 4), ("E0207", 5), ("E0207", 6), ("E0202", 7)]


def test_scan(spark):
    sources = spark.createDataFrame([("src/pay/svc.py", SOURCE), ("x/y.py", "# @intent\n# owner: \"o\"\nclass K:\n    pass\n"), ("src/flow.ts", "// @intent\n// kind: workflow\n// name: Flow\n// purpose: \"p\"\n\n// @intent\n// kind: step\n// name: one\n// emits: A.B\n"), ("z/step.go", "// @intent\n// kind: step\n// name: s\nfunc Go() {\n}\n"), ("e.py", None)], "file string, text string")
    globs = spark.createDataFrame([(0, glob_regex("src/pay/**"), "Billing"), (1, glob_regex("src/**"), "Src")], "ord int, regex string, module string")
    nodes, clauses, findings = S.scan(sources, globs)
    got = {r["qname"]: r for r in nodes.collect()}
    assert set(got) == {"Pay", "Pay.charge", "Pay.lonely", "_orphan.K", "Flow", "Flow.one"}
    assert got["Pay.charge"]["subject_line"] == 12 and got["Pay.charge"]["identifier"] == "charge" and got["_orphan.K"]["kind"] == "type"
    said = {(r["qname"], r["clause"], r["value"]) for r in clauses.collect()}
    assert ("Pay", "purpose", "all\n  payments") in said and ("Pay.charge", "triggers", "Pay.audit") in said
    codes = {(r["code"], r["file"]) for r in findings.collect()}
    assert codes == {("E0202", "src/pay/svc.py"), ("W0110", "src/pay/svc.py"), ("E0103", "src/pay/svc.py"), ("W0208", "x/y.py"), ("E0105", "z/step.go")}


def test_python_facts_and_resolution(spark):
    app = "from helpers import run\nimport store\ncounter = 0\nclass K:\n    def go(self):\n        pass\ndef bump():\n    global counter\n    counter += 1\n    store.items.append(2)\ndef show():\n    return counter\ndef driver():\n    bump()\n    run()\n    ghost()\n    k = K()\n    k.go()\n    (lambda: bump())()\n"
    sources = spark.createDataFrame([("src/app.py", app), ("src/helpers.py", "def run():\n    pass\n"), ("src/store.py", "items = []\n"), ("src/bad.py", "def (")], "file string, text string")
    f = extract.facts(sources).cache()
    assert f.filter("fact = 'unparsed'").count() == 1
    table = spark.createDataFrame([("src/app.py", "app", None), ("src/helpers.py", "helpers", None), ("src/store.py", "store", None)], "file string, module string, package string")
    imports = R.import_targets(f.filter("fact = 'import'"), table, [".py"], "__init__", ["src"])
    decls, calls = f.filter("fact = 'decl'"), f.filter("fact = 'call'")
    resolved = R.resolve_calls(calls.select("file", "idx", "shape", "obj", "name", "class_decl", "enclosing", "line"), imports, decls, table)
    got = {(r["src"], r["dst"], r["confidence"]) for r in R.call_edges(resolved, decls, table).collect()}
    assert got == {("app.driver", "app.bump", "Exact"), ("app.driver", "helpers.run", "Resolved"), ("app.driver", "app.go", "Exact")}
    assert R.unresolved_count(resolved, decls, table).first()[0] == calls.count() - 3
    states = spark.createDataFrame([("src/app.py", "app", "counter", "app.counter"), ("src/store.py", "store", "items", "store.items")], "file string, module string, identifier string, state string")
    visible = R.visible_states(states, table, imports)
    names = R.unambiguous(decls, table).filter("kind = 'function'").select("file", F.col("idx").alias("enclosing"), F.col("qname").alias("src"))
    touches = f.filter("fact = 'touch'").select("file", F.col("name").alias("visible"), "write", "enclosing", "line", "idx").join(visible, ["file", "visible"]).join(names, ["file", "enclosing"]).withColumnRenamed("state", "dst")
    assert {(r["src"], r["dst"], r["kind"]) for r in R.touch_edges(touches).collect()} == {("app.bump", "app.counter", "Affects"), ("app.bump", "store.items", "Affects"), ("app.show", "app.counter", "Reads")}


def test_paths_and_globs(spark):
    import re

    for pattern, yes, no in (("src/*.py", "src/a.py", "src/b/a.py"), ("src/**/a.py", "src/x/y/a.py", "srcx/a.py"), ("**/t?.py", "a/t1.py", "a/t12.py")):
        assert re.match(glob_regex(pattern), yes) and not re.match(glob_regex(pattern), no)
    for pattern, yes, no in (("*.py", "a/b.py", "a/b.ts"), ("/docs/", "docs/x/y", "a/docs/x"), ("docs/", "a/docs/x", "docs"), ("src/pay", "src/pay/x.py", "a/src/pay")):
        assert re.match(owner_rule_regex(pattern), yes) and not re.match(owner_rule_regex(pattern), no)
    paths = spark.createDataFrame([("a/./b/../c",), ("../x",), ("a//b",)], "p string")
    assert [r[0] for r in paths.select(normal_path(F.col("p"))).collect()] == ["a/c", "../x", "a/b"]


def test_ownership_and_staleness(spark):
    rules = files.ownership_rules(spark, ["* @org/all", "# c", "/src/pay/ @org/payments-team  # note", "src/free"])
    assert rules.count() == 3
    blame = spark.createDataFrame([("f", 1, 10, "a"), ("f", 2, 20, "b"), ("f", 3, 20, "c")], "file string, line int, time bigint, hash string")
    spans = lambda a, b: spark.createDataFrame([("Q", "f", a, b)], "qname string, file string, line int, end_line int")
    assert L.newest_change(spans(1, 3), blame).first()["hash"] == "b"
    assert L.stale(spans(1, 1), spans(2, 3), blame).count() == 1 and L.stale(spans(2, 2), spans(3, 3), blame).count() == 0 and L.stale(spans(8, 9), spans(2, 3), blame).count() == 0


def test_newest_change_by_blamed_lines(spark):
    """Long spans over few blamed lines; nested, inverted, single and empty ones against a search of all pairs."""
    ddl = "qname string, file string, line int, end_line int"
    blame = spark.createDataFrame([("f", 1, 10, "a"), ("f", 2**31 - 1, 20, "b"), ("g", 7, 5, "c")], "file string, line int, time bigint, hash string")
    long = spark.createDataFrame([("Q", "f", 1, 2**31 - 1), ("R", "f", -(2**31), 2**31 - 2), ("S", "g", 7, 7), ("T", "g", 8, None), ("U", "h", 1, 9)], ddl)
    assert sorted(tuple(r) for r in L.newest_change(long, blame).collect()) == [("Q", 20, "b"), ("R", 10, "a"), ("S", 5, "c")]
    draw = random.Random(5)
    lines = [(f"f{k}", i, draw.randrange(9), f"h{k}.{i}") for k in range(3) for i in range(-40, 200) if draw.random() < 0.5]
    spans = [(f"q{i}", f"f{draw.randrange(4)}", a := draw.randrange(-50, 210), a + draw.choice([0, 1, 2, 7, 8, 31, 90, -5])) for i in range(200)]
    want = {}
    for q, file, a, b in spans:
        if held := [(t, -i, h) for f, i, t, h in lines if f == file and min(a, b) <= i <= max(a, b)]:
            want[q] = (max(held)[0], max(held)[2])
    got = L.newest_change(spark.createDataFrame(spans, ddl), spark.createDataFrame(lines, blame.schema)).collect()
    assert len(got) == len(want) and {r["qname"]: (r["time"], r["hash"]) for r in got} == want


def test_claim_statuses(spark):
    edges = spark.createDataFrame([("a", "s", "Affects", "f"), ("a", "t", "Affects", "f"), ("a", "u", "Reads", "f"), ("b", "s", "Reads", "g"), ("a", "e", "Emits", "f"), ("c", "s", "Reads", "f"), ("a", "w", "Triggers", "f")], "src string, dst string, kind string, file string")
    derived = spark.createDataFrame([("a", "s", "Affects"), ("a", "w", "Calls")], "src string, dst string, kind string")
    ids = spark.createDataFrame([("s", "ledger"), ("t", "led"), ("u", None)], "qname string, identifier string")
    spans = spark.createDataFrame([("a", "x = ledger + 1")], "qname string, span_text string")
    got = {(r["src"], r["dst"]): r["status"] for r in L.claim_statuses(edges, derived, spark.createDataFrame([("f",)], "file string"), ids, spans).collect()}
    assert got == {("a", "s"): "Verified", ("a", "t"): "Contradicted", ("a", "u"): "Unverified", ("b", "s"): "Unverifiable", ("a", "e"): "Unverifiable", ("c", "s"): "Unverified", ("a", "w"): "Verified"}


def test_manifest():
    good = files.read_manifest('name = "p"\nroots = ["src"]\n[modules]\n"b/**" = "B"\n"a/**" = "A"\n[policy]\nunknown = "error"\n[lint]\nW0213 = "off"\n')
    assert list(good["modules"]) == ["b/**", "a/**"]
    for text, code in (("nam = 1", "E0401"), ("name = 1", "E0403"), ("[policy]\nunknown = 'x'", "E0403"), ("[lint]\nE0306 = 'off'", "E0401"), ("[", "E0403")):
        with pytest.raises(files.ManifestError) as e:
            files.read_manifest(text)
        assert e.value.code == code


def test_git_and_tree(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@y", *a], check=True, capture_output=True)
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\ny = 2\n")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/b.py").write_text("no")
    (tmp_path / "src/c.py").write_bytes(b"\xff\xfe")
    run("init", "-q")
    run("add", "src/a.py")
    run("commit", "-qm", "first")
    tree = files.source_tree(spark, str(tmp_path))
    assert [r["file"] for r in tree.collect()] == ["src/a.py"]
    rows = files.blame(tree, str(tmp_path)).collect()
    assert [r["line"] for r in rows] == [1, 2] and len(rows[0]["hash"]) == 40
    assert files.history(str(tmp_path), "src/a.py", 1, 1)[0][3] == "first"
    times = spark.createDataFrame([(1767323045, "+0000"), (0, "-0130")], "t bigint, z string")
    assert [r[0] for r in times.select(files.iso_time(F.col("t"), F.col("z"))).collect()] == ["2026-01-02T03:04:05+00:00", "1969-12-31T22:30:00-01:30"]
    seen = []
    cached = lambda: files.with_cache(tree, f"{tmp_path}/cache", "1", lambda d: (seen.append(d.count()), extract.facts(d))[1]).count()
    assert cached() == cached() and seen == [1, 0]


def test_sinks(spark):
    g = build(spark)
    assert any('"Cash" -> "Cash.journal"' in x for x in sinks.dot(g))
    assert '"code":"E0306"' in "".join(r[0] for r in sinks.findings_json(g.findings).collect())
    lines = [r[0] for r in sinks.answer_json(g, g.ask("affects*(Cash.journal)")).collect()]
    assert len(lines) == 5 and '"kind":"Emits"' in lines[-1]


def test_streamed_scan(spark, tmp_path):
    from intentloom.streaming.scan import latest, scan_arrivals

    schema = "file string, text string"
    spark.createDataFrame([("x/y.py", "# @intent\n# owner: \"o\"\nclass K:\n    pass\n")], schema).write.parquet(f"{tmp_path}/in/1")
    globs = spark.createDataFrame([(0, glob_regex("x/**"), "X")], "ord int, regex string, module string")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    scan_arrivals(stream, globs, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    spark.createDataFrame([("x/y.py", "# @intent\n# owner: \"o\"\nclass L:\n    pass\n")], schema).write.parquet(f"{tmp_path}/in/2")
    scan_arrivals(stream, globs, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    nodes = spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/out/nodes")
    assert nodes.count() == 2 and [r["qname"] for r in latest(nodes).collect()] == ["X.L"]
