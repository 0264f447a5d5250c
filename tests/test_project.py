import json
import subprocess

import pytest

from intentloom import project, server
from intentloom.__main__ import main
from intentloom.plans.query import QueryError
from intentloom.sources.extract import python_facts

SVC = '''# @intent
# purpose: "money"
ledger = {}

# @intent
balances = {}

# @intent
# affects: Pay.ledger
# reads: Pay.balances, Pay.balancez
# triggers: User.notify
def charge():
    ledger.update(a=1)
    return notify


def audit():
    charge()
    balances["x"] = 1
'''


def make(tmp_path):
    for name, text in {"intent.toml": 'name = "p"\n[modules]\n"src/pay/**" = "Pay"\n"src/user/**" = "User"\n', "src/pay/svc.py": SVC, "src/user/n.py": "# @intent\ndef notify():\n    pass\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)


def test_project(spark, tmp_path, capsys):
    make(tmp_path)
    g = project.load(spark, str(tmp_path))
    origin = {r["qname"]: r["origin"] for r in g.nodes.collect()}
    assert origin == {"Pay": "Declared", "User": "Declared", "Pay.ledger": "Declared", "Pay.balances": "Declared", "Pay.charge": "Both", "Pay.audit": "Derived", "User.notify": "Both"}
    status = {(r["dst"]): r["status"] for r in g.edges.filter("layer = 'Declared'").collect()}
    assert status == {"Pay.ledger": "Verified", "Pay.balances": "Contradicted", "User.notify": "Unverified"}
    assert [r["qname"] for r in g.ask("affects*(Pay.ledger)").collect()] == ["Pay.audit", "Pay.charge"]
    assert [r["qname"] for r in g.ask("affects(Pay.balances)").collect()] == ["Pay.audit"]
    codes = {(r["code"], r["line"]) for r in g.findings.collect()}
    assert {("E0306", 10), ("W0302", 10), ("E0304", 11), ("W0209", 6)} <= codes
    assert main(["lint", "--root", str(tmp_path)]) == 1 and "E0306" in capsys.readouterr().out
    assert main(["ask", "affects(Pay.ledgr)", "--root", str(tmp_path)]) == 2 and main(["ask"]) == 2
    assert main(["init", "--root", str(tmp_path)]) == 0 and '"src/**" = "Src"' in capsys.readouterr().out


def test_history_stale_clash_and_options(spark, tmp_path, capsys, monkeypatch):
    make(tmp_path)
    git = lambda *a, **kw: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True, **kw)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "first", env={"GIT_COMMITTER_DATE": "2024-01-01T00:00:00Z", "PATH": "/usr/bin:/bin"})
    svc = tmp_path / "src/pay/svc.py"
    svc.write_text(svc.read_text().replace("    return notify", "    return notify, 1") + "\n\n# @intent\ndef charge():\n    pass\n")
    git("add", ".")
    git("commit", "-qm", "second", env={"GIT_COMMITTER_DATE": "2024-02-01T00:00:00Z", "PATH": "/usr/bin:/bin"})
    root = ["--root", str(tmp_path)]
    g = project.load(spark, str(tmp_path), check_stale=True)
    monkeypatch.setattr(project, "load", lambda *a, **kw: g)  # the same project for all commands
    assert main(["lint", "--human", *root]) == 1
    out = capsys.readouterr().out
    assert "warning W0301: Pay.charge changed after its block" in out and "error E0305: the name Pay.charge is taken" in out
    assert main(["history", "Pay.charge", *root]) == 0
    told = json.loads(capsys.readouterr().out)
    assert [c["message"] for c in told["commits"]] == ["second", "first"] and told["location"]["file"] == "src/pay/svc.py"
    assert main(["ask", "path(Pay.charge, Pay.ledger)", "--all", "--max-len", "2", *root]) == 0
    *hits, last = capsys.readouterr().out.splitlines()
    assert json.loads(hits[0])["hops"] == 1 and json.loads(last) == {"unresolved": ["Pay.balancez"]}
    assert main(["dot", "--focus", "User.notify", *root]) == 0 and "Pay.ledger" not in capsys.readouterr().out
    assert main(["scan", *root]) == 0 and '"qname":"Pay.ledger"' in capsys.readouterr().out


def test_no_manifest_and_internal_errors(tmp_path, monkeypatch, capsys):
    assert main(["lint", "--root", str(tmp_path)]) == 2 and "E0402" in capsys.readouterr().err
    monkeypatch.setattr(project, "propose_manifest", lambda root: 1 / 0)
    assert main(["init", "--root", str(tmp_path)]) == 3 and "internal error" in capsys.readouterr().err


def test_server():
    def bad(args):
        raise QueryError("no such thing")

    tools = {"ask": lambda a: iter([a["query"].upper()]), "lint": lambda a: iter(["x", "y"]), "history": bad, "stats": lambda a: iter([])}
    say = lambda **m: json.loads(server.handle(json.dumps({"jsonrpc": "2.0", "id": 1} | m), tools))
    call = lambda name, **args: say(method="tools/call", params={"name": name, "arguments": args})
    assert say(method="initialize")["result"]["serverInfo"]["name"] == "intentloom"
    assert [t["name"] for t in say(method="tools/list")["result"]["tools"]] == ["ask", "lint", "history", "stats"]
    assert call("ask", query="a")["result"] == {"content": [{"type": "text", "text": "A"}], "isError": False}
    assert call("history", qname="q")["result"]["isError"] and call("lint")["result"]["content"][0]["text"] == "x\ny"
    assert call("ask")["error"]["code"] == call("ask", query=1)["error"]["code"] == call("none")["error"]["code"] == -32602
    assert say(method="nothing")["error"]["code"] == -32601 and say(jsonrpc="1")["error"]["code"] == -32600
    assert json.loads(server.handle("{", tools))["error"]["code"] == -32700
    assert server.handle('{"jsonrpc": "2.0", "method": "notifications/initialized"}', tools) is None


@pytest.mark.parametrize("text,names", [("def f(x=g(), *, y=h()):\n    pass", ["g", "h"]), ("class A(make(), metaclass=meta()):\n    pass", ["make", "meta"]), ("def f(x: t(1)) -> u():\n    pass", ["t", "u"]), ("@d()\ndef f():\n    g()", ["d", "g"])])
def test_calls_in_defaults_bases_and_annotations(text, names):
    assert [r["name"] for r in python_facts("a.py", text) if r["fact"] == "call"] == names


def test_annotated_construction_is_a_method_call():
    rows = python_facts("a.py", "class K:\n    def go(self):\n        pass\n\ndef f():\n    k: K = K()\n    k.go()\n")
    assert [r["shape"] for r in rows if r["fact"] == "call"] == ["Bare", "Method"]
