"""Languages with braces: a lexer that knows strings and comments, declarations, facts."""

import pytest

from intentloom.sources import braces as B

TS = """import { a as b } from "./m";
import * as util from "../util";
// function no() {}
export const totals = new Map<string, number>();
export function bill(
  x: number,
): void {
  const t = `a } ${ fmt("}") } b {`;
  totals.set("k", x);
  b(x); util.run(t);
}
class K {
  run(a: string): void { this.stop(); }
  stop() { bill(1); }
}
"""
GO = """package p

import (
	"fmt"
	q "a/b/c"
)

var Total = map[string]int{
	"a": 1,
}

func Bill(
	x int,
) error {
	fmt.Println("}{")
	Total["a"] = 2
	return nil
}

func (k *K) Run() { Bill(`}`) }
"""
JAVA = """package a.b;
import a.c.Util;
public class Till {
    private static final Map<String, Integer> totals = new HashMap<>();
    @Override
    public void bill(int x,
                     String y) throws E {
        totals.put("}", x);
        Util.send(y);
    }
    void audit() { String s = \"\"\"
      }{ \"\"\"; }
}
"""
RUST = """use crate::till::{self, record as r};
static mut TOTALS: Vec<u8> = Vec::new();
/* outer /* inner } */ } */
pub async fn bill<'a>(x: &'a str) -> u8 {
    let c = '}';
    let s = r#"}"#;
    TOTALS.push(1);
    r(x); till::send();
    1
}
impl K { fn run(&self) { bill("a"); } }
"""
DECLARED = {
    "a.ts": (TS, [(4, 4, "totals", "state"), (5, 11, "bill", "function"), (12, 15, "K", "type"), (13, 13, "run", "function"), (14, 14, "stop", "function")]),
    "a.go": (GO, [(8, 10, "Total", "state"), (12, 18, "Bill", "function"), (20, 20, "Run", "function")]),
    "A.java": (JAVA, [(3, 13, "Till", "type"), (4, 4, "totals", "state"), (5, 10, "bill", "function"), (11, 12, "audit", "function")]),
    "a.rs": (RUST, [(2, 2, "TOTALS", "state"), (4, 10, "bill", "function"), (11, 11, "run", "function")]),
}
CALLS = {"a.ts": ["fmt", "totals.set", "b", "util.run", "stop", "bill"], "a.go": ["fmt.Println", "Bill"], "A.java": ["totals.put", "Util.send"], "a.rs": ["TOTALS.push", "r", "till.send", "bill"]}
WRITTEN = {"a.ts": "totals", "a.go": "Total", "A.java": "totals", "a.rs": "TOTALS"}
IMPORTED = {"a.ts": [("Named", "./m", "b"), ("Whole", "../util", "util")], "a.go": [("Whole", "fmt", "fmt"), ("Whole", "a/b/c", "q")], "A.java": [("Whole", "a.c.Util", "Util")], "a.rs": [("Named", "crate", "till"), ("Whole", "crate::till", "till"), ("Named", "crate::till", "r"), ("Whole", "crate::till::record", "r")]}


@pytest.mark.parametrize("file", DECLARED)
def test_declarations_and_facts(file):
    text, want = DECLARED[file]
    assert B.line_declarations(text, "." + file.rpartition(".")[2]) == want
    rows = B.facts(file, text)
    calls = [f"{r['obj']}.{r['name']}" if r["obj"] else r["name"] for r in rows if r["fact"] == "call" and r["name"] not in ("new", "HashMap", "Map")]
    assert calls == CALLS[file]
    assert [(r["form"], r["module"], r["alias"]) for r in rows if r["fact"] == "import"] == IMPORTED[file]
    assert any(r["fact"] == "touch" and r["name"] == WRITTEN[file] and r["write"] for r in rows)


@pytest.mark.parametrize("language", ["ts", "go", "java", "rust"])
def test_blanked_keeps_places(language):
    import random

    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choices(["{", "}", '"', "'", "`", "${", "//", "/*", "*/", "\\", "\n", "a", " ", 'r#"', '"#', '\"\"\"'], k=rng.randint(0, 40)))
        bare = B.blanked(text, language)
        assert len(bare) == len(text) and [i for i, c in enumerate(bare) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]
        B.facts("x." + {"ts": "ts", "go": "go", "java": "java", "rust": "rs"}[language], text)
