"""Functions and their documentation: lexers, delimiting, triviality and the match with units."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from seamark.llm import lexing as LX
from seamark.llm import pairs as P

SRC = "source_id long, repo string, path string, source_hash string, body string, lang string, tokens int, i int"
UNIT = "unit_id long, source_id long, source_hash string, kind string, start_byte long, end_byte long, doc string"

RUST = """use a::b;

/// Splits the é at the end and hands on the pieces.
#[inline]
pub fn split<'a>(x: &'a str) -> String {
    let c = '{'; /* nested /* } */ { */
    let r = r#"}"{"#;
    format!("}}{{")
}

impl T {
    // plain
    fn plain(&self) { }
    /// TODO
    fn todo(&self, a: [u8; 3]) -> u8 { a[0] }
    #[doc = "Counts what is left in the open drawer."]
    pub(crate) async fn count(&self) {}
    /** Gives the oldest one back. */
    fn decl(&self);
}
"""
PY = '''import os

class A:
    """Docs of the class only."""

    @cached
    def f(self, x):
        # fmt: off
        """Reads the oldest line
        and returns it."""
        s = """
def no(): {
"""
        return {1: 2}
        # trailing

    def g(self):
        s = 1
        """Not a docstring at all here."""

async def h(a,
            b): return "Never a docstring of mine"

def k():
    r"""Waits for the lock and then leaves."""

def one(): "Tells whether the door is open now."
'''
TS = """class A {
  /** Reads the last open row from disk. */
  private async load<T>(a: Map<string, { x: number }>): Promise<{ y: T }> {
    const re = /[{(]+x/g;
    const t = `{ ${[1].map((v) => `<${v}>`).join("}")} `;
    if (a) { return null; }
  }
  /* Not documentation at all. */
  plain(): void { }
}

/** Orders the rows by their age in days. */
export const order = (a: string[]): string | null => {
  return a.map((x) => ({ id: x })).length ? null : null;
};

/** Adds up what the rows weigh in total. */
export function sum(a: number[]): number { return 0; }
/** The rows of a shelf by their number. */
const SHELF = { a: 1 };
"""
GO = """package a

// Reads the oldest file first.
// And the newest last.
func read(x map[string]interface{}) interface{} {
	s := `}`
	r := '{'
	return func() { _ = "}" }
}

// Detached comment about something else.

func bare() {}

//go:noinline
func inlined() {}

/* Closes every open file of the run. */
func (t *T) Close() {}
"""


def found(spark, path, text, spans=None):
    body = text.encode()
    src = spark.createDataFrame([(1, "r", path, "h", text, "x", 1, 2)], SRC)
    f = P.function_rows(P.token_rows(src)).collect()
    return {r["name"]: (body[r["head"] : r["end"]].decode(), (r["doc"] or "").strip()) for r in f}


def test_rust(spark):
    f = found(spark, "a.RS", RUST)
    assert set(f) == {"split", "plain", "todo", "count", "decl"}
    assert f["split"][0].startswith("pub fn split") and f["split"][0].endswith('format!("}}{{")\n}') and f["split"][1].startswith("Splits the é")
    assert f["plain"][1] == "" and f["todo"][1] == "TODO" and f["count"][1] == "Counts what is left in the open drawer." and f["decl"][1] == "Gives the oldest one back."


def test_python(spark):
    f = found(spark, "a.py", PY)
    assert set(f) == {"f", "g", "h", "k", "one"}
    assert f["f"][0].endswith("# trailing") and f["f"][1].startswith("Reads the oldest line") and f["g"][1] == ""
    assert f["h"][1] == "" and f["k"][1].startswith("Waits") and f["one"][1].startswith("Tells")


def test_typescript(spark):
    f = found(spark, "a.ts", TS)
    assert set(f) == {"load", "plain", "order", "sum"}
    assert f["load"][1].startswith("Reads the last") and f["load"][0].endswith("return null; }\n  }") and f["plain"][1] == ""
    assert f["order"][1].startswith("Orders the rows") and f["sum"][1].startswith("Adds up")


def test_go(spark):
    f = found(spark, "a.go", GO)
    assert set(f) == {"read", "bare", "inlined", "Close"}
    assert f["read"][0].endswith('}" }\n}') and f["read"][1].startswith("Reads the oldest") and f["bare"][1] == ""
    assert f["Close"][1].startswith("Closes every")


@pytest.mark.parametrize(
    ("doc", "name", "tells"),
    [
        ("Idempotent; skips open files.", "f", True), ("Newest open file first.", "f", True), ("Raises if the door is open.", "check_door_open", True), ("Reúne los símbolos abiertos.", "f", True),
        ("FIXME later. Drops rows whose key is gone.", "f", True), ("@param x the number of rows that are kept\n@returns", "f", True), (None, "f", False), ("", "f", False), ("  \n ", "f", False), ("----", "f", False),
        ("TODO: write something proper about this one.", "f", False), ("open_door()", "open_door", False), ("Opens the door.", "openDoor", False), ("This function is used to open a door.", "open_door", False),
        ("@param {string} länge\n@return {void}", "f", False), ("Args:\n    x: int\n    y:\nReturns:", "f", False), ("Parameters\n----------\nx : str\n", "f", False), ("# Arguments\n\n* `x`\n\n# Returns", "f", False),
        ("Licensed under the MIT licence, see the file.", "f", False), ("Generated by the build, do not edit.", "f", False), ("noqa: E501", "f", False), ("helper", "f", False), ("Placeholder.", "f", False), ("{@inheritDoc}", "f", False),
        ("Please describe what this function does here.", "f", False), ("Lorem ipsum.", "f", False), ("N/A", "f", False), ("Internal helper function.", "f", False),
    ],
)
def test_triviality(spark, doc, name, tells):
    d = spark.createDataFrame([(doc, name)], "doc string, name string")
    assert d.select(P.says_something(F.col("doc"), F.col("name")).alias("x")).first()["x"] is tells


def test_units(spark):
    body = RUST.encode()
    a, head, end = body.index(b"///"), body.index(b"pub fn"), body.index(b"}\n\nimpl") + 1
    attr, impl = body.index(b"#[inline"), body.index(b"impl")
    units = [
        (1, 1, "h", "body", a, end, None), (1, 1, "h", "body", a, end, None), (2, 1, "h", None, head, end, None), (3, 1, "h", "x", attr, end + 2, None), (4, 1, "h", "file", 0, len(body), None), (5, 1, "old", "body", a, end, None),
        (6, 1, "h", "body", None, end, None), (7, 1, "h", "body", a, None, None), (8, 1, "h", "body", head + 4, end, None), (9, 1, "h", "parent", impl, len(body), None), (10, 9, "h", "body", a, end, None), (11, 2, "h", "body", a, end, None),
    ]
    src = spark.createDataFrame([(1, "r", "a.rs", "h", RUST, "x", 1, 2), (1, "r", "a.rs", "h", RUST, "x", 1, 2), (2, "r", "b.rs", "h", None, "x", 1, 2), (3, None, None, None, "fn x() {}", None, None, None), (4, "r", "c.py", "h", "", None, 0, 0)], SRC)
    u = spark.createDataFrame(units, UNIT)
    assert sorted(r["unit_id"] for r in P.documented_units(src, u).collect()) == [1, 2, 3]
    code = {r["unit_id"]: r for r in P.code_pairs(src, u).collect()}
    assert code[2]["code"].startswith("pub fn split") and code[1]["code"].startswith("/// Splits the é") and code[1]["description"].startswith("Splits")
    assert P.documented_units(src.limit(0), u).count() == 0 and P.documented_units(src, u.limit(0)).count() == 0


def test_many_functions_and_truncated_files():
    text = "".join(f"/// Gives back row number {i} of it.\nfn f{i}() {{ if a {{ }} }}\n" for i in range(5000))
    assert sum(r[0] == LX.HEAD for r in LX.lex(text, "rust")) == 5000
    for lang, text in (("rust", RUST), ("python", PY), ("ts", TS), ("go", GO)):
        for cut in range(0, len(text), 7):
            LX.lex(text[:cut], lang)
        LX.lex(text.replace("\n", "\r\n"), lang)
        LX.lex("", lang), LX.lex("\0", lang), LX.lex("\"" * 999, lang)


def test_comments_at_the_top_of_a_block_lead_its_first_method(spark):
    body = 'class A:\n    # noqa\n    def f(self):\n        # first\n        """Closes the open drawer again."""\n        return 1\n\n    # second\n    def g(self):\n        """Opens the closed drawer again."""\n'
    src = spark.createDataFrame([(1, "r", "a.py", "h", body, None, 0, 0)], SRC)
    lead, head, end = body.index("# noqa"), body.index("def f"), body.index("return 1") + len("return 1")
    lead2, end2 = body.index("# second"), len(body) - 1
    units = spark.createDataFrame([(1, 1, "h", "body", lead, end, None), (2, 1, "h", "body", head, end, None), (3, 1, "h", "body", lead2, end2, None), (4, 1, "h", "body", body.index("# first"), end, None)], UNIT)
    assert {r["unit_id"] for r in P.documented_units(src, units).collect()} == {1, 2, 3}
