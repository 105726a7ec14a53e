"""Units, imports, calls and outlines of languages with braces, and Python's."""

from __future__ import annotations

import time

import pytest

from seamark.functions import code as C
from seamark.operators import documents as DO

RUST = '''//! top
use a::b::{self, c as d, e::*, f};
use std::fmt;
use g as _;

/// Doc of S
#[derive(Debug)]
pub struct S { a: u8 }

pub enum E { A, B(u8), C { x: u8 } }

impl<T> fmt::Display for S {
    /// doc
    pub fn show(&self) -> String { let x = "}"; if a { foo(1) } assert_eq!(x, y); x.bar::<u8>() }
    fn two();
}
mod m { fn inner() { } const X: u8 = 1; }
macro_rules! mm { () => {} }
pub(crate) async fn solo<'a>(x: &'a str) -> u8 { 1 }
type T = u8;
'''
TS = '''import def, { a as b, type c } from "x/y";
import * as ns from './z';
const fs = require("lib/fs.js");
/** doc */
export class K extends Q {
  private x = 1;
  /** m doc */
  async run(a: number): Promise<void> { if (a) { go(a); } }
  get v() { return 1 }
}
export const f = (x: number): number => { return g(x) };
export const h = async y => y;
export interface I { a: string }
export type U = { a: 1 };
enum Z { One, Two = 2 }
export default function main() { const s = `}${a}`; }
'''
GO = '''package p

import (
	"fmt"
	x "a/b"
	_ "c/d"
)

// Doc
type S struct {
	a int
}

const K = 1
var V = 2

// Run runs.
func (s *S) Run(a int) error { return fmt.Errorf("}", a) }
func Free[T any](a T) {
	go func() { run(a) }()
}
'''
JAVA = '''package a;
import x.y.Z;
public class A extends B {
    /** d */
    @Override
    public int f(List<String> a) { return g(a); }
    A() { }
    enum E { X, Y }
}
interface I { void m(); }
'''
CPP = '''#include "x/y.h"
namespace n {
struct S { int a; };
static int f(int a, char *b) { if (a) { return g(a); } return 0; }
}
'''


OTHERS = {
    "ruby": ("require 'a/b'\n# def no\nmodule M\n  class K < Q\n    # doc\n    def run(a)\n      if a\n        go\n      end\n    end\n    def self.x?\n      'def y'\n    end\n  end\nend\n", "mod M,class M::K,method M::K::run,method M::K::x?", ["b"]),
    "lua": ("local m = require('a.b')\nlocal function f(a)\n  if a then\n    g()\n  end\nend\nm.h = function()\nend\n-- function no()\n", "fn f,fn m.h", ["b"]),
    "elixir": ("defmodule A.B do\n  alias C.D\n  def f(x) do\n    x\n  end\n  defp g, do: 1\n  defmacro m(a) do\n  end\nend\n", "mod A.B,fn A.B.f,fn A.B.g,macro A.B.m", ["D"]),
    "haskell": ("module M where\nimport qualified Data.Map as Map\nimport Data.List\ndata T = A | B\n  deriving Show\nclass C a where\n  op :: a -> a\nf :: Int -> Int\nf x = x\n", "enum T,class C,fn C.op,fn f", ["Map", "List"]),
    "fsharp": ("module M\nopen A.B\ntype T =\n  | X\n  member this.Go() = 1\nlet rec f x =\n  x + 1\n(* let no = 1 *)\n", "mod M,type T,method T.Go,fn f", ["B"]),
    "vbnet": ("Imports X = A.B\nImports C.D\nPublic Class K\n  ' Sub no()\n  Public Sub Go()\n    Run()\n  End Sub\nEnd Class\n", "class K,method K.Go", ["X", "D"]),
    "bash": ("source lib/x.sh\nrun() {\n  go # }\n}\nfunction other {\n  a\n}\n", "fn run,fn other", ["x"]),
    "perl": ("package A::B;\nuse strict;\nuse C::D;\nsub f {\n  return '}';\n}\n", "mod A::B,fn f", ["D"]),
    "powershell": ("Import-Module ./a/b.psm1\nfunction Get-It($x) {\n  <# } #>\n  $x\n}\nclass K {\n}\n", "fn Get-It,class K", ["b"]),
    "csharp": ("using A.B;\nnamespace N {\n  public class K : Q {\n    public int F(int a) { return G(a); }\n    K() { }\n  }\n  struct S { }\n}\n", "mod N,class N.K,method N.K.F,method N.K.K,struct N.S", ["B"]),
    "swift": ("import Foundation\nstruct S {\n    func f(_ a: Int) -> Int { return a }\n}\nextension S {\n    func g() {}\n}\n", "struct S,method S.f,impl S,method S.g", ["Foundation"]),
    "scala": ("import a.b.C\ntrait T {\n  def f(x: Int): Int = x\n}\nobject O {\n  def g() = {\n    1\n  }\n}\n", "interface T,method T.f,class O,method O.g", ["C"]),
    "php": ("<?php\nuse A\\B as C;\nclass K {\n  public function f() { return '}'; }\n}\nfunction g() {}\n", "class K,method K.f,fn g", ["C"]),
    "dart": ("import 'a/b.dart';\nclass K {\n  int f(int a) { return g(a); }\n}\nvoid main() { }\n", "class K,method K.f,fn main", []),
    "kotlin": ("import a.b.C\nclass A(val x: Int) {\n    fun f(a: Int): Int { return a }\n}\nfun g() = 1\n", "class A,method A.f,fn g", ["C"]),
}


@pytest.mark.parametrize("family", sorted(OTHERS))
def test_units_of_other_languages(family):
    text, units, imports = OTHERS[family]
    got = C.code_units(text, family)
    assert ",".join(f"{u.kind} {u.qname}" for u in got) == units
    assert C.code_imports(text, family) == imports and C.balanced(text, family)
    assert all(0 <= u.start < u.end <= len(text) and (u.parent < 0 or (got[u.parent].start <= u.start and u.end <= got[u.parent].end)) for u in got)


@pytest.mark.parametrize(
    ("text", "family", "units", "imports", "calls"),
    [
        (RUST, "rust", "struct S,enum E,variant E::A,variant E::B,variant E::C,impl S,method S::show,method S::two,mod m,fn m::inner,const m::X,macro mm,fn solo,type T", ["b", "d", "f", "fmt"], {"foo": 1, "assert_eq": 1, "bar": 1}),
        (TS, "ts", "class K,method K.run,method K.v,fn f,fn h,interface I,type U,enum Z,variant Z.One,variant Z.Two,fn main", ["def", "b", "c", "ns", "fs"], {"require": 1, "go": 1, "g": 1}),
        (GO, "go", "type S,const K,static V,method S.Run,fn Free", ["fmt", "x"], {"Errorf": 1, "run": 1}),
        (JAVA, "java", "class A,method A.f,method A.A,enum A.E,interface I,method I.m", ["Z"], {"g": 1}),
        (CPP, "c", "mod n,struct n::S,fn n::f", ["y"], {"g": 1}),
    ],
)
def test_units_imports_and_calls(text, family, units, imports, calls):
    assert ",".join(f"{u.kind} {u.qname}" for u in C.code_units(text, family)) == units
    assert C.code_imports(text, family) == imports
    got = C.code_calls(text, family)
    assert {k: v for k, v in got.items() if k != "go"} == {k: v for k, v in calls.items() if k != "go"}


def test_units_begin_at_their_comments_and_end_at_their_block():
    u = {x.qname: RUST[x.start : x.end] for x in C.code_units(RUST, "rust")}
    assert u["S"].startswith("impl<T>") or u["S"].startswith("/// Doc of S\n#[derive(Debug)]\npub struct S {")
    assert u["S::show"].startswith("/// doc\n    pub fn show") and u["S::show"].endswith("x.bar::<u8>() }") and u["solo"].endswith("{ 1 }")
    go = {x.qname: GO[x.start : x.end] for x in C.code_units(GO, "go")}
    assert go["S"] == "// Doc\ntype S struct {\n\ta int\n}" and go["K"] == "const K = 1" and go["S.Run"].startswith("// Run runs.\nfunc")


def test_offsets_are_bytes_and_units_nest():
    text = "// é€\nmod a {\n    // ü\n    fn f() { let s = \"ß\"; }\n}\n"
    body = text.encode()
    units = DO.units_of("x.rs", text)
    assert [(u[0], u[2], body[u[3] : u[4]].decode()[:6]) for u in units] == [("mod", "a", "// é€\n"), ("fn", "a::f", "// ü\n ")]
    assert all(units[u[5]][3] <= u[3] and u[4] <= units[u[5]][4] for u in units if u[5] >= 0)


def test_parsed_flag_and_names():
    assert DO.parsed_of("a.py", "import os\nX = 1\n") and not DO.parsed_of("a.py", "def (") and DO.parsed_of("a.md", "") and DO.parsed_of("a.txt", "x") is None
    assert DO.parsed_of("a.rs", "fn f() { }") and not DO.parsed_of("a.rs", "fn f() { ") and not DO.parsed_of("a.go", "x" * (DO.MOST_PARSED + 1))
    long = "".join(f"{' ' * i}class {'k' * 60}{i}:\n" for i in range(8)) + " " * 8 + "def own(): pass\n"
    name = DO.python_units(long)[-1][2]
    assert len(name.encode()) <= DO.MOST_QNAME and name.endswith(".own")
    assert [(u[0], u[2], u[5]) for u in DO.python_units("A = 1\nclass B:\n    C = 2\n    def f(self):\n        def g(): pass\nif x:\n    def h(): pass\n")] == [("static", "A", -1), ("class", "B", -1), ("method", "B.f", 1), ("function", "B.f.g", 2), ("function", "h", -1)]


def test_python_imports_and_calls():
    text = "import a.b as c, d.e\nfrom m import (x as y,\n  z)\nfrom q import *\ny(1); c.f(2); z()\n"
    assert [x for (x,) in DO.imports_of("a.py", text)] == ["c", "e", "y", "z"]
    assert dict(DO.calls_of("a.py", text)) == {"x": 1, "f": 1, "z": 1}


def test_outlines_of_braces():
    text = "fn f() {\n    a;\n    b;\n    c;\n    d;\n}\nfn g() {\n    a;\n}\n"
    assert DO.outline_of("a.rs", text) == "fn f() {\n    … 4 lines\n}\nfn g() {\n    a;\n}\n"


def test_time_is_linear():
    took = []
    for n in (500, 4000):
        t = time.perf_counter()
        assert len(C.code_units("class A {\n" + "  f(a) { if (a) { g(a); } }\n" * n + "}\n", "ts")) == n + 1
        assert len(DO.python_units("class A:\n" + "    def f(self):\n        return 1\n" * n)) == n + 1
        took.append(time.perf_counter() - t)
    assert took[1] < 30 * took[0] + 0.5
