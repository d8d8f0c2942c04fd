"""Source files to extract from, with the expected elements marked in the text.

``⟦f|name⟧`` marks a function, c a call, i an import, s a string, q a string that
names an import. ``~`` stands for a key that is filled in per file. Nothing outside
the marks may be taken for an element.
"""

from __future__ import annotations

import re

LANGUAGES = ["python", "javascript", "typescript", "go", "java", "csharp", "rust", "php"]

TEMPLATES = {
    "python": '''import ⟦i|os⟧, ⟦i|pkg.mod_~⟧, numpy as np
from ⟦i|lib.core⟧ import a, b
from . import sibling

class ⟦f|Svc_~⟧(Base):
    ⟦s|"""Doc ~."""⟧
    @app.⟦c|route⟧(⟦s|"/u/~"⟧)
    async def ⟦f|load_~⟧(self, x):  # not a call("here")
        if (x): return ⟦c|len⟧(x)
        é = ⟦s|r'\\d é~'⟧; cur.⟦c|execute⟧(⟦s|"SELECT 1 WHERE id = "⟧ + x)
        return not (x) and self.⟦c|helper_~⟧(⟦s|b"v"⟧)
''',
    "javascript": '''import def, { a as b } from ⟦q|'mod_~'⟧;
import ⟦q|"side-effect"⟧;
export * from ⟦s|'./other'⟧
// skipped(); "comment ~"
function ⟦f|load_~⟧(x) { return ⟦c|helper_~⟧(x).⟦c|catch⟧(e => { throw new Error(⟦s|'no'⟧) }) }
const arrow = async (x) => x / 2 + fn2 / 3, re = /["'(]~/g;
class K extends Base { ⟦f|delete⟧(a) { if (a) { this.x?.⟦c|write⟧(`t ${⟦c|inner_~⟧(a)} "q"`) } }
  static async ⟦f|run_~⟧() { for (const i of ⟦c|list⟧()) { ⟦c|fetch⟧(⟦s|"/u?q=~"⟧) } } }
function* walk(x) { function* inner() { yield ⟦c|step_~⟧(x) } if (x) /["']/.⟦c|test⟧(⟦s|'b'⟧); ⟦c|after_~⟧(⟦s|"x"⟧) }
class P { #hidden(a) { return ⟦c|shown⟧(a) } ⟦f|open_~⟧() { return `a ${⟦c|outer⟧(`c ${⟦c|deep_~⟧(⟦s|"{"⟧, `e`)}`)} d ${⟦c|tail⟧({a: 1})}` } }
const o = { ⟦f|m1⟧(v) { return new Date(v) }, p: function (z) { return ⟦c|require⟧(⟦s|'fs'⟧) } }
''',
    "typescript": '''import type { A } from ⟦q|'./types_~'⟧
export interface Api { get(id: string): void; load<T>(x: T): T }
export async function ⟦f|load_~⟧(x: string): Promise<string> { return ⟦c|helper_~⟧<T>(x) }
function overload(x: string): void;
while (x) /[/"]~/.⟦c|exec⟧(y); ⟦c|next_~⟧(`n ${⟦c|t1⟧(`m`)}`)
class H<T> implements Api {
  constructor_ = ⟦c|make⟧(⟦s|"k~"⟧)
  ⟦f|constructor⟧(private readonly x: number) { super(x) }
  public ⟦f|handle_~⟧(req: Req): Res { return this.api.⟦c|get⟧(req!.url as string) }
  abstract later(x: number): string;
}
''',
    "go": '''package main

import (
	⟦q|"fmt"⟧ // std
	x ⟦q|"net/http~"⟧
)

type Doer interface {
	Do(x int) error
}

func ⟦f|load_~⟧(w io.Writer, id string) (int, error) {
	/* skipped("x") */ rows, err := db.⟦c|Query⟧(⟦s|"SELECT ~"⟧ + id)
	r := '"'; go func() { ⟦c|helper_~⟧(⟦s|`raw~`⟧) }()
	if (x) { return ⟦c|len⟧(rows), nil }
	b := []byte(⟦s|"x~"⟧); m := map[string]int(b); var _ = [4]int(m)
	k := b[0]
	⟦c|plain_~⟧(k, fns[0](1))
	return nil
}
func (s *Srv[T]) ⟦f|Start_~⟧() error { return http.⟦c|Get⟧(⟦s|"~"⟧) }
''',
    "java": '''package a.b;
import ⟦i|java.sql.Conn_~⟧;
import static ⟦i|org.x.Assert.that⟧;
import ⟦i|java.util⟧.*;
@Path(⟦s|"/x"⟧) public class D_~ extends B {
  private final List<String> l = new ArrayList<>(⟦c|size⟧());
  public ⟦f|D_~⟧() { super(1); }
  @Override public int ⟦f|load_~⟧(String id) throws E { if (id == null) { return ⟦c|helper_~⟧(id); }
    stmt.⟦c|executeQuery⟧(⟦s|"SELECT ~"⟧ + id); char c = '"'; return new a.b.Thing(id).⟦c|run⟧(); }
  abstract Map<String, Integer> ⟦f|all⟧();
  <T extends A<B>> List<T> ⟦f|typed_~⟧() { stmt.<Integer>⟦c|execute⟧(); return a.b.Collections.<Map<String, List<T>>>⟦c|emptyList⟧(); }
  public <K> ⟦f|D_~⟧(K k) { this.<K>⟦c|keep_~⟧(k); }
  enum Color { RED(1), GREEN(2); }
}
''',
    "csharp": '''using ⟦i|System⟧;
using System.Text;
using static ⟦i|Helpers_~⟧;
namespace N { [Route(⟦s|"api/~"⟧)]
public class S_~ : Base {
  public ⟦f|S_~⟧(int x) : base(x) { }
  public async Task<int> ⟦f|Get_~⟧(string id) { var c = new SqlCommand(⟦s|"SELECT 1"⟧ + id); return c.⟦c|ExecuteReader⟧(); }
  [HttpGet(⟦s|"q"⟧)] public int ⟦f|Calc⟧(int a) => ⟦c|Helper_~⟧(a, $"n {⟦c|Fmt⟧(a)}", @"v ""~""");
  void ⟦f|Outer⟧() { int Local(int z) { return z; } if (ok) { ⟦c|Local⟧(1); } x?.Skip(2); }
} }
''',
    "rust": '''use ⟦i|std::process::Command⟧;
pub use ⟦i|crate::m_~::{a, b as c}⟧;
#[derive(Debug)] enum E { V(i32), W(String) }
pub fn ⟦f|load_~⟧<'a>(x: &'a str) -> Option<i32> {
    let out = Command::new(⟦s|"sh~"⟧).⟦c|arg⟧(x).⟦c|output⟧();
    println!(⟦s|"{} ~"⟧, skipped(x)); // no("call")
    if let Some(v) = ⟦c|helper_~⟧(r#"raw "~" "#, '"') { return ⟦c|Some⟧(v.parse::<i32>()) }
    match x { Ok(y) => ⟦c|run⟧(y), _ => vec![no(1)] }
}
''',
    "php": '''<h1>it's "text"</h1>
<?php
namespace App;
use ⟦i|App\\Models\\User_~⟧;
use Single;
function ⟦f|load_~⟧($id) { // skipped('x')
  $r = ⟦c|mysqli_query⟧($c, ⟦s|"SELECT ~"⟧ . $id); $f($id); echo(1); include(⟦s|''⟧);
}
class C { use T; public static function ⟦f|show_~⟧($id) { $this->raw($id); DB::raw($id); ⟦c|exec⟧(⟦s|'ls ~'⟧); return new Foo($id); } }
⟦c|trim⟧(⟦s|"plain { brace ~ {$b} "⟧ . ⟦s|"{$c->d}"⟧);
# more('y')
?> tail text("z") <?= ⟦c|h⟧(⟦s|'e'⟧) ?>
''',
}

_MARK = re.compile(r"⟦([a-z])\|(.*?)⟧", re.S)
_KINDS = {"f": ["function"], "c": ["call"], "i": ["import"], "s": ["string"], "q": ["string", "import"]}


def source(language: str) -> str:
    """The file, with ``~`` for the key."""
    return _MARK.sub(lambda m: m.group(2), TEMPLATES[language])


def expected(language: str) -> list[tuple]:
    """(kind, ordinal, name, row, column, keys before it in its line), byte columns without the keys."""
    rows, counters = [], {}
    for row, line in enumerate(TEMPLATES[language].split("\n")):
        at, plain = 0, ""
        for mark in _MARK.finditer(line):
            plain += line[at:mark.start()]
            name = mark.group(2)
            for kind in _KINDS[mark.group(1)]:
                ordinal = counters[kind] = counters.get(kind, -1) + 1
                rows.append((kind, ordinal, name, row, len(plain.replace("~", "").encode()), plain.count("~")))
            plain += name
            at = mark.end()
    return rows
