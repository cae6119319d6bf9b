"""The lexical scan on code whose strings, comments, templates and patterns hold brackets and keywords."""

from graphloom.sources.files import DECLARATIONS
from graphloom.sources.lexical import Scan, bound_names, lexed, module_imports, symbol_blocks

CODE = {
    "src/a.ts": """// import {x} from './no'
import def, {
  a as b,
  type C,
} from './multi'
import * as ns from "../src/ns";
import type { T } from './types';
import './side';
export { q } from './re'
const s = "class Foo { }", t = `x ${ {a: `}`} } import z from './zz'`
export class A {
  m() { return /[{}]\\/"/.test("}") }
}
export default function run(a = { x: 1 }) {
  if (a) { const r = await import('./dyn'); require(name) }
}
function f(x: number): void;
abstract class Q {
}
export { Q as B, f }
const q = a / b; /* } */ const w = 1 / 2
import { late } from '../../out'; import up from './a.css'
""",
    "src/multi.ts": "class M {}\nexport default class N {}\nexport { M as a }\nexport interface C {}\n",
    "src/ns/index.ts": "", "src/ns.js": "", "src/types.tsx": "export type T = 1", "src/side.mjs": "",
    "src/b.py": 'import os\nclass A:\n    """doc { class B: """\n    def m(self, x=(1,\n        2)):\n        if x:\n            return "def no():"\n        # def c():\n\n    def n(self): pass\ndef g():\n    return {\n  1: 1}\nx = 1\n',
    "src/c.rs": "fn a<'x>(c: char) -> bool { c == '{' || c == '\\'' }\npub struct S {\n x: &'static str }\nfn b() {\n let r = r#\"}}\"{{\"#;\n}\n",
    "src/d.go": "func Do() {\n x := `}`\n}\ntype T struct {\n}\n", "src/e.cs": 'public class C {\n string s = @"}\\";\n}\n', "src/f.cpp": 'class K {\n auto s = R"x(}})x";\n};\n',
    "src/g.php": "class P {\n  function go() {\n    # }\n    return '}';\n  }\n}\n", "src/h.kt": 'class H {\n  fun go() {\n    val s = """}"""\n  }\n}\n', "src/i.rb": "class R\n  def go(x)\n    x.each do |q|\n      if q then 1 end\n    end\n    a if b\n  end\nend\n",
    "src/open.ts": "class U {\n  m() {", "src/cut.ts": "class V { /* }", "src/close.ts": "}}) class W {\n}", "src/n.txt": "class X {}",
}


def test_symbols_and_modules(spark):
    df = spark.createDataFrame([*CODE.items(), ("src/null.ts", None)], "path string, content string").repartition(3)
    scanned = lexed(df)
    symbols = symbol_blocks(scanned, DECLARATIONS)
    got = {(r.path.split("/")[-1], r.name): (r.start_line, r.end_line, r.container) for r in symbols.collect()}
    want = {
        ("a.ts", "A"): (11, 13, None), ("a.ts", "f"): (17, 17, None), ("a.ts", "Q"): (18, 19, None), ("b.py", "A"): (2, 10, None), ("b.py", "m"): (4, 7, "A"), ("b.py", "n"): (10, 10, "A"), ("b.py", "g"): (11, 13, None),
        ("c.rs", "a"): (1, 1, None), ("c.rs", "S"): (2, 3, None), ("c.rs", "b"): (4, 6, None), ("d.go", "Do"): (1, 3, None), ("d.go", "T"): (4, 5, None), ("e.cs", "C"): (1, 3, None), ("f.cpp", "K"): (1, 3, None),
        ("g.php", "P"): (1, 6, None), ("g.php", "go"): (2, 5, "P"), ("h.kt", "H"): (1, 5, None), ("h.kt", "go"): (2, 4, "H"), ("i.rb", "R"): (1, 8, None), ("i.rb", "go"): (2, 7, "R"),
        ("multi.ts", "M"): (1, 1, None), ("open.ts", "U"): (1, 2, None), ("cut.ts", "V"): (1, 1, None),
    }
    assert got == want
    imports = module_imports(scanned, df)
    found = {(r.specifier, r.start_line): (r.form, r.end_line, r.target, r.reason, r.type_only) for r in imports.collect()}
    assert found == {
        ("./multi", 2): ("import", 5, "src/multi.ts", None, False), ("../src/ns", 6): ("import", 6, None, "ambiguous-module", False), ("./types", 7): ("import", 7, "src/types.tsx", None, True), ("./side", 8): ("import", 8, "src/side.mjs", None, False),
        ("./re", 9): ("reexport", 9, None, "unsupported-reexport", False), ("./dyn", 15): ("dynamic", 15, None, "dynamic-import", False), (None, 15): ("require", 15, None, "unsupported-commonjs", False),
        ("../../out", 22): ("import", 22, None, "outside-project", False), ("./a.css", 22): ("import", 22, None, "missing-module", False),
    }
    names = {(r.imported, r.local): (r.symbol, r.reason, r.type_only) for r in bound_names(imports, scanned, symbols).collect()}
    assert names == {("default", "def"): (None, "unresolved-export", False), ("a", "b"): ("M", None, False), ("C", "C"): (None, "unresolved-export", True), ("T", "T"): (None, "unresolved-export", True)}


def test_long_inputs_take_linear_time():
    import time

    for text in ("{" * 100_000, "/" * 100_000, "`${" * 30_000, "import " * 20_000, "'\\" * 50_000, "export {" * 20_000, "(" * 50_000 + ")" * 50_000, "import {" + "a, " * 50_000 + "} from './x'"):
        began = time.perf_counter()
        s = Scan(text, "typescript")
        list(s.lines())
        from graphloom.sources.lexical import module_facts

        module_facts(s)
        assert time.perf_counter() - began < 5, text[:10]


def test_a_file_is_scanned_once_and_no_scan_goes_through_the_driver(spark, sf_dir):
    import __spark_entry__ as entry

    for name, scans in (("bound_names", 1), ("import_facts_multiline", 0)):  # the file scan is written by then; what is left reads each file's symbols
        plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and plan.count("MapInArrow") == scans, plan


def test_a_path_twice_and_what_a_base_may_stand_for(spark):
    files = [("src/m.ts", "import './x'\nimport './y.ts'\nimport './z'\nimport './d'\nimport './q.js'\nimport './t.d'"), ("src/x.ts", ""), ("src/x.ts", ""), ("src/y.ts.ts", ""), ("src/z", ""), ("src/d/index.tsx", ""), ("src/d.mjs", ""), ("src/q.js/index.ts", ""), ("src/t.d.ts", "class A {}")]
    df = spark.createDataFrame(files, "path string, content string")
    got = {r.specifier: (r.target, r.reason) for r in module_imports(lexed(df), df).collect()}
    assert got == {"./x": (None, "file-collision"), "./y.ts": (None, "missing-module"), "./z": (None, "unsupported-language"), "./d": (None, "ambiguous-module"), "./q.js": (None, "missing-module"), "./t.d": ("src/t.d.ts", None)}
