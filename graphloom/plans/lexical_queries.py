"""Queries of the lexical scan over source files that the part table generates: one file of each of several kinds for every part."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.plans.registering import Registry
from graphloom.session import table
from graphloom.sources import lexical
from graphloom.sources.files import DECLARATIONS

FOUND = Registry()

#: Files by p_partkey % 4, with K for the key and N for p_partkey % 5 repeats of the line in angle brackets.
SOURCES = (
    (".ts", "// class Fake {\nexport class AK {\n  text = \"}}{{ class No {\"\n<  x = `${ {a: '}'} } class Nor {`\n>}\nexport function runK(a = { b: 1 }) {\n  if (a) {\n    return /[}]/\n  }\n}\n"),
    (".py", 'class PK:\n    """class No:"""\n<    x = "{"  # class Nor:\n>    def mK(self):\n        return [\n1]\ndef gK(): pass\n'),
    (".rb", "class RK\n<  # end\n>  def goK\n    while x do\n      y 'end'\n    end\n  end\nend\n"),
    (".java", 'public class JK {\n  /* class No { */\n<  String s = "}";\n>}\ninterface IK {}\n'),
)


def sources(spark, d):
    k = F.col("p_partkey")
    n, text = (k % 5).cast("int"), F.lit(None).cast("string")
    for i, (ext, code) in enumerate(SOURCES):
        before, rest = code.split("<")
        line, after = rest.split(">")
        text = F.when(k % 4 == i, F.concat(F.lit(before), F.repeat(F.lit(line), n), F.lit(after))).otherwise(text)
    kind = F.element_at(F.array(*[F.lit(ext) for ext, _ in SOURCES]), (k % 4 + 1).cast("int"))
    # K stands for the key where it ends a name
    return table(spark, d, "part").select(F.concat(F.lit("src/f"), k.cast("string"), kind).alias("path"), F.regexp_replace(text, r"(?<=\b(?:A|run|P|m|g|R|go|J|I))K\b", k.cast("string")).alias("content"))


@FOUND("symbol_blocks", """SELECT 'src/f' || k || ext AS path, kind, name || k AS name, CAST(a + an * n AS INTEGER) AS start_line, CAST(b + bn * n AS INTEGER) AS end_line, container || k AS container
FROM (SELECT p_partkey AS k, p_partkey % 5 AS n FROM part) p, (VALUES (0, '.ts', 'class', 'A', 2, 0, 4, 1, NULL), (0, '.ts', 'function', 'run', 5, 1, 9, 1, NULL), (1, '.py', 'class', 'P', 1, 0, 5, 1, NULL), (1, '.py', 'function', 'm', 3, 1, 5, 1, 'P'), (1, '.py', 'function', 'g', 6, 1, 6, 1, NULL),
(2, '.rb', 'class', 'R', 1, 0, 7, 1, NULL), (2, '.rb', 'function', 'go', 2, 1, 6, 1, 'R'), (3, '.java', 'class', 'J', 1, 0, 3, 1, NULL), (3, '.java', 'interface', 'I', 4, 1, 4, 1, NULL)) v(m, ext, kind, name, a, an, b, bn, container) WHERE k % 4 = m""")
def symbol_blocks(spark, d):
    return lexical.symbol_blocks(lexical.lexed(sources(spark, d)), DECLARATIONS).drop("language")


def modules(spark, d):
    """A module for every part: an import over several lines, one in a comment, a re-export, a dynamic import, a package, and two declarations."""
    k = F.col("p_partkey")
    s, next_one = k.cast("string"), (k + 1).cast("string")
    names = F.repeat(F.lit("  type T,\n"), (k % 3).cast("int"))
    text = F.concat(
        F.lit("import {\n"), names, F.lit("  run"), next_one, F.lit(",\n  hidden"), next_one, F.lit(" as h\n} from './m"), next_one, F.lit("'\n// import no from './no'\nexport * from './m1'\nconst d = import('./m"), s,
        F.lit("')\nimport pkg from \"pkg"), (k % 7).cast("string"), F.lit("\"\nimport * as up from '../m0.ts'\nexport function run"), s, F.lit("() {}\nfunction hidden"), s, F.lit("() { import x from './late' }\n"),
    )
    parts = table(spark, d, "part").select("p_partkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # a small file of keys makes much text
    return parts.select(F.concat(F.lit("src/m"), s, F.lit(".ts")).alias("path"), text.alias("content"))


@FOUND("import_facts_multiline", """WITH p AS (SELECT p_partkey AS k, p_partkey % 3 AS n FROM part), f AS (
SELECT k, n, 'import' AS form, './m' || (k + 1) AS specifier, 1 AS a, 4 + n AS b, 2 + n AS bindings, CASE WHEN EXISTS (SELECT 1 FROM part WHERE p_partkey = k + 1) THEN 'src/m' || (k + 1) || '.ts' END AS target, CASE WHEN NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = k + 1) THEN 'missing-module' END AS reason FROM p
UNION ALL SELECT k, n, 'reexport', './m1', 6 + n, 6 + n, 0, NULL, 'unsupported-reexport' FROM p UNION ALL SELECT k, n, 'dynamic', './m' || k, 7 + n, 7 + n, 0, NULL, 'dynamic-import' FROM p
UNION ALL SELECT k, n, 'import', 'pkg' || k % 7, 8 + n, 8 + n, 1, NULL, 'external-module' FROM p UNION ALL SELECT k, n, 'import', '../m0.ts', 9 + n, 9 + n, 1, NULL, 'missing-module' FROM p
UNION ALL SELECT k, n, 'import', './late', 11 + n, 11 + n, 1, NULL, 'invalid-syntax' FROM p)
SELECT 'src/m' || k || '.ts' AS path, form, specifier, CAST(a AS INTEGER) AS start_line, CAST(b AS INTEGER) AS end_line, CAST(bindings AS INTEGER) AS bindings, target, reason FROM f""")
def import_facts_multiline(spark, d):
    files = modules(spark, d)
    return lexical.module_imports(lexical.kept(lexical.lexed(files), "path", "imports"), files).select("path", "form", "specifier", "start_line", "end_line", F.size("bindings").alias("bindings"), "target", "reason")


@FOUND("bound_names", """WITH p AS (SELECT p_partkey AS k FROM part a WHERE EXISTS (SELECT 1 FROM part b WHERE b.p_partkey = a.p_partkey + 1))
SELECT 'src/m' || k || '.ts' AS path, 'run' || (k + 1) AS imported, 'run' || (k + 1) AS local, false AS type_only, 'run' || (k + 1) AS symbol, NULL AS reason FROM p
UNION ALL SELECT 'src/m' || k || '.ts', 'hidden' || (k + 1), 'h', false, NULL, 'unresolved-export' FROM p
UNION ALL SELECT 'src/m' || k || '.ts', 'T', 'T', true, NULL, 'unresolved-export' FROM p, range(k % 3)""")
def bound_names(spark, d):
    files = modules(spark, d)
    scanned = lexical.kept(lexical.lexed(files))
    return lexical.bound_names(lexical.module_imports(scanned, files), scanned, lexical.symbol_blocks(scanned, DECLARATIONS)).drop("target")
