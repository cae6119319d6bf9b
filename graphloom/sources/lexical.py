"""A lexical scan of source files: blocks, symbols with their ends and containers, module imports and exports.

One pass over each file's characters, in Arrow batches, blanks comments and the insides of strings and pairs brackets on a stack. What
stands where, and what belongs to what, is then found by patterns and joins. What a scan gives has no size that the planner could know,
and is many times the files' own: its joins are merge joins, as a broadcast would go through the driver.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.keys import MODULE_EXTENSIONS, language
from graphloom.session import Scratch

#: Kinds of tokens by language: comments, strings, and what opens or closes. A string that is not closed ends with its line.
QUOTED = r"\"(?:\\.|[^\"\\\n])*+\"?|'(?:\\.|[^'\\\n])*+'?"
DOUBLE = r"\"(?:\\.|[^\"\\])*+\"?|'(?:\\.[^'\n]{0,8}|[^'\\\n])'"
SLASHES, HASH = r"//[^\n]*|/\*.*?(?:\*/|\Z)", r"\#[^\n]*"
LONG = r"\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)"
TOKENS = {
    "javascript": (SLASHES, QUOTED), "python": (HASH, rf"{LONG}|{QUOTED}"), "ruby": (rf"{HASH}|^=begin\b.*?(?:^=end\b|\Z)", QUOTED), "php": (rf"{SLASHES}|{HASH}", r"\"(?:\\.|[^\"\\])*+\"?|'(?:\\.|[^'\\])*+'?"),
    "go": (SLASHES, rf"`[^`]*(?:`|\Z)|{DOUBLE}"), "rust": (SLASHES, rf"\br(?P<raw>\#*)\".*?(?:\"(?P=raw)|\Z)|{DOUBLE}"), "java": (SLASHES, rf"\"\"\".*?(?:\"\"\"|\Z)|{QUOTED}"),
    "cpp": (SLASHES, rf"R\"(?P<raw>[^()\s]{0,16})\(.*?(?:\)(?P=raw)\"|\Z)|{QUOTED}"), "csharp": (SLASHES, rf"\$?@\$?\"(?:\"\"|[^\"])*+\"?|{QUOTED}"),
}
TOKENS |= {"typescript": TOKENS["javascript"], "tsx": TOKENS["javascript"], "kotlin": TOKENS["java"], "swift": TOKENS["java"]}
SCRIPTS = ("javascript", "typescript", "tsx")
LEXERS = {x: re.compile(rf"(?P<comment>{a})|(?P<string>{b})|(?P<sign>[{{}}()\[\];`/])", re.S | re.M) for x, (a, b) in TOKENS.items()}
TEMPLATE = re.compile(r"\\.|`|\$\{", re.S)
REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
#: A slash after one of these begins a pattern, else it divides.
BEFORE_REGEX = re.compile(r"(?:[(,=:\[!&|?{};+\-*%~^<>]|\b(?:return|typeof|case|in|of|delete|void|throw|new|do|else|yield|await)|\A)\s*\Z")
RUBY = re.compile(r"^[ \t]*(class|module|def|if|unless|while|until|for|begin|case)\b|(?<=[\s)])(do)\b|\b(end)\b", re.M)
NOT_NEWLINE = re.compile(r"[^\n]")


class Scan:
    """A file's ``code`` (comments blanked, strings underscored, same length and lines), its blocks and the marks where statements open a block or end."""

    def __init__(self, text: str, lang: str):
        self.text, self.lang, self.blocks, self.marks, self.strings = text, lang, [], [], {}
        self.newlines = [m.start() for m in re.finditer("\n", text)]
        self.cuts: list[tuple[int, int, str]] = []
        self.stack: list[tuple[str, int]] = []
        self.read()
        out, done = [], 0
        for a, b, fill in self.cuts:
            out += [text[done:a], NOT_NEWLINE.sub(fill, text[a:b])]
            done = b
        self.code = "".join(out) + text[done:]
        if lang == "python":
            self.indents()
        elif lang == "ruby":
            self.ends()

    def line(self, at: int) -> int:
        return bisect_right(self.newlines, at - 1) + 1

    def open(self, at: int) -> None:
        parent = next((k for c, k in reversed(self.stack) if c == "{"), -1)
        self.marks.append((at, len(self.blocks)))
        self.stack.append(("{", len(self.blocks)))
        self.blocks.append([at, len(self.text), parent])

    def close(self, at: int) -> None:
        if any(c == "{" for c, _ in self.stack):
            while self.stack[-1][0] != "{":  # brackets that were left open
                self.stack.pop()
            self.blocks[self.stack.pop()[1]][1] = at

    def template(self, at: int) -> int:
        """Where the text of a template literal from ``at`` on ends, or its next inner expression begins."""
        start = at
        while m := TEMPLATE.search(self.text, at):
            at = m.end()
            if m[0] == "`" or m[0] == "${":
                self.cuts.append((start, m.start(), "_"))
                self.stack.append(("$", 0)) if m[0] == "${" else None
                return at
        self.cuts.append((start, len(self.text), "_"))
        return len(self.text)

    def read(self) -> None:
        text, lexer, at, braces = self.text, LEXERS[self.lang], 0, self.lang not in ("python", "ruby")
        script = self.lang in SCRIPTS
        while m := lexer.search(text, at):
            at, sign = m.end(), m["sign"]
            if m["comment"] is not None:
                self.cuts.append((*m.span(), " "))
            elif m["string"] is not None:
                closed = m.end() - m.start() > 1 and text[m.end() - 1] in "\"'`#"
                self.cuts.append((m.start() + 1, m.end() - closed, "_"))
                self.strings[m.start()] = m.end()
            elif sign == "`":
                at = self.template(at) if script else at
            elif sign == "/":
                if script and BEFORE_REGEX.search(self.before(m.start())) and (r := REGEX.match(text, m.start())):
                    self.cuts.append((*r.span(), "_"))
                    at = r.end()
            elif sign in "([":
                self.stack.append(("(", at))
            elif sign in ")]":
                if self.stack and self.stack[-1][0] == "(":
                    self.stack.pop()
            elif sign == "}" and self.stack and self.stack[-1][0] == "$":
                self.stack.pop()
                at = self.template(at)
            elif braces and sign == "{":
                if self.stack and self.stack[-1][0] == "(":  # an object among arguments is no body
                    self.stack.append(("{", len(self.blocks)))
                    self.blocks.append([m.start(), len(text), -1])
                else:
                    self.open(m.start())
            elif braces and sign == "}":
                self.close(m.start())
            elif sign == ";" and not (self.stack and self.stack[-1][0] == "("):
                self.marks.append((m.start(), -1))
            elif self.lang == "python" and sign in "{}":
                self.stack.append(("(", at)) if sign == "{" else self.stack and self.stack.pop()
        if self.lang == "python":
            self.stack = []

    def before(self, at: int) -> str:
        """Some code before a place, comments left out."""
        low = max(self.cuts[-1][1] if self.cuts and self.cuts[-1][2] == " " else 0, at - 40)
        part = self.text[low:at]
        if part.strip() or low == 0:
            return part
        a = self.cuts[-1][0]
        return self.text[max(0, a - 40) : a]

    def indents(self) -> None:
        """Blocks of Python: an indented run of lines, which the end of the line before opens."""
        levels, at, last, depth = [0], 0, -1, 0
        for line in self.code.split("\n"):
            own = line.strip()
            if own and depth == 0:
                width = len(line.expandtabs()) - len(line.expandtabs().lstrip())
                while width < levels[-1]:
                    levels.pop()
                    self.close(last)
                if width > levels[-1]:
                    levels.append(width)
                    self.open(last)
                elif last >= 0:
                    self.marks.append((last, -1))
            if own:
                depth = max(0, depth + sum(line.count(x) for x in "([{") - sum(line.count(x) for x in ")]}"))
                last = at + len(line.rstrip()) - 1
            at += len(line) + 1
        while len(levels) > 1:
            levels.pop()
            self.close(last)

    def ends(self) -> None:
        """Blocks of Ruby: from a keyword to its ``end``; a ``do`` of a loop opens no second one."""
        self.stack, loop = [], -1
        for m in RUBY.finditer(self.code):
            line = self.line(m.start())
            if m[3]:
                self.close(m.start())
            elif m[2] is None or loop != line:
                self.open(m.start(m.lastindex))
            if m[1] in ("while", "until", "for"):
                loop = line

    def lines(self):
        """(line, code, place of its first character, blocks around it from the outermost) of the lines that hold code."""
        opens = sorted((b[0], 0, k) for k, b in enumerate(self.blocks)) + sorted((b[1], 1, k) for k, b in enumerate(self.blocks))
        opens.sort()
        inside, e, at = [], 0, 0
        for n, line in enumerate(self.code.split("\n"), 1):
            while e < len(opens) and opens[e][0] < at:
                _, closing, k = opens[e]
                if closing:
                    inside.remove(k)
                else:
                    inside.append(k)
                e += 1
            if line.strip():
                yield {"line": n, "code": line, "at": at, "around": list(inside)}
            at += len(line) + 1


LEXED = "path string, language string, lines array<struct<line:int,code:string,at:int,around:array<int>>>, blocks array<struct<block:int,at:int,start_line:int,end_line:int,parent:int>>, marks array<struct<at:int,line:int,block:int>>, imports array<struct<form:string,specifier:string,type_only:boolean,top:boolean,start_line:int,end_line:int,bindings:array<struct<imported:string,local:string,type_only:boolean>>>>, exports array<struct<exported:string,local:string>>"

WORD = r"[\w$]+"
IMPORT = re.compile(rf"(?<![\w$.])(?:(?P<import>import)\s*(?P<type>type\s+(?!from\b|,))?(?P<clause>(?:{WORD}\s*(?:,\s*)?)?(?:\{{[^{{}}]*\}}|\*\s*as\s+{WORD})?)\s*(?:from\s*)?(?P<q>['\"])|(?P<call>import|require)\s*\(\s*(?P<arg>['\"])?|(?P<export>export)\s+(?:type\s+)?(?:\*(?:\s*as\s+{WORD})?|\{{[^{{}}]*\}})\s*from\s*(?P<eq>['\"]))")
EXPORT = re.compile(rf"(?<![\w$.])export\s+(?:(?P<default>default)\s+(?:(?:abstract\s+)?class\s+|(?:async\s+)?function\s*\*?\s*)?(?P<value>{WORD})?|\{{(?P<list>[^{{}}]*)\}}(?!\s*from\b)|(?:declare\s+)?(?:abstract\s+)?(?:class|interface|enum|type|namespace|(?:async\s+)?function\s*\*?)\s+(?P<name>{WORD})|(?:const|let|var)\s+(?P<first>{WORD}))")


def named(part: str, type_only: bool):
    for one in part.split(","):
        words = one.split()
        own = type_only or len(words) > 1 and words[0] == "type" and words[1] != "as"
        words = words[1:] if own and not type_only else words
        if words:
            yield {"imported": words[0], "local": words[-1], "type_only": own}


def module_facts(scan: Scan) -> tuple[list[dict], list[dict]]:
    """(imports, exports) of a script: static, dynamic and required modules and re-exports; names that it exports with their own names."""
    tops = [(b[0], b[1]) for b in scan.blocks if b[2] < 0]
    starts = sorted(tops)

    def top(at):
        k = bisect_right(starts, (at, len(scan.code))) - 1
        return k < 0 or starts[k][1] < at

    imports, exports = [], []
    for m in IMPORT.finditer(scan.code):
        quote = next((m.start(g) for g in ("q", "arg", "eq") if m[g]), None)
        end = scan.strings.get(quote, m.end())
        form = "import" if m["import"] else "reexport" if m["export"] else "dynamic" if m["call"] == "import" else "require"
        bindings, type_only = [], bool(m["type"])
        if m["import"]:
            for group in re.findall(r"\{[^{}]*\}|\*\s*as\s+[\w$]+|[\w$]+", m["clause"]):
                if group[0] == "{":
                    bindings += named(group[1:-1], type_only)
                elif group[0] == "*":
                    bindings.append({"imported": "*", "local": group.split()[-1], "type_only": type_only})
                else:
                    bindings.append({"imported": "default", "local": group, "type_only": type_only})
        imports.append({"form": form, "specifier": scan.text[quote + 1 : end - 1] if quote is not None else None, "type_only": type_only, "top": top(m.start()), "start_line": scan.line(m.start()), "end_line": scan.line(max(end - 1, m.start())), "bindings": bindings})
    for m in EXPORT.finditer(scan.code):
        if not top(m.start()):
            continue
        if m["default"]:
            exports.append({"exported": "default", "local": m["value"]})
        elif m["list"] is not None:
            for x in m["list"].split(","):
                words = x.removeprefix("type ").split()
                if words:
                    exports.append({"exported": words[-1], "local": words[0]})
        else:
            name = m["name"] or m["first"]
            exports.append({"exported": name, "local": name})
    return imports, exports


def lexed(files: DataFrame) -> DataFrame:
    """One row for each file (path, content) of a scanned language: its lines of code, blocks, marks, imports and exports.

    Files of other languages and null contents give no row. Lines count from 1, places from 0, in code points.
    """

    def run(batches):
        schema = None
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                rows = []
                for path, lang, text in zip(*(batch.slice(k, 64).column(c).to_pylist() for c in range(3))):
                    s = Scan(text, lang)
                    imports, exports = module_facts(s) if lang in SCRIPTS else ([], [])
                    blocks = [{"block": i, "at": a, "start_line": s.line(a), "end_line": s.line(min(b, len(text))), "parent": p} for i, (a, b, p) in enumerate(s.blocks)]
                    marks = [{"at": a, "line": s.line(a), "block": b} for a, b in sorted(s.marks)]
                    rows.append({"path": path, "language": lang, "lines": list(s.lines()), "blocks": blocks, "marks": marks, "imports": imports, "exports": exports})
                schema = schema or to_arrow()
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    known = files.select("path", language("path").alias("language"), "content").where(F.col("language").isin(*TOKENS) & F.col("content").isNotNull())
    return known.mapInArrow(run, LEXED)


def kept(scanned: DataFrame, *columns: str) -> DataFrame:
    """The rows of ``lexed`` (some columns, or all), written once: whoever reads them several times would scan the files as often."""
    return Scratch(scanned.sparkSession, "lexed").write(scanned.select(*columns or scanned.columns), "files")


def to_arrow() -> pa.Schema:
    i, s, b = pa.int32(), pa.string(), pa.bool_()
    rows = lambda *fields: pa.list_(pa.struct(fields))
    binding = rows(("imported", s), ("local", s), ("type_only", b))
    return pa.schema([
        ("path", s), ("language", s), ("lines", rows(("line", i), ("code", s), ("at", i), ("around", pa.list_(i)))), ("blocks", rows(("block", i), ("at", i), ("start_line", i), ("end_line", i), ("parent", i))),
        ("marks", rows(("at", i), ("line", i), ("block", i))), ("imports", rows(("form", s), ("specifier", s), ("type_only", b), ("top", b), ("start_line", i), ("end_line", i), ("bindings", binding))), ("exports", rows(("exported", s), ("local", s))),
    ])


def symbols_of(rules: list, lines: list[dict], blocks: list[dict], marks: list[dict]):
    """(kind, name, start_line, end_line, container) of one file's declared symbols."""
    places, ends, found, holders = [m["at"] for m in marks], {b["block"]: b["end_line"] for b in blocks}, [], {}
    for l in lines:
        kind, name = next(((kind, m[1]) for kind, pattern in rules if (m := pattern.search(l["code"])) and m[1]), (None, None))
        if name is None:
            continue
        k = bisect_left(places, l["at"] + len(l["code"]) - len(l["code"].lstrip(" \t\n\x0b\f\r")))
        body = marks[k]["block"] if k < len(marks) else -1
        end = ends.get(body, marks[k]["line"] if k < len(marks) else l["line"])
        found.append((kind, name, l["line"], end, l["around"]))
        if body >= 0:
            holders[body] = (l["at"], name)
    for kind, name, line, end, around in found:
        yield kind, name, line, end, max((holders[b] for b in around if b in holders), default=(0, None))[1]


def symbol_blocks(scanned: DataFrame, declarations: dict) -> DataFrame:
    """Path, language, kind, name, start_line, end_line and container of the declared symbols of ``lexed`` files.

    A symbol ends where the block closes that opens first behind its declaration, or with a statement that ends before one opens. Its
    container is the name of the innermost symbol whose block it stands in. Each file is done where its row is: nothing is shuffled.
    """
    rules = {lang: [(kind, re.compile(pattern, re.A)) for kind, pattern in of] for lang, of in declarations.items()}

    def run(batches):
        schema = pa.schema([("path", pa.string()), ("language", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("container", pa.string())])
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                rows = []
                for path, lang, *facts in zip(*(batch.slice(k, 64).column(c).to_pylist() for c in range(5))):
                    rows += [(path, lang, *x) for x in symbols_of(rules.get(lang, ()), *facts)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)

    return scanned.select("path", "language", "lines", "blocks", "marks").mapInArrow(run, "path string, language string, kind string, name string, start_line int, end_line int, container string")


def joined_path(path, specifier):
    """The path that a relative specifier stands for; null where it leaves the project."""
    steps = F.split(F.concat(F.regexp_replace(path, r"[^/]*$", ""), specifier), "/")
    done = lambda a, x: F.when(a.isNull() | x.isin("", "."), a).when((x == "..") & (F.size(a) == 0), F.lit(None)).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x))
    return F.array_join(F.aggregate(steps, F.array().cast("array<string>"), done), "/")


def module_imports(scanned: DataFrame, files: DataFrame) -> DataFrame:
    """Path, form, specifier, type_only, start_line, end_line, bindings, target and reason of each import of ``lexed`` scripts.

    A static import at the top of a module stands for the one file of ``files`` (path) that its specifier may name; what stands for none, or for
    several, has a reason and no target. A path that occurs twice is a collision.
    """
    facts = scanned.select("path", F.explode("imports").alias("i")).select("path", "i.*")
    relative = (F.col("form") == "import") & F.col("top") & (F.startswith("specifier", F.lit("./")) | F.startswith("specifier", F.lit("../")))
    base = F.when(relative, joined_path("path", "specifier"))
    own = F.regexp_extract("base", r"(\.[^./]+)$", 1).isin(*MODULE_EXTENSIONS)
    spec = F.col("specifier")
    reason = (
        F.when(F.col("form") == "reexport", "unsupported-reexport").when(F.col("form") == "dynamic", "dynamic-import").when(F.col("form") == "require", "unsupported-commonjs").when(~F.col("top"), "invalid-syntax")
        .when(spec.isNull() | spec.rlike(r"[\\\x00-\x1f\x7f?#]"), "unsupported-specifier").when(~spec.startswith("./") & ~spec.startswith("../"), "external-module").when(F.col("base").isNull(), "outside-project")
    )
    keyed = facts.withColumn("base", base).withColumn("reason", reason)
    open_ = keyed.where("reason is null")
    bases = open_.select("base", own.alias("_own")).distinct()
    inventory = files.groupBy("path").agg(F.count("*").alias("_files"))
    # A file is offered under each base that may stand for it: three rows at most, where each base would try eleven paths.
    short = lambda end: F.when(F.endswith("path", F.lit(end)), F.expr(f"left(path, length(path) - {len(end)})"))
    way = lambda whole, x: F.struct(F.lit(whole).alias("whole"), x.alias("base"))
    ways = F.array(way(True, F.col("path")), *[way(False, short(e + x)) for x in MODULE_EXTENSIONS for e in ("", "/index")])
    offers = inventory.select("path", "_files", F.explode(F.filter(ways, lambda w: w["base"].isNotNull())).alias("w")).select("path", "_files", F.col("w.whole").alias("_whole"), F.col("w.base").alias("base"))
    met = bases.join(offers.hint("merge"), "base").where("_whole or not _own")
    hits = met.groupBy("base").agg(F.count("*").alias("_n"), F.min("path").alias("_target"), F.max("_files").alias("_files"))
    late = (
        F.when(F.col("_n").isNull(), "missing-module").when(F.col("_n") > 1, "ambiguous-module").when(F.col("_files") > 1, "file-collision")
        .when(~F.regexp_extract("_target", r"(\.[^./]+)$", 1).isin(*MODULE_EXTENSIONS), "unsupported-language")
    )
    out = ["path", "form", "specifier", "type_only", "start_line", "end_line", "bindings"]
    settled = keyed.where("reason is not null").select(*out, F.lit(None).cast("string").alias("target"), "reason")
    tried = open_.join(hits.hint("merge"), "base", "left").withColumn("reason", late)
    return settled.unionByName(tried.select(*out, F.when(F.col("reason").isNull(), F.col("_target")).alias("target"), "reason"))


def bound_names(imports: DataFrame, scanned: DataFrame, symbols: DataFrame) -> DataFrame:
    """Path, target, imported, local, type_only, symbol and reason of each name that a resolved import binds.

    A name stands for the one top-level symbol (path, name, of ``symbols``) that its module exports once under that name.
    """
    names = imports.where("target is not null").select("path", "target", F.explode("bindings").alias("b")).select("path", "target", "b.*")
    exports = scanned.select(F.col("path").alias("target"), F.explode("exports").alias("e")).select("target", F.col("e.exported").alias("imported"), "e.local").groupBy("target", "imported").agg(F.count("*").alias("_n"), F.min("local").alias("_own"))
    tops = symbols.where("container is null").groupBy(F.col("path").alias("target"), F.col("name").alias("_own")).agg(F.count("*").alias("_m"))
    hits = names.join(exports.hint("merge"), ["target", "imported"], "left").join(tops.hint("merge"), ["target", "_own"], "left")
    one = (F.col("imported") != "*") & (F.col("_n") == 1) & (F.col("_m") == 1)
    reason = F.when(F.col("imported") == "*", "namespace-import").when(~F.coalesce(one, F.lit(False)), "unresolved-export")
    return hits.select("path", "target", "imported", "local", "type_only", F.when(reason.isNull(), F.col("_own")).alias("symbol"), reason.alias("reason"))
