"""Paths, symbol keys and node kinds as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Relation names, depth presets, node kinds and file extensions of the data model.
RELATIONS = ("contains", "method", "calls", "imports", "imports_from")
FOCUS = {"dependencies": ("imports", "imports_from"), "callers": ("calls",), "containment": ("contains", "method")}
DEPTHS = {"compact": (1, 2000), "extended": (2, 5000), "deep": (3, 10_000), "disk": (3, 15_000)}
NODE_KINDS = ("file", "symbol", "member", "doc", "config", "data")
CODE_EXTENSIONS = tuple(
    (
        "js mjs cjs jsx ts tsx mts cts java cs kt kts scala groovy clj cljs fs fsx vb c h cc cpp cxx hpp hh hxx m mm rs go zig nim "
        "py pyw pyi rb php pl pm r lua dart ex exs erl hs ml swift sh bash zsh fish ps1 psm1 bat cmd html htm css scss sass less vue svelte astro"
    ).split()
)
DOC_EXTENSIONS = tuple("md markdown mdx mdown mkd rmd rst adoc txt".split())
CONFIG_EXTENSIONS = tuple("json jsonc json5 yaml yml toml ini cfg conf env properties lock".split())
CONFIG_NAMES = tuple("package.json composer.json cargo.toml docker-compose.yml docker-compose.yaml go.mod go.work makefile dockerfile gemfile rakefile procfile justfile".split())
MEMBER_KINDS = tuple("method member constructor property field event accessor getter setter".split())
SYMBOL_KINDS = tuple("function class interface enum struct union trait type typedef variable constant module namespace macro decorator annotation".split())
WATCHED_EXTENSIONS = ("ts", "tsx", "mjs", "js", "jsx", "cs")
MODULE_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs")
LANGUAGES = {"js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "tsx", "py": "python", "java": "java", "go": "go", "rs": "rust", "rb": "ruby", "php": "php", "kt": "kotlin", "swift": "swift", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "cs": "csharp"}
IGNORED_DIRS = ("node_modules", "dist", "build", "coverage", "bin", "obj", "target", ".next", ".turbo", ".vercel", "graphify-out", ".worktrees", ".planning", ".git")
WALKED_HIDDEN_DIRS = (".opencode",)
GRAPH_SCOPE = ("graphify-out", ".graphify_")


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normal_path(path) -> Column:
    """backslashes become slashes."""
    return F.replace(col(path), F.lit("\\"), F.lit("/"))


def strict_path(path) -> Column:
    """F1, strict: null for an absolute path, a drive, a step above the root, control characters or ``|``."""
    p = normal_path(path)
    return F.when(~p.rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)|[\x00-\x1f|]") & (p != ""), p)


def basename(path) -> Column:
    """F2."""
    return F.element_at(F.split(normal_path(path), "/"), -1)


def extension(path) -> Column:
    """lower case without the dot; a dotfile has none."""
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]+)$", 1))


def language(path) -> Column:
    """The language of a file by its extension, or null."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), extension(path))


def ignored_dir(name) -> Column:
    """Names that are never walked, and hidden folders but for the ones that hold settings."""
    x = col(name)
    return x.isin(*IGNORED_DIRS) | x.startswith(".") & ~x.isin(*WALKED_HIDDEN_DIRS)


def watched(path) -> Column:
    """A file with a watched extension (in that case) that is no graph output and in no ignored or settings folder."""
    p = normal_path(path)
    folders = F.slice(F.split(p, "/"), 1, F.greatest(F.size(F.split(p, "/")) - 1, F.lit(0)))
    own = F.regexp_extract(basename(path), r"^.+\.([^.]+)$", 1)
    graph = basename(path).startswith(GRAPH_SCOPE[1]) | (basename(path) == GRAPH_SCOPE[0])
    return ~graph & ~F.exists(folders, lambda x: x.isin(*IGNORED_DIRS, *WALKED_HIDDEN_DIRS)) & own.isin(*WATCHED_EXTENSIONS)


def symbol_key(language, path, kind, scope, name, arity) -> Column:
    """``language|path|kind|scope|name|arity``."""
    return F.concat_ws("|", col(language), normal_path(path), col(kind), col(scope), col(name), F.coalesce(col(arity).cast("string"), F.lit("0")))


def key_part(key, k: int) -> Column:
    """part k of a key, from 1; from the end where negative; null if there is none."""
    return F.try_element_at(F.split(col(key), r"\|"), F.lit(k))


def key_name(key) -> Column:
    return key_part(key, -2)


def canonical_key(key) -> Column:
    """P10: six parts, none empty, arity a number; or seven of C#, where only namespace and container may be empty. No white space at the ends."""
    parts = F.split(col(key), r"\|")
    part = lambda k: F.try_element_at(parts, F.lit(k))
    plain = (F.size(parts) == 6) & ~F.exists(parts, lambda x: x == "") & part(6).rlike(r"^[0-9]+$")
    sharp = (F.size(parts) == 7) & (part(1) == "csharp") & (part(2) != "") & (part(5) != "") & (part(6) != "") & (part(7) != "")
    edges = col(key).rlike(r"^[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]|[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]\z")
    return F.coalesce((plain | sharp) & ~edges, F.lit(False))


def constructor_end(key) -> Column:
    """P11."""
    return F.coalesce(key_name(key).endswith(".constructor"), F.lit(False))


def test_file(path) -> Column:
    """P12."""
    return normal_path(path).rlike(r"(^|/)(tests?|__tests__)(/|$)|\.(test|spec)\.[^/.]+$")


def path_like(label) -> Column:
    """A slash, a known extension or name, or a dotfile, and no ``.name(`` label."""
    x = col(label)
    known = extension(x).isin(*CODE_EXTENSIONS, *DOC_EXTENSIONS, *CONFIG_EXTENSIONS) | F.lower(basename(x)).isin(*CONFIG_NAMES)
    return F.coalesce((x != "") & ~x.rlike(r"^\.[A-Za-z_$][A-Za-z0-9_$]*\s*\(") & (x.contains("/") | x.contains("\\") | known | basename(x).startswith(".")), F.lit(False))


def config_path(path) -> Column:
    """A dotfile, a known name or one with ``config`` in it."""
    name = F.lower(basename(path))
    return name.startswith(".") | name.isin(*CONFIG_NAMES) | name.contains("config")


def key_kind(key) -> Column:
    """The kind that a symbol key names, part 3 or of a C# key part 5."""
    parts = F.split(col(key), r"\|")
    sharp = (F.size(parts) >= 7) & (F.lower(F.element_at(parts, 1)) == "csharp")
    return F.when(sharp, F.try_element_at(parts, F.lit(5))).when(F.size(parts) >= 6, F.try_element_at(parts, F.lit(3)))


def node_kind(label, kind=None, file_type=None, symbol_key=None, container=None, source_file=None, source_location=None) -> Column:
    """Member, doc, symbol, doc, file, config or data, by the first rule that fits.

    Evidence of a member (kind, key or container) comes first, then document nodes, then evidence of a symbol (key, kind, or a
    place in code) of a label that is no path, then the extension of the label or, for other labels, of the source file.
    """
    said = lambda x: F.lit(None).cast("string") if x is None else F.when(col(x) != "", col(x))
    x, own_kind, key = said(label), F.lower(said(kind)), said(symbol_key)
    own_path = path_like(x)
    member = own_kind.isin(*MEMBER_KINDS) | F.lower(key_kind(key)).isin(*MEMBER_KINDS) | said(container).isNotNull()
    symbol = key.isNotNull() | own_kind.isin(*SYMBOL_KINDS) | (said(file_type) == "code") & said(source_location).isNotNull()
    ext = extension(x)
    return (
        F.when(F.coalesce(member, F.lit(False)), "member")
        .when(said(file_type) == "document", "doc")
        .when(~own_path & F.coalesce(symbol, F.lit(False)), "symbol")
        .when(extension(F.when(own_path, x).otherwise(said(source_file))).isin(*DOC_EXTENSIONS), "doc")
        .when(~own_path, "data")
        .when(ext.isin(*CODE_EXTENSIONS), "file")
        .when(config_path(x), "config")
        .otherwise("data")
    )


def kinds_allowed(kinds) -> tuple[str, ...] | None:
    """None is no filter, an empty list allows nothing; an unknown kind is an error."""
    if kinds is None:
        return None
    if bad := [k for k in kinds if k not in NODE_KINDS]:
        raise TypeError(f"unknown node kinds: {bad}")
    return tuple(kinds)


def focus_relations(focus: str | None) -> tuple[str, ...]:
    """P4."""
    return FOCUS.get(focus or "", RELATIONS)


def depth_preset(name: str | None) -> tuple[int, int]:
    """P5: (hops, tokens)."""
    return DEPTHS.get(name or "compact", DEPTHS["compact"])


def safe_key(key) -> Column:
    """lossy; see ``operators.delta.backfill_plan`` for collisions."""
    return F.regexp_replace(col(key), "[^a-zA-Z0-9_-]+", "_")


def key_tag(key) -> Column:
    """F14."""
    return F.concat(F.lit("key:symbol:"), safe_key(key))


def line_range(text) -> Column:
    """``L12-L20`` as a struct of start and end, ``L12`` as one line; else null."""
    m = F.regexp_extract(col(text), r"^L(\d+)(?:-L?(\d+))?$", 1).try_cast("int")
    end = F.regexp_extract(col(text), r"^L(\d+)(?:-L?(\d+))?$", 2).try_cast("int")
    return F.when(m.isNotNull() & (F.coalesce(end, m) >= m), F.struct(m.alias("start"), F.coalesce(end, m).alias("end")))


def label_name(label) -> Column:
    """F29."""
    return F.regexp_replace(col(label), r"^\.+|\(\)$", "")


def project_id(root) -> Column:
    """F30."""
    return F.sha2(F.lower(normal_path(root)), 256)


def short_file(path) -> Column:
    """the last two steps of a path."""
    parts = F.split(normal_path(path), "/")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "/")


def module_candidates(base) -> Column:
    """a module's path, with each extension, and the index files under it."""
    b = col(base)
    return F.array(b, *[F.concat(b, F.lit(e)) for e in MODULE_EXTENSIONS], *[F.concat(b, F.lit(f"/index{e}")) for e in MODULE_EXTENSIONS])


def heritage_base(clause) -> Column:
    """the bare base type of an ``extends`` or ``implements`` clause."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(col(clause)), r"^(extends|implements)\s+", ""), r"<.*$", ""), r"^.*\.", "")


def content_hash(*parts) -> Column:
    """sha-256 of the JSON of the parts in a fixed order."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts])), 256)
