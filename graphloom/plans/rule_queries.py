"""Scalar functions, rules, roles, cards and evaluation queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import keys as K
from graphloom.functions import text as T
from graphloom.operators import cards, evaluation, roles
from graphloom.plans.registering import Registry
from graphloom.session import table
from graphloom.sources.adapters import GRAPH_SQL, graph_nodes

FOUND = Registry()
PATHS = "SELECT p_partkey AS k, 'src\\' || lower(p_brand) || '\\' || replace(p_name, ' ', '_') || CASE p_partkey % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.test.js' WHEN 2 THEN '.MD' ELSE '' END AS path FROM part"


def paths(spark, d):
    end = F.element_at(F.array(*[F.lit(x) for x in (".ts", ".test.js", ".MD", "")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("src\\"), F.lower("p_brand"), F.lit("\\"), F.replace("p_name", F.lit(" "), F.lit("_")), end).alias("path"))


@FOUND("path_normalize", f"""WITH p AS ({PATHS}), n AS (SELECT k, replace(path, '\\', '/') AS p FROM p)
SELECT k, p AS path, regexp_extract(p, '[^/]*$') AS base, lower(regexp_extract(regexp_extract(p, '[^/]*$'), '^.+\\.([^.]+)$', 1)) AS ext, regexp_extract(p, '[^/]+/[^/]*$') AS short, regexp_matches(p, '(^|/)(tests?|__tests__)(/|$)|\\.(test|spec)\\.[^/.]+$') AS is_test FROM n""")
def path_normalize(spark, d):
    return paths(spark, d).select("k", K.normal_path("path").alias("path"), K.basename("path").alias("base"), K.extension("path").alias("ext"), K.short_file("path").alias("short"), K.test_file("path").alias("is_test"))


@FOUND("project_ids", f"WITH p AS ({PATHS}) SELECT k, sha256(lower(replace(path, '\\', '/'))) AS id FROM p")
def project_ids(spark, d):
    return paths(spark, d).select("k", K.project_id("path").alias("id"))


KEY_SQL = "SELECT p_partkey AS k, 'typescript|' || lower(p_brand) || '.ts|function|exported|' || replace(p_type, ' ', '.') || '|' || p_size AS key FROM part"


def symbol_keys(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), K.symbol_key(F.lit("typescript"), F.concat(F.lower("p_brand"), F.lit(".ts")), F.lit("function"), F.lit("exported"), F.replace("p_type", F.lit(" "), F.lit(".")), "p_size").alias("key"))


@FOUND("symbol_key_parts", f"WITH s AS ({KEY_SQL}) SELECT k, key, string_split(key, '|')[-2] AS name, string_split(key, '|')[2] AS path, true AS canonical, 'key:symbol:' || regexp_replace(key, '[^a-zA-Z0-9_-]+', '_', 'g') AS tag FROM s")
def symbol_key_parts(spark, d):
    return symbol_keys(spark, d).select("k", "key", K.key_name("key").alias("name"), K.key_part("key", 2).alias("path"), K.canonical_key("key").alias("canonical"), K.key_tag("key").alias("tag"))


# Labels, kinds, file types, keys and source files that the orders take in turn (numbers without a common divisor, so that they mix).
LABELS = (".run()", "notes.md", "app.json", "tsconfig.json", "src/a.ts", "Thing", "some thing", "Makefile", ".eslintrc", "lib/x.unknown", "Guide.RST", "data.yaml", "go.mod", "a\\b", "")
KINDS = ("method", "class", "x", "Getter", "function", "", "annotation")
TYPES = ("code", "document", "", "code")
KEYS = ("", "", "", "ts|a.ts|function|exported|f|0", "ts|a.ts|property|member|A.f|0", "csharp|a.cs|N|C|constructor|C|", "bad|key", "", "")
SOURCES = ("README.md", "a.ts", "", "b.txt", "c.js")


def pick(values, number):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def pick_sql(values, number):
    said = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{said}])[{number} % {len(values)} + 1]"


def names_sql(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def ext_sql(x):
    return f"lower(regexp_extract(regexp_extract({x}, '[^/\\\\]*$'), '^.+\\.([^.]+)$', 1))"


BASE_SQL = "lower(regexp_extract({x}, '[^/\\\\]*$'))"


def path_sql(x):
    base = BASE_SQL.format(x=x)
    return f"({x} <> '' AND NOT regexp_matches({x}, '^\\.[A-Za-z_$][A-Za-z0-9_$]*\\s*\\(') AND (contains({x}, '/') OR contains({x}, '\\') OR {ext_sql(x)} IN {names_sql(K.CODE_EXTENSIONS + K.DOC_EXTENSIONS + K.CONFIG_EXTENSIONS)} OR {base} IN {names_sql(K.CONFIG_NAMES)} OR starts_with({base}, '.')))"


KIND_SQL = f"""WITH r AS (SELECT o_orderkey AS k, {pick_sql(LABELS, 'o_orderkey')} AS label, lower({pick_sql(KINDS, '(o_orderkey // 3)')}) AS kind, {pick_sql(TYPES, '(o_orderkey // 7)')} AS type, {pick_sql(KEYS, '(o_orderkey // 2)')} AS key, {pick_sql(SOURCES, '(o_orderkey // 5)')} AS source, o_orderkey % 17 = 0 AS owned, o_orderkey % 4 = 0 AS placed FROM orders),
q AS (SELECT *, {path_sql('label')} AS is_path, string_split(key, '|') AS parts FROM r),
v AS (SELECT *, CASE WHEN len(parts) >= 7 AND lower(parts[1]) = 'csharp' THEN parts[5] WHEN len(parts) >= 6 THEN parts[3] END AS key_kind FROM q)
"""


def kind_rows(spark, d):
    k = F.col("o_orderkey")
    n = lambda m: F.floor(k / m).cast("long")
    return table(spark, d, "orders").select(k.alias("k"), pick(LABELS, k).alias("label"), pick(KINDS, n(3)).alias("kind"), pick(TYPES, n(7)).alias("type"), pick(KEYS, n(2)).alias("key"), pick(SOURCES, n(5)).alias("source"), F.when(k % 17 == 0, "Owner").alias("owner"), F.when(k % 4 == 0, "L1").alias("place"))


@FOUND("node_kind_classify", KIND_SQL + f"""SELECT k, CASE WHEN kind IN {names_sql(K.MEMBER_KINDS)} OR coalesce(key_kind IN {names_sql(K.MEMBER_KINDS)}, false) OR owned THEN 'member' WHEN type = 'document' THEN 'doc'
WHEN NOT is_path AND (key <> '' OR kind IN {names_sql(K.SYMBOL_KINDS)} OR (type = 'code' AND placed)) THEN 'symbol' WHEN {ext_sql('CASE WHEN is_path THEN label ELSE source END')} IN {names_sql(K.DOC_EXTENSIONS)} THEN 'doc'
WHEN NOT is_path THEN 'data' WHEN {ext_sql('label')} IN {names_sql(K.CODE_EXTENSIONS)} THEN 'file' WHEN starts_with({BASE_SQL.format(x='label')}, '.') OR {BASE_SQL.format(x='label')} IN {names_sql(K.CONFIG_NAMES)} OR contains({BASE_SQL.format(x='label')}, 'config') THEN 'config' ELSE 'data' END AS node_kind FROM v""")
def node_kind_classify(spark, d):
    return kind_rows(spark, d).select("k", K.node_kind("label", "kind", "type", "key", "owner", "source", "place").alias("node_kind"))


@FOUND("path_like_labels", KIND_SQL + "SELECT k, is_path FROM v")
def path_like_labels(spark, d):
    return kind_rows(spark, d).select("k", K.path_like("label").alias("is_path"))


FOLDERS = ("src", ".opencode", "node_modules", ".git", "graphify-out", "vendor", ".hidden", "out", "target", "lib")
FILES = ("a.ts", "b.py", "c.CS", "d.cs", ".graphify_x.ts", "e.mjs", "f")


@FOUND("ignored_and_watched", f"""WITH r AS (SELECT o_orderkey AS k, {pick_sql(FOLDERS, 'o_orderkey')} AS folder, {pick_sql(FILES, '(o_orderkey // 10)')} AS file, o_orderkey % 3 = 0 AS deep FROM orders)
SELECT k, folder IN {names_sql(K.IGNORED_DIRS)} OR (starts_with(folder, '.') AND folder <> '.opencode') AS ignored,
folder NOT IN {names_sql(K.IGNORED_DIRS + K.WALKED_HIDDEN_DIRS)} AND NOT starts_with(file, '.graphify_') AND string_split(file, '.')[-1] IN ('ts', 'tsx', 'mjs', 'js', 'jsx', 'cs') AS watched FROM r""")
def ignored_and_watched(spark, d):
    k = F.col("o_orderkey")
    folder, file = pick(FOLDERS, k), pick(FILES, F.floor(k / 10).cast("long"))
    path = F.when(k % 3 == 0, F.concat(F.lit("top\\"), folder, F.lit("/x/"), file)).otherwise(F.concat(folder, F.lit("/"), file))
    return table(spark, d, "orders").select(k.alias("k"), K.ignored_dir(folder).alias("ignored"), K.watched(path).alias("watched"))


CHANGED = ("package.json", "./package.json", "src/package.json", "App.csproj", "README.md", "docs/README.md", "sub/AGENTS.md", ".cursorrules", ".planning/context/project-context/declared/technical-rules.md", ".planning\\context\\project-context\\declared\\architecture-target.md", "src/a.ts")


@FOUND("invalidated_contexts", f"""WITH r AS (SELECT event_id, {pick_sql(CHANGED, 'event_id')} AS p FROM events), n AS (SELECT event_id, regexp_replace(replace(p, '\\', '/'), '^\\./', '') AS p FROM r)
SELECT event_id, array_to_string(CASE WHEN p = 'package.json' OR p LIKE '%.csproj' THEN ['stack-runtime', 'dependencies-summary', 'integrations-summary'] WHEN p LIKE '.planning/%/technical-rules%' THEN ['technical-rules'] WHEN p LIKE '.planning/%/architecture-target%' THEN ['architecture-target'] WHEN p = 'README.md' OR p LIKE '%/AGENTS.md' OR p = '.cursorrules' THEN ['technical-rules', 'project-requirements'] ELSE [] END, ',') AS kinds FROM n""")
def invalidated_contexts(spark, d):
    return table(spark, d, "events").select("event_id", F.array_join(T.invalidated_kinds(pick(CHANGED, F.col("event_id"))), ",").alias("kinds"))


@FOUND("token_estimates", "SELECT doc_id, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens, CAST(greatest(0, ceil(length(text) / 4) - ceil(length(lang) / 4)) AS BIGINT) AS saved FROM documents")
def token_estimates(spark, d):
    return table(spark, d, "documents").select("doc_id", T.estimated_tokens("text").alias("tokens"), T.tokens_saved("text", "lang").cast("long").alias("saved"))


@FOUND("line_slices", "SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS lines FROM documents")
def line_slices(spark, d):
    return table(spark, d, "documents").select("doc_id", T.line_slice("text", F.lit(2), F.lit(4)).alias("lines"))


@FOUND("first_sentences")
def first_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", T.semantic_summary("text").alias("summary"))


@FOUND("size_router", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity / 50 >= 0.6 THEN 'subagent' WHEN l_extendedprice >= 40000 THEN 'subagent' ELSE 'local' END AS route FROM lineitem")
def size_router(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.routed("l_extendedprice", "l_quantity", F.lit(50), 40000).alias("route"))


CAUSES = ("HTTP 503", "forbidden", "socket closed", "Invalid API key", "Timed out", "bad CONFIG", "the provider said no", "odd", "Unauthorized", "model missing", "ECONNRESET")
EFFECTS = ("", "timeout", "Rate Limit hit", "404", "network down", "401", "request 429")
ERROR_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(m, '{w}')" for w in words) + f" THEN '{name}'" for name, words in (
    ("auth", ("401", "unauthorized", "forbidden")), ("rate-limit", ("429", "rate limit")), ("provider", ("500", "502", "503", "504", "404", "provider unavailable", "model missing")),
    ("network", ("econnrefused", "enotfound", "econnreset", "socket", "network")), ("timeout", ("timeout",)), ("config", ("config",)), ("provider", ("provider",)))) + " ELSE 'runtime' END"


@FOUND("error_classifier", f"WITH r AS (SELECT event_id, lower({pick_sql(CAUSES, 'event_id')} || ' ' || {pick_sql(EFFECTS, '(event_id // 11)')} || ' ' || event_type) AS m FROM events) SELECT event_id, {ERROR_SQL} AS class FROM r")
def error_classifier(spark, d):
    k = F.col("event_id")
    said = F.concat_ws(" ", pick(CAUSES, k), pick(EFFECTS, F.floor(k / 11).cast("long")), "event_type")
    return table(spark, d, "events").select("event_id", T.error_class(said).alias("class"))


TYPES_ = ("bugfix", "decision", "architecture", "discovery", "pattern", "config", "preference", "odd")


@FOUND("type_categories", f"WITH r AS (SELECT event_id, {pick_sql(TYPES_, 'event_id')} AS t FROM events) SELECT event_id, CASE t WHEN 'bugfix' THEN 'bug-fix' WHEN 'decision' THEN 'architecture' WHEN 'architecture' THEN 'architecture' WHEN 'config' THEN 'tool-usage' WHEN 'preference' THEN 'personal' ELSE 'learning' END AS category FROM r")
def type_categories(spark, d):
    return table(spark, d, "events").select("event_id", T.category(pick(TYPES_, F.col("event_id"))).alias("category"))


@FOUND("prompt_cuts", "SELECT doc_id, CASE WHEN len(l) > 8 THEN array_to_string(list_concat(l[1:4], l[-4:]), chr(10)) ELSE text END AS cut FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)")
def prompt_cuts(spark, d):
    return table(spark, d, "documents").select("doc_id", T.prompt_cut("text", 8).alias("cut"))


ROLE_SQL = "SELECT CAST(l_suppkey AS VARCHAR) AS id, l_returnflag AS role, w FROM (SELECT DISTINCT l_suppkey, l_returnflag, CASE l_linestatus WHEN 'O' THEN 0.6 ELSE 0.9 END AS w, l_linestatus FROM lineitem)"


@FOUND("role_noisy_or", f"""WITH s AS ({ROLE_SQL}), g AS (SELECT id, role, floor((1 - product(1 - w)) * 10000 + 0.5) / 10000 AS confidence, max(w) AS top FROM s GROUP BY id, role)
SELECT id, role, confidence FROM g QUALIFY row_number() OVER (PARTITION BY id ORDER BY confidence DESC, top DESC, role) = 1""")
def role_noisy_or(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("id"), F.when(F.col("l_linestatus") == "O", "suffix").otherwise("annotation").alias("signal"), F.col("l_returnflag").alias("role")).distinct()
    weight = F.when(F.col("signal") == "suffix", 0.6).otherwise(0.9)
    return roles.scored(rows.withColumn("weight", weight)).select("id", "role", "confidence")


@FOUND("ownership_join", "WITH c AS (SELECT s_nationkey AS path, s_suppkey % 5 AS name, count(*) AS n, min(s_suppkey) AS container FROM supplier GROUP BY 1, 2) SELECT c_custkey AS member, container FROM customer JOIN c ON c_nationkey = path AND c_custkey % 5 = name WHERE n = 1")
def ownership_join(spark, d):
    return roles.ownership(*own_rows(spark, d))


def own_rows(spark, d):
    members = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("path"), (F.col("c_custkey") % 5).alias("container_name"))
    return members, table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("path"), (F.col("s_suppkey") % 5).alias("name"))


@FOUND("role_inheritance", """WITH r AS (SELECT 'customer|' || c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'client' END AS role FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'nation|' || n_nationkey, 'place' FROM nation)
SELECT 'customer|' || c_custkey AS id, CASE WHEN o.id IS NOT NULL THEN o.role ELSE t.role END AS role FROM customer LEFT JOIN r o ON o.id = 'customer|' || c_custkey LEFT JOIN r t ON t.id = 'nation|' || c_nationkey""")
def role_inheritance(spark, d):
    nodes = graph_nodes(spark, d)
    c = nodes.where("kind = 'customer'")
    k = F.substring_index("id", "|", -1).cast("long")
    own = c.where(k % 2 == 0).select("id", F.when(k % 6 != 0, "client").alias("role"))
    given = own.unionByName(nodes.where("kind = 'nation'").select("id", F.lit("place").alias("role")))
    return roles.inherited_roles(c, given, c.select(F.col("id").alias("member"), F.concat(F.lit("nation|"), F.col("community").cast("string")).alias("container")))


EVAL_SQL = "WITH e AS (SELECT c_custkey AS id, list_distinct([c_custkey % 3, c_custkey % 5, c_custkey % 2]) AS e, CASE WHEN c_custkey % 7 = 0 THEN [] ELSE list_distinct([c_custkey % 4, c_custkey % 5]) END AS o FROM customer), h AS (SELECT *, len(list_intersect(e, o)) AS h FROM e)\n"


def eval_rows(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), F.array(k % 3, k % 5, k % 2).alias("expected"), F.when(k % 7 == 0, F.array().cast("array<bigint>")).otherwise(F.array(k % 4, k % 5)).alias("observed"))


@FOUND("set_precision_recall", EVAL_SQL + "SELECT id, round(CASE WHEN len(o) = 0 THEN 0.0 ELSE h / len(o) END, 9) AS precision, round(CASE WHEN len(o) = 0 THEN 0.0 ELSE h / len(e) END, 9) AS recall FROM h")
def set_precision_recall(spark, d):
    rows = evaluation.precision_recall(eval_rows(spark, d))
    return rows.select("id", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@FOUND("micro_macro", EVAL_SQL + "SELECT round(sum(h) / sum(len(o)), 9) AS micro_precision, round(sum(h) / sum(len(e)), 9) AS micro_recall, round(avg(CASE WHEN len(o) > 0 THEN h / len(o) END), 9) AS macro_precision, round(avg(h / len(e)), 9) AS macro_recall FROM h")
def micro_macro(spark, d):
    rows = evaluation.micro_macro(eval_rows(spark, d))
    return rows.select(*[F.round(c, 9).alias(c) for c in rows.columns])


@FOUND("mention_validity", "SELECT count(*) AS total, count(*) FILTER (m < 20) AS valid, string_agg(DISTINCT CASE WHEN m >= 20 THEN CAST(m AS VARCHAR) END, ',' ORDER BY CASE WHEN m >= 20 THEN CAST(m AS VARCHAR) END) AS unknown FROM (SELECT unnest([c_custkey % 17, c_custkey % 23]) AS m FROM customer)")
def mention_validity(spark, d):
    c = table(spark, d, "customer").select(F.array((F.col("c_custkey") % 17).cast("string"), (F.col("c_custkey") % 23).cast("string")).alias("mentions"))
    keys = spark.range(20).select(F.col("id").cast("string").alias("symbol_key"))
    return evaluation.mention_validity(c, keys).withColumn("unknown", F.array_join("unknown", ","))


@FOUND("token_budget_cut", "WITH t AS (SELECT conv_id AS card, turn AS seq, CAST(sum(ceil(length(text) / 4)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tokens, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations) SELECT card, seq, tokens FROM t WHERE tokens <= 60 OR seq = first")
def token_budget_cut(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("card"), F.col("turn").alias("seq"), "text")
    return cards.within_budget(rows, 60).select("card", "seq", "tokens")


@FOUND("status_counts", "SELECT count(*) AS total, count(*) FILTER (o_orderstatus IN ('O', 'P')) AS pending, count(*) FILTER (o_orderstatus = 'F') AS enriched, 0::BIGINT AS errors, 0::BIGINT AS queued FROM orders")
def status_counts(spark, d):
    s = F.col("o_orderstatus")
    return cards.status_counts(table(spark, d, "orders").select(F.when(s == "F", "already_enriched").when(s == "P", "stale").otherwise("pending").alias("status")))


@FOUND("narrative_rollup", "SELECT c_nationkey AS path, string_agg('- ' || c_name || ': ' || c_mktsegment, chr(10) ORDER BY c_name) AS rollup, count(*) AS narratives FROM customer GROUP BY c_nationkey")
def narrative_rollup(spark, d):
    return cards.rollup(table(spark, d, "customer").select(F.col("c_nationkey").alias("path"), F.col("c_name").alias("symbol_key"), F.col("c_mktsegment").alias("summary")))


@FOUND("retry_candidates", "SELECT user_id AS symbol_key, string_agg(event_type, ',' ORDER BY event_id) AS errors, max(CAST(floor(value) AS BIGINT)) AS attempts, arg_max(event_id, floor(value) * 1000000000 + event_id) AS entry FROM events WHERE event_type IN ('error', 'signup') GROUP BY user_id")
def retry_candidates(spark, d):
    e = table(spark, d, "events").where("event_type in ('error', 'signup')")
    rows = e.select(F.col("user_id").alias("symbol_key"), F.col("event_id").alias("seq"), F.col("event_type").alias("error"), F.floor("value").alias("attempts"), F.col("event_id").alias("entry"))
    return cards.retry_candidates(rows).withColumn("errors", F.array_join("errors", ","))


@FOUND("visible_nodes", f"WITH {GRAPH_SQL} SELECT id FROM nodes WHERE community IN (1, 2) AND contains(lower(label), 'customer')")
def visible_nodes(spark, d):
    from graphloom.operators.graph import visible

    return visible(graph_nodes(spark, d), [1, 2], search="Customer").select("id")
