"""The thin queries opN_<name>: an operator with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.collocations import collocations
from graphloom.llm.embedding_dedup import near_duplicates
from graphloom.llm.filter_audit import filter_audit
from graphloom.llm.html_text import extract_pages
from graphloom.llm.language_id import language_ids
from graphloom.llm.line_dedup import without_repeated_lines
from graphloom.llm.lz_fingerprint import fingerprints
from graphloom.llm.mixing import mix_sources
from graphloom.llm.ngram_join import near_copies
from graphloom.llm.packing import pack_documents
from graphloom.llm.personal_data import personal_digest, personal_spans
from graphloom.llm.secret_scan import secret_digest, secret_spans
from graphloom.llm.token_counts import token_counts
from graphloom.session import table

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"[^\x20\x09-\x0D]+"
#: What SQL can express whole: the pairs of operators 1, 8 and 9 by brute force behind a join that loses none, and components by recursion.
#: Tokenizers, clustering, Lempel-Ziv parsing, packing, decoding, schedules and markup are beyond it; the tests compare those with plain code.
ORACLE_SQL: dict[str, str] = {
    "op1_signature_trees": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORDS}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(w) < 5 THEN w ELSE w[i : i + 4] END, ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.id)
SELECT r.id AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.id GROUP BY r.id""",
    "op8_line_dedup": f"""WITH t AS (SELECT doc_id, i, line, list_sort(list_distinct(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}'))) AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL)),
c AS (SELECT w, len(w) AS n, min((doc_id, i)) AS first, row_number() OVER () AS c FROM t WHERE len(w) > 0 GROUP BY w),
p AS (SELECT c, n, word FROM (SELECT c, n, word, row_number() OVER (PARTITION BY c ORDER BY seen, word) AS k FROM (SELECT c, n, word, count(*) OVER (PARTITION BY word) AS seen FROM (SELECT c, n, unnest(w) AS word FROM c))) WHERE k <= n - ceil(n * 80 / 100) + 1),
m AS (SELECT DISTINCT a.c AS a, b.c AS b FROM p a JOIN p b ON a.word = b.word AND a.c <> b.c AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
g AS (SELECT DISTINCT y.c FROM m JOIN c x ON x.c = m.a JOIN c y ON y.c = m.b WHERE x.first < y.first AND 100 * len(list_intersect(x.w, y.w)) >= 80 * (x.n + y.n - len(list_intersect(x.w, y.w)))),
k AS (SELECT t.doc_id, t.i, t.line, c.c IS NOT NULL AND ((t.doc_id, t.i) <> c.first OR g.c IS NOT NULL) AS gone FROM t LEFT JOIN c ON c.w = t.w LEFT JOIN g ON g.c = c.c),
o AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed FROM k GROUP BY doc_id)
SELECT d.doc_id, o.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed FROM documents d LEFT JOIN o USING (doc_id)""",
    "op9_sorted_projections": """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM v WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.norm > 0 AND b.norm > 0 AND list_inner_product(a.v, b.v) >= 0.98 * a.norm * b.norm),
r AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.id)
SELECT id AS vec_id, (SELECT count(*) FROM l WHERE x = id) AS n_links, min(root) AS component_id, min(root) = id AS kept FROM r GROUP BY id""",
    "op11_suffix_collocations": f"""WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
g AS (SELECT lang, words, array_to_string(w[i : i + words - 1], ' ') AS phrase, count(*) AS f FROM (SELECT lang, w, words, unnest(range(1, len(w) - words + 2)) AS i FROM p, (VALUES (1), (2), (3)) v(words)) GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE words > 1),
s AS (SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, (CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM (SELECT *, unnest(range(1, words)) AS k FROM c) c JOIN g l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:k], ' ') JOIN g r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1 :], ' ')),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM s) WHERE o = 1),
x AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE words = 3) GROUP BY ALL),
k AS (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b LEFT JOIN x USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM k JOIN t USING (lang) WHERE rank <= 2000""",
    "op12_filter_audit": """WITH RECURSIVE t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
d AS (SELECT doc_id, part, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask FROM t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n FROM d LEFT JOIN l USING (doc_id) GROUP BY ALL),
o AS (SELECT '' AS o UNION ALL SELECT o || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(o, x)),
s AS (SELECT o AS filter_order, CAST(i AS INTEGER) AS step, o[i] AS letter, 1 << (ascii(o[i]) - 65) AS bit, list_sum(list_transform(range(1, i), lambda j: 1 << (ascii(o[j]) - 65))) AS earlier FROM o, range(1, 6) r(i) WHERE length(o) = 5),
m AS (SELECT part, filter_order, step, letter, sum(CASE WHEN mask & (bit | coalesce(earlier, 0)::INTEGER) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(earlier, 0)::INTEGER = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(earlier, 0)::INTEGER <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(earlier, 0)::INTEGER = 0 THEN n * good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(earlier, 0)::INTEGER = 0 THEN n * toxic ELSE 0 END) AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM m""",
}


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark, table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(secret_spans(spark, table(spark, sf_dir, "documents")))


def op5_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, table(spark, sf_dir, "documents"))


def op4_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark, table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_ids(spark, table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark, table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark, table(spark, sf_dir, "pages"))


def op9_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "embeddings"))


def op1_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(spark, table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that has a word is compared."""
    return without_repeated_lines(spark, table(spark, sf_dir, "documents"), least_words=1).select("doc_id", "text", "n_lines", "n_removed")


def op11_suffix_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark, table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_digest(personal_spans(spark, table(spark, sf_dir, "documents")))
