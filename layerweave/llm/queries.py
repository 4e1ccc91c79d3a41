"""The registered queries of the subpackage, with their SQL twins where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerweave.llm import (
    byte_bpe, dataset_manifest, hard_negatives, impact_search, jaccard_join, line_dedup, maxent_lm, mixing, quality_rules, rule_ensemble, text_trees,
    toxicity, url_filter,
)
from layerweave.plans.registry import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


# Words in SQL: the text's pieces between white space.
WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

MIX_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest, len({WORDS})::BIGINT AS size,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g')) AS symbols FROM documents),
units AS (
  SELECT doc_id, source, digest, count(*)::BIGINT AS copies, any_value(size) AS size,
    -ln((('0x' || substr(md5(concat_ws(':', 'mix', doc_id::VARCHAR, digest)), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)
      / (1.0::DOUBLE / (1.0::DOUBLE + any_value(symbols)::DOUBLE / greatest(any_value(size), 1)::DOUBLE)) AS key
  FROM sized GROUP BY doc_id, source, digest),
sources AS (SELECT source, sum(size * copies)::BIGINT AS source_size FROM units GROUP BY source),
weighed AS (
  SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER earlier, 0.0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER earlier, 0.0)) AS level
  FROM weighed WINDOW earlier AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, coalesce(least(cap, max(CASE WHEN cap > level * w THEN level END) OVER () * w), cap) AS target FROM levels),
placed AS (
  SELECT *, coalesce(sum(size * copies) OVER (PARTITION BY source ORDER BY key, doc_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM units),
shares AS (
  SELECT p.*, t.source_size, t.target, CASE WHEN t.source_size = 0 THEN 0 ELSE floor(t.target / t.source_size)::BIGINT END AS epochs
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(floor(target)::BIGINT - epochs * source_size - earlier, size * copies)) // copies)::BIGINT AS taken
FROM (SELECT *, unnest(range(copies)) AS copy FROM shares)
"""


@query("op7_mix_sources", MIX_SQL)
def mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed_rows(table(spark, folder, "documents"))


TOP_K_SQL = """
WITH vectors AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query("op8_top_k_search", TOP_K_SQL)
def top_k_search(spark: SparkSession, folder: str) -> DataFrame:
    return impact_search.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


RULES_SQL = rf"""
WITH cut AS (
  SELECT doc_id, {WORDS} AS words, coalesce(text, '') AS body,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
windows AS (
  SELECT *, list_transform(range(1, greatest(len(words) - 6, 1)), lambda i: array_to_string(list_slice(words, i, i + 7), chr(10))) AS grams FROM cut),
counted AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
    length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    CASE WHEN len(list_distinct(grams)) = len(grams) THEN 0 ELSE (
      SELECT count(DISTINCT pos + step) FROM (
        SELECT unnest(spots) AS pos FROM (
          SELECT list(pos) AS spots FROM (SELECT unnest(grams) AS gram, unnest(range(len(grams))) AS pos) GROUP BY gram HAVING count(*) > 1)), range(8) AS r(step)
    ) END::BIGINT AS n_repeat_words,
    len(list_filter(words, lambda w: list_contains([{", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)}], lower(w))))::BIGINT AS n_stop_words,
    len(list_filter(lines, lambda x: rtrim(x, ' ') LIKE '%...' OR rtrim(x, ' ') LIKE '%…'))::BIGINT AS n_ellipsis_lines,
    len(list_filter(lines, lambda x: substr(ltrim(x, ' '), 1, 1) IN ('-', '*', '•')))::BIGINT AS n_bullet_lines
  FROM windows),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted)
SELECT *, NOT base_failed AND coalesce(n_words >= 20, true)
  AND coalesce(word_chars / nullif(n_words, 0) BETWEEN 2 AND 20, true) AND coalesce(n_symbols / nullif(n_words, 0) <= 0.1::DOUBLE, true)
  AND coalesce(n_stop_words / nullif(n_words, 0) >= 0.02::DOUBLE, true) AND coalesce(n_dup_lines / nullif(n_lines, 0) <= 0.6::DOUBLE, true)
  AND coalesce(n_ellipsis_lines / nullif(n_lines, 0) <= 0.3::DOUBLE, true) AND coalesce(n_bullet_lines / nullif(n_lines, 0) <= 0.9::DOUBLE, true) AS kept
FROM judged
"""


@query("op9_quality_rules", RULES_SQL)
def quality_rule_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(table(spark, folder, "documents"))


@query("op3_byte_bpe")
def byte_bpe_documents(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode_documents(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)


@query("op4_quality_classifier")
def quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return rule_ensemble.classify(docs, rule_ensemble.train(docs, table(spark, folder, "labels")))


@query("op6_toxicity")
def toxic_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.classify(docs, toxicity.train(docs, table(spark, folder, "labels")))

#: Fixed rules of the URL query.
URL_RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
)


@query("op2_url_filter")
def url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(table(spark, folder, "pages"), URL_RULES)


LINES_SQL = r"""
WITH cut AS (
  SELECT doc_id, md5(coalesce(text, '')) AS digest, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM (SELECT DISTINCT doc_id, text FROM documents)),
lines AS (
  SELECT doc_id, digest, pos, md5(trim(line, ' ')) AS h, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words FROM cut),
placed AS (
  SELECT *, (sum(words) OVER (PARTITION BY doc_id, digest ORDER BY pos) - words)::BIGINT AS start FROM lines WHERE words > 0),
grams AS (
  SELECT *, md5(array_to_string(list(h) OVER gram, '')) AS gram_key, sum(words) OVER gram AS held,
    list(h) OVER reach AS ahead, list(pos) OVER reach AS ahead_at, list(h) OVER back AS behind, list(pos) OVER back AS behind_at
  FROM placed WINDOW gram AS (PARTITION BY doc_id, digest ORDER BY start RANGE BETWEEN CURRENT ROW AND 24 FOLLOWING),
    reach AS (PARTITION BY doc_id, digest ORDER BY start RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING),
    back AS (PARTITION BY doc_id, digest ORDER BY start RANGE BETWEEN 50 PRECEDING AND 1 PRECEDING)),
least_of AS (
  SELECT *, min(CASE WHEN held >= 25 THEN {'k': gram_key, 'p': pos} END) OVER (
    PARTITION BY doc_id, digest ORDER BY start RANGE BETWEEN CURRENT ROW AND 24 FOLLOWING) AS smallest FROM grams),
found AS (
  SELECT * FROM least_of WHERE held >= 25 QUALIFY list_contains(list(smallest.p) OVER (
    PARTITION BY doc_id, digest ORDER BY start RANGE BETWEEN 24 PRECEDING AND CURRENT ROW), pos)),
ranked AS (
  SELECT *, row_number() OVER by_key AS n, first_value(ahead) OVER by_key AS first_ahead, first_value(behind) OVER by_key AS first_behind
  FROM found WINDOW by_key AS (PARTITION BY gram_key ORDER BY doc_id NULLS LAST, digest, pos)),
matched AS (
  SELECT *, coalesce(list_min(list_filter(range(1, len(ahead) + 1), lambda i: i > len(first_ahead) OR ahead[i] <> first_ahead[i])) - 1, len(ahead)) AS r,
    coalesce(list_min(list_filter(range(1, coalesce(len(behind), 0) + 1), lambda i: i > coalesce(len(first_behind), 0) OR behind[-i] <> first_behind[-i])) - 1,
      coalesce(len(behind), 0)) AS l
  FROM ranked WHERE n > 1),
runs AS (SELECT doc_id, digest, CASE WHEN l > 0 THEN behind_at[-l] ELSE pos END AS a, ahead_at[r] AS b FROM matched),
gone AS (
  SELECT DISTINCT c.doc_id, c.digest, c.pos FROM cut c JOIN runs r ON c.doc_id IS NOT DISTINCT FROM r.doc_id AND c.digest = r.digest AND c.pos BETWEEN r.a AND r.b),
kept AS (
  SELECT c.doc_id, c.digest, count(*)::BIGINT AS n_lines, count(g.pos)::BIGINT AS n_deleted,
    coalesce(string_agg(c.line, chr(10) ORDER BY c.pos) FILTER (WHERE g.pos IS NULL), '') AS left_over
  FROM cut c LEFT JOIN gone g ON c.doc_id IS NOT DISTINCT FROM g.doc_id AND c.digest = g.digest AND c.pos = g.pos GROUP BY ALL)
SELECT d.doc_id, k.n_lines, k.n_deleted, CASE WHEN k.n_deleted = 0 THEN d.text ELSE k.left_over END AS text
FROM documents d JOIN kept k ON d.doc_id IS NOT DISTINCT FROM k.doc_id AND md5(coalesce(d.text, '')) = k.digest
"""


@query("op5_line_dedup", LINES_SQL)
def repeated_lines_out(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, folder, "documents"), count=True)


@query("op10_jaccard_join")
def similar_documents(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.components(table(spark, folder, "documents"), words=4, percent=85).select("doc_id", "n_shingles", "component_id")


@query("op1_lm_scoring")
def lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return maxent_lm.score(table(spark, folder, "documents"))


FINGERPRINTS_SQL = rf"""
WITH ordered AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id NULLS LAST) AS n FROM documents),
pairs AS (
  SELECT n, doc_id, text, coalesce(lead(text) OVER (ORDER BY n), first_value(text) OVER (ORDER BY n)) AS following,
    coalesce(lead(n) OVER (ORDER BY n), first_value(n) OVER (ORDER BY n)) AS following_n FROM ordered),
forms AS (
  SELECT n, 0 AS form, text FROM pairs
  UNION ALL SELECT n, 1, left(text, length(text) - length(text) // 2) || left(following, length(text) // 2) FROM pairs),
leaves AS (
  SELECT n, form, unnest(leaves) AS leaf, generate_subscripts(leaves, 1) AS pos
  FROM (SELECT n, form, regexp_extract_all(text, '{text_trees.LEAF}') AS leaves FROM forms)),
named AS (
  SELECT n, form, pos, sha256('0' || leaf) AS h,
    coalesce(sum((right(leaf, 1) = chr(10))::INTEGER) OVER (PARTITION BY n, form ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS para FROM leaves),
paras AS (
  SELECT n, form, para, sha256('1' || string_agg(h, '' ORDER BY pos)) AS h, string_agg(to_base64(unhex(left(h, 6))), '' ORDER BY pos) AS spelled
  FROM named GROUP BY n, form, para),
sectioned AS (
  SELECT *, coalesce(sum((left(h, 1) IN ('0', '1'))::INTEGER) OVER (PARTITION BY n, form ORDER BY para ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS section
  FROM paras),
sections AS (
  SELECT n, form, section, sha256('2' || string_agg(h, '' ORDER BY para)) AS h, string_agg(spelled, ',' ORDER BY para) AS spelled
  FROM sectioned GROUP BY n, form, section),
trees AS (
  SELECT n, form, sha256('3' || string_agg(h, '' ORDER BY section)) || ':' || string_agg(spelled, ';' ORDER BY section) AS tree
  FROM sections GROUP BY n, form),
all_trees AS (SELECT n, form, coalesce(tree, sha256('3') || ':') AS tree FROM forms LEFT JOIN trees USING (n, form)),
counted AS (SELECT n, form, left(h, 6) AS leaf, count(*) AS c FROM named GROUP BY ALL),
sizes AS (SELECT n, form, sum(c) AS c FROM counted GROUP BY n, form),
compared AS (SELECT n, 1 AS form, n AS other, 1 AS other_form FROM pairs UNION ALL SELECT n, 0, following_n, 0 FROM pairs),
common AS (
  SELECT c.n, c.form, sum(least(a.c, b.c)) AS shared FROM compared c JOIN counted a ON a.n = c.n AND a.form = 0
  JOIN counted b ON b.n = c.other AND b.form = c.other_form AND b.leaf = a.leaf GROUP BY c.n, c.form),
alike AS (
  SELECT c.n, c.form, CASE WHEN a.tree = b.tree THEN 1.0::DOUBLE WHEN s.c IS NULL OR t.c IS NULL THEN 0.0::DOUBLE
    ELSE 2.0::DOUBLE * coalesce(m.shared, 0) / (s.c + t.c) END AS likeness
  FROM compared c JOIN all_trees a ON a.n = c.n AND a.form = 0 JOIN all_trees b ON b.n = c.other AND b.form = c.other_form
  LEFT JOIN sizes s ON s.n = c.n AND s.form = 0 LEFT JOIN sizes t ON t.n = c.other AND t.form = c.other_form
  LEFT JOIN common m ON m.n = c.n AND m.form = c.form)
SELECT p.doc_id, length(p.text)::BIGINT AS n_chars, sha256(e.text) AS edited_sha256, own.tree AS fingerprint, made.tree AS edited_fingerprint,
  near_made.likeness AS near_edited, near.likeness AS near_next
FROM pairs p JOIN forms e ON e.n = p.n AND e.form = 1 JOIN all_trees own ON own.n = p.n AND own.form = 0 JOIN all_trees made ON made.n = p.n AND made.form = 1
JOIN alike near_made ON near_made.n = p.n AND near_made.form = 1 JOIN alike near ON near.n = p.n AND near.form = 0
"""


@query("op11_document_fingerprints", FINGERPRINTS_SQL)
def document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return text_trees.compare_with_edits(table(spark, folder, "documents"))


def _field(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen({name}::VARCHAR) || ':' || {name}::VARCHAR END"


# crc32 of the decimal id from its rule: eight halvings per value of a byte, then one look-up per digit.
MANIFEST_SQL = f"""
WITH RECURSIVE crc_bytes AS (
  SELECT list(list_reduce(list_concat([i::BIGINT], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) AS r(i)),
coded AS (
  SELECT *, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
    lambda c, d: xor(t[xor(c & 255, d) + 1], c >> 8)) AS crc
  FROM documents, crc_bytes),
leaves AS (
  SELECT source, doc_id, sha256({" || ".join(_field(c) for c in dataset_manifest.DOCUMENT)}) AS leaf,
    sha256({" || ".join(_field(c) for c in dataset_manifest.DOCUMENT[:-1])} || {_field("broken")}) AS checked
  FROM (SELECT *, CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS broken FROM coded)),
sources AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) AS n FROM leaves GROUP BY source),
ranked AS (
  SELECT l.*, s.tree, s.n, row_number() OVER (PARTITION BY s.tree ORDER BY l.doc_id NULLS FIRST, l.leaf) - 1 AS rank
  FROM leaves l JOIN sources s ON l.source IS NOT DISTINCT FROM s.source),
low AS (
  SELECT tree, 0 AS level, rank AS k, n, leaf AS h FROM ranked
  UNION ALL SELECT tree, level + 1, k // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY k)) FROM low WHERE n > 1 GROUP BY tree, level, k // 3, n),
high AS (
  SELECT 0 AS level, tree AS k, (SELECT count(*) FROM sources) AS n, h FROM low WHERE n = 1
  UNION ALL SELECT level + 1, k // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY k)) FROM high WHERE n > 1 GROUP BY level, k // 3, n),
steps AS (
  SELECT r.tree, r.rank, a.level, coalesce(string_agg(a.h, '' ORDER BY a.k) FILTER (WHERE a.k < r.rank // (3 ** a.level)::BIGINT), '') AS l,
    coalesce(string_agg(a.h, '' ORDER BY a.k) FILTER (WHERE a.k > r.rank // (3 ** a.level)::BIGINT), '') AS r
  FROM ranked r JOIN low a ON a.tree = r.tree AND a.n > 1 AND a.k // 3 = r.rank // (3 ** (a.level + 1))::BIGINT GROUP BY r.tree, r.rank, a.level),
high_steps AS (
  SELECT s.tree, a.level, coalesce(string_agg(a.h, '' ORDER BY a.k) FILTER (WHERE a.k < s.tree // (3 ** a.level)::BIGINT), '') AS l,
    coalesce(string_agg(a.h, '' ORDER BY a.k) FILTER (WHERE a.k > s.tree // (3 ** a.level)::BIGINT), '') AS r
  FROM sources s JOIN high a ON a.n > 1 AND a.k // 3 = s.tree // (3 ** (a.level + 1))::BIGINT GROUP BY s.tree, a.level),
paths AS (SELECT tree, rank, list(l || '|' || r ORDER BY level) AS path FROM steps GROUP BY tree, rank),
high_paths AS (SELECT tree, list(l || '|' || r ORDER BY level) AS path FROM high_steps GROUP BY tree),
whole AS (
  SELECT r.*, s.h AS subroot, (SELECT h FROM high WHERE n = 1) AS root, list_concat(coalesce(p.path, []), coalesce(hp.path, [])) AS path
  FROM ranked r JOIN low s ON s.tree = r.tree AND s.n = 1 LEFT JOIN paths p ON p.tree = r.tree AND p.rank = r.rank LEFT JOIN high_paths hp ON hp.tree = r.tree),
folds AS (
  SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256,
    list_reduce(list_concat([checked], path), lambda h, s: sha256(split_part(s, '|', 1) || h || split_part(s, '|', 2))) AS folded_root FROM whole)
SELECT *, folded_root = root AS verified FROM folds
"""


@query("op12_dataset_manifest", MANIFEST_SQL)
def dataset_proofs(spark: SparkSession, folder: str) -> DataFrame:
    return dataset_manifest.verify_documents(table(spark, folder, "documents"))


NEGATIVES_SQL = """
WITH vectors AS (
  SELECT DISTINCT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i]))::BIGINT AS score
  FROM vectors a JOIN vectors c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank,
  n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN scored n USING (anchor_id) WHERE NOT n.same AND 80 * positive_score <= 100 * n.score AND n.score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) <= 5
"""


@query("op13_hard_negatives", NEGATIVES_SQL)
def mined_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label)
