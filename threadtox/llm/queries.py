"""The registered queries of the operators and, where SQL can express them, DuckDB SQL for their rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threadtox.llm import (
    attention_lm,
    collocations,
    decontam,
    dedup,
    divergence,
    html_text,
    impact_index,
    licenses,
    line_quality,
    line_templates,
    mixing,
    token_counts,
    url_rules,
)
from threadtox.llm.rows import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"list_filter(string_split_regex({0}, '[\x09-\x0D\x20]+'), lambda w: w <> '')"


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f
    return add


@query("op1_minhash_dedup", f"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM words
), classes AS MATERIALIZED (
  SELECT min(doc_id) AS c, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
), flat AS MATERIALIZED (SELECT c, n, unnest(s) AS x FROM classes
), links AS MATERIALIZED (
  SELECT a.c AS a, b.c AS b FROM flat a JOIN flat b ON a.x = b.x AND a.c <> b.c GROUP BY a.c, b.c, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT c AS a, c AS b FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), groups AS (SELECT a AS c, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(g.component_id, s.doc_id) AS component_id,
       s.doc_id = coalesce(g.component_id, s.doc_id) AS kept
FROM sets s LEFT JOIN classes k ON s.s = k.s LEFT JOIN groups g ON g.c = k.c
""")
def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary, limit=2048)


_ITEM_WORDS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(_LOWER)


@query("op4_benchmark_decontamination", f"""
WITH items AS (
  SELECT item_id, w FROM (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark) WHERE len(w) > 0
), windows AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS x
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items)
), sizes AS (SELECT DISTINCT n FROM windows
), docs AS MATERIALIZED (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents
), places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS x
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)
), found AS MATERIALIZED (SELECT p.doc_id, p.n, p.i, t.item_id FROM places p JOIN windows t ON p.x = t.x AND p.n = t.n
), hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT doc_id, n, i FROM found)) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(m.n_items, 0) AS BIGINT) AS n_items, coalesce(m.items_sha256, sha256('')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit h ON h.doc_id = d.doc_id LEFT JOIN named m ON m.doc_id = d.doc_id
""")
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/"))


@query("op10_url_filter", """
WITH parts AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages
), split AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM parts
), urls AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM split
), rules(host, path, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fits AS (
  SELECT u.page_id, u.host, u.path, max_by(r.host || r.path, length(r.host || r.path)) AS rule,
         max_by(r.action, length(r.host || r.path)) AS action
  FROM (SELECT DISTINCT * FROM urls) u JOIN rules r
    ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY ALL
)
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.action, 'allow') AS verdict
FROM urls u LEFT JOIN fits f ON f.page_id = u.page_id AND f.host = u.host AND f.path = u.path
""")
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), URL_RULES, default="allow")


@query("op9_quality_rules")
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), min_words=50, max_repeat=50) \
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op2_html_extraction")
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.train(pages))


@query("op7_attention_lm")
def op7_attention_lm(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return attention_lm.score(table(spark, sf_dir, "documents"), vocabulary, modulus=7, remainder=2)


def _line_dedup_sql(depth: int, min_docs: int, min_share: int, lead_share: int, long_docs: int, long_tokens: int) -> str:
    tokens = "list_filter(string_split_regex({0}, '[\\x09-\\x0D\\x20]+'), lambda t: t <> '')"
    fixed = f"(f.i <= {depth} OR c.token IS NOT NULL)"
    return f"""
WITH places AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(t, ' ') AS line, t
  FROM (SELECT doc_id, {tokens.format("line")} AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents
        WHERE doc_id IS NOT NULL AND text IS NOT NULL)) WHERE len(t) > 0
), kinds AS MATERIALIZED (
  SELECT *, len(m) || ' ' || array_to_string(m[1:{depth}], ' ') AS leaf
  FROM (SELECT line, len(t) AS n_tokens, docs, list_transform(t, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS m
        FROM (SELECT line, any_value(t) AS t, count(*) AS docs FROM places GROUP BY line))
), flat AS MATERIALIZED (SELECT leaf, line, docs, n_tokens, i, m[i] AS token FROM (SELECT *, unnest(range(1, n_tokens + 1)) AS i FROM kinds)
), constant AS (SELECT leaf, i, token FROM flat WHERE i > {depth} GROUP BY leaf, i, token HAVING sum(docs) >= {min_docs}
), leaves AS (SELECT leaf FROM kinds GROUP BY leaf HAVING sum(docs) >= {min_docs}
), templates AS MATERIALIZED (
  SELECT f.line, string_agg(CASE WHEN {fixed} THEN f.token ELSE '<*>' END, ' ' ORDER BY f.i) AS template
  FROM flat f LEFT JOIN constant c ON c.leaf = f.leaf AND c.i = f.i AND c.token = f.token WHERE f.leaf IN (FROM leaves) GROUP BY f.line
  HAVING 100 * count(*) FILTER ({fixed} AND f.token <> '<*>')
    >= count(*) * CASE WHEN count(*) FILTER (f.i <= 2 AND f.token <> '<*>') = 2 THEN {min(min_share, lead_share)} ELSE {min_share} END
), rules AS (
  SELECT p.doc_id, p.line, min(p.doc_id) OVER (PARTITION BY t.template) AS holder, t.template
  FROM places p JOIN templates t ON t.line = p.line
  WHERE t.template IN (SELECT t.template FROM places p JOIN templates t ON t.line = p.line GROUP BY t.template HAVING count(DISTINCT p.doc_id) >= {min_docs})
  UNION ALL
  SELECT p.doc_id, p.line, min(p.doc_id) OVER (PARTITION BY p.line), NULL FROM places p JOIN kinds k ON k.line = p.line
  WHERE k.docs >= CASE WHEN k.n_tokens >= {long_tokens} THEN {min(min_docs, long_docs)} ELSE {min_docs} END
), gone AS (SELECT doc_id, list(DISTINCT line) AS lines FROM rules WHERE doc_id > holder GROUP BY doc_id
), kept AS (
  SELECT d.*, string_split(d.text, chr(10)) AS l,
         list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(coalesce(g.lines, []), array_to_string({tokens.format("x")}, ' '))) AS k
  FROM documents d LEFT JOIN gone g ON g.doc_id = d.doc_id
)
SELECT doc_id, array_to_string(k, chr(10)) AS text, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(k) AS BIGINT) AS n_dropped
FROM kept
"""


LINE_DEDUP = {"depth": 3, "min_docs": 5, "min_share": 80, "lead_share": 70, "long_docs": 2, "long_tokens": 50}


@query("op5_line_dedup", _line_dedup_sql(**LINE_DEDUP))
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.drop_templates(docs, counts=True, **LINE_DEDUP)


def _license_sql() -> str:
    """The scan from its tables of sentences and rules: every sentence of every text is read, none is passed over for lack of a word."""
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''").replace("$1", chr(92) + "1").replace("$2", chr(92) + "2") + "'"

    def replaced(expr: str, steps) -> str:
        for pattern, to in steps:
            expr = f"regexp_replace({expr}, {quoted(pattern)}, {quoted(to)}, 'g')"
        return expr

    patterns = ", ".join(f"({i}, {quoted(name)}, {quoted(licenses.over_lines(p))})" for i, (name, p) in enumerate(licenses.SENTENCES))
    exact = " ".join(f"WHEN {quoted(x)} THEN {quoted(name)}" for x, name in licenses.EXACT)
    left = "array_to_string(list_transform(ids, lambda x: ';' || x || ';'), '')"
    for run, name in licenses.RULES:
        left = f"replace({left}, '{''.join(f';{x};' for x in run)}', '[{name}]')"
    tagged = replaced(f"regexp_extract(s, {quoted(licenses.TAG)}, 1)", [(" with [^ ]+", "")])
    return f"""
WITH patterns(k, name, p) AS (VALUES {patterns}
), numbered AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text FROM documents
), parts AS (SELECT r, string_split({replaced("text", licenses.ENDS)}, chr(1)) AS p FROM numbered
), sentences AS MATERIALIZED (
  SELECT r, i, {replaced("lower(s)", licenses.CLEAN)} AS s FROM (SELECT r, i, p[i] AS s FROM (SELECT r, p, unnest(range(1, len(p) + 1)) AS i FROM parts))
), kinds AS MATERIALIZED (
  SELECT *, CASE replace(s, chr(10), ' ') {exact} END AS whole, regexp_matches(s, {quoted(licenses.TAG)}) AS tag,
         regexp_matches(s, {quoted("(?s)" + licenses.DENIED)}) AS denied FROM sentences
), places AS (
  SELECT r, i, strpos(s, regexp_extract(s, p)) AS pos, k, name FROM kinds, patterns
  WHERE whole IS NULL AND NOT tag AND NOT denied AND regexp_matches(s, p)
), named AS (
  SELECT r, i, pos, name FROM places QUALIFY row_number() OVER (PARTITION BY r, i, pos ORDER BY k) = 1
  UNION ALL SELECT r, i, 0, whole FROM kinds WHERE whole IS NOT NULL AND NOT tag
  UNION ALL SELECT r, i, n, 'spdx:' || regexp_replace(regexp_replace(x[n], '-only$', ''), '[+]$', '-or-later')
  FROM (SELECT r, i, x, unnest(range(1, len(x) + 1)) AS n FROM (SELECT r, i, string_split({tagged}, ' ') AS x FROM kinds WHERE tag)) WHERE x[n] NOT IN ('', 'and', 'or')
), matched AS (
  SELECT n.doc_id, coalesce(m.ids, []) AS ids FROM numbered n LEFT JOIN (SELECT r, list(name ORDER BY i, pos) AS ids FROM named GROUP BY r) m ON m.r = n.r
), done AS (SELECT doc_id, ids, {left} AS rest FROM matched
), lists AS (SELECT doc_id, ids, rest, regexp_extract_all(rest, '\\[([^\\]]+)\\]', 1) AS names FROM done)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ',') AS sentence_ids,
  coalesce(array_to_string(list_filter(names, lambda x, i: list_position(names, x) = i), ','), '') AS licenses,
  CAST(len(regexp_extract_all(rest, ';([^;]+);', 1)) AS BIGINT) AS n_unmatched
FROM lists
"""


@query("op6_license_scan", _license_sql())
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def _mixing_sql(target_entropy: float, max_repeat: float, seed: int, block_docs: int) -> str:
    def md5(parts: str) -> str:
        return f"CAST('0x' || substr(md5({parts}), 1, 15) AS BIGINT)"

    doc = "coalesce(CAST(doc_id AS VARCHAR), '')"
    weight = "pow(tokens / total, a)"
    entropy = (f"(SELECT -sum(w / n * ln(w / n)) FROM (SELECT {weight} AS w, sum({weight}) OVER () AS n FROM shares))")
    repeats = f"(SELECT max(total * w / n / tokens) FROM (SELECT tokens, total, {weight} AS w, sum({weight}) OVER () AS n FROM shares))"
    return f"""
WITH RECURSIVE sized AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x09-\\x0D\\x20]+')) AS n_tokens FROM documents
), sums AS MATERIALIZED (SELECT source, CAST(sum(n_tokens) AS DOUBLE) AS tokens, count(*) AS docs FROM sized GROUP BY source
), shares AS MATERIALIZED (SELECT *, sum(tokens) OVER () AS total, count(*) OVER () AS n_sources FROM sums WHERE tokens > 0
), by_entropy(step, lo, hi) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) UNION ALL
  SELECT step + 1, CASE WHEN ok THEN a ELSE lo END, CASE WHEN ok THEN hi ELSE a END
  FROM (SELECT step, lo, hi, a, {entropy} >= {target_entropy} * (SELECT ln(max(n_sources)) FROM shares) AS ok
        FROM (SELECT *, (lo + hi) / 2 AS a FROM by_entropy WHERE step < 40))
), by_repeat(step, lo, hi) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) UNION ALL
  SELECT step + 1, CASE WHEN over THEN a ELSE lo END, CASE WHEN over THEN hi ELSE a END
  FROM (SELECT step, lo, hi, a, {repeats} > {max_repeat} AS over FROM (SELECT *, (lo + hi) / 2 AS a FROM by_repeat WHERE step < 40))
), as_is AS (SELECT {entropy} >= {target_entropy} * (SELECT ln(max(n_sources)) FROM shares) AS flat FROM (SELECT 1.0 AS a)
), start_at AS (SELECT CASE WHEN (SELECT flat FROM as_is) THEN 1.0 ELSE (SELECT (lo + hi) / 2 FROM by_entropy WHERE step = 40) END AS a
), alpha AS (
  SELECT CASE WHEN over THEN greatest(a, (SELECT (lo + hi) / 2 FROM by_repeat WHERE step = 40)) ELSE a END AS a
  FROM (SELECT a, {repeats} > {max_repeat} AS over FROM start_at)
), quotas AS (
  SELECT source, CAST(tokens AS BIGINT) AS tokens, CAST((docs + {block_docs} - 1) // {block_docs} AS BIGINT) AS blocks,
         CAST(floor(w / sum(w) OVER () * total + 1e-6) AS BIGINT) AS quota
  FROM (SELECT s.*, {weight} AS w FROM shares s, alpha)
), plan AS (SELECT source, blocks, quota // tokens AS full_passes, quota % tokens AS rest FROM quotas WHERE quota > 0
), drawn AS MATERIALIZED (
  SELECT z.*, p.full_passes, p.rest, {md5(f"'{seed}:' || {doc}")} % p.blocks AS block,
         unnest(range(1, p.full_passes + CASE WHEN p.rest > 0 THEN 1 ELSE 0 END + 1)) AS epoch
  FROM sized z JOIN plan p ON p.source = z.source
), blocks AS (
  SELECT source, epoch, block, row_number() OVER o AS block_rank,
         coalesce(sum(tokens) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT source, epoch, block, sum(n_tokens) AS tokens FROM drawn GROUP BY ALL)
  WINDOW o AS (PARTITION BY source, epoch ORDER BY {md5(f"'{seed}:' || epoch || ':' || block")}, block)
), placed AS (
  SELECT *, row_number() OVER i AS place, sum(n_tokens) OVER (i ROWS UNBOUNDED PRECEDING) AS so_far FROM drawn
  WINDOW i AS (PARTITION BY source, epoch, block ORDER BY {md5(f"'{seed}:' || epoch || ':' || {doc}")}, doc_id, n_tokens)
)
SELECT p.doc_id, p.source, CAST(p.epoch AS BIGINT) AS epoch, CAST(b.block_rank AS BIGINT) AS block_rank, CAST(p.place AS BIGINT) AS place,
       CAST(p.n_tokens AS BIGINT) AS n_tokens
FROM placed p JOIN blocks b ON b.source = p.source AND b.epoch = p.epoch AND b.block = p.block
WHERE p.epoch <= p.full_passes OR b.before + p.so_far <= p.rest
"""


MIXING = {"target_entropy": 0.98, "max_repeat": 2.0, "seed": 1, "block_docs": 1000}


@query("op8_source_mixing", _mixing_sql(**MIXING))
def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), **MIXING)


def _top_k_sql(k: int, scale: int, divisor: int) -> str:
    bound = int(impact_index.BOUND)
    return f"""
WITH vectors AS MATERIALIZED (
  SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(least(greatest(CAST(x AS DOUBLE) * {scale}, -{bound}), {bound})) AS BIGINT))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(coalesce(list_sum(list_transform(range(1, least(len(a.v), len(b.v)) + 1), lambda i: a.v[i] * b.v[i])), 0) AS BIGINT) AS score
  FROM vectors a JOIN vectors b ON a.vec_id % {divisor} = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, CAST(row_number() OVER o AS INTEGER) AS rank, vec_id, score FROM scored
WINDOW o AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= {k}
"""


@query("op12_exact_top_k", _top_k_sql(k=20, scale=64, divisor=20))
def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return impact_index.top_k(rows.filter("vec_id % 20 = 0"), rows, k=20, scale=64)


def _audit_sql(min_docs: int, top_terms: int, prior: int, scale: int) -> str:
    def share(count: str, total: str) -> str:
        return f"1 + CAST({scale} AS HUGEINT) * ({count} + {prior}) // ({total} + {prior} * v.kept)"

    return f"""
WITH plain AS MATERIALIZED (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), words AS MATERIALIZED (SELECT d, lang, source, unnest(terms) AS term FROM plain
), kept AS MATERIALIZED (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= {min_docs}
), vocabulary AS (SELECT l.lang, count(k.term) AS kept FROM (SELECT DISTINCT lang FROM plain) l LEFT JOIN kept k ON k.lang = l.lang GROUP BY l.lang
), counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM plain) g
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL
), shares AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {share('coalesce(c.n, 0)', 'g.total')} AS p
  FROM groups g JOIN vocabulary v ON v.lang = g.lang JOIN kept k ON k.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), general AS (
  SELECT k.lang, k.term, {share('k.n', 't.total')} AS q FROM (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL) k
  JOIN (SELECT lang, sum(n) AS total FROM counts GROUP BY lang) t ON t.lang = k.lang JOIN vocabulary v ON v.lang = k.lang
), valued AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT a.lang, a.source, b.source AS other, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b
    ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  ) x ON x.lang = a.lang AND x.source = a.source AND x.other = b.source
  UNION ALL
  SELECT s.lang, s.source, 'term', s.term, s.p - g.q FROM shares s JOIN general g ON g.lang = s.lang AND g.term = s.term WHERE s.n > 0 AND s.p > g.q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM valued QUALIFY part = 'pair' OR rank <= {top_terms}
"""


AUDIT = {"min_docs": 30, "top_terms": 50, "prior": 5, "scale": 1_000_000_000}


@query("op13_source_divergence", _audit_sql(**AUDIT))
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), **AUDIT)


def _collocations_sql(min_count: int, percent: int, top: int, scale: int) -> str:
    return f"""
WITH pieces AS MATERIALIZED (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), runs AS MATERIALIZED (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (VALUES (1), (2), (3)) sizes(k) WHERE len(w) >= k)
  GROUP BY ALL
), sizes AS (SELECT lang, sum(f) AS n FROM runs WHERE k = 1 GROUP BY lang
), candidates AS MATERIALIZED (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM runs WHERE k > 1 AND f >= {min_count}
), cuts AS (
  SELECT c.*, cut, l.f AS l, r.f AS r, CAST({scale} AS HUGEINT) * c.a * c.a // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c
  JOIN runs l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:cut], ' ')
  JOIN runs r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1:], ' ')
), inside AS (
  SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, w, a, unnest([1, 2]) AS i FROM candidates WHERE k = 3) GROUP BY ALL
), kept AS (
  SELECT x.* FROM (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1) x
  LEFT JOIN inside i ON i.lang = x.lang AND i.phrase = x.phrase WHERE i.longer IS NULL OR 100 * i.longer < {percent} * x.a
)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a,
       CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(s.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept k JOIN sizes s ON s.lang = k.lang QUALIFY rank <= {top}
"""


COLLOCATIONS = {"min_count": 10, "percent": 50, "top": 2000, "scale": 1_000_000}


@query("op11_phrase_collocations", _collocations_sql(**COLLOCATIONS))
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), **COLLOCATIONS)
