"""Registered queries: pair truncation, pair features and concatenated representations (F4-F13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadtox.functions.text import SPECIAL_TOKENS, pad_post_sql, pair_budget_sql, word_tokens, word_tokens_sql
from threadtox.operators import features as FE
from threadtox.operators import text as T
from threadtox.operators.inference import bag_network_factory, bag_network_sql, network_scores
from threadtox.plans.registry import register
from threadtox.plans.text import R6, _POOL_SQL
from threadtox.sources import fixtures as fx

MAX_LEN = 128   # pieces the study's encoder reads

_TOKS = (f"toks AS (SELECT id, label, {word_tokens_sql('text')} AS a, "
         f"COALESCE({word_tokens_sql('parent')}, []) AS b FROM gc)")
_KA, _KB = pair_budget_sql("len(a)", "len(b)", MAX_LEN - 3)


def _tokens(spark, d):
    c = fx.comments(spark, d)
    return c.select("id", "label", F.coalesce(word_tokens(F.col("text")), F.array().cast("array<string>")).alias("a"),
                    F.coalesce(word_tokens(F.col("parent")), F.array().cast("array<string>")).alias("b"))


@register("truncate_pair", "F4", fx.with_fixtures(
    f"WITH {_TOKS} SELECT id, list_slice(a, 1, {_KA}) AS ta, list_slice(b, 1, {_KB}) AS tb FROM toks"))
def q_truncate_pair(spark, d):
    t = _tokens(spark, d)
    ta, tb = FE.truncate_pair(F.col("a"), F.col("b"), MAX_LEN)
    return t.select("id", ta.alias("ta"), tb.alias("tb"))


@register("truncate_single", "F5", fx.with_fixtures(
    f"WITH {_TOKS} SELECT id, list_slice(a, 1, {MAX_LEN - 2}) AS ta FROM toks"))
def q_truncate_single(spark, d):
    t = _tokens(spark, d)
    return t.select("id", FE.truncate_single(F.col("a"), MAX_LEN).alias("ta"))


def _pair_sql() -> str:
    cls, sep = f"['{SPECIAL_TOKENS[2]}']", f"['{SPECIAL_TOKENS[3]}']"
    seg = ("list_concat(list_transform(range(len(ta) + 2), lambda x: 0::BIGINT), "
           "list_transform(range(CASE WHEN has_b THEN len(tb) + 1 ELSE 0 END), lambda x: 1::BIGINT))")
    return f"""WITH {_TOKS},
      cut AS (SELECT id, label, len(b) > 0 AS has_b,
                     CASE WHEN len(b) > 0 THEN list_slice(a, 1, {_KA}) ELSE list_slice(a, 1, {MAX_LEN - 2}) END AS ta,
                     CASE WHEN len(b) > 0 THEN list_slice(b, 1, {_KB}) ELSE [] END AS tb FROM toks),
      seq AS (SELECT *, CASE WHEN has_b THEN {cls} || ta || {sep} || tb || {sep} ELSE {cls} || ta || {sep} END AS tokens
              FROM cut),
      ids AS (SELECT s.id, list(CAST(COALESCE(v.token_id, 1) AS BIGINT) ORDER BY s.pos) AS ids
              FROM (SELECT id, unnest(tokens) AS tok, generate_subscripts(tokens, 1) AS pos FROM seq) s
              LEFT JOIN pair_vocab v ON s.tok = v.token GROUP BY s.id)
      SELECT q.id, {pad_post_sql('ids.ids', MAX_LEN, '0::BIGINT')} AS input_ids,
             {pad_post_sql("list_transform(ids.ids, lambda x: 1::BIGINT)", MAX_LEN, '0::BIGINT')} AS input_mask,
             {pad_post_sql(seg, MAX_LEN, '0::BIGINT')} AS segment_ids,
             CAST(q.label AS INTEGER) AS label_id, true AS is_real_example
      FROM seq q JOIN ids ON q.id = ids.id"""


@register("pair_features", "F6 F7 F8 F9 F10 F11 F12", fx.with_fixtures(_pair_sql(), "pair_vocab"))
def q_pair_features(spark, d):
    return FE.pair_features(_tokens(spark, d), fx.pair_vocab(spark, d), "a", "b", MAX_LEN)


def _network_sql() -> str:
    return f"SELECT id, label_id, round({bag_network_sql('input_ids', 'input_mask')}, 9) AS score FROM ({_pair_sql()})"


@register("predict_network", "M6 F12", fx.with_fixtures(_network_sql(), "pair_vocab"))
def q_predict_network(spark, d):
    """A user's network over the encoder inputs of every comment, in batches in the tasks."""
    features = FE.pair_features(_tokens(spark, d), fx.pair_vocab(spark, d), "a", "b", MAX_LEN)
    scored = network_scores(features, bag_network_factory(), {"input_ids": [MAX_LEN], "input_mask": [MAX_LEN]}, keep=["label_id"])
    return scored.select("id", "label_id", F.round("score", 9).alias("score"))


def _concat_sql() -> str:
    text_pool = _POOL_SQL
    parent_pool = _POOL_SQL.replace(word_tokens_sql('text'), f"COALESCE({word_tokens_sql('parent')}, [])")
    return (f"SELECT p.id, list_concat(p.pooled, q.pooled) AS features FROM ({text_pool}) p "
            f"JOIN ({parent_pool}) q ON p.id = q.id")


@register("concat_features", "F13", fx.with_fixtures(_concat_sql(), "word_vectors"))
def q_concat_features(spark, d):
    t = _tokens(spark, d)
    vec = fx.word_vectors(spark, d)
    pa = T.masked_mean_pool(t, vec, 64, tokens="a", out="pa")
    pb = T.masked_mean_pool(t, vec, 64, tokens="b", out="pb")
    j = pa.join(pb, "id")
    return j.select("id", F.transform(F.concat("pa", "pb"), lambda x: F.round(x, R6)).alias("features"))


# ---- WordPiece: the vocabulary is every token of the first training part, so unseen words are split ----

def _train_pieces(spark, d):
    from threadtox.operators import wordpiece as W
    from threadtox.plans.evaluation import split_text
    from threadtox.session import materialized_once
    return materialized_once(spark, ("wordpiece_vocab", d), lambda: W.wordpiece_vocab(split_text(spark, d, 0, "gc", "train")))


def _pieces_sql() -> str:
    from threadtox.operators.wordpiece import CONTROL_PATTERN, TOKEN_PATTERN
    from threadtox.plans.sql import split_table_sql

    def basic(col: str) -> str:
        return f"regexp_extract_all(regexp_replace(coalesce({col}, ''), '{CONTROL_PATTERN}', '', 'g'), '{TOKEN_PATTERN}')"

    return f"""split_table AS ({split_table_sql()}),
      seen AS MATERIALIZED (SELECT t, count(*) AS n FROM (
        SELECT unnest({basic('text')}) AS t FROM split_table WHERE setting = 'gc' AND split = 0 AND part = 'train') GROUP BY t),
      letters AS (SELECT DISTINCT unnest(string_split(t, '')) AS c FROM seen),
      vocab AS MATERIALIZED (
        SELECT token, row_number() OVER (ORDER BY g, o, token) - 1 AS token_id FROM (
          SELECT token, min(g) AS g, min_by(o, g) AS o FROM (
            SELECT unnest({list(SPECIAL_TOKENS)}) AS token, 0 AS g, generate_subscripts({list(SPECIAL_TOKENS)}, 1) AS o
            UNION ALL SELECT c, 1, 0 FROM letters WHERE c <> '' UNION ALL SELECT '##' || c, 2, 0 FROM letters WHERE c <> ''
            UNION ALL SELECT t, 3, -n FROM seen WHERE length(t) > 1) GROUP BY token)),
      basics AS MATERIALIZED (SELECT id, 'text' AS side, {basic('text')} AS b FROM gc UNION ALL SELECT id, 'parent', {basic('parent')} FROM gc),
      words AS MATERIALIZED (SELECT DISTINCT w FROM (SELECT unnest(b) AS w FROM basics)),
      cand AS (SELECT w, s, e FROM (SELECT w, s, unnest(range(s + 1, length(w) + 1)) AS e FROM (
        SELECT w, unnest(range(0, length(w))) AS s FROM words WHERE length(w) <= 200))),
      longest AS MATERIALIZED (SELECT w, s, max(e) AS e FROM cand
        WHERE CASE WHEN s = 0 THEN w[1:e] ELSE '##' || w[s + 1:e] END IN (SELECT token FROM vocab) GROUP BY w, s),
      walk(w, s, pieces) AS (SELECT w, 0::BIGINT, []::VARCHAR[] FROM words
        UNION ALL SELECT k.w, l.e, list_append(k.pieces, CASE WHEN k.s = 0 THEN k.w[1:l.e] ELSE '##' || k.w[k.s + 1:l.e] END)
        FROM walk k JOIN longest l ON l.w = k.w AND l.s = k.s),
      per_word AS MATERIALIZED (SELECT w.w, coalesce(any_value(k.pieces), ['[UNK]']) AS pieces
        FROM words w LEFT JOIN walk k ON k.w = w.w AND k.s = length(w.w) GROUP BY w.w),
      pieces AS MATERIALIZED (SELECT id, side, flatten(list(p.pieces ORDER BY i)) AS pieces FROM (
        SELECT id, side, unnest(b) AS w, generate_subscripts(b, 1) AS i FROM basics) x JOIN per_word p ON p.w = x.w GROUP BY id, side)"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@register("wordpiece_tokens", "F3", _recursive(fx.with_fixtures(
    f"WITH {_pieces_sql()} SELECT g.id, coalesce(p.pieces, []) AS pieces FROM gc g LEFT JOIN pieces p ON p.id = g.id AND p.side = 'text'",
    "settings")))
def q_wordpiece_tokens(spark, d):
    from threadtox.operators import wordpiece as W
    return W.wordpiece_tokens(fx.comments(spark, d).select("id", "text"), _train_pieces(spark, d)).select("id", "pieces")


def _piece_features_sql() -> str:
    toks = ("toks AS (SELECT g.id, g.label, coalesce(p.pieces, []) AS a, coalesce(q.pieces, []) AS b FROM gc g "
            "LEFT JOIN pieces p ON p.id = g.id AND p.side = 'text' LEFT JOIN pieces q ON q.id = g.id AND q.side = 'parent')")
    body = _pair_sql().replace(_TOKS, toks).replace("LEFT JOIN pair_vocab v", "LEFT JOIN vocab v")
    return body.replace("WITH ", f"WITH {_pieces_sql()}, ", 1)


@register("wordpiece_pair_features", "F3 F4 F6 F7 F8 F9 F10 F11 F12", _recursive(fx.with_fixtures(_piece_features_sql(), "settings")))
def q_wordpiece_pair_features(spark, d):
    """The encoder's whole input path: pieces of text and parent -> truncated pair -> ids, mask, segments."""
    from threadtox.operators import wordpiece as W
    vocab = _train_pieces(spark, d)
    c = W.wordpiece_sides(fx.comments(spark, d).select("id", "label", "text", "parent"), vocab, ["text", "parent"], ["a", "b"])
    return FE.pair_features(c, vocab, "a", "b", MAX_LEN)
