"""WordPiece tokenisation with a supplied vocabulary table.

Two steps:

* basic tokenisation: clean control characters, isolate CJK ideographs and punctuation. The cased form (the default,
  as the study's encoder is cased) is one regular expression in the JVM; the lower-cased form also strips accents,
  which needs Unicode normalisation that Spark SQL does not offer, so it is a small Arrow-batched helper;
* greedy longest-match-first split of each *distinct* basic token into vocabulary pieces (continuations carry the
  ``##`` prefix; a token with no split, or longer than ``max_word_chars``, becomes [UNK]). A vocabulary of checked size is
  broadcast as a set and the distinct tokens are walked in Arrow batches; a larger one is joined with the tokens'
  candidate substrings.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from threadtox.operators import lookup as L
from threadtox.operators.ranking import exact_row_number
from threadtox.operators.text import BROADCAST_MB, fits_broadcast
from threadtox.session import ship_package

# --- fixed values -------------------------------------------------------------------------------
UNK = "[UNK]"
CONTINUATION = "##"
_BETWEEN = "\0"      # stands between the texts of a row that are split together
MAX_WORD_CHARS = 200   # default limit of the published tokenizer's longest-match step
# -------------------------------------------------------------------------------------------------


_CONTROL = regex.compile(r"[\x00\uFFFD\p{Cf}]|[^\P{Cc}\t\n\r]")
_SPACE = regex.compile(r"[ \t\n\r\p{Zs}]")
_CJK = regex.compile("([\u4E00-\u9FFF\u3400-\u4DBF\U00020000-\U0002A6DF\U0002A700-\U0002B73F"
                     "\U0002B740-\U0002B81F\U0002B820-\U0002CEAF\uF900-\uFAFF\U0002F800-\U0002FA1F])")
_MARK = regex.compile(r"\p{Mn}")
_PUNCT = regex.compile(r"([!-/:-@\[-`{-~]|\p{P})")


def basic_tokens(text: str | None, lower: bool = False) -> list[str]:
    """Whitespace/punctuation tokens of one text (the pre-split of WordPiece), in a few regex passes:
    drop control characters, blank out whitespace, space out CJK ideographs, lower-case and strip
    combining marks (NFD), then split punctuation into tokens of their own."""
    if not text:
        return []
    t = _CJK.sub(r" \1 ", _SPACE.sub(" ", _CONTROL.sub("", text)))
    if lower:
        t = _MARK.sub("", unicodedata.normalize("NFD", t.lower()))
    return _PUNCT.sub(r" \1 ", t).split()


# the same pre-split as one pattern, for engines with \\p{..} and \\x{..}
_PUNCT_CLASS = r"!-/:-@\[-`{-~\p{P}"
_CJK_CLASS = (r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}"
              r"\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}")
CONTROL_PATTERN = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}\x{FFFD}\p{Cf}]"
TOKEN_PATTERN = rf"[{_PUNCT_CLASS}{_CJK_CLASS}]|[^ \t\n\r\p{{Zs}}{_PUNCT_CLASS}{_CJK_CLASS}]+"


def basic_tokenize(text: Column, lower: bool = False) -> Column:
    """Column of basic tokens (null text: none)."""
    if not lower:
        clean = F.regexp_replace(F.coalesce(text, F.lit("")), CONTROL_PATTERN, "")
        return F.regexp_extract_all(clean, F.lit(TOKEN_PATTERN), F.lit(0))

    @F.pandas_udf(ArrayType(StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: basic_tokens(t, True))
    return run(text)


def greedy_pieces(word: str, pieces: frozenset[str], longest: int, max_word_chars: int) -> list[str]:
    """Longest-match-first split of one basic token; [UNK] if it has none or is too long."""
    if len(word) > max_word_chars:
        return [UNK]
    out, at = [], 0
    while at < len(word):
        mark = CONTINUATION if at else ""
        for end in range(min(len(word), at + longest), at, -1):
            if (piece := mark + word[at:end]) in pieces:
                break
        else:
            return [UNK]
        out.append(piece)
        at = end
    return out


def _split_with_broadcast(words: DataFrame, vocab: DataFrame, max_word_chars: int) -> DataFrame:
    """__w, __pieces of the distinct basic tokens, walked in Arrow batches with the vocabulary as a broadcast set."""
    spark = words.sparkSession
    pieces = frozenset(r.token for r in vocab.select("token").collect() if r.token)
    shared = spark.sparkContext.broadcast((pieces, max(map(len, pieces), default=1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, longest = shared.value
        for b in batches:
            split = [greedy_pieces(w, known, longest, max_word_chars) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(split, pa.list_(pa.string()))], names=["__w", "__pieces"])

    ship_package(spark)
    return words.select("__w").mapInArrow(run, "__w string, __pieces array<string>")


def _split_with_joins(words: DataFrame, vocab: DataFrame, max_word_chars: int) -> DataFrame:
    """The same with a vocabulary of any size. A word that is a piece needs no walk. Of the others, the substrings that could be
    a piece by their length, at the start of a word or after it, are joined with the vocabulary, the longest match per
    start is aggregated, and the walk is an ``aggregate``."""
    vocab = vocab.select("token").distinct()
    known = words.join(vocab.select(F.col("token").alias("__w")).where(F.length("token") <= max_word_chars), "__w", "left_semi")
    words = words.join(vocab.select(F.col("token").alias("__w")).where(F.length("token") <= max_word_chars), "__w", "left_anti")
    whole = known.select("__w", F.array("__w").alias("__pieces"))
    words = words.withColumn("__L", F.length("__w"))
    lengths = vocab.select(F.length("token").alias("n"), F.col("token").startswith(CONTINUATION).alias("inner")).distinct() \
        .where(F.col("n") <= max_word_chars + len(CONTINUATION)).collect()  # bounded by max_word_chars
    inside = sorted({r.n - len(CONTINUATION) for r in lengths if r.inner and r.n > len(CONTINUATION)})
    heads = sorted({r.n for r in lengths if 0 < r.n <= max_word_chars})
    as_column = lambda ns: F.array(*[F.lit(n) for n in ns]).cast("array<int>")
    short = words.where(F.col("__L") <= max_word_chars)
    # the (start, end) substrings of each distinct word, with the continuation prefix after position 0
    cand = short.withColumn("__s", F.explode(F.sequence(F.lit(0), F.col("__L") - 1)))
    cand = cand.withColumn("__n", F.explode(F.when(F.col("__s") == 0, as_column(heads)).otherwise(as_column(inside)))) \
        .withColumn("__e", F.col("__s") + F.col("__n")).where(F.col("__e") <= F.col("__L"))
    sub = F.substring(F.col("__w"), F.col("__s") + 1, F.col("__e") - F.col("__s"))
    cand = cand.withColumn("__piece", F.when(F.col("__s") == 0, sub).otherwise(F.concat(F.lit(CONTINUATION), sub)))
    hits = cand.join(vocab.select(F.col("token").alias("__piece")), "__piece", "left_semi")
    longest = hits.groupBy("__w", "__L", "__s").agg(F.max("__e").alias("__e"))
    steps = longest.groupBy("__w", "__L").agg(F.map_from_entries(F.collect_list(F.struct("__s", "__e"))).alias("__m"))

    def walk(acc, _):
        nxt = F.try_element_at(F.col("__m"), acc["pos"])
        piece_len = nxt - acc["pos"]
        piece = F.substring(F.col("__w"), acc["pos"] + 1, piece_len)
        piece = F.when(acc["pos"] == 0, piece).otherwise(F.concat(F.lit(CONTINUATION), piece))
        done = (acc["pos"] >= F.col("__L")) | ~acc["ok"]
        return F.when(done, acc).when(nxt.isNull(), F.struct(acc["pos"].alias("pos"), acc["pieces"].alias("pieces"),
                                                             F.lit(False).alias("ok"))) \
            .otherwise(F.struct(nxt.alias("pos"), F.concat(acc["pieces"], F.array(piece)).alias("pieces"),
                                F.lit(True).alias("ok")))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("pieces"), F.lit(True).alias("ok"))
    walked = steps.select("__w", F.aggregate(F.sequence(F.lit(1), F.col("__L")), start, walk).alias("__r"))
    split = walked.select("__w", F.when(F.col("__r.ok") & (F.col("__r.pos") >= F.length("__w")), F.col("__r.pieces"))
                          .alias("__pieces"))
    return whole.unionByName(words.join(split, "__w", "left").select("__w", F.coalesce(F.col("__pieces"), F.array(F.lit(UNK))).alias("__pieces")))


def wordpiece_tokens(df: DataFrame, vocab: DataFrame, text: str = "text", out: str = "pieces",
                     key: str = "id", lower: bool = False, max_word_chars: int = MAX_WORD_CHARS,
                     max_broadcast_mb: float = BROADCAST_MB) -> DataFrame:
    """Add the WordPiece pieces of ``text`` (vocabulary table column ``token``). Rows may share an id or have none. The rows are
    written once with their tokens as integers; only distinct words are split and move with their pieces.

    A vocabulary within ``max_broadcast_mb`` (counted first; about 100 bytes a token) is walked as a broadcast set, a larger
    one joined; the results are the same."""
    pieces = _pieces(df.withColumn("__bt", basic_tokenize(F.col(text), lower)), vocab, out, max_word_chars, max_broadcast_mb)
    return pieces.withColumn(out, F.coalesce(F.col(out), F.array().cast("array<string>")))


def wordpiece_sides(df: DataFrame, vocab: DataFrame, texts: Sequence[str], outs: Sequence[str], lower: bool = False,
                    max_word_chars: int = MAX_WORD_CHARS, max_broadcast_mb: float = BROADCAST_MB) -> DataFrame:
    """The pieces of several text columns, which they replace, in one pass: their tokens lie in one list with a mark between
    two texts (a control character, which no basic token holds)."""
    lists = [basic_tokenize(F.col(t), lower) for t in texts]
    marked = [x for tokens in lists for x in (F.array(F.lit(_BETWEEN)), tokens)][1:]
    rest = _pieces(df.withColumn("__bt", F.concat(*marked)).drop(*texts), vocab, "__all", max_word_chars, max_broadcast_mb)
    rest = rest.withColumn("__all", F.coalesce("__all", F.array().cast("array<string>")))
    for out in outs[:-1]:
        at = F.array_position("__all", _BETWEEN).cast("int")
        rest = rest.withColumns({out: F.slice("__all", F.lit(1), at - 1), "__all": F.slice("__all", at + 1, F.size("__all"))})
    return rest.withColumnRenamed("__all", outs[-1]).select(*(c for c in df.columns if c not in texts), *outs)


def _pieces(df: DataFrame, vocab: DataFrame, out: str, max_word_chars: int, max_broadcast_mb: float) -> DataFrame:
    base = L.coded(df, "__bt")
    ex = L.chunk_words(base)
    words = ex.where(F.col("__w") != _BETWEEN).select("__w").distinct()
    small = fits_broadcast(vocab.count(), 100, max_broadcast_mb)
    per_word = (_split_with_broadcast if small else _split_with_joins)(words, vocab, max_word_chars)
    mark = df.sparkSession.range(1).select(F.lit(_BETWEEN).alias("__w"), F.array(F.lit(_BETWEEN)).alias("__pieces"))
    j = ex.join(per_word.unionByName(mark), "__w").select("__chunk", "__code", F.col("__pieces").alias("__value"))
    return L.decoded(base, j, out)


def wordpiece_vocab(df: DataFrame, text: str = "text", top_words: int | None = None, lower: bool = False) -> DataFrame:
    """A vocabulary derived from the corpus: [PAD] [UNK] [CLS] [SEP], every single character seen (and its
    continuation form), then all longer basic tokens by frequency (ties by token), or the ``top_words`` most
    frequent. token, token_id. Ids of the words come from bucketed ranks, so no task orders the whole vocabulary."""
    from threadtox.functions.text import SPECIAL_TOKENS
    spark = df.sparkSession
    counts_all = df.select(F.explode(basic_tokenize(F.col(text), lower)).alias("t")).groupBy("t").count()
    chars = counts_all.select(F.explode(F.split(F.col("t"), "")).alias("c")).where(F.col("c") != "").distinct()
    # at most two entries a code point: bounded by Unicode
    singles = chars.select(F.col("c").alias("token"), F.lit(1).alias("g")) \
        .unionByName(chars.select(F.concat(F.lit(CONTINUATION), F.col("c")).alias("token"), F.lit(2).alias("g")))
    first = [r.token for r in singles.orderBy("g", "token").collect()]
    head = list(dict.fromkeys([*SPECIAL_TOKENS, *first]))
    head_table = spark.createDataFrame(list(zip(head, range(len(head)))), "token string, token_id long")
    counts = counts_all.where(F.length("t") > 1).join(F.broadcast(head_table.withColumnRenamed("token", "t")), "t", "left_anti")
    ranked = exact_row_number(counts, [], [F.col("count").desc(), F.col("t")], [-F.col("count"), F.substring("t", 1, 2)], name="rank")
    if top_words is not None:
        ranked = ranked.where(F.col("rank") <= top_words)
    return head_table.unionByName(ranked.select(F.col("t").alias("token"), (F.col("rank") + F.lit(len(head) - 1)).cast("long").alias("token_id")))
