"""Column expressions for tokenising, padding and truncating — all JVM-side, no UDF.

Each Spark expression has a DuckDB twin (``*_sql``) used by the SQL oracles, built from the same
constants so the two engines cannot drift apart.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------------------
# Default filter characters of the word tokenizer (a public Keras default, 33 characters): each is
# turned into a space before splitting on spaces. Apostrophe and carriage return are not in the list.
WORD_FILTERS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n'
# Special tokens of the pair-feature vocabulary, in id order.
SPECIAL_TOKENS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]"]
# -------------------------------------------------------------------------------------------------

_SPACES = " " * len(WORD_FILTERS)


def word_tokens(text: Column) -> Column:
    """lower-case, filter characters -> space, split on single spaces, drop empty pieces."""
    return F.filter(F.split(F.translate(F.lower(text), WORD_FILTERS, _SPACES), " "), lambda t: t != F.lit(""))


def sql_literal(s: str) -> str:
    """A DuckDB string literal (standard SQL: only the quote is escaped)."""
    return "'" + s.replace("'", "''") + "'"


def word_tokens_sql(expr: str) -> str:
    return (f"list_filter(string_split(translate(lower({expr}), {sql_literal(WORD_FILTERS)}, "
            f"{sql_literal(_SPACES)}), ' '), lambda t: t <> '')")


def pad_pre(ids: Column, n: int, value: int = 0) -> Column:
    """Keep the last ``n`` elements, then left-pad with ``value`` to length ``n``."""
    kept = F.slice(ids, F.greatest(F.size(ids) - F.lit(n - 1), F.lit(1)), F.lit(n))
    return F.concat(F.array_repeat(F.lit(value), F.lit(n) - F.size(kept)), kept)


def pad_pre_sql(expr: str, n: int, value: int = 0) -> str:
    kept = f"list_slice({expr}, greatest(len({expr}) - {n - 1}, 1), len({expr}))"
    return f"list_concat(list_transform(range({n} - len({kept})), lambda x: {value}), {kept})"


def pad_post(ids: Column, n: int, value: int = 0) -> Column:
    """Right-pad with ``value`` (cast to the element type of ``ids``) to length ``n``; callers guarantee
    ``size(ids) <= n`` (longer input is returned unchanged, never cut)."""
    fill = F.array_repeat(F.lit(value), F.greatest(F.lit(n) - F.size(ids), F.lit(0)))
    return F.concat(ids, F.transform(fill, lambda x: x.cast("long")))


def pad_post_sql(expr: str, n: int, value: int = 0) -> str:
    return f"list_concat({expr}, list_transform(range({n} - len({expr})), lambda x: {value}))"


def pair_budget(len_a: Column, len_b: Column, budget: int) -> tuple[Column, Column]:
    """Closed form of 'pop one token from the longer side (ties pop b) until a + b <= budget'.

    a' = min(a, max(budget - b, ceil(budget / 2))),  b' = min(b, max(budget - a, floor(budget / 2))).
    """
    hi, lo = (budget + 1) // 2, budget // 2
    keep_a = F.least(len_a, F.greatest(F.lit(budget) - len_b, F.lit(hi)))
    keep_b = F.least(len_b, F.greatest(F.lit(budget) - len_a, F.lit(lo)))
    return keep_a, keep_b


def pair_budget_sql(len_a: str, len_b: str, budget: int) -> tuple[str, str]:
    hi, lo = (budget + 1) // 2, budget // 2
    return (f"least({len_a}, greatest({budget} - {len_b}, {hi}))",
            f"least({len_b}, greatest({budget} - {len_a}, {lo}))")
