"""DuckDB building blocks shared by the oracles (plain window-function SQL: the oracle is the obvious
formulation, so a bug in the scalable Spark plan shows up as a mismatch)."""

from __future__ import annotations

SEED = 42
SPLITS = 10
TEST_SIZE = 0.2


def split_table_sql(source: str = "settings", splits: int = SPLITS, seed: int = SEED,
                    test_size: float = TEST_SIZE) -> str:
    """CTE body: every row of ``source`` x split number, with part by exact hash rank."""
    return f"""SELECT e.* EXCLUDE (r, nv), CASE WHEN r < nv THEN 'val' WHEN r < 2 * nv THEN 'dev' ELSE 'train' END AS part
      FROM (SELECT s.*, row_number() OVER (PARTITION BY setting, split
                                           ORDER BY md5(concat_ws(':', split + {seed}, id)), id) - 1 AS r,
                   CAST(ceil(count(*) OVER (PARTITION BY setting, split) * {float(test_size)}::DOUBLE) AS BIGINT) AS nv
            FROM (SELECT {source}.*, unnest(range({splits})) AS split FROM {source}) s) e"""


def auroc_sql(source: str, keys: list[str], score: str = "score", label: str = "label",
              out: str = "auroc") -> str:
    """Exact AUROC per key group (ties half), n_pos, n_neg; null when a class is missing."""
    k = ", ".join(keys)
    kc = (k + ", ") if keys else ""
    part = f"PARTITION BY {k}" if keys else ""
    group = f"GROUP BY {k}" if keys else ""
    return f"""SELECT {kc}CAST(SUM(pos) AS BIGINT) AS n_pos, CAST(SUM(neg) AS BIGINT) AS n_neg,
             CASE WHEN SUM(pos) > 0 AND SUM(neg) > 0
                  THEN CAST(SUM(pos * (2 * nb + neg)) AS DOUBLE) / (2.0 * SUM(pos) * SUM(neg)) END AS {out}
      FROM (SELECT *, COALESCE(SUM(neg) OVER ({part} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb
            FROM (SELECT {kc}{score} AS score, SUM(CASE WHEN {label} = 1 THEN 1 ELSE 0 END) AS pos,
                         SUM(CASE WHEN {label} = 1 THEN 0 ELSE 1 END) AS neg
                  FROM {source} WHERE {score} IS NOT NULL AND {label} IS NOT NULL GROUP BY {kc}{score}) g) r
      {group}"""
