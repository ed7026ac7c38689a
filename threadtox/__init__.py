"""threadtox: context-aware comment-toxicity analytics on Spark DataFrames.

Sub-packages
------------
sources    readers, writers and derived input tables
functions  column-level expressions (hashing, tokenising, padding, truncation)
operators  DataFrame -> DataFrame operators (splits, metrics, text, features, models, scoring)
plans      the registered queries and their SQL oracles
streaming  the stateless operators applied to streaming DataFrames
"""

from threadtox.session import build_session, scratch_path

__all__ = ["build_session", "scratch_path"]
