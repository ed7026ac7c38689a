"""All registered queries (importing the query modules fills the registry)."""

from __future__ import annotations

from threadtox.plans import context, evaluation, features, io, models, scoring, text  # noqa: F401
from threadtox.plans.registry import QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)
