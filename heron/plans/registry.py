"""The queries of the reference's operators, with their SQL."""

from __future__ import annotations

from heron.plans import conversations, knowledge, memory, runtime, streams, texts
from heron.plans.base import Query

MODULES = (knowledge, conversations, memory, texts, runtime, streams)


def queries() -> dict[str, Query]:
    return {name: q for m in MODULES for name, q in m.PLANS.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in MODULES for name, s in m.PLANS.sql.items()}
