"""All queries of the core package and their SQL counterparts."""

from __future__ import annotations

from fluxloom.plans import problems, reference
from fluxloom.plans.oracles import ORACLE_SQL as _SQL

QUERIES: dict[str, problems.Query] = dict(problems.QUERIES) | dict(reference.QUERIES)
ORACLE_SQL: dict[str, str] = {name: sql for name, sql in _SQL.items() if name in QUERIES}
FLAGSHIP: problems.Query = reference.preview_dofs
