"""Queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from .queries import q01, q02, q03, q04, q05, q06, q07, q08, q09, q10

_MODULES = (q01, q02, q03, q04, q05, q06, q07, q08, q09, q10)

QUERIES = {m.NAME: m.query for m in _MODULES}
ORACLES = {m.NAME: m.ORACLE for m in _MODULES if m.ORACLE}
