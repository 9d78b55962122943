"""Independent DuckDB oracle: one SQL text per registered query.

The SQL reads only the driver's base tables; the campus views it needs are
inlined as CTEs from :mod:`.fixture_sql`.  Rules followed everywhere:
every output column aliased to the Spark name; integer sums cast to BIGINT
(DuckDB widens them to HUGEINT); ratios guarded by NULLIF (DuckDB gives
``inf`` for x/0.0); rounding is ``floor(x*100+0.5)/100`` on DOUBLE.
"""

from __future__ import annotations

import re

from ..sources.schemas import SCHEMAS
from .fixture_sql import VIEW_SQL

_DUCK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
               "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
               "boolean": "BOOLEAN"}
_VIEW_COLS = {
    v: set(re.findall(r"\bAS\s+(\w+)\s*(?:,|\n|$)", sql)) | {"etudiant_id", "cours_id"}
    for v, sql in VIEW_SQL.items()
}


def conformed_view(name: str) -> str:
    """The fixture view with every column of the fixed schema: the columns the
    view does not carry are typed NULLs (as the Spark loader does)."""
    inner = VIEW_SQL[name].strip()
    have = _VIEW_COLS[name]
    cols = []
    for f in SCHEMAS[name].fields:
        t = _DUCK_TYPES[f.dataType.simpleString()]
        cols.append(f"CAST({f.name if f.name in have else 'NULL'} AS {t}) AS {f.name}")
    return f"SELECT {', '.join(cols)} FROM ({inner}) v"


def with_views(body: str) -> str:
    """Prefix ``body`` with CTEs for every campus view it names."""
    used = [v for v in VIEW_SQL if re.search(rf"\b{v}\b", body)]
    if not used:
        return body.strip()
    ctes = ",\n".join(f"{v} AS ({conformed_view(v)})" for v in used)
    body = body.strip()
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes},\n{body[14:].lstrip()}"
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"


def r2(x: str) -> str:
    """T1 rounding in SQL."""
    return f"(floor(({x}) * 100 + 0.5) / 100)"
