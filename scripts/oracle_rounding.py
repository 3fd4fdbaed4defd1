"""The registry's SQL twins with their double columns rounded like the queries' results.

Output types come from DuckDB binding the SQL against the smallest tables (DESCRIBE, nothing runs).
Kept outside the package: the library itself needs neither DuckDB nor test tables.
"""

from __future__ import annotations

from airwise.plans.registry import ORACLE

_WRAPPED: dict[str, str] = {}


def rounded_oracles(schema_dir: str = "/root/testdata/sf0.001") -> dict[str, str]:
    """Oracle SQL with every DOUBLE/FLOAT output column rounded like ``finish``.

    Output types come from DuckDB binding the query (DESCRIBE, no execution)
    against the smallest data set; any failure leaves the SQL unwrapped."""
    if len(_WRAPPED) == len(ORACLE):
        return dict(_WRAPPED)
    import os

    candidates = [schema_dir] + [f"/root/testdata/sf{x}" for x in ("0.001", "0.01", "0.1")]
    found = next((c for c in candidates if os.path.exists(f"{c}/events.parquet")), None)
    if found is None:
        return dict(ORACLE)
    try:
        import duckdb

        con = duckdb.connect()
        for t in ("region nation customer supplier part orders lineitem events documents embeddings "
                  "pages benchmark labels conversations").split():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{found}/{t}.parquet')")
    except Exception:  # noqa: BLE001
        return dict(ORACLE)
    for name, sql in ORACLE.items():
        try:
            desc = con.execute(f"DESCRIBE {sql}").fetchall()
            dbl = [r[0] for r in desc if r[1] in ("DOUBLE", "FLOAT", "REAL")]
            if dbl:
                rep = ", ".join(f'round(CAST("{c}" AS DOUBLE), 6) + CAST(0 AS DOUBLE) AS "{c}"' for c in dbl)
                _WRAPPED[name] = f"SELECT * REPLACE ({rep}) FROM ({sql}) AS _q"
            else:
                _WRAPPED[name] = sql
        except Exception:  # noqa: BLE001
            _WRAPPED[name] = sql
    return dict(_WRAPPED)
