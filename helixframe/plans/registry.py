"""Query catalogue: key -> Spark plan over the driver tables, plus its SQL twin.

Every registered query reads whole driver tables (or data Spark derives from
them).  The SQL twin is an independent formulation of the same result that
DuckDB runs on the same parquet files; doubles are rounded on both sides, in
the registered outer query only, so that summation order does not matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

DIGITS = 6
#: Columns that are products of powers, compared by significant digits alone
#: however small they are.
RELATIVE = ("e_value", "p_value", "pearson_p", "spearman_p")


def register(key: str, sql: str | None = None):
    """Register a query under ``key`` with an optional oracle SQL string."""
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def finish(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every floating column (top level and arrays of doubles)."""
    out = []
    for name, dtype in df.dtypes:
        c = F.col(name)
        if name in RELATIVE and dtype == "double":
            c = F.when(c.isNotNull(), F.format_string(f"%.{SIGNIFICANT - 1}e", c).cast("double"))
        elif dtype in ("double", "float"):
            c = round_half_even(c, digits)
        elif dtype in ("array<double>", "array<float>"):
            c = F.transform(c, lambda x: round_half_even(x, digits))
        out.append(c.alias(name))
    return df.select(*out)


SIGNIFICANT = 10


def round_half_even(c, digits: int = DIGITS):
    """rint(x * 10^d) / 10^d (+0.0 folds -0.0) with d = min(digits, 10 - 1 -
    floor(log10|x|)) clamped at 0: six decimals for ordinary values, ten
    significant digits for large sums (whose last bits depend on summation
    order).  The SQL side applies the same IEEE operations."""
    x = c.cast("double")
    d = F.least(F.greatest(F.lit(SIGNIFICANT - 1) - F.floor(F.log10(F.abs(x))), F.lit(0)), F.lit(digits))
    scale = F.pow(F.lit(10.0), d)
    plain = F.isnan(x) | (F.abs(x) == float("inf")) | (x == 0)
    return F.when(plain, x + F.lit(0.0)).otherwise(F.rint(x * scale) / scale + F.lit(0.0))


def _round_expr(name: str, dtype: str, digits: int) -> str | None:
    q = '"' + name.replace('"', '""') + '"'
    t = dtype.upper()
    def rnd(v: str) -> str:
        x = f"CAST({v} AS DOUBLE)"
        d = f"least(greatest({SIGNIFICANT - 1} - floor(log10(abs({x}))), 0), {digits})"
        scale = f"pow(CAST(10.0 AS DOUBLE), {d})"
        return (f"CASE WHEN isnan({x}) OR isinf({x}) OR {x} = 0 THEN {x} + CAST(0.0 AS DOUBLE) "
                f"ELSE round_even({x} * {scale}, 0) / {scale} + CAST(0.0 AS DOUBLE) END")
    if name in RELATIVE and t == "DOUBLE":
        return f"CAST(printf('%.{SIGNIFICANT - 1}e', {q}) AS DOUBLE) AS {q}"
    if t in ("DOUBLE", "FLOAT", "REAL"):
        return f"{rnd(q)} AS {q}"
    if t in ("DOUBLE[]", "FLOAT[]"):
        return f"list_transform({q}, lambda v: {rnd('v')}) AS {q}"
    return None


def rounded_oracle(sql_by_key: dict[str, str], sample_dir: str, digits: int = DIGITS) -> dict[str, str]:
    """Wrap each SQL twin so its floating columns are rounded like ``finish``.

    Column types come from DuckDB's DESCRIBE on the (small) sample tables,
    which binds the query without running it.
    """
    try:
        import duckdb
    except ImportError:  # pragma: no cover
        return dict(sql_by_key)
    import os

    from helixframe.sources.tables import TABLES

    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sample_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    out = {}
    for key, sql in sql_by_key.items():
        try:
            desc = con.execute(f"DESCRIBE {sql}").fetchall()
        except Exception:  # noqa: BLE001  (leave it unwrapped; the check reports it)
            out[key] = sql
            continue
        repl = [e for e in (_round_expr(r[0], r[1], digits) for r in desc) if e]
        if repl:
            out[key] = f"SELECT * REPLACE ({', '.join(repl)}) FROM ({sql}) AS __q"
        else:
            out[key] = sql
    con.close()
    return out
