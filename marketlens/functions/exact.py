"""Exact rounding and money helpers.

ROUND on doubles differs between engines at binary half-way points, and
AVG(decimal) has engine-specific result scales.  Every rounded ratio in the
reports is therefore computed from integer numerators and denominators
(cents, tenths of a day, counts) with half-away-from-zero rounding, and only
the final value becomes a DOUBLE.  ``sql_ratio_round`` emits the same
arithmetic for the SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio_round(num, den, k: int) -> Column:
    """round(num / den, k), half away from zero; NULL if den is 0 or NULL.

    ``num`` and ``den`` must be integral (bigint or scale-0 decimal).  The
    arithmetic runs in 38 digits, so totals of any table fit: cents in 18
    digits, times a hundred, times 2 * 10^k.
    """
    scale = 10 ** k
    wide = "decimal(38,0)"
    n = _col(num).cast(wide)
    d = _col(den).cast(wide)
    q = F.call_function("div", F.abs(n) * F.lit(2 * scale).cast(wide) + d, d * F.lit(2).cast(wide))
    return F.when(d != 0, F.when(n < 0, -q).otherwise(q).cast("double") / F.lit(float(scale)))


def sql_ratio_round(num: str, den: str, k: int) -> str:
    scale = 10 ** k
    n = f"CAST(({num}) AS HUGEINT)"
    d = f"CAST(({den}) AS HUGEINT)"
    return (
        f"(CASE WHEN {d} <> 0 THEN CAST(sign({n}) * ((abs({n}) * {2 * scale} + {d}) // (2 * {d})) AS DOUBLE)"
        f" / {float(scale)} END)"
    )


def _per(den, units: int) -> Column:
    return _col(den).cast("decimal(38,0)") * F.lit(units).cast("decimal(38,0)")


def money_ratio(num, den, k: int = 2) -> Column:
    """A mean of money: ``num`` in cents over a count, in whole units."""
    return ratio_round(num, _per(den, 100), k)


def days_ratio(num, den, k: int = 1) -> Column:
    """A mean of days: ``num`` in tenths of a day over a count, in days."""
    return ratio_round(num, _per(den, 10), k)


def sql_money_ratio(num: str, den: str, k: int = 2) -> str:
    return sql_ratio_round(num, f"CAST(({den}) AS HUGEINT) * 100", k)


def sql_days_ratio(num: str, den: str, k: int = 1) -> str:
    return sql_ratio_round(num, f"CAST(({den}) AS HUGEINT) * 10", k)


def cents(c) -> Column:
    """DECIMAL(…,2) money → exact BIGINT cents."""
    return (_col(c) * F.lit(100)).cast("bigint")


def sql_cents(expr: str) -> str:
    return f"CAST(({expr}) * 100 AS BIGINT)"


def tenths(c) -> Column:
    """DECIMAL(…,1) day metric → exact BIGINT tenths."""
    return (_col(c) * F.lit(10)).cast("bigint")


def sql_tenths(expr: str) -> str:
    return f"CAST(({expr}) * 10 AS BIGINT)"


def money(c) -> Column:
    """Final projection of an exact decimal amount."""
    return _col(c).cast("double")


def pct(num, den, k: int = 1) -> Column:
    """round(num * 100 / den, k) on integer counts."""
    return ratio_round(_col(num).cast("decimal(38,0)") * F.lit(100).cast("decimal(38,0)"), den, k)


def sql_pct(num: str, den: str, k: int = 1) -> str:
    return sql_ratio_round(f"CAST(({num}) AS HUGEINT) * 100", den, k)


def cond_count(cond: Column) -> Column:
    """SUM(CASE WHEN cond THEN 1 ELSE 0 END) as BIGINT."""
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("bigint")
