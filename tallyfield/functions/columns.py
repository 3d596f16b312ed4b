"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is null or 0."""
    return F.when(b != 0, a / b)


def ieee_ratio(a: Column, b: Column) -> Column:
    """a / b by IEEE 754, as DuckDB divides: over 0 infinite with the sign of a, NaN for 0 / 0."""
    return F.when(b != 0, a / b).when(b == 0, a * F.lit(float("inf")))


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def so_far(w: WindowSpec) -> WindowSpec:
    """From the first row of the window's partition to the current one."""
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def carried(c: Column | str, w: WindowSpec) -> Column:
    """The last value that isn't null, up to the current row."""
    return F.last(c, ignorenulls=True).over(so_far(w))


def not_nan(c: Column | str) -> Column:
    """NaN as null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def active_difference(a: Column, b: Column, default: float = 0.0) -> Column:
    """a - b with a missing side as ``default``; null if both are missing."""
    return F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(default)) - F.coalesce(b, F.lit(default)))


def percent_return(r: Column) -> Column:
    """A 1-based return in percent."""
    return (r - 1) * 100


def date_from(text: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "dd/MM/yyyy")) -> Column:
    """The first format that parses."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats)).cast("date")


def node_id(level: Column, classes: list[Column], ticker: Column) -> Column:
    """Text id of a tree node: root, bracketed buckets without spaces, and a leaf's ticker."""
    joined = F.lit("")
    bucket = []
    for c in classes:
        joined = F.concat(joined, F.lit("\\") if bucket else F.lit(""), F.regexp_replace(F.coalesce(c, F.lit("")), " ", ""))
        bucket.append(joined)
    out = F.when(level == 0, F.lit(".[top]"))
    for i, b in enumerate(bucket, 1):
        out = out.when(level == i, F.concat(F.lit("["), b, F.lit("\\]") if i == 1 else F.lit("]")))
    return out.otherwise(F.concat(F.lit("["), bucket[-1], F.lit("]\\"), ticker))


def carino_k(r: Column) -> Column:
    """ln(r) / (r - 1) for a 1-based return; 1 for a flat, missing or impossible one."""
    usable = r.isNotNull() & (r > 0) & (r != 1)
    return F.when(usable, F.ln(F.when(usable, r).otherwise(2.0)) / (r - 1)).otherwise(1.0)


def active_k(p: Column, b: Column, when_equal: Column) -> Column:
    """(ln p - ln b) / (p - b) for 1-based returns above 0, ``when_equal`` where they are equal."""
    usable = (p > 0) & (b > 0)
    both = (F.ln(F.when(usable, p).otherwise(1.0)) - F.ln(F.when(usable, b).otherwise(1.0))) / F.nullif(p - b, F.lit(0.0))
    return F.when(usable & (p != b), both).otherwise(when_equal)
