"""Column expressions: each returns a Column and stays inside generated code."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F

PI = math.pi


# --- numbers -------------------------------------------------------------------------------------
def z_score(effect: Column, error: Column) -> Column:
    """Effect over its standard error; null where the error is 0 or null."""
    return F.try_divide(effect, error)


def probability(logit: Column) -> Column:
    """Logistic function; a null fails the job, as it must not pass unseen."""
    return F.when(F.assert_true(logit.isNotNull(), "a score is null").isNull(), 1 / (1 + F.exp(-logit)))


def minus_log10(p: Column, floor: float = 1e-29) -> Column:
    """-log10 of p, p being ``floor`` at least; null for null."""
    return F.when(p.isNotNull(), -F.log10(F.greatest(p, F.lit(float(floor)))))


def log_count(x: Column) -> Column:
    return F.log10(1 + x)


def binarised(x: Column) -> Column:
    """1 if positive, 0 if not, 0 for null."""
    return F.coalesce((x > 0).cast("int"), F.lit(0))


def finite(x: Column) -> Column:
    """True for numbers other than NaN and the infinities; false for null."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def midpoint(start: Column, stop: Column, up: bool = False) -> Column:
    """The middle of an interval; ``up``: the next whole position."""
    middle = (start + stop) / F.lit(2.0)
    return F.ceil(middle) if up else middle


def parity_bucket(chrom: Column, even: str = "even", odd: str = "odd") -> Column:
    return F.when(chrom % 2 == 0, even).otherwise(odd)


def unit_interval(pos: Column) -> tuple[Column, Column]:
    """A position as (start, start + 1)."""
    return pos.alias("start"), (pos + 1).alias("stop")


def bin_number(x: Column, width: float, low: float = 0.0) -> Column:
    """Left-closed bin of fixed width, counted from 0."""
    return F.floor((x - F.lit(float(low))) / F.lit(float(width))).cast("long")


def cut_bin(x: Column, width: float, n_bins: int) -> Column:
    """Right-closed bin 1..n_bins of the absolute value; null outside and at 0."""
    b = F.ceil(F.abs(x) / F.lit(float(width))).cast("long")
    return F.when((b >= 1) & (b <= n_bins), b)


def p_combined(p: Column) -> Column:
    """Aggregate: the Cauchy combination of p-values (equal weights).

    Below 1e-16 the tangent is replaced by its limit 1/(p*pi); any p of 0 gives 0, 1 is taken as 1 - 1e-15, and nulls don't count.
    """
    safe = F.least(p, F.lit(1 - 1e-15))
    term = F.when(p.isNull() | (p == 0), None).when(p < 1e-16, 1 / (F.greatest(p, F.lit(5e-324)) * F.lit(PI))).otherwise(F.tan((F.lit(0.5) - safe) * F.lit(PI)))
    mean = F.avg(term)
    tail = F.when(mean > 1e15, 1 / (mean * F.lit(PI))).otherwise(F.lit(0.5) - F.atan(mean) / F.lit(PI))
    return F.when(F.min(p) == 0, F.lit(0.0)).otherwise(tail)


# --- choices -------------------------------------------------------------------------------------
def recode(col: Column, mapping: Mapping, default=None) -> Column:
    """The mapped value, else ``default`` (a value, or a Column such as the input itself)."""
    out = None
    for a, b in mapping.items():
        out = F.when(col == a, b) if out is None else out.when(col == a, b)
    return out.otherwise(default)


def filled(target: Column, other: Column) -> Column:
    """``target`` unless null or empty, else ``other``."""
    return F.coalesce(F.nullif(target, F.lit("")), other)


def significance_stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p.isNotNull(), "ns")


def p_label(p: Column) -> Column:
    """``p = 1.2e-03`` below .01, else four decimals."""
    return F.when(p < 0.01, F.format_string("p = %.1e", p)).otherwise(F.format_string("p = %.4f", p))


def indicator(col: Column, members: Iterable) -> Column:
    return F.coalesce(col.isin(*members).cast("int"), F.lit(0))


# --- strings -------------------------------------------------------------------------------------
def locus_parts(locus: Column, separators: str = "[:_-]") -> list[Column]:
    """chrom (string), start, stop of ``chr_start_stop`` in any of its forms; null parts where there are none."""
    parts = F.split(locus, separators)
    return [F.try_element_at(parts, F.lit(1)).alias("chrom"), *(F.try_element_at(parts, F.lit(i)).try_cast("long").alias(n) for i, n in ((2, "start"), (3, "stop")))]


def key_of(*parts: Column, separator: str = "_") -> Column:
    return F.concat_ws(separator, *[p.cast("string") for p in parts])


def stripped(col: Column, pattern: str) -> Column:
    return F.regexp_replace(col, pattern, "")


def first_replaced(col: Column, old: str, new: str) -> Column:
    """Replaces the first ``old`` (one character) only."""
    return F.regexp_replace(col, f"^([^{old}]*){old}", f"$1{new}")


def prefix_before(col: Column, mark: str = "_") -> Column:
    return F.substring_index(col, mark, 1)


def natural_key(col: Column) -> list[Column]:
    """Sort keys for names such as chr2 < chr10: the letters, then the number."""
    return [F.regexp_extract(col, r"^(\D*)", 1), F.regexp_extract(col, r"(\d+)", 1).try_cast("long"), col]


def file_stem(path: Column) -> Column:
    """The file name without folders and extensions."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]+)*$", 1)


def synonyms_replaced(col: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    for old, new in pairs:
        col = F.regexp_replace(col, old, new)
    return col
