"""Column expressions shared by the operators (all JVM-side, codegen'd)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def field(name: str) -> Column:
    """A column by its exact name (dots and back-ticks included)."""
    return F.col("`" + name.replace("`", "``") + "`")


def finite_sql(name: str) -> str:
    """A column as a double in SQL text; NULL for NaN and infinities too."""
    x = "CAST(`" + name.replace("`", "``") + "` AS DOUBLE)"
    return f"CASE WHEN abs({x}) < double('infinity') THEN {x} END"      # NaN is above infinity


def md5_int(*parts: str | Column, digits: int = 8) -> Column:
    """First ``digits`` (at most 15) hex digits of md5(p1|p2|...) as a bigint."""
    cols = []
    for i, p in enumerate(parts):
        if i:
            cols.append(F.lit("|"))
        cols.append(F.lit(p) if isinstance(p, str) else p.cast("string"))
    return F.conv(F.substring(F.md5(F.concat(*cols)), 1, digits), 16, 10).cast("bigint")


def md5_uniform(*parts: str | Column) -> Column:
    """A reproducible uniform number in [0, 1) from the hash of ``parts``."""
    return md5_int(*parts) / F.lit(TWO_POW_32)


def poisson_count(rate: float, *parts: str | Column) -> Column:
    """A Poisson(rate) number fixed by the hash of ``parts``: the inverse distribution
    function at ``md5_uniform``.  Rates above 500 are sums of independent smaller ones, so
    the table of thresholds stays short."""
    draws = max(1, math.ceil(rate / 500))
    small = rate / draws
    term = total = math.exp(-small)
    cuts = [total]
    while total < 1 - 2.0 ** -34 and len(cuts) < small + 40 * math.sqrt(small) + 60:
        term *= small / len(cuts)
        total += term
        cuts.append(total)
    table = F.expr("array(" + ", ".join(f"{c!r}D" for c in cuts) + ")")

    def count(i: int) -> Column:
        u = md5_uniform(*parts, F.lit(str(i))) if i else md5_uniform(*parts)
        return F.size(F.filter(table, lambda c: c <= u))

    return sum((count(i) for i in range(1, draws)), count(0))


def pair_code(a: str | Column, b: str | Column) -> Column:
    """First character of ``a`` followed by first character of ``b`` (null if either is)."""
    return F.concat(F.substring(col_(a), 1, 1), F.substring(col_(b), 1, 1))


def rnd(c: Column, digits: int = 6) -> Column:
    return F.round(c.cast("double"), digits)


def sql_literal(v, t: str | None = None) -> str:
    """A typed SQL literal for a Python value (strings escaped)."""
    if isinstance(v, str):
        lit = "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    elif isinstance(v, bool):
        lit = "true" if v else "false"
    elif isinstance(v, float):
        lit = repr(v) + "D" if math.isfinite(v) else f"CAST('{v}' AS DOUBLE)"
    elif v is None:
        lit = "NULL"
    else:
        lit = str(v)
    return f"CAST({lit} AS {t})" if t else lit


def search_bucket(key: Column | Sequence[Column], bounds: Sequence,
                  types: Sequence[str] | None = None, names: Sequence[str] | None = None) -> Column:
    """0-based bucket of the key among sorted literal ``bounds`` by binary search.

    bucket = number of bounds <= key.  The key is one column or several
    (compared lexicographically as a struct).  Built as SQL text (one JVM
    parse instead of a Py4J call per node): a CASE tree of depth
    log2(len(bounds)), so each row does a handful of comparisons.
    ``names`` are the key column names (required for SQL text)."""
    keys = [key] if isinstance(key, Column) else list(key)
    if names is None:
        raise ValueError("search_bucket needs the key column names")
    multi = len(names) > 1
    tps = list(types) if types else [None] * len(names)
    fields = [f"k{i}" for i in range(len(names))]
    if multi:
        row = "named_struct(" + ", ".join(f"'{f}', `{n}`" for f, n in zip(fields, names)) + ")"
    else:
        row = f"`{names[0]}`"

    def lit_of(b):
        vals = b if isinstance(b, (tuple, list)) else (b,)
        if multi:
            return "named_struct(" + ", ".join(f"'{f}', {sql_literal(v, t)}"
                                               for f, v, t in zip(fields, vals, tps)) + ")"
        return sql_literal(vals[0], tps[0])

    def build(lo: int, hi: int) -> str:
        if lo >= hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"CASE WHEN {row} < {lit_of(bounds[mid])} THEN {build(lo, mid)} ELSE {build(mid + 1, hi)} END"

    del keys
    return F.expr(build(0, len(bounds)))
