"""Deterministic pseudo-random values as Spark SQL expressions.

Every value is a pure function of ``(seed, example id, slot ...)`` through
``md5`` (identical in Spark and DuckDB), so a task retry, a different
partitioning or a different executor count yields the same rows.

Expressions are composed as SQL text (:class:`X`) and turned into one
Column at the end with ``F.expr``: a generator expression has thousands of
nodes and building it call by call through the Python/JVM bridge would
cost far more than running it.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

_2_32 = float(1 << 32)
_names = itertools.count(1)


class X(str):
    """A Spark SQL expression (as opposed to a literal key part)."""


def lit(v) -> X:
    if isinstance(v, X):
        return v
    if isinstance(v, bool):
        return X("true" if v else "false")
    if isinstance(v, (int, float)):
        return X(repr(v))
    s = str(v).replace("\\", "\\\\").replace("'", "\\'")
    return X(f"'{s}'")


def var() -> X:
    """A fresh lambda variable name."""
    return X(f"v{next(_names)}")


def _part(p) -> str:
    return f"cast({p} as string)" if isinstance(p, X) else lit(str(p))


def h32(*parts) -> X:
    """Unsigned 32-bit integer from the first 8 hex digits of md5(parts)."""
    inner = ", ".join(_part(p) for p in parts)
    return X(f"cast(conv(substring(md5(concat_ws(':', {inner})), 1, 8), 16, 10) as bigint)")


def rint(n, *parts) -> X:
    """Integer in ``[0, n)``; ``n`` may be an expression."""
    return X(f"pmod({h32(*parts)}, cast({lit(n)} as bigint))")


def unit(*parts) -> X:
    return X(f"({h32(*parts)} / {_2_32})")


def arr(options) -> X:
    return X("array(" + ", ".join(lit(o) for o in options) + ")")


def pick(options, *parts) -> X:
    """One element of a literal list."""
    return X(f"element_at({arr(options)}, cast({rint(len(options), *parts)} + 1 as int))")


def col(x: X) -> Column:
    return F.expr(x)
