"""Values that an expression uses more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once for a row. Plain columns are copied into each place that names them, and
    copies within branches are worked out anew, so that nested uses multiply."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def let_all(body: Callable[..., Column], **values: Column) -> Column:
    """:func:`let` for several values, which ``body`` takes by name."""
    return let(F.struct(*[v.alias(n) for n, v in values.items()]), lambda s: body(**{n: s.getField(n) for n in values}))
