"""From class probabilities to text: greedy CTC decoding and what surrounds it.

Probabilities are row-major ``array<float>``: step after step, ``classes`` values each.
All sums and quotients are single precision, in step order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def score_rows(p: str, classes: int) -> Column:
    """The steps of a score matrix; none for an empty one."""
    return F.expr(f"if(size({p}) < {classes}, cast(array() as array<array<float>>), transform(sequence(0, cast(size({p}) div {classes} as int) - 1), t -> slice({p}, t * {classes} + 1, {classes})))")


def best_classes(rows: str) -> Column:
    """(k, v) of each step: the first class of the largest probability, and that."""
    return F.expr(f"transform({rows}, x -> named_struct('k', cast(array_position(x, array_max(x)) as int) - 1, 'v', array_max(x)))")


def emitted(best: str) -> Column:
    """Steps whose class is neither blank (0) nor a repeat of the step before."""
    return F.expr(f"filter({best}, (z, j) -> z.k <> 0 and (j = 0 or {best}[greatest(j - 1, 0)].k <> z.k))")


def ctc_text(steps: str, symbols: Column) -> Column:
    return F.array_join(F.transform(F.col(steps), lambda z: F.element_at(symbols, z["k"])), "")


def ctc_confidence(steps: str) -> Column:
    """Mean probability of the emitted steps; 0 for none."""
    return F.expr(f"if(size({steps}) = 0, float(0), cast(aggregate({steps}, float(0), (a, z) -> cast(a + z.v as float)) / cast(size({steps}) as float) as float))")


def rows_normalised(rows: str, tolerance: float) -> Column:
    return F.expr(f"forall({rows}, r -> abs(aggregate(r, float(0), (a, x) -> cast(a + x as float)) - 1) <= {tolerance})")


def probabilities_admitted(p: str, n: int) -> Column:
    """Right length, and every value finite in [0, 1]."""
    return F.expr(f"size({p}) = {n} and forall({p}, x -> not isnan(x) and x >= 0 and x <= 1)")


def recogniser_width(width: Column, height: Column) -> Column:
    """Width of a crop scaled to 48 rows, rounded up, in [1, 3200]."""
    return F.least(F.lit(3200), F.greatest(F.lit(1), F.ceil(width * 48 / height))).cast("int")


def text_admitted(text: Column) -> Column:
    """Non-empty printable ASCII."""
    return text.rlike(r"\A[\x20-\x7E]+\z")
