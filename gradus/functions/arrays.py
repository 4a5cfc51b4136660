"""Array expressions: packed lists, timelines, frame picks and completion masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean, col

TOLERANCE = 1e-6
#: Label of tokens that take no part in the loss.
IGNORED = -100


def unpack(c: Column | str, to: str = "string", sep: str = ";") -> Column:
    """A list packed into one cell; an empty cell is an empty list, a malformed number fails."""
    parts = F.when(clean(c) == "", F.array().cast("array<string>")).otherwise(F.split(clean(c), sep))
    return parts if to == "string" else F.transform(parts, lambda x: x.cast(to))


def close(a: Column | str, b: Column | str, tolerance: float = TOLERANCE) -> Column:
    """Equal lengths, and every pair at most ``tolerance`` apart."""
    a, b = col(a), col(b)
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.coalesce(F.abs(x - y) <= tolerance, F.lit(False))), lambda x: x)


def ascending(a: Column | str) -> Column:
    return col(a) == F.array_sort(col(a))


def midpoints(n: Column | int) -> Column:
    """(i + 0.5) / n for i below n."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: (i + 0.5) / n)


def pick(values: Column | str, places: list[int]) -> Column:
    """Elements at zero-based places, in the order of the places."""
    return F.array(*(F.element_at(col(values), p + 1) for p in places))


def completion_labels(full: str, mask: str, prefix: str, prefix_mask: str, answer: str, end: int) -> Column:
    """Labels of a masked token row: the answer and its end keep their tokens, all else is ignored.

    Null where the mask has holes, the prompt is not a prefix, or answer and end do not follow it.
    """
    at = F.filter(F.transform(F.col(mask), lambda m, i: F.when(m == 1, i)), lambda i: i.isNotNull())
    seq = F.transform(at, lambda i: F.element_at(F.col(full), i + 1))
    before = F.filter(F.transform(F.arrays_zip(F.col(prefix).alias("v"), F.col(prefix_mask).alias("m")), lambda x: F.when(x["m"] == 1, x["v"])), lambda v: v.isNotNull())
    want = F.concat(F.col(answer), F.array(F.lit(end)))
    n, k = F.size(before), F.size(want)
    ok = (
        (F.size(at) > 0) & (F.array_max(at) - F.array_min(at) == F.size(at) - 1) & (n > 0) & (F.size(F.col(answer)) > 0) & ~F.array_contains(F.col(answer), F.lit(end))
        & (F.size(F.col(full)) == F.size(F.col(mask))) & (F.slice(seq, 1, F.greatest(n, F.lit(1))) == before) & (F.slice(seq, n + 1, k) == want)
    )
    first = F.array_min(at) + n
    return F.when(ok, F.transform(F.col(full), lambda v, i: F.when((i >= first) & (i < first + k), v).otherwise(F.lit(IGNORED))))
