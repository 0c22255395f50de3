"""Array column expressions: class scores, arg-max, log-softmax, one-hot.

All of these are native higher-order functions, so they stay inside
whole-stage code generation and never leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_doubles(arr) -> Column:
    """Cast an array of numbers to ``array<double>``."""
    return _col(arr).cast("array<double>")


def scores_slice(arr, start: int, length: int) -> Column:
    """``length`` elements of ``arr`` starting at 1-based ``start``, as doubles."""
    return F.slice(as_doubles(arr), start, length)


def argmax_class(scores) -> Column:
    """0-based index of the largest score; the first index wins ties.

    Null or empty input gives null.
    """
    s = _col(scores)
    return (F.array_position(s, F.array_max(s)) - 1).cast("int")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a lambda binding).

    Expressions used inside a higher-order function's lambda are evaluated
    per element; binding them first keeps an O(k) pass O(k).
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def log_softmax(scores) -> Column:
    """Numerically stable log-softmax over an array of scores (one max, one sum)."""
    def with_scores(s):
        return let(F.array_max(s), lambda m: let(
            F.log(F.aggregate(s, F.lit(0.0), lambda acc, x: acc + F.exp(x - m))) + m,
            lambda lse: F.transform(s, lambda x: x - lse)))
    return let(as_doubles(scores), with_scores)


def cross_entropy(logp, label) -> Column:
    """Negative log-likelihood of the true class (0-based ``label``)."""
    return -F.element_at(_col(logp), _col(label) + 1)


def one_hot(code, k: int) -> Column:
    """``array<double>`` of size ``k`` with 1.0 at ``code``; null code -> zeros."""
    c = _col(code)
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                       lambda i: F.when(i == c, F.lit(1.0)).otherwise(F.lit(0.0)))


def one_hot_matrix(codes, k: int) -> Column:
    """One-hot of every element of an int array: ``array<array<double>>``."""
    return F.transform(_col(codes), lambda c: one_hot(c, k))


def with_fallback(pred, k: int | None = None) -> Column:
    """Fallback prediction when a head is missing or failed.

    ``k=None``: scalar -1. ``k``: array of ``k`` times -1.
    """
    p = _col(pred)
    if k is None:
        return F.coalesce(p, F.lit(-1))
    return F.coalesce(p, F.array_repeat(F.lit(-1), k))


def dot(a, b) -> Column:
    """Dot product of two equally long numeric arrays."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x * y),
                       F.lit(0.0), lambda acc, v: acc + v)


def linear_scores(vec, weights: list[list[float]], bias: list[float] | None = None) -> Column:
    """Scores of a linear head: ``W @ vec + b`` with ``W`` inlined as literals.

    ``weights`` has one row per class; it is bounded by classes x dims, not by
    data, so inlining it is the cheapest way to ship it to every task.
    """
    v = as_doubles(vec)
    rows = []
    for c, w in enumerate(weights):
        lit_w = F.array(*[F.lit(float(x)) for x in w])
        s = dot(v, lit_w)
        if bias is not None:
            s = s + F.lit(float(bias[c]))
        rows.append(s)
    return F.array(*rows)


def argmax_per_group(scores, groups: int, width: int) -> Column:
    """Arg-max inside each consecutive block of ``width`` scores.

    Used for the four aspect heads packed in one score array.
    """
    s = as_doubles(scores)
    return F.array(*[argmax_class(F.slice(s, g * width + 1, width)) for g in range(groups)])


def mismatches(t, p) -> Column:
    """Number of positions where two equally long arrays differ."""
    return F.aggregate(F.zip_with(_col(t), _col(p), lambda x, y: F.when(x == y, 0).otherwise(1)),
                       F.lit(0), lambda acc, v: acc + v)
