"""Array arithmetic with higher-order functions; stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def let(value: Column, body) -> Column:
    """body(value) with the value computed once per row: a lambda variable is bound, whereas
    an expression used inside a lambda would be evaluated again for every element."""
    return F.transform(F.array(value), body)[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, x: s + x)


def dot_fixed(a: Column, b: Column, width: int) -> Column:
    """Dot product of short arrays of known length."""
    total = a[0] * b[0]
    for i in range(1, width):
        total = total + a[i] * b[i]
    return total


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column, floor: float = 1e-9) -> Column:
    return let(F.greatest(norm(a), F.lit(floor)),
               lambda length: F.transform(a, lambda x: x.cast("double") / length))


def top_k_mean(values: Column, k: int) -> Column:
    return let(F.slice(F.sort_array(values, asc=False), 1, k),
               lambda best: F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(best))


def running(values: Column, start: Column, step, piece: int = 32) -> Column:
    """The states of a fold after every element, as an array of doubles.

    Elements are folded in pieces: states are appended within a piece, and whole pieces to the result, so an element
    costs a copy of `piece` states at most and not of all before it.
    """
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / piece).cast("int")), lambda i: F.slice(values, i * piece + 1, F.lit(piece)))

    def fold(state, rows):
        return F.aggregate(rows, F.struct(state.alias("s"), F.expr("cast(array() as array<double>)").alias("out")), lambda acc, x: let(
            step(acc["s"], x), lambda s: F.struct(s.alias("s"), F.concat(acc["out"], F.array(s)).alias("out"))))

    whole = F.aggregate(pieces, F.struct(start.alias("s"), F.expr("cast(array() as array<array<double>>)").alias("out")), lambda acc, rows: let(
        fold(acc["s"], rows), lambda done: F.struct(done["s"].alias("s"), F.concat(acc["out"], F.array(done["out"])).alias("out"))))
    return F.when(F.size(values) > 0, F.flatten(whole["out"])).otherwise(F.expr("cast(array() as array<double>)"))


def mean_squared_error(pred: Column, actual: Column) -> Column:
    total = F.aggregate(F.zip_with(pred, actual, lambda p, a: (p - a) * (p - a)),
                        F.lit(0.0), lambda s, x: s + x)
    return total / F.size(pred)


def left_pad_rows(history: Column, length: int, width: int) -> Column:
    """Prefix zero vectors until the history has `length` rows; keep the latest rows."""
    zero = F.array_repeat(F.array_repeat(F.lit(0.0), width), F.greatest(F.lit(0), length - F.size(history)))
    tail = F.when(F.size(history) > length, F.slice(history, -length, length)).otherwise(history)
    return F.concat(zero, tail)
