"""Edit distance with swaps of neighbours, and what words near each other have in common, as expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def distance(a: Column, b: Column) -> Column:
    """Insertions, deletions, replacements and swaps of two neighbours cost 1; no part is edited twice. Null with nulls.

    A fold over the first text's characters: its state is the last two rows of the table of distances, and each row is a
    fold over the second text's.
    """

    def table(z: Column) -> Column:
        x, y = z["x"], z["y"]
        at = lambda values, k: F.get(values, F.greatest(k, F.lit(0)))
        zero = F.struct(F.array().cast("array<int>").alias("before"), F.sequence(F.lit(0), F.size(y)).alias("last"), F.lit(0).alias("i"))

        def row(s: Column, c: Column) -> Column:
            def cell(done: Column, j: Column) -> Column:
                plain = F.least(at(s["last"], j) + 1, at(done, j - 1) + 1, at(s["last"], j - 1) + (c != at(y, j - 1)).cast("int"))
                swapped = (s["i"] > 0) & (j > 1) & (c == at(y, j - 2)) & (at(x, s["i"] - 1) == at(y, j - 1))
                return F.array_append(done, F.when(swapped, F.least(plain, at(s["before"], j - 2) + 1)).otherwise(plain))

            made = F.aggregate(F.sequence(F.lit(1), F.size(y)), F.array(s["i"] + 1), cell)
            return F.struct(s["last"].alias("before"), made.alias("last"), (s["i"] + 1).alias("i"))

        return F.aggregate(x, zero, row, lambda s: F.element_at(s["last"], -1))

    letters = F.struct(F.split(a, "").alias("x"), F.split(b, "").alias("y"))
    short = F.when(a.isNull() | b.isNull(), None).when(a == b, 0).when((a == "") | (b == ""), F.char_length(a) + F.char_length(b))
    return short.otherwise(_bound(letters, table))


def _less(word: Column) -> Column:
    """The word without each of its characters."""
    places = F.sequence(F.lit(1), F.char_length(word))
    return F.when(word != "", F.transform(places, lambda k: F.concat(F.substr(word, F.lit(1), k - 1), F.substr(word, k + 1)))).otherwise(F.array().cast("array<string>"))


def neighbourhood(word: Column, most: Column) -> Column:
    """The word, and what is left of it without one character, and without two if ``most`` is 2. Two words within that
    many edits (a swap is one) have one of these in common."""
    one = F.when(most > 0, _less(word)).otherwise(F.array().cast("array<string>"))
    two = F.when(most > 1, F.flatten(F.transform(one, _less))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(word), one, two))


def may_be_within(a: Column, b: Column, most: Column) -> Column:
    """A swap is two replacements at most, so the built-in banded distance bounds this one from above by twice."""
    return (F.abs(F.char_length(a) - F.char_length(b)) <= most) & (F.levenshtein(a, b) <= 2 * most)
