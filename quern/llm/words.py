"""Column expressions shared by the operators on words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All ASCII but digits and lower-case letters parts words.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased words of digits, letters and whatever is not ASCII; array<string>, empty for null.

    lower() also folds letters outside ASCII. Of those only the Kelvin sign gives a lone ASCII letter, a k.
    """
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAKS), lambda w: w != "")


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(numbers: Column, block: int = 64) -> Column:
    """array<int>: at each place the sum up to there. An array grown by appending is copied each time, so it is done in blocks."""

    def grown(values: Column, start: Column, after: bool) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, zero, lambda a, v: F.struct((a["at"] + v).alias("at"), F.concat(a["out"], F.array(a["at"] + v if after else a["at"])).alias("out")), lambda a: a["out"])

    def joined(blocks: Column) -> Column:
        before = grown(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, v: a + v)), F.lit(0), False)
        return F.flatten(F.zip_with(blocks, before, lambda b, s: grown(b, s, True)))

    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / block).cast("int")), lambda k: F.slice(x, k * block + 1, block))
    return let(numbers, lambda x: F.when(F.size(x) > 0, let(cut(x), joined)).otherwise(F.array().cast("array<int>")))


def grams(tokens: Column, offsets: tuple[int, ...]) -> Column:
    """array<bigint>: at each place, the hash of the words at `offsets` from it; empty where they don't fit."""
    span = max(offsets) + 1
    return F.when(
        F.size(tokens) >= span,
        F.transform(
            F.sequence(F.lit(1), F.size(tokens) - (span - 1)),
            lambda i: F.xxhash64(*[F.get(tokens, i + (o - 1)) for o in offsets]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))

