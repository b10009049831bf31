"""Scalar functions over array columns. All run in the JVM.

Null arrays give null everywhere. Empty arrays give null where a value is
asked for (argmax, class_id) and an empty array otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_ints(a: Column) -> Column:
    """Elements truncated towards zero; NaN and values beyond int become null."""
    return F.transform(a, lambda v: F.when(~F.isnan(v) & (F.abs(v) < 2147483648.0), v.cast("int")))


def as_floats(a: Column) -> Column:
    return a.cast("array<float>")


def columns_between(a: Column, start: int, stop: int) -> Column:
    """Columns start <= i < stop, 0-based; past the end there are fewer."""
    if start < 0 or stop < start:
        raise ValueError("0 <= start <= stop must hold")
    return F.slice(a, start + 1, stop - start)


def element(a: Column, i: int) -> Column:
    """The i-th element, 0-based; null beyond the end."""
    return F.get(a, F.lit(i))


def argmax(a: Column) -> Column:
    """Position of the largest value, the lowest among equals. Null elements are passed over, NaN is largest."""
    return F.when(F.size(a) > 0, (F.array_position(a, F.array_max(a)) - 1).cast("int"))


def is_complete(a: Column, width: int | None = None) -> Column:
    """True where a is not null, has no null or NaN element and, if given, this width; else false."""
    whole = F.coalesce(~F.exists(a, lambda v: v.isNull() | F.isnan(v)), F.lit(False))
    return whole if width is None else whole & F.coalesce(F.size(a) == width, F.lit(False))


def class_id(y: Column, classes: int = 10) -> Column:
    """Position of the single largest value of a complete y of this width; else null (no label)."""
    top = F.array_max(y)
    single = F.size(F.filter(y, lambda v: v == top)) == 1
    return F.when(is_complete(y, classes) & single, argmax(y))


def one_hot(label: Column, classes: int = 10) -> Column:
    """A 1 at label among zeros; null for a null label or one outside 0..classes-1."""
    hot = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.when(i == label, F.lit(1.0)).otherwise(F.lit(0.0)).cast("float"))
    return F.when((label >= 0) & (label < classes), hot)


def to_grid(a: Column, height: int, width: int) -> Column:
    """Row-major grid of height rows; null where the array does not have height*width values."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda r: F.slice(a, r * width + 1, F.lit(width)))
    return F.when(F.size(a) == height * width, rows)


def as_vector(c: Column) -> Column:
    """A scalar as a one-element array."""
    return F.array(c)


def total(a: Column) -> Column:
    """Sum of the elements in double precision; null if one is null."""
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double"))


def softmax(o: Column) -> Column:
    """Class probabilities, shifted by the maximum so that large logits stay finite."""
    top = F.array_max(o)
    e = F.transform(o, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / total(e))


def top_ids(o: Column, k: int) -> Column:
    """Positions of the k largest values, larger first, the lower position among equals."""
    keyed = F.transform(o, lambda v, i: F.struct((-v.cast("double")).alias("k"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda s: s["i"])


def rank_of(o: Column, label: Column) -> Column:
    """How many positions come before label, by larger value and then lower position.

    One pass without a sort: label is among the k best where the rank is under k.
    """
    mine = F.get(o, label)
    before = F.filter(F.transform(o, lambda v, i: (v > mine) | ((v == mine) & (i < label))), lambda b: b)
    return F.size(before)


def title(truth: Column, predicted: Column) -> Column:
    return F.concat(F.lit("num: "), truth.cast("string"), F.lit(","), predicted.cast("string"))


def fixed(c: Column, digits: int, suffix: str = "") -> Column:
    """c with this many decimals; null stays null."""
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}f{suffix}", c))
