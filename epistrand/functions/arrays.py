"""Array column expressions over token sequences. All are linear in the array length."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from epistrand.schemas import CLS, PAD, SEP


def bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tail(values: Column, n: int) -> Column:
    """The last ``n`` elements, or all of them if there are fewer."""
    if n < 1:
        raise ValueError("n must be at least 1")
    return F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), F.lit(n))


def pad_right(values: Column, length: int, symbol) -> Column:
    """Exactly ``length`` elements: filled up with ``symbol`` at the end, or cut there."""
    symbol = symbol if isinstance(symbol, Column) else F.lit(symbol)
    missing = F.greatest(F.lit(length) - F.size(values), F.lit(0))
    return F.slice(F.concat(values, F.array_repeat(symbol, missing)), 1, length)


def pad_sequence(values: Column, length: int, symbol=PAD) -> Column:
    """Pad or cut a token list to ``length``."""
    return pad_right(values, length, symbol)


def count_token(values: Column, token: str = SEP) -> Column:
    return F.size(F.filter(values, lambda x: x == F.lit(token)))


def visit_index(marks: Column) -> Column:
    """For each element, the number of true marks strictly before it.

    ``marks`` is an array of booleans, true where a visit ends. The result is put
    together from one constant run per visit, so the work is linear.
    """
    ends = F.filter(
        F.transform(marks, lambda m, i: F.when(m, i + 1)), lambda i: i.isNotNull()
    )
    starts = F.concat(F.array(F.lit(0)), ends)
    stops = F.concat(ends, F.array(F.size(marks)))
    # Both lists are operands, not captured by the lambda, which would compute them anew per element.
    lengths = F.zip_with(stops, starts, lambda stop, start: stop - start)
    return F.flatten(F.transform(lengths, lambda n, i: F.array_repeat(i, n)))


def position_index(codes: Column, symbol: str = SEP, before=0) -> Column:
    """Visit number of each token: how many separators come strictly before it.

    ``before`` is the number of visits that end before a segment (its column ``visit``).
    """
    found = visit_index(F.transform(codes, lambda c: F.coalesce(c == F.lit(symbol), F.lit(False))))
    if isinstance(before, int) and before == 0:
        return found
    first = (before if isinstance(before, Column) else F.lit(before)).cast("int")
    return F.zip_with(found, F.array_repeat(first, F.size(found)), lambda i, b: i + b)


def parity(positions: Column) -> Column:
    return F.transform(positions, lambda p: p % 2)


def segment_index(codes: Column, symbol: str = SEP, before=0) -> Column:
    """0 and 1 in turn from visit to visit."""
    return parity(position_index(codes, symbol, before))


def attention_mask(values: Column, length: int) -> Column:
    """1 for each real token, 0 for each padding token."""
    ones = F.array_repeat(F.lit(1), F.least(F.size(values), F.lit(length)))
    return pad_right(ones, length, 0)


def with_cls(codes: Column) -> Column:
    """CLS in front; a leading separator is replaced by it instead."""
    cls = F.array(F.lit(CLS))
    return F.when(
        _starts_with_sep(codes), F.concat(cls, F.slice(codes, F.lit(2), F.greatest(F.size(codes) - 1, F.lit(0))))
    ).otherwise(F.concat(cls, codes))


def ages_with_cls(codes: Column, ages: Column) -> Column:
    """Ages aligned with :func:`with_cls`: the first age is repeated when CLS is added."""
    return F.when(_starts_with_sep(codes), ages).otherwise(F.concat(F.slice(ages, 1, 1), ages))


def _starts_with_sep(codes: Column) -> Column:
    return F.coalesce(F.get(codes, 0) == F.lit(SEP), F.lit(False))


def argmax_index(scores: Column) -> Column:
    """0-based position of the first highest score."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
