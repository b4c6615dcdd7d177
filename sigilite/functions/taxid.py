"""Check digits of Brazilian tax numbers as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the two check digits.
CPF_WEIGHTS = ([10, 9, 8, 7, 6, 5, 4, 3, 2], [11, 10, 9, 8, 7, 6, 5, 4, 3, 2])
CNPJ_WEIGHTS = ([5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2], [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2])


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def check_digit(number: Column, weights: list[int]) -> Column:
    """11 less the weighted sum modulo 11; 0 where the remainder is below 2."""
    total = sum((F.substring(number, i + 1, 1).cast("int") * w for i, w in enumerate(weights[1:], 1)), F.substring(number, 1, 1).cast("int") * weights[0])
    return F.when(total % 11 < 2, 0).otherwise(11 - total % 11)


def _valid(s: Column, weights: tuple[list[int], list[int]]) -> Column:
    d, n = digits(s), len(weights[1]) + 1
    sums = [F.substring(d, len(w) + 1, 1).cast("int") == check_digit(d, w) for w in weights]
    # other lengths never reach the casts
    return F.when((F.length(d) == n) & ~d.rlike(r"\A(.)\1*\z"), sums[0] & sums[1]).when(s.isNotNull(), False)


def cpf_valid(s: Column) -> Column:
    return _valid(s, CPF_WEIGHTS)


def cnpj_valid(s: Column) -> Column:
    return _valid(s, CNPJ_WEIGHTS)
