"""Where the best window of a partial ratio lies."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import kernels as K
from .editops import _column


class Alignment(NamedTuple):
    score: float
    src_start: int
    src_end: int
    dest_start: int
    dest_end: int


ALIGNMENT_TYPE = "struct<score:double,src_start:int,src_end:int,dest_start:int,dest_end:int>"


def partial_ratio_alignment(left, right) -> Alignment | Column | None:
    """The partial ratio with the windows of both operands that it compares: of two values, or of the rows' columns.

    Of equally good windows the first counts: those at the beginning, then inside, then at the
    end. None (null) if an operand is missing.
    """
    if isinstance(left, Column) or isinstance(right, Column):
        sides = (x if isinstance(x, Column) else F.lit(x) for x in (left, right))
        return _column(lambda a, b: partial_ratio_alignment(a, b)._asdict(), ALIGNMENT_TYPE, *sides)
    for x in (left, right):
        if x is not None and not isinstance(x, (str, list, tuple)):
            raise TypeError("only strings and sequences can be compared")
    if left is None or right is None:
        return None
    return Alignment(*K.partial_alignment(*K.comparable(left, right)))
