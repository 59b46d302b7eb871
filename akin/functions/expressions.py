"""Scores and texts built from column expressions alone; they stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that Unicode counts as white space, as a class.
WHITE = "[\\u0009-\\u000D\\u001C-\\u0020\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, the value worked out once however often it is used; Spark repeats it in each branch otherwise."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def levenshtein(left: Column, right: Column, weights=(1, 1, 1), most: Column | None = None) -> tuple[Column, Column] | None:
    """Distance and its largest value. Other than uniform weights have no native form.

    ``most``: a distance beyond which only a narrow band of the table is worked out; it is below 0 then.
    """
    if len(set(weights)) > 1:
        return None
    w = weights[0]
    if most is None:
        apart = F.levenshtein(left, right)
    else:
        apart = F.call_function("levenshtein", left, right, F.greatest(most, F.lit(0)).cast("int"))
    return apart * F.lit(w), F.greatest(F.length(left), F.length(right)) * F.lit(w)


def normalize_text(text: Column) -> Column:
    """Anything but letters and numbers becomes a space, then trimmed and in lower case."""
    plain = F.regexp_replace(text, "[^\\p{L}\\p{N}]", " ")
    return F.lower(F.translate(F.trim(plain), "İΣ", "iσ"))


def tokens(text: Column) -> Column:
    """White-space separated parts."""
    return F.filter(F.split(text, f"{WHITE}+"), lambda t: t != "")


def token_sort(text: Column) -> Column:
    """The parts in order of code points, joined by a space."""
    return F.array_join(F.array_sort(tokens(text)), " ")


def grams(text: Column, n: int) -> Column:
    """Overlapping runs of ``n`` code points; none if the text is shorter."""
    count = F.length(text) - F.lit(n - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
