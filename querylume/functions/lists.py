"""Comma lists held as text."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F


def split_ids(col: Column) -> Column:
    """Array of ids; null for a null or empty list."""
    return F.split(F.nullif(col, F.lit("")), ",")


def ids_or_empty(col: Column) -> Column:
    """Array of ids; an empty array for a null or empty list."""
    return F.coalesce(split_ids(col), F.array().cast("array<string>"))


def concat_lists(a: Column, b: Column) -> Column:
    """``a,b`` as text; null when either side is null."""
    return F.concat(a, F.lit(","), b)


def concat_present_lists(a: Column, b: Column) -> Column:
    """``a,b`` as text from the sides that hold anything; null when neither does."""
    blank = F.lit("")
    return F.nullif(F.concat_ws(",", F.nullif(a, blank), F.nullif(b, blank)), blank)


def common_ids(col: Column, ids) -> Column:
    """Ids of the list that are also in ``ids``, each once, sorted; null when the text
    does not even contain one of them, which spares most rows the split."""
    wanted = F.array(*[F.lit(i) for i in ids])
    mentioned = reduce(or_, [col.contains(i) for i in ids])
    return F.when(mentioned, F.sort_array(F.array_intersect(F.split(col, ","), wanted)))


def join_texts(parts, sep=" | ") -> Column:
    """The non-null texts joined by ``sep``."""
    return F.concat_ws(sep, *parts)
