"""From comma lists of table ids to one row per id."""

from pyspark.sql import DataFrame, functions as F

from querylume.functions.lists import (
    concat_lists, concat_present_lists, ids_or_empty, split_ids,
)


def explode_ids(df: DataFrame, col: str, out="table_id", keep=None) -> DataFrame:
    """One row per id in ``col``; a null or empty list gives none.

    ``keep`` names the other columns to carry along (all by default).
    """
    keep = [c for c in df.columns if c != out] if keep is None else keep
    return df.select(*keep, F.explode(split_ids(F.col(col))).alias(out))


def explode_accesses(df: DataFrame, keep) -> DataFrame:
    """One row per id read and per id written.

    Same rows as the union of two ``explode_ids``, from one scan instead of two.
    """
    both = F.concat(
        ids_or_empty(F.col("read_table_ids")), ids_or_empty(F.col("write_table_ids"))
    )
    return df.select(*keep, F.explode(both).alias("table_id"))


def explode_read_write(df: DataFrame, include_one_sided=False, keep=("query_id",),
                       once=False) -> DataFrame:
    """One row per id of ``read,write`` joined as one list.

    By default a query that lacks either list gives no row at all;
    ``include_one_sided`` keeps the ids of the side that is there, and ``once`` lists
    an id that a query names several times only once.
    """
    join = concat_present_lists if include_one_sided else concat_lists
    ids = F.split(join(F.col("read_table_ids"), F.col("write_table_ids")), ",")
    return df.select(*keep, F.explode(F.array_distinct(ids) if once else ids).alias("table_id"))
