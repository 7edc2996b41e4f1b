"""Array columns to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from funnelscope.functions.text import let


def rows_of(df: DataFrame, items: Column | str, keep: list[str], pos: str = "pos", item: str = "item") -> DataFrame:
    """One row per array item with the ``keep`` columns, its zero-based ``pos`` and the ``item``.

    Written as an outer explode and a filter on its output: for a plain explode Spark derives a
    "size > 0" filter on the array, pushes it below and computes the array a second time there.
    """
    return df.select(*keep, F.posexplode_outer(items).alias(pos, item)).filter(F.col(item).isNotNull())


def last_by_key(items: Column, key) -> Column:
    """The last item of each key, in the order in which keys first appear; one sort, no nested search.

    ``key`` maps an item to its key. Items must be orderable (no maps inside).
    """
    indexed = F.transform(items, lambda x, i: F.struct(key(x).alias("key"), i.alias("at"), x.alias("item")))

    def pick(s):
        n = F.size(s)
        firsts = F.filter(s, lambda x, i: (i == 0) | (F.try_element_at(s, i)["key"] != x["key"]))
        lasts = F.filter(s, lambda x, i: (i == n - 1) | (F.try_element_at(s, i + 2)["key"] != x["key"]))
        return F.array_sort(F.zip_with(firsts, lasts, lambda f, x: F.struct(f["at"].alias("at"), x["item"].alias("item"))))
    return F.transform(let(F.array_sort(indexed), pick), lambda x: x["item"])
