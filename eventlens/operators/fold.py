"""Keyed folds: several events of one key become one row, the last one wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def last_of(when: Column, *cols: Column) -> Column:
    """The columns of the last event (by ``seq``) for which ``when`` holds.

    The whole struct is taken from one event, null fields included, so an older
    value never shows through.  The aggregate combines map-side: however often
    a key occurs, each input partition sends at most one row for it.
    """
    return F.max_by(F.struct(*cols), F.when(when, F.col("seq")))


def last_per_id(items: Column) -> Column:
    """The last item per ``acc_id`` in an array of structs (acc_id, value).

    Sorts inside the row (by id, then position) and keeps the items whose
    successor has another id; nothing is shuffled.
    """
    ordered = F.array_sort(
        F.transform(
            items,
            lambda a, i: F.struct(
                a["acc_id"].alias("acc_id"), i.alias("pos"), a["value"].alias("value")
            ),
        )
    )
    with_next = F.arrays_zip(ordered.alias("this"), F.slice(ordered, 2, F.size(ordered)).alias("next"))
    last = F.filter(
        with_next, lambda z: z["next"].isNull() | (z["next"]["acc_id"] != z["this"]["acc_id"])
    )
    return F.transform(last, lambda z: z["this"])
