"""Wide columns for rows that were chosen by narrow ones.

Order, top percents and budgets look at keys and scores only. Those are staged once as a narrow table, the choice is a filter on it, and
the text joins the choice at the end: rows that were not chosen stop at the scan of the text, before anything is moved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.operators.lookup import BROADCAST_ROWS, fits_broadcast


def attach(chosen: DataFrame, wide: DataFrame, key: str, small: bool | None = None, rows: int | None = None) -> DataFrame:
    """The chosen rows with the columns of ``wide``, a table with one row per ``key``.

    A choice that fits is sent to the scan of ``wide``, which is then not shuffled at all. A larger one should be a filter over a staged
    table: Spark turns it into a Bloom filter in that scan (``spark.sql.optimizer.runtime.bloomFilter``; the session sets its
    sizes), and only what passes is shuffled. ``small`` settles which, else the choice is counted, unless it has numbers only
    and the caller knows its ``rows``.
    """
    if small is None:
        texts = [f.name for f in chosen.schema.fields if f.dataType.typeName() == "string"]
        small = rows <= BROADCAST_ROWS if rows is not None and not texts else fits_broadcast(chosen, texts)
    return wide.join(F.broadcast(chosen) if small else chosen, key)
