"""Mixed timestamp formats and zones brought to one unambiguous form per record.

`stamped(df, text, zone, order, year)` adds `canon`: 'YYYY-MM-DD' where the text states a day only,
'YYYY-MM-DDTHH:MMZ' (UTC, nearest minute) where it states a clock time, null where it states no real day.
The cascade of formats and the policy for ambiguous and nonexistent local times are in
`plinth.functions.stamps`. A row-wise map: no shuffle; lookups of zone and date order are joined before.

Defined results: null, blank and placeholder texts give null; a missing zone gives the day alone; a missing
date order reads month first; repeated rows give the same result each; extra columns pass through.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions import stamps


def _canon():
    @F.pandas_udf("string")  # type: ignore[call-overload]
    def run(text: pd.Series, zone: pd.Series, order: pd.Series, year: pd.Series) -> pd.Series:
        seen: dict = {}
        out = []
        for key in zip(text, zone, order, year):
            t, z, o, y = key
            k = (t, z, o, None if y is None or y != y else int(y))
            if k not in seen:
                if len(seen) > 20000:
                    seen.clear()
                seen[k] = stamps.canonical(*k) if isinstance(t, str) else None
            out.append(seen[k])
        return pd.Series(out, dtype=object)

    return run


def year_in(col: Column) -> Column:
    """The first four-digit year in a term or path, null without one."""
    return F.regexp_extract(F.coalesce(col, F.lit("")), r"(\d{4})", 1).try_cast("int")


def stamped(df: DataFrame, text: Column, zone: Column, order: Column, year: Column, out: str = "canon") -> DataFrame:
    """Texts without any digit state no day and never reach Python."""
    some = F.coalesce(text.rlike(r"\p{Nd}"), F.lit(False))
    return df.withColumn(out, F.when(some, _canon()(F.when(some, text), zone, order, year)))


def archive_stamps(talks: DataFrame, pages: DataFrame, feeds: DataFrame) -> DataFrame:
    """(tab, rec_id, canon) of every record of both tables whose own text states a day."""
    a = talks.select(F.lit("talks").alias("tab"), F.col("row_id").alias("rec_id"), "feed", F.col("date_raw").alias("raw"), year_in(F.col("term")).alias("year"))
    b = pages.select(F.lit("blog_pages").alias("tab"), F.col("page_id").alias("rec_id"), "feed", F.col("meta_raw").alias("raw"), year_in(F.col("path_date")).alias("year"))
    rows = a.unionByName(b).where(F.col("raw").rlike(r"\p{Nd}"))
    rows = rows.join(feeds.select("feed", "zone", "date_order"), "feed", "left")
    return (
        stamped(rows, F.col("raw"), F.col("zone"), F.col("date_order"), F.col("year")).where(F.col("canon").isNotNull()).select("tab", "rec_id", "canon")
    )
