"""Hand-kept recurring entries as dated, scored listing rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listloom.functions.dates import iso, schedule_dates
from listloom.functions.scoring import with_confidence
from listloom.functions.text import filled


def curated_rows(entries: DataFrame, as_of: Column, trust: Column, horizon: int = 14, schedule: str = "weekly", commune: str = "",
                 source: str = "curated", expected: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """One scored row for every date of an entry; entries without a venue give none.

    A missing schedule counts as ``schedule``, a missing place as ``commune``. ``entries`` has title,
    venue_name, schedule, start_date and end_date (ISO texts), time, commune, description, source_url.
    """
    day = lambda c: F.try_to_date(F.col(c), "yyyy-MM-dd")
    dates = schedule_dates(F.coalesce(filled("schedule"), F.lit(schedule)), day("start_date"), day("end_date"), as_of, horizon)
    rows = (entries.where(filled("venue_name").isNotNull()).withColumn("_day", F.explode(dates))
            .withColumns({"start_date": iso(F.col("_day")), "end_date": F.lit(None).cast("string"), "source_id": F.lit(source),
                          "commune": F.coalesce(filled("commune"), F.lit(commune)), "image_url": F.lit(None).cast("string")}).drop("_day"))
    return with_confidence(rows, trust, expected)
