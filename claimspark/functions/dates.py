"""Date columns: ISO texts with or without an offset, parsed without raising, in an explicit zone.

The results are times without a zone, so nothing depends on the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL = "local"

# An offset after a time of day, up to the 18 hours a zone offset may have.
_OFFSET = r"(?<=:[0-9.]{2,12})\s*(Z|[+-](?:0\d|1[0-7]):?[0-5]\d|[+-]18:?00)$"


def wall_clock(c: Column, zone: str = LOCAL) -> Column:
    """Time of day as read in ``zone``, null when the text is not a time.

    ``local`` keeps the clock the text was written in; otherwise a text without an offset is
    taken as UTC.
    """
    written = F.regexp_replace(c, _OFFSET, "").try_cast("timestamp_ntz")
    if zone == LOCAL:
        return written
    offset = F.regexp_replace(F.regexp_extract(c, _OFFSET, 1), r"^([+-]\d{2}):?(\d{2})$", "$1:$2")
    source = F.when(offset.isin("", "Z"), F.lit("UTC")).otherwise(offset)
    return F.convert_timezone(source, F.lit(zone), written)
