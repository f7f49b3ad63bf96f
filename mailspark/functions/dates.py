"""Dates of mail headers as timestamps."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# [day-of-week ","] day month year hour ":" minute [":" second] zone [(comment)]
MAIL_DATE = (
    r"(?i)^\s*(?:[a-z]{3,9}\s*,\s*)?(\d{1,2})\s+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+(\d{2,4})"
    r"\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([+-]\d{4}|[a-z]{1,5})?\s*(?:\(.*\))?\s*$"
)
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
# Hours west or east of Greenwich; other names count as +0000.
ZONES = {"EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}


def mail_time(date: Column) -> Column:
    """TIMESTAMP of a Date header; NULL for what is none.

    Years of two digits are 1950 to 2049, of three digits from 1900. A leap second is the second before.
    """
    part = lambda i: F.regexp_extract(date, MAIL_DATE, i)
    number = lambda i: part(i).try_cast("int")
    digits, given = F.length(part(3)), number(3)
    year = F.when(digits == 2, given + F.when(given < 50, 2000).otherwise(1900)).when(digits == 3, given + 1900).otherwise(given)
    month = F.array_position(F.lit(MONTHS), F.lower(part(2))).cast("int")
    second = F.least(F.coalesce(number(6), F.lit(0)), F.lit(59))
    zone = part(7)
    sign = F.when(F.left(zone, F.lit(1)) == "-", -1).otherwise(1)
    offset = F.when(zone.rlike(r"^[+-]"), sign * (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int")))
    for name, hours in ZONES.items():
        offset = offset.when(F.upper(zone) == name, hours * 60)
    # A day that its month has not gives NULL, not an error.
    day = F.try_make_timestamp(year, month, number(1), number(4), number(5), second, F.lit("UTC"))
    return F.when(date.rlike(MAIL_DATE), day - F.make_dt_interval(mins=F.coalesce(offset, F.lit(0))))
