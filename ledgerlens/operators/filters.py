"""Report filters: four optional arguments, ANDed, bound at plan time."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Non-ISO date forms also accepted (month first, as the reference's parser reads them).
EXTRA_DATE_FORMATS = ["%m/%d/%Y", "%Y/%m/%d", "%B %d %Y", "%b %d %Y", "%B %d, %Y", "%b %d, %Y"]


def parse_date(value: str | date | None) -> date | None:
    """Parse a date argument before any job starts; bad input raises ValueError.

    Accepts ``YYYY-MM-DD``, ``YYYYMMDD``, ISO date-times (time dropped) and the
    forms in ``EXTRA_DATE_FORMATS``.
    """
    if value is None or value == "":
        return None
    if isinstance(value, datetime):
        return value.date()
    if isinstance(value, date):
        return value
    text = str(value).strip()
    try:
        return date.fromisoformat(text)
    except ValueError:
        pass
    try:
        return datetime.fromisoformat(text).date()
    except ValueError:
        pass
    for fmt in EXTRA_DATE_FORMATS:
        try:
            return datetime.strptime(text, fmt).date()
        except ValueError:
            continue
    raise ValueError(f"not a date: {value!r}")


@dataclass(frozen=True)
class ReportFilter:
    """The optional filter arguments of every report.

    A falsy argument (None or empty string) is skipped.  The number must match
    exactly; the name is trimmed, lower-cased and searched as a substring of the
    lower-cased name (``name_regex=True`` reads it as a regular expression);
    the date bounds are inclusive.
    """

    servicer_number: str | None = None
    servicer_name: str | None = None
    start_date: str | date | None = None
    end_date: str | date | None = None
    name_regex: bool = False

    def __post_init__(self) -> None:
        # Validate eagerly so a bad argument fails before any Spark job.
        parse_date(self.start_date)
        parse_date(self.end_date)
        if self.name_regex and self.servicer_name:
            try:
                re.compile(self.name_pattern)
            except re.error as exc:
                raise ValueError(f"bad name pattern: {self.servicer_name!r}") from exc

    @property
    def start(self) -> date | None:
        return parse_date(self.start_date)

    @property
    def end(self) -> date | None:
        return parse_date(self.end_date)

    @property
    def name_pattern(self) -> str:
        return (self.servicer_name or "").strip().lower()

    def normalised(self) -> ReportFilter:
        """Client-side clean-up: drop empty values and whitespace-only names, trim the name."""
        name = (self.servicer_name or "").strip() or None
        return replace(
            self,
            servicer_number=self.servicer_number or None,
            servicer_name=name,
            start_date=self.start_date or None,
            end_date=self.end_date or None,
        )

    def is_empty(self) -> bool:
        return not (self.servicer_number or self.servicer_name
                    or self.start_date or self.end_date)


NO_FILTER = ReportFilter()


def name_condition(name: Column, flt: ReportFilter) -> Column:
    """The name filter on a name column: substring (or regex) of the lower-cased
    name; a missing name never matches."""
    lowered = F.lower(name)
    cond = (lowered.rlike(flt.name_pattern) if flt.name_regex
            else lowered.contains(F.lit(flt.name_pattern)))
    return F.coalesce(cond, F.lit(False))


def apply_filters(df: DataFrame, flt: ReportFilter | None) -> DataFrame:
    """Apply the filters in the fixed order; Catalyst merges them into one."""
    if flt is None:
        return df
    if flt.servicer_number:
        df = df.where(F.col("servicer_number") == F.lit(flt.servicer_number))
    if flt.servicer_name:
        df = df.where(name_condition(F.col("servicer_name"), flt))
    if flt.start is not None:
        df = df.where(F.col("business_date") >= F.lit(flt.start))
    if flt.end is not None:
        df = df.where(F.col("business_date") <= F.lit(flt.end))
    return df
