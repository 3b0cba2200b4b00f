"""Dates: project-specific texts, calendars and time-of-day flags."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Date patterns by style, with the order of their parts; month names.
DATE_STYLES = {
    "day_first": (r"(\d*?) (.*) (.*) (\d*):(\d*)", ("day", "month", "year", "hour", "minute")),
    "full": (r"(\d*)-(\d*)-(\d*) (\d*):(\d*):(\d*)", ("year", "month", "day", "hour", "minute", "second")),
    "month_first": (r"(.*) (\d*), (\d*)", ("month", "day", "year")),
    "date_only": (r"(\d*)-(\d*)-(\d*)", ("year", "month", "day")),
}
PROJECT_STYLES = {
    "qt": "day_first",
    "jdt": "full",
    "platform": "full",
    "eclipse": "full",
    "gerrit": "month_first",
    "go": "date_only",
    "openstack": "date_only",
}
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
DEFAULTS = {"hour": "23", "minute": "59", "second": "59"}


def _month(text: Column) -> Column:
    names = F.array(*[F.lit(m) for m in MONTHS])
    at = F.array_position(names, text)
    return F.when(at > 0, at.cast("string")).otherwise(text)


def _year(text: Column) -> Column:
    """A year like ``'19`` means 2019 (for 10 to 20)."""
    return F.regexp_replace(text, r"^'(1[0-9]|20)$", "20$1")


def parse_date(text: Column, style: str) -> Column:
    """Timestamp without zone; parts a style lacks are 23, 59 and 59; unreadable texts are null."""
    pattern, names = DATE_STYLES[style]
    part = {n: F.regexp_extract(text, pattern, i + 1) for i, n in enumerate(names)}
    get = lambda n: part.get(n, F.lit(DEFAULTS.get(n, "")))
    day = F.concat_ws("-", _year(get("year")), F.lpad(_month(get("month")), 2, "0"), F.lpad(get("day"), 2, "0"))
    time = F.concat_ws(":", *[F.lpad(get(n), 2, "0") for n in ("hour", "minute", "second")])
    return F.concat_ws(" ", day, time).try_cast("timestamp_ntz")


def parse_project_date(text: Column, project: Column) -> Column:
    """Pick the style by project."""
    out = None
    for style in DATE_STYLES:
        names = [p for p, s in PROJECT_STYLES.items() if s == style]
        when = (F.when if out is None else out.when)(project.isin(*names), parse_date(text, style))
        out = when
    return out


def month_intervals(first: Column, last: Column) -> Column:
    """Array of (start, end) month pairs: the first of the month after ``first`` up to the first one
    not before ``last``, each paired with the next."""
    begin = F.add_months(F.trunc(first, "month"), 1)
    end = F.when(F.trunc(last, "month") == last, last).otherwise(F.add_months(F.trunc(last, "month"), 1))
    marks = F.sequence(begin, F.greatest(end, begin), F.expr("interval 1 month"))
    return F.when(first < last, F.transform(
        F.slice(marks, F.lit(1), F.size(marks) - 1),
        lambda m: F.struct(m.alias("start"), F.add_months(m, 1).alias("end")),
    ))


# Hours of the four parts of the day.
DAY_PARTS = {
    "night": (22, 23, 0, 1, 2, 3, 4, 5, 6),
    "morning": (7, 8, 9, 10, 11, 12),
    "afternoon": (13, 14, 15, 16, 17),
    "evening": (18, 19, 20, 21),
}
WEEKDAYS = "Mon Tue Wed Thu Fri Sat Sun".split()


def time_flags(ts: Column) -> list[Column]:
    """0/1 columns for the part of the day and the weekday."""
    parts = [F.hour(ts).isin(*hours).cast("int").alias(name) for name, hours in DAY_PARTS.items()]
    days = [(F.weekday(ts) == i).cast("int").alias(name.lower()) for i, name in enumerate(WEEKDAYS)]
    return parts + days
