"""Times: canonical stamps, precisions, calendars, truncation, labels.  All are column expressions but two calendars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: precisions by rank
PRECISION_RANKS = {
    "billion_years": 0, "hundred_million_years": 1, "million_years": 3, "hundred_thousand_years": 4, "ten_thousand_years": 5, "millennium": 6,
    "century": 7, "decade": 8, "year": 9, "month": 10, "day": 11, "hour": 12, "minute": 13, "second": 14,
}
# fixed values: calendars by identifier
CALENDARS = {"Q1985727": "gregorian", "Q181974": "republican", "Q1985786": "julian", "Q44722": "hebrew", "Q28892": "islamic"}
# fixed values: month names
MONTHS = {
    "fr": ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"],
    "en": ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"],
}


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def canonical_stamp(raw: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SSZ`` of a date with - or /, and an optional time; null if it is none."""
    pattern = r"^\s*(-?\d{1,6})[-/](\d{1,2})[-/](\d{1,2})(?:[T ](\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:\.\d+)?)?)?Z?\s*$"
    g = lambda i: F.regexp_extract(raw, pattern, i)
    two = lambda c: F.lpad(F.when(c == "", "0").otherwise(c), 2, "0")
    year = F.regexp_replace(g(1), "^-", "")
    sign = F.when(g(1).startswith("-"), "-").otherwise("")
    padded = F.when(F.length(year) < 4, F.lpad(year, 4, "0")).otherwise(year)
    return F.when(raw.rlike(pattern), F.concat(sign, padded, F.lit("-"), two(g(2)), F.lit("-"), two(g(3)), F.lit("T"), two(g(4)), F.lit(":"), two(g(5)), F.lit(":"), two(g(6)), F.lit("Z")))


def instant(stamp: Column, calendar: Column, precision: Column) -> Column:
    """All three or none."""
    return F.when(stamp.isNotNull() & calendar.isNotNull() & precision.isNotNull(), F.struct(stamp.alias("stamp"), calendar.alias("calendar"), precision.alias("precision")))


def valid_time(start: Column, end: Column, as_of: str) -> tuple[Column, Column]:
    """Start, and end or the day ``as_of`` in the Gregorian calendar."""
    return start, F.coalesce(end, F.struct(F.lit(as_of).alias("stamp"), F.lit("gregorian").alias("calendar"), F.lit("day").alias("precision")))


def strict_gregorian(value: Column) -> Column:
    """An instant of day precision from a date that exists; else null."""
    day = F.try_to_date(F.substring(canonical_stamp(value), 1, 10))
    return F.when(day.isNotNull(), F.struct(canonical_stamp(value).alias("stamp"), F.lit("gregorian").alias("calendar"), F.lit("day").alias("precision")))


def is_iso_date(value: Column) -> Column:
    """Exactly YYYY-MM-DD, and a day that exists."""
    return F.coalesce(value.rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.date_format(F.try_to_date(value), "yyyy-MM-dd") == value), F.lit(False))


def day_number(day: Column) -> Column:
    """Days since 0001-01-01."""
    return F.datediff(day, F.lit("0001-01-01").cast("date")).cast("long")


def precision_rank(precision: Column) -> Column:
    name = F.regexp_replace(F.lower(precision), "^unit|s$", "")
    name = F.when(name == "millenium", "millennium").otherwise(name)
    return F.coalesce(_map(PRECISION_RANKS)[name], F.lit(-1))


def more_precise(target: Column, other: Column) -> Column:
    """Whether the other is finer than the target; unknown ones are coarsest."""
    return precision_rank(other) > precision_rank(target)


def precision_of(rank: Column) -> Column:
    return _map({v: k for k, v in PRECISION_RANKS.items()})[rank.cast("int")]


def calendar_of(uri: Column) -> Column:
    return _map(CALENDARS)[F.regexp_extract(uri, r"(Q\d+)$", 1)]


def same_calendar(a: Column, b: Column) -> Column:
    """Identifiers that differ by http or https alone are one."""
    plain = lambda c: F.regexp_replace(c, "^https?://", "")
    return plain(a) == plain(b)


def truncated(stamp: Column, precision: Column) -> Column:
    """A date's text cut to its precision; the sign stays, and a year too short gives 0."""
    year = F.regexp_extract(stamp, r"^(-?)(\d{4,})-(\d{2})-(\d{2})", 2)
    sign = F.regexp_extract(stamp, r"^(-?)(\d{4,})-(\d{2})-(\d{2})", 1)
    month, day = F.regexp_extract(stamp, r"^-?\d{4,}-(\d{2})-(\d{2})", 1), F.regexp_extract(stamp, r"^-?\d{4,}-(\d{2})-(\d{2})", 2)

    def cut(n: int) -> Column:
        left = F.when(F.length(year) > n, year.substr(F.lit(1), F.length(year) - n)).otherwise("0")
        return F.when(left == "0", left).otherwise(F.concat(sign, left))

    rank = precision_rank(precision)
    return (
        F.when(rank == 6, cut(3)).when(rank == 7, cut(2)).when(rank == 8, cut(1)).when(rank == 9, F.concat(sign, year))
        .when(rank == 10, F.concat(sign, year, F.lit("-"), month)).when(rank >= 11, F.concat(sign, year, F.lit("-"), month, F.lit("-"), day))
    )


# Julian day arithmetic, integers throughout


def _div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("long")


def julian_day_of_gregorian(y: Column, m: Column, d: Column) -> Column:
    a = F.floor((14 - m) / 12).cast("long")
    yy, mm = y + 4800 - a, m + 12 * a - 3
    return (d + _div(153 * mm + 2, 5) + 365 * yy + _div(yy, 4) - _div(yy, 100) + _div(yy, 400) - 32045).cast("long")


def julian_day_of_julian(y: Column, m: Column, d: Column) -> Column:
    a = F.floor((14 - m) / 12).cast("long")
    yy, mm = y + 4800 - a, m + 12 * a - 3
    return (d + _div(153 * mm + 2, 5) + 365 * yy + _div(yy, 4) - 32083).cast("long")


def julian_day_of_republican(y: Column, m: Column, d: Column) -> Column:
    """French Republican years of the arithmetic (Romme) rule: leap by fours, not by hundreds but by four hundreds, from 22 September 1792 on."""
    p = y - 1
    return (F.lit(2375839) + 365 * p + _div(y, 4) - _div(y, 100) + _div(y, 400) + 30 * (m - 1) + d).cast("long")


def date_of_julian_day(jd: Column) -> Column:
    """The Gregorian date of a Julian day number."""
    return F.date_add(F.lit("1970-01-01").cast("date"), (jd - 2440588).cast("int"))


def to_gregorian(y: Column, m: Column, d: Column, calendar: Column) -> Column:
    """The Gregorian date of a day in the Gregorian, Julian or Republican calendar."""
    jd = F.when(calendar == "julian", julian_day_of_julian(y, m, d)).when(calendar == "republican", julian_day_of_republican(y, m, d)).when(calendar == "gregorian", julian_day_of_gregorian(y, m, d))
    return date_of_julian_day(jd)


def islamic_to_julian_day(y: Column, m: Column, d: Column) -> Column:
    """The civil Islamic calendar."""
    return (d + F.ceil(29.5 * (m - 1)) + (y - 1) * 354 + _div(3 + 11 * y, 30) + 1948439).cast("long")


def hebrew_to_julian_day(y: Column, m: Column, d: Column) -> Column:
    """The Hebrew calendar, months from Nisan; leap years have thirteen."""

    def elapsed(year: Column) -> Column:
        months = _div(235 * year - 234, 19)
        parts = 12084 + 13753 * months
        day = 29 * months + _div(parts, 25920)
        return day + F.when(F.pmod(3 * (day + 1), F.lit(7)) < 3, 1).otherwise(0)

    def new_year(year: Column) -> Column:
        before, own, after = elapsed(year - 1), elapsed(year), elapsed(year + 1)
        return own + F.when(after - own == 356, 2).when(own - before == 382, 1).otherwise(0)

    start, size = new_year(y), new_year(y + 1) - new_year(y)
    leap = F.pmod(7 * y + 1, F.lit(19)) < 7
    last = F.when(leap, 13).otherwise(12)

    def month_days(k: Column) -> Column:
        short = k.isin(2, 4, 6, 10, 13) | ((k == 12) & ~leap) | ((k == 8) & (F.pmod(size, F.lit(10)) != 5)) | ((k == 9) & (F.pmod(size, F.lit(10)) == 3))
        return F.when(short, 29).otherwise(30)

    total = lambda a, b: F.aggregate(F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<int>")), F.lit(0), lambda s, k: s + month_days(k))
    m = m.cast("int")
    before = F.when(m < 7, total(F.lit(7), last) + total(F.lit(1), m - 1)).otherwise(total(F.lit(7), m - 1))
    return (F.lit(347998) + start + before + d - 1).cast("long")


# Labels


def _ordinal_en(n: Column) -> Column:
    teen = F.pmod(n, F.lit(100)).between(11, 13)
    last = F.pmod(n, F.lit(10))
    return F.concat(n.cast("string"), F.when(~teen & (last == 1), "st").when(~teen & (last == 2), "nd").when(~teen & (last == 3), "rd").otherwise("th"))


def time_label(stamp: Column, precision: Column, lang: str) -> Column:
    """A human label of an instant of a precision, in French or else English."""
    year, month, day = F.year(stamp), F.month(stamp), F.dayofmonth(stamp)
    century, millennium = F.ceil(year / 100), F.ceil(year / 1000)
    decade = (F.floor(year / 10) * 10).cast("int")
    rank = precision_rank(precision)
    name = F.element_at(F.array(*[F.lit(x) for x in MONTHS["fr" if lang == "fr" else "en"]]), month)
    two = F.lpad(day.cast("string"), 2, "0")
    text = lambda c: c.cast("string")
    if lang == "fr":
        return F.when(
            stamp.isNotNull(),
            F.when(rank == 6, F.concat(text(millennium), F.when(millennium == 1, "re").otherwise("e"), F.lit(" millénaire")))
            .when(rank == 7, F.concat(text(century), F.when(century == 1, "er").otherwise("e"), F.lit(" siècle")))
            .when(rank == 8, F.concat(F.lit("années "), text(decade)))
            .when(rank == 10, F.concat_ws(" ", name, text(year)))
            .when(rank >= 11, F.concat_ws(" ", F.when(day == 1, "1er").otherwise(two), name, text(year)))
            .otherwise(text(year)),
        )
    return F.when(
        stamp.isNotNull(),
        F.when(rank == 6, F.concat(_ordinal_en(millennium), F.lit(" millennium")))
        .when(rank == 7, F.concat(_ordinal_en(century), F.lit(" century")))
        .when(rank == 8, F.concat(text(decade), F.lit("s")))
        .when(rank == 10, F.concat_ws(" ", name, text(year)))
        .when(rank >= 11, F.concat(name, F.lit(" "), two, F.lit(", "), text(year)))
        .otherwise(text(year)),
    )


# fixed values: words of validity labels
VALIDITY_WORDS = {
    "en": {"app": "Creation time", "dis": "Disappearance time", "between": "between", "before": "before", "after": "after", "and": "and"},
    "fr": {"app": "Date de création", "dis": "Date de disparition", "between": "entre", "before": "avant", "after": "après", "and": "et"},
}


def validity_label(side: str, crisp: Column, after: Column, before: Column, lang: str) -> Column:
    """``Creation time: ...`` from a crisp label, or bounds; null without any."""
    w = VALIDITY_WORDS.get(lang, VALIDITY_WORDS["en"])
    lead = F.lit(f"{w[side]}: ")
    return (
        F.when(crisp.isNotNull(), F.concat(lead, crisp))
        .when(before.isNotNull() & after.isNotNull(), F.concat(lead, F.lit(w["between"] + " "), after, F.lit(f" {w['and']} "), before))
        .when(before.isNotNull(), F.concat(lead, F.lit(w["before"] + " "), before))
        .when(after.isNotNull(), F.concat(lead, F.lit(w["after"] + " "), after))
    )


def midpoint(a: Column, b: Column) -> Column:
    """The middle of two timestamps, in whole milliseconds."""
    ms = lambda c: F.unix_millis(c.cast("timestamp"))
    return F.timestamp_millis(F.floor((ms(a) + ms(b)) / 2)).cast("timestamp_ntz")


def standardised(stamp: Column, calendar: Column, precision: Column) -> Column:
    """A date's text in the Gregorian calendar, cut to its precision; null for a calendar that no arithmetic here converts."""
    part = lambda i: F.regexp_extract(stamp, r"^(-?\d{1,6})-(\d{2})-(\d{2})", i).cast("int")
    day = F.date_format(to_gregorian(part(1), part(2), part(3), calendar), "yyyy-MM-dd")
    return F.element_at(F.transform(F.array(day), lambda d: truncated(d, precision)), 1)  # the day is computed once
