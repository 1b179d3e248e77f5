"""Times in calendars whose years are not those of the standard one: day numbers by whole-number arithmetic on columns.

A calendar is named by the last part of its identifier. Times are texts of the five lexical forms; parts that are left out are
the first of their kind. Offsets belong to the standard calendar and are malformed here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: calendars by name.
NO_LEAP, ALL_LEAP, DAYS_360, JULIAN = ("noleap", "365_day"), ("all_leap", "366_day"), ("360_day",), ("julian",)
#: Fixed: days before each month of a year without the 29th of February.
BEFORE = (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334, 365)
FORM = r"^([0-9]{4}|[+-][0-9]{5,})(?:-([0-9]{2})(?:-([0-9]{2})(?:T([0-9]{2}):([0-9]{2}):([0-9]{2})(\.[0-9]+)?Z?)?)?)?\z"


def name(calendar: Column) -> Column:
    return F.lower(F.element_at(F.split(calendar, "/"), -1))


def is_known(calendar: Column) -> Column:
    return F.coalesce(name(calendar).isin(*NO_LEAP, *ALL_LEAP, *DAYS_360, *JULIAN), F.lit(False))


def _let(value: Column, then) -> Column:
    """then(value), with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _is_leap(year: Column, calendar: Column) -> Column:
    """Whether a year has a 29th of February; years without it in the calendar of 360 days play no part."""
    kind = name(calendar)
    return F.when(kind.isin(*ALL_LEAP), True).when(kind.isin(*JULIAN), F.pmod(year, F.lit(4)) == 0).otherwise(False)


def days_in_month(year: Column, month: Column, calendar: Column) -> Column:
    table = F.array(*[F.lit(b - a) for a, b in zip(BEFORE, BEFORE[1:], strict=False)])
    plain = F.get(table, (month - 1).cast("int"))
    return F.when(name(calendar).isin(*DAYS_360), 30).otherwise(plain + F.when((month == 2) & _is_leap(year, calendar), 1).otherwise(0)).cast("bigint")


def day_number(year: Column, month: Column, day: Column, calendar: Column) -> Column:
    """Days since the first day of year 0 of the calendar."""
    kind = name(calendar)
    before = F.get(F.array(*map(F.lit, BEFORE)), (month - 1).cast("int")) + F.when((month > 2) & _is_leap(year, calendar), 1).otherwise(0)
    # Leap years from year 0 up to the one before.
    julian = year * 365 + F.floor((year + 3) / 4)
    start = F.when(kind.isin(*ALL_LEAP), year * 366).when(kind.isin(*JULIAN), julian).otherwise(year * 365)
    return F.when(kind.isin(*DAYS_360), year * 360 + (month - 1) * 30 + day - 1).otherwise(start + before + day - 1).cast("bigint")


def micros(value: Column, calendar: Column) -> Column:
    """Microseconds since the start of year 0 of the calendar; null for what is no time in it, or for an unknown calendar."""

    def judged(x: Column) -> Column:
        v = x["v"]
        part = lambda k, least: F.coalesce(F.nullif(F.regexp_extract(v, FORM, k), F.lit("")).try_cast("bigint"), F.lit(least)).alias(f"p{k}")
        fraction = F.rpad(F.substring(F.regexp_extract(v, FORM, 7), 2, 6), 6, "0").try_cast("bigint").alias("f")
        fits = F.regexp_like(v, F.lit(FORM)) & is_known(x["c"])
        read = F.struct(*[part(k, least) for k, least in ((1, 0), (2, 1), (3, 1), (4, 0), (5, 0), (6, 0))], fraction, x["c"].alias("c"))
        return F.when(fits, _let(read, counted))

    def counted(p: Column) -> Column:
        year, month, day, hour, minute, second = (p[f"p{k}"] for k in range(1, 7))
        inside = month.between(1, 12) & day.between(1, days_in_month(year, month, p["c"])) & (hour <= 23) & (minute <= 59) & (second <= 59) & (F.abs(year) <= 200_000)
        total = ((day_number(year, month, day, p["c"]) * 24 + hour) * 60 + minute) * 60 + second
        return F.when(inside, total * 1_000_000 + F.coalesce(p["f"], F.lit(0)))

    return _let(F.struct(value.alias("v"), name(calendar).alias("c")), judged)


def is_moment(value: Column, calendar: Column) -> Column:
    """Whether a text is a time of the calendar; of one that isn't known, whether it has the form of a time."""
    return F.when(is_known(calendar), micros(value, calendar).isNotNull()).otherwise(F.regexp_like(value, F.lit(FORM)))


def text(micros_: Column, calendar: Column) -> Column:
    """The ISO text of microseconds since the start of year 0 of a known calendar, to the second; its inverse."""
    day_long = F.lit(86_400_000_000)

    def dated(x: Column) -> Column:
        days = ((x["m"] - F.pmod(x["m"], day_long)) / day_long).cast("bigint")
        return _let(F.struct(days.alias("days"), F.floor(F.pmod(x["m"], day_long) / 1_000_000).cast("int").alias("s"), x["c"].alias("c")), placed)

    def placed(x: Column) -> Column:
        days, kind, cycle = x["days"], x["c"], F.pmod(x["days"], F.lit(1461))
        even = lambda n: F.struct(F.floor(days / n).cast("bigint").alias("y"), F.pmod(days, F.lit(n)).alias("d"))
        # Of four Julian years the first has the leap day.
        place = F.when(cycle < 366, 0).otherwise(F.floor((cycle - 366) / 365) + 1)
        julian = F.struct((F.floor(days / 1461) * 4 + place).cast("bigint").alias("y"), F.when(cycle < 366, cycle).otherwise(F.pmod(cycle - 366, F.lit(365))).alias("d"))
        found = F.when(kind.isin(*DAYS_360), even(360)).when(kind.isin(*ALL_LEAP), even(366)).when(kind.isin(*JULIAN), julian).otherwise(even(365))
        return _let(F.struct(found.alias("at"), x["s"].alias("s"), kind.alias("c")), written)

    def written(x: Column) -> Column:
        year, of_year, seconds = x["at"]["y"], x["at"]["d"], x["s"]
        leap = F.when(_is_leap(year, x["c"]), 1).otherwise(0)
        starts = F.transform(F.array(*map(F.lit, BEFORE[:12])), lambda b: b + F.when(b > 31, leap).otherwise(0))
        month = F.when(x["c"].isin(*DAYS_360), F.floor(of_year / 30) + 1).otherwise(F.size(F.filter(starts, lambda s: s <= of_year)))
        two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
        clock = F.concat_ws(":", two(F.floor(seconds / 3600)), two(F.floor(seconds / 60) % 60), two(seconds % 60))

        def joined(m: Column) -> Column:
            day = F.when(x["c"].isin(*DAYS_360), F.pmod(of_year, F.lit(30)) + 1).otherwise(of_year - F.get(starts, (m - 1).cast("int")) + 1)
            return F.concat(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), two(m), two(day)), F.lit("T"), clock, F.lit("Z"))

        return _let(month, joined)

    return F.when(micros_.isNotNull() & is_known(calendar), _let(F.struct(micros_.alias("m"), name(calendar).alias("c")), dated))
