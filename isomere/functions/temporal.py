"""Times and durations: five lexical forms, precision, whole-column parsing, ISO 8601 durations. Sessions are in UTC."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

# Fixed lexical forms of years (expanded ones have a sign and five digits or more), months, days and seconds, as whole texts.
PLAIN_YEAR, EXPANDED_YEAR = r"^[0-9]{4}\z", r"^[+-][0-9]{5,}\z"
MONTH, DAY = r"^[0-9]{4}-[0-9]{2}\z", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
SECOND = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})\z"


def has_timezone(value: Column) -> Column:
    return F.regexp_like(value, F.lit(r"(Z|[+-][0-9]{2}:[0-9]{2})\z"))


def precision(value: Column) -> Column:
    """year, month, day or second by the lexical form, null if there is none. The length tells which form to look for."""
    n, fits = F.char_length(value), lambda pattern: F.regexp_like(value, F.lit(pattern))
    signed = F.substring(value, 1, 1).isin("+", "-")
    return (
        F.when(signed, F.when(fits(EXPANDED_YEAR), "year")).when(n == 4, F.when(fits(PLAIN_YEAR), "year")).when(n == 7, F.when(fits(MONTH), "month"))
        .when(n == 10, F.when(fits(DAY), "day")).when(n >= 20, F.when(fits(SECOND), "second"))
    )


def _days(year: Column, month: Column) -> Column:
    """Days of a month by the Gregorian rules, which also hold for year 0."""
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    return F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def resolve(value: Column) -> Column:
    """struct(kind, when, precision): moment, unrepresentable (year 0, beyond 9999, a leap second) or malformed.

    Offsets are taken off by arithmetic, as they may be up to 23:59 either way. All parts are read by their places. The form, the
    parts and the moment are bound one after the other, so each is worked out once, also under a condition, where the engine
    would repeat the form's patterns wherever a part depends on them.
    """
    return _let(F.struct(value.alias("v"), precision(value).alias("form")), _parts)


def _let(value: Column, then) -> Column:
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _parts(r: Column) -> Column:
    form, v = r["form"], r["v"]
    whole = lambda at, n: F.substring(v, at, n).try_cast("int")
    # Only what the form has is cast: a cast that fails costs more than all the rest.
    year = F.when(form == "year", v.try_cast("bigint")).when(form.isNotNull(), whole(1, 4).cast("bigint"))
    month, day = F.when(form != "year", whole(6, 2)), F.when(form.isin("day", "second"), whole(9, 2))
    zoned = (form == "second") & ~F.endswith(v, F.lit("Z"))
    parts = F.struct(
        v.alias("v"), form.alias("form"), year.alias("year"), month.alias("month"), day.alias("day"), zoned.alias("zoned"), F.when(zoned, F.substring(v, -5, 2).try_cast("int")).alias("hours"),
        F.when(zoned, F.substring(v, -2, 2).try_cast("int")).alias("minutes"), ((form == "second") & (F.substring(v, 18, 2) == "60")).alias("leap_second"),
    )
    return _let(parts, _judged)


def _judged(r: Column) -> Column:
    form, v, year, month, day, zoned = (r[k] for k in ("form", "v", "year", "month", "day", "zoned"))
    whole = lambda at, n: F.substring(v, at, n).try_cast("int")
    clock = (form != "second") | (whole(12, 2) <= 23) & (whole(15, 2) <= 59) & (whole(18, 2) <= 59) & (~zoned | (r["hours"] <= 23) & (r["minutes"] <= 59))
    right = (form == "year") | month.between(1, 12) & ((form == "month") | day.between(1, _days(year, month))) & clock
    return _let(F.struct(r.alias("of"), right.alias("right"), year.between(1, 9999).alias("inside")), _timed)


def _timed(j: Column) -> Column:
    r, right, inside = j["of"], j["right"], j["inside"]
    form, v, zoned = r["form"], r["v"], r["zoned"]
    start = F.lpad(r["year"].cast("string"), 4, "0")
    local = F.when(form == "year", F.concat(start, F.lit("-01-01"))).when(form == "month", F.concat(v, F.lit("-01"))).otherwise(F.when(zoned, F.concat(F.substring(v, F.lit(1), F.char_length(v) - 6), F.lit("Z"))).otherwise(v))
    offset = F.make_dt_interval(F.lit(0), r["hours"], r["minutes"]) * F.when(F.substring(v, -6, 1) == "-", -1).otherwise(1)
    moment = form.isNotNull() & right & inside & ~r["leap_second"]

    def told(parsed: Column) -> Column:
        when = F.when(zoned, parsed - offset).otherwise(parsed)
        kind = (
            F.when(form.isNull(), "malformed").when(r["leap_second"], "unrepresentable").when(~right, "malformed")
            .when(r["year"].isNull() | ~inside, "unrepresentable").when(parsed.isNull(), "malformed").otherwise("moment")
        )
        # The moment is missing exactly where what was parsed is.
        return F.struct(kind.alias("kind"), when.alias("when"), F.when(parsed.isNotNull(), form).alias("precision"))

    return _let(F.try_to_timestamp(F.when(moment, local)), told)


def maybe_datetime(value: Column, column: WindowSpec) -> Column:
    """The values of one axis as timestamps if all parse (time zones may be left out), else null for the whole axis."""
    parsed = F.try_to_timestamp(value)
    return F.when(F.bool_and(parsed.isNotNull() | value.isNull()).over(column), parsed)


def iso_duration(seconds: Column) -> Column:
    """Seconds as PT..S, with decimals only if needed; negative ones with a sign before the P."""
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", F.abs(seconds).cast("double")), "0+$", ""), r"\.$", "")
    return F.concat(F.when(seconds < 0, F.lit("-")).otherwise(F.lit("")), F.lit("PT"), text, F.lit("S"))


def iso_time(when: Column) -> Column:
    """A timestamp as ISO text with Z, with a fraction only if it has one."""
    fraction = F.regexp_replace(F.date_format(when, ".SSSSSS"), r"\.000000$", "")
    return F.concat(F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))


def is_standard_calendar(calendar: Column) -> Column:
    return F.coalesce(F.regexp_like(calendar, F.lit(r"(?is)^(.*/)?(gregorian|standard|proleptic_gregorian)\z")), F.lit(False))
