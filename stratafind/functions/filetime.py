"""100-nanosecond ticks since 1601."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, functions as F

# Ticks of 1970-01-01, ticks per millisecond and per day.
EPOCH, PER_MS, PER_DAY = 116_444_736_000_000_000, 10_000, 864_000_000_000


def _floor_div(x: Column, by: int) -> Column:
    """Floor of x / by for any 64-bit x: exact in 38 digits, where a double would lose the last ticks."""
    rest = x % F.lit(by)
    whole = ((x - rest).cast("decimal(20,0)") / F.lit(by).cast("decimal(20,0)")).cast("long")
    return whole - F.when(rest < 0, 1).otherwise(0)


def to_unix_ms(ticks: Column) -> Column:
    """Floor of the milliseconds since 1970 (also before it)."""
    return _floor_div(ticks, PER_MS) - F.lit(EPOCH // PER_MS)


def from_unix_ms(ms: Column) -> Column:
    return ms * F.lit(PER_MS) + F.lit(EPOCH)


def _shown(day: Column, second: Column) -> Column:
    """Date and second of the day as text; a date prints the same in every session time zone."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    clock = F.concat_ws(":", two((second / 3600).cast("int")), two((second % 3600 / 60).cast("int")), two(second % 60))
    return F.concat(F.ltrim(day.cast("string"), F.lit("+")), F.lit("T"), clock)


def format_utc(ticks: Column) -> Column:
    """yyyy-MM-ddTHH:mm:ss in UTC, whatever the session's time zone; years beyond 9999 have five digits."""
    days = _floor_div(ticks, PER_DAY)
    second = _floor_div(F.pmod(ticks, F.lit(PER_DAY)), 10_000_000)
    return _shown(F.date_add(F.lit(date(1601, 1, 1)), days.cast("int")), second)


def format_local(ticks: Column, zone: Column | str | None = None) -> Column:
    """The same on the clock of a time zone (default: the session's), from whole milliseconds; '' beyond year 9999."""
    ms = to_unix_ms(ticks)
    here = F.current_timezone() if zone is None else F.lit(zone) if isinstance(zone, str) else zone
    inside = (ms >= F.lit(-62_135_596_800_000)) & (ms < F.lit(253_402_207_200_000))
    safe = F.when(inside, ms)
    # a wall clock without a zone: nothing in it depends on the session
    utc = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(_floor_div(safe, 86_400_000).cast("int"), F.lit(0), F.lit(0), _floor_div(F.pmod(safe, F.lit(86_400_000)), 1000).cast("decimal(18,6)"))
    local = F.substring(F.convert_timezone(F.lit("UTC"), here, utc).cast("string"), 1, 19)
    return F.when(ticks.isNotNull(), F.coalesce(F.replace(local, F.lit(" "), F.lit("T")), F.lit("")))


def format_ticks(ticks: int) -> str:
    """format_utc of one 64-bit value, in the proleptic Gregorian calendar."""
    days, rest = divmod(ticks, PER_DAY)
    seconds = rest // 10_000_000
    cycles, days = divmod(days + 584_388, 146_097)  # 584,388 days from year 1 to 1601
    day = date.fromordinal(days + 1)
    year = day.year + 400 * cycles
    return f"{year:0{5 if year < 0 else 4}d}-{day.month:02d}-{day.day:02d}T{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}"
