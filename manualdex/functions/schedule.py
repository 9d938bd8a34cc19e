"""When an incremental run is due, on zone-less timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default time.
DEFAULT_HOUR = 18
DEFAULT_MINUTE = 0


def _clock(time: Column) -> tuple[Column, Column]:
    """Hour and minute of ``HH:MM``, clamped; the default time when it cannot be read."""
    shape = r"\A\s*([+-]?[0-9]+)\s*:\s*([+-]?[0-9]+)\s*\z"
    hour = F.regexp_extract(time, shape, 1).try_cast("bigint")
    minute = F.regexp_extract(time, shape, 2).try_cast("bigint")
    readable = hour.isNotNull() & minute.isNotNull()

    def clamp(v: Column, top: int) -> Column:
        return F.least(F.greatest(v, F.lit(0)), F.lit(top))

    return (
        F.when(readable, clamp(hour, 23)).otherwise(DEFAULT_HOUR).cast("int"),
        F.when(readable, clamp(minute, 59)).otherwise(DEFAULT_MINUTE).cast("int"),
    )


def _at(day: Column, time: Column) -> Column:
    hour, minute = _clock(time)
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour, minute)


def _step_days(frequency: Column, interval_days: Column) -> Column:
    return (
        F.when(frequency == "weekly", 7)
        .when(frequency == "interval", F.greatest(F.lit(1), F.coalesce(interval_days, F.lit(1))))
        .otherwise(1)
    )


def next_due(
    base: Column, frequency: Column, weekday: Column, interval_days: Column, time: Column,
    initial: Column,
) -> Column:
    """Next run after ``base``. An initial plan may still use today; later ones may not."""
    today = F.to_date(base)
    step = _step_days(frequency, interval_days)
    wanted = F.least(F.greatest(weekday, F.lit(0)), F.lit(6))
    ahead = F.pmod(wanted - F.weekday(base), F.lit(7))
    this_week = _at(F.date_add(today, ahead), time)
    weekly = F.when(
        (this_week <= base) | (~initial & (ahead == 0)), _at(F.date_add(today, ahead + 7), time)
    ).otherwise(this_week)
    soon = _at(today, time)
    later = _at(F.date_add(today, step), time)
    return F.when(frequency == "weekly", weekly).otherwise(
        F.when(initial & (soon > base), soon).otherwise(later)
    )


def roll_forward(
    due: Column,
    now: Column,
    frequency: Column,
    weekday: Column,
    interval_days: Column,
    time: Column,
    max_steps: int | None = None,
) -> Column:
    """First planned time after ``now``.

    All steps but the first have equal length, so the number of steps follows from the days
    between. ``max_steps`` stops that many steps from ``due``, still in the past if need be.
    """
    step = _step_days(frequency, interval_days)
    first = next_due(due, frequency, weekday, interval_days, time, F.lit(False))
    whole = F.floor(F.datediff(now, first) / step)
    reached = first <= now

    def after(steps: Column) -> Column:
        return F.date_add(F.to_date(first), (steps * step).cast("int"))

    enough = F.when(_at(after(whole), time) <= now, whole + 1).otherwise(whole)
    steps = F.when(reached, enough).otherwise(0)
    if max_steps is not None:
        steps = F.least(steps, F.lit(max_steps - 1))
    return F.when(due > now, due).otherwise(_at(after(steps), time))


def schedule_action(
    enabled: Column, next_due_text: Column, now: Column, run_overdue: Column, startup: Column
) -> Column:
    """What a check does: none, reschedule, wait, run, or roll_forward at start-up."""
    due = parse_timestamp(next_due_text)
    return (
        F.when(~enabled, "none")
        .when(due.isNull(), "reschedule")
        .when(due > now, "wait")
        .when(startup & ~run_overdue, "roll_forward")
        .otherwise("run")
    )


def parse_bool(value: Column, default: bool = False) -> Column:
    text = F.lower(F.regexp_replace(value.cast("string"), r"(?U)\A\s+|\s+\z", ""))
    return F.when(value.isNull(), default).otherwise(text.isin("1", "true", "yes", "on"))


def parse_timestamp(value: Column) -> Column:
    """ISO date or date and time; anything else is null."""
    text = F.regexp_replace(value, r"(?U)\A\s+|\s+\z", "")
    iso = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?)?\z"
    return F.when(text.rlike(iso), text.try_cast("timestamp_ntz"))


def show_timestamp(value: Column) -> Column:
    return F.coalesce(F.date_format(value, "dd.MM.yyyy HH:mm"), F.lit("—"))
