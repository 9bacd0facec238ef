"""Spaced repetition: the next schedule of a card, and the fold of a review log.

A card's reviews are folded in order inside one expression, without Python. A log is as
long as one card's history; all cards are folded in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import fixed as X

STATE = "struct<seen:boolean,due:bigint,interval:bigint,ease:double,reps:bigint,lapses:bigint,last:bigint>"


def next_day(ms: Column, zone: str = "UTC") -> Column:
    """Beginning of the day after in a time zone, whose days may have 23 or 25 hours."""
    if zone == "UTC":
        return (F.floor(ms / X.DAY_MS).cast("long") + 1) * F.lit(X.DAY_MS).cast("long")
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=ms / 1000))
    day = F.date_trunc("day", local).cast("timestamp_ntz") + F.expr("interval 1 day")
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), day)
    return (F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), utc) / 1000).cast("long")


def is_due(due: Column, now: Column, zone: str = "UTC") -> Column:
    """Whether a card is due before the next day begins."""
    return due < next_day(now, zone)


def next_schedule(s: Column, grade: Column, now: Column) -> Column:
    """The state after a review; ``s`` has the fields of ``STATE``."""
    learning = s["reps"] == 0
    before = F.greatest(F.lit(1).cast("long"), s["interval"])
    ease = F.when(learning, s["ease"]).when(grade == "hard", F.greatest(F.lit(X.MIN_EASE), s["ease"] - 0.15)).when(grade == "easy", s["ease"] + 0.15).otherwise(s["ease"])
    grown = F.when(grade == "hard", before * F.lit(1.2)).when(grade == "good", before * ease).otherwise(before * ease * F.lit(1.3))
    first = F.when(grade == "easy", X.FIRST_INTERVAL["easy"]).otherwise(X.FIRST_INTERVAL["good"]).cast("long")
    days = F.least(F.lit(X.MAX_INTERVAL).cast("long"), F.when(learning, first).otherwise(F.greatest(before + 1, F.floor(grown + 0.5).cast("long"))))
    again = grade == "again"
    lost = again & ~learning
    return F.struct(
        F.lit(True).alias("seen"),
        F.when(again, now).otherwise(now + days * F.lit(X.DAY_MS).cast("long")).alias("due"),
        F.when(again, F.lit(0).cast("long")).otherwise(days).alias("interval"),
        F.when(lost, F.greatest(F.lit(X.MIN_EASE), s["ease"] - 0.2)).when(again, s["ease"]).otherwise(ease).alias("ease"),
        F.when(again, F.lit(0).cast("long")).otherwise(s["reps"] + 1).alias("reps"),
        (s["lapses"] + F.when(lost, 1).otherwise(0).cast("long")).alias("lapses"),
        now.alias("last"),
    )


def new_state() -> Column:
    """A card that was never reviewed."""
    zero = F.lit(0).cast("long")
    return F.struct(F.lit(False).alias("seen"), zero.alias("due"), zero.alias("interval"), F.lit(X.DEFAULT_EASE).alias("ease"), zero.alias("reps"), zero.alias("lapses"), zero.alias("last"))


def applied(s: Column, grade: Column, now: Column) -> Column:
    """A review counts if it is a miss, or the card is new or due; else nothing changes."""
    counts = (grade == "again") | ~s["seen"] | is_due(s["due"], now)
    return F.when(counts, next_schedule(s, grade, now)).otherwise(s)


def schedules(log: DataFrame) -> DataFrame:
    """``card_id, due, interval, ease, reps, lapses, last`` from ``log(card_id, seq, at_ms, grade)``; times that tie go by ``seq``."""
    ordered = F.array_sort(F.collect_list(F.struct("at_ms", "seq", "grade")))
    state = F.aggregate(ordered, new_state().cast(STATE), lambda s, e: applied(s, e["grade"], e["at_ms"]).cast(STATE))
    return log.groupBy("card_id").agg(state.alias("s")).select("card_id", "s.due", "s.interval", "s.ease", "s.reps", "s.lapses", "s.last")


def state_label(due: Column, now: Column, zone: str = "UTC") -> Column:
    """``New``, ``Due``, or when it will be, in calendar days."""
    days = F.floor((next_day(due, zone) - next_day(now, zone)) / X.DAY_MS + 0.5).cast("long")
    months = F.floor(days / 30 + 0.5).cast("long")
    ahead = (
        F.when(days <= 0, "today").when(days == 1, "tomorrow").when(days < 31, F.concat(F.lit("in "), days.cast("string"), F.lit(" days")))
        .when(months <= 1, "in a month").otherwise(F.concat(F.lit("in "), months.cast("string"), F.lit(" months")))
    )
    return F.when(due.isNull(), "New").when(is_due(due, now, zone), "Due").otherwise(F.concat(F.lit("Due "), ahead))
