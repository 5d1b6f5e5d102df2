"""Deterministic rotation and the calendar, on a date dimension. Items are ordered within a cycle by a hash, so any row's place is reproducible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Day 0, and the slots in which nothing repeats across cycles.
EPOCH, GAP = "2026-01-01", 3
REMINDER_DAYS, HORIZON = 14, 400


def dates(spark: SparkSession, first: str, last: str) -> DataFrame:
    return spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}')) AS date")


def _raw(items: DataFrame, cycles: DataFrame) -> DataFrame:
    """(category, cycle, item, n, raw): a hash-ordered permutation of every category's items for every cycle."""
    key = F.sha2(F.concat_ws(":", "category", F.col("cycle").cast("string"), F.col("item").cast("string")), 256)
    both = items.join(cycles, "category")
    return both.withColumn("raw", F.row_number().over(Window.partitionBy("category", "cycle").orderBy(key, "item")) - 1)


def cycle_orders(items: DataFrame, cycles: DataFrame) -> DataFrame:
    """(category, cycle, item, pos). items: (category, item); cycles: (category, cycle).

    What stood in the last ``gap`` places of the cycle before goes behind the rest of the first 2 gap places, so nothing repeats within gap places.
    """
    sized = items.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("category")))
    gap = F.least(F.lit(GAP), F.floor(F.col("n") / 3))
    wanted = cycles.unionByName(cycles.select("category", (F.col("cycle") - 1).alias("cycle"))).where("cycle >= 0").distinct()
    raw = _raw(sized, wanted)
    tail = raw.where(F.col("raw") >= F.col("n") - gap).select("category", (F.col("cycle") + 1).alias("cycle"), "item", F.lit(True).alias("recent"))
    head = F.col("raw") < 2 * gap
    order = Window.partitionBy("category", "cycle").orderBy(~head, F.when(head, F.coalesce("recent", F.lit(False))), "raw")
    placed = raw.join(tail, ["category", "cycle", "item"], "left").withColumn("pos", F.row_number().over(order) - 1)
    return placed.join(cycles, ["category", "cycle"], "left_semi").select("category", "cycle", "item", "pos")


def picks(days: DataFrame, items: DataFrame) -> DataFrame:
    """(date, category, item): the item of every category for every date; floor division, so dates before day 0 have a place too (cycles below 0 have none before them)."""
    sizes = items.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    day = F.datediff("date", F.lit(EPOCH).cast("date"))
    at = days.crossJoin(F.broadcast(sizes)).select("date", "category", F.floor(day / F.col("n")).alias("cycle"), F.pmod(day, F.col("n")).alias("pos"))  # one row per category
    orders = cycle_orders(items, at.select("category", "cycle").distinct())
    return at.join(orders, ["category", "cycle", "pos"]).select("date", "category", "item")


def easter(year: Column) -> Column:
    """Easter Sunday of a Gregorian year, in integer arithmetic."""
    y = year.cast("int")
    div = lambda a, b: F.floor(a / b).cast("int")
    a, b, c = y % 19, div(y, 100), y % 100
    h = (19 * a + b - div(b, 4) - div(b - div(b + 8, 25) + 1, 3) + 15) % 30
    m = (32 + 2 * (b % 4) + 2 * div(c, 4) - h - c % 4) % 7
    k = div(a + 11 * h + 22 * m, 451)
    total = h + m - 7 * k + 114
    return F.make_date(y, div(total, 31), total % 31 + 1)


def break_names(days: DataFrame, breaks: DataFrame, holidays: DataFrame, easter_break: bool = True) -> DataFrame:
    """(date, name): the break of each date, null on others. breaks: (priority, name, start, end), the first listed wins; then Easter, Good Friday to Monday; then a bank holiday."""
    listed = breaks.select(F.col("name").alias("break_name"), "priority", F.explode(F.sequence(F.col("start").cast("date"), F.col("end").cast("date"))).alias("date"))
    first = listed.groupBy("date").agg(F.min_by("break_name", "priority").alias("break_name"))
    named = days.join(first, "date", "left")
    gap = F.datediff("date", easter(F.year("date")))
    is_easter = F.lit(easter_break) & gap.between(-2, 1)
    free = holidays.select("date", F.col("name").alias("holiday"))
    return named.join(free, "date", "left").select("date", F.coalesce("break_name", F.when(is_easter, F.lit("Easter")), "holiday").alias("name"))


def breaks_with_return(named: DataFrame) -> DataFrame:
    """(date, name, back): break days, with the next day that is none. ``named`` must reach far enough; a break of over HORIZON days is an error."""
    after = Window.orderBy("date").rowsBetween(1, HORIZON)  # a calendar: one row a day
    back = F.min(F.when(F.col("name").isNull(), F.col("date"))).over(after)
    found = named.withColumn("back", back).where("name IS NOT NULL")
    return found.withColumn("back", F.when(F.col("back").isNull(), F.raise_error(F.concat(F.lit("no day without a break after "), F.col("date").cast("string"))).cast("date")).otherwise(F.col("back")))


def reading_plan(books: DataFrame) -> DataFrame:
    """(week, book, first, last): per book an overview week (null chapters), then two chapters a week. books: (seq, book, chapters)."""
    weeks = F.flatten(F.array(F.array(F.lit(0)), F.when(F.col("chapters") > 0, F.sequence(F.lit(1), F.col("chapters"), F.lit(2))).otherwise(F.array().cast("array<int>"))))
    at = books.select("seq", "book", "chapters", F.posexplode(weeks).alias("k", "first"))
    week = F.row_number().over(Window.orderBy("seq", "k")) - 1  # a plan: a row a week
    return at.select(week.alias("week"), "book", F.when(F.col("first") > 0, F.col("first")).alias("first"), F.when(F.col("first") > 0, F.least(F.col("first") + 1, "chapters")).alias("last"))


def readings(named: DataFrame, plan: DataFrame, start: str) -> DataFrame:
    """(date, absolute, week, book, first, last, previous_date, next_date) of the reading Sundays: those from ``start`` on that are no break days; the plan starts again after its end."""
    sundays = named.where((F.dayofweek("date") == 1) & (F.col("date") >= F.lit(start).cast("date")) & F.col("name").isNull())
    order = Window.orderBy("date")
    numbered = sundays.withColumn("absolute", F.row_number().over(order) - 1).withColumn("previous_date", F.lag("date").over(order)).withColumn("next_date", F.lead("date").over(order))
    weeks = plan.select(F.count(F.lit(1)).alias("weeks"))
    return numbered.crossJoin(F.broadcast(weeks)).withColumn("week", F.pmod("absolute", "weeks")).join(plan, "week").select("date", "absolute", "week", "book", "first", "last", "previous_date", "next_date")


def stewards(days: DataFrame, duty: DataFrame, teams: DataFrame, mine: str) -> DataFrame:
    """Sundays with their team, names, whether it is ``mine``, note, what is missing, and a reminder before the rota ends."""
    last = duty.select(F.max("date").alias("last"))
    long = lambda c: F.date_format(c, "EEEE d MMMM yyyy")
    at = days.where(F.dayofweek("date") == 1).crossJoin(F.broadcast(last)).join(duty.withColumn("listed", F.lit(True)), "date", "left").join(teams, "team", "left")
    over, inside = F.col("date") > F.col("last"), F.col("date") <= F.col("last")
    missing = F.when(over, F.concat(F.lit("The rota on file ended on "), long("last"), F.lit("; please send the next one."))).when(F.col("listed").isNull(), "This Sunday is not in the rota on file.")
    reminder = F.when(inside & (F.datediff("last", "date") <= REMINDER_DAYS), F.concat(F.lit("The rota on file ends on "), long("last"), F.lit("; please send the next rota.")))
    return at.select("date", F.when(inside, F.col("team")).alias("team"), F.when(inside, F.col("names")).alias("names"), F.coalesce(inside & (F.col("team") == mine), F.lit(False)).alias("mine"), F.when(inside, F.col("note")).alias("note"), missing.alias("missing"), reminder.alias("reminder"))


def ordinal_date(date: Column) -> Column:
    """``Today is Tuesday 13th October 2026.``"""
    d = F.dayofmonth(date)
    suffix = F.when((d % 100).between(11, 13), "th").when(d % 10 == 1, "st").when(d % 10 == 2, "nd").when(d % 10 == 3, "rd").otherwise("th")
    return F.concat(F.lit("Today is "), F.date_format(date, "EEEE d"), suffix, F.date_format(date, " MMMM yyyy"), F.lit("."))


def delivery_date(now: Column) -> Column:
    """The London date after that of an instant."""
    return F.date_add(F.to_date(F.from_utc_timestamp(now, "Europe/London")), 1)


def recent_topics(state: DataFrame, cap: int = 60) -> DataFrame:
    """The last ``cap`` non-empty topics, oldest first."""
    return state.where("topic IS NOT NULL AND topic <> ''").orderBy(F.desc("date")).limit(cap).orderBy("date")


def chapter_range(first: Column, last: Column) -> Column:
    """``1–2``, or ``51`` for one chapter."""
    return F.when(first == last, first.cast("string")).otherwise(F.concat(first.cast("string"), F.lit("–"), last.cast("string")))


def reading_title(book: Column, first: Column, last: Column) -> Column:
    """``Sirach 1–2``, ``Sirach 51``, or ``Sirach overview`` where there are no chapters."""
    return F.concat(book, F.lit(" "), F.coalesce(chapter_range(first, last), F.lit("overview")))


def chapter_words(verses: DataFrame) -> DataFrame:
    """(book, chapter, words) of (book, chapter, verse, lines): words between white space."""
    words = F.aggregate("lines", F.lit(0), lambda n, line: n + F.size(F.filter(F.split(line, r"(?U)\s+"), lambda w: w != "")))
    return verses.groupBy("book", "chapter").agg(F.sum(words).alias("words"))


def day_plans(days: DataFrame, items: DataFrame, named: DataFrame, readings: DataFrame, duty: DataFrame) -> DataFrame:
    """One row per date: its picks (category to item), its break (name, back) or null, its reading on a Sunday that is no break day, its stewards on a Sunday.

    named: the calendar of break_names(), reaching beyond the days; readings: of readings(); duty: of stewards().
    """
    # a date has as many picks as there are categories
    chosen = picks(days, items).groupBy("date").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "item")))).alias("picks"))
    breaks = breaks_with_return(named).select("date", F.struct("name", "back").alias("on_break"))
    read = readings.select("date", F.struct("absolute", "week", "book", "first", "last", "previous_date", "next_date").alias("reading"))
    served = duty.select("date", F.struct(*[c for c in duty.columns if c != "date"]).alias("stewards"))
    out = days.select("date")
    for part in (chosen, breaks, read, served):
        out = out.join(part, "date", "left")
    return out


def geography(iso3: Column, known: DataFrame) -> tuple[DataFrame, Column]:
    """``known`` (iso3, geography) as a side to join by ``iso3``, and the geography of a row that it has none for."""
    return known, F.coalesce("geography", F.lit("the whole country"))


# What a run ends with.
STATUS = {"done": 0, "failure": 1, "not sent": 2, "diagrams": 3, "flood": 4, "nothing": 10}


def run_status(failed: Column, problems: Column, unseen: Column, cap: Column, wants_send: Column, sent: Column) -> Column:
    """A run's status: a failure first, then diagrams that would not be drawn, nothing new, too much at once, and a package that was made but not sent."""
    return (
        F.when(failed, STATUS["failure"])
        .when(problems > 0, STATUS["diagrams"])
        .when(unseen == 0, STATUS["nothing"])
        .when(unseen > cap, STATUS["flood"])
        .when(wants_send & ~sent, STATUS["not sent"])
        .otherwise(STATUS["done"])
    )
