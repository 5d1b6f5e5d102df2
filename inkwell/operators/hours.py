"""Hourly forecasts: civil days, coverage, wet spells as gaps and islands, the sky, and overlapping notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ZONE = "Europe/London"
# Thresholds of chance (%), amount (mm) and intensity (mm an hour), daytime hours, parts of the day, kinds of rain by code.
WET_CHANCE, SURE_CHANCE, WET_MM, HEAVY_MM, MODERATE_MM = 50, 70, 0.1, 4.0, 0.5
DAYTIME = (7, 19)
PARTS = ((0, 6, "early morning"), (6, 12, "morning"), (12, 17, "afternoon"), (17, 22, "evening"), (22, 24, "late evening"))
KINDS = (("thunderstorms", range(95, 100)), ("snow", (71, 73, 75, 77, 85, 86)), ("showers", (80, 81, 82)), ("rain", range(61, 68)), ("drizzle", range(51, 58)))
CODES = {0: "clear sky", 1: "mainly clear skies", 2: "partly cloudy", 3: "overcast", 45: "fog", 48: "freezing fog", 51: "light drizzle", 53: "drizzle", 55: "heavy drizzle", 56: "light freezing drizzle", 57: "freezing drizzle", 61: "light rain", 63: "rain", 65: "heavy rain", 66: "light freezing rain", 67: "freezing rain", 71: "light snow", 73: "snow", 75: "heavy snow", 77: "snow grains", 80: "light showers", 81: "showers", 82: "heavy showers", 85: "light snow showers", 86: "heavy snow showers", 95: "thunderstorms", 96: "thunderstorms with hail", 99: "thunderstorms with heavy hail"}
FEELS = ((8, "cold"), (12, "chilly"), (16, "cool"), (20, "mild"), (25, "warm"))


def day_start(date: Column) -> Column:
    """The UTC instant at which a London date begins."""
    return F.to_utc_timestamp(date.cast("timestamp"), ZONE)


def day_end(date: Column) -> Column:
    return day_start(F.date_add(date, 1))


def local_hour(moment: Column) -> Column:
    return F.hour(F.from_utc_timestamp(moment, ZONE))


def coverage(hours: DataFrame, days: DataFrame, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """(by, date, expected, found, complete): a label t covers the hour before it; a day of 23, 24 or 25 hours needs each label exactly once, with numbers.

    Every group of ``by`` that has any hour is asked for every day; a null in ``by`` is a group as well.
    """
    wanted = days.withColumn("s", day_start(F.col("date"))).withColumn("e", day_end(F.col("date"))).select("date", F.explode(F.expr("sequence(s + interval 1 hour, e, interval 1 hour)")).alias("t"))
    if by:
        wanted = wanted.crossJoin(hours.select(*by).distinct())
    seen = hours.groupBy(*by, "t").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("chance").isNotNull() & F.col("mm").isNotNull()).alias("numeric"))
    seen = seen.withColumnsRenamed({c: f"__{c}" for c in (*by, "t")})
    on = F.col("t") == F.col("__t")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    both = wanted.join(seen, on, "left")
    good = F.coalesce((F.col("n") == 1) & F.col("numeric"), F.lit(False))
    return both.groupBy(*by, "date").agg(F.count(F.lit(1)).alias("expected"), F.sum(F.coalesce("n", F.lit(0))).alias("found"), F.bool_and(good).alias("complete"))


def wet_spells(hours: DataFrame, by: list[str]) -> DataFrame:
    """Spells of touching wet hours: (by, start, end, kind, intensity, likely, peak_chance, parts). hours: (by, t, chance, mm, code), one row an hour."""
    wet = hours.where((F.col("chance") >= WET_CHANCE) | (F.col("mm") >= WET_MM))
    start = F.expr("t - interval 1 hour")
    hour = local_hour(start)
    part = F.expr("cast(null as string)")
    for first, last, name in reversed(PARTS):
        part = F.when((hour >= first) & (hour < last), name).otherwise(part)
    marked = wet.withColumn("likely", (F.col("chance") >= SURE_CHANCE) | ((F.col("mm") >= WET_MM) & (F.col("chance") >= WET_CHANCE))).withColumn("part", part)
    island = F.unix_timestamp("t") - 3600 * F.row_number().over(Window.partitionBy(*by).orderBy("t"))
    runs = marked.withColumn("island", island).groupBy(*by, "island")
    kind = F.lit("rain")
    for name, codes in reversed(KINDS):
        kind = F.when(F.arrays_overlap("codes", F.array(*map(F.lit, codes))), name).otherwise(kind)
    intensity = F.when(F.col("mm") > HEAVY_MM, "heavy").when(F.col("mm") >= MODERATE_MM, "moderate").otherwise("light")
    # a spell is at most a civil day's 25 hours, so its hours fit a row
    ordered = F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("t", "part"))), lambda x: x["part"]))
    found = runs.agg(F.min(start).alias("start"), F.max("t").alias("end"), F.collect_set("code").alias("codes"), F.max("mm").alias("mm"), F.bool_or("likely").alias("likely"), F.max("chance").cast("int").alias("peak_chance"), ordered.alias("parts"))
    return found.select(*by, "start", "end", kind.alias("kind"), intensity.alias("intensity"), "likely", "peak_chance", "parts")


def sky(hours: DataFrame, by: list[str]) -> DataFrame:
    """(by, sky) from the codes of the daytime hours; a group without any is an error to its reader: it is not there."""
    hour = local_hour(F.expr("t - interval 1 hour"))
    day = hours.where((hour >= DAYTIME[0]) & (hour < DAYTIME[1]))
    shares = day.groupBy(*by).agg(F.avg(F.col("code").isin(0, 1).cast("int")).alias("clear"), F.avg(((F.col("code") == 3) | (F.col("code") >= 45)).cast("int")).alias("cloudy"))
    word = F.when(F.col("clear") >= 0.6, "mostly sunny").when(F.col("cloudy") >= 0.9, "grey").when(F.col("cloudy") >= 0.6, "mostly cloudy").otherwise("sunny spells")
    return shares.select(*by, word.alias("sky"))


def code_text(code: Column) -> Column:
    """A weather code in words; null for one that is not known."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair]), code)


def whole_degrees(value: Column) -> Column:
    return F.concat(F.floor(value + 0.5).cast("string"), F.lit("°C"))


def feel(high: Column) -> Column:
    degrees, word = F.floor(high + 0.5), F.lit("hot")
    for below, name in reversed(FEELS):
        word = F.when(degrees < below, name).otherwise(word)
    return word


def clock(moment: Column) -> Column:
    """``15:00 (3pm)``, ``12:00 (midday)`` or ``midnight`` in London."""
    local = F.from_utc_timestamp(moment, ZONE)
    hour, minute = F.hour(local), F.minute(local)
    spoken = F.concat(F.when(hour % 12 == 0, F.lit(12)).otherwise(hour % 12).cast("string"), F.when(minute > 0, F.date_format(local, ":mm")).otherwise(""), F.when(hour < 12, "am").otherwise("pm"))
    spoken = F.when((hour == 12) & (minute == 0), "midday").otherwise(spoken)
    return F.when((hour == 0) & (minute == 0), "midnight").otherwise(F.concat(F.date_format(local, "HH:mm"), F.lit(" ("), spoken, F.lit(")")))


def overlaps(start: Column, end: Column, date: Column) -> Column:
    """Whether the half-open [start, end) and the London date have a moment in common."""
    return (start < day_end(date)) & (end > day_start(date))


def line_status(pages: DataFrame, safe, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """(by, date, notices, dropped) of landed pages (by, date, json): the notices of one line that hold on the London date, in order, and how many had to be left out.

    A status other than good service counts where it has no period or one that overlaps the day. One whose period is malformed, or whose reason is
    missing, empty or not ``safe`` (a rule over a column), is left out and counted. Of reasons that are equal but for white space the first stays.
    A page of another shape is an error.
    """
    period = "struct<fromDate:string,toDate:string>"
    lines = F.from_json("json", f"array<struct<lineStatuses:array<struct<statusSeverityDescription:string,reason:string,validityPeriods:array<{period}>>>>>")
    statuses = F.get(lines, F.lit(0))["lineStatuses"]
    sound = F.when((F.size(lines) == 1) & statuses.isNotNull(), statuses).otherwise(F.raise_error(F.lit("unexpected response shape")).cast(f"array<struct<statusSeverityDescription:string,reason:string,validityPeriods:array<{period}>>>"))
    keys = [*by, "date"]
    each = pages.select(*keys, sound.alias("all")).select(*keys, F.posexplode_outer("all").alias("seq", "s"))
    moment = lambda x: F.try_to_timestamp(x)
    periods = F.transform(F.coalesce("s.validityPeriods", F.array().cast(f"array<{period}>")), lambda p: F.struct(moment(p["fromDate"]).alias("from"), moment(p["toDate"]).alias("to")))
    judged = each.withColumn("periods", periods).withColumn("reason", F.trim("s.reason"))
    hits = F.transform("periods", lambda p: overlaps(p["from"], p["to"], F.col("date")))
    # a period before a malformed one may already have decided
    holds = (F.size("periods") == 0) | F.exists(hits, lambda h: F.coalesce(h, F.lit(False)))
    broken = ~holds & F.exists(hits, lambda h: h.isNull())
    bad = F.coalesce("s.statusSeverityDescription", F.lit("")) != "Good Service"
    good = holds & F.coalesce((F.col("reason") != "") & safe(F.col("reason")), F.lit(False))
    marked = judged.withColumn("kept", F.col("s").isNotNull() & bad & good).withColumn("lost", F.col("s").isNotNull() & bad & (broken | holds & ~good))
    key = F.regexp_replace("reason", r"\s+", " ")
    once = marked.withColumn("k", F.row_number().over(Window.partitionBy(*keys, "kept", F.when(F.col("kept"), key)).orderBy("seq")))
    listed = F.array_sort(F.collect_list(F.when(F.col("kept") & (F.col("k") == 1), F.struct("seq", "reason"))))
    return once.groupBy(*keys).agg(F.transform(listed, lambda x: x["reason"]).alias("notices"), F.sum(F.col("lost").cast("int")).cast("int").alias("dropped"))


def notices(statuses: DataFrame, date: Column) -> DataFrame:
    """(seq, reason) of statuses other than good service that have no period or one that overlaps the date; the first of equal reasons, white space aside."""
    hit = (F.size(F.coalesce("periods", F.array())) == 0) | F.exists("periods", lambda p: overlaps(p["from"], p["to"], date))
    found = statuses.where((F.col("severity") != "Good Service") & hit).withColumn("reason", F.trim("reason")).where("reason <> ''")
    key = F.regexp_replace("reason", r"\s+", " ")
    return found.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy("seq"))).where("k = 1").select("seq", "reason")


def on_and_off(spells: DataFrame, by: list[str]) -> DataFrame:
    """Parts of the day that at least two spells share."""
    return spells.select(*by, F.explode("parts").alias("part")).groupBy(*by, "part").agg(F.count(F.lit(1)).alias("spells")).where("spells >= 2")
