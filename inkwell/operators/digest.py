"""The daily digest: sections per date, their order, run notes, and the state of what was sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The sections of an ordinary day in order, and those of a break day.
ORDER = ("weather", "trains", "country", "comparison", "research", "ai", "scripture")
ON_BREAK = ("notice", "weather", "country")
UNAVAILABLE = "Unavailable today"


def gather(days: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """(date, <name>..., diagnostics): each source (date, value, error) joined by itself, so one's failure leaves the others alone. Null: failed; '': empty."""
    out, errors = days, []
    for name, rows in sources.items():
        out = out.join(rows.select("date", F.col("value").alias(name), F.col("error").alias(f"{name}_error")), "date", "left")
        errors.append(F.when(F.col(f"{name}_error").isNotNull(), F.concat(F.lit(f"{name}: "), F.col(f"{name}_error"))))
    return out.select("date", *sources, F.array_compact(F.array(*errors)).alias("diagnostics"))


def sections(days: DataFrame, texts: DataFrame) -> DataFrame:
    """(date, ord, key, text): the sections of each date. days: (date, on_break boolean, steward boolean); texts: (date, key, text).

    A Sunday has scripture instead of ai; a break has its three alone. Stewards stand first, or second on a break. What has no text says so.
    """
    sunday = F.dayofweek("date") == 1
    usual = F.when(sunday, F.array(*[F.lit(k) for k in ORDER if k != "ai"])).otherwise(F.array(*[F.lit(k) for k in ORDER if k != "scripture"]))
    rest = F.array(*map(F.lit, ON_BREAK))
    keys = F.when(F.col("on_break"), F.when(F.col("steward"), F.array_insert(rest, 2, F.lit("stewards"))).otherwise(rest)).otherwise(F.when(F.col("steward"), F.array_prepend(usual, F.lit("stewards"))).otherwise(usual))
    listed = days.select("date", F.posexplode(keys).alias("ord", "key"))
    return listed.join(texts, ["date", "key"], "left").select("date", "ord", "key", F.coalesce("text", F.lit(UNAVAILABLE)).alias("text"))


def bodies(parts: DataFrame) -> DataFrame:
    """(date, body): a date's sections, in order, apart by an empty line."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])
    return parts.groupBy("date").agg(F.array_join(rows, "\n\n").alias("body"))


def run_note(notes: Column, diagnostics: Column) -> Column:
    """A reviewer's notes go before diagnostics; without either, all is well."""
    return F.when(F.size(notes) > 0, F.concat(F.lit("Notes: "), F.array_join(notes, "; "))).when(F.size(diagnostics) > 0, F.concat(F.lit("Diagnostics: "), F.array_join(diagnostics, "; "))).otherwise("All sources answered.")


def unsent(days: DataFrame, state: DataFrame) -> DataFrame:
    return days.join(state.select("date"), "date", "left_anti")


def recorded(state: DataFrame, sent: DataFrame) -> DataFrame:
    """The state with the newly sent dates; a date that is there stays as it is."""
    return state.unionByName(unsent(sent, state), allowMissingColumns=True)


def canonical(topics: DataFrame) -> DataFrame:
    """Topics with one row per title, white space and case aside: the first of each in its sequence."""
    key = F.lower(F.trim(F.regexp_replace("title", r"[\s_]+", " ")))
    return topics.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy("seq"))).where("k = 1").drop("k")


def category_counts(topics: DataFrame) -> DataFrame:
    return canonical(topics).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
