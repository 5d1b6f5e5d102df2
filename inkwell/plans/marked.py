"""Documents whose lines are marked with the structures that the text rules look for, in Spark and in SQL: each line gets a prefix by its number and the document's id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIXES = ("", "1) ", "2\\) ", "#tag", "## ", "**Name:** ", "**Place:** ", "```", "- ", "| ", "```", "", "**Created:** 8/31/2026 9:44:08", "3) ", "**Updated:** 2026/2/30 1:02:03", "* ", "✅", "⚠️")
#: Stamps stand alone on their lines.
STAMPS = tuple(p for p in PREFIXES if p.startswith(("**Created", "**Updated")))


def marked(docs: DataFrame, prefixes: tuple[str, ...] = PREFIXES, alone: tuple[str, ...] = STAMPS) -> DataFrame:
    rows = F.split("text", "\n", -1)
    put = F.array(*map(F.lit, prefixes))

    def one(line: Column, i: Column) -> Column:
        p = F.element_at(put, (F.pmod(i + F.col("doc_id"), F.lit(len(prefixes))) + 1).cast("int"))
        return F.when(p.isin(*alone), p).otherwise(F.concat(p, line))

    return docs.select("doc_id", F.array_join(F.transform(rows, one), "\n").alias("text"))


def sql_lines(prefixes: tuple[str, ...] = PREFIXES, alone: tuple[str, ...] = STAMPS) -> str:
    """The marked lines in SQL: one row a line, with the mask of fences."""
    listed = lambda xs: ", ".join("'" + x + "'" for x in xs)
    return f"""
    WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l, [{listed(prefixes)}] AS p FROM documents),
    e AS (SELECT doc_id, unnest(l) AS raw, unnest(range(len(l))) AS i, p FROM s),
    m AS (SELECT doc_id, i, p[((i + doc_id) % {len(prefixes)}) + 1] AS px, raw FROM e),
    x AS (SELECT doc_id, i, CASE WHEN px IN ({listed(alone)}) THEN px ELSE px || raw END AS line FROM m),
    f AS (SELECT doc_id, i, line, regexp_matches(line, '^\\s*```') AS fence FROM x),
    g AS (SELECT *, fence OR (sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY i)) % 2 = 1 AS mask FROM f),
    w AS (SELECT *, lag(line) OVER o AS before, lead(line) OVER o AS after, lag(mask) OVER o AS before_mask, lead(mask) OVER o AS after_mask FROM g WINDOW o AS (PARTITION BY doc_id ORDER BY i))
"""


SQL_LINES = sql_lines()
