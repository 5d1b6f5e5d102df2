"""Run modes with their exit codes: ``python -m inkwell convert|next|seed``. What a run ends with is rotation.STATUS."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import feed, xhtml
from inkwell.operators.rotation import STATUS
from inkwell.session import session
from inkwell.sources import commits, readers, sinks
from inkwell.streaming.feed import STATE


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="inkwell", description=__doc__)
    modes = parser.add_subparsers(dest="mode", required=True)
    convert = modes.add_parser("convert", help="all files of a folder to packages: a table (doc_id, title, status, problems, epub)")
    convert.add_argument("source")
    convert.add_argument("target")
    for name in ("title", "author", "subtitle"):
        convert.add_argument(f"--{name}")
    following = modes.add_parser("next", help="the oldest item of a feed that has not been delivered: its document, then its mark")
    following.add_argument("feed")
    following.add_argument("state")
    following.add_argument("target")
    following.add_argument("--max-sends", type=int, default=feed.MAX_SENDS)
    seeded = modes.add_parser("seed", help="marks all items of a feed but the newest as delivered")
    seeded.add_argument("feed")
    seeded.add_argument("state")
    seeded.add_argument("--leave-newest", type=int, default=0)
    for mode in (convert, following):
        mode.add_argument("--dry-run", action="store_true", help="nothing is written")
    return parser


def convert(spark: SparkSession, args: argparse.Namespace) -> int:
    """3 where a diagram of any file would not be drawn: that file gets no package, the others do. 10 without a file."""
    files = readers.files(spark, args.source).where("format IN ('md', 'html', 'txt')")
    raw = files.select(F.xxhash64("path").alias("doc_id"), "format", "text", F.lit(args.title).cast("string").alias("title"), "stem", F.lit(args.author).cast("string").alias("author"), F.lit(args.subtitle).cast("string").alias("subtitle"))
    found = xhtml.converted(raw)
    if args.dry_run:
        worst = found.agg(F.max("status")).first()[0]
    else:
        found.write.parquet(args.target)
        worst = spark.read.parquet(args.target).agg(F.max("status")).first()[0]
    return STATUS["nothing"] if worst is None else STATUS["diagrams"] if worst else STATUS["done"]


def _documents(items: DataFrame) -> DataFrame:
    """(slug, text): each item's document."""
    named = items.withColumn("names", feed.names(F.col("title")))
    made = feed.document(F.col("names.display"), F.col("image_url"), feed.notes("content_html", "title"), F.col("link"), F.to_date("pub_date"))
    return named.select(F.col("names.slug").alias("slug"), made.alias("text"))


def following(spark: SparkSession, args: argparse.Namespace) -> int:
    """0 where an item was delivered, 10 where none is new, 4 where more than --max-sends are: then none is. The mark comes after the document, so a run that dies between delivers again."""
    items = readers.feed(spark, args.feed)
    known = commits.rows(spark, args.state, ["guid"], STATE)
    found = feed.next_delivery(items, known, args.max_sends).first()
    if found.status == feed.DELIVERED and not args.dry_run:
        sinks.write_texts(_documents(items.where(F.col("guid") == found.guid)), args.target)
        mark = spark.createDataFrame([(found.guid,)], "guid string").select("guid", F.lit("sent").alias("how"), F.current_timestamp().alias("at"))
        commits.change(mark, args.state, ["guid"])
    return found.status


def seed(spark: SparkSession, args: argparse.Namespace) -> int:
    items = readers.feed(spark, args.feed)
    known = commits.rows(spark, args.state, ["guid"], STATE)
    marked = feed.seeded(items, known, args.leave_newest, F.current_timestamp())
    commits.change(marked.join(known.select("guid"), "guid", "left_anti").select("guid", "how", "at"), args.state, ["guid"])
    return STATUS["done"]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _arguments().parse_args(argv)
    run = {"convert": convert, "next": following, "seed": seed}[args.mode]
    try:
        return run(spark or session(), args)
    except Exception as e:  # told by its class alone: a message may hold what it was given
        print(f"error: {type(e).__name__}")
        return STATUS["failure"]
