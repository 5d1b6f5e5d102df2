"""URL keys, labels, hosts and publishers."""

from __future__ import annotations

from urllib.parse import parse_qsl, urlencode, urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Hosts of over one in so many rows are hot.
HOT_SHARE = 1000
# Query parameters that only track clicks.
TRACKING = ("gclid", "fbclid", "msclkid", "mc_cid", "mc_eid")


#: Scheme, host with its slashes, path, and query of a URL; the fragment is left out.
WHOLE = r"^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)(?:\?([^#]*))?"
#: A query that is as it would be written anew: no escape, and one = a parameter at most.
SIMPLE_QUERY = r"^(?:[A-Za-z0-9_.~-]*(?:=[A-Za-z0-9_.~-]*)?(?:&|$))*$"


@F.pandas_udf(T.StringType())
def _decoded_query(queries: pd.Series) -> pd.Series:
    """Queries with escapes, parted and written anew; parameters stay in order, blank ones too."""
    return queries.map(lambda q: None if q is None else urlencode(parse_qsl(q, keep_blank_values=True)))


def normalised(url: Column) -> Column:
    """A match key: scheme and host in lower case, no fragment, no tracking parameters. Only a query with escapes needs Python."""
    part = lambda k: F.regexp_extract(F.trim(url), WHOLE, k)
    query = part(4)
    simple = query.rlike(SIMPLE_QUERY)
    plain = F.coalesce(F.when(simple, query), _decoded_query(F.when(~simple, query)))
    own = F.filter(F.split(plain, "&"), lambda p: (p != "") & ~_tracks(F.lower(F.substring_index(p, "=", 1))))
    kept = F.array_join(F.transform(own, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("=")))), "&")
    return F.concat(F.lower(part(1)), F.lower(part(2)), part(3), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def _tracks(name: Column) -> Column:
    return name.startswith("utm_") | name.isin(*TRACKING)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def site(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def label(url: Column) -> Column:
    """Host without www. and path without a final slash, 70 characters at most."""
    place = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    whole = F.concat(place, path)
    return F.when(F.length(whole) <= 70, whole).otherwise(F.concat(F.left(whole, F.lit(67)), F.lit("...")))


def absolute(base: str, link: str) -> str:
    return urljoin(base, link)


def publishers(urls: DataFrame, domains: DataFrame, url_col: str = "url") -> DataFrame:
    """``urls`` with ``publisher``: that of the longest domain the host ends in, at a label's border, else the site.

    The host is cut into its suffixes, so it meets the domains in an equi-join whatever their number.
    """
    known = domains.select(F.col("domain").alias("suffix"), "publisher")
    hosts = urls.select(host(F.col(url_col)).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    best = hosts.select("h", "n", F.explode(suffixes_of(F.col("h"))).alias("suffix")).join(known, "suffix").groupBy("h", "n").agg(F.max_by("publisher", F.length("suffix")).alias("found"))
    named = urls.withColumn("h", host(F.col(url_col)))
    # hosts of over a thousandth of all rows, under a thousand of them, are broadcast: no task gets all rows of a hot host
    hot = best.join(hosts.agg((F.sum("n") / HOT_SHARE).alias("least")), F.lit(True)).where("n > least").select(F.col("h").alias("of"), F.col("found").alias("hot"), F.lit(True).alias("is_hot"))
    first = named.join(F.broadcast(hot), F.col("h") == F.col("of"), "left").drop("of")
    rest = first.where("is_hot IS NULL").join(best.select(F.col("h").alias("of"), "found"), F.col("h") == F.col("of"), "left")
    done = first.where("is_hot").select(*urls.columns, F.col("hot").alias("publisher")).unionByName(rest.select(*urls.columns, F.col("found").alias("publisher")))
    return done.withColumn("publisher", F.coalesce("publisher", site(F.col(url_col))))


def suffixes_of(name: Column) -> Column:
    """A host and what is left of it after each of its dots."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def validated_sources(selected: DataFrame, known: DataFrame, by: list[str], cap: int = 3) -> DataFrame:
    """Of ``selected`` (by, seq, url, supports), those whose key is that of a ``known`` (by, seq, url) one, first of each key, ``cap`` at most; the known URL is returned."""
    first = known.withColumn("key", normalised(F.col("url"))).groupBy(*by, "key").agg(F.min_by("url", "seq").alias("url"))
    found = selected.withColumn("key", normalised(F.col("url"))).drop("url").join(first, [*by, "key"])
    once = found.withColumn("k", F.row_number().over(Window.partitionBy(*by, "key").orderBy("seq"))).where("k = 1")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("seq"))).where(F.col("rank") <= cap).select(*by, "rank", "url", "supports")


def foreign_links(links: DataFrame, allowed: DataFrame) -> DataFrame:
    """Links that are not among the allowed ones: must be empty."""
    return links.join(allowed, ["doc_id", "url"], "left_anti")


def search_actions(calls: DataFrame) -> DataFrame:
    return calls.groupBy(F.coalesce("kind", F.lit("unknown")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
