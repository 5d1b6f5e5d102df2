"""Registered queries over whole texts and all groups."""

from inkwell.functions import text
from inkwell.operators import hours, series
from inkwell.plans import queries
from pyspark.sql import functions as F


def test_text_keys_of_whole_texts(spark, tmp_path):
    long = "Some Words & <b> " * 40 + "the end>"
    spark.createDataFrame([(1, long), (2, "!!")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.queries()["text_keys"](spark, str(tmp_path)).collect()}
    want = spark.createDataFrame([(long,)], "t string").select(F.md5(text.alnum(F.col("t"))), F.md5(F.lit(long.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")))).first()
    assert (got[1].alnum, got[1].escaped) == tuple(want) and got[1].slug == ("some-words-b-" * 40)[:60] and got[2].slug is None


def test_coverage_by_place(spark):
    days = spark.sql("SELECT DATE'2026-06-01' AS date UNION ALL SELECT DATE'2026-10-25'")
    label = F.explode(F.sequence(hours.day_start(F.col("date")) + F.expr("interval 1 hour"), hours.day_end(F.col("date")), F.expr("interval 1 hour"))).alias("t")
    labels = days.select("date", label).crossJoin(spark.sql("SELECT explode(array(1, 2, null)) AS place")).where("NOT (place <=> 2 AND date = DATE'2026-06-01')")
    labels = labels.select("place", "t", F.lit(60.0).alias("chance"), F.lit(0.0).alias("mm"))
    got = {(r.place, str(r.date)): (r.expected, r.found, r.complete) for r in hours.coverage(labels, days, ["place"]).collect()}
    whole = {(p, d): (n, n, True) for p in (1, 2, None) for d, n in (("2026-06-01", 24), ("2026-10-25", 25))}
    assert got == whole | {(2, "2026-06-01"): (24, 0, False)}


def test_every_nation_against_home(spark):
    sf_dir = "/root/testdata/sf0.01"
    others = {r.n_name for r in queries.table(spark, sf_dir, "nation").where("n_nationkey <> 0").collect()}
    for name in ("latest_common_year", "country_compare"):
        assert {r.other for r in queries.queries()[name](spark, sf_dir).select("other").distinct().collect()} == others


def test_relation_texts_equal_their_sql(spark, tmp_path):
    """Balances of zero of either sign, ties of shares with an exponent, shares of -0, missing figures."""
    import duckdb

    balances = [0.0, -0.0, None, -100.0, -10.0, -1.0, -0.01, 0.01, 100.0, 1001.91, 9999.99]
    prices = [None, 0.0, -5.0, 935.0, 945.0, 985.0, 995.0, 1050.0, 1150.0, 9350.0, 99500.0, 1001.91, 1001.92, 9999.98]
    rows = [(k, c, x) for k, (c, x) in enumerate([(c, x) for c in range(len(balances)) for x in prices] * 3)]
    spark.createDataFrame(list(enumerate(balances)), "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for name in ("customer", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = {r[0]: r for r in con.execute(queries.oracle_sql()["relation_texts"]).fetchall()}
    got = {r.o_orderkey: tuple(r) for r in queries.queries()["relation_texts"](spark, str(tmp_path)).collect()}
    assert len(want) == len(rows) and {k: (got.get(k), v) for k, v in want.items() if got.get(k) != v} == {} and len(got) == len(want)
    assert {v[1] for v in got.values()} >= {"inf× the UK's", "-inf% of the UK's", "-9.4e+02% of the UK's", "-1e+03% of the UK's"}


def test_significant_digits_round_exactly(spark):
    """Half to even by the exact value, also where an exponent is written."""
    import math

    ties = [float(f"{m}5e{p}") for m in range(10, 1000, 3) for p in range(-9, 12)] + [9.95e-5, 1e-120, 99.5, 995.0, 99500.0, 0.0, -0.0]
    values = [w for v in ties for w in (v, -v, math.nextafter(v, 0), math.nextafter(v, math.inf)) if abs(w) > 1e-300 or w == 0]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    for digits in (2, 3):
        got = {r.k: r.t for r in rows.select("k", series.significant(F.col("v"), digits).alias("t")).collect()}
        assert [(v, got[k]) for k, v in enumerate(values) if got[k] != f"{v:.{digits}g}"] == []
