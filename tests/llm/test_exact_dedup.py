import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from inkwell.llm.exact_dedup import drop_copies, exact_groups, maybe_repeated, member_filter, repeated_filter


def test_groups(spark):
    rows = [(k, f"text {k % 90}", "x") for k in range(100)] + [(1000 + k, "hot", "y") for k in range(300)] + [(5, None, None), (6, "", "z"), (None, "n", "a"), (None, "n", "b"), (7, "twice", "c"), (7, "twice", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id string").repartition(5)
    got = exact_groups(docs).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    for r in got:
        own = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        ids = [i for i in own if i is not None]
        assert (r.keep_id, r.group_size) == (max(ids, default=None), len(own))
    assert sum(r.kept for r in got) == len(groups)
    kept = drop_copies(docs).collect()
    assert len(kept) == len(groups)
    assert {(r.text or "") for r in kept} == set(groups)
    assert drop_copies(docs).columns == docs.columns


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_groups(docs).count() == 0
    assert drop_copies(docs).count() == 0


def test_filters_lose_nothing_and_pass_most(spark):
    keys = spark.range(20_000).select(F.when(F.col("id") < 200, F.col("id") % 100).otherwise(F.col("id")).alias("k"))
    bloom, blocks = repeated_filter(keys, F.col("k"), 20_000)
    flags = maybe_repeated(keys, F.col("k"), bloom, blocks, "again").groupBy("again", (F.col("k") < 100).alias("twice")).count().collect()
    count = {(r.again, r.twice): r["count"] for r in flags}
    assert (False, True) not in count and count[True, True] == 200
    assert count.get((True, False), 0) < 600
    bloom, blocks = member_filter(spark.range(50), F.col("id"), 50)
    assert maybe_repeated(spark.range(50), F.col("id"), bloom, blocks, "in").where("in").count() == 50


def test_main_path_is_native(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")
    plan = exact_groups(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan.replace("PandasUDF", "Pandas")


def test_stages_take_any_columns(spark):
    """Map columns, and columns named like those that the operators make for themselves; repeated rows and null ids; an empty table."""
    from inkwell.llm.exact_dedup import drop_copies
    from inkwell.llm.langid import keep_identified, train
    from inkwell.llm.neardup import drop_near_copies
    from inkwell.llm.pii import redact

    words = " ".join(f"alpha{k} beta" for k in range(40))
    schema = "doc_id long, text string, lang string, at string, again int, bits map<string,int>, `of` string, gone string, maybe int, row int, sha string, `a.b` int"
    rows = [(i, t, "en", "x", 1, {"k": i or 0}, "o", "g", 2, 3, "s", 4) for i, t in [(1, words), (2, words), (2, words), (3, words + " more"), (None, None), (4, ""), (5, "mail a.b@c.de " + words[:200])]]
    docs = spark.createDataFrame(rows, schema)
    kept = drop_copies(docs)
    assert kept.schema.simpleString() == docs.schema.simpleString()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(2, words), (3, words + " more"), (4, ""), (5, rows[-1][1])])
    near = drop_near_copies(docs)
    assert near.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in near.collect()) == [0, 1, 4, 5]
    clean = redact(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    assert [r.text for r in clean.where("doc_id = 5").collect()] == ["mail [EMAIL] " + words[:200]] and clean.where("text IS NULL").count() == 1
    found = keep_identified(docs, train(docs))
    assert found.columns == docs.columns and found.where("text IS NULL OR text = ''").count() == 0
    empty = docs.limit(0)
    for stage in (drop_copies, drop_near_copies, redact, lambda d: keep_identified(d, train(docs))):
        assert stage(empty).count() == 0
