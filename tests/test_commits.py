from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from inkwell.sources import commits
from inkwell.streaming import release

SCHEMA = "k string, n long, how string"


def _table(spark, path, version=None):
    return sorted(tuple(r) for r in commits.rows(spark, path, ["k"], SCHEMA, version).collect())


def _rows(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_changes_removals_and_older_versions(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert _table(spark, path) == [] and commits.current(spark, path).version == 0
    assert commits.change(_rows(spark, ("a", 1, None), ("b", 1, "x")), path, ["k"]) == 1
    assert commits.change(_rows(spark, ("b", 2, None)), path, ["k"]) == 2
    commits.change(_rows(spark, ("a", 9, "gone")).withColumn("_gone", F.lit(True)), path, ["k"])
    assert _table(spark, path) == [("b", 2, None)]
    assert _table(spark, path, 1) == [("a", 1, None), ("b", 1, "x")] and _table(spark, path, 2) == [("a", 1, None), ("b", 2, None)]
    commits.change(_rows(spark), path, ["k"])  # no rows
    assert _table(spark, path) == [("b", 2, None)]


def test_second_writer_conflicts_and_other_keys_do_not(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    commits.change(_rows(spark, ("a", 1, None)), path, ["k"])
    read = commits.current(spark, path).version
    commits.change(_rows(spark, ("a", 2, None)), path, ["k"], read)
    before = sorted(p.name for p in (tmp_path / "t").iterdir())
    with pytest.raises(commits.Conflict):
        commits.change(_rows(spark, ("a", 3, None)), path, ["k"], read)
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == before  # what the loser wrote is gone
    others = [chr(98 + k) for k in range(8)]
    assert commits.change(_rows(spark, *((k, 1, None) for k in others if commits._buckets(_rows(spark, (k, 1, None)), ["k"]) != commits._buckets(_rows(spark, ("a", 1, None)), ["k"]))), path, ["k"], read) == 3
    assert ("a", 2, None) in _table(spark, path)


@pytest.mark.parametrize("linked", [True, False])
def test_a_number_is_taken_once(spark, tmp_path, monkeypatch, linked):
    """By hard links, and by renames that replace nothing."""
    store = commits._Store(spark, f"file://{tmp_path}/s")
    monkeypatch.setattr(commits._Store, "local", linked)
    with ThreadPoolExecutor(1 if not linked else 8) as pool:
        won = [k for k, ok in enumerate(pool.map(lambda k: store.put("_commits/000000000001.json", f"writer {k}"), range(8))) if ok]
    assert len(won) == 1 and store.text("_commits/000000000001.json") == f"writer {won[0]}"


def test_writers_at_once_lose_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/t"

    def add(writer):
        for _ in range(3):
            commits.update(spark, path, ["k"], SCHEMA, lambda old: spark.createDataFrame([(x,) for x in "abc"], "k string").join(old, "k", "left").select("k", (F.coalesce("n", F.lit(0)) + 1).alias("n"), F.lit(f"w{writer}").alias("how")))

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(add, range(3)))
    assert [(k, n) for k, n, _ in _table(spark, path)] == [("a", 9), ("b", 9), ("c", 9)]


def test_numbers_make_a_change_count_once(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    for n in (0, 0, 1, 0):
        commits.change(_rows(spark, ("a", n, None)), path, ["k"], numbers={"stream": n})
    assert commits.current(spark, path).version == 2 and _table(spark, path) == [("a", 1, None)]
    assert commits.compact(spark, path, ["k"], SCHEMA, 1) == 3
    commits.change(_rows(spark, ("a", 7, None)), path, ["k"], numbers={"stream": 1})
    assert _table(spark, path) == [("a", 1, None)]  # the merge keeps the numbers


def test_compaction_beside_changes(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    for n in range(4):
        commits.change(_rows(spark, ("a", n, None), (f"k{n}", n, None)), path, ["k"])
    assert commits.compact(spark, path, ["k"], SCHEMA, 10) is None
    now = commits.current(spark, path)
    want = _table(spark, path)
    # a change that comes between the merge's reading and its commit stays
    made = commits.rows(spark, path, ["k"], SCHEMA, now.version)
    made.withColumn("_gone", F.lit(False)).write.parquet(f"{path}/merge-late")
    commits.change(_rows(spark, ("a", 100, None)), path, ["k"])
    commits._put(commits._Store(spark, path), {"kind": "merge", "folder": "merge-late", "upto": now.version, "buckets": [], "numbers": {}}, None)
    assert _table(spark, path) == sorted([("a", 100, None), *(r for r in want if r[0] != "a")])
    assert len(commits.current(spark, path).changes) == 1
    commits.compact(spark, path, ["k"], SCHEMA, 1)
    gone = commits.vacuum(spark, path, 1)
    assert len(gone) >= 4 and _table(spark, path)[0] == ("a", 100, None)


# feeds as keyed state

ITEM = "feed string, what string, guid string, pub_date timestamp, feed_pos long"


def _simulated(rows, period, most, mark):
    """Tick by tick, over all items at once: times in seconds."""
    out = []
    for feed in sorted({r[0] for r in rows}):
        seen, waiting = set(), []
        for _, what, guid, at, pos in rows:
            if _ == feed and what == "item" and guid not in seen:
                seen.add(guid)
                waiting.append((at, -pos, guid))
        waiting.sort()
        tick = period
        while waiting and tick <= mark:
            due = [w for w in waiting if w[0] < tick]
            if len(due) > most:
                out.append((feed, tick, 4, len(due), None))
                break
            if due:
                out.append((feed, tick, 0, len(due), due[0][2]))
                waiting.remove(due[0])
            tick += period
    return sorted(out, key=str)


def _batches():
    import random

    rng = random.Random(5)
    out = []
    for b in range(4):
        rows = [(rng.choice("abc"), "item", f"g{rng.randrange(60)}", 7200 * b + rng.randrange(0, 7200), rng.randrange(9)) for _ in range(18)]
        rows += [("flood", "item", f"f{b}-{k}", 7200 * b + 100 + k, k) for k in range(5 if b == 1 else 1)]
        out.append(rows)
    out.append([("z", "item", "last", 100_000, 0)])
    # a guid that comes again later is no new item: the first in order counts, so repeats come later
    first, kept = set(), []
    for rows in out:
        kept.append([r for r in sorted(rows, key=lambda r: r[3]) if (r[0], r[2]) not in first and not first.add((r[0], r[2]))])
    return kept


def _files(spark, rows, path):
    import datetime as dt

    spark.createDataFrame([(f, w, g, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), p) for f, w, g, s, p in rows], ITEM).coalesce(1).write.mode("append").parquet(path)


def _released(spark, path):
    import datetime as dt

    return sorted(((r.feed, int((r.tick - dt.datetime(2024, 1, 1)).total_seconds()), r.status, r.unseen, r.guid) for r in spark.read.parquet(path).collect()), key=str)


@pytest.mark.parametrize("how", ["at once", "restarted", "killed"])
def test_releases_however_the_stream_is_cut(spark, tmp_path, how):
    """All in one batch; stopped and started again after each file, with repeats; killed within a batch. The table is that of a simulation."""
    own, source, out, check = release.stateful(spark), str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    batches = _batches()
    stream = lambda: release.released(own.readStream.schema(ITEM).parquet(source), 1800, 3, "10 minutes")
    for k, rows in enumerate(batches):
        again = [] if not k or how == "at once" else [(f, w, g, s, p) for f, w, g, s, p in batches[k - 1] if s > 7200 * k - 300]
        _files(spark, rows + again, source)
        if how != "at once":
            query = release.write(stream(), out, check)
            if how == "killed" and k == 2:
                import time

                time.sleep(1.5)
                query.stop()  # wherever it is
            else:
                query.awaitTermination()
    release.write(stream(), out, check).awaitTermination()
    want = _simulated([r for b in batches for r in b], 1800, 3, 100_000 - 600)
    got = _released(spark, out)
    assert got == want and any(r[2] == 4 for r in got) and len(got) > 20


def test_seeding_ends_a_flood(spark, tmp_path):
    own, source, out, check = release.stateful(spark), str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    for rows in ([("a", "item", f"g{k}", k, 0) for k in range(6)] + [("a", "item", "n0", 4000, 0)], [("a", "seed", None, 8000, 0)], [("a", "item", "g1", 9000, 0), ("a", "item", "n1", 9100, 0), ("z", "item", "x", 90_000, 0)]):
        _files(spark, rows, source)
        release.write(release.released(own.readStream.schema(ITEM).parquet(source), 1800, 3, "1 minute"), out, check).awaitTermination()
    assert [r for r in _released(spark, out) if r[0] == "a"] == [("a", 10_800, 0, 1, "n1"), ("a", 1800, 4, 6, None)]
