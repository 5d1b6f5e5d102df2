from inkwell.cli import main
from inkwell.sources import commits, sinks
from inkwell.streaming.feed import STATE


def test_convert(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a_b.md").write_text("# One\ntext\n")
    (source / "c.txt").write_text("plain")
    run = lambda *more: main(["convert", f"file://{source}", f"file://{tmp_path}/{len(more)}", *more], spark)
    assert run("--author", "Ann") == 0
    assert sorted(r.title for r in spark.read.parquet(f"{tmp_path}/2").where("epub IS NOT NULL").collect()) == ["One", "c"]
    (source / "bad.md").write_text("# D\n```mermaid\npie\n```\n")
    assert run("--dry-run") == 3 and not (tmp_path / "1").exists()
    assert run("--title", "T", "--subtitle", "S") == 3
    got = {r.status: r for r in spark.read.parquet(f"{tmp_path}/4").collect()}
    assert got[3].epub is None and got[3].problems and got[0].epub is not None
    assert run("--title", "T", "--subtitle", "S") == 1  # the target is there
    (source / "x.docx").write_text("?")
    assert run("--dry-run") == 1  # an unknown kind of file
    empty = tmp_path / "none"
    empty.mkdir()
    (empty / "i.png").write_bytes(b"\x89PNG")
    assert main(["convert", f"file://{empty}", f"file://{tmp_path}/e", "--dry-run"], spark) == 10


def _feed(tmp_path, n):
    items = "".join(f"<item><guid>g{k}</guid><title>Notes {k}</title><link>https://e.org/{k}</link><pubDate>Mon, {k:02d} Jun 2026 10:00:00 GMT</pubDate><description>&lt;p&gt;text {k}&lt;/p&gt;</description></item>" for k in range(n, 0, -1))
    (tmp_path / "feed.xml").write_text(f'<?xml version="1.0"?><rss><channel><title>C</title>{items}</channel></rss>')
    return f"file://{tmp_path}/feed.xml"


def test_feed_runs(spark, tmp_path):
    state, target = f"file://{tmp_path}/state", f"file://{tmp_path}/out"
    path = _feed(tmp_path, 8)
    run = lambda *more: main(["next", path, state, target, *more], spark)
    known = lambda: sorted((r.guid, r.how) for r in commits.rows(spark, state, ["guid"], STATE).collect())
    assert run() == 4 and known() == []  # a flood delivers nothing
    assert main(["seed", path, state, "--leave-newest", "2"], spark) == 0
    assert known() == [(f"g{k}", "seeded") for k in range(1, 7)]
    assert run("--dry-run") == 0 and len(known()) == 6
    assert run() == 0 and ("g7", "sent") in known() and "<p>text 7</p>" in sinks.read_text(spark, target, "item-notes-7")
    assert run() == 0 and ("g8", "sent") in known()
    assert run() == 10
    assert main(["next", f"file://{tmp_path}/nothing.xml", state, target], spark) == 1
