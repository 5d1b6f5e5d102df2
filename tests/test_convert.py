from inkwell.operators import convert

SOURCE = """---
title: X
---
# One
Intro:
1) a
2) b

```python
x = 1
```
> q1
> q2

| h | i |
|---|---|
| 1 | 2 |
math $x^2$ ✅
# Two
***
end"""


def test_markdown_blocks():
    got = [(b["tag"], b["text"], b["lang"]) for b in convert.markdown_blocks_of("# A #\np1\np2\n- x\n  more\n1. y\n~~~ js\n# no\n~~~\n---\n> q")]
    assert got == [("h1", "A", None), ("p", "p1\np2", None), ("li", "x\nmore", None), ("oli", "y", None), ("pre", "# no", "js"), ("hr", "", None), ("blockquote", "q", None)]
    assert convert.markdown_blocks_of(None) == convert.markdown_blocks_of("") == []


def test_document_to_chapters(spark):
    raw = spark.createDataFrame([(1, "md", SOURCE, None, "a_b"), (2, "html", "<h1>H</h1><p>x</p>", None, "c"), (3, "txt", "only text", None, "d_e")], "doc_id int, format string, text string, title string, stem string")
    docs = convert.documents(raw)
    assert [m.latex for m in docs.where("doc_id = 1").first().math] == ["x^2"]
    found = convert.blocks(docs)
    tags = [r.tag for r in found.where("doc_id = 1").orderBy("pos").collect()]
    assert tags == ["p", "h1", "p", "oli", "oli", "pre", "blockquote", "th", "tr", "p", "h1", "hr", "p"]
    assert {r.doc_id: r.title for r in convert.titles(raw, found).collect()} == {1: "One", 2: "H", 3: "d e"}
    pages = convert.chapter_pages(found, "Start").where("doc_id = 1").orderBy("chapter").collect()
    assert [p.title for p in pages] == ["Start", "One", "Two"] and "[Yes]" in pages[1].xhtml
