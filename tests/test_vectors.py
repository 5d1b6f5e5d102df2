"""Fixed vectors: every operator gives what its rule demands; and the conversion from end to end."""

import io
import zipfile

import pytest

from inkwell.operators import xhtml
import vectors


@pytest.mark.parametrize("name", sorted(vectors.GOLDEN))
def test_golden_vectors(spark, name):
    got = {r.name: r.result for r in vectors.frame_of(spark, vectors.GOLDEN[name]).collect()}
    assert got == {n: want for n, _, want in vectors.GOLDEN[name]}


@pytest.mark.parametrize("name", sorted(vectors._WHOLE))
def test_golden_tables(spark, name):
    made, want = vectors._WHOLE[name]
    key = lambda x: (x[0], x[1] or "")
    assert sorted(((r.name, r.result) for r in vectors._union(made(spark)).collect()), key=key) == sorted(want, key=key)


def test_conversion_to_a_package(spark):
    source = "---\ntitle: X\n---\n# One & two\nIntro:\n1) a\n2) b\n\n```python\nx < 1\n```\n\n| h | i |\n|---|---|\n| 1 | **2** |\n\nSee https://e.org/a. ✅Done\n# Last\nend"
    raw = spark.createDataFrame([(1, "md", source, None, "a_V3", "Ann", None), (2, "txt", "only\n\ntext", None, "d_e", "Ann", "Sub")], "doc_id int, format string, text string, title string, stem string, author string, subtitle string")
    got = {r.doc_id: r for r in xhtml.converted(raw).collect()}
    assert (got[1].title, got[1].status, got[2].title) == ("One & two (V3)", 0, "d e")
    book = zipfile.ZipFile(io.BytesIO(bytes(got[1].epub)))
    pages = [book.read(n).decode() for n in sorted(n for n in book.namelist() if "chap_" in n)]
    assert len(pages) == 3 and "<h1>One &amp; two</h1>" in pages[1] and "<ol><li>a</li><li>b</li></ol>" in pages[1]
    assert "<pre><code>x &lt; 1</code></pre>" in pages[1] and "<thead><tr><th>h</th><th>i</th></tr></thead>" in pages[1] and "<td><strong>2</strong></td>" in pages[1]
    assert '<a href="https://e.org/a">https://e.org/a</a>. [Yes] Done' in pages[1] and "<p>end</p>" in pages[2]
    book = zipfile.ZipFile(io.BytesIO(bytes(got[2].epub)))
    assert '<h1>d e</h1>\n<p class="subtitle">Sub</p>\n<p>only</p>' in book.read("OEBPS/chap_01.xhtml").decode()
