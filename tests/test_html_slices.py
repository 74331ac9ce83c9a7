"""pages become Python strings a few at a time, and a page's tree goes with the page."""

import gc

import pyarrow as pa

from postlens.functions import unicode as U
from postlens.sources import ingest as IN
from postlens.sources.html_posts import extract_from_html


def test_few_values_are_python_strings_at_a_time(monkeypatch):
    monkeypatch.setattr(U, "SLICE", 3)
    held = []
    monkeypatch.setattr(U.pa, "array", lambda values, kind, make=pa.array: held.append(list(values)) or make(held[-1], kind))
    texts = pa.array([None, "", "<p>a</p>", "<b>&eacute;</b>", None, "<script>x</script>y", "z"][:7], pa.string())
    held.clear()
    assert U._in_slices(U._get_text, texts).to_pylist() == [None, "", "a", "é", None, "y", "z"]
    assert [len(h) for h in held] == [3, 3, 1]
    assert U._in_slices(U._get_text, texts.slice(0, 0)).to_pylist() == []


def test_a_page_leaves_no_cycles():
    html = "<html><body><div><article><p>one<br>two</p></div></article><article>three</b></article></body></html>"
    extract_from_html("http://a.example/x", html)
    gc.collect()
    gc.disable()
    try:
        rows = extract_from_html("http://a.example/x", html)
        assert gc.collect() == 0
    finally:
        gc.enable()
    assert [r[3] for r in rows] == ["onetwo", "three"]


def test_pages_of_several_slices(spark, monkeypatch):
    monkeypatch.setattr(IN, "PAGES_AT_ONCE", 2)
    pages = spark.createDataFrame([(i, f"http://a.example/{i}", None if i == 3 else f"<article>t{i}</article>") for i in range(7)],
                                  "page_id long, url string, html string").coalesce(1)
    assert sorted((r["page_id"], r["content"]) for r in IN.extract_posts(pages).collect()) == [(i, f"t{i}") for i in range(7) if i != 3]
    assert IN.extract_posts(pages.where("page_id = 3")).collect() == []
