"""The page index and paths over it."""

import random
import xml.etree.ElementTree as ET

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leadflow.sources import tree
from leadflow.sources.tree import Page, compiled, page_index


def walked(html):
    found = tree._Nodes()
    found.page(html)
    return found.arrow().to_pylist()[0]


def outline(html):
    """Nested (name, children) of a page; texts in place."""
    page = walked(html)

    def inside(pre, t0, t1):
        out, at = [], t0
        for n in page["nodes"]:
            if n["parent"] == pre:
                out += page["texts"][at : n["t0"]] + [(n["tag"], inside(n["pre"], n["t0"], n["t1"]))]
                at = n["t1"]
        return out + page["texts"][at:t1]

    return inside(0, 0, len(page["texts"]))


def test_elements_texts_and_intervals():
    assert outline("a<div>b<p>c<b>d</b>e</div>f") == ["a", ("div", ["b", ("p", ["c", ("b", ["d"]), "e"])]), "f"]
    assert outline("<p>one<p>two<div>three</div>four") == [("p", ["one"]), ("p", ["two"]), ("div", ["three"]), "four"]
    assert outline("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == [("ul", [("li", ["a"]), ("li", ["b", ("ul", [("li", ["c"])])]), ("li", ["d"])])]
    assert outline("<table><tr><td>1<td>2<tr><td>3</table>") == [("table", [("tr", [("td", ["1"]), ("td", ["2"])]), ("tr", [("td", ["3"])])])]
    assert outline("<div><b>x</div>y</b>z") == [("div", [("b", ["x"])]), "y", "z"]
    assert outline("<td><a href=x>l</td></a></div>m") == [("td", [("a", ["l"])]), "m"]
    assert outline("<br>a<img src=x>b<br/>c") == [("br", []), "a", ("img", []), "b", ("br", []), "c"]
    for node in (page := walked("<a><b>t</b><c><d>u</d></c></a><e>v</e>"))["nodes"]:
        below = [n["pre"] for n in page["nodes"] if node["pre"] < n["pre"] <= node["last"]]
        assert below == sorted(below) and all(page["nodes"][k - 1]["t0"] >= node["t0"] and page["nodes"][k - 1]["t1"] <= node["t1"] for k in below)


def test_raw_text_comments_and_references():
    page = walked("""<!DOCTYPE html><script type="a">if (a < b && c) { "</p>" }</script><title>A &amp; B</title><!-- <p>no</p> -->&lt;x&gt; &copy;<style>p>a{}</STYLE ><p>end &bogus; 1 < 2""")
    assert [n["tag"] for n in page["nodes"]] == ["script", "title", "style", "p"]
    assert page["texts"] == ['if (a < b && c) { "</p>" }', "A & B", "<x> ©", "p>a{}", "end &bogus; 1 < 2"]
    assert outline("<script>never closed <p>") == [("script", ["never closed <p>"])]
    assert outline("a <!-- open comment <p>") == ["a "]
    assert outline("x <b unfinished") == ["x <b unfinished"] and outline("<" * 50_000) == ["<" * 50_000]
    assert outline("") == [] and walked(None) is None


def test_attributes():
    tag = """<A data-x='href="no"' title="a>b" HREF=/bare class='c d' content="Toyota's bid" empty="" alone it's=1 ref="a&amp;b">"""
    assert dict(walked(tag)["nodes"][0]["attrs"]) == {"data-x": 'href="no"', "title": "a>b", "href": "/bare", "class": "c d", "content": "Toyota's bid", "empty": "", "alone": "", "it's": "1", "ref": "a&b"}
    assert dict(walked("<p x=1 x=2/>")["nodes"][0]["attrs"]) == {"x": "2/"} or dict(walked("<p x=1 x=2 />")["nodes"][0]["attrs"]) == {"x": "2"}


def test_paths_that_are_not_supported_are_errors():
    for bad in ("//a[", "//a]", "//a[last()]", "//a/@href/b", "//a[contains(@x)]", "ancestor::a", "//a[@x=]", "", "//a | ", "//a[position() < 3]"):
        with pytest.raises(ValueError):
            compiled(bad)


HTML = """<html lang="en"><body><div id="list"><article class="card big"><h2><a href="/article/1">First</a></h2><time datetime="2026-09-24">24 Sep</time></article>
<article class="card"><h2><a href="/about">About</a></h2></article><article><h3><a href="/article/3"> Third <i>story</i> </a></h3><time>soon</time></article></div>
<ul><li>x</li><li class="hit">y<ul><li>z</li></ul></li></ul><table id="t"><tr><td>A</td><td>B</td><td class="kjTitle x"><a>C</a></td></tr><tr><td>D</td></tr></table></body></html>"""


@pytest.fixture(scope="module")
def ask(spark):
    df = spark.createDataFrame([(HTML,)], "html string").select(page_index("html").alias("page")).checkpoint()
    return lambda *expressions: df.select(*[e.alias(f"c{k}") for k, e in enumerate(expressions)]).first()


@pytest.mark.parametrize("path, wanted", [
    ("//h2/a/@href", ["/article/1", "/about"]), ("//a[contains(@href,'/article/')]", ["First", "Third story"]), ("//article[.//time[@datetime]]//a/@href", ["/article/1"]),
    ("//*[@id='list']/article[2]", ["About"]), ("//article[.//h3]", ["Third story soon"]), ("//h3 | //h2", ["First", "About", "Third story"]),
    ("//*[contains(concat(' ', normalize-space(@class), ' '), ' card ')]//h2", ["First", "About"]), ("//a[starts-with(@href,'/ab')]", ["About"]), ("//a[not(@href)]", ["C"]),
    ("//tr[td[contains(@class,'kjTitle')]]/td[1]", ["A"]), ("//tr/td[2]", ["B"]), ("//td/text()", ["A", "B", "", "D"]), ("//li[text()='z']", ["z"]), ("//li/li", []), ("//ul//li", ["x", "y z", "z"]), ("//ul/li[2]", ["y z"]),
    ("/html/@lang", ["en"]), ("/html/body/ul/li[@class='hit' or @id='q']/text()", ["y"]), ("//article[@class!='card']//a", ["First"]), ("//*[translate(@class,'ABC','abc')='card']//a", ["About"]),
    ("//article[h2 and time]//a", ["First"]), ("//time[normalize-space(.)='soon']", ["soon"]), ("//table[@id='t']//a", ["C"]), ("//div/ul", [])])
def test_paths(ask, path, wanted):
    assert ask(Page.of("page").values(path))[0] == wanted


def test_paths_from_a_node(ask):
    page = Page.of("page")
    each = F.transform(page.select("//article"), lambda n: F.struct(page.value(".//time/@datetime", n).alias("date"), page.value("./h2/a/@href", n).alias("href"), page.value("./@class", n).alias("own")))
    assert [tuple(r) for r in ask(each)[0]] == [("2026-09-24", "/article/1", "card big"), (None, "/about", "card"), (None, None, None)]


def test_nodes_as_a_table(spark):
    pages = spark.createDataFrame([(1, HTML), (2, "<p>only</p>"), (3, None)], "page_id int, html string").select("page_id", page_index("html").alias("page"))
    nodes = tree.node_table(pages).checkpoint()
    below = nodes.alias("a").join(nodes.alias("d"), F.expr("a.page_id = d.page_id AND d.pre > a.pre AND d.pre <= a.last")).filter("a.tag = 'ul' AND d.tag = 'li'")
    assert below.select("d.text").distinct().count() == 3 and nodes.filter("page_id = 3").count() == 0
    assert nodes.filter("page_id = 2").select("tag", "text").collect() == [("p", "only")]


def random_tree(rng, depth=0):
    node = ET.Element(rng.choice(["div", "span", "section", "b"]), {k: rng.choice(["1", "2", "x y"]) for k in rng.sample(["id", "class", "k"], rng.randint(0, 2))})
    if rng.random() < 0.5:
        node.text = rng.choice(["one", "two", "three"])
    for _ in range(rng.randint(0, 3) if depth < 4 else 0):
        child = random_tree(rng, depth + 1)
        child.tail = rng.choice([None, "tail"])
        node.append(child)
    return node


def test_paths_agree_with_another_reader(spark):
    """Random trees; the paths that the standard library can read too."""
    rng = random.Random(4)
    trees = [random_tree(rng) for _ in range(25)]
    paths = [".//div", ".//div/span", ".//*[@id='1']", ".//section[@k]", ".//div//b", ".//span[@class='x y']/div", ".//div[span]", ".//section/*", ".//b[2]", ".//div[1]/span", ".//*[@id]/*[@k]", ".//section//div//span"]
    rows = [(k, "<x>" + ET.tostring(t, encoding="unicode", short_empty_elements=False) + "</x>") for k, t in enumerate(trees)]
    df = spark.createDataFrame(rows, "k int, html string").select("k", page_index("html").alias("page"))
    page = Page.of("page")
    got = {r["k"]: r for r in df.select("k", *[F.transform(page.select(p[1:]), page.text).alias(f"c{i}") for i, p in enumerate(paths)]).collect()}
    for k, t in enumerate(trees):
        holder = ET.Element("x")
        holder.append(t)
        for i, p in enumerate(paths):
            place = {n: j for j, n in enumerate(holder.iter())}
            hits = sorted(set(holder.findall(p)), key=place.get)
            want = [" ".join(" ".join(n.itertext()).split()) for n in hits]
            assert got[k][f"c{i}"] == want, (p, rows[k][1])


def test_an_article_is_read_from_one_walk_of_its_page(spark):
    from leadflow.sources.articles import extract_articles

    pages = spark.createDataFrame([("https://www.example.com/a", HTML)], "url string, html string")
    plan = extract_articles(pages)._jdf.queryExecution().executedPlan().toString()
    evaluated = [line for line in plan.splitlines() if "ArrowEvalPython" in line and "_index_batch(html" in line]
    assert len(evaluated) == 1 and "Exchange" not in plan


def test_a_batch_is_indexed_in_stretches(monkeypatch):
    """a worker holds the nodes of a stretch of pages and not of a batch; nulls, empty and large pages keep their places."""
    pages = [None, "", "<p>a</p>", "<div>" + "<i>x</i>" * 50 + "</div>", None, "<p>b", "<b>" * 40, "plain", None]
    monkeypatch.setattr(tree, "SLICE_BYTES", 100)
    for kind in (pa.string(), pa.large_string()):
        for batch in (pa.array(pages, kind), pa.array(["<p>z</p>", *pages], kind).slice(1), pa.array([None, None], kind), pa.array([], kind)):
            whole = tree._Nodes()
            for html in batch.to_pylist():
                whole.page(html)
            parts = list(tree._index_batch.func(iter([batch])))
            assert pa.concat_arrays(parts).to_pylist() == whole.arrow().to_pylist()
            assert all(sum(len(h or "") for h in batch[at : at + len(part)].to_pylist()) <= 100 or len(part) == 1 for at, part in zip([0, *np.cumsum([len(x) for x in parts])], parts))
    assert len(list(tree._index_batch.func(iter([pa.array(pages)])))) > 2
