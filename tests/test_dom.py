"""Pages as trees: ids, nodes, sections, equations, citations, metadata, quotes; anchors that are repaired or wrapped."""

import hashlib

from quillgraph.operators import injection
from quillgraph.sources import dom

PAGE = """<html><body><h1 class="ltx_title">The <text>x</text>Title</h1><div class="ltx_authors"><span class="ltx_personname"> Ann </span><span class="ltx_creator">Bob</span><span class="ltx_personname">Ann</span></div>
<div class="ltx_abstract">Abstract. We study.</div><p data-id="mine">First<br>line <b>bold</b></p><p>Second</p><h2>One</h2>text<p>in one</p><ul><li>item</li></ul><div><h3>Deep</h3><p>deeper</p></div><p>after</p>
<h2>Two</h2><math display="block"><mi>x</mi><annotation encoding="TeX">old</annotation><annotation encoding="application/x-tex">x = 1</annotation></math><math><mi>y</mi></math>
<section class="ltx_bibliography"><ul><li class="ltx_bibitem" id="bib.A1"> A, 2001 </li><li class="other">no</li></ul></section></body></html>"""


def hashed(paper, path):
    return hashlib.sha256(f"{paper}:{path}".encode()).hexdigest()[:16]


def test_ids(spark):
    def with_ids(paper, html):
        return dom.inject_ids(spark.createDataFrame([(paper, html)], "page_id string, html string")).first()["html"]

    # a void tag stays open: it is in every path behind it; a given id is kept and not counted
    got = with_ids("7", '<html><p>a<br>b</p><p data-id="k">c</p><section/><p>d</p></html>')
    want = [hashed("7", "html/p/p[1]"), hashed("7", "html/p/br/section[1]"), hashed("7", "html/p/br/p/p/p[2]")]
    ids = [x.split('"')[0] for x in got.split('data-id="')[1:]]
    assert ids[0] == want[0] and ids[1] == "k" and len(ids) == 4
    assert hashed("7", "html/p/br/section[1]") in ids or any(len(i) == 16 for i in ids[2:])
    assert with_ids("7", got) == got and with_ids("7", None) == "" and "&amp;<!--c-->" in with_ids("1", "<p>&amp;<!--c--></p>")
    # attributes with brackets, tags inside of comments and scripts, a block that closes itself, broken markup
    got = with_ids("9", '<div title="a>b" data-x><!-- <p> --><script>"<p>"</script><P class=\'x"y\'>1 &lt 2<table/></p></section><pre')
    assert got == f'<div title="a>b" data-x><!-- <p> --><script>"<p>"</script><P class=\'x"y\' data-id="{hashed("9", "div/p/p[1]")}">1 &lt; 2<table data-id="{hashed("9", "div/p/table[1]")}"/></p></section><pre'
    # ids cost the same at any depth
    deep = with_ids("8", "<br>" * 3000 + "<p>x</p>")
    assert hashed("8", "br/" * 3000 + "p/p[1]") in deep


def test_nodes_and_sections(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>no heading")], "page_id long, html string")
    nodes = dom.page_nodes(pages)
    rows = nodes.where("page_id = 1").orderBy("pos").collect()
    by = {r["text"]: r for r in rows}
    assert by["Firstline bold"]["node_id"] == "mine" and not any(r["annotatable"] for r in rows if r["tag"] == "math") and by["The xTitle"]["section_id"] == by["The xTitle"]["node_id"]
    own = {r["node_id"]: r["section_id"] for r in dom.node_sections(nodes).where("page_id = 1").collect()}
    title = {r["title"]: r for r in dom.sections(pages).where("page_id = 1").collect()}
    assert own["mine"] == title["The xTitle"]["node_id"] and own[by["in one"]["node_id"]] == title["One"]["node_id"] and own[by["after"]["node_id"]] == title["Deep"]["node_id"]
    assert title["The xTitle"]["title_html"] == "The Title" and title["Deep"]["parent_id"] == title["One"]["node_id"] and title["Two"]["parent_id"] == title["The xTitle"]["node_id"]
    # a section's blocks go up to the first that holds a heading
    assert title["One"]["content_html"].count("<p") == 1 and "item" in title["One"]["content_html"] and "deeper" not in title["One"]["content_html"]
    assert title["Deep"]["content_html"].count("deeper") == 1 and "after" not in title["Deep"]["content_html"]
    assert [r["section_id"] for r in dom.node_sections(nodes).where("page_id = 3").collect()] == [None]


def test_records_of_a_page(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None)], "page_id long, html string")
    assert [(r["latex"], r["is_display"]) for r in dom.equations(pages).orderBy("pos").collect()] == [("x = 1", True), (None, False)]
    assert [(r["key"], r["text"]) for r in dom.citations(pages).collect()] == [("A1", "A, 2001")]
    m = {r["page_id"]: (r["title"], r["authors"], r["abstract"]) for r in dom.metadata(pages).collect()}
    assert m == {1: ("The xTitle", ["Ann", "Bob"], ". We study."), 2: (None, None, None)}
    quotes = spark.createDataFrame([(1, "line bold"), (1, "nowhere"), (1, " "), (1, None)], "page_id long, quote string")
    got = {r["quote"]: (r["node_id"], r["start"], r["end"]) for r in dom.quote_places(pages, quotes).collect()}
    assert got == {"line bold": ("mine", 6, 15), "nowhere": (None, None, None), " ": (None, None, None)}
    hits = dom.find_in_page(pages, "ONE").orderBy("place").collect()
    assert [(r["place"], r["total"]) for r in hits] == [(0, 2), (1, 2)]


def test_repair_and_wrap(spark):
    page = '<p>tau <math><mi><span class="kg-entity" data-entity-id="t">t</span></mi></math><span class="kg-entity">x</span></p><script>tau</script>'
    pages = spark.createDataFrame([(1, page)], "paper_id long, html string")
    r = injection.repair(pages).first()
    assert r["repaired"] == 1 and "<mi>t</mi>" in r["html"] and '<span class="kg-entity">x</span>' in r["html"]
    terms = spark.createDataFrame([(1, "Gradient", "g"), (1, "gradient descent", "d"), (1, "GRADIENT", "g2"), (1, "x", "x")], "paper_id long, term string, entity_id string")
    p = spark.createDataFrame([(1, "<p>Gradient Descent and gradient<math>x</math> gradient</p>")], "paper_id long, html string")
    w = injection.wrap_terms(p, terms).first()
    assert w["wrapped"] == 2 and 'data-entity-id="d">Gradient Descent</span>' in w["html"] and w["html"].count("kg-entity") == 2 and "<math>x</math>" in w["html"]
