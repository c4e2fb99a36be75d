"""Cycles, repeated ids, relative links, empty tables, and the operators' SQL on tables made by hand."""

import math
import random

import pytest

from quillgraph.llm import chat, common, language_id, mixing, stages, telephony, toxicity, url_filters, warc

from .test_llm import empty_documents, odd_documents

MESSAGES = "tree string, node long, parent long, role string, text string, score double"
PAGES = "page_id long, url string, html string"


def test_a_leaf_below_a_cycle_gives_no_path(spark):
    m = [("t", 1, 3, "user", "a", 0.0), ("t", 2, 1, "user", "b", 0.0), ("t", 3, 2, "user", "c", 0.0), ("t", 4, 3, "assistant", "d", 0.0), ("t", 5, 4, "user", "e", 0.0)]
    m += [("t", 10, None, "user", "q", 0.0), ("t", 11, 10, "assistant", "r", None), ("s", 1, 1, "user", "own parent", 0.0)]
    # a node that comes twice stays once, a null node goes
    m += [("t", 11, 10, "assistant", "r", None), ("t", 11, 10, "assistant", "z", 5.0), ("t", None, 10, "user", "x", 0.0), (None, 1, None, None, None, 0.0)]
    rows = chat.branches(spark.createDataFrame(m, MESSAGES)).collect()
    got = {(r["tree"], r["leaf"]): [(t["role"], t["text"]) for t in r["turns"]] for r in rows}
    assert got == {("t", 11): [("user", "q"), ("assistant", "r")], (None, 1): [("unknown", "")]} and len(rows) == 2


def test_long_chains_and_ties_of_branches(spark):
    m = [("c", i, i - 1 if i else None, "user", str(i), 0.0) for i in range(65)] + [("c", 100 + k, 0, "user", f"k{k}", 0.0) for k in range(3)]
    rows = chat.branches(spark.createDataFrame(m, MESSAGES).repartition(3)).collect()
    assert {r["leaf"]: (len(r["turns"]), r["branch"]) for r in rows} == {64: (65, 1), 100: (2, 2), 101: (2, 3), 102: (2, 4)}


def test_the_mix_keeps_rows_of_one_id_apart(spark):
    docs = [(1, "a b c", "en", "s", 5), (1, "d e f g", "en", "s", 7), (2, "x y", None, None, None), (3, None, "de", "s", None), (4, "", "de", "s", 0)]
    out = stages.mixture(spark, spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()
    texts = [r["text"] for r in out]
    assert len(texts) == len(set(texts)) and set(texts) <= {"a b c", "d e f g", "x y"}
    assert all(r["size"] == len(r["text"].split()) and r["taken"] == r["copies"] * r["size"] for r in out)
    both = {r["text"]: r["copies"] for r in out if r["doc_id"] == 1}
    assert len(set(both.values())) <= 1 and len(both) in (0, 2)


def duck(**tables):
    c = pytest.importorskip("duckdb").connect()
    for name, frame in tables.items():
        c.register(name, frame.toPandas())
    return c


def same(got, want):
    plain = lambda v: None if v is None or v != v else v
    key = lambda rows: sorted((tuple(plain(x) for x in r) for r in rows), key=repr)
    return key(got) == key(want)


def test_links_by_sql(spark):
    base = "http://a.example.net/d/e/f.html"
    links = ["../g", "./h?x", "?q", "i//j", "/k", "//B.net/l", "https://c.example.com/de/1#z", "mailto:a@b", "", "../../../../m/..", "n/../o/."]
    pages = [(i, f"{base}{i}", f'<p><link rel="x canonical" href="{x}"><meta http-equiv=refresh content="3; url={x}">') for i, x in enumerate(links)]
    pages += [(50, "http://a.example.net/d/g", '<link href="http://example.org/es/1" rel=canonical>'), (51, "http://a.example.net/k", "<LINK REL=canonical HREF=/ok>"), (52, "http://a\nb.net/x", '<link rel=canonical href="y">'), (53, "http://a\nb.net/y", '<link rel=canonical href="http://example.org/es/2">'), (54, None, None), (55, "no", "<link rel=canonical href=/z>")]
    df = spark.createDataFrame([(*p, "h") for p in pages], PAGES + ", host string")
    got = url_filters.judge(df.select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict").collect()
    want = duck(pages=df).execute(url_filters.OP8_SQL).fetchall()
    assert same(got, want)
    verdicts = {r["page_id"]: r["verdict"] for r in got}
    assert verdicts[0] == "block" and verdicts[52] == "block" and verdicts[4] == "allow"


def test_redirects_carry_decisions(spark):
    pages = spark.createDataFrame([(1, "http://old.net/a?x=1#top", None), (5, "http://old.net/a", None), (2, "http://mid.net/b", None), (3, "http://example.org/es/new", None), (4, "http://else.net/", None)], PAGES)
    redirects = spark.createDataFrame([("http://old.net/a?x=1", "http://mid.net/b"), ("http://mid.net/b", "http://example.org/es/new"), (None, "http://else.net/"), ("http://else.net/", None)], "from_url string, to_url string")
    got = {r["page_id"]: r["verdict"] for r in url_filters.judge(pages, redirects=redirects).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow"}  # another query string is another url
    allowed = redirects.union(spark.createDataFrame([("http://old.net/a?x=1", "http://www.org/")], "from_url string, to_url string"))
    got = {r["page_id"]: r["verdict"] for r in url_filters.judge(pages, redirects=allowed).collect()}
    assert got == {1: "allow", 2: "allow", 3: "block", 4: "allow", 5: "allow"}


def test_archive_by_sql(spark):
    big = "é" * 600
    pages = [(1, "u", big), (2, "u", big), (2, "v", big), (3, None, None), (None, "u", big), (4, "u", "x" * 999), (5, "u", "x" * 999), (6, "u", "x" * 1000), (None, None, None)]
    df = spark.createDataFrame(pages, PAGES)
    path = common.new_path(spark, "warc-test")
    head, stored = warc.store(df)
    warc.write_archives(warc.records(head, stored), path)
    want = duck(pages=df).execute(warc.OP4_SQL).fetchall()
    assert same(warc.resolved(warc.read_archives(spark, path)).collect(), want)


def test_long_texts_teach_a_language_by_all_of_their_parts(spark):
    rng = random.Random(5)
    words = {k: ["".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(150)] for k, letters in (("aa", "abcdefghij"), ("bb", "klmnopqrst"))}
    text = lambda k, n: " ".join(rng.choices(words[k], k=n))
    other = {"aa": "bb", "bb": "aa"}
    # every training text opens with a long passage in the other language
    docs = [(i, text(other[k], 700) + "\n" + text(k, 3000), k) for i, k in enumerate(["aa", "bb"] * 20)]
    docs += [(7, t, "bb") for t in ("twice", "thrice")]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    learned = language_id.train(d)
    probe = [(100 + i, text(k, 60), k) for i, k in enumerate(["aa", "bb"] * 10)]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.classify(spark.createDataFrame(probe, "doc_id long, text string, lang string"), learned).collect()}
    assert got == {i: k for i, _, k in probe}
    assert language_id.train(d.repartition(5)) == learned


def test_an_id_gives_one_row_to_the_sample(spark):
    docs = spark.createDataFrame([(3, f"t{i} awful", "x") for i in range(50)] + [(4, None, "x"), (1, "fine", "x")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, 1), (1, None), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.sample(docs, labels)
    assert [y for _, _, y in rows] == [1] * len(rows) and len(rows) <= 1


def test_empty_tables(spark):
    none = empty_documents(spark)
    assert toxicity.score(none, {}, 0.0).count() == 0 == language_id.classify(none, {}).count() == mixing.mix(none).count()
    assert telephony.analyse(telephony.encode_column(none.selectExpr("doc_id", "key as n_bytes", "cast(text as binary) as payload"))).count() == 0
    assert url_filters.judge(spark.createDataFrame([], PAGES)).count() == 0
    assert chat.branches(spark.createDataFrame([], MESSAGES)).count() == 0
    for stage in (stages.language, stages.near_duplicates, stages.repeats, stages.benchmark_leaks, stages.mixture):
        assert stage(spark, none, "/root/testdata/sf0.001").count() == 0


def test_clashing_columns_and_long_texts(spark):
    odd = odd_documents(spark)
    rows = mixing.mix(odd.withColumn("limit", odd["key"]).withColumn("target", odd["key"])).collect()
    assert len(rows) == 10 and all(r["taken"] <= 2 * r["size"] for r in rows) and max(r["size"] for r in rows) == 20_001
    found = language_id.classify(odd, {"en": b"a b c", "de": b"x y z"}).collect()
    assert len(found) == 10 and sum(r["lang_pred"] == "und" for r in found) == 4
    long = "w " * 200_000
    m = chat.branches(spark.createDataFrame([("t", 1, None, "assistant", long, 0.0)], MESSAGES))
    back = chat.parsed(chat.formatted(m)).first()
    assert back["loss_texts"] == [long] and math.isclose(len(back["formatted"]), len(long), rel_tol=0.01)


def test_a_query_string_makes_another_url(spark):
    link = '<link rel=canonical href="{}">'.format
    pages = [(1, "http://shop.net/view?id=1", link("http://example.org/es/1")), (2, "http://shop.net/view?id=2", "x"), (3, "http://shop.net/view", None), (4, "http://shop.net/view?id=1#top", "y"), (5, "http://a.net/p?q=1", link("#x")), (6, "http://a.net/other", link("?q=1")), (7, "http://a.net/other?q=1", link("http://example.org/es/2"))]
    df = spark.createDataFrame(pages, PAGES)
    got = {r["page_id"]: r["verdict"] for r in url_filters.judge(df).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow", 4: "block", 5: "allow", 6: "block", 7: "block"}
    c = duck(pages=df)
    assert {r[0]: r[4] for r in c.execute(url_filters.OP8_SQL).fetchall()} == got
