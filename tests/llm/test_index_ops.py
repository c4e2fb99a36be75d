"""Byte-level BPE, vector codes and ranked search against plain versions of what they compute."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from quillgraph.llm import byte_bpe as B
from quillgraph.llm import ranked_search as R
from quillgraph.llm import vector_codes as V

from .test_cases import duck, same

ALPHABET = ["a", "b", "'", "re", "ll", "s", " ", "  ", "\n", "\t", "1", "23", "!", "?!", "é", "ñ", "中", "文", "😀", "՘", "\U00032400", " ", "​", "the", "tion", "\r\n", "ação", "<|endoftext|>"]


@pytest.fixture(scope="module")
def ranks():
    return B.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(seed, n):
    r = random.Random(seed)
    out = ["", " ", "\n\n x", "'r", "'re", "a" * 500, "ab" * 300, "!" * 99, "中" * 200]
    for _ in range(n):
        out.append("".join(r.choice(ALPHABET) for _ in range(r.randrange(60))))
        out.append("".join(r.choice("abcde") for _ in range(r.randrange(400))))
        out.append("".join(chr(r.choice([r.randrange(32, 0xD800), r.randrange(0xE000, 0x110000)])) for _ in range(30)))
    return out


def test_joined_halves_are_the_librarys_tokens(ranks, library, monkeypatch):
    # leaves of a few characters: most of the work is done by the joins
    monkeypatch.setattr(B, "TEXT_LEAF", 5), monkeypatch.setattr(B, "PIECE_LEAF", 1), monkeypatch.setattr(B, "SHORT", 40)
    e = B.Encoder(ranks, public_tokenizers.PATTERN, *B.patterns(public_tokenizers.PATTERN))
    for text in odd_texts(3, 600):
        assert e.encode(text) == library.encode_ordinary(text), text


def test_every_cut_of_a_text_gives_its_pieces(ranks):
    e = B.Encoder(ranks, public_tokenizers.PATTERN, *B.patterns(public_tokenizers.PATTERN))
    for text in ["we'll  go\n\n'tis 12 '", "a  'll b", "x'", "'re're  \t y!!'ve", "é12é    中'd"]:
        for cut in range(len(text) + 1):
            assert B.spliced(e.find(text[:cut]), e.find(text[cut:]), e.find) == e.find(text), (text, cut)


def test_every_cut_of_bytes_gives_their_tokens(ranks):
    tokens = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
    for raw in [b"internationalisation", "ação中文".encode(), b"aaaaaaaaaaaaaaaaaaaaa", b"abcabcabcabcabc"]:
        whole = B.merged(raw, ranks)
        assert B.merged_by_heap(raw, ranks) == whole
        for cut in range(len(raw) + 1):
            assert B.fused(B.merged(raw[:cut], ranks), B.merged(raw[cut:], ranks), ranks, tokens) == whole


def test_encoding_and_decoding_columns(spark, ranks, library):
    texts = [*odd_texts(5, 20), None, "long " * 50_000, "x" * 20_000]
    df = spark.createDataFrame([(i % 40, t, f"{i}") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    coded = B.encode(df, ranks, public_tokenizers.PATTERN)
    assert coded.columns == ["doc_id", "ids"]
    got = coded.select("doc_id", "ids", B.decoder(spark, ranks)("ids").alias("raw")).collect()
    key = lambda x: (x[0], x[1])
    assert sorted(((r["doc_id"], r["ids"], bytes(r["raw"])) for r in got), key=key) == sorted(((i % 40, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in enumerate(texts)), key=key)
    assert B.encode(df.limit(0), ranks, public_tokenizers.PATTERN).collect() == []


def test_op11_digests(spark, library, tmp_path):
    texts = [None, "", "we'll see  12 中文", "a" * 3000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in B.op11_byte_bpe(spark, str(tmp_path)).collect():
        text = texts[r["doc_id"]] or ""
        ids = library.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """rows: (vec_id, vector of ints), in order."""
    width = len(rows[0][1]) // parts
    x = [[[int(v) for v in vec[p * width : (p + 1) * width]] for p in range(parts)] for _, vec in rows]
    books = [[x[i][p] for i in range(min(entries, len(rows)))] for p in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = [near(r[p], books[p])[1] for r in x]
            for k in range(len(books[p])):
                mine = [r[p] for r, o in zip(x, own) if o == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    last = [[near(r[p], books[p]) for p in range(parts)] for r in x]
    return [("".join(f"{k:02x}" for _, k in row), sum(d for d, _ in row)) for row in last], books


def vectors(seed, n, length, few=False):
    r = random.Random(seed)
    return [(i, [float(r.randrange(-3, 4)) / 4096 if few else r.gauss(0, 0.01) * (1 + i % 5) for _ in range(length)], i % 3 or None) for i in range(n)]


@pytest.mark.parametrize("few", [True, False])
def test_codes_equal_those_of_all_distances(spark, few):
    rows = vectors(7, 300, 24, few)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    got, books = V.compress(df)
    want, want_books = plain_codes([(i, [math.floor(4096 * v) for v in vec]) for i, vec, _ in rows])
    assert [(r["code"], r["error"]) for r in got.orderBy("vec_id").collect()] == want
    assert books.tolist() == want_books


def test_bounds_leave_out_most_distances_and_lose_no_tie():
    r = np.random.default_rng(5)
    centres = r.integers(-4000, 4000, (16, 8))
    x = centres[r.integers(0, 16, 5000)] + r.integers(-60, 60, (5000, 8))
    book = centres + r.integers(-40, 40, (16, 8))
    book[9] = book[4]  # equal entries: the lower index takes all
    code, upper, lower = V.assigned(x, book)
    assert not (code == 9).any()
    for _ in range(3):
        new = np.array([x[code == e].sum(axis=0) // max(1, (code == e).sum()) if (code == e).any() else book[e] for e in range(16)])
        moved = np.where((new != book).any(axis=1), V.above(V.squares_to(new, book)), 0).astype(float)
        code, upper, lower, took = V.reassigned(x, new, moved, code, upper, lower)
        d2 = ((x[:, None] - new[None]) ** 2).sum(axis=2)
        assert (code == d2.argmin(axis=1)).all() and (upper.astype(float) ** 2 >= d2.min(axis=1)).all() and (lower.astype(float) ** 2 <= d2).all()
        assert took < 0.5 * d2.size
        book = new


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [0.5] * 8, 1), (5, [0.25] * 8, 1), (1, [nan] + [0.0] * 7, 1), (2, [inf] + [0.0] * 7, 2), (3, None, 2), (4, [None] + [0.0] * 7, None), (None, [-0.1] * 8, None), (7, [1.0] * 16, 1), (8, [1.0] * 3, 1), (9, [], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, code string")
    got, books = V.compress(df)
    assert books.shape == (8, 3, 1) and sorted(((r["vec_id"], r["code"], r["error"]) for r in got.collect()), key=repr) == [(5, "00" * 8, 0), (5, "01" * 8, 0), (None, "02" * 8, 0)]
    assert V.compress(df.where("vec_id = 3"))[0].collect() == []
    with pytest.raises(Exception, match="64-bit|ARITHMETIC|OVERFLOW"):
        V.compress(spark.createDataFrame([(1, [1e9] * 8, 1)], "vec_id long, embedding array<double>, label int"))[0].collect()


def test_op12_equals_sql(spark, tmp_path):
    rows = [(i, [float(np.float32(v)) for v in vec], label) for i, vec, label in vectors(11, 90, 16)] + [(1000, None, 1), (-5, [float("nan")] * 16, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duck()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    got = V.op12_vector_codes(spark, str(tmp_path))
    want = c.execute(V.OP12_SQL)
    names = [d[0] for d in want.description]
    assert same([tuple(r) for r in got.select(*names).collect()], want.fetchall())


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs, items, k):
    words = lambda t: TERM.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    bags = [(i, Counter(words(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    for item, terms in asked.items():
        scored = []
        for doc, b in bags:
            m = 50 + (50 * sum(b.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 20 * m)) for t in terms if t in b)
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.mark.parametrize("k,rows", [(1, 200_000), (3, 0), (50, 200_000)])
def test_search_equals_scoring_everything(spark, monkeypatch, k, rows):
    monkeypatch.setattr(R, "SENT_ROWS", rows)  # with 0, all joins are shuffles
    r = random.Random(k)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "été", "中文", "A1", "a1"]
    text = lambda n: " ".join(vocabulary[min(int(r.expovariate(0.08)), len(vocabulary) - 1)] for _ in range(n))
    docs = [(i, text(r.randrange(1, 60))) for i in range(400)] + [(400, None), (401, " ,;\t"), (7, "w1 w50"), (None, "w2 w50 w50"), (402, "w3 " * 5000)]
    docs += [(500 + i, "w1 w2 w40") for i in range(70)]  # ties beyond k
    items = [(i, text(12)) for i in range(15)] + [(20, "nowhere"), (21, None), (3, "w50 w51"), (None, "w40 W1!")]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, term int").repartition(6)
    q = spark.createDataFrame([(*x, 1.0) for x in items], "item_id long, text string, score double")
    got = [tuple(x) for x in R.search(d, q, k).select("item_id", "rank", "doc_id", "score").collect()]
    assert same(got, plain_search(docs, items, k))
    assert len({x[:2] for x in got}) == len(got)


def test_search_of_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id string, text string")
    q = spark.createDataFrame([("i", "a b")], "item_id string, text string")
    assert R.search(d, q).collect() == [] and R.search(q.toDF("doc_id", "text"), d.toDF("item_id", "text")).collect() == []
    assert [tuple(x) for x in R.search(q.toDF("doc_id", "text"), q).collect()] == plain_search([("i", "a b")], [("i", "a b")], 50)
