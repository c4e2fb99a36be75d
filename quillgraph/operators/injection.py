"""Anchors in HTML: spans around exact text ranges of nodes, put in and taken out."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.dom import MATH, SILENT, VOID, slices

#: Elements in which nothing is anchored.
CLOSED = SILENT | MATH
ANCHOR = "kg-entity"


class Rewriter(HTMLParser):
    """Copies a page; counts, for the innermost element with a data-id, the characters of its own text.

    ``ranges`` maps a node to (start, end, occurrence, entity), which are wrapped; ``drop(attrs)`` tells the
    spans whose tags are left out. An occurrence that crosses inline tags becomes several spans.
    """

    def __init__(self, ranges: dict | None = None, drop=lambda attrs, node: False) -> None:
        super().__init__(convert_charrefs=False)
        self.ranges, self.drop = ranges or {}, drop
        self.out: list[str] = []
        self.open: list[tuple[str, str | None, bool]] = []
        self.at: dict[str, int] = {}
        self.texts: dict[str, list[str]] = {}
        self.dropped = 0

    def node(self) -> str | None:
        return next((n for _, n, _ in reversed(self.open) if n), None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        gone = tag == "span" and self.drop(a, self.node())
        self.dropped += gone
        if not gone:
            self.out.append(self.get_starttag_text())
        if tag not in VOID and not self.get_starttag_text().endswith("/>"):
            self.open.append((tag, a.get("data-id"), gone))

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is None or not self.open[at][2]:
            self.out.append(f"</{tag}>")
        if at is not None:
            del self.open[at:]

    def piece(self, source: str, text: str) -> None:
        node = self.node()
        if node is None or any(t in CLOSED for t, _, _ in self.open):
            self.out.append(source)
            return
        start = self.at.get(node, 0)
        self.at[node] = start + len(text)
        self.texts.setdefault(node, []).append(text)
        done = 0
        for a, b, occurrence, entity in sorted(self.ranges.get(node, ())):
            a, b = max(a - start, done), min(b - start, len(text))
            if a < b:
                cut = (lambda i, j: source[i:j]) if len(source) == len(text) else (lambda i, j: source if (i, j) == (0, len(text)) else "")
                self.out.append(cut(done, a))
                self.out.append(f'<span class="{ANCHOR}" data-entity-id="{entities.escape(entity)}" data-occurrence-id="{entities.escape(occurrence)}">{cut(a, b)}</span>')
                done = b
        self.out.append(source[done:] if len(source) == len(text) else (source if not done else ""))

    def handle_data(self, data: str) -> None:
        self.piece(data, data)

    def handle_entityref(self, name: str) -> None:
        self.piece(f"&{name};", entities.unescape(f"&{name};"))

    def handle_charref(self, name: str) -> None:
        self.piece(f"&#{name};", entities.unescape(f"&#{name};"))

    def handle_comment(self, data: str) -> None:
        self.out.append(f"<!--{data}-->")

    def handle_decl(self, decl: str) -> None:
        self.out.append(f"<!{decl}>")

    def handle_pi(self, data: str) -> None:
        self.out.append(f"<?{data}>")

    def run(self, page: str) -> str:
        self.feed(page)
        self.close()
        return "".join(self.out)


def inject_page(page: str, occurrences: list[tuple]) -> tuple[str, list[tuple[str, str]]]:
    """The page with anchors for (id, entity, node, start, end, text), and what became of each: injected, present,
    missing node, stale or overlapping."""
    plain = Rewriter()
    plain.run(page)
    texts = {n: "".join(t) for n, t in plain.texts.items()}
    present = set(re.findall(r'data-occurrence-id="([^"]*)"', page))
    ranges: dict[str, list] = {}
    told = []
    for key, entity, node, start, end, text in sorted(occurrences, key=lambda o: (o[2] or "", o[3], o[0])):
        if entities.escape(key) in present:
            told.append((key, "present"))
        elif node not in texts:
            told.append((key, "missing node"))
        elif texts[node][start:end] != text:
            told.append((key, "stale"))
        elif any(a < end and start < b for a, b, _, _ in ranges.get(node, ())):
            told.append((key, "overlapping"))
        else:
            ranges.setdefault(node, []).append((start, end, key, entity))
            told.append((key, "injected"))
    return Rewriter(ranges).run(page) if ranges else page, told


def inject(pages: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(paper_id, html, injected, skipped) of pages(paper_id, html) with occurrences(paper_id, id, entity_id, node, start, end, text)."""
    one = F.struct("id", "entity_id", "node", "start", "end", "text")
    per = occurrences.groupBy("paper_id").agg(F.collect_list(one).alias("o"))
    both = pages.select("paper_id", "html").join(per, "paper_id", "left")

    out = f"paper_id {dict(pages.dtypes)['paper_id']}, html string, injected long, skipped long"
    kinds = to_arrow_schema(StructType.fromDDL(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for paper, page, found in zip(*(c.to_pylist() for c in b.columns)):
                new, told = inject_page(page or "", [tuple(o.values()) for o in found or ()])
                n = sum(t == "injected" for _, t in told)
                rows.append((paper, new, n, len(told) - n))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), kinds)], names=kinds.names)

    return both.mapInArrow(run, out)


def remove(pages: DataFrame, entity: str, node: str | None = None) -> DataFrame:
    """(paper_id, html, removed): without the anchors of an entity, in all nodes or in one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for paper, page in zip(b["paper_id"], b["html"]):
                r = Rewriter(drop=lambda a, n: ANCHOR in (a.get("class") or "").split() and a.get("data-entity-id") == entity and node in (None, n))
                rows.append((paper, r.run(page or ""), r.dropped))
            yield pd.DataFrame(rows, columns=["paper_id", "html", "removed"])

    return pages.select("paper_id", "html").mapInPandas(run, f"paper_id {dict(pages.dtypes)['paper_id']}, html string, removed long")


def repair(pages: DataFrame) -> DataFrame:
    """(paper_id, html, repaired): without the anchors that lie inside formulas."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for paper, page in zip(b["paper_id"], b["html"]):
                r = Rewriter()
                r.drop = lambda a, n, r=r: ANCHOR in (a.get("class") or "").split() and any(t in MATH for t, _, _ in r.open)
                rows.append((paper, r.run(page or ""), r.dropped))
            yield pd.DataFrame(rows, columns=["paper_id", "html", "repaired"])

    return pages.select("paper_id", "html").mapInPandas(run, f"paper_id {dict(pages.dtypes)['paper_id']}, html string, repaired long")


class Wrapper(Rewriter):
    """Wraps the first place of each term, without regard to case, in the text outside of formulas and scripts."""

    def __init__(self, terms: list[tuple[str, str]]) -> None:
        super().__init__()
        self.left = {t.lower(): (t, e) for t, e in sorted(terms, key=lambda x: (len(x[0]), x[0])) if t.strip()}
        self.wrapped = 0

    def piece(self, source: str, text: str) -> None:
        if source != text or any(t in CLOSED for t, _, _ in self.open):
            self.out.append(source)
            return
        low = text.lower()
        spans: list[tuple[int, int, str]] = []
        for t in sorted(self.left, key=lambda t: (-len(t), t)):
            a = low.find(t) if len(low) == len(text) else -1
            if a >= 0 and not any(a < z and a + len(t) > y for y, z, _ in spans):
                spans.append((a, a + len(t), self.left.pop(t)[1]))
        done = 0
        for a, z, entity in sorted(spans):
            self.out.append(f'{text[done:a]}<span class="{ANCHOR}" data-entity-id="{entities.escape(entity)}">{text[a:z]}</span>')
            done, self.wrapped = z, self.wrapped + 1
        self.out.append(text[done:])


def wrap_terms(pages: DataFrame, terms: DataFrame) -> DataFrame:
    """(paper_id, html, wrapped): pages with the first place of each of terms(paper_id, term, entity_id) wrapped, longer terms first;
    of terms that differ in case only one is."""
    per = terms.groupBy("paper_id").agg(F.array_sort(F.collect_set(F.struct("term", "entity_id"))).alias("t"))
    both = pages.select("paper_id", "html").join(per, "paper_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for paper, page, t in zip(b["paper_id"], b["html"], b["t"]):
                w = Wrapper([(x["term"], x["entity_id"]) for x in t] if t is not None else [])
                rows.append((paper, w.run(page or ""), w.wrapped))
            yield pd.DataFrame(rows, columns=["paper_id", "html", "wrapped"])

    return both.mapInPandas(run, f"paper_id {dict(pages.dtypes)['paper_id']}, html string, wrapped long")


def intact(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, ok) of tag counts (key, sections, paragraphs, maths) before and after an edit: 5 sections and paragraphs may differ, no math."""
    a = after.select("key", *[F.col(c).alias(f"{c}2") for c in ("sections", "paragraphs", "maths")])
    d = lambda c: F.abs(F.col(c) - F.col(f"{c}2"))
    return before.join(a, "key").select("key", ((d("sections") <= 5) & (d("paragraphs") <= 5) & (d("maths") == 0)).alias("ok"))
