"""Language identification by compression.

Each language has a raw-content zstandard dictionary: text of training documents, bounded in bytes. A text
is cut into pieces, every piece is compressed with each dictionary, and the language whose dictionary gives
the fewest bytes in all wins. Where the runner-up is within ``min_margin`` of it, the decision is rejected.

Defined cases: null texts and texts without a letter are ``und`` with score 0, rejected; ties go to the first
language in order; a long text is compressed whole, piece by piece; training rows without a language are
skipped; without training rows every text is ``und``; repeated rows give repeated results; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table

#: Bound of the training sample: bytes of a language's dictionary, from at most this many documents of about average size.
DICT_BYTES = 112 << 10
SAMPLE_DOCS = 160
#: Characters of a piece; short enough that a text's own history doesn't outweigh the dictionary.
PIECE = 2000
LEVEL = 9
#: Pieces that a long training text gives.
PIECES = 4
#: Characters of a training line at most: what is judged when the sample is cleaned.
LINE = 400
#: Share of the compressed size by which the best must beat the second; below it, the decision is rejected.
MIN_MARGIN = 0.003
LETTER = r"\p{L}"


def train(docs: DataFrame, dict_bytes: int = DICT_BYTES, sample_docs: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """Dictionary content of each language from the training documents (``held_out`` false).

    A sample bounded by ``sample_docs`` documents a language: those of the lowest hash, by a threshold
    from the counts, so that nothing is sorted; one text for each id. A long text gives PIECES pieces, one of each part of
    it, from offsets that its id's hash sets. Copies in the sample count once.
    """
    d = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, sample_docs / n))])
    place = F.pmod(F.xxhash64("doc_id", F.lit("lang-sample")), F.lit(1 << 30)) / float(1 << 30)
    # the longest texts would fill a dictionary alone: a document gives its share of it at most
    most = max(256, 4 * dict_bytes // sample_docs)
    part, size = F.length("text") / PIECES, most // PIECES

    def piece(k: int) -> Column:
        at = F.floor(part * k + F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(1 << 20)) / float(1 << 20) * (part - size))
        return F.substr("text", (at + 1).cast("int"), F.lit(size))

    text = F.when(F.length("text") <= most, F.col("text")).otherwise(F.concat_ws("\n", *[piece(k) for k in range(PIECES)]))
    some = d.where(place < F.element_at(share, F.col("lang"))).select("lang", "doc_id", text.alias("text"))
    rows = some.groupBy("lang", "doc_id").agg(F.min("text").alias("text")).collect()
    lines: dict[str, list[list[str]]] = {}
    for lang in sorted(counts):
        texts = list(dict.fromkeys(r["text"] for r in sorted((r for r in rows if r["lang"] == lang), key=lambda r: r["doc_id"] or 0)))
        lines[lang] = [[x[i : i + LINE] for t in texts[k::2] for x in t.split("\n") for i in range(0, len(x), LINE)] for k in (0, 1)]
    lines = {k: v for k, v in lines.items() if any(x.strip() for half in v for x in half)}
    return {k: content(v, dict_bytes) for k, v in cleaned(lines, dict_bytes).items()}


def content(halves: list[list[str]], dict_bytes: int) -> bytes:
    """Each half's distinct lines, to its share of the bytes; what one half leaves free the other takes."""
    texts = ["\n".join(dict.fromkeys(x for x in half if x.strip())).encode("utf-8", "surrogatepass") for half in halves]
    room = dict_bytes
    out = []
    for n, t in sorted(enumerate(texts), key=lambda x: len(x[1])):
        out.append((n, t[: room // (len(texts) - len(out))]))
        room -= len(out[-1][1])
    return b"\n".join(t for _, t in sorted(out) if t)[:dict_bytes]


def compressors(contents: list[bytes], level: int = LEVEL) -> list[zstandard.ZstdCompressor]:
    made = []
    for c in contents:
        ready = zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        ready.precompute_compress(level=level)
        made.append(zstandard.ZstdCompressor(dict_data=ready, write_content_size=False, write_checksum=False, write_dict_id=False))
    return made


def cleaned(lines: dict[str, list[list[str]]], dict_bytes: int) -> dict[str, list[list[str]]]:
    """Without the lines that another language's half of the sample explains better: texts quote other languages.

    Each half is judged by the other, so that no line vouches for itself. A language keeps its lines where
    none would be left.
    """
    kept = lines
    for _ in range(2):
        new: dict[str, list[list[str]]] = {k: [[], []] for k in lines}
        for half in (0, 1):
            judges = compressors([content([kept[k][1 - half]], dict_bytes) or b" " for k in lines])
            for n, k in enumerate(lines):
                for x in lines[k][half]:
                    sizes = [len(c.compress(x.encode("utf-8", "surrogatepass"))) for c in judges]
                    if sizes[n] == min(sizes):
                        new[k][half].append(x)
        kept = {k: new[k] if any(new[k]) else lines[k] for k in lines}
    return kept


def classify(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN, piece: int = PIECE, level: int = LEVEL) -> DataFrame:
    """(doc_id, lang_pred, score, margin, rejected) of every document.

    score is 1 for a margin of 0.1 or more and falls linearly to 0.5 for a tie of the two best.
    """
    langs = sorted(dictionaries)
    shared = docs.sparkSession.sparkContext.broadcast([dictionaries[k] for k in langs])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = compressors(shared.value, level)
        for b in batches:
            pred, score, margin = [], [], []
            for text, letters in zip(b["text"], b["letters"]):
                if not letters or not made:
                    pred.append("und"), score.append(0.0), margin.append(0.0)
                    continue
                pieces = [text[i : i + piece].encode("utf-8", "surrogatepass") for i in range(0, len(text), piece)]
                sizes = np.array([sum(len(c.compress(p)) for p in pieces) for c in made], dtype=float)
                order = np.argsort(sizes, kind="stable")
                gap = (sizes[order[1]] - sizes[order[0]]) / sizes[order[1]] if len(made) > 1 else 1.0
                pred.append(langs[order[0]]), score.append(0.5 + min(gap, 0.1) * 5), margin.append(gap)
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang_pred": pred, "score": score, "margin": margin, "rejected": [p == "und" or m < min_margin for p, m in zip(pred, margin)]})

    # the letters are looked for in the JVM; a text without one isn't sent
    letters = F.coalesce(F.col("text").rlike(LETTER), F.lit(False))
    d = docs.select("doc_id", F.when(letters, F.col("text")).alias("text"), letters.alias("letters"))
    return d.mapInPandas(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double, margin double, rejected boolean")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = classify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected")
