"""Toxicity by weak supervision.

Many voters look at a text: words of a lexicon, patterns (word beginnings) mined from labelled training texts,
the shape of the text, and the absence of all of these. A generative label model estimates by EM, without
the labels, how often each voter fires in either class, and how far voters depend on each other beyond the
class; dependent voters share their weight. A linear classifier over hashed word beginnings is then trained on the
model's posterior labels, and scores every whole text.

Defined cases: null and empty texts score what the bias alone gives; labels of repeated documents: toxic if
any says so, null labels are left out; without labelled training rows the lexicon alone votes; ties of hashes go
by document; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table

# Words that insult or degrade; each is a voter.
LEXICON = (
    "awful bastard bitch clown creep crap cretin damn degenerate dirtbag disgusting dumb dumbass filth filthy fool freak garbage hate idiot "
    "imbecile jerk kill loser lousy lunatic moron nasty pathetic pig psycho puke rat rotten scum scumbag shit slime sleazy stupid suck thug "
    "trash ugly vermin vile whore worthless wretch"
).split()

#: Bound of the training sample: labelled rows that the models are fitted to, of the lowest hash.
FIT_ROWS = 12_000
#: Lengths of the word beginnings that patterns are mined from.
HEADS = (3, 4, 5, 6, 8)
#: Patterns kept: seen in so many documents at least, of which this share is toxic. Their number has no bound but the sample's words.
MIN_SUPPORT, MIN_SHARE = 4, 0.9
#: Voters of the label model: the patterns are dealt to so many groups.
GROUPS = 24
#: Buckets of the classifier's hashed features.
DIM = 1 << 18
WORDS = re.compile(r"[^\W_]+")


def words(text: str | None) -> set[str]:
    return set(WORDS.findall(text.lower())) if text else set()


def heads(word: str) -> list[str]:
    """The whole word, marked, and its beginnings, where something follows."""
    return [f"={word}"] + [f"{word[:n]}-" for n in HEADS if len(word) > n]


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % DIM


def shape(text: str | None) -> list[bool]:
    """Voters of form: shouting, strings of marks, and a word that repeats at once."""
    t = text or ""
    letters = sum(map(str.isalpha, t))
    return [letters >= 20 and sum(map(str.isupper, t)) > 0.5 * letters, "!!!" in t or "?!" in t, re.search(r"\b(\w{3,}) \1\b", t) is not None]


def sample(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> list[tuple[str, tuple, int]]:
    """(distinct words, shape votes, toxic) of at most about ``fit_rows`` labelled training rows, those under a hash threshold from their count."""
    own = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    own = own.where(~held_out(F.col("doc_id")))
    n = own.count()
    if not n:
        return []
    place = F.pmod(F.xxhash64("doc_id", F.lit("toxic-sample")), F.lit(1 << 30)) / float(1 << 30)
    picked = own.where(place < min(1.0, fit_rows / n))

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            # words only, each once: what the driver gets does not grow with a text's length beyond its vocabulary
            yield pd.DataFrame({"doc_id": b["doc_id"], "bag": [" ".join(sorted(words(t))) for t in b["text"]], "shape": [shape(t) for t in b["text"]], "toxic": b["toxic"]})

    found = docs.select("doc_id", "text").where("text is not null").join(picked, "doc_id").select("doc_id", "text", "toxic")
    found = found.mapInPandas(bags, f"doc_id {dict(docs.dtypes)['doc_id']}, bag string, shape array<boolean>, toxic int")
    # an id has one label and gives one row, whatever the number of its texts
    rows = found.groupBy("doc_id").agg(F.min(F.struct("bag", "shape", "toxic")).alias("r")).collect()
    return [(r["r"]["bag"], tuple(r["r"]["shape"]), int(r["r"]["toxic"])) for r in sorted(rows, key=lambda r: r["doc_id"])]


def signature(bag: set[str]) -> int:
    """Equal for most copies of a text: the sum of the three lowest word hashes."""
    return sum(sorted(zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in bag)[:3])


def mine(rows: Iterable[tuple[set[str], int]], min_support: int = MIN_SUPPORT, min_share: float = MIN_SHARE) -> dict[str, float]:
    """Patterns with their smoothed share of toxic documents; copies of a text support a pattern once."""
    texts = {(signature(bag), y): bag for bag, y in rows}
    all_, toxic = Counter(), Counter()
    for (_, y), bag in texts.items():
        found = {h for w in bag for h in heads(w)}
        all_.update(found)
        if y:
            toxic.update(found)
    return {f: (t + 0.5) / (all_[f] + 1) for f, t in sorted(toxic.items()) if all_[f] >= min_support and t >= min_share * all_[f]}


def group_of(pattern: str) -> int:
    return zlib.crc32(pattern[:3].encode("utf-8", "surrogatepass")) % GROUPS


def votes(bags: list[set[str]], shapes: list[tuple], patterns: dict[str, float]) -> np.ndarray:
    """int8 (rows, voters): 1 toxic, -1 clean, 0 no opinion."""
    lexicon = {w: i for i, w in enumerate(LEXICON)}
    out = np.zeros((len(bags), len(lexicon) + GROUPS + 3 + 2), dtype=np.int8)
    at = len(lexicon)
    for i, (bag, form) in enumerate(zip(bags, shapes)):
        for w in bag & lexicon.keys():
            out[i, lexicon[w]] = 1
        hit = {f for w in bag for f in heads(w) if f in patterns}
        for f in hit:
            out[i, at + group_of(f)] = 1
        out[i, at + GROUPS : at + GROUPS + 3] = form
        lone = not (bag & lexicon.keys())
        out[i, -2] = -1 if lone else 0
        out[i, -1] = -1 if not hit else 0
    return out


def label_model(v: np.ndarray, prior: float = 0.1, rounds: int = 30) -> tuple[np.ndarray, dict]:
    """Posterior of the class toxic for each row, and the estimated parameters.

    Each voter has a chance of each of its two votes under either class; no vote is no evidence. EM starts from the
    balance of the votes. After half of the rounds the voters' residual correlation given the posterior is measured;
    from then on the evidence of a vote is divided by one plus its positive correlations with the other votes for the
    same class on the row (a composite likelihood), so that voters that say the same thing count about once.
    """
    used = np.flatnonzero((v != 0).sum(0) >= 2)
    if not len(used):
        return np.full(len(v), prior), {"used": used, "prior": prior}
    x = v[:, used]
    no, yes = (x == -1).astype(np.float64), (x == 1).astype(np.float64)
    fired = no + yes
    q = np.where(yes.sum(1) * 2 > no.sum(1), 0.95, 0.05)
    corr, weight = np.eye(len(used)), np.ones_like(fired)
    pi = prior
    for r in range(rounds):
        pi = float(np.clip(q.mean(), 0.005, 0.5))
        on = [(s.T @ q + 0.02) / (q.sum() + 0.06) for s in (no, yes)]
        off = [(s.T @ (1 - q) + 0.02) / ((1 - q).sum() + 0.06) for s in (no, yes)]
        if r == rounds // 2:
            rest = fired - np.outer(q, on[0] + on[1]) - np.outer(1 - q, off[0] + off[1])
            scale = np.sqrt((rest * rest).mean(0)) + 1e-9
            corr = (rest.T @ rest) / len(x) / np.outer(scale, scale)
            np.fill_diagonal(corr, 1)
            side = np.sign(x.sum(0, dtype=np.int64))
            alike = (corr > 0.05) & (side[:, None] == side[None, :]) & ~np.eye(len(used), dtype=bool)
            weight = 1 / (1 + fired @ np.where(alike, corr, 0))
        evidence = ((no * weight) @ np.log(on[0] / off[0])) + ((yes * weight) @ np.log(on[1] / off[1]))
        q = 1 / (1 + np.exp(-np.clip(np.log(pi / (1 - pi)) + evidence, -30, 30)))
    accuracy = on[1] * pi / (on[1] * pi + off[1] * (1 - pi))
    return q, {"used": used, "prior": pi, "accuracy": accuracy, "correlation": corr}


def fit_linear(bags: list[set[str]], q: np.ndarray, features: Iterable[str], rounds: int = 400, rate: float = 0.1, l2: float = 2e-5) -> tuple[np.ndarray, float]:
    """Weights by hash bucket and a bias: logistic regression on the posteriors, by Adam over all rows at a time.

    Only mined patterns and lexicon words are features, so that ordinary words add nothing to a long text's score;
    the rows without any are one row with their number as weight.
    """
    known = set(features)
    rows = [sorted({bucket(f) for word in bag for f in heads(word) if f in known}) for bag in bags]
    full = [i for i, r in enumerate(rows) if r]
    bare = [i for i, r in enumerate(rows) if not r]
    at = np.array([i for i in full for _ in rows[i]], dtype=np.int64)
    place = {i: n for n, i in enumerate(full)}
    at = np.array([place[i] for i in at], dtype=np.int64)
    cols, col = np.unique(np.array([c for i in full for c in rows[i]], dtype=np.int64), return_inverse=True)
    y = np.append(q[full], q[bare].mean() if bare else 0.02)
    n = np.append(np.ones(len(full)), max(len(bare), 1))
    w = np.append(np.full(len(cols), 1.0), -2.0)
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = np.append(np.bincount(at, w[:-1][col], len(full)), 0.0) + w[-1]
        g = n * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n.sum()
        grad = np.append(np.bincount(col, g[:-1][at], len(cols)) + l2 * w[:-1], g.sum())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad * grad
        w -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-10)
    weights = np.zeros(DIM, dtype=np.float32)
    for f in known:  # what the sample never shows, as a lexicon word, is as toxic as most of them
        weights[bucket(f)] = max(2.0, -w[-1])
    weights[cols] = w[:-1]
    return weights, float(w[-1])


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict:
    rows = sample(docs, labels, fit_rows)
    bags = [set(b.split()) for b, _, _ in rows]
    patterns = mine(zip(bags, (y for _, _, y in rows)))
    prior = sum(y for _, _, y in rows) / len(rows) if rows else 0.1
    q, model = label_model(votes(bags, [s for _, s, _ in rows], patterns), prior=prior)
    known = set(patterns) | {f"={x}" for x in LEXICON}
    w, bias = fit_linear(bags, q, known)
    return {"weights": {f: float(w[bucket(f)]) for f in known}, "bias": bias, "label_model": model, "patterns": patterns}


def score(docs: DataFrame, weights: dict[str, float], bias: float) -> DataFrame:
    """(doc_id, score): of the whole text, the classifier's chance of the class toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        memo: dict[str, tuple[str, ...]] = {}
        for b in batches:
            out = []
            for text in b["text"]:
                hits: set[str] = set()
                for word in words(text):
                    found = memo.get(word)
                    if found is None:
                        if len(memo) > 200_000:
                            memo.clear()
                        memo[word] = found = tuple(f for f in heads(word) if f in known)
                    if found:
                        hits.update(found)
                z = bias + sum(known[f] for f in sorted(hits))
                out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": np.array(out, dtype=float)})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = score(docs, model["weights"], model["bias"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
