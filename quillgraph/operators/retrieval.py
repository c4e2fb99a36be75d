"""Lexical and graph-assisted retrieval, and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import written


def term_stats(corpus: DataFrame) -> DataFrame:
    """(token, df, tf) over the passages (id, text)."""
    t = corpus.select("id", F.explode(T.retrieval_tokens(F.col("text"))).alias("token"))
    return t.groupBy("id", "token").agg(F.count(F.lit(1)).alias("n")).groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("tf"))


def passage_scores(corpus: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, id, score) of passages that share a token: tf * (ln((N + 1) / (df + 1)) + 1) for every query token
    as often as it occurs; 1.5 more where the joined query tokens lie in the joined passage tokens.

    Only the questions' tokens are counted: the passages are filtered by a join on tokens before they are
    aggregated. A containing passage shares every token but perhaps the first and the last, which may end or begin a
    longer one; the phrase is looked for in the texts of such pairs alone.
    """
    n = corpus.agg(F.count(F.lit(1)).alias("n"))
    q = questions.select("question_id", T.retrieval_tokens(F.col("question")).alias("tokens"))
    asked = q.select("question_id", F.explode("tokens").alias("token")).groupBy("question_id", "token").agg(F.count(F.lit(1)).alias("times"))
    words = asked.select("token").distinct()
    t = corpus.select("id", F.explode(T.retrieval_tokens(F.col("text"))).alias("token")).join(words, "token", "left_semi")
    tf = written(t.groupBy("id", "token").agg(F.count(F.lit(1)).alias("tf")), "token-counts")
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    weight = df.join(F.broadcast(n)).select("token", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))  # n: one row
    weight = written(weight.join(asked, "token"), "question-weights")
    # a passage's tokens lie together, so the many rows of tokens by questions are summed where they are made
    s = tf.repartition("id").join(weight, "token").groupBy("question_id", "id").agg(F.sum(F.col("times") * F.col("tf") * F.col("idf")).alias("score"), F.count(F.lit(1)).alias("shared"))
    s = written(s, "lexical-scores")  # read several times
    phrase = q.select("question_id", F.array_join("tokens", " ").alias("phrase"), F.size(F.array_distinct("tokens")).alias("of"))
    near = s.join(phrase, "question_id").where((F.col("phrase") != "") & (F.col("shared") >= F.col("of") - 2)).select("question_id", "id", "phrase")
    # texts are split once more only where a phrase may lie
    joined = corpus.join(near.select("id").distinct(), "id", "left_semi").select("id", F.array_join(T.retrieval_tokens(F.col("text")), " ").alias("joined"))
    bonus = near.join(joined, "id").where(F.contains("joined", F.col("phrase"))).select("question_id", "id", F.lit(1.5).alias("bonus"))
    return s.join(bonus, ["question_id", "id"], "left").select("question_id", "id", (F.col("score") + F.coalesce("bonus", F.lit(0.0))).alias("score"))


def best_scores(scored: DataFrame, k: int) -> DataFrame:
    """(question_id, rank, id, score): the k best of each question of scored(question_id, id, score), which is written, by nine digits and id.

    Sorting and rounding are slow and rounding moves no score by more than a billionth. The best scores of 64 shares of a question's rows are
    scores of different rows, so the k-th of them is no more than the k-th of all: only what lies less than a millionth under it is rounded and sorted.
    """
    shares = scored.groupBy("question_id", F.pmod(F.hash("id"), F.lit(64)).alias("share")).agg(F.max("score").alias("score"))
    kth = shares.withColumn("n", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score")))).where(F.col("n") == k)
    least = written(kth.select("question_id", (F.col("score") - 1e-6).alias("least")), "least-scores")
    w = Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 9)), "id")
    near = scored.join(least, "question_id", "left").where(F.col("least").isNull() | (F.col("score") >= F.col("least")))
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("question_id", "rank", "id", F.round("score", 6).alias("score"))


def passage_topk(corpus: DataFrame, questions: DataFrame, k: int = 2, scores: DataFrame | None = None) -> DataFrame:
    """(question_id, rank, id, score): the k best passages of each question; passages without a shared token score 0
    and come last, in corpus order. ``scores`` are the ``passage_scores``, where they are at hand."""
    best = written(passage_scores(corpus, questions), "scores") if scores is None else scores
    first = corpus.select("id").orderBy("id").limit(k).withColumn("score", F.lit(0.0))
    rest = questions.select("question_id").join(F.broadcast(first))  # k rows
    rest = rest.join(best.select("question_id", "id"), ["question_id", "id"], "left_anti").select("question_id", "id", "score")
    return best_scores(best.union(rest), k)


def containing(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(question_id, id) of the docs(id, text) whose text holds the item of items(question_id, item), character by character.

    The words inside an item, all but its first and last, are whole words of such a text: the second to fourth, or of a short
    item the second alone, are met by an equi-join before containment is tested. Texts are split once, and the items' keys
    are far fewer than the words, so Spark sends them to where the words are. Items of one or two words have no word inside:
    they are met by their first character.
    """
    n = F.size(F.split("item", " "))
    word = lambda a, k: F.array_join(F.slice(F.split("item", " "), a, k), " ")
    keyed = items.where("item is not null and item <> ''").withColumn("wide", F.when(n >= 5, 3).when(n >= 3, 1).otherwise(0))
    keyed = keyed.select("question_id", "wide", F.when(n >= 5, word(2, 3)).when(n >= 3, word(2, 1)).otherwise(F.substring("item", 1, 1)).alias("key"))
    keyed = written(keyed, "item-keys")
    t = docs.select("id", F.split("text", " ").alias("w"))
    later = lambda k: F.slice("w", F.lit(k), F.greatest(F.size("w") - (k - 1), F.lit(0)))
    threes = t.select("id", F.explode(F.arrays_zip(F.col("w").alias("a"), later(2).alias("b"), later(3).alias("c"))).alias("x")).where("x.c is not null").select("id", F.lit(3).alias("wide"), F.concat_ws(" ", "x.a", "x.b", "x.c").alias("key"))
    met = [threes]
    kinds = {r["wide"] for r in keyed.select("wide").distinct().collect()}  # three at most
    if 1 in kinds:
        met.append(t.select("id", F.lit(1), F.explode(F.array_distinct("w"))))
    if 0 in kinds:
        met.append(docs.select("id", F.lit(0), F.explode(F.array_distinct(F.split("text", "")))))
    grams = met[0]
    for more in met[1:]:
        grams = grams.union(more)
    near = grams.join(keyed, ["wide", "key"]).select("id", "question_id").distinct()
    return near.join(docs, "id").join(items, "question_id").where(F.contains("text", F.col("item"))).select("question_id", "id").distinct()


def by_class(classes: DataFrame, passage: DataFrame, hybrid: DataFrame, expected: DataFrame, corpus: DataFrame) -> DataFrame:
    """(class, recall_, faith_ and tokens_ of either way, decision) for classes(question_id, class): means over the questions."""
    ways = [(name, written(found.select("question_id", "id"), f"found-{name}")) for name, found in (("passage", passage), ("hybrid", hybrid))]
    shown = ways[0][1].union(ways[1][1]).select("id").distinct()
    # only the texts that are shown are split
    tokens = written(corpus.join(shown, "id", "left_semi").select("id", F.size(T.retrieval_tokens(F.col("text"))).alias("n")), "shown-tokens")
    expected = written(expected, "expected")
    out = None
    for name, found in ways:
        used = found.join(tokens, "id").groupBy("question_id").agg(F.sum("n").alias("n"))
        scored = evaluate_exact(found, expected)
        one = classes.join(scored, "question_id", "left").join(used, "question_id", "left").na.fill(1.0, ["recall", "faithfulness"]).na.fill(0, ["n"])
        m = one.groupBy("class").agg(F.avg("recall").alias(f"r_{name}"), F.avg("faithfulness").alias(f"f_{name}"), F.avg("n").alias(f"t_{name}"))
        out = m if out is None else out.join(m, "class")
    same = F.lit(0.0)  # latencies belong to a machine, not to a result
    better = promotion(F.col("r_passage"), F.col("r_hybrid"), F.col("f_passage"), F.col("f_hybrid"), same, same, F.col("t_passage"), F.col("t_hybrid"))
    cols = [F.round(f"{k}_{name}", d).alias(f"{long}_{name}") for name in ("passage", "hybrid") for k, long, d in (("r", "recall", 6), ("f", "faith", 6), ("t", "tokens", 4))]
    return out.select("class", *cols, F.when(better, "hybrid").otherwise("passage_only").alias("decision"))


def evaluate(found: DataFrame, expected: DataFrame) -> DataFrame:
    """``evaluate_exact`` in six digits."""
    return evaluate_exact(found, expected).select("question_id", F.round("recall", 6).alias("recall"), F.round("faithfulness", 6).alias("faithfulness"))


def evaluate_exact(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(question_id, recall, faithfulness) of found(question_id, id) against expected(question_id, id); 1 where there is nothing."""
    e = expected.distinct().groupBy("question_id").agg(F.count(F.lit(1)).alias("wanted"))
    f = found.select("question_id", "id").distinct()
    g = f.groupBy("question_id").agg(F.count(F.lit(1)).alias("got"))
    hit = f.join(expected.distinct(), ["question_id", "id"]).groupBy("question_id").agg(F.count(F.lit(1)).alias("hits"))
    j = e.join(g, "question_id", "full").join(hit, "question_id", "left").na.fill(0, ["wanted", "got", "hits"])
    rate = lambda d: F.when(F.col(d) == 0, 1.0).otherwise(F.col("hits") / F.col(d))
    return j.select("question_id", rate("wanted").alias("recall"), rate("got").alias("faithfulness"))


def entity_link(questions: DataFrame, labels: DataFrame, k: int = 3) -> DataFrame:
    """(question_id, rank, id, score): the entities that a question names; labels(id, label) has a row for each label and alias.

    2 for a label whose normal form lies in the question's, else the share of its tokens that the question has. A label that
    shares no token but lies in the question is part of one token, or of two neighbours: all parts of tokens, and
    all ends of a token with beginnings of the next, are looked up as whole labels. So each is found by equality.
    """
    tokens = T.retrieval_tokens(F.col("question"))
    q = questions.select("question_id", tokens.alias("tokens"), F.array_distinct(tokens).alias("qt"), F.array_join(tokens, " ").alias("whole"))
    lab = labels.where("label is not null").select("id", F.array_distinct(T.retrieval_tokens(F.col("label"))).alias("lt"), F.array_join(T.retrieval_tokens(F.col("label")), " ").alias("norm")).where("norm <> ''")
    shared = q.select("question_id", F.explode("qt").alias("token")).join(lab.select("id", "norm", "lt", F.explode("lt").alias("token")), "token")
    pairs = shared.groupBy("question_id", "id", "norm").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("lt")).alias("of")).join(q.select("question_id", "whole"), "question_id")
    score = F.when(F.contains("whole", F.col("norm")), 2.0).otherwise(F.col("n") / F.col("of"))
    upto = lambda n: F.sequence(F.lit(1), n)
    parts = lambda t: F.flatten(F.transform(upto(F.length(t)), lambda a: F.transform(upto(F.length(t) - a + 1), lambda n: F.substring(t, a, n))))
    ends = lambda t: F.transform(upto(F.length(t)), lambda a: F.substring(t, a, F.length(t)))
    starts = lambda t: F.transform(upto(F.length(t)), lambda n: F.substring(t, F.lit(1), n))
    over = F.transform(F.slice("tokens", F.lit(1), F.greatest(F.size("tokens") - 1, F.lit(0))), lambda t, i: F.flatten(F.transform(ends(t), lambda a: F.transform(starts(F.col("tokens")[i + 1]), lambda b: F.concat_ws(" ", a, b)))))
    inside = q.select("question_id", F.explode(F.array_distinct(F.concat(F.flatten(F.transform("qt", parts)), F.flatten(over)))).alias("norm")).join(lab.select("id", "norm"), "norm")
    best = pairs.select("question_id", "id", score.alias("score")).union(inside.select("question_id", "id", F.lit(2.0))).groupBy("question_id", "id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("question_id", "rank", "id", F.round("score", 6).alias("score"))


def hybrid_topk(corpus: DataFrame, questions: DataFrame, labels: DataFrame, evidence: DataFrame, relations: DataFrame, k: int = 3, budget: int = 6, scores: DataFrame | None = None) -> DataFrame:
    """(question_id, rank, id, score): passages by lexical score and by the graph around the entities that a question names.

    At most three named entities are seeds; their neighbours, by the best seed beside them, fill the budget. Each piece of
    evidence(entity, id) adds 3 and the link score for a seed, 5 for a neighbour; each of relations(source_id, target_id, id)
    between selected entities, one a seed, adds 4. Passages without any score are left out.
    """
    seeds = entity_link(questions, labels, min(3, budget)).select("question_id", F.col("id").alias("entity"), F.col("score").alias("link"))
    ends = relations.select("source_id", "target_id").distinct()
    step = ends.union(ends.select("target_id", "source_id")).toDF("entity", "to")
    near = seeds.join(step, "entity").groupBy("question_id", F.col("to").alias("entity")).agg(F.max("link").alias("link"))
    near = near.join(seeds.select("question_id", "entity"), ["question_id", "entity"], "left_anti")
    room = seeds.groupBy("question_id").agg((budget - F.count(F.lit(1))).alias("room"))
    w = Window.partitionBy("question_id").orderBy(F.desc("link"), "entity")
    near = near.withColumn("n", F.row_number().over(w)).join(room, "question_id").where(F.col("n") <= F.col("room"))
    chosen = seeds.select("question_id", "entity", (F.col("link") + 3).alias("boost"), F.lit(True).alias("seed")).union(near.select("question_id", "entity", F.lit(5.0), F.lit(False)))
    own = chosen.join(evidence, "entity").select("question_id", "id", "boost")
    a = chosen.select("question_id", F.col("entity").alias("source_id"), F.col("seed").alias("s1"))
    b = chosen.select("question_id", F.col("entity").alias("target_id"), F.col("seed").alias("s2"))
    ties = relations.join(a, "source_id").join(b, ["question_id", "target_id"]).where("s1 or s2").select("question_id", "id", F.lit(4.0))
    scores = passage_scores(corpus, questions) if scores is None else scores
    total = scores.union(own).union(ties).groupBy("question_id", "id").agg(F.sum("score").alias("score"))
    return best_scores(written(total, "total-scores"), k)


def promotion(recall_a, recall_b, faith_a, faith_b, latency_a, latency_b, tokens_a, tokens_b):
    """Whether b may replace a: recall 0.05 higher, as faithful, at most 1.5 times as slow (or 0.05 ms), at most 1.25 times the tokens."""
    return (recall_b - recall_a >= 0.05) & (faith_b >= faith_a) & (latency_b <= F.greatest(latency_a * 1.5, latency_a + 0.05)) & (tokens_b <= tokens_a * 1.25)
