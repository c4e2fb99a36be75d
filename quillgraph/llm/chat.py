r"""Chat formatting of reply trees.

Messages (tree, node, parent, role, text, score) form trees. Iterative self-joins double the reach of each
message's ancestor pointer, so a path of n messages takes log2(n) joins; every root-to-leaf path is ranked
in its tree by the sum of its scores, and each chosen path becomes one string:

    <|turn|>role\n text <|end|>\n

In texts and roles, ``\`` ``<`` and ``[`` are written as ``\b`` ``\l`` and ``\o``: no control string of this or
another template can appear, and ``unescaped`` gives back the very text. The loss mask is a list of spans
(start, length) in code points over assistant texts.

Defined cases: null text is empty; a null role is ``unknown``; rows that repeat a turn are turns of their own, in
order of role and text; rows with a null conversation form one conversation; an unknown parent makes a root;
messages on a cycle, or below one, have no root and give no path; of rows with the same tree and node ``once`` keeps one;
a null node is left out; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

OPEN, END = "<|turn|>", "<|end|>\n"


def escaped(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(c, F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\o"))


def unescaped(c: Column) -> Column:
    c = F.replace(F.replace(c, F.lit("\\o"), F.lit("[")), F.lit("\\l"), F.lit("<"))
    return F.replace(c, F.lit("\\b"), F.lit("\\"))


def threads(conversations: DataFrame) -> DataFrame:
    """Messages of a table of conversations: each turn answers the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    m = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    m = m.withColumn("node", F.row_number().over(order).cast("long"))
    return m.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def once(messages: DataFrame) -> DataFrame:
    """One row for each (tree, node): the least by parent, role, text and score."""
    rest = F.struct("parent", "role", "text", "score")
    return messages.groupBy("tree", "node").agg(F.min(rest).alias("m")).select("tree", "node", "m.*")


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, back): every message of every root-to-leaf path, ``back`` steps from the leaf.

    First the pointers join themselves: those of round k lead 2^k steps up, and only messages with so many ancestors
    have one. After as many rounds as the largest tree's size has bits, messages that still have one lead to a cycle. Then
    round k joins the members found so far, from the other leaves, with the 2^k-step pointers. Everything is written
    each round, so a lost executor repeats one round at most. messages(tree, node, parent), each node once.
    """
    m = messages.select("tree", "node", "parent")
    most = m.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    at = lambda d: d.select(F.col("tree").alias("t"), F.col("node").alias("n"), *[c for c in d.columns if c == "up"])
    here = F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))
    up = m.join(at(m), F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n")), "left")
    up = materialize(up.select("tree", "node", F.col("n").alias("up")), "chat-up")
    jumps = [up.where("up is not null")]
    while most >= 1 << (len(jumps) - 1) and not jumps[-1].isEmpty():
        j, k = jumps[-1], at(jumps[-1]).withColumnRenamed("up", "over")
        far = j.join(k, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n")))
        jumps.append(materialize(far.select("tree", "node", F.col("over").alias("up")), "chat-up"))
    inner = jumps[0].select("tree", F.col("up").alias("node")).distinct()
    leaf = up.join(at(inner), here, "left_anti").join(at(jumps[-1].select("tree", "node")), here, "left_anti")
    found = materialize(leaf.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("back")), "chat-paths")
    for k, j in enumerate(jumps[:-1]):
        more = found.join(at(j), here).select("tree", "leaf", F.col("up").alias("node"), F.col("back") + (1 << k))
        found = materialize(found.union(more), "chat-paths")
    return found


def ranked(members: DataFrame, messages: DataFrame) -> DataFrame:
    """(tree, leaf, branch, turns): each path with its messages in order; branch 1 has the highest score."""
    m = messages.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text", "score")
    full = members.join(m, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
    one = full.groupBy("tree", "leaf").agg(F.sum("score").alias("total"), F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at"), "role", "text"))).alias("turns"))
    w = Window.partitionBy("tree").orderBy(F.desc("total"), "leaf")
    return one.withColumn("branch", F.row_number().over(w)).select("tree", "leaf", "branch", "total", "turns")


def branches(messages: DataFrame) -> DataFrame:
    """``ranked`` paths of any table of messages(tree, node, parent, role, text, score)."""
    own = messages.select("tree", "node", "parent", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))
    m = materialize(once(own.where("node is not null")), "chat-messages")
    return ranked(paths(m), m)


def formatted(turns: DataFrame) -> DataFrame:
    """(tree, leaf, branch, formatted, loss): loss is the array of (start, length) of assistant texts, in code points."""
    whole = F.transform("turns", lambda t: F.struct(F.concat(F.lit(OPEN), escaped(t["role"]), F.lit("\n")).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss")))
    d = turns.withColumn("p", whole)
    text = F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start: bigint, length: bigint>>)").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        body = acc["at"] + F.length(x["head"])
        spans = F.when(x["loss"], F.concat(acc["spans"], F.array(F.struct(body.cast("long").alias("start"), F.length(x["body"]).cast("long").alias("length"))))).otherwise(acc["spans"])
        return F.struct((body + F.length(x["body"]) + len(END)).cast("long").alias("at"), spans.alias("spans"))

    return d.select("tree", "leaf", "branch", text.alias("formatted"), F.aggregate("p", start, step)["spans"].alias("loss"))


def parsed(done: DataFrame) -> DataFrame:
    """The formatted strings read back: (tree, leaf, branch, formatted, turns, loss_texts)."""
    pieces = F.filter(F.split("formatted", r"\Q" + OPEN + r"\E"), lambda x: x != "")
    turns = F.transform(pieces, lambda x: F.struct(unescaped(F.substring_index(x, "\n", 1)).alias("role"), unescaped(F.substr(x, F.instr(x, "\n") + 1, F.length(x) - F.instr(x, "\n") - len(END))).alias("text")))
    masked = F.transform("loss", lambda s: unescaped(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return done.select("tree", "leaf", "branch", "formatted", turns.alias("turns"), masked.alias("loss_texts"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    messages = materialize(threads(rows), "chat-messages")
    best = ranked(paths(messages), messages).where("branch = 1")
    back = parsed(materialize(formatted(best), "chat-formatted"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP6_SQL = r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(role) + length(text) + 17
        + length(regexp_replace(role || text, '[^\\<\[]', '', 'g')) AS n FROM m)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
