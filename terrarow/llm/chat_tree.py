r"""Chat formatting over reply trees.

Messages name their parent. Iterative self-joins over ancestors 1, 2, 4, ... steps up enumerate all root-to-leaf
paths in 2 log2(depth) rounds; branches of a tree are ranked by score and each chosen path becomes one
formatted conversation with a loss mask over its assistant texts.

Template of a turn: <|turn|>ROLE[INST]TEXT, then </s> after an assistant and [/INST] after any other role. Control
strings inside roles and texts get a backslash after their first character (one more where there is one already),
so no text can end a turn and unescaping is exact.

Edge cases: null role or text counts as empty; a message whose parent is null, missing or itself, or that lies
on a cycle of parents, is a root; equal messages are told apart by their ids, which must be unique within a tree; null tree ids form one tree;
rows of a conversation that are equal in turn come in the order of role and text, null ones first, and equal rows all stay;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_rows, stored, table

TURN, BODY, END, LEARNED_END = "<|turn|>", "[INST]", "[/INST]", "</s>"
_CONTROL = r"([<\[])(\\*)(/?s>|\|turn\|>|/?INST\])"
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|\|turn\|>|/?INST\])")


def escape(text: str) -> str:
    return re.sub(_CONTROL, r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the (start, end) code points of its escaped assistant texts."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{BODY}", escape(text)
        parts += (head, body, LEARNED_END if role == "assistant" else END)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        at += sum(map(len, parts[-3:]))
    return "".join(parts), mask


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation, unescaped."""
    turns = []
    for part in formatted.split(TURN)[1:]:
        role, _, text = part.partition(BODY)
        role = unescape(role)
        turns.append((role, unescape(text.removesuffix(LEARNED_END if role == "assistant" else END))))
    return turns


def _jumps(parents: DataFrame, n: int) -> tuple[list[DataFrame], bool]:
    """Tables of (tree, id, up): the ancestor 2**k steps up, of messages that have one; whether one of them never ends."""
    tables = [stored(parents, "jumps")]
    while tables[-1].limit(1).count():
        if 1 << (len(tables) - 1) >= max(2, n):
            return tables, True
        low, high = tables[-1], tables[-1].select(F.col("tree").alias("t"), F.col("id").alias("k"), F.col("up").alias("far"))
        tables.append(stored(low.join(high, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("k"))).select("tree", "id", F.col("far").alias("up")), "jumps"))
    return tables[:-1], False


def reply_paths(messages: DataFrame) -> DataFrame:
    """tree, leaf, id, above: every message of every root-to-leaf path, above steps over the leaf.

    messages: tree string, id long, parent long. Self-joins build tables of ancestors 1, 2, 4, ... steps up, only of
    messages that are that deep; then the steps of those tables, from the longest down, take the leaves to all their
    ancestors, each reached once. The rows made are those of the result; texts stay out of the rounds.
    """
    nodes = messages.select("tree", "id", "parent")
    same = F.col("tree").eqNullSafe(F.col("t"))
    known = nodes.select(F.col("tree").alias("t"), F.col("id").alias("k"))
    parents = nodes.where("parent IS NOT NULL AND parent != id").join(known, same & (F.col("parent") == F.col("k"))).select("tree", "id", F.col("parent").alias("up"))
    n = nodes.count()
    tables, endless = _jumps(parents, n)
    if endless:  # far jumps end on the cycles: their messages become roots
        cycles = stored(tables[-1].select(F.col("tree").alias("t"), F.col("up").alias("k")).distinct(), "cycles")
        tables, _ = _jumps(parents.join(cycles, same & (F.col("id") == F.col("k")), "left_anti"), n)
    above = parents.select(F.col("tree").alias("t"), F.col("up").alias("k")).distinct() if not tables else tables[0].select(F.col("tree").alias("t"), F.col("up").alias("k")).distinct()
    rows = nodes.join(above, same & (F.col("id") == F.col("k")), "left_anti").select("tree", F.col("id").alias("leaf"), "id", F.lit(0).alias("above"))
    for k in reversed(range(len(tables))):
        far = tables[k].select(F.col("tree").alias("t"), F.col("id").alias("k"), "up")
        rows = stored(rows.join(far, same & (F.col("id") == F.col("k")), "left").select("tree", "leaf", "above", F.explode(F.array_compact(F.array(F.struct(F.col("id"), F.lit(0).alias("more")), F.when(F.col("up").isNotNull(), F.struct(F.col("up").alias("id"), F.lit(1 << k).alias("more")))))).alias("x")).select("tree", "leaf", F.col("x.id").alias("id"), (F.col("above") + F.col("x.more")).alias("above")), "paths")
    return rows


def format_trees(messages: DataFrame, top: int | None = None) -> DataFrame:
    """tree, leaf, score, rank, formatted, mask: one row per chosen root-to-leaf path.

    messages: tree string, id long, parent long, role, text, score double (null: 0). A branch's score is the sum of
    its messages' scores; ties go to the smaller leaf id. top keeps that many branches of a tree, None all, ranked too.
    """
    steps = reply_paths(messages).select("tree", "leaf", "id", (-F.col("above")).alias("depth"))
    same = F.col("tree").eqNullSafe(F.col("t"))
    # branches are ranked by ids and scores alone; texts join the chosen ones
    scores = messages.select(F.col("tree").alias("t"), F.col("id").alias("i"), F.coalesce("score", F.lit(0.0)).alias("s"))
    ranked = steps.join(scores, same & (F.col("id") == F.col("i"))).groupBy("tree", "leaf").agg(F.sum("s").alias("score"))
    ranked = stored(ranked.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))), "ranks")
    chosen = (ranked if top is None else ranked.where(F.col("rank") <= top)).select(F.col("tree").alias("t"), F.col("leaf").alias("l"), "score", "rank")
    texts = messages.select(F.col("tree").alias("t"), F.col("id").alias("i"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kept = steps.join(chosen, same & (F.col("leaf") == F.col("l"))).select("tree", "leaf", "id", "depth", "score", "rank")
    rows = kept.join(texts, same & (F.col("id") == F.col("i"))).groupBy("tree", "leaf").agg(F.first("score").alias("score"), F.first("rank").alias("rank"), F.array_sort(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))

    def formatted(batch):
        names = batch.schema.names
        columns = {n: batch.column(names.index(n)) for n in ("tree", "leaf", "score", "rank")}
        done = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in batch.column(names.index("turns")).to_pylist()]
        yield columns | {"formatted": [x[0] for x in done], "mask": [[{"start": a, "end": b} for a, b in x[1]] for x in done]}

    return map_rows(rows, formatted, "tree string, leaf bigint, score double, rank int, formatted string, mask array<struct<start:int,end:int>>")


def conversations_as_trees(conversations: DataFrame) -> DataFrame:
    """Each turn replies to the one before it, in the order of turn, then role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("id", F.row_number().over(order).cast("long"))
    return rows.select(F.col("conv_id").cast("string").alias("tree"), "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


_SAFETY = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(_SAFETY, "conv_id bigint, turn bigint, role string, text string"))
    out = format_trees(stored(conversations_as_trees(rows), "messages"))

    def digests(batch):
        names = batch.schema.names
        got = {k: [] for k in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
        for tree, text, mask in zip(*(batch.column(names.index(n)).to_pylist() for n in ("tree", "formatted", "mask"))):
            turns = parse_turns(text)
            loss = "".join(unescape(text[m["start"] : m["end"]]) for m in mask)
            got["conv_id"].append(None if tree is None else int(tree))
            got["n_turns"].append(len(turns))
            got["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
            got["loss_chars"].append(len(loss))
            got["loss_sha256"].append(hashlib.sha256(loss.encode()).hexdigest())
            got["formatted_chars"].append(len(text))
        yield got

    return map_rows(out, digests, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


_ESC = r"length(regexp_replace({}, '([<\[])(\\*)(/?s>|\|turn\|>|/?INST\])', '\1\\\2\3', 'g'))"
OP4_SQL = f"""
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce("text", '') AS t FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(TURN) + len(BODY)} + {_ESC.format("role")} + {_ESC.format("t")} + CASE WHEN role = 'assistant' THEN {len(LEARNED_END)} ELSE {len(END)} END) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""
