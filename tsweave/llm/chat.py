"""Operator 10: conversations from reply trees.

Messages are nodes (tree, node, parent, role, text, score). Self-joins climb from every message by 1, 2, 4 and so on
messages at a time and add up scores on the way, so each leaf gets its path's score in one number. A tree's paths are
ranked by it, and only the best are then written out, by the same climbs, and formatted, one conversation each.

A turn is formatted as  <s>[INST] role [/INST] text</s>  and the next follows at once. In roles and texts, a backslash is
doubled and each control string gets one backslash after its first character; so no control string is left in them, and
dropping single backslashes and halving double ones gives the text back. The loss mask is the spans of the assistant's
texts, in code points of the formatted conversation, without any mark.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\] (.*?)</s>", re.S)
LEARNED = "assistant"


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for c in CONTROL:
        text = text.replace(c, f"{c[0]}\\{c[1:]}")
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(formatted, mask): mask has the start and end of each of the assistant's texts."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"<s>[INST] {escape(role)} [/INST] ", escape(text)
        at += len(head)
        if role == LEARNED:
            mask.append((at, at + len(body)))
        parts += [head, body, "</s>"]
        at += len(body) + 4
    return "".join(parts), mask


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    found = TURN.findall(formatted)
    return [(unescape(r), unescape(t)) for r, t in found]


def climbs(nodes: DataFrame) -> list[DataFrame]:
    """Written tables (tree, node, up, total). In the k-th, counted from 0, up is the message 2^k above, null past the root.

    nodes: (tree, node, parent, score), a node once. total: the sum of the scores from node on that lie below up. After
    the last table, a node that still has an up has no root: it is in a cycle or answers one. A message whose
    parent is null or missing is a root.
    """
    most = nodes.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n or 0
    inner = nodes.where("parent is not null").select("tree", "node", F.col("parent").alias("up"), F.col("score").alias("total"))
    inner = inner.join(nodes.select("tree", F.col("node").alias("up")), ["tree", "up"], "left_semi").select("tree", "node", "up", "total")
    roots = nodes.select("tree", "node", F.lit(None).cast("long").alias("up"), F.col("score").alias("total")).join(inner, ["tree", "node"], "left_anti")
    tables = [written(inner.union(roots), "climbs")]
    while 1 << len(tables) - 1 < most:
        here = tables[-1]
        more = here.where("up is not null")
        if more.isEmpty():
            break
        above = here.select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"))
        more = more.join(above, ["tree", "up"]).select("tree", "node", F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total"))
        tables.append(written(here.where("up is null").union(more), "climbs"))
    return tables


def conversations(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, leaf, rank, score, formatted, mask) of the `top` best paths of each tree.

    messages: tree string, node long, parent long, role, text, score. Ties of score go to the smaller leaf. Null roles
    and texts are empty, null scores 0; of rows of one tree and node the least by parent, role, text and score counts;
    rows without tree or node are none; messages in a cycle, or that answer one, are in no path; an empty table gives no
    rows; further columns are not read.
    """
    m = messages.select("tree", F.col("node").cast("long").alias("node"), F.col("parent").cast("long").alias("parent"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    m = m.where("tree is not null and node is not null").groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m"))
    m = written(m.select("tree", "node", "m.*"), "messages")
    steps = climbs(m.select("tree", "node", "parent", "score"))
    inner = m.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    leaf = steps[-1].where("up is null").join(inner, ["tree", "node"], "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc("total"), "node")
    leaf = leaf.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    leaf = written(leaf.select("tree", F.col("node").alias("leaf"), "rank", F.col("total").alias("score")), "best-paths")
    step = leaf.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).alias("step"))
    for k, climb in enumerate(steps):  # step has all that lie less than 2^k above their leaf
        more = step.join(climb.where("up is not null").select("tree", "node", "up"), ["tree", "node"])
        step = written(step.union(more.select("tree", "leaf", F.col("up").alias("node"), (F.col("step") + (1 << k)).alias("step"))), "path-steps")
    turn = step.join(leaf, ["tree", "leaf"]).join(m.select("tree", "node", "role", "text"), ["tree", "node"])
    path = turn.groupBy("tree", "leaf", "rank", "score").agg(F.sort_array(F.collect_list(F.struct((-F.col("step")).alias("at"), "role", "text"))).alias("turns"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in pdf.pop("turns")]
            yield pdf.assign(formatted=[f for f, _ in made], mask=[[{"start": a, "end": b} for a, b in m] for _, m in made])

    return path.mapInPandas(run, "tree string, leaf long, rank int, score double, formatted string, mask array<struct<start: long, end: long>>")


def from_turns(rows: DataFrame) -> DataFrame:
    """Messages of conversations (conv_id, turn, role, text): each row answers the one before it by turn, role and text.

    A null conv_id is a conversation too; its tree is named by the empty text.
    """
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    own = rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("tree"), "turn", "role", "text")
    own = own.withColumn("node", F.row_number().over(order).cast("long"))
    return own.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for tree, text, mask in zip(pdf["tree"], pdf["formatted"], pdf["mask"], strict=True):
                turns = parse_turns(text)
                loss = "".join(unescape(text[m["start"] : m["end"]]) for m in mask)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((tree, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            yield pd.DataFrame(out, columns=["tree", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    found = formatted.select("tree", "formatted", "mask").mapInPandas(run, "tree string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return found.select(F.expr("try_cast(nullif(tree, '') as bigint)").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
