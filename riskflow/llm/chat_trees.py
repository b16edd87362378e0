"""Chat formatting of reply trees (operator 6).

Every message names its parent.  Iterative self-joins enumerate the paths from
the leaves to the root, doubling the jump in each round, so a thread of n turns
takes log n rounds and only ids are joined.  Branches of a tree are ranked by
the mean score of their messages; each chosen path becomes one conversation.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn.  In texts and roles
every ``<``, backslashes, ``|`` gets one more backslash before the ``|``, so no
control string can occur inside and the original comes back exactly.  The loss
mask lists (start, length) of every assistant text in the formatted string.

Defined cases: null texts and roles are empty; rows of a null tree are one
tree; a message whose parent is missing is a root; an empty table gives an
empty result; equal branch scores rank by leaf.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.llm.common import settle

START, END = "<|im_start|>", "<|im_end|>\n"
TRAINED = "assistant"
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: Column) -> Column:
    """A role stands on one line: backslashes and line ends are escaped too."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def paths(nodes: DataFrame) -> DataFrame:
    """nodes (tree, node, parent) -> (tree, leaf, node, up): every root-to-leaf path, up = steps above the leaf."""
    jump = settle(nodes.join(nodes.select("tree", F.col("node").alias("parent")), ["tree", "parent"], "left_semi")
                  .select("tree", "node", F.col("parent").alias("to")), "jumps")
    leaves = nodes.select("tree", "node").join(jump.select("tree", F.col("to").alias("node")), ["tree", "node"], "left_anti")
    reach = settle(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "reach")
    step = 1
    while not jump.isEmpty():
        further = reach.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + step).alias("up"))
        reach = settle(reach.unionByName(further), "reach")
        jump = settle(jump.join(jump.select("tree", F.col("node").alias("to"), F.col("to").alias("far")), ["tree", "to"])
                      .select("tree", "node", F.col("far").alias("to")), "jumps")
        step *= 2
    return reach


def format_paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """nodes (tree, node, parent, role, text, score) -> tree, leaf, rank, score, formatted, loss (array of start, length).

    The top branches of each tree by mean score; top 0 takes all.
    """
    nodes = settle(nodes, "messages")
    reach = paths(nodes.select("tree", "node", "parent"))
    scored = reach.join(nodes.select("tree", "node", "score"), ["tree", "node"]) \
        .groupBy("tree", "leaf").agg(F.avg("score").alias("path_score"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc_nulls_last("path_score"), "leaf"))
    chosen = scored.withColumn("rank", rank)
    if top:
        chosen = chosen.filter(F.col("rank") <= top)
    head = F.concat(F.lit(START), escape_role(F.coalesce("role", F.lit(""))), F.lit("\n"))
    body = escape(F.coalesce("text", F.lit("")))
    d = reach.join(chosen, ["tree", "leaf"]).join(
        nodes.select("tree", "node", head.alias("head"), body.alias("body"), (F.col("role") == TRAINED).alias("trained")), ["tree", "node"])
    by = Window.partitionBy("tree", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(END)
    d = d.withColumn("start", F.coalesce(F.sum(size).over(by), F.lit(0)) + F.length("head"))
    d = d.withColumn("span", F.when(F.col("trained"), F.struct("start", F.length("body").cast("long").alias("length"))))
    return d.groupBy("tree", "leaf").agg(
        F.first("rank").alias("rank"), F.first("path_score").alias("score"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), F.concat("head", "body", F.lit(END)).alias("turn")))),
                                 lambda t: t["turn"]), "").alias("formatted"),
        F.sort_array(F.collect_list("span")).alias("loss"))


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted conversation."""
    return [(unescape_role(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def loss_text(formatted: str, loss: list[tuple[int, int]]) -> str:
    """All text under the loss mask, unescaped."""
    return "".join(unescape(formatted[s:s + n]) for s, n in loss)
