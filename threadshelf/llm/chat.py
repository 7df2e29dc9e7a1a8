"""Chat formatting: reply trees to root-to-leaf paths, the best branches, one text per path.

Only joins, aggregates and column expressions. Paths are found by pointer doubling: after k
self-joins a message knows its ancestor 2^k replies up, so a chain of any length takes a
logarithmic number of joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadshelf.llm.common import let
from threadshelf.plans.lineage import cut

# Strings that steer common chat templates; in a text they are escaped.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """A turn is start, role, middle, text, end."""

    start: str = "<s>[INST]"
    middle: str = "[/INST]"
    end: str = "</s>\n"


def escape(text: Column) -> Column:
    """No control string is left: the escape sign is doubled, and put behind the first
    character of each control string."""
    text = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for control in CONTROL:
        text = F.replace(text, F.lit(control), F.lit(control[0] + ESCAPE + control[1:]))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree"))


def jump_tables(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """([(tree, node, up)] for 1, 2, 4, ... replies up, (tree, node, total, depth)).

    `messages`: (tree, node, parent, score), a node once per tree. A parent that does not
    exist counts as none. Messages that hang on no root (a circle of replies) are left out.
    """
    nodes = cut(messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("total")))
    parents = nodes.select("tree", F.col("node").alias("up"))
    step = cut(
        nodes.alias("n")
        .join(parents.alias("p"), _same("n", "p") & (F.col("n.parent") == F.col("p.up")), "left")
        .select("n.tree", "n.node", "p.up", "n.total", F.lit(1).cast("long").alias("depth"))
    )
    largest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    jumps, ended = [], step.where(F.col("up").isNull())
    while True:
        open_rows = step.where(F.col("up").isNotNull())
        if (1 << len(jumps)) > largest or open_rows.isEmpty():
            return jumps, ended.drop("up")
        jumps.append(open_rows.select("tree", "node", "up"))
        # only messages that have not reached their root go on; those above may have
        above = open_rows.unionByName(ended).select("tree", F.col("node").alias("at"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("depth").alias("deeper"))
        step = cut(
            open_rows.alias("s")
            .join(above.alias("a"), _same("s", "a") & (F.col("s.up") == F.col("a.at")))
            .select(
                "s.tree",
                "s.node",
                F.col("a.next").alias("up"),
                (F.col("s.total") + F.col("a.more")).alias("total"),
                (F.col("s.depth") + F.col("a.deeper")).alias("depth"),
            )
        )
        ended = ended.unionByName(step.where(F.col("up").isNull()))


def best_paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree, leaf, branch, node, height) for the best branches of every tree.

    Branches are ranked by the mean score of their messages, then by length, then by the
    smallest leaf; `branches=None` takes all. Height 0 is the leaf.
    """
    jumps, reached = jump_tables(messages)
    replied = messages.where(F.col("parent").isNotNull()).select("tree", F.col("parent").alias("node")).distinct()
    leaves = (
        reached.alias("r")
        .join(replied.alias("p"), _same("r", "p") & (F.col("r.node") == F.col("p.node")), "left_anti")
        .withColumn("score", F.col("total") / F.col("depth"))
    )
    order = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("depth"), F.asc("node"))
    ranked = leaves.withColumn("branch", F.row_number().over(order))
    if branches is not None:
        ranked = ranked.where(F.col("branch") <= branches)
    paths = ranked.select("tree", F.col("node").alias("leaf"), "branch", "node", F.lit(0).cast("long").alias("height"))
    for k in reversed(range(len(jumps))):
        paths = cut(paths)
        higher = (
            paths.alias("x")
            .join(jumps[k].alias("j"), _same("x", "j") & (F.col("x.node") == F.col("j.node")))
            .select("x.tree", "x.leaf", "x.branch", F.col("j.up").alias("node"), (F.col("x.height") + (1 << k)).alias("height"))
        )
        paths = paths.unionByName(higher)
    return paths


def format_paths(
    messages: DataFrame, branches: int | None = 1, template: Template = Template()
) -> DataFrame:
    """(tree, leaf, branch, n_turns, formatted, pieces): one conversation per chosen path.

    `messages`: (tree, node, parent, role, text, score). `pieces` are (piece, loss) whose
    concatenation is `formatted`; loss is true for exactly the escaped texts of the assistant.
    Null roles and texts count as empty. A tree may be null; it is then a tree of its own.
    A message repeated under one node is one message: the smallest role and text count.
    One row holds one conversation, as its reader needs it; nothing else is gathered.
    """
    text = F.coalesce("text", F.lit(""))
    role = F.coalesce("role", F.lit(""))
    single = cut(
        messages.groupBy("tree", "node").agg(
            F.min(F.struct(role.alias("role"), text.alias("text"), F.col("parent"), F.col("score"))).alias("m")
        ).select("tree", "node", "m.*")
    )
    paths = best_paths(single.select("tree", "node", "parent", "score"), branches)
    turns = (
        paths.alias("x")
        .join(single.alias("s"), _same("x", "s") & (F.col("x.node") == F.col("s.node")))
        .groupBy("x.tree", "x.leaf", "x.branch")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("x.height")).alias("at"), "s.role", "s.text"))).alias("turns"))
    )

    def pieces(t: Column) -> Column:
        said = t["role"] == "assistant"
        head = F.concat(F.lit(template.start), escape(t["role"]), F.lit(template.middle))
        return F.array(
            F.struct(head.alias("piece"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("piece"), said.alias("loss")),
            F.struct(F.lit(template.end).alias("piece"), F.lit(False).alias("loss")),
        )

    cutout = turns.select(
        "tree", "leaf", "branch", F.size("turns").cast("long").alias("n_turns"),
        F.flatten(F.transform("turns", pieces)).alias("pieces"),
    )
    return cutout.withColumn("formatted", F.array_join(F.transform("pieces", lambda p: p["piece"]), ""))


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns of a formatted conversation as (role, text), unescaped."""

    def parse(turn: Column) -> Column:
        inner = F.substring(turn, len(template.start) + 1, 2**31 - 1)
        return let(
            F.split(inner, _quoted(template.middle), 2),
            lambda x: F.struct(unescape(F.get(x, F.lit(0))).alias("role"), unescape(F.get(x, F.lit(1))).alias("text")),
        )

    parts = F.filter(F.split(formatted, _quoted(template.end)), lambda x: x != "")
    return F.transform(parts, parse)


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"


def loss_text(pieces: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(pieces, lambda p: p["loss"]), lambda p: unescape(p["piece"])), "")


def chains(conversations: DataFrame) -> DataFrame:
    """Flat conversations (conv_id, turn, role, text) as trees: each turn replies to the one before.

    Turns with the same number are ordered by role, then text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    place = F.row_number().over(order).cast("long")
    return conversations.select(
        F.col("conv_id").alias("tree"), place.alias("node"), (place - 1).alias("parent"), "role", "text",
        F.lit(0.0).alias("score"),
    )
