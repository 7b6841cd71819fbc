"""Reply trees to chat text, with DataFrame functions only.

Iterative self-joins double the reach of every node's pointer to an ancestor
and add up scores on the way, so depths and path scores of all root-to-leaf
paths take O(log depth) rounds over rows of ids. Branches are ranked by path
score; the chosen paths are unrolled by the same pointers, again O(log depth)
joins, and each is formatted as one conversation.

A turn is `<|im_start|>role\\ntext<|im_end|>\\n`. In texts, `<|` becomes `<\\|` and
`<\\|` takes one more backslash, so no marker can occur inside one; roles are
escaped with `%`. The loss mask covers the texts of assistant turns.

Null text or role: empty. Null score: 0. Rows without a tree id are one tree, for
one conversation is one text. Null node: ignored. A parent that is null or missing in its tree: the node is a
root. Nodes on a cycle reach no root and belong to no
path. Several rows of one (tree, node): the least by parent, role and text
counts. Equal path scores: the least leaf first. Empty table: empty result.
Extra columns: ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base

START, END = "<|im_start|>", "<|im_end|>"
PROBE = "<|im_end|><|im_start|>assistant ok"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def role_escaped(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def role_unescaped(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def nodes_of(rows: DataFrame, distinct: bool) -> DataFrame:
    """One row for each node (as they are, if known to be distinct). Trees go
    by `t` and their id as text, so that a null tree joins like any other."""
    own = rows.where("node_id IS NOT NULL").select(
        F.concat_ws("", F.lit("t"), F.col("tree_id").cast("string")).alias("tree_id"), "node_id", "parent_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")
    )
    if distinct:
        return own
    return own.groupBy("tree_id", "node_id").agg(F.min(F.struct("parent_id", "role", "text", "score")).alias("n")).select("tree_id", "node_id", "n.*")


def _reach(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Pointer tables (tree_id, node_id, up) with up 1, 2, 4, … steps above,
    and (tree_id, node_id, depth, path_score) of all nodes with a root."""
    ids = nodes.select("tree_id", F.col("node_id").alias("parent_id"), F.lit(1).alias("known"))
    step = nodes.select("tree_id", "node_id", "parent_id", "score").join(ids, ["tree_id", "parent_id"], "left")
    now = base.stored(step.select("tree_id", "node_id", F.when(F.col("known") == 1, F.col("parent_id")).alias("up"), F.lit(1).alias("depth"), F.col("score").alias("path_score")), "paths")
    tables, open_nodes = [], None
    while True:
        left = now.where("up IS NOT NULL").count()
        if left in (0, open_nodes):
            break
        open_nodes = left
        tables.append(now.where("up IS NOT NULL").select("tree_id", "node_id", "up"))
        above = now.select("tree_id", F.col("node_id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("path_score").alias("score2"))
        done = now.where("up IS NULL")
        onward = now.where("up IS NOT NULL").join(above, ["tree_id", "up"]).select("tree_id", "node_id", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"), (F.col("path_score") + F.col("score2")).alias("path_score"))
        now = base.stored(done.unionByName(onward), "paths")
    return tables, now.where("up IS NULL").drop("up")


def best_paths(nodes: DataFrame, branches: int) -> DataFrame:
    """(tree_id, leaf_id, branch, position, role, text) along the best
    `branches` paths of each tree; position counts from 0 at the root."""
    tables, depths = _reach(nodes)
    parents = nodes.select("tree_id", F.col("parent_id").alias("node_id")).where("node_id IS NOT NULL").distinct()
    leaves = depths.join(parents, ["tree_id", "node_id"], "left_anti")
    if branches == 1:
        best = leaves.groupBy("tree_id").agg(F.min(F.struct((-F.col("path_score") / F.col("depth")).alias("s"), F.col("node_id").alias("leaf_id"), "depth")).alias("b"))
        chosen = best.select("tree_id", "b.leaf_id", F.lit(1).alias("branch"), "b.depth")
    else:
        ranked = leaves.selectExpr("tree_id", "node_id AS leaf_id", "depth", "row_number() OVER (PARTITION BY tree_id ORDER BY path_score / depth DESC, node_id) AS branch")
        chosen = ranked.where(F.col("branch") <= branches)
    path = chosen.select("tree_id", "leaf_id", "branch", "depth", F.col("leaf_id").alias("node_id"), F.lit(0).alias("above"))
    for k in range(len(tables) - 1, -1, -1):
        both = F.explode(F.array(F.struct(F.col("node_id").alias("n"), F.col("above").alias("a")), F.struct(F.col("up").alias("n"), (F.col("above") + F.lit(1 << k)).alias("a")))).alias("x")
        path = path.join(tables[k], ["tree_id", "node_id"], "left").select("tree_id", "leaf_id", "branch", "depth", both).where("x.n IS NOT NULL").select("tree_id", "leaf_id", "branch", "depth", F.col("x.n").alias("node_id"), F.col("x.a").alias("above"))
    return path.join(nodes, ["tree_id", "node_id"]).select("tree_id", "leaf_id", "branch", (F.col("depth") - 1 - F.col("above")).alias("position"), "role", "text")


def formatted(turns: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each conversation: formatted, and loss_mask, an entry for
    each assistant turn: its number, the code point in formatted where its text
    begins (offset), where in the turn (start), and the length."""
    head = F.concat(F.lit(START), role_escaped(F.col("role")), F.lit("\n"))
    body = escaped(F.col("text"))
    rows = turns.select(*keys, "position", "role", head.alias("head"), body.alias("body")).withColumn("turn", F.concat("head", "body", F.lit(END + "\n")))
    rows = rows.selectExpr("*", f"coalesce(sum(char_length(turn)) OVER (PARTITION BY {', '.join(keys)} ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin")
    start = F.char_length("head").cast("long")
    mask = F.when(
        F.col("role") == "assistant",
        F.struct(F.col("position").cast("long").alias("turn"), (F.col("begin") + start).alias("offset"), start.alias("start"), F.char_length("body").cast("long").alias("length")),
    )
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("position", "turn", mask.alias("mask")))).alias("t"))
    return packed.select(*keys, F.array_join(F.col("t.turn"), "").alias("formatted"), F.filter("t.mask", lambda m: m.isNotNull()).alias("loss_mask"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    turns = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda x: x != "")
    role = lambda x: F.regexp_extract(x, r"^<\|im_start\|>([^\n]*)\n", 1)
    return F.transform(turns, lambda x: F.struct(role_unescaped(role(x)).alias("role"), unescaped(F.regexp_replace(x, r"^<\|im_start\|>[^\n]*\n", "")).alias("text")))


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, in order."""
    turns = F.split(formatted, r"<\|im_end\|>\n", -1)
    return F.array_join(F.transform(mask, lambda m: unescaped(F.substring(F.element_at(turns, (m["turn"] + 1).cast("int")), (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")


def format_reply_trees(rows: DataFrame, branches: int = 1, distinct: bool = False) -> DataFrame:
    """rows(tree_id, node_id, parent_id, role, text, score) to one formatted
    conversation for each of the best `branches` paths of a tree. A path's
    score is the mean of its nodes' scores. distinct: no (tree, node) repeats."""
    nodes = base.stored(nodes_of(rows, distinct), "nodes")
    out = formatted(best_paths(nodes, branches), ["tree_id", "leaf_id", "branch"])
    kind = rows.schema["tree_id"].dataType
    return out.withColumn("tree_id", F.when(F.col("tree_id") != "t", F.substring("tree_id", 2, 1 << 30)).cast(kind))


def as_trees(conversations: DataFrame) -> DataFrame:
    """Linear conversations as trees: each row answers the one before, by
    turn, then role and text (null first)."""
    numbered = conversations.selectExpr("conv_id AS tree_id", "role", "text", "row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS node_id")
    return numbered.select("tree_id", F.col("node_id").cast("long"), F.when(F.col("node_id") > 1, F.col("node_id").cast("long") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.table(spark, sf_dir, "conversations").selectExpr("cast(conv_id AS long) AS conv_id", "cast(turn AS long) AS turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    chats = format_reply_trees(as_trees(rows.unionByName(probe)), distinct=True)
    turns = read_back(F.col("formatted"))
    loss = loss_text(F.col("formatted"), F.col("loss_mask"))
    return chats.select(F.col("tree_id").alias("conv_id"), "formatted", turns.alias("turns"), loss.alias("loss")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
  UNION ALL SELECT -1, 0, 'user', '@probe', 'user', '@probe'
  UNION ALL SELECT -1, 1, 'assistant', '@probe', 'assistant', '@probe'
), chats AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (role = 'assistant'), '') AS loss,
         sum(12 + length(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C')) + 1
             + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 11) AS chars
  FROM rows GROUP BY conv_id
)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
       sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars
FROM chats
""".replace("@probe", PROBE)
