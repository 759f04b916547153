"""Chat formatting: the best paths of reply trees as conversations.  DataFrame functions only.

Messages name their parents.  Self-joins of ids and pointers alone double the way to
the ancestors that a message knows, and then put the nodes of each root-to-leaf path
together, the longest stride first, so a chain of n messages takes about 2 log n joins.
Branches are ranked by the mean score of their messages, and only chosen ones meet
their texts.  A conversation is one row, as long as its texts are.

The template puts control strings around turns.  A control string in a text or role
gets one backslash more behind its first character (``<\\/s>``, then ``<\\\\/s>``), so no
text holds one, all others stay as they are, and reading takes one away again.  The
loss mask is a list of byte spans, one for each text of the trained role.

Defined results: null and empty texts are empty turns, a null role the role ''; a null
score counts as 0, a null tree is a tree of its own; a parent that does not exist (or
is null) makes a root; messages whose parents run in a circle, and what hangs on them, are in no path; of
repeated ids in a tree one stays (the least parent, role and text); ties of branches: the least leaf id; texts
of any length are whole; an empty table gives no rows; other columns are not read,
whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quorumlake.session import discard, scratch, written


@dataclass(frozen=True)
class Template:
    """Control strings: before a conversation, before a role, between role and text,
    and behind a text; more to escape, as those of other templates.  All start with
    a character that none has elsewhere."""

    begin: str = "<s>"
    opens: str = "[INST]"
    says: str = "[/INST]"
    ends: str = "</s>"
    others: tuple[str, ...] = ("<unk>", "<|im_start|>", "<|im_end|>")

    def __post_init__(self) -> None:
        heads = {c[0] for c in self.controls()}
        if any(h in c[1:] for c in self.controls() for h in heads) or "\\" in "".join(self.controls()) or any(not c[1:] for c in self.controls()):
            raise ValueError("a control string must have two characters or more, and its first one nowhere else")

    def controls(self) -> tuple[str, ...]:
        return (self.begin, self.opens, self.says, self.ends, *self.others)

    def escaped(self, text: Column) -> Column:
        """One backslash more between the first character of a control string and the rest."""
        return F.regexp_replace(text, "|".join(rf"(?<={_literal(c[0])})(?=\\*{_literal(c[1:])})" for c in self.controls()), r"\\")

    def unescaped(self, text: Column) -> Column:
        mended = F.regexp_replace(text, "|".join(rf"(?<={_literal(c[0])})\\(?=\\*{_literal(c[1:])})" for c in self.controls()), "")
        return F.when(F.contains(text, F.lit("\\")), mended).otherwise(text)


def _literal(s: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", s)


# ---- paths ---------------------------------------------------------------------------

#: Scores are summed as decimals, so that the order of rows does not matter.
SCORE = "decimal(28,6)"


def _strides(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Tables (tree, node, up, score of up) of the ancestors 1, 2, 4, … above, as long as
    any message has one, and the nodes (tree, node) whose way up never ends."""
    known = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("score").alias("up_score"))
    step = nodes.where("parent is not null").join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n")))
    tables, before = [written(step.select("tree", "node", F.col("parent").alias("up"), "up_score"), "stride")], None
    while (many := tables[-1].count()) and many != before:
        on = tables[-1].select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("next"), F.col("up_score").alias("next_score"))
        longer = tables[-1].join(on, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n")))
        before = many
        tables.append(written(longer.select("tree", "node", F.col("next").alias("up"), F.col("next_score").alias("up_score")), "stride"))
    last = tables.pop()
    if not many:
        discard(last)
        return tables, None
    # as many messages have an ancestor twice as far: of the two tables' messages all are in circles, or hang on one
    discard(tables.pop())
    return tables, last.select("tree", "node")


def reply_paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, above, score) of (tree, node, parent, score), ids being unique in
    a tree: the nodes of every root-to-leaf path, ``above`` being the distance from the leaf."""
    tables, circles = _strides(nodes)
    parents = nodes.where("parent is not null").select(F.col("tree").alias("t"), F.col("parent").alias("n"))
    rows = nodes.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left_anti")
    if circles is not None:
        rows = rows.join(circles.select(F.col("tree").alias("t"), F.col("node").alias("n")), F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left_anti")
    rows = rows.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("above"), "score")
    for k in range(len(tables) - 1, -1, -1):
        on = tables[k].select(F.col("tree").alias("t"), F.col("node").alias("n"), "up", "up_score")
        both = F.array(F.struct("node", "above", "score"), F.when(F.col("up").isNotNull(), F.struct(F.col("up").alias("node"), (F.col("above") + (1 << k)).alias("above"), F.col("up_score").alias("score"))))
        met = rows.join(on, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left").select("tree", "leaf", F.explode(both).alias("at"))
        rows = met.where("at is not null").select("tree", "leaf", "at.*")
    out = written(rows, "paths")
    discard(*tables, *([circles] if circles is not None else []))
    return out


def best_branches(paths: DataFrame, best: int | None) -> DataFrame:
    """(tree, leaf, score, branch_rank) of the ``best`` branches of each tree (all: None)."""
    means = paths.groupBy("tree", "leaf").agg((F.sum("score") / F.count(F.lit(1))).cast("double").alias("score"))
    ranked = means.select("*", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("score"), "leaf")).alias("branch_rank"))
    return ranked if best is None else ranked.where(F.col("branch_rank") <= best)


# ---- conversations ----------------------------------------------------------------------


def format_replies(messages: DataFrame, path: str, *, tree: str = "tree", node: str = "node", parent: str = "parent", role: str = "role", text: str = "text", score: str | None = None,
                   best: int | None = 1, trained: str = "assistant", template: Template = Template(), distinct: bool = False) -> DataFrame:
    """Write the best branches of each tree as conversations below ``path`` (Parquet) and
    return them as read back: tree, leaf, branch_rank, score, n_turns, formatted and
    loss_mask, which has (turn_start, start, size) for each turn, in code points of
    ``formatted``: where the turn and its trained text begin, and how long that is (0: not trained).

    distinct: whether ids are known to be unique in their trees.
    """
    mark = F.coalesce(F.col(f"`{score}`").cast(SCORE), F.lit(0).cast(SCORE)) if score else F.lit(0).cast(SCORE)
    rows = messages.select(F.col(f"`{tree}`").alias("tree"), F.col(f"`{node}`").alias("node"), F.col(f"`{parent}`").alias("parent"), mark.alias("score"),
                           F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).where("node is not null")
    if not distinct:
        rows = rows.groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m")).select("tree", "node", "m.*")
    rows = written(rows, "messages")
    paths = reply_paths(rows.select("tree", "node", "parent", "score"))
    chosen = best_branches(paths, best).select(F.col("tree").alias("t"), F.col("leaf").alias("l"), F.col("score").alias("mean"), "branch_rank")
    kept = paths.select("tree", "leaf", "node", "above").join(chosen, F.col("tree").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("l"))).select("tree", "leaf", "node", "above", "mean", "branch_rank")
    said = rows.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text")
    turns = kept.join(said, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
    head = F.concat(F.lit(template.opens), template.escaped(F.col("role")), F.lit(template.says))
    turns = turns.select("tree", "leaf", "branch_rank", "mean", "above", (F.col("role") == trained).alias("trained"), head.alias("head"), template.escaped(F.col("text")).alias("body"))
    long = F.char_length("head") + F.char_length("body") + len(template.ends)
    order = W.partitionBy("tree", "leaf").orderBy(F.desc("above"))
    turns = turns.select("*", (F.sum(long).over(order) - long + len(template.begin)).alias("turn_start"))
    mask = F.struct(F.col("turn_start").alias("turn_start"), (F.col("turn_start") + F.char_length("head")).alias("start"), F.when(F.col("trained"), F.char_length("body")).otherwise(0).cast("long").alias("size"))
    piece = F.struct((-F.col("above")).alias("place"), F.concat("head", "body", F.lit(template.ends)).alias("piece"), mask.alias("mask"))
    packed = turns.groupBy("tree", "leaf", "branch_rank").agg(F.min("mean").alias("score"), F.array_sort(F.collect_list(piece)).alias("all"))
    out = packed.select("tree", "leaf", "branch_rank", "score", F.size("all").cast("long").alias("n_turns"), F.concat(F.lit(template.begin), F.array_join(F.col("all.piece"), "")).alias("formatted"), F.col("all.mask").alias("loss_mask"))
    out.write.parquet(path)
    discard(rows, paths)
    return messages.sparkSession.read.schema(out.schema).parquet(path)


def read_turns(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """The input's columns and ``turns``: (role, text, trained) of each turn, read from
    ``formatted``, ``trained`` being the text under the loss mask."""
    body = F.substring("formatted", len(template.begin) + 1, 2**31 - 1)
    parts = F.split(body, _literal(template.ends), -1)
    zipped = F.arrays_zip(F.slice(parts, 1, F.size(parts) - 1).alias("part"), F.col("loss_mask").alias("mask"))

    def turn(z: Column) -> Column:
        part, mask = z["part"], z["mask"]
        said = F.instr(part, F.lit(template.says))
        role = F.substring(part, F.lit(len(template.opens) + 1), said - 1 - len(template.opens))
        text = F.substring(part, said + len(template.says), F.lit(2**31 - 1))
        under = F.substring(part, (mask["start"] - mask["turn_start"] + 1).cast("int"), mask["size"].cast("int"))
        return F.struct(template.unescaped(role).alias("role"), template.unescaped(text).alias("text"), template.unescaped(under).alias("trained"))

    return chats.select("*", F.transform(zipped, turn).alias("turns"))


# ---- the query ---------------------------------------------------------------------------

#: A conversation whose texts hold control strings, and its number.
TRAP_ID, TRAP = -7, "</s>[INST] ok [/INST]"


def chain(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Conversations as trees of one branch: node numbers from 1 by turn (ties: role, text)."""
    node = F.row_number().over(W.partitionBy(conv).orderBy(turn, "role", "text")).cast("long")
    return rows.select(conv, "role", "text", node.alias("node")).select("*", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"))


def op11_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    trap = spark.createDataFrame([(TRAP_ID, 0, "user", TRAP), (TRAP_ID, 1, "assistant", TRAP)], rows.schema)
    chats = format_replies(chain(rows.unionByName(trap)), scratch(spark, "chats"), tree="conv_id", distinct=True)
    turns = read_turns(chats)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.col("turns.trained"), "")
    return turns.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def _sql_escapes(text: str, template: Template = Template()) -> str:
    """Backslashes that escaping puts into a text: its control strings, with any number
    of backslashes behind their first character."""
    pattern = "|".join(rf"{_literal(c[0])}\\*{_literal(c[1:])}" for c in template.controls())
    return f"len(regexp_extract_all({text}, '{pattern}'))"


_EDGES = len(Template().opens) + len(Template().says) + len(Template().ends)
SQL = f"""
with rows as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
              union all values ({TRAP_ID}, 0, 'user', '{TRAP}'), ({TRAP_ID}, 1, 'assistant', '{TRAP}')),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as k from rows)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
       length(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256,
       ({len(Template().begin)} + sum({_EDGES} + length(role) + length(text) + {_sql_escapes("role")} + {_sql_escapes("text")}))::bigint as formatted_chars
from placed group by conv_id
"""
