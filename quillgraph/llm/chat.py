"""Reply trees as conversations: paths from root to leaf by repeated self-joins of ids, branches ranked by score, and the
text of the chosen paths joined in once at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.llm.common import checkpoint


def reply_tree(conversations: DataFrame) -> DataFrame:
    """(conv_id, msg_id, parent_id, role, text, score) from conversations(conv_id, turn, role, text).

    Rows of one turn are alternatives, in order of role and text; the j-th answers the j-th of the turn before (the last
    one, if that has fewer). Equal rows are one message. Rows with a null conv_id or turn are left out, a null role is
    'user', a null text ''. msg_id numbers the messages of a conversation, score is the number of words of an
    assistant's message and 0 for others.
    """
    c = conversations.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    by = W.partitionBy("conv_id")
    c = c.select("*", F.dense_rank().over(by.orderBy("turn")).alias("level"), F.row_number().over(by.orderBy("turn", "role", "text")).alias("msg_id"))
    c = c.withColumn("j", F.row_number().over(W.partitionBy("conv_id", "level").orderBy("role", "text"))).withColumn("width", F.count("*").over(W.partitionBy("conv_id", "level")))
    above = c.select("conv_id", (F.col("level") + 1).alias("level"), F.col("j").alias("pj"), F.col("width").alias("above"), F.col("msg_id").alias("parent_id"))
    widths = above.select("conv_id", "level", "above").distinct()
    c = c.join(widths, ["conv_id", "level"], "left").withColumn("pj", F.least("j", "above"))
    c = c.join(above.drop("above"), ["conv_id", "level", "pj"], "left")
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return c.select("conv_id", F.col("msg_id").cast("long").alias("msg_id"), F.col("parent_id").cast("long").alias("parent_id"), "role", "text", F.when(F.col("role") == "assistant", words).otherwise(0).cast("long").alias("score"))


def branch_conversations(messages: DataFrame, top: int = 2) -> DataFrame:
    """(conv_id, rank, leaf_id, score, n_turns, text): the `top` best paths from root to leaf of every tree of
    messages(conv_id, msg_id, parent_id, role, text, score).

    The score of a path is the sum of its messages'; ties go to the lesser leaf. A message whose parent is null or isn't
    there is a root; one that answers itself, stands on a cycle or below one belongs to no path. Messages with a null
    conv_id or msg_id are left out; of several under one id the least (parent, role, text) counts. A null role is 'user',
    a null text '', a null score 0. Each message is written <|role|>, its text and a line end. An empty table gives no rows.

    Each self-join doubles how far a message sees towards its root, so a tree of depth d takes about log2(d) rounds, and
    the same jumps, taken from the longest down, list the messages of the chosen paths. Only ids move until the end.
    """
    m = messages.where("conv_id is not null and msg_id is not null").select("conv_id", "msg_id", "parent_id", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0)).cast("long").alias("score"))
    m = m.groupBy("conv_id", "msg_id").agg(F.min(F.struct("parent_id", "role", "text", "score")).alias("r")).select("conv_id", "msg_id", "r.*")
    m = checkpoint(m)
    there = m.select("conv_id", F.col("msg_id").alias("parent_id"), F.col("msg_id").alias("up"))
    jump = checkpoint(m.select("conv_id", "msg_id", "parent_id", "score").join(there, ["conv_id", "parent_id"], "left").select("conv_id", "msg_id", "up", F.col("score").alias("sum"), F.lit(1).alias("hops")))
    most = m.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    jumps = [jump]
    while (1 << (len(jumps) - 1)) <= most and not jumps[-1].where("up is not null").isEmpty():
        a, b = jumps[-1].alias("a"), jumps[-1].select("conv_id", F.col("msg_id").alias("up"), F.col("up").alias("up2"), F.col("sum").alias("sum2"), F.col("hops").alias("hops2"))
        jumps.append(checkpoint(a.join(b, ["conv_id", "up"], "left").select("conv_id", "msg_id", F.col("up2").alias("up"), (F.col("sum") + F.coalesce("sum2", F.lit(0))).alias("sum"), (F.col("hops") + F.coalesce("hops2", F.lit(0))).alias("hops"))))
    whole = jumps[-1].where("up is null")  # what still sees something above it hangs on a cycle
    leaves = whole.join(jump.where("up is not null").select("conv_id", F.col("up").alias("msg_id")), ["conv_id", "msg_id"], "left_anti")
    ranked = leaves.select("conv_id", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("sum"), "msg_id")).alias("rank"), F.col("msg_id").alias("leaf_id"), F.col("sum").alias("score"), "hops").where(F.col("rank") <= top)
    steps = checkpoint(ranked.select("conv_id", "rank", "leaf_id", "score", F.col("leaf_id").alias("msg_id"), F.col("hops").alias("pos")))
    for k in range(len(jumps) - 2, -1, -1):
        far = jumps[k].where("up is not null").select("conv_id", "msg_id", "up")
        more = steps.join(far, ["conv_id", "msg_id"]).select("conv_id", "rank", "leaf_id", "score", F.col("up").alias("msg_id"), (F.col("pos") - (1 << k)).alias("pos"))
        steps = checkpoint(steps.unionByName(more))
    said = steps.join(m.select("conv_id", "msg_id", "role", "text"), ["conv_id", "msg_id"]).select("conv_id", "rank", "leaf_id", "score", "pos", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n")).alias("line"))
    grouped = said.groupBy("conv_id", "rank", "leaf_id", "score").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    return grouped.select("conv_id", "rank", "leaf_id", "score", F.size("lines").alias("n_turns"), F.array_join(F.col("lines.line"), "").alias("text"))


#: The query over the table conversations, for DuckDB.
SQL = """
with recursive c0 as (
    select distinct conv_id, turn, coalesce(role, 'user') role, coalesce(text, '') text
    from conversations where conv_id is not null and turn is not null
), c1 as (
    select *, dense_rank() over (partition by conv_id order by turn) lvl, row_number() over (partition by conv_id order by turn, role, text) msg_id from c0
), c2 as (
    select *, row_number() over (partition by conv_id, lvl order by role, text) j, count(*) over (partition by conv_id, lvl) w from c1
), m as (
    select c2.conv_id, c2.msg_id, p.msg_id parent_id, c2.role, c2.text,
        case when c2.role = 'assistant' then len(list_filter(regexp_split_to_array(c2.text, '\\s+'), lambda x: x <> '')) else 0 end score
    from c2 left join c2 p on p.conv_id = c2.conv_id and p.lvl = c2.lvl - 1 and p.j = least(c2.j, p.w)
), walk as (
    select conv_id, msg_id leaf_id, score::bigint score, 1 n_turns, '<|' || role || '|>' || chr(10) || text || chr(10) said from m where parent_id is null
    union all
    select m.conv_id, m.msg_id, walk.score + m.score, n_turns + 1, said || '<|' || m.role || '|>' || chr(10) || m.text || chr(10)
    from walk join m on m.conv_id = walk.conv_id and m.parent_id = walk.leaf_id
), ranked as (
    select *, row_number() over (partition by conv_id order by score desc, leaf_id) rank
    from walk where not exists (select 1 from m where m.conv_id = walk.conv_id and m.parent_id = walk.leaf_id)
)
select conv_id, rank::integer as rank, leaf_id, score::bigint as score, n_turns::integer as n_turns, said as text from ranked where rank <= 2
"""
