"""Operator 4: chat formatting of reply trees.

Messages name the message they answer. Messages with one answer each are first drawn together into runs, by pointer
doubling (a self-join a round, as many rounds as the logarithm of the longest run). The paths from the roots are then
enumerated by self-joins of runs, a round for each branching. Branches are ranked by the sum of their messages' scores
and each chosen path is formatted as one conversation.

The template marks a turn as <|turn|>role<|text|>text<|end|>. In roles and texts each "<", any backslashes and "|"
gets one backslash more, so no text holds a mark, and taking one away gives the text back.

Defined results: a null text or role is the empty string, a null score 0. A tree id may be null. A message whose parent
is missing, or null, is a root. Messages on a cycle are reached from no root and belong to no path. Rows of linear
conversations that share a turn are ordered by role and text; repeated rows are turns of their own. Repeated message
ids of one tree are refused with a ValueError (null ids too, unless alone); linear() numbers rows itself. An empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm.common import checkpoint, let

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*+)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def linear(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Conversations by turn as reply trees of one path: tree, id, parent, role, text, score."""
    order = Window.partitionBy(id_col).orderBy(turn_col, "role", "text")
    numbered = rows.select(F.col(id_col).alias("tree"), "role", "text", F.row_number().over(order).cast("long").alias("id"))
    return numbered.select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _tree(a: DataFrame, b: DataFrame, left: str, right: str) -> Column:
    return a["tree"].eqNullSafe(b["tree"]) & (a[left] == b[right])


def runs(messages: DataFrame) -> DataFrame:
    """tree, id, head, place, up, children: each message's run (its first message), its place there, what that answers, and its answers."""
    own = messages.select("tree", "id", "parent")
    kids = own.where("parent is not null").groupBy("tree", "parent").agg(F.count("*").alias("n")).select(F.col("tree").alias("kt"), F.col("parent").alias("kp"), "n")
    own = own.join(kids, own["tree"].eqNullSafe(kids["kt"]) & (own["id"] == kids["kp"]), "left").select("tree", "id", "parent", F.coalesce("n", F.lit(0)).alias("children"))
    up = own.select(F.col("tree").alias("ut"), F.col("id").alias("ui"), F.col("children").alias("un"))
    own = own.join(up, own["tree"].eqNullSafe(up["ut"]) & (own["parent"] == up["ui"]), "left")
    known = F.when(F.col("ui").isNotNull(), F.col("parent"))  # a missing parent is none
    # link: where the pointer leads, while that is in the same run
    own = checkpoint(own.select("tree", "id", known.alias("parent"), "children", F.when(F.col("un") == 1, known).alias("link"), F.when(F.col("un") == 1, 1).otherwise(0).cast("long").alias("place"), F.when(F.col("un") == 1, known).otherwise(F.col("id")).alias("head")))
    left = own.where("link is not null").count()
    while left:  # only messages that haven't reached the head of their run go on
        to = own.select(F.col("tree").alias("tt"), F.col("id").alias("ti"), F.col("link").alias("tl"), F.col("place").alias("tp"), F.col("head").alias("th"))
        on = own.where("link is not null").join(to, own["tree"].eqNullSafe(to["tt"]) & (own["link"] == to["ti"]))
        on = on.select("tree", "id", "parent", "children", F.col("tl").alias("link"), (F.col("place") + F.col("tp")).alias("place"), F.col("th").alias("head"))
        own = checkpoint(own.where("link is null").union(on))
        now = own.where("link is not null").count()
        if now == left:  # only cycles are left: they have no head
            own = checkpoint(own.where("link is null"))
            break
        left = now
    return own.select("tree", "id", "parent", "children", "head", "place")


def paths(messages: DataFrame) -> DataFrame:
    """tree, leaf, depth and head: the runs on the path from the root to each leaf, in order."""
    own = runs(messages)
    heads = own.where("id = head").select("tree", "head", F.col("parent").alias("up"))
    tails = own.where("children <> 1").select("tree", "head", F.col("id").alias("tail"), (F.col("children") == 0).alias("leaf"))
    t = tails.select(F.col("tree").alias("tt"), F.col("head").alias("th"), "tail", "leaf")
    whole = checkpoint(heads.join(t, heads["tree"].eqNullSafe(t["tt"]) & (heads["head"] == t["th"])).select("tree", "head", "up", "tail", "leaf"))
    front = whole.where("up is null").select("tree", "tail", "leaf", F.array("head").alias("heads"))
    found = front.where("leaf")
    front = checkpoint(front.where("not leaf"))
    later = whole.where("up is not null").select(F.col("tree").alias("lt"), "up", F.col("head").alias("next"), F.col("tail").alias("end"), F.col("leaf").alias("last"))
    while front.limit(1).count():
        front = checkpoint(front.join(later, front["tree"].eqNullSafe(later["lt"]) & (front["tail"] == later["up"])).select("tree", F.col("end").alias("tail"), F.col("last").alias("leaf"), F.concat("heads", F.array("next")).alias("heads")))
        found, front = found.union(front.where("leaf")), front.where("not leaf")
    steps = found.select("tree", F.col("tail").alias("leaf"), F.posexplode("heads").alias("depth", "head"))
    return steps, own


def format_trees(messages: DataFrame, best: int | None = None, trained: tuple[str, ...] = ("assistant",), unique: bool = False) -> DataFrame:
    """tree, rank, leaf, score, n_turns, formatted and spans (start and size, in code points, of what the loss is on).

    messages: tree, id, parent, role, text, score. best: branches that are chosen of each tree; None: all. unique: ids
    are known not to repeat, as those of linear() are.
    """
    if not unique and messages.groupBy("tree", "id").count().where("count > 1").limit(1).count():
        raise ValueError("a message id repeats in its tree")
    steps, own = paths(messages)
    s = steps.select(F.col("tree").alias("st"), "leaf", "depth", F.col("head").alias("sh"))
    on = own.join(s, own["tree"].eqNullSafe(s["st"]) & (own["head"] == s["sh"])).select("tree", "leaf", "id", "depth", "place")
    m = messages.select(F.col("tree").alias("mt"), F.col("id").alias("mi"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    turns = on.join(m, on["tree"].eqNullSafe(m["mt"]) & (on["id"] == m["mi"])).select("tree", "leaf", "depth", "place", "role", "text", "score")
    if best is not None:
        ranked = turns.groupBy("tree", "leaf").agg(F.sum("score").alias("sum")).withColumn("r", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("sum"), "leaf"))).where(F.col("r") <= best)
        k = ranked.select(F.col("tree").alias("kt"), F.col("leaf").alias("kl"))
        turns = turns.join(k, turns["tree"].eqNullSafe(k["kt"]) & (turns["leaf"] == k["kl"]), "left_semi")
    before = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    part = F.struct("depth", "place", F.col("score"), before.alias("before"), escape(F.col("text")).alias("text"), F.col("role").isin(*trained).alias("loss"))
    whole = turns.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(part)).alias("turns"), F.sum("score").alias("score"))
    lengths = F.transform("turns", lambda t: F.struct(F.length(t["before"]).alias("b"), F.length(t["text"]).alias("t"), t["loss"].alias("loss")))

    def step(at: Column, x: Column) -> Column:
        start = at["end"] + x["b"]
        span = F.array(F.struct(start.alias("start"), x["t"].alias("size")))
        return F.struct((start + x["t"] + len(END)).alias("end"), F.when(x["loss"], F.concat(at["spans"], span)).otherwise(at["spans"]).alias("spans"))

    spans = F.aggregate(lengths, F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,size:int>>").alias("spans")), step)["spans"]
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["before"], t["text"], F.lit(END))), "")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
    return whole.select("tree", rank.alias("rank"), "leaf", "score", F.size("turns").cast("long").alias("n_turns"), formatted.alias("formatted"), spans.alias("spans"))


def read_turns(formatted: Column) -> Column:
    """The turns (role and text) that a formatted conversation holds."""
    marked = F.filter(F.split(formatted, r"<\|end\|>"), lambda x: x != "")
    both = F.transform(marked, lambda x: F.split(F.substring(x, len(TURN) + 1, 1 << 30), r"<\|text\|>"))
    return F.transform(both, lambda x: F.struct(unescape(x[0]).alias("role"), unescape(x[1]).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return let(formatted, lambda f: F.array_join(F.transform(spans, lambda s: unescape(f.substr(s["start"] + 1, s["size"]))), ""))


#: What op4_chat_trees returns, as DuckDB SQL.
ORACLE_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, length(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + 23 AS chars FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
