"""Chat formatting: multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant and the others
as named users; the mask is 1 on what the assistant says, 0 elsewhere, given as character spans of the rendered text.
Speakers are those of all roles but ``system``, whose turns stay system turns in every rendering.

A rendering is one row.  Only where it is longer than ``part_chars`` characters does it go on in further rows, cut between
turns; ``part`` numbers them, ``start`` is a row's place in the whole rendering, spans count from the beginning of the whole, and the
rows' texts joined in order are the whole.  Turns are ordered by one range partitioning of the table, so that an
endless conversation spreads over many tasks; where a turn begins is the sum of the lengths before it, added up first for
each stretch of a conversation in a partition and then inside it.  What a perspective changes is the heads of its own turns,
so its places follow from the number of these before.

Defined results: a null text is empty; a null role is a participant named ``unknown``; a null turn comes first; turns
with the same number are ordered by role and text, and repeated rows are rendered as often as they occur; a conversation
of system turns only has no participant and no row; ``<|`` in a text or role becomes ``< |``, so that neither can hold a
marker, and line breaks in a role become spaces, so that it can't end its header (roles that are equal then are one participant);
an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covaria.llm.common import materialize

SYSTEM = "system"
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
#: Longer renderings go on in further rows; Spark's rows and strings have to fit into memory.
PART_CHARS = 1 << 20
MINE, SYSTEM_HEAD, USER_HEAD = f"{OPEN}assistant{MIDDLE}", f"{OPEN}{SYSTEM}{MIDDLE}", f"{OPEN}user name="


def _plain(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, turn, role, text, size): size is the length of the turn's rendering as another's."""
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    role = F.coalesce(safe(F.regexp_replace(F.col(role_col), r"\R", " ")), F.lit("unknown"))
    plain = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), safe(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    head = F.when(F.col("role") == SYSTEM, F.lit(len(SYSTEM_HEAD))).otherwise(len(USER_HEAD) + F.length("role") + len(MIDDLE))
    return plain.withColumn("size", (head + F.length("text") + len(CLOSE)).cast("long"))


def _placed(turns: DataFrame) -> DataFrame:
    """``turns`` with their order (at), the partition they are ordered in (block), and the length of everything before them in their conversation (before)."""
    spark = turns.sparkSession
    order = ["conv_id", "turn", "role", "text", "tie"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = turns.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = materialize(spark, dealt.withColumn("block", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()).drop("tie"), "chat-turns")
    so_far = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = dealt.groupBy("conv_id", "block").agg(F.sum("size").alias("n")).select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("base"))
    inside = Window.partitionBy("conv_id", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).select("conv_id", "role", "text", "at", "block", (F.col("base") + F.col("inside")).alias("before"))


def _spans(placed: DataFrame) -> DataFrame:
    """(sc, sp, sr, spans): for each conversation, part and speaker where the speaker's own texts lie in their own rendering, in order.

    Of what comes before a turn, the speaker's own turns alone are of another length there; they are counted as the lengths are, by stretches.
    """
    own = placed.where(F.col("role") != SYSTEM).select("conv_id", "role", "block", "at", "part", "before", F.length("text").alias("n"))
    so_far = Window.partitionBy("conv_id", "role").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = own.groupBy("conv_id", "role", "block").agg(F.count("*").alias("turns")).select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("block").alias("b"), F.coalesce(F.sum("turns").over(so_far), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "role", "block").orderBy("at")) - 1
    counted = own.withColumn("inside", inside).join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("block") == F.col("b")))
    shift = len(MINE) - len(USER_HEAD) - F.length("role") - len(MIDDLE)
    start = (F.col("before") + shift * (F.col("base") + F.col("inside")) + len(MINE)).cast("long")
    ends = counted.select("conv_id", "part", "role", F.struct(start.alias("start"), (start + F.col("n")).cast("long").alias("end")).alias("span"))
    return ends.groupBy(F.col("conv_id").alias("sc"), F.col("part").alias("sp"), F.col("role").alias("sr")).agg(F.count("*").alias("times"), F.sort_array(F.collect_list("span")).alias("spans"))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_chars: int = PART_CHARS) -> DataFrame:
    """Per conversation, participant and part: where it starts, the rendered text, its turns, and the assistant's spans (start, end)."""
    spark = turns.sparkSession
    placed = _placed(_plain(turns, conv_col, turn_col, role_col, text_col)).withColumn("part", F.floor(F.col("before") / part_chars).cast("long"))
    placed = materialize(spark, placed, "chat-placed")
    # how often each participant has spoken before a part
    parts = placed.groupBy("conv_id", "part").agg(F.min("before").alias("begins"))
    speakers = placed.where(F.col("role") != SYSTEM).select(F.col("conv_id").alias("c"), F.col("role").alias("perspective")).distinct()
    every = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).join(_spans(placed), F.col("conv_id").eqNullSafe(F.col("sc")) & (F.col("part") == F.col("sp")) & (F.col("perspective") == F.col("sr")), "left")
    so_far = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = len(MINE) - len(USER_HEAD) - F.length("perspective") - len(MIDDLE)
    start = F.col("begins") + shift * F.coalesce(F.sum(F.coalesce("times", F.lit(0))).over(so_far), F.lit(0))
    views = every.select(F.col("conv_id").alias("vc"), F.col("part").alias("vp"), "perspective", start.cast("long").alias("start"), F.coalesce("spans", F.expr("CAST(array() AS array<struct<start:bigint,end:bigint>>)")).alias("spans"))
    views = views.groupBy("vc", "vp").agg(F.collect_list(F.struct("perspective", "start", "spans")).alias("views"))
    gathered = placed.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("at", "role", "text"))).alias("turns"))
    joined = gathered.join(views, F.col("conv_id").eqNullSafe(F.col("vc")) & (F.col("part") == F.col("vp"))).select("conv_id", "part", "turns", F.explode("views").alias("view")).select("conv_id", "part", "turns", "view.*")

    def piece(t):
        head = F.when(t["role"] == F.col("perspective"), F.lit(MINE)).when(t["role"] == SYSTEM, F.lit(SYSTEM_HEAD)).otherwise(F.concat(F.lit(USER_HEAD), t["role"], F.lit(MIDDLE)))
        return F.concat(head, t["text"], F.lit(CLOSE))

    return joined.select("conv_id", "perspective", "part", "start", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", piece), "").alias("rendered"), "spans")
