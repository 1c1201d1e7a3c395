"""Conversations as training windows under a token budget.

A window holds the system turn, some history that is repeated from before, and the window's own turns. Every turn
is some window's own exactly once; the loss covers own assistant turns only, so a repeated one is masked.

Windows follow from prefix sums. With P the tokens of a conversation up to and with a turn, the turn belongs to
step ceil(P / stride), and only a turn that reaches over a step's start can make its window longer than the
stride. Where such a turn is too long to share a window it gets one of its own. Prefix sums are taken in blocks of
turns and carried over blocks, so a huge conversation is not summed in one task.

Marks: ``<|im_start|>role\\ntext<|im_end|>\\n``. In texts and roles ``&`` becomes ``&amp;`` and ``<|`` becomes
``&lt;|``, in roles a line end becomes ``&#10;``; the way back is exact, and no text can hold a mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmetrics.llm.shared import written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
BUDGET, HISTORY = 2048, 256
BLOCK = 256
CONV = ["_conv", "_no_conv"]


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("&#10;"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def tokens(text: Column) -> Column:
    """Words and single signs, and four for a turn's marks: the default measure of the budget."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")).cast("long") + 4


def placed_turns(conversations: DataFrame, budget: int, history: int, measure=tokens) -> DataFrame:
    """Every turn with its prefix sums, its window (_step, _part) and whether it is the system turn.

    Turns are in order of turn (null first), role and text; null roles and texts are empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    turns = conversations.select(
        F.coalesce(F.col("conv_id"), F.lit(0)).cast("long").alias("_conv"),
        F.col("conv_id").isNull().alias("_no_conv"),
        F.col("turn").cast("long").alias("_turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("_role"),
        text.alias("_text"),
        measure(text).alias("_len"),
    ).withColumn("_block", F.coalesce(F.floor(F.col("_turn") / BLOCK), F.lit(-(2**62))).cast("long"))
    in_block = Window.partitionBy(*CONV, "_block").orderBy("_turn", "_role", "_text")
    turns = turns.withColumns({
        "_in": F.sum("_len").over(in_block.rowsBetween(Window.unboundedPreceding, 0)),
        "_first": F.row_number().over(in_block) == 1,
    })
    blocks = turns.groupBy(*CONV, "_block").agg(
        F.sum("_len").alias("_sum"),
        F.max(F.when(F.col("_first") & (F.col("_role") == "system"), F.col("_len"))).alias("_system"),
    )
    in_conv = Window.partitionBy(*CONV).orderBy("_block")
    free = F.greatest(F.lit(budget - history) - F.col("_system_len"), F.lit(max(budget // 4, 2)))
    blocks = blocks.select(
        *CONV,
        "_block",
        F.coalesce(F.sum("_sum").over(in_conv.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_carry"),
        F.coalesce(F.first("_system").over(in_conv), F.lit(0)).alias("_system_len"),
        (F.row_number().over(in_conv) == 1).alias("_opens"),
    ).withColumn("_free", free)
    turns = turns.join(blocks, [*CONV, "_block"])
    stride = F.floor(F.col("_free") / 2)
    turns = turns.withColumns({
        "_end": F.col("_carry") + F.col("_in"),
        "_start": F.col("_carry") + F.col("_in") - F.col("_len"),
        "_is_system": F.col("_opens") & F.col("_first") & (F.col("_role") == "system"),
        "_stride": stride,
    }).withColumn("_step", F.floor((F.col("_end") - 1) / F.col("_stride")))
    over = F.col("_start") < F.col("_step") * F.col("_stride")
    alone = over & (F.col("_len") > F.col("_free") - F.col("_stride"))
    # A step holds fewer turns than its stride has tokens, since every turn has some.
    of_step = Window.partitionBy(*CONV, "_step")
    return turns.withColumn("_alone", alone).withColumn(
        "_part", F.when(~F.col("_alone") & F.max("_alone").over(of_step), F.lit(1)).otherwise(F.lit(0))
    )


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, measure=tokens) -> DataFrame:
    """Formatted windows: conv_id, step and part (their order), text, loss, n_repeated, n_tokens.

    ``loss`` lists the spans (from, length; code points) of own assistant texts. The first ``n_repeated`` turns of
    the text are the system turn and history repeated from earlier windows. A window stays within the budget unless
    a single turn, with the system turn, is longer; no turn is cut. Conversations of a null id form one; equal
    rows are turns of their own; empty tables give none.
    """
    if not 0 <= history <= budget // 2:
        raise ValueError("history must lie between 0 and half the budget")
    turns = written(placed_turns(conversations, budget, history, measure), "turns")
    window = [*CONV, "_step", "_part"]
    piece = ["_role", "_text", "_len", "_turn"]
    own = turns.select(*window, F.lit(2).alias("_kind"), "_start", *piece)
    starts = turns.groupBy(*window).agg(
        F.min("_start").alias("_from"), F.max("_is_system").alias("_has_system")
    )
    # A turn may be repeated in windows that begin at its end or up to ``history`` tokens after its start.
    past = turns.filter(~F.col("_is_system") & (F.col("_len") <= history)).select(
        *CONV,
        "_start",
        "_end",
        *piece,
        F.explode(
            F.sequence(
                F.floor(F.col("_end") / F.col("_stride")),
                F.floor((F.col("_start") + history + F.col("_stride")) / F.col("_stride")),
            )
        ).alias("_at"),
    )
    near = starts.join(
        turns.groupBy(*CONV).agg(F.max("_stride").alias("_conv_stride")), CONV
    ).withColumn("_at", F.floor(F.col("_from") / F.col("_conv_stride")))
    repeated = past.join(near, [*CONV, "_at"]).filter(
        (F.col("_end") <= F.col("_from")) & (F.col("_from") - F.col("_start") <= history)
    ).select(*window, F.lit(1).alias("_kind"), "_start", *piece)
    system = turns.filter("_is_system").select(*CONV, "_start", *piece)
    kept = starts.filter(~F.col("_has_system")).join(system, CONV).select(
        *window, F.lit(0).alias("_kind"), "_start", *piece
    )
    pieces = own.unionByName(repeated).unionByName(kept)
    head = F.concat(F.lit(OPEN), escaped_role(F.col("_role")), F.lit("\n"))
    pieces = pieces.select(
        *window,
        F.struct(
            F.col("_kind").alias("kind"),
            F.col("_start").alias("at"),
            F.length(head).alias("head"),
            F.concat(head, escaped(F.col("_text")), F.lit(CLOSE)).alias("text"),
            F.col("_len").alias("len"),
            ((F.col("_kind") == 2) & (F.col("_role") == "assistant")).alias("target"),
        ).alias("piece"),
    )
    grouped = pieces.groupBy(*window).agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    empty = F.array().cast("array<struct<from:int,len:int>>")
    seed = F.struct(F.lit(0).alias("at"), empty.alias("loss"))

    def take(done: Column, p: Column) -> Column:
        size = F.length(p["text"])
        span = F.struct((done["at"] + p["head"]).alias("from"), (size - p["head"] - len(CLOSE)).alias("len"))
        return F.struct(
            (done["at"] + size).alias("at"),
            F.when(p["target"], F.concat(done["loss"], F.array(span))).otherwise(done["loss"]).alias("loss"),
        )

    return grouped.select(
        F.when(~F.col("_no_conv"), F.col("_conv")).alias("conv_id"),
        F.col("_step").alias("step"),
        F.col("_part").alias("part"),
        F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("text"),
        F.aggregate("pieces", seed, take, lambda done: done["loss"]).alias("loss"),
        F.size(F.filter("pieces", lambda p: p["kind"] < 2)).alias("n_repeated"),
        F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["len"]).alias("n_tokens"),
    )


def read_back(text: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    segments = F.filter(F.split(text, r"<\|im_start\|>"), lambda s: s != "")

    def turn(s: Column) -> Column:
        role = F.substring_index(s, "\n", 1)
        body = F.substring(s, F.length(role) + 2, F.length(s) - F.length(role) - 1 - len(CLOSE))
        return F.struct(unescaped_role(role).alias("role"), unescaped(body).alias("text"))

    return F.transform(segments, turn)


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: turns and loss text as SHA-256, and their counts.

    The digest of a whole conversation needs its text in one row; the windows themselves do not.
    """
    all_turns = read_back(F.col("text"))
    own = F.filter(all_turns, lambda t, i: i >= F.col("n_repeated"))
    loss = F.transform("loss", lambda s: unescaped(F.substring(F.col("text"), s["from"] + 1, s["len"])))
    parts = formatted.withColumn("_own", own).select(
        "conv_id",
        F.struct(
            "step",
            "part",
            F.array_join(F.transform("_own", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
            F.array_join(loss, "").alias("loss"),
        ).alias("w"),
        F.size("_own").cast("long").alias("n"),
        F.length("text").cast("long").alias("chars"),
    )
    each = parts.groupBy("conv_id").agg(
        F.sort_array(F.collect_list("w")).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars")
    )
    turns_text = F.array_join(F.transform("w", lambda w: w["turns"]), "")
    loss_text = F.array_join(F.transform("w", lambda w: w["loss"]), "")
    return each.withColumn("_loss", loss_text).select(
        "conv_id",
        "n_turns",
        F.sha2(turns_text.cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
