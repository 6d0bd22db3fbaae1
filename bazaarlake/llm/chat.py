"""Chat formatting in budgeted windows, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlake.llm.common import id_key, id_of, with_offsets

#: The markers of the template. All begin with "<|", which no escaped text contains.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Where control strings begin, those of this template and those of other common ones.
CONTROL = r"<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])"

#: Tokens of a window, and of these the most for the system turn and for repeated history.
BUDGET, FOR_SYSTEM, FOR_HISTORY = 2048, 512, 256
#: What a turn's markers count, and turn numbers summed at a time.
MARKERS, TURNS = 4, 256


def escape(text: Column) -> Column:
    """Breaks control strings: a backslash is doubled, and one is put behind the first character of each."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def n_tokens(text: Column) -> Column:
    """Words and single other characters, with the markers of a turn."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")) + F.lit(MARKERS)


def _formatted(turn: Column) -> Column:
    return F.concat(F.lit(TURN), turn["role"], F.lit(TEXT), turn["text"], F.lit(END))


def windows(
    conversations: DataFrame, budget: int = BUDGET, for_system: int = FOR_SYSTEM, for_history: int = FOR_HISTORY
) -> DataFrame:
    """Conversations as formatted windows of whole turns with a loss mask.

    Prefix sums of the turns' tokens decide everything: turns whose sums begin in the same stretch of half
    the free budget are one span, and a turn longer than such a stretch is a span of its own. So a window,
    which is the system turn, the last turns of the span before as far as ``for_history`` reaches, and the
    span, keeps to the budget unless its system turn or a single turn alone is too long for it
    (``over_budget``). Each assistant turn is under the loss mask of the one window whose span has it;
    repeated ones are masked.

    The sums are made in pieces of a conversation, and spans are grouped, so a conversation of any length is
    spread over many tasks.

    Returns id, window (number of its first new turn), n_context (turns that are repeated), has_system, text,
    loss (array of start, from 0, and length in code points), n_tokens, over_budget. Turns go by their
    number; ties by role and text; NULL numbers come first. NULL role or text is empty. NULL ids are one
    conversation. A conversation of one turn is one window, whatever its role. An empty table gives none.
    """
    stretch = (budget - for_system - for_history) // 2
    if stretch < 1:
        raise ValueError("the budget leaves no room for turns")
    turns = conversations.select(
        id_key("conv_id").alias("id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-(2**63))).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumns({"tokens": n_tokens(F.col("text")), "piece": F.floor(F.col("turn") / F.lit(TURNS))})
    long = F.col("tokens") > stretch
    placed = with_offsets(
        turns,
        ["id"],
        "piece",
        [F.col("turn"), F.col("role"), F.col("text")],
        {"turns": F.lit(1), "tokens": F.col("tokens"), "long": long.cast("long")},
    ).withColumn("is_system", (F.col("turns_before") == 0) & (F.col("role") == "system") & (F.col("turns_total") > 1))
    one = F.struct(
        F.col("turns_before").alias("at"),
        F.col("tokens_before").alias("start"),
        "tokens",
        escape(F.col("role")).alias("role"),
        escape(F.col("text")).alias("text"),
        (F.col("role") == "assistant").alias("target"),
    )
    spans = (
        placed.where(~F.col("is_system"))
        .groupBy("id", F.floor(F.col("tokens_before") / F.lit(stretch)).alias("stretch"), "long_before", long.alias("long"))
        .agg(F.sort_array(F.collect_list(one)).alias("new"), F.sum("tokens").alias("new_tokens"))
        .withColumn("start", F.col("new")[0]["start"])
        .withColumn("stop", F.col("start") + F.col("new_tokens"))
    )
    # A span's history is the end of the span that stops where it starts.
    before = spans.select(
        F.col("id").alias("_id"),
        F.col("stop").alias("_stop"),
        F.filter("new", lambda t: t["start"] >= F.col("stop") - for_history).alias("history"),
    )
    system = placed.where("is_system").select(F.col("id").alias("_sid"), F.array(one).alias("system"))
    none = F.filter("new", lambda _: F.lit(False))
    joined = (
        spans.join(before, (F.col("id") == F.col("_id")) & (F.col("start") == F.col("_stop")), "left")
        .join(system, F.col("id") == F.col("_sid"), "left")
        .withColumn("context", F.concat(F.coalesce("system", none), F.coalesce("history", none)))
    )
    tokens = F.aggregate("context", F.col("new_tokens"), lambda n, t: n + t["tokens"])
    lengths = lambda turns: F.transform(turns, lambda t: F.length(_formatted(t)).cast("long"))
    total = lambda turns: F.aggregate(lengths(turns), F.lit(0).cast("long"), lambda n, x: n + x)
    mask = F.aggregate(
        "new",
        F.struct(total(F.col("context")).alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("loss")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(_formatted(t))).alias("at"),
            F.when(
                t["target"],
                F.concat(
                    acc["loss"],
                    F.array(
                        F.struct(
                            (acc["at"] + F.length(F.concat(F.lit(TURN), t["role"], F.lit(TEXT)))).alias("start"),
                            F.length(t["text"]).cast("long").alias("length"),
                        )
                    ),
                ),
            )
            .otherwise(acc["loss"])
            .alias("loss"),
        ),
    )["loss"]
    return joined.select(
        "id",
        F.col("new")[0]["at"].alias("window"),
        F.size("context").alias("n_context"),
        F.col("system").isNotNull().alias("has_system"),
        F.array_join(F.transform(F.concat("context", "new"), _formatted), "").alias("text"),
        mask.alias("loss"),
        tokens.alias("n_tokens"),
        (tokens > budget).alias("over_budget"),
    )


def read_back(windows_: DataFrame) -> DataFrame:
    """Of every window, from its text and mask alone: new turns (role, text) and the texts under the mask.

    The first window of a conversation with a system turn counts that turn as new.
    """
    parsed = F.transform(
        F.slice(F.split("text", r"<\|end\|>", -1), 1, F.size(F.split("text", r"<\|end\|>", -1)) - 1),
        lambda t: F.struct(
            unescape(F.substring_index(F.substring_index(t, TEXT, 1), TURN, -1)).alias("role"),
            unescape(F.substring_index(t, TEXT, -1)).alias("text"),
        ),
    )
    first = F.col("has_system") & (F.col("window") == 1)
    return windows_.select(
        "id",
        "window",
        parsed.alias("turns"),
        F.when(first, F.lit(0)).otherwise(F.col("n_context")).alias("skip"),
        F.transform(
            "loss", lambda s: unescape(F.substring(F.col("text"), s["start"].cast("int") + 1, s["length"].cast("int")))
        ).alias("targets"),
        F.length("text").cast("long").alias("chars"),
    ).select(
        "id", "window", F.filter("turns", lambda t, i: i >= F.col("skip")).alias("turns"), "targets", "chars"
    )


def conversation_digests(windows_: DataFrame) -> DataFrame:
    """One row per conversation, read back from its windows.

    A digest is of a conversation's whole text, so here, unlike in ``windows``, a conversation's rows meet.
    """
    gathered = (
        read_back(windows_)
        .groupBy("id")
        .agg(
            F.sort_array(F.collect_list(F.struct("window", "turns", "targets"))).alias("all"),
            F.sum("chars").alias("formatted_chars"),
        )
        .withColumn("turns", F.flatten(F.transform("all", lambda w: w["turns"])))
        .withColumn("loss", F.array_join(F.flatten(F.transform("all", lambda w: w["targets"])), ""))
    )
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return gathered.select(
        id_of("id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
