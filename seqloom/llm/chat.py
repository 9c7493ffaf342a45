"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Each conversation becomes one formatted text; each assistant turn becomes one example whose context is all text before
it and whose reply alone is trainable. An example carries its place in the formatted text, not a copy of its context, so
a conversation of n turns takes space in proportion to n; ``with_contexts`` writes the contexts out where they are wanted.

Template: ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n`` for each turn. Inside roles and texts every ``<|`` becomes ``<||``, and
a line feed in a role becomes ``<|nl|>``, so markers never occur inside a turn and both can be undone exactly.

Defined cases: null text or role counts as empty; a null conv_id is a conversation of its own; rows are in order of turn
(null first), then role, then text, so ties and repeated rows have a fixed order and all are kept; a conversation without
an assistant has no examples and an empty mask; other columns are not read; an empty table gives an empty one.

Turns are first put together in blocks of ``BLOCK`` turn numbers, then blocks in conversations, so the task that
ends a very long conversation reads a row for each block, not for each turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
BLOCK = 64


def escaped(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def unescaped(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def format_conversations(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, formatted string, replies array<struct<start long, chars long>>: where the trainable spans are.

    ``start`` counts code points from 0 in ``formatted``; a span holds the escaped reply without its end marker.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(START), F.replace(escaped(role), F.lit("\n"), F.lit("<|nl|>")), F.lit("\n"))
    one = turns.select(
        "conv_id",
        F.floor(F.col("turn") / block).alias("block"),
        F.col("turn").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        head.alias("head"),
        escaped(text).alias("body"),
    )
    rows = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    upto = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)  # by rows: repeated rows are peers of a range
    placed = one.select(
        "conv_id",
        "block",
        F.row_number().over(rows).alias("at"),
        F.concat("head", "body", F.lit(END)).alias("formatted"),
        F.when(F.col("role") == "assistant", F.struct(F.char_length("head").cast("long").alias("skip"), F.char_length("body").cast("long").alias("chars"))).alias("reply"),
        (F.sum(F.char_length("head") + F.char_length("body") + len(END)).over(upto)).alias("upto"),
    )
    blocks = (
        placed.groupBy("conv_id", "block")
        .agg(F.array_sort(F.collect_list(F.struct("at", "formatted", "reply", "upto"))).alias("turns"))
        .select(
            "conv_id",
            "block",
            F.array_join(F.transform("turns", lambda t: t["formatted"]), "").alias("formatted"),
            F.transform(
                F.filter("turns", lambda t: t["reply"].isNotNull()),
                lambda t: F.struct((t["upto"] - F.char_length(t["formatted"]) + t["reply"]["skip"]).alias("start"), t["reply"]["chars"].alias("chars")),
            ).alias("replies"),
            F.element_at("turns", -1)["upto"].alias("chars"),
        )
    )
    before = F.sum("chars").over(Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("chars")
    based = blocks.withColumn("base", before)
    return (
        based.select("conv_id", F.struct("base", "formatted", F.transform("replies", lambda r: F.struct((r["start"] + F.col("base")).alias("start"), r["chars"].alias("chars"))).alias("replies")).alias("b"))
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("b")).alias("b"))
        .select("conv_id", F.array_join(F.transform("b", lambda x: x["formatted"]), "").alias("formatted"), F.flatten(F.transform("b", lambda x: x["replies"])).alias("replies"))
    )


def masked(text: Column, spans: Column) -> Column:
    """array<string>: the stretch of text under each span of the loss mask, in order.

    Spans are cut from about sqrt(n) stretches of as many spans each, so the whole text is walked sqrt(n) times, not n times.
    """
    n = F.size(spans)
    many = F.ceil(F.sqrt(F.greatest(n, F.lit(1)))).cast("int")

    def stretch(own: Column) -> Column:
        start, last = own[0]["start"], F.element_at(own, -1)
        whole = F.substr(text, (start + 1).cast("int"), (last["start"] + last["chars"] - start).cast("int"))
        return F.flatten(F.transform(F.array(whole), lambda w: F.transform(own, lambda s: F.substr(w, (s["start"] - start + 1).cast("int"), s["chars"].cast("int")))))

    groups = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)), many), lambda i: F.slice(spans, i, many))
    return F.flatten(F.transform(F.filter(groups, lambda g: F.size(g) > 0), stretch))


def expand_examples(conversations: DataFrame, *columns: str) -> DataFrame:
    """One row for each assistant turn: conv_id, example, context_chars, reply_chars, reply (escaped), read through the spans.

    A conversation without an assistant gives one row without an example if more ``columns`` are asked for.
    """
    explode = F.posexplode_outer if columns else F.posexplode
    zipped = F.arrays_zip(F.col("replies").alias("span"), masked(F.col("formatted"), F.col("replies")).alias("reply"))
    return conversations.select("conv_id", *columns, explode(zipped).alias("example", "x")).select(
        "conv_id", *columns, "example", F.col("x.span.start").alias("context_chars"), F.col("x.span.chars").alias("reply_chars"), F.col("x.reply").alias("reply")
    )


def with_contexts(conversations: DataFrame) -> DataFrame:
    """The examples with their whole contexts written out (their size grows with the square of a conversation's turns)."""
    spans = conversations.select("conv_id", "formatted", F.posexplode("replies").alias("example", "span"))
    start = F.col("span.start").cast("int")
    return spans.select(
        "conv_id",
        "example",
        F.substr("formatted", F.lit(1), start).alias("context"),
        F.concat(F.substr("formatted", start + 1, F.col("span.chars").cast("int")), F.lit(END)).alias("target"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted text, with escapes undone."""
    parts = F.split(formatted, r"<\|im_end\|>\n")
    whole = F.filter(parts, lambda t, i: i < F.size(parts) - 1)
    return F.transform(
        whole,
        lambda t: F.struct(
            unescaped(F.replace(F.substring_index(F.substr(t, F.lit(len(START) + 1)), "\n", 1), F.lit("<|nl|>"), F.lit("\n"))).alias("role"),
            unescaped(F.substr(t, F.instr(t, F.lit("\n")) + 1)).alias("text"),
        ),
    )


def chat_digests(turns: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted texts and the examples: turns, text under the loss mask and their digests.

    ``spans_ok`` is true if what the spans cut out is what the assistant's turns say, read back by their markers.
    """
    done = format_conversations(turns).withColumn("turns", read_turns(F.col("formatted")))
    said = F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"])
    known = done.select(
        "conv_id",
        "formatted",
        "replies",
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")), 256).alias("turns_sha256"),
        F.sha2(F.array_join(said, ""), 256).alias("said_sha256"),
    )
    kept = ["n_turns", "turns_sha256", "formatted_chars", "said_sha256"]
    examples = expand_examples(known, *kept)
    reply = F.when(F.col("example").isNotNull(), F.struct("example", unescaped(F.col("reply")).alias("reply")))
    loss = F.array_join(F.transform(F.array_sort(F.collect_list(reply)), lambda r: r["reply"]), "")
    return (
        examples.groupBy("conv_id")
        .agg(*[F.first(k).alias(k) for k in kept], loss.alias("loss"), F.count("example").alias("n_examples"))
        .select("conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples", (F.sha2("loss", 256) == F.col("said_sha256")).alias("spans_ok"))
    )
