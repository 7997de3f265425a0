"""Chat formatting by prefix-target expansion: one example per assistant turn."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The control strings of the template.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPE = r"([<\[])(\\*)(/?s>|/?INST\]|<?/?SYS>>)"
_UNESCAPE = r"([<\[])\\(\\*)(/?s>|/?INST\]|<?/?SYS>>)"
_TURN = r"(?s)\[INST\] .*? \[/INST\]|<<SYS>>.*?<</SYS>>|.*?</s>"


def escaped(text: Column) -> Column:
    """One more backslash after the first character of whatever looks like a control string, escaped or not."""
    return F.regexp_replace(text, F.lit(_ESCAPE), F.lit(r"$1\\$2$3"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_UNESCAPE), F.lit("$1$2$3"))


def format_turn(role: Column, text: Column) -> Column:
    """User turns stand between [INST] marks, replies end with </s>; any other role is written with the length of its name, the name and the text between SYS marks."""
    name = escaped(role)
    return (F.when(role == "user", F.concat(F.lit("[INST] "), escaped(text), F.lit(" [/INST]")))
            .when(role == "assistant", F.concat(escaped(text), F.lit("</s>")))
            .otherwise(F.concat(F.lit("<<SYS>>"), F.char_length(name).cast("string"), F.lit(" "), name, F.lit(" "), escaped(text), F.lit("<</SYS>>"))))


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted text, as structs of role and text."""
    def one(x: Column) -> Column:
        inner = F.substring(x, F.lit(8), F.char_length(x) - 15)
        size = F.substring_index(inner, " ", 1)
        rest = F.substring(inner, F.char_length(size) + 2, F.char_length(inner))
        n = size.try_cast("int")
        system = F.struct(unescaped(F.substring(rest, F.lit(1), n)).alias("role"), unescaped(F.substring(rest, n + 2, F.char_length(rest))).alias("text"))
        user = F.struct(F.lit("user").alias("role"), unescaped(F.substring(x, F.lit(8), F.char_length(x) - 15)).alias("text"))
        reply = F.struct(F.lit("assistant").alias("role"), unescaped(F.substring(x, F.lit(1), F.char_length(x) - 4)).alias("text"))
        return F.when(F.startswith(x, F.lit("[INST] ")), user).when(F.startswith(x, F.lit("<<SYS>>")), system).otherwise(reply)
    return F.transform(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0)), one)


def expand(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One example per assistant turn: all turns before it as context, and only its text under the loss.

    Returns `conv_id`, `example` (place of the last turn in it, from 1), `n_turns` in the example, `formatted`,
    `loss_start` and `loss_end` (code points, end excluded; equal where nothing is trained). A conversation that does not end
    with an assistant gets one further example with all its turns and an empty loss, so that no turn is lost.

    Defined cases: null texts and roles are empty; turns are ordered by turn, role and text, null turns first; repeated
    rows are turns of their own; rows with a null conversation id are one conversation; extra columns are ignored.

    Scale: one shuffle, by conversation. A conversation's turns meet in one row, as its examples quote all of them: the
    output of a conversation grows with the square of its turns, as the expansion is defined, and is made row by row.
    """
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("conv_id", F.struct("turn", "role", "text", format_turn(F.col("role"), F.col("text")).alias("made")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    size = F.size("t")
    last = F.filter(F.sequence(F.lit(1), size), lambda i: (F.get(F.col("t"), i - 1)["role"] == "assistant") | (i == size))
    made = convs.select("conv_id", F.col("t.made").alias("made"), F.col("t.role").alias("roles"), F.explode(last).alias("example"))
    trained = F.get("roles", F.col("example") - 1) == "assistant"
    whole = made.select("conv_id", "example", F.array_join(F.slice("made", F.lit(1), F.col("example")), "").alias("formatted"),
                        trained.alias("trained"), F.char_length(F.get("made", F.col("example") - 1)).alias("own"))
    total = F.char_length("formatted").cast("long")
    end = F.when(F.col("trained"), total - 4).otherwise(total)
    return whole.select("conv_id", "example", F.col("example").alias("n_turns"), "formatted",
                        F.when(F.col("trained"), total - F.col("own")).otherwise(total).alias("loss_start"), end.alias("loss_end"))


def read_back(examples: DataFrame) -> DataFrame:
    """Digests of each conversation, taken from the formatted examples alone."""
    seen = examples.select("conv_id", "example", F.char_length("formatted").cast("long").alias("chars"),
                           unescaped(F.substring("formatted", F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int"))).alias("reply"), "formatted")
    longest = F.max_by(F.col("formatted"), F.col("example"))
    conv = seen.groupBy("conv_id").agg(longest.alias("formatted"), F.sum("chars").alias("formatted_chars"),
                                       F.sort_array(F.collect_list(F.struct("example", "reply"))).alias("replies"))
    turns = conv.select("conv_id", "formatted_chars", parse_turns(F.col("formatted")).alias("turns"), F.array_join("replies.reply", "").alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
