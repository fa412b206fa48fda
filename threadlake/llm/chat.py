"""Chat formatting as a grammar round trip, with DataFrame functions only.

    conversation := turn*
    turn         := <|turn|> level role <|text|> text <|end|>

A turn is first rendered as it is (level 0) and parsed again. If the parser does not give back the
same single turn, its role and text are escaped (level 1): every ``<|`` becomes ``<||``, which no
control string contains and which the parser undoes by the level it reads. The rendered conversation
is parsed once more and must equal its source, or the query fails.

The rendered conversation is one value, so the rows of a conversation meet in one place; only
rendered turns travel there. A conversation longer than a task can hold cannot be rendered at all.

Cases. Null text or role: empty. Null turn: before all others. Equal turn numbers: ordered by the
rendered turn; repeated rows stay repeated. Null conversation id: one conversation of its own. Empty
table: no rows. Extra columns: ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the template.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
OPEN, ESCAPED = "<|", "<||"


def escape(value: Column) -> Column:
    return F.replace(value, F.lit(OPEN), F.lit(ESCAPED))


def unescape(value: Column) -> Column:
    return F.replace(value, F.lit(ESCAPED), F.lit(OPEN))


def render(role: Column, text: Column, level: int) -> Column:
    if level:
        role, text = escape(role), escape(text)
    return F.concat(F.lit(TURN), F.lit(str(level)), role, F.lit(TEXT), text, F.lit(END))


def parse(formatted: Column) -> Column:
    """Array of (role, text); a piece that breaks the grammar gives null fields."""
    def turn(piece):
        level = F.substring(piece, 1, 1)
        role = F.substring_index(F.substr(piece, F.lit(2)), TEXT, 1)
        after = F.substr(piece, F.length(role) + 2 + len(TEXT))
        text = F.substring_index(after, END, 1)
        whole = F.concat(level, role, F.lit(TEXT), text, F.lit(END)) == piece
        return F.when(whole & (level == "0"), F.struct(role.alias("role"), text.alias("text"))) \
            .when(whole & (level == "1"), F.struct(unescape(role).alias("role"),
                                                   unescape(text).alias("text"))) \
            .otherwise(F.struct(F.lit(None).cast("string").alias("role"),
                                F.lit(None).cast("string").alias("text")))

    pieces = F.split(formatted, r"\Q" + TURN + r"\E", -1)
    return F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), turn)


def format_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """``conv, formatted, turns`` per conversation; ``turns`` is what the parser reads back."""
    said = rows.select(
        F.col(conv).alias("_conv"), F.col(turn).alias("_turn"),
        F.coalesce(F.col(role), F.lit("")).alias("_role"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"))
    plain = said.withColumn("_plain", render(F.col("_role"), F.col("_text"), 0))
    own = F.array(F.struct(F.col("_role").alias("role"), F.col("_text").alias("text")))
    turned = plain.select(
        "_conv", F.struct(
            F.col("_turn").alias("turn"),
            F.when(parse(F.col("_plain")) == own, F.col("_plain"))
            .otherwise(render(F.col("_role"), F.col("_text"), 1)).alias("shown"),
            F.col("_role").alias("role"), F.col("_text").alias("text")).alias("_one"))
    whole = turned.groupBy("_conv").agg(F.sort_array(F.collect_list("_one")).alias("_all")).select(
        "_conv", "_all",
        F.array_join(F.transform("_all", lambda t: t["shown"]), "").alias("formatted"))
    back = whole.withColumn("turns", parse(F.col("formatted")))
    source = F.transform("_all", lambda t: F.struct(t["role"].alias("role"),
                                                    t["text"].alias("text")))
    checked = F.when(F.col("turns") == source, F.col("turns")).otherwise(
        F.raise_error(F.lit("a conversation does not read back as it was")))
    return back.select(F.col("_conv").alias(conv), "formatted", checked.alias("turns"))


def loss_text(turns: Column) -> Column:
    """What the loss mask covers: the texts of the assistant, unescaped, in order."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == "assistant"),
                                    lambda t: t["text"]), "")


def digest(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"],
                                                    F.lit("\n")))
    return formatted.select(
        conv, "formatted", F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(lines, "").alias("_lines"), loss_text(F.col("turns")).alias("_loss")
    ).select(
        conv, "n_turns", F.sha2("_lines", 256).alias("turns_sha256"),
        F.length("_loss").cast("bigint").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))
