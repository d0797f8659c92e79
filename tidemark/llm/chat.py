"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is rendered as one ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn and read back by a deterministic
parser. The rendered text starts unescaped; if the turns read back differ from the source, the turns that do not survive
on their own are escaped, and if that is not enough all turns are, which is provably identical: an escape puts one more
backslash between ``<`` and ``|``, so escaped text holds no control string, and the parser takes exactly one away.
A conversation that still differed would end the query with an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
LEARNED_ROLE = "assistant"


def escape(text: Column) -> Column:
    """``<``, any backslashes and ``|`` get one backslash more."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def escape_role(role: Column) -> Column:
    """Roles stand on one line: backslashes and line feeds are escaped besides control strings."""
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # A pair of backslashes is parked on a character that no role may hold before the line feed is read.
    parked = F.replace(role, F.lit("\\\\"), F.lit("\x00b"))
    return unescape(F.replace(F.replace(parked, F.lit("\\n"), F.lit("\n")), F.lit("\x00b"), F.lit("\\")))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), escape_role(role), F.lit("\n"), text, F.lit(END + "\n"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a rendered conversation; NULL if it is not of the grammar.

    A turn ends at its first ``<|im_end|>``, so one anywhere but at the close of a turn is an error.
    """
    parts = F.split(formatted, r"<\|im_start\|>", -1)
    turns = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    close = END + "\n"
    line = lambda t: F.instr(t, F.lit("\n"))
    closed = lambda t: F.endswith(t, F.lit(close)) & (F.instr(t, F.lit(END)) == F.length(t) - len(close) + 1)
    good = (F.element_at(parts, 1) == "") & F.forall(turns, lambda t: (line(t) > 0) & closed(t))
    read = F.transform(
        turns,
        lambda t: F.struct(
            unescape_role(F.substring(t, F.lit(1), line(t) - 1)).alias("role"),
            unescape(F.substring(t, line(t) + 1, F.length(t) - line(t) - len(close))).alias("text"),
        ),
    )
    return F.when(good, read)


def survives(role: Column, text: Column) -> Column:
    """Whether an unescaped turn is read back as it was."""
    read = parse(render(role, text))
    return F.coalesce(read == F.array(F.struct(role.alias("role"), text.alias("text"))), F.lit(False))


def format_conversations(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row a conversation: conv_id, formatted, turns as read back, loss_spans, escapes.

    ``loss_spans`` holds start (from 0) and length, in code points of ``formatted``, of each assistant text. Turns are
    ordered by turn, then role and text (ties, repeated rows); NULL turns come first, NULL roles and texts are empty. Rows
    with a NULL conv_id are one conversation. ``escapes`` is 0 (none needed), 1 (conflicting turns) or 2 (all turns).
    A character NUL in a role is dropped. Other columns are ignored; an empty table gives no rows.
    """
    rows = conversations.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.translate(F.coalesce(F.col(role_col), F.lit("")), "\x00", "").alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("safe", survives(F.col("role"), F.col("text")))
    whole = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text", "safe"))).alias("source")
    )
    wanted = F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    for level in range(3):
        own = (
            lambda t, level=level: t["text"]
            if level == 0
            else (F.when(t["safe"], t["text"]).otherwise(escape(t["text"])) if level == 1 else escape(t["text"]))
        )
        shown = F.transform("source", lambda t: F.struct(t["role"].alias("role"), own(t).alias("body")))
        formatted = F.array_join(F.transform(shown, lambda t: render(t["role"], t["body"])), "")
        whole = whole.withColumn(f"try{level}", formatted) if level == 0 else whole.withColumn(
            f"try{level}", F.when(~F.col(f"same{level - 1}"), formatted)
        )
        done = F.coalesce(parse(F.col(f"try{level}")) == wanted, F.lit(False))
        whole = whole.withColumn(f"same{level}", done if level == 0 else F.col(f"same{level - 1}") | done)
    failed = F.raise_error(F.concat(F.lit("no round trip for conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("NULL"))))
    level = F.when(F.col("same0"), 0).when(F.col("same1"), 1).when(F.col("same2"), 2).otherwise(failed.cast("int"))
    best = whole.select(
        "conv_id",
        level.alias("escapes"),
        F.coalesce(F.when(F.col("same0"), F.col("try0")), F.when(F.col("same1"), F.col("try1")), "try2").alias("formatted"),
    )
    return best.withColumn("turns", parse(F.col("formatted"))).withColumn("loss_spans", _loss_spans(F.col("formatted")))


def _loss_spans(formatted: Column) -> Column:
    """Start and length of each assistant text, from the lengths of the rendered turns."""
    turns = F.split(formatted, r"<\|im_start\|>", -1)
    turns = F.slice(turns, F.lit(2), F.greatest(F.size(turns) - 1, F.lit(0)))
    ends = F.aggregate(
        turns,
        F.array(F.lit(0)),
        lambda acc, t: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(t) + len(START))),
    )
    head = len(LEARNED_ROLE) + 1
    spans = F.transform(
        turns,
        lambda t, i: F.struct(
            (F.element_at(ends, i + 1) + len(START) + head).alias("start"),
            (F.length(t) - head - len(END) - 1).alias("length"),
            F.startswith(t, F.lit(LEARNED_ROLE + "\n")).alias("learned"),
        ),
    )
    learned = F.filter(spans, lambda s: s["learned"])
    return F.transform(learned, lambda s: F.struct(s["start"], s["length"]))


def masked_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, one span after the other."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def digests(formatted: DataFrame) -> DataFrame:
    """What a formatted conversation reads back as, in numbers and hashes."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = masked_text(F.col("formatted"), F.col("loss_spans"))
    return formatted.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "escapes",
    )
