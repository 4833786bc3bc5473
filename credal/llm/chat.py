"""Chat formatting with a grammar round trip, in DataFrame functions alone.

A turn renders as ``<|im_start|>role\\ntext<|im_end|>\\n``. The parser is deterministic: it cuts a conversation at every
start mark, wants role, newline, text, one end mark and a newline in each piece, and takes one escape mark off each marked
control string. A turn is first rendered as it stands and parsed; where the parse is not the source, the conflicting
content is escaped (one more mark inside each control string, marked ones included, so nothing is ambiguous) and the turn
is rendered and parsed again. A turn that still differs stops the job; none can by the grammar.

Nulls: a null role or text is empty; a null conversation id is a conversation of its own; a null turn comes first. Rows of
one conversation with equal turns are ordered by role, then text; repeated rows are repeated turns. An empty table gives
an empty result. Other columns are ignored. One conversation becomes one string, so it is limited by Spark's 2 GB a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, MARK = "<|im_start|>", "<|im_end|>", "\\"
_CONTROL = r"<\|(\\*)(im_start|im_end)\|>"
_MARKED = r"<\|\\(\\*)(im_start|im_end)\|>"


def escape(text: Column, newline: bool = False) -> Column:
    """One more mark inside every control string. newline: for roles, which end at a newline; mark and newline are coded too."""
    if newline:
        text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return F.regexp_replace(text, _CONTROL, r"<|\\$1$2|>")


def unescape(text: Column, newline: bool = False) -> Column:
    """What escape made, back again."""
    text = F.regexp_replace(text, _MARKED, "<|$1$2|>")
    if newline:  # \x00 stands for a coded mark meanwhile; the pair below is read from the left
        text = F.array_join(F.transform(F.split(text, r"\\\\"), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")
    return text


def render(role: Column, text: Column) -> Column:
    """A turn's rendered form, contents as given."""
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation: array of (role, text, ok), unescaped; ok is false where the grammar is broken.

    Every start mark begins a turn; the first item stands for what is before the first start mark, which must be nothing.
    Each turn is read from its own piece alone, so the work is in proportion to the text.
    """
    tail = END + "\n"

    def turn(piece: Column, at: Column) -> Column:
        body = F.substring(piece, F.lit(1), F.length(piece) - len(tail))
        role = F.substring_index(body, "\n", 1)
        text = F.substring(body, F.length(role) + 2, F.length(body))
        ok = F.endswith(piece, F.lit(tail)) & F.contains(body, F.lit("\n")) & ~F.contains(body, F.lit(END))
        return F.struct(unescape(role, True).alias("role"), unescape(text).alias("text"), F.when(at == 0, piece == "").otherwise(ok).alias("ok"))

    return F.transform(F.split(formatted, r"<\|im_start\|>"), turn)


def expected(turns: Column) -> Column:
    """What parse has to give for turns (array of structs with role and text)."""
    item = lambda role, text: F.struct(role.alias("role"), text.alias("text"), F.lit(True).alias("ok"))
    return F.concat(F.array(item(F.lit(""), F.lit(""))), F.transform(turns, lambda x: item(x["role"], x["text"])))


def format_turns(turns: DataFrame) -> DataFrame:
    """Each row's rendered turn. turns: conv_id, turn, role, text. Adds ``rendered`` and ``escaped`` (whether it had to be)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    df = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    same = lambda rendered: parse(rendered) == expected(F.array(F.struct("role", "text")))
    # Only content with a control string, marked or not, or a role with a mark or newline can conflict: the others need no parse.
    suspect = F.contains(F.col("text"), F.lit("<|")) | F.contains(F.col("role"), F.lit("<|")) | F.contains(F.col("role"), F.lit("\\")) | F.contains(F.col("role"), F.lit("\n"))
    raw, marked = render(F.col("role"), F.col("text")), render(escape(F.col("role"), True), escape(F.col("text")))
    first = F.when(~suspect, F.lit(True)).otherwise(same(raw))
    df = df.withColumn("escaped", ~first)
    return df.withColumn("rendered", F.when(~F.col("escaped"), raw).when(same(marked), marked).otherwise(F.raise_error(F.lit("a turn does not survive the round trip"))))


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row a conversation: conv_id, formatted, turns (parsed back from it, compared with the source), n_escaped.

    The text under the loss mask is that of the turns of ``loss_role``.
    """
    item = F.struct("turn", "role", "text", "rendered", "escaped")
    df = format_turns(turns).groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("source"))
    df = df.select("conv_id", "source", F.array_join(F.col("source.rendered"), "").alias("formatted"))
    df = df.withColumn("parsed", parse(F.col("formatted"))).withColumn("held", F.col("parsed") == expected(F.col("source")))
    return df.select(
        "conv_id",
        F.when(F.col("held"), F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not survive the round trip"))).alias("formatted"),
        F.transform(F.slice("parsed", 2, F.size("parsed")), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"),
        F.size(F.filter("source", lambda x: x["escaped"])).cast("long").alias("n_escaped"),
        F.lit(loss_role).alias("loss_role"),
    )


def digest(conversations: DataFrame) -> DataFrame:
    """Counts and hashes of formatted conversations, from what was parsed back."""
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda x: x["role"] == F.col("loss_role")), lambda x: x["text"]), "")
    return conversations.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_escaped",
    )
