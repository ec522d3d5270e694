"""Chat formatting as a relational plan: collect, sort, merge and concatenate in Spark expressions.

Template: ``<|turn|>role<|text|>first<|also|>second<|end|>`` per group of adjacent turns with
one role, so a merged group still says where each of its turns began. Control strings inside a
role or text get a backslash behind their first character, one more than they have; taking one away
restores the text exactly.

The loss mask is a list of spans of the formatted text, one for each assistant text, in code
points and in bytes; it touches no control string. Offsets are running sums over the turns taken apart, by
a window on the partitioning that the conversations are collected by, so n turns take n steps.

Defined results: null text or role is empty; a null conversation id is a conversation of its
own; turns sort by turn number (null first), then role, then text, and repeated rows all stay;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, ALSO, END = "<|turn|>", "<|text|>", "<|also|>", "<|end|>"
ASSISTANT = "assistant"
#: What follows the first character of a control string, ours and other common templates'.
CONTROL = r"\|(?:turn|text|also|end|im_start|im_end|endoftext)\|>|/?s>|/?INST\]|</?SYS>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({CONTROL})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({CONTROL})", "$1$2$3")


def format_conversations(df: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss), one row a conversation, from rows (conv_id, turn, role, text);
    ``loss``: spans (begin, end, byte_begin, byte_end) of ``formatted`` that carry loss."""
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    turns = df.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    roles = F.transform("turns", lambda t: t.role)
    previous = F.concat(F.array(F.lit(None).cast("string")), F.slice(roles, 1, F.size(roles) - 1))

    def piece(t: Column, before: Column) -> Column:
        opened = F.concat(F.lit(TURN), escape(t.role), F.lit(TEXT))
        lead = F.when(before.isNull(), opened).when(before == t.role, F.lit(ALSO)).otherwise(F.concat(F.lit(END), opened))
        return F.struct(lead.alias("lead"), escape(t.text).alias("said"), (t.role == ASSISTANT).alias("loss"))

    pieces = turns.select("conv_id", F.posexplode(F.zip_with("turns", previous, piece)).alias("pos", "piece")).select("conv_id", "pos", "piece.*")
    run = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ends = lambda size: F.sum(size("lead") + size("said")).over(run).cast("int")
    placed = pieces.withColumns({"end": ends(F.length), "byte_end": ends(F.octet_length)})
    span = F.struct((F.col("end") - F.length("said")).alias("begin"), "end", (F.col("byte_end") - F.octet_length("said")).alias("byte_begin"), "byte_end")
    whole = placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", F.concat("lead", "said").alias("x")))).alias("pieces"),
        F.sort_array(F.collect_list(F.when(F.col("loss"), span))).alias("loss"),
    )
    formatted = F.concat(F.array_join(F.transform("pieces", lambda p: p.x), ""), F.lit(END))
    return whole.select("conv_id", formatted.alias("formatted"), "loss")


def loss_texts(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, cut from the formatted text and unescaped."""
    cut = lambda s: F.substring(formatted.cast("binary"), s.byte_begin + 1, s.byte_end - s.byte_begin)
    return F.transform(loss, lambda s: unescape(cut(s).cast("string")))


def parse(formatted: Column) -> Column:
    """The groups of a formatted conversation: array of (role, texts), unescaped."""
    groups = F.split(formatted, r"<\|end\|>")
    groups = F.slice(groups, 1, F.size(groups) - 1)

    def group(g: Column) -> Column:
        parts = F.split(g, r"<\|text\|>", 2)
        texts = F.transform(F.split(parts[1], r"<\|also\|>"), unescape)
        return F.struct(unescape(F.substr(parts[0], F.lit(len(TURN) + 1))).alias("role"), texts.alias("texts"))

    return F.transform(groups, group)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted conversations hold, taken from text and mask alone."""
    read = formatted.select(
        "conv_id", F.length("formatted").cast("long").alias("formatted_chars"), parse(F.col("formatted")).alias("groups"),
        F.array_join(loss_texts(F.col("formatted"), F.col("loss")), "").alias("loss"), F.size("loss").cast("long").alias("n_loss_spans"),
    )
    each = F.flatten(F.transform("groups", lambda g: F.transform(g.texts, lambda t: F.concat(g.role, F.lit("\n"), t, F.lit("\n")))))
    read = read.select("conv_id", "formatted_chars", each.alias("turns"), "loss", "n_loss_spans", F.size("groups").cast("long").alias("n_groups"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_groups",
        "n_loss_spans",
    )
