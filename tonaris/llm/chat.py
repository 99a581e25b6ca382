"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every turn becomes a segment ``<|im_start|>role\\ntext<|im_end|>\\n`` (``format_turns``). Every assistant turn is
then expanded into an example of its own (``expand``): its prefix, all segments before it, written out, and its
target, the reply, which alone is trainable. ``read_back`` takes its results from these examples. Prefixes of one
conversation grow with the square of its length; they are made row by row and never gathered. ``examples`` has
them as lengths into the conversation's formatted text, for where that is enough.

Escapes: backslash -> \\0, <| -> <\\1, line feed -> \\2 (in roles only; texts keep theirs). After that every
backslash is followed by a digit and no text holds ``<|``, so markers are unambiguous and the
replacements, undone in reverse order, give back the original.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonaris.llm.common import pick

START, END = "<|im_start|>", "<|im_end|>\n"
#: Turns of a conversation are summed and joined in blocks of so many before the whole is put together.
BLOCK = 256


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\0"))
    return F.replace(c, F.lit("<|"), F.lit("<\\1"))


def unescape(c: Column) -> Column:
    c = F.replace(c, F.lit("<\\1"), F.lit("<|"))
    return F.replace(c, F.lit("\\0"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\2"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("\\2"), F.lit("\n")))


def format_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, block, turn, role, segment, reply_chars, context_chars, context_bytes, example`` for each row.

    Rows stand in order of turn (null first), then role, then text; repeated rows are repeated turns. A null
    role or text is empty; a null conv_id is a conversation of its own. ``reply_chars`` is the length of the
    trainable part of the segment (escaped text and end mark; 0 unless the role is assistant), ``context_chars``
    and ``context_bytes`` the length of all segments before it. ``example`` is true for the turns that ``expand`` makes examples of.
    Extra columns are left out. An empty table gives an empty table.
    """
    rows = pick(conversations, "conv_id", "turn", "role", "text")
    block = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 60))).cast("long")
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = rows.groupBy("conv_id", block.alias("block")).agg(F.sort_array(F.collect_list(turn)).alias("_t"))

    def part(x: Column) -> Column:
        said = escape(x["text"])
        segment = F.concat(F.lit(START), escape_role(x["role"]), F.lit("\n"), said, F.lit(END))
        reply = F.when(x["role"] == "assistant", F.length(said) + len(END) - 1).otherwise(0).cast("long")
        return F.struct(x["turn"].alias("turn"), x["role"].alias("role"), segment.alias("segment"), reply.alias("reply_chars"))

    blocks = blocks.select("conv_id", "block", F.transform("_t", part).alias("_s"))
    sizes = {"chars": F.length, "bytes": F.octet_length}
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda size: F.aggregate("_s", F.lit(0).cast("long"), lambda acc, x: acc + size(x["segment"]))
    blocks = blocks.withColumns({f"_{n}": total(size) for n, size in sizes.items()})
    blocks = blocks.withColumns({f"_{n}_offset": F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)) for n in sizes})
    each = blocks.select("conv_id", "block", *[f"_{n}_offset" for n in sizes], F.posexplode("_s").alias("_pos", "_x"))
    each = each.select("conv_id", "block", *[f"_{n}_offset" for n in sizes], "_pos", "_x.*")
    within = Window.partitionBy("conv_id", "block").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    before = [(F.col(f"_{n}_offset") + F.coalesce(F.sum(size("segment")).over(within), F.lit(0))).alias(f"context_{n}") for n, size in sizes.items()]
    return each.select("conv_id", "block", "turn", "role", "segment", "reply_chars", *before, (F.col("role") == "assistant").alias("example"))


def examples(turns: DataFrame) -> DataFrame:
    """One row for each assistant turn: ``conv_id, block, turn, context_chars, reply_chars``.

    The context is the first ``context_chars`` characters of the conversation's formatted text: all turns before and the reply's own
    header. The reply, which alone is trainable, is the ``reply_chars`` characters that follow.
    """
    return turns.filter("example").select("conv_id", "block", "turn", _example().alias("_e")).select("conv_id", "block", "turn", "_e.*")


def _example() -> Column:
    """The example that an assistant turn is."""
    head = F.length("segment") - 1 - F.col("reply_chars")
    return F.struct((F.col("context_chars") + head).alias("context_chars"), F.col("reply_chars").alias("reply_chars"))


def _joined(turns: DataFrame, **parts: Column) -> DataFrame:
    """Strings of a conversation joined in order: by block first, then over its blocks."""
    piece = F.struct(F.col("context_chars").alias("at"), *[c.alias(n) for n, c in parts.items()])
    blocks = turns.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(piece)).alias("_p"))

    def strings(of: str, name: str) -> Column:
        return F.array_join(F.transform(of, lambda x: x[name]), "").alias(name)

    of_block = [strings("_p", n) for n in parts]
    blocks = blocks.select("conv_id", F.struct(F.col("_p")[0]["at"].alias("at"), F.size("_p").alias("n"), *of_block).alias("_b"))
    whole = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list("_b")).alias("_b"))
    n = F.aggregate("_b", F.lit(0).cast("long"), lambda acc, b: acc + b["n"])
    return whole.select("conv_id", n.alias("n_turns"), *[strings("_b", n) for n in parts])


def formatted(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, text``: each conversation's formatted text, the string into which contexts point."""
    return _joined(turns, text=F.col("segment"))


def expand(turns: DataFrame) -> DataFrame:
    """Prefix-target expansion: ``conv_id, block, turn, start, context, reply``, a row for each assistant turn and one that closes each block.

    ``context`` is the prefix written out: the formatted text of all turns before and the reply's own header. ``reply`` is the target, which
    alone is trainable. ``start`` is the byte of the context at which the block or, in it, what follows the reply before begins: what a context
    holds from there on no earlier one has. The row that closes a block has all formatted text to its end as its context and a null reply.
    """
    before = F.length("segment") - 1 - F.col("reply_chars")
    at = F.col("context_bytes") + F.octet_length(_cut("segment", F.lit(0), before))
    span = F.struct(at.alias("at"), (at + F.octet_length(_cut("segment", before, F.col("reply_chars")))).alias("end"), "turn")
    segments, wanted = F.collect_list(F.struct("context_bytes", "segment")), F.collect_list(F.when(F.col("example"), span))
    blocks = turns.groupBy("conv_id", "block").agg(F.sort_array(segments).alias("_s"), F.sort_array(wanted).alias("_e"))
    blocks = blocks.select("conv_id", "block", F.col("_s")[0]["context_bytes"].alias("_at"), F.array_join(F.col("_s")["segment"], "").alias("_text"), "_e")
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_head", F.array_join(F.collect_list("_text").over(earlier), ""))
    closing = F.struct((F.col("_at") + F.octet_length("_text")).alias("at"), F.lit(None).cast("long").alias("end"), F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"))
    starts = F.concat(F.array("_at"), F.transform("_e", lambda e: e["end"]))
    spans = F.zip_with(F.concat("_e", F.array(closing)), starts, lambda e, start: F.struct(start.alias("start"), e.alias("e")))
    text = [F.col(n).cast("binary").alias(n) for n in ("_head", "_text")]
    each = blocks.select("conv_id", "block", "_at", *text, spans.alias("_spans")).select("conv_id", "block", "_at", "_head", "_text", F.explode("_spans").alias("_x"))
    each = each.select("conv_id", "block", "_at", "_head", "_text", "_x.start", "_x.e.*")
    context = F.concat("_head", _cut("_text", F.lit(0), F.col("at") - F.col("_at"))).cast("string")
    reply = _cut("_text", F.col("at") - F.col("_at"), F.col("end") - F.col("at")).cast("string")
    return each.select("conv_id", "block", "turn", "start", context.alias("context"), reply.alias("reply"))


def _cut(of: str | Column, at: Column, n: Column) -> Column:
    """Characters of a string; bytes of a binary, for which nothing before them is looked at."""
    return F.substring(of, (at + 1).cast("int"), n.cast("int"))


def inline_contexts(turns: DataFrame) -> DataFrame:
    """Examples with their contexts written out: ``conv_id, turn, context, reply``. Its size grows with the square of a conversation's length."""
    return expand(turns).filter(F.col("reply").isNotNull()).select("conv_id", "turn", "context", "reply")


def read_back(turns: DataFrame) -> DataFrame:
    """What the expanded examples hold, by conversation: roles and texts parsed from contexts and replies, the loss from the replies.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``. Each example gives the turns that its context has
    beyond those of the example before, and its reply; the row that closes a block gives those that follow its last reply.
    """
    mark = END[:-1]
    fresh = _cut(F.col("context").cast("binary"), F.col("start"), F.octet_length("context")).cast("string")
    each = expand(turns).select("conv_id", "start", F.concat(fresh, F.coalesce("reply", F.lit(""))).alias("new"), "reply")
    reply = F.coalesce(unescape(_cut("reply", F.lit(0), F.length("reply") - len(mark))), F.lit(""))

    def turn(x: Column) -> Column:
        x = F.substring_index(x, START, -1)
        role = F.substring_index(x, "\n", 1)
        return F.concat(unescape_role(role), F.lit("\n"), unescape(F.substring(x, F.length(role) + 2, F.length(x))), F.lit("\n"))

    parsed = F.split("new", mark.replace("|", "\\|"))  # the last part is what follows the last end mark: nothing, or its line feed
    said = F.array_join(F.transform(F.slice(parsed, F.lit(1), F.size(parsed) - 1), turn), "")
    one = F.struct("start", (F.size(parsed) - 1).cast("long").alias("n"), said.alias("said"), reply.alias("reply"), F.length("new").cast("long").alias("chars"))
    whole = each.select("conv_id", one.alias("_b")).groupBy("conv_id").agg(F.sort_array(F.collect_list("_b")).alias("_b"))
    total = lambda of: F.aggregate("_b", F.lit(0).cast("long"), lambda acc, b: acc + b[of])
    joined = lambda of: F.array_join(F.col("_b")[of], "")
    return whole.select(
        "conv_id",
        total("n").alias("n_turns"),
        F.sha2(joined("said"), 256).alias("turns_sha256"),
        F.length(joined("reply")).cast("long").alias("loss_chars"),
        F.sha2(joined("reply"), 256).alias("loss_sha256"),
        total("chars").alias("formatted_chars"),
    )


CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
           UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(24 + length(replace(replace(replace(role, '\', '\0'), '<|', '<\1'), chr(10), '\2'))
                   + length(replace(replace(text, '\', '\0'), '<|', '<\1'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
