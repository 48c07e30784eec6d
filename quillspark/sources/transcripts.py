"""Transcripts from JSON message lists, session event lines and plain text, as rows ``(context_id, pos, kind, content)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import kind_for_role, stripped

# Results must agree with them.
ROLE_LINE = r"(?im)^[ \t]*(user|human|assistant|agent|system|tool|function|output)[ \t]*:[ \t]*"


def _is(value: Column, kind: str) -> Column:
    return F.schema_of_variant(value).startswith(kind)


def _string(value: Column, path: str = "$") -> Column:
    found = F.try_variant_get(value, path, "variant")
    return F.when(_is(found, "STRING"), F.try_variant_get(value, path, "string"))


def flat_part(part: Column) -> Column:
    """A block of content as text: itself, or what it has as text, content or output, or its JSON."""
    return F.coalesce(_string(part), *[_string(part, f"$.{k}") for k in ("text", "content", "output")], F.to_json(part))


def flat_content(content: Column) -> Column:
    """Content that is a text, a list of blocks or something else, as one text with a line for each block."""
    parts = F.transform(F.try_variant_get(content, "$", "array<variant>"), flat_part)
    return F.when(_is(content, "ARRAY"), F.array_join(parts, "\n")).otherwise(F.coalesce(_string(content), content.cast("string"), F.lit("")))


def _kind(block: Column) -> Column:
    return _string(block, "$.type")


def _holds_blocks(block: Column) -> Column:
    return F.coalesce((_kind(block) == "tool_result") & _is(F.try_variant_get(block, "$.content", "variant"), "ARRAY"), F.lit(False))


def unfolded(blocks: Column, json: Column) -> Column:
    """The blocks of a list, with every result of a tool that holds blocks itself replaced by those, however deep they lie.

    Lines of blocks are joined by line ends on every level, so the blocks in order are all that matters. Each pass opens one
    level, and as many passes as there are results in ``json``, the list's own text, are enough; once nothing is left to
    open a pass does nothing. An empty list of blocks is an empty line.
    """
    nothing = F.array(F.parse_json(F.lit('""')))

    def opened(block: Column) -> Column:
        inner = F.try_variant_get(block, "$.content", "array<variant>")
        return F.when(_holds_blocks(block), F.when(F.size(inner) > 0, inner).otherwise(nothing)).otherwise(F.array(block))

    def level(state: Column, _: Column) -> Column:
        done = ~F.exists(state["blocks"], _holds_blocks)
        return F.when(state["done"], state).otherwise(F.struct(F.when(done, state["blocks"]).otherwise(F.flatten(F.transform(state["blocks"], opened))).alias("blocks"), done.alias("done")))

    results = F.size(F.split(json, "tool_result")) - 1
    whole = F.aggregate(F.sequence(F.lit(0), results), F.struct(blocks.alias("blocks"), F.lit(False).alias("done")), level)
    return F.when(results > 0, whole["blocks"]).otherwise(blocks)


def session_block(block: Column) -> Column:
    """A block of a session's message as text: its text, a call with its input as compact JSON, a result, or its JSON; one without a type is
    read like a block of a message list."""
    kind, inner = _kind(block), F.try_variant_get(block, "$.content", "variant")
    call = F.concat(F.lit("[tool_call "), F.coalesce(_string(block, "$.name"), F.lit("unknown_tool")), F.lit("] "), F.coalesce(F.to_json(F.try_variant_get(block, "$.input", "variant")), F.lit("{}")))
    result = F.coalesce(_string(inner), inner.cast("string"))
    found = F.when(kind == "text", F.coalesce(_string(block, "$.text"), F.lit(""))).when(kind == "tool_use", call).when(kind == "tool_result", F.coalesce(result, F.lit("")))
    return F.when(kind.isNull(), flat_part(block)).otherwise(F.coalesce(_string(block), found, F.to_json(block)))


def session_content(content: Column) -> Column:
    """Content of a session's message, a text or a list of blocks, as one text with a line for each block."""
    parts = F.transform(unfolded(F.try_variant_get(content, "$", "array<variant>"), F.to_json(content)), session_block)
    return F.when(_is(content, "ARRAY"), F.array_join(parts, "\n")).otherwise(F.coalesce(_string(content), content.cast("string"), F.lit("")))


def from_messages(raw: DataFrame) -> DataFrame:
    """Items of ``raw(context_id, raw)``: JSON lists of messages, or objects that hold one as ``messages``.

    Blank messages are left out but counted in ``pos``. Texts that aren't such JSON give no items.
    """
    parsed = raw.withColumn("v", F.try_parse_json("raw"))
    listed = F.coalesce(F.try_variant_get("v", "$.messages", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    items = parsed.select("context_id", F.posexplode(listed).alias("pos", "m"))
    content = flat_content(F.try_variant_get("m", "$.content", "variant"))
    out = items.select("context_id", F.col("pos").cast("long").alias("pos"), kind_for_role(F.coalesce(_string(F.col("m"), "$.role"), F.lit(""))).alias("kind"), content.alias("content"))
    return out.where(stripped(F.col("content")) != "")


def session_lines(lines: DataFrame) -> DataFrame:
    """``lines(context_id, line_no, value)`` with what each is: ``item`` or the reason why it is skipped."""
    v = F.try_parse_json("value")
    out = lines.where(stripped(F.col("value")) != "").withColumn("v", v).withColumn("type", _string(F.col("v"), "$.type"))
    message = F.try_variant_get("v", "$.message", "variant")
    known = F.col("type").isin("user", "assistant")
    reason = (
        F.when(F.col("v").isNull() | ~_is(F.col("v"), "OBJECT"), "unparseable")
        .when(~F.coalesce(known, F.lit(False)), F.coalesce("type", F.lit("unknown")))
        .when(F.coalesce(~_is(message, "OBJECT"), F.lit(True)), F.concat("type", F.lit("_without_message")))
        .otherwise("item")
    )
    return out.withColumn("outcome", reason).withColumn("content", F.when(F.col("outcome") == "item", session_content(F.try_variant_get("v", "$.message.content", "variant")))).drop("v")


def from_session(lines: DataFrame) -> DataFrame:
    """Items of a session's event lines; ``pos`` counts those kept."""
    kept = session_lines(lines).where((F.col("outcome") == "item") & (stripped(F.col("content")) != ""))
    pos = F.row_number().over(Window.partitionBy("context_id").orderBy("line_no")) - 1
    return kept.select("context_id", pos.cast("long").alias("pos"), kind_for_role(F.col("type")).alias("kind"), "content")


def skipped(lines: DataFrame) -> DataFrame:
    return session_lines(lines).where("outcome <> 'item'").groupBy("context_id", F.col("outcome").alias("reason")).agg(F.count("*").alias("n"))


def from_text(raw: DataFrame) -> DataFrame:
    """Items of plain texts: split at role markers, or at blank lines where there are none; a preamble is the system's."""
    cut, mark = "\u0001", "\u0002"
    marked = F.regexp_replace("raw", ROLE_LINE, f"{cut}$1{mark}")
    role_parts = F.transform(F.split(marked, cut), lambda x: F.struct(F.when(x.contains(mark), F.substring_index(x, mark, 1)).alias("role"), stripped(F.when(x.contains(mark), F.substring_index(x, mark, -1)).otherwise(x)).alias("content")))
    blank_parts = F.transform(F.split("raw", r"\n\s*\n"), lambda x: F.struct(F.lit("agent").alias("role"), stripped(x).alias("content")))
    parts = F.filter(F.when(F.col("raw").rlike(ROLE_LINE), role_parts).otherwise(blank_parts), lambda x: x["content"] != "")
    items = raw.select("context_id", F.posexplode(parts).alias("pos", "p"))
    return items.select("context_id", F.col("pos").cast("long").alias("pos"), kind_for_role(F.coalesce("p.role", F.lit("system"))).alias("kind"), "p.content")


def is_session(raw: Column) -> Column:
    """Whether there are two lines or more, and the first five that aren't blank are all JSON objects with a type."""
    lines = F.slice(F.filter(F.split(raw, "\n"), lambda x: stripped(x) != ""), 1, 5)
    typed = F.forall(lines, lambda x: F.coalesce(F.try_variant_get(F.try_parse_json(x), "$.type", "string").isNotNull(), F.lit(False)))
    return (F.size(lines) > 1) & typed


def load(raw: DataFrame) -> DataFrame:
    """Items of texts ``(context_id, raw)`` of any format: JSON messages, session lines or plain text.

    A JSON object without messages is plain text, also if it is a session of one line.
    """
    v, first = F.try_parse_json("raw"), F.substring(stripped(F.col("raw")), 1, 1)
    listed = _is(v, "ARRAY") | (_is(v, "OBJECT") & _is(F.try_variant_get(v, "$.messages", "variant"), "ARRAY"))
    # the parser reads the first value of a text only, so lines are told apart before lists
    format_ = F.when((first == "{") & is_session(F.col("raw")), "session").when(first.isin("[", "{") & F.coalesce(listed, F.lit(False)), "messages").otherwise("text")
    routed = raw.withColumn("format", format_)
    of = lambda name: routed.where(F.col("format") == name).select("context_id", "raw")
    lines = of("session").select("context_id", F.posexplode(F.split("raw", "\n")).alias("line_no", "value"))
    return from_messages(of("messages")).unionByName(from_session(lines)).unionByName(from_text(of("text")))
