"""Chat formatting over typed content parts.

A turn holds parts of type text, image, audio or document. A visitor maps each part to what the string gets: the escaped
text, or an ordered placeholder, while the attachment's reference and the tokens it expands to are recorded. Turns are
marked by control strings; control strings inside texts are escaped so that parsing the output gives back every turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, ROLE_END, END = "<s>[INST] ", " [/INST]", "</s>"
#: A control string inside a text gets a backslash after its first character, and a backslash becomes two.
_CONTROL = "([<\\[])(?=/?s>|/?INST\\]|(?:image|audio|document)_[0-9]+>)"
PARTS = "array<struct<type:string,text:string,ref:string,amount:int>>"
#: Tokens an attachment expands to: a fixed head and so many per unit of ``amount`` (tiles, seconds, pages).
TOKENS = {"image": (1, 256), "audio": (2, 25), "document": (2, 600)}


#: The same in a part that another one follows: a bracket at its end may also open a control string together with that.
_OPEN_CONTROL = _CONTROL[:-1] + "|[^<\\[\\\\]*\\z)"


def escape(text: Column, control: str = _CONTROL) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "\\\\", "\\\\\\\\"), control, "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)\\\\(.)", "$1")


def _visit_parts(parts: Column) -> Column:
    """Parts with their rendering, in order. Placeholders are numbered by their place among all parts of the turn."""
    def visit(part, i):
        tokens = F.lit(None).cast("long")
        for kind, (head, each) in TOKENS.items():
            tokens = F.when(part["type"] == kind, (F.lit(head) + F.lit(each) * F.greatest(F.coalesce(part["amount"], F.lit(1)), F.lit(0))).cast("long")).otherwise(tokens)
        known = part["type"].isin(*TOKENS)
        text = F.coalesce(part["text"], F.lit(""))
        shown = F.when(known, F.concat(F.lit("<"), part["type"], F.lit("_"), i.cast("string"), F.lit(">"))).otherwise(
            F.when(i + 1 < F.size(parts), escape(text, _OPEN_CONTROL)).otherwise(escape(text)))
        return F.struct(shown.alias("shown"), F.when(known, F.struct(part["type"].alias("type"), i.alias("part"), part["ref"].alias("ref"), tokens.alias("tokens"))).alias("attachment"))
    return F.transform(F.coalesce(parts, F.array().cast(PARTS)), visit)


def format_chats(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans, attachments, expanded_tokens, n_turns``: one row per conversation.

    ``turns(conv_id, turn, role, text[, parts])``: ``parts`` is an array of ``(type, text, ref, amount)``; without the
    column, or where it is null, the turn is one text part. Other columns are not read. Turns are ordered by turn, role
    and parts, nulls first; repeated rows are turns of their own. A null text or role is empty; an unknown part type is
    text; rows without conv_id form one conversation with a null id; an empty table gives no rows. Texts may be of any
    length. ``loss_spans`` are the code points [begin, end) of each assistant text in ``formatted``.

    One grouping by conversation: a conversation is a unit of training and as a whole the size of one row.
    """
    parts = F.coalesce(F.col("parts").cast(PARTS), _one_text()) if "parts" in turns.columns else _one_text()
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), parts.alias("parts"))
    seen = t.select("conv_id", "turn", "role", _visit_parts(F.col("parts")).alias("v"))
    body = F.array_join(F.transform("v", lambda x: x.shown), "")
    rendered = seen.select(
        "conv_id", "turn", "role", F.concat(F.lit(BEGIN), escape(F.col("role")), F.lit(ROLE_END)).alias("head"), body.alias("body"),
        F.transform(F.filter("v", lambda x: x.attachment.isNotNull()), lambda x: x.attachment).alias("attached"))
    grouped = rendered.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "body", "head", "attached"))).alias("t"))
    width = F.transform("t", lambda x: F.struct(
        (x.role == "assistant").alias("learn"), F.length(x["head"]).alias("head"), F.length(x.body).alias("body")))
    spans = F.aggregate(
        width, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<begin:long,end:long>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc.at + x["head"] + x.body + F.lit(len(END))).alias("at"),
            F.when(x.learn, F.concat(acc.spans, F.array(F.struct((acc.at + x["head"]).alias("begin"), (acc.at + x["head"] + x.body).alias("end"))))).otherwise(acc.spans).alias("spans")))
    attachments = F.flatten(F.transform("t", lambda x, i: F.transform(x.attached, lambda a: F.struct(
        i.alias("turn"), a.part.alias("part"), a["type"].alias("type"), a["ref"].alias("ref"), a.tokens.alias("tokens")))))
    return grouped.select(
        "conv_id", F.array_join(F.transform("t", lambda x: F.concat(x["head"], x.body, F.lit(END))), "").alias("formatted"),
        spans.spans.alias("loss_spans"), attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda acc, a: acc + a.tokens).alias("expanded_tokens"), F.size("t").cast("long").alias("n_turns"))


def _one_text() -> Column:
    return F.array(F.struct(F.lit("text").alias("type"), F.col("text").cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("amount")))


def parse_chats(formatted: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans, turns``: the turns (role, text) read back from ``formatted`` alone.

    Escaped texts hold no control string, so every one in ``formatted`` is a mark. Placeholders stay as they are.
    """
    pieces = F.slice(F.split("formatted", "(?:^|\\Q" + END + "\\E)\\Q" + BEGIN + "\\E"), F.lit(2), F.size(F.split("formatted", "(?:^|\\Q" + END + "\\E)\\Q" + BEGIN + "\\E")))
    last = F.transform(pieces, lambda x: F.regexp_replace(x, "\\Q" + END + "\\E$", ""))
    turns = F.transform(last, lambda x: F.struct(
        unescape(F.substring_index(x, ROLE_END, 1)).alias("role"),
        unescape(F.substr(x, F.length(F.substring_index(x, ROLE_END, 1)) + F.lit(len(ROLE_END) + 1))).alias("text")))
    return formatted.select("conv_id", "formatted", "loss_spans", turns.alias("turns"))


def digest_chats(turns: DataFrame) -> DataFrame:
    """What the output holds, read back from it: turns, and the text under the loss mask."""
    parsed = parse_chats(format_chats(turns))
    masked = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s.begin + 1).cast("int"), (s.end - s.begin).cast("int")))), "")
    out = parsed.select(
        "conv_id", "turns", masked.alias("masked"), F.length("formatted").cast("long").alias("formatted_chars"))
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"), "formatted_chars")


_SQL_ESCAPE = r"""regexp_replace(regexp_replace(replace({0}, '\', '\\'), '<(/?s>|(?:image|audio|document)_[0-9]+>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g')"""

ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(BEGIN) + len(ROLE_END) + len(END)} + length(role) + length({_SQL_ESCAPE.format('text')})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
