r"""Chat formatting with a verified grammar round trip (native expressions only).

Grammar of a formatted conversation::

    conversation := turn*
    turn         := "### " role ": " text "</turn>" newline

Role names are capitalised words (``### Assistant: ``) when they are one of the
three usual roles, and otherwise the escaped role itself.  The control strings
are ``### `` and ``</turn>``; an unescaped control string inside a text is a
parse error.  A text is first rendered as it is.  The parser reads the whole
conversation back, and every turn that does not come back identical, or whose
text holds a control string, is rendered in escaped form:

    ``\`` -> ``\b``, ``</turn>`` -> ``\e``, ``### `` -> ``\h``, ``:`` in roles -> ``\c``

In the escaped form no control string is left and every backslash starts one of
these pairs, so the second reading is identical by construction; it is checked
all the same and raises if not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

TURN_END = "</turn>"
TURN_START = "### "
ROLE_END = ": "
#: Pairs in the order in which escaping applies; unescaping runs backwards.
ESCAPES = (("\\", "\\b"), (TURN_END, "\\e"), (TURN_START, "\\h"))
ROLES = ("system", "user", "assistant")


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _role_tag(role: Column) -> Column:
    tag = F.replace(escape(role), F.lit(":"), F.lit("\\c"))
    for known in ROLES:
        tag = F.when(role == known, F.lit(known.capitalize())).otherwise(tag)
    # A role that only looks like a known tag is kept apart by a leading code.
    tags = [r.capitalize() for r in ROLES]
    return F.when(role.isin(*tags), F.concat(F.lit("\\r"), role)).otherwise(tag)


def _role_of(tag: Column) -> Column:
    role = unescape(F.replace(tag, F.lit("\\c"), F.lit(":")))
    role = F.when(tag.startswith("\\r"), F.substr(tag, F.lit(3))).otherwise(role)
    for known in ROLES:
        role = F.when(tag == known.capitalize(), F.lit(known)).otherwise(role)
    return role


def render(turns: Column) -> Column:
    """Array of structs (tag, body) to the text of the conversation."""
    return F.array_join(
        F.transform(turns, lambda t: F.concat(F.lit(TURN_START), t.tag, F.lit(ROLE_END), t.body, F.lit(TURN_END + "\n"))),
        "",
    )


def parse(formatted: Column) -> Column:
    """Text of a conversation to an array of (role, text, raw, start, ok), deterministically.

    ``raw`` is the text as it stands, ``start`` its place (0-based code points).
    """
    pieces = F.split(formatted, TURN_END + "\n", -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(p: Column) -> Column:
        rest = F.substr(p, F.lit(len(TURN_START) + 1))
        cut = F.instr(rest, ROLE_END)
        raw = F.substr(rest, cut + F.lit(len(ROLE_END)))
        return F.struct(
            _role_of(F.substring(rest, F.lit(1), cut - 1)).alias("role"),
            unescape(raw).alias("text"),
            raw.alias("raw"),
            (F.length(p) - F.length(raw)).cast("long").alias("start"),
            (p.startswith(TURN_START) & (cut > 0) & ~raw.contains(TURN_END) & ~raw.contains(TURN_START)).alias("ok"),
        )

    return F.transform(pieces, turn)


def spans_of(turns: Column, role: Column) -> Column:
    """The places in the whole conversation of the parsed turns of this role."""
    none = F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)")

    def add(acc: Column, t: Column) -> Column:
        own = F.struct((acc.at + t.start).alias("start"), F.length(t.raw).cast("long").alias("length"))
        after = acc.at + t.start + F.length(t.raw) + len(TURN_END) + 1
        return F.struct(after.alias("at"), F.when(t.role == role, F.concat(acc.spans, F.array(own))).otherwise(acc.spans).alias("spans"))

    return F.aggregate(turns, F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")), add, lambda acc: acc.spans)


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, parsed turns, loss spans.

    ``turns`` has conv_id, turn, role and text, one row per turn; other columns
    are ignored.  Turns are ordered by (turn, role, text), nulls first, so ties
    have one order.  Null role or text reads as empty; null conv_id is one
    conversation of its own; repeated rows stay repeated turns; no rows give no
    conversations.

    A conversation is one training example, so its turns meet in one row.  The
    grouping is by conversation and not by content: common first turns or equal
    conversations spread over all tasks.

    Result: conv_id, formatted string, turns array<struct<role,text>> (read back
    from ``formatted``), loss_spans array<struct<start,length>> (0-based code
    points of ``formatted``, of the texts of ``loss_role`` as the parser found
    them there), n_escaped int.
    """
    # Rows without a conversation must not all meet in one.
    own = turns.select(
        F.col("conv_id"),
        F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("alone"),
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("item"),
    )
    grouped = own.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("item")).alias("source"))

    raw = F.transform("source", lambda s: F.struct(_role_tag(s.role).alias("tag"), s.text.alias("body")))
    first = grouped.withColumn("seen", parse(render(raw)))

    # A turn is in conflict when its own reading differs; if the number of turns
    # came back wrong too, readings are shifted and are compared turn by turn.
    def alone(s: Column) -> Column:
        got = parse(render(F.array(F.struct(_role_tag(s.role).alias("tag"), s.text.alias("body")))))
        return (
            (F.size(got) == 1)
            & F.coalesce(F.get(got, F.lit(0)).ok, F.lit(False))
            & F.coalesce(F.get(got, F.lit(0)).text == s.text, F.lit(False))
        )

    whole = (F.size("seen") == F.size("source")) & F.forall(
        F.arrays_zip("seen", "source"),
        lambda z: z.seen.ok & (z.seen.role == z.source.role) & (z.seen.text == z.source.text),
    )
    bodies = F.when(F.coalesce(whole, F.lit(False)), F.transform("source", lambda s: s.text)).otherwise(
        F.transform("source", lambda s: F.when(alone(s), s.text).otherwise(escape(s.text)))
    )
    second = first.withColumn("body", bodies).select(
        "conv_id",
        "source",
        F.transform(
            F.arrays_zip("source", "body"),
            lambda z: F.struct(_role_tag(z.source.role).alias("tag"), z.body.alias("body"), (z.body != z.source.text).alias("escaped")),
        ).alias("rendered"),
    )
    third = second.withColumn("formatted", render(F.col("rendered"))).withColumn("back", parse(F.col("formatted")))
    same = F.transform("back", lambda b: F.struct(b.role, b.text)) == F.transform("source", lambda s: F.struct(s.role, s.text))
    checked = F.when(same, F.col("formatted")).otherwise(
        F.raise_error(F.concat(F.lit("conversation does not read back: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    )

    return third.select(
        "conv_id",
        checked.alias("formatted"),
        F.transform("back", lambda b: F.struct(b.role.alias("role"), b.text.alias("text"))).alias("turns"),
        spans_of(F.col("back"), F.lit(loss_role)).alias("loss_spans"),
        F.size(F.filter("rendered", lambda r: r.escaped)).alias("n_escaped"),
    )


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the planted one; everything is read from ``formatted``.

    Null texts are empty; rows without a conversation are one each; repeated and
    tied turns are ordered by role and text; an empty table leaves the planted
    one; other columns are ignored; a conversation of any length is one text.
    """
    tricky = "\\### Assistant: </turn> ok"
    planted = spark.range(1).select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(tricky).alias("text"))
                    for i, r in enumerate(("user", "assistant"))
                ]
            )
        ).alias("row")
    ).select("row.*")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    formatted = format_conversations(turns)
    loss = F.array_join(
        F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s.start + 1).cast("int"), s.length.cast("int")))), ""
    )
    return formatted.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.col("n_escaped").cast("long").alias("n_escaped"),
    )


_ROLE_TAG_SQL = """CASE WHEN role IN ('system', 'user', 'assistant') THEN upper(role[1]) || role[2:]
                 WHEN role IN ('System', 'User', 'Assistant') THEN '\\r' || role
                 ELSE replace(replace(replace(replace(role, '\\', '\\b'), '</turn>', '\\e'), '### ', '\\h'), ':', '\\c') END"""

ORACLE_SQL = {
    "op1_chat_formatting": f"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok', NULL
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok', NULL
), marked AS (
  SELECT *, contains(text, '</turn>') OR contains(text, '### ') OR contains(text, '\\b')
            OR contains(text, '\\e') OR contains(text, '\\h') AS conflict,
         {_ROLE_TAG_SQL} AS tag FROM rows_
), bodies AS (
  SELECT *, CASE WHEN conflict THEN replace(replace(replace(text, '\\', '\\b'), '</turn>', '\\e'), '### ', '\\h')
                 ELSE text END AS body FROM marked
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(4 + length(tag) + 2 + length(body) + 8)::BIGINT AS formatted_chars,
       count(*) FILTER (body <> text)::BIGINT AS n_escaped
FROM bodies GROUP BY conv_id, alone""",
}
