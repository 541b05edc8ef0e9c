"""Chat formatting by grammar round trip, in DataFrame functions only.

Each turn is rendered as::

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

and a conversation is the concatenation of its turns.  The grammar that reads it back is
deterministic: cut at every end marker, drop the start marker, split the header from the body at the
first line feed that is not escaped, and undo the escapes.  An escape is a backslash before one
character, so a backslash itself is written twice and a control string is broken after its first
character.

Formatting is a loop until identical: a turn is rendered as it is and the rendered form is parsed; if it
does not come back, or a control string of any known template is found in it, its strings are escaped and
it is parsed again; a turn that still differs has every character escaped, which the grammar always gives
back.  The whole output is parsed once more and compared (``round_trip``).

``loss_spans`` marks the assistants' texts in the output, as code point numbers (start, one past the
end); ``loss_text`` is what they cut from it, unescaped.

Defined results: a null text or role is empty; turns are ordered by (turn, role, text), nulls first;
repeated rows stay repeated; a conversation is one row however long, because its digest covers all
of it; no rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import table

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings that must never stand in a text unbroken.
CONTROLS = (
    "<|im_start|>",
    "<|im_end|>",
    "<|endoftext|>",
    "<s>",
    "</s>",
    "[INST]",
    "[/INST]",
    "<<SYS>>",
    "<</SYS>>",
)
_ANY_CONTROL = "|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in CONTROLS)
_CONTROL = "|".join(re.escape(c) for c in CONTROLS)


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _ANY_CONTROL, r"\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\\n"))


def every_escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)(.)", r"\\$1")


#: How the strings of a turn are written: as they are, with escapes, with an escape each character.
PLAIN, ESCAPED, EVERY = range(3)


def _written(c: Column, level: Column, some) -> Column:
    return F.when(level == PLAIN, c).when(level == ESCAPED, some(c)).otherwise(every_escaped(c))


def rendered(turn: Column, level: Column) -> Column:
    """struct(line, start, end) of one turn: the text is line[start:end]."""
    head = F.concat(F.lit(START), _written(turn["role"], level, escaped_role), F.lit("\n"))
    text = _written(turn["text"], level, escaped)
    parts = F.array(F.struct(head.alias("h"), text.alias("t")))
    return F.transform(
        parts,
        lambda p: F.struct(
            F.concat(p["h"], p["t"], F.lit(END + "\n")).alias("line"),
            F.char_length(p["h"]).alias("start"),
            (F.char_length(p["h"]) + F.char_length(p["t"])).alias("end"),
        ),
    )[0]


def _header(block: Column) -> Column:
    return F.regexp_extract(block, r"(?s)^((?:[^\\\n]|\\.)*+)\n", 1)


def parsed(formatted: Column) -> Column:
    """Turns read back from the formatted text: array of struct(role, text, raw_text, head), head being the characters before the text."""
    blocks = F.split(formatted, re.escape(END + "\n"))
    blocks = F.filter(
        F.slice(blocks, F.lit(1), F.greatest(F.size(blocks) - 1, F.lit(0))),
        lambda b: b.startswith(START),
    )

    def turn(block: Column) -> Column:
        inner = F.substring(block, len(START) + 1, 2**31 - 1)
        role = _header(inner)
        raw = F.substr(inner, F.length(role) + 2)
        return F.struct(
            unescaped(role).alias("role"),
            unescaped(raw).alias("text"),
            raw.alias("raw_text"),
            (F.char_length(role) + len(START) + 1).alias("head"),
        )

    return F.transform(blocks, turn)


def _conflicts(turn: Column, level: int) -> Column:
    """The grammar does not give the turn back from this rendering, or it holds a control."""
    line = rendered(turn, F.lit(level))["line"]
    back = parsed(line)
    one = F.get(back, F.lit(0))
    same = (F.size(back) == 1) & (one["role"] == turn["role"]) & (one["text"] == turn["text"])
    inner = F.substr(line, F.lit(len(START) + 1), F.char_length(line) - len(START) - len(END) - 1)
    return ~F.coalesce(same, F.lit(False)) | inner.rlike(_CONTROL)


def level_of(turn: Column) -> Column:
    """The first way of writing a turn that comes back identical."""
    return F.when(~_conflicts(turn, PLAIN), PLAIN).when(~_conflicts(turn, ESCAPED), ESCAPED).otherwise(EVERY)


def format_chat(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted text, turns read back, loss spans and their text, round_trip flag."""
    clean = conversations.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    # each turn is rendered, parsed and escaped if need be before turns are brought together
    tried = clean.select("conv_id", "t", level_of(F.col("t")).alias("level"))
    lined = tried.select("conv_id", "t", rendered(F.col("t"), F.col("level")).alias("r"))
    lined = lined.select("conv_id", "t.*", "r.*")
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    lined = lined.withColumn("at", F.coalesce(F.sum(F.char_length("line")).over(before), F.lit(0)))
    lined = lined.select("conv_id", F.struct("turn", "role", "text", "line", "at", "start", "end").alias("t"))
    whole = lined.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    whole = whole.withColumn("formatted", F.array_join(F.transform("turns", lambda t: t["line"]), ""))
    whole = whole.withColumn("back", parsed(F.col("formatted")))
    # role and place of a turn's text are those read back; only where its line begins comes from the lengths of the lines before
    mask = F.zip_with("turns", "back", lambda t, b: F.struct(b["role"].alias("role"), t["at"].alias("at"), b["head"].alias("start"), (b["head"] + F.char_length(b["raw_text"])).alias("end")))
    whole = whole.withColumn("mask", mask)
    spans = F.transform(
        F.filter("mask", lambda t: t["role"] == "assistant"),
        lambda t: F.struct((t["at"] + t["start"]).alias("start"), (t["at"] + t["end"]).alias("end")),
    )
    # a span is cut from its line of the output, so that cutting takes one pass
    whole = whole.withColumn("lines", F.split("formatted", re.escape(END + "\n")))
    cuts = F.zip_with("mask", F.slice("lines", F.lit(1), F.size("turns")), lambda t, line: F.struct(t.alias("t"), line.alias("line")))
    cuts = F.filter(cuts, lambda c: c["t"]["role"] == "assistant")
    loss = F.transform(cuts, lambda c: unescaped(F.substr(c["line"], c["t"]["start"] + 1, c["t"]["end"] - c["t"]["start"])))
    strip = lambda c: F.transform(c, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return whole.select(
        "conv_id",
        "formatted",
        "back",
        spans.alias("loss_spans"),
        F.array_join(loss, "").alias("loss_text"),
        (strip(F.col("turns")) == strip(F.col("back"))).alias("round_trip"),
    )


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).selectExpr(
        f"inline(array(named_struct('conv_id', -7L, 'turn', 0L, 'role', 'user', 'text', '{said}'),"
        f" named_struct('conv_id', -7L, 'turn', 1L, 'role', 'assistant', 'text', '{said}')))"
    )
    out = format_chat(rows.unionByName(extra))
    turns = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "round_trip",
    )


#: The digests follow from the rows alone; the formatted length follows from the template: marks of
#: 24 characters and one line feed for the header and the end, plus one per escape.  A turn without a control string needs no
#: escape if its only backslash ends its text (nothing follows that it could escape).
_RE2 = "|".join(re.escape(c) for c in CONTROLS)
OP5_SQL = f"""
with c as (
  select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
m as (
  select *, case when not regexp_matches(r || chr(10) || t, '{_RE2}') and not regexp_matches(r, '[\\\\\\n]')
      and length(regexp_replace(t, '[^\\\\]', '', 'g')) = case when right(t, 1) = chr(92) then 1 else 0 end then 0 else
    length(regexp_replace(r, '[^\\\\]', '', 'g')) + len(regexp_extract_all(r, '{_RE2}')) + length(regexp_replace(r, '[^\\n]', '', 'g'))
    + length(regexp_replace(t, '[^\\\\]', '', 'g')) + len(regexp_extract_all(t, '{_RE2}')) end as extra from c)
select conv_id, count(*) n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn nulls first, r, t)) turns_sha256,
  cast(coalesce(sum(length(t)) filter (where r = 'assistant'), 0) as bigint) loss_chars,
  sha256(coalesce(string_agg(t, '' order by turn nulls first, r, t) filter (where r = 'assistant'), '')) loss_sha256,
  cast(sum(length(r) + length(t) + {len(START) + len(END) + 2} + extra) as bigint) formatted_chars,
  true as round_trip
from m group by conv_id
"""
