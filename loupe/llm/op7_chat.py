"""Chat formatting: a state machine over roles, and a template with loss flags.

Everything is a DataFrame expression. ``chat_format`` gathers the turns of a
conversation, walks them with a finite-state machine that validates their
order, and emits text segments, each with a loss flag. ``chat_parse`` reads the
turns back from the joined text.

Escapes: a backslash in a text is doubled, and a backslash is put behind the
first character of each control string, so no control string is left; one pass
over the backslashes undoes both.

Defined results: a null text or role counts as empty; turns are ordered by
``turn`` (nulls first), then role, then text; repeated rows stay repeated turns;
a null ``conv_id`` is one conversation; a role without a template entry is
marked with its escaped name, not trained on, and makes the order invalid; an
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.llm.common import table


@dataclass(frozen=True)
class Turn:
    """How the turns of a role are written, and whether their text is trained on."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """A declarative chat format.

    ``control`` lists every string that marks something, each with ``[`` or
    ``<`` first; ``moves`` the roles that may follow each state ("" at the
    start), and ``final`` the roles that a conversation may end on.
    """

    turns: dict[str, Turn] = field(
        default_factory=lambda: {
            "system": Turn("[SYS] ", " [/SYS]"),
            "user": Turn("[INST] ", " [/INST]"),
            "assistant": Turn("<s> ", " </s>", True),
        }
    )
    other: Turn = Turn("[ROLE] ", " [/ROLE]")
    colon: str = " [:] "
    control: tuple[str, ...] = ("[SYS]", "[/SYS]", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[/ROLE]", "[:]")
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)


DEFAULT = Template()


def _quoted(s: str) -> str:
    return "".join("\\" + c if c in "\\.[]{}()<>*+-=!?^$|/" else c for c in s)


def escaped(text: Column, t: Template = DEFAULT) -> Column:
    rests = "|".join(f"(?<={_quoted(c[0])})(?={_quoted(c[1:])})" for c in t.control)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), rests, r"\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _segments(turn: Column, t: Template) -> Column:
    """The segments of one turn: mark, text, mark."""

    def made(before: Column, after: Column, loss: bool) -> Column:
        return F.array(*(F.struct(s.alias("text"), F.lit(x).alias("loss")) for s, x in ((before, False), (escaped(turn["text"], t), loss), (after, False))))

    out = made(F.concat(F.lit(t.other.before), escaped(turn["role"], t), F.lit(t.colon)), F.lit(t.other.after), t.other.loss)
    for role, how in t.turns.items():
        out = F.when(turn["role"] == role, made(F.lit(how.before), F.lit(how.after), how.loss)).otherwise(out)
    return out


def _walk(turns: Column, t: Template) -> Column:
    """The state after the last turn: a role, or "!" from the first turn that may not be there."""

    def step(state: Column, turn: Column) -> Column:
        allowed = reduce(lambda a, b: a | b, ((state == s) & turn["role"].isin(*roles) for s, roles in t.moves.items()))
        return F.when(allowed, turn["role"]).otherwise(F.lit("!"))

    return F.aggregate(turns, F.lit(""), step)


def chat_format(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """One row for each conversation: conv_id, segments, formatted, valid_order."""
    turns = conversations.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("turn"))
    told = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return told.select(
        "conv_id",
        F.flatten(F.transform("turns", lambda x: _segments(x, template))).alias("segments"),
        _walk(F.col("turns"), template).isin(*template.final).alias("valid_order"),
    ).withColumn("formatted", F.concat_ws("", F.transform("segments", lambda s: s["text"])))


def chat_parse(formatted: Column, template: Template = DEFAULT) -> Column:
    """The turns, as an array of (role, text), read from a formatted text."""
    known = "|".join(f"{_quoted(how.before)}(.*?){_quoted(how.after)}" for how in template.turns.values())
    other = f"{_quoted(template.other.before)}(.*?){_quoted(template.colon)}(.*?){_quoted(template.other.after)}"
    pattern = F.lit(f"(?s)(?:{known}|{other})")
    parts = F.regexp_extract_all(formatted, pattern, F.lit(0))

    def role_of(p: Column) -> Column:
        out = unescaped(F.substring_index(F.substr(p, F.lit(len(template.other.before) + 1)), template.colon, 1))
        for role, how in template.turns.items():
            out = F.when(p.startswith(how.before), F.lit(role)).otherwise(out)
        return out

    def text_of(p: Column) -> Column:
        def cut(s: Column, before: int, after: str) -> Column:
            return F.substr(s, F.lit(before + 1), F.length(s) - F.lit(before + len(after)))

        inner = F.substr(p, F.instr(p, template.colon) + F.lit(len(template.colon)))
        out = F.substr(inner, F.lit(1), F.length(inner) - F.lit(len(template.other.after)))
        for how in template.turns.values():
            out = F.when(p.startswith(how.before), cut(p, len(how.before), how.after)).otherwise(out)
        return unescaped(out)

    return F.transform(parts, lambda p: F.struct(role_of(p).alias("role"), text_of(p).alias("text")))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every formatted conversation, read back from its text and its loss mask."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", "assistant"))))).alias("t")).select("conv_id", "t.*")
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    made = chat_format(rows)
    back = made.withColumn("back", chat_parse(F.col("formatted"))).withColumn("trained", unescaped(F.concat_ws("", F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]))))
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid_order",
    )


_ORACLE = r"""
WITH said AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *,
    length(regexp_replace(replace(text, '\', '\\'), '([\[<])(SYS\]|/SYS\]|INST\]|/INST\]|s>|/s>|ROLE\]|/ROLE\]|:\])', '\1\\\2', 'g')) AS n_text,
    length(regexp_replace(replace(role, '\', '\\'), '([\[<])(SYS\]|/SYS\]|INST\]|/INST\]|s>|/s>|ROLE\]|/ROLE\]|:\])', '\1\\\2', 'g')) AS n_role,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    lead(1) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS NULL AS ends
  FROM said)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n_text + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 ELSE n_role + 7 + 5 + 8 END) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before IN ('system', 'assistant') THEN role = 'user' WHEN before = 'user' THEN role = 'assistant' ELSE false END)
    AND bool_or(ends AND role = 'assistant') AS valid_order
FROM marked GROUP BY conv_id
"""

QUERIES = {"op7_chat": op7_chat}
ORACLES = {"op7_chat": _ORACLE}
