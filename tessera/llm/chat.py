r"""Chat formatting: heterogeneous records to canonical turns to one template.

Records are variants.  The nested field paths of a record, with scalar types set
aside, are hashed to a fingerprint; the fingerprint selects a declarative
``Layout`` whose expressions read conversation id and turns.  Turns are rendered
as ``<|im_start|>role\ntext<|im_end|>\n``.

Escape rule, reversible: in roles and texts every ``<``, any number of ``&``, an
optional ``/`` and ``|`` in a row gains one ``&`` after the ``<``, so ``<|``
occurs in markup only; a line feed in a role becomes ``</|``.

Defined results: a null text or role is empty; turns of one conversation are
ordered by (turn, role, rendered text), nulls first, so repeated turns stay; records of
an unknown layout are returned by ``unmapped`` and never guessed; an empty
table gives no rows; extra columns do not take part.

A conversation is one training record and its digest is that of one string, so
its turns meet in one task by definition; nothing else is gathered per key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<turn:bigint,role:string,text:string>>"
PAIRS = "array<struct<{role}:string,{text}:string>>"


@dataclass(frozen=True)
class Layout:
    """Field paths of a record (arrays as ``[]``), its id's path, and SQL for its turns from variant ``v``."""

    name: str
    paths: tuple[str, ...]
    id_path: str
    turns: str

    @property
    def shape(self) -> str:
        """Paths in order, as ``record_shape`` writes them."""
        return ",".join(sorted(self.paths))


def _messages(path: str, role: str, text: str, roles: str = "m.{role}") -> str:
    kind = PAIRS.format(role=f"`{role}`", text=f"`{text}`")
    who = roles.format(role=f"`{role}`")
    return f"transform(try_variant_get(v, '$.{path}', '{kind}'), (m, i) -> struct(cast(i as bigint), {who}, m.`{text}`))"


def _said(*parts: tuple[str, str]) -> str:
    return "array(" + ", ".join(f"struct({i}L, '{role}', {text})" for i, (role, text) in enumerate(parts)) + ")"


def _text(path: str) -> str:
    return f"try_variant_get(v, '$.{path}', 'string')"


_SHARE_ROLES = "case m.{role} when 'human' then 'user' when 'gpt' then 'assistant' else m.{role} end"
LAYOUTS = (
    Layout("turn", ("conv_id", "role", "text", "turn"), "conv_id", "array(struct(try_variant_get(v, '$.turn', 'bigint'), " + _text("role") + ", " + _text("text") + "))"),
    Layout("messages", ("id", "messages[].content", "messages[].role"), "id", _messages("messages", "role", "content")),
    Layout("shared", ("conversations[].from", "conversations[].value", "id"), "id", _messages("conversations", "from", "value", _SHARE_ROLES)),
    Layout("prompt", ("completion", "id", "prompt"), "id", _said(("user", _text("prompt")), ("assistant", _text("completion")))),
    Layout("prompt_response", ("id", "prompt", "response"), "id", _said(("user", _text("prompt")), ("assistant", _text("response")))),
    Layout("question", ("answer", "id", "question"), "id", _said(("user", _text("question")), ("assistant", _text("answer")))),
    Layout("system_prompt", ("id", "prompt", "response", "system"), "id", _said(("system", _text("system")), ("user", _text("prompt")), ("assistant", _text("response")))),
    Layout("instruction", ("id", "instruction", "output"), "id", _said(("user", _text("instruction")), ("assistant", _text("output")))),
    Layout(
        "instruction_input",
        ("id", "input", "instruction", "output"),
        "id",
        _said(("user", f"concat_ws('\\n\\n', {_text('instruction')}, nullif({_text('input')}, ''))"), ("assistant", _text("output"))),
    ),
)


def record_shape(record: Column) -> Column:
    """Nested field paths of a variant, in order, without scalar types: ``id,messages[].role``.

    The engine describes a variant as OBJECT<a: T, b: ARRAY<OBJECT<c: T>>>; objects
    one array deep cover the layouts, deeper ones keep their description.
    """
    s = F.regexp_replace(F.schema_of_variant(record), r"\b(?:STRING|VOID|BOOLEAN|BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\))", "_")
    fields = F.regexp_extract(s, r"^OBJECT<(.*)>$", 1)
    parts = F.regexp_extract_all(fields, F.lit(r"(?:[^,<>]|<(?:[^<>]|<[^<>]*>)*>)+"), F.lit(0))

    def paths(part: Column) -> Column:
        name = F.trim(F.substring_index(part, ": ", 1))
        kind = F.trim(F.right(part, F.char_length(part) - F.char_length(F.substring_index(part, ": ", 1)) - 2))
        inner = F.regexp_extract(kind, r"^ARRAY<OBJECT<([^<>]*)>>$", 1)
        nested = F.transform(F.split(inner, ", "), lambda f: F.concat(name, F.lit("[]."), F.substring_index(f, ": ", 1)))
        return F.when(inner != "", nested).otherwise(F.array(F.when(kind == "_", name).otherwise(F.concat(name, F.lit(": "), kind))))

    return F.array_join(F.sort_array(F.flatten(F.transform(parts, paths))), ",")


def fingerprint(record: Column) -> Column:
    """Hash of a record's field paths."""
    return F.xxhash64(record_shape(record))


def canonical_turns(records: DataFrame, record: str = "record") -> DataFrame:
    """(conv_id, turn, role, text), one row per turn of every record with a known layout."""
    known = records.select(F.col(record).alias("v")).withColumn("print", fingerprint(F.col("v")))
    turns, conv = F.lit(None).cast(TURNS), F.lit(None).cast("bigint")
    for layout in LAYOUTS:
        here = F.col("print") == F.xxhash64(F.lit(layout.shape))
        turns = F.when(here, F.expr(layout.turns).cast(TURNS)).otherwise(turns)
        conv = F.when(here, F.expr(f"try_variant_get(v, '$.{layout.id_path}', 'bigint')")).otherwise(conv)
    return known.select(conv.alias("conv_id"), F.explode(turns).alias("t")).select("conv_id", "t.turn", "t.role", "t.text")


def unmapped(records: DataFrame, record: str = "record") -> DataFrame:
    """Records whose field paths no layout describes, with their paths."""
    shapes = [x.shape for x in LAYOUTS]
    return records.withColumn("shape", record_shape(F.col(record))).where(~F.coalesce(F.col("shape").isin(shapes), F.lit(False)))


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(&*/?\|)", "<&$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<&(&*/?\|)", "<$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("</|"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("</|"), F.lit("\n")))


def format_chats(turns: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask.

    ``loss_mask`` lists for each trained turn its number from 0, the place of its
    first trained character within the rendered turn, and the count of characters.
    """
    body, head = escape(F.col("text")), F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    mask = F.struct(F.char_length(head).alias("start"), F.char_length(body).alias("chars"), F.col("role").isin(*trained).alias("on"))
    shown = turns.select("conv_id", F.struct("turn", "role").alias("place"), F.concat(head, body, F.lit(END + "\n")).alias("shown"), mask.alias("m"))
    chats = shown.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "shown", "m"))).alias("t"))
    spans = F.transform("t", lambda x, i: F.struct(i.alias("turn"), x["m"]["start"].alias("start"), x["m"]["chars"].alias("chars"), x["m"]["on"].alias("on")))
    spans = F.transform(F.filter(spans, lambda s: F.coalesce(s["on"], F.lit(False))), lambda s: s.dropFields("on"))
    return chats.select("conv_id", F.array_join(F.transform("t", lambda x: x["shown"]), "").alias("formatted"), spans.alias("loss_mask"))


def read_back(chats: DataFrame) -> DataFrame:
    """Turns and trained text of formatted chats: conv_id, turns (role, text), loss_text."""
    rendered = F.split(F.col("formatted"), r"<\|im_end\|>\n")
    c = chats.select("conv_id", "formatted", "loss_mask", F.slice(rendered, F.lit(1), F.size(rendered) - 1).alias("r"))

    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        text = F.right(x, F.char_length(x) - F.char_length(role) - 1)
        return F.struct(unescape_role(F.right(role, F.char_length(role) - len(START))).alias("role"), unescape(text).alias("text"))

    said = F.transform("loss_mask", lambda s: unescape(F.substr(F.element_at("r", s["turn"] + 1), s["start"] + 1, s["chars"])))
    return c.select("conv_id", "formatted", F.transform("r", turn).alias("turns"), F.array_join(said, "").alias("loss_text"))
