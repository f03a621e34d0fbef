"""Chat formatting by a finite-state machine over roles (DataFrame operations only).

A declarative ``Template`` names, for each role, the strings put before and after a turn's text, whether the text
carries loss, and the transitions of the machine. Every turn becomes three segments (opening mark, text, closing
mark), each with a loss flag; the formatted conversation is their concatenation. Control strings inside texts are
escaped reversibly (``&`` becomes ``&amp;`` and the first character of a control string an entity), so a text can
never open or close a turn, and ``read_back`` recovers roles and texts from the formatted string alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Any string that could be read as a mark, without its first character, by that character.
CONTROL = {"<": r"(?=/?s>|<?/?SYS>>|/?TURN>)", "[": r"(?=/?INST\])"}
ENTITY = {"<": "&lt;", "[": "&lb;"}


@dataclass(frozen=True)
class Role:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    roles: dict[str, Role] = field(
        default_factory=lambda: {
            "system": Role("<<SYS>>\n", "\n<</SYS>>\n"),
            "user": Role("[INST] ", " [/INST]"),
            "assistant": Role("<s>", "</s>", loss=True),
        }
    )
    #: Opens a turn of any other role; its name, escaped, stands between the two parts.
    other: tuple[str, str, str] = ("<TURN>", "<s>", "</TURN>")
    #: state -> role -> next state; a pair that isn't listed is an error of turn order.
    start: str = "start"
    machine: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "primed", "user": "asked"},
            "primed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    accepting: tuple[str, ...] = ("answered",)


DEFAULT = Template()


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for first, rest in CONTROL.items():
        out = F.regexp_replace(out, ("\\" if first == "[" else "") + first + rest, ENTITY[first])
    return out


def unescape(text: Column) -> Column:
    for first, entity in ENTITY.items():
        text = F.replace(text, F.lit(entity), F.lit(first))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def _by_role(role: Column, values: dict[str, Column], otherwise: Column) -> Column:
    out = None
    for name, value in values.items():
        out = F.when(role == name, value) if out is None else out.when(role == name, value)
    return out.otherwise(otherwise) if out is not None else otherwise


def format_chats(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """One row per conversation: ``conv_id, valid, final_state, formatted, segments``.

    ``segments`` is an array of (text, loss) in order. Turns are put in order of ``turn`` (null first), then role,
    then text; repeated rows are turns of their own. A null text is an empty one and a null role an empty name. Rows
    with a null conv_id form one conversation. Roles that the template doesn't name are kept under a mark that holds
    their name, never carry loss, and make the conversation invalid. Invalid conversations are formatted like the
    others, with ``valid`` false. Other columns are ignored.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    r = F.col("role")
    first, middle, last = template.other
    before = _by_role(r, {k: F.lit(v.before) for k, v in template.roles.items()}, F.concat(F.lit(first), escape(r), F.lit(middle)))
    after = _by_role(r, {k: F.lit(v.after) for k, v in template.roles.items()}, F.lit(last))
    loss = _by_role(r, {k: F.lit(v.loss) for k, v in template.roles.items()}, F.lit(False))
    packed = rows.select(
        "conv_id",
        F.struct("turn", "role", escape(F.col("text")).alias("text"), before.alias("before"), after.alias("after"), loss.alias("loss")).alias("t"),
    )
    gathered = packed.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def step(state: Column, t: Column) -> Column:
        out = None
        for at, moves in template.machine.items():
            for role, to in moves.items():
                hit = (state == at) & (t["role"] == role)
                out = F.when(hit, F.lit(to)) if out is None else out.when(hit, F.lit(to))
        return out.otherwise(F.lit("error"))

    segment = lambda text, flag: F.struct(text.alias("text"), flag.alias("loss"))
    segments = F.flatten(
        F.transform(
            "ts",
            lambda t: F.array(segment(t["before"], F.lit(False)), segment(t["text"], t["loss"]), segment(t["after"], F.lit(False))),
        )
    )
    return (
        gathered.select("conv_id", F.aggregate("ts", F.lit(template.start), step).alias("final_state"), segments.alias("segments"))
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
        .select("conv_id", F.col("final_state").isin(*template.accepting).alias("valid"), "final_state", "formatted", "segments")
    )


def _marks(template: Template) -> str:
    """A pattern of all marks; longer ones first where one holds another."""
    quoted = lambda s: "".join("\\" + c if not c.isalnum() and c not in "\n <>/" else c for c in s)
    first, middle, last = template.other
    named = {quoted(x) for v in template.roles.values() for x in (v.before, v.after)}
    return "|".join([quoted(first) + "[^<]*(?:<(?!s>)[^<]*)*?" + quoted(middle), quoted(last), *sorted(named, key=lambda s: (-len(s), s))])


def read_back(formatted: Column, template: Template = DEFAULT) -> Column:
    """The array of (role, text) that a formatted string holds, in order."""
    pattern = _marks(template)
    first, middle, _ = template.other
    marks = F.regexp_extract_all(formatted, F.lit(f"(?s){pattern}"), F.lit(0))
    bodies = F.split(formatted, f"(?s){pattern}", -1)

    def turn(z: Column) -> Column:
        mark = z["mark"]
        name = None
        for role, v in template.roles.items():
            name = F.when(mark == v.before, F.lit(role)) if name is None else name.when(mark == v.before, F.lit(role))
        name = name.otherwise(unescape(F.substring(mark, F.lit(len(first) + 1), F.char_length(mark) - len(first) - len(middle))))
        return F.struct(name.alias("role"), unescape(z["body"]).alias("text"))

    # opening and closing marks alternate; the body after an opening one is a turn's text
    after = F.slice(bodies, F.lit(2), F.greatest(F.size(bodies) - 1, F.lit(0)))
    pairs = F.zip_with(marks, after, lambda m, b: F.struct(m.alias("mark"), b.alias("body")))
    return F.transform(F.filter(pairs, lambda z, k: k % 2 == 0), turn)
