"""Chat formatting: a finite-state machine over roles and a declarative template with loss flags.

A conversation is one training example, so its turns are gathered into one row, ordered by turn (null first), then role
and text. The machine walks the roles: each (state, role) names the next state; a missing entry is an error from which
it does not return. Every turn gives three segments from the template: head, text, tail; only text segments of roles
under the loss mask carry the flag. Control strings inside roles and texts are escaped by one more backslash between
``<`` and ``|`` and read back by removing one, so any text survives.

Results: a null text or role is an empty one. A null id is a conversation of its own. Conversations that break the turn
order are formatted all the same and have ``valid`` false. Repeated rows are repeated turns. An empty table gives an
empty one. Only JVM expressions are used.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Texts around a turn, the roles that carry loss, and the turn order. ``{role}`` stands for the role."""

    head: str = "<|im_start|>{role}\n"
    tail: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "begin"
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("begin", "system"): "ready", ("begin", "user"): "asked", ("ready", "user"): "asked", ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    accept: tuple[str, ...] = ("answered", "asked")


CHAT = Template()
SEGMENT = "struct<turn_no:int,part:string,text:string,loss:boolean>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", "<$1|")


def _escape_role(c: Column) -> Column:
    """Roles end at the line end, so line ends inside them are escaped too."""
    return escape(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(unescape(c), r"(?<!\\)((?:\\\\)*)\\n", "$1\n"), r"\\\\", r"\\")


def format_chats(turns: DataFrame, template: Template = CHAT, key: str = "conv_id") -> DataFrame:
    """``key, n_turns, valid, end_state, segments, formatted`` of every conversation."""
    t = turns.select(
        F.col(key), F.struct(
            F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
        ).alias("_turn"),
    )
    d = t.groupBy(key).agg(F.sort_array(F.collect_list("_turn")).alias("turns"))
    table = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}\n{role}", to)])
    state = F.aggregate(
        "turns", F.lit(template.start),
        lambda s, x: F.coalesce(F.element_at(table, F.concat(s, F.lit("\n"), x["role"])), F.lit("error")),
    )
    before, after = template.head.split("{role}")

    def emit(x, i):
        part = lambda name, text, loss: F.struct(
            i.alias("turn_no"), F.lit(name).alias("part"), text.alias("text"), loss.alias("loss")
        )
        return F.array(
            part("head", F.concat(F.lit(before), _escape_role(x["role"]), F.lit(after)), F.lit(False)),
            part("text", escape(x["text"]), x["role"].isin(list(template.loss_roles))),
            part("tail", F.lit(template.tail), F.lit(False)),
        )

    d = d.withColumn("segments", F.flatten(F.transform("turns", emit))).withColumn("end_state", state)
    return d.select(
        key, F.size("turns").cast("bigint").alias("n_turns"), F.col("end_state").isin(list(template.accept)).alias("valid"),
        "end_state", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def read_back(formatted: Column, template: Template = CHAT) -> Column:
    """Turns ``(role, text)`` from a formatted conversation."""
    before, after = template.head.split("{role}")
    turns = F.filter(F.split(formatted, _quoted(before), -1), lambda p: p != "")

    def parse(p):
        body = F.substring(p, 1, F.length(p) - len(template.tail))
        cut = F.instr(body, after)
        return F.struct(
            _unescape_role(F.substring(body, 1, cut - 1)).alias("role"),
            unescape(F.substring(body, cut + len(after), F.length(body))).alias("text"),
        )

    return F.transform(turns, parse)


def _quoted(s: str) -> str:
    return "\\Q" + s + "\\E"
