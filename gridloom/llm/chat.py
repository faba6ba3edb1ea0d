"""Chat formatting: a state machine over roles and a declarative template.

``chat_format`` turns rows (conversation, turn, role, text) into one formatted
string per conversation, as segments with a loss flag each.  Control strings in
texts are escaped so that markers of the template cannot be forged, and
``chat_parse`` reads the turns back.  All of it is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """A turn is ``open + role + head + text + close``; markers contain ``<`` and ``>``
    where texts have escapes, so neither can be taken for the other."""

    open: str = "<turn "
    head: str = ">"
    close: str = "</turn>"
    #: roles whose text counts for the loss
    loss_roles: tuple[str, ...] = ("assistant",)
    #: from each state (the role before, "" at the start) the roles that may follow
    order: Mapping[str, tuple[str, ...]] = field(
        default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )


#: Escapes in the order in which they are applied; ``chat_parse`` undoes them backwards.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def _order_valid(turns: Column, template: Template) -> Column:
    """Runs the machine over the roles; a missing transition leads to the dead state."""
    moves = F.create_map(*[x for state, roles in template.order.items() for role in roles for x in (F.lit(f"{state}\n{role}"), F.lit(role))])
    dead = F.lit("\n")
    return F.aggregate(turns, F.lit(""), lambda state, t: F.coalesce(F.try_element_at(moves, F.concat(state, F.lit("\n"), t["role"])), dead)) != dead


def chat_format(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation: conv_id, turn_order_valid, segments, formatted.

    ``segments`` is an array of (text, loss) whose texts concatenate to
    ``formatted``.  Turns sort by turn (nulls first), ties by role and text, and
    repeated rows are repeated turns.  A null role or text is empty; rows with a
    null conv_id form one conversation.  Turn order is reported, never enforced:
    conversations that break it are formatted all the same.  Other columns are
    ignored.  An empty table gives an empty one.
    """
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn), _before).alias("turns"))

    def parts(t: Column) -> Column:
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            piece(F.concat(F.lit(template.open), escape(t["role"]), F.lit(template.head)), F.lit(False)),
            piece(escape(t["text"]), t["role"].isin(*template.loss_roles)),
            piece(F.lit(template.close), F.lit(False)),
        )

    return grouped.select(
        "conv_id",
        _order_valid(F.col("turns"), template).alias("turn_order_valid"),
        F.flatten(F.transform("turns", parts)).alias("segments"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def _before(a: Column, b: Column) -> Column:
    """Comparator for array_sort: by turn with nulls first, then role, then text."""
    key = lambda x: F.struct(x["turn"], x["role"], x["text"])
    return F.when(key(a) < key(b), F.lit(-1)).when(key(a) > key(b), F.lit(1)).otherwise(F.lit(0))


def chat_parse(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Reads ``turns`` (role, text) and ``loss_text`` back from formatted and segments."""
    turn = rf"\Q{template.open}\E([^<>]*)\Q{template.head}\E([^<>]*)\Q{template.close}\E"
    found = lambda group: F.regexp_extract_all("formatted", F.lit(turn), F.lit(group))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), "")
    return formatted.withColumn(
        "turns", F.arrays_zip(found(1).alias("role"), found(2).alias("text"))
    ).withColumns(
        {
            "turns": F.transform("turns", lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text"))),
            "loss_text": unescape(loss),
        }
    )
