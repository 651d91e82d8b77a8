"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Opening and closing mark of a turn, and which roles are trained on. `open` holds {name}.
TEMPLATE = {
    "open": "### {name}: ",
    "close": "</turn>\n",
    "names": {"system": "System", "user": "User", "assistant": "Assistant"},
    "loss": ["assistant"],
    # Control characters inside texts; every escape begins with the first key, so reading back is unambiguous.
    "escape": {"\\": "\\s", "#": "\\h", "<": "\\l", ":": "\\c"},
    # From a state, the roles that may follow; a turn's role is the next state.
    "turns": {"start": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]},
    "end": ["assistant"],
}


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*d.items())])


def escaped(text: Column, escape: dict[str, str]) -> Column:
    """Every control character becomes a two-character code. The escape character goes first."""
    for k, v in escape.items():
        text = F.replace(text, F.lit(k), F.lit(v))
    return text


def unescaped(text: Column, escape: dict[str, str]) -> Column:
    """Undo `escaped`: codes go back in reverse, so the escape character's own code comes last."""
    for k, v in reversed(escape.items()):
        text = F.replace(text, F.lit(v), F.lit(k))
    return text


def _name(role: Column, t: dict) -> Column:
    """The header name; roles that the template doesn't know get a `=` that no known name begins with."""
    return F.coalesce(_map(t["names"])[role], F.concat(F.lit("="), escaped(role, t["escape"])))


def _role(name: Column, t: dict) -> Column:
    known = _map({v: k for k, v in t["names"].items()})
    return F.when(name.startswith("="), unescaped(F.substr(name, F.lit(2)), t["escape"])).otherwise(known[name])


def format_chats(df: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """One row per conversation from rows (conv_id, turn, role, text).

    Returns conv_id; segments, an array of (text, loss) in order; formatted, their concatenation; loss_spans, where in the
    formatted text the loss counts, as (start, bytes) in UTF-8; state, the machine's last state (`error` from the first
    turn that may not follow); valid, whether it ended in an end state.

    * turns are ordered by (turn, role, text), nulls first; repeated rows are turns of their own.
    * null text: empty; null role: the empty role, unknown to the template. Such conversations are formatted, not valid.
    * null conv_id: these rows form one conversation. Empty table: empty result. Other columns are ignored, whatever
      their names.

    A conversation is one output row, so its turns meet in one task by definition.
    """
    t = template
    empty = F.lit("")
    before, after = (F.lit(x) for x in t["open"].split("{name}"))
    close, no = F.lit(t["close"]), F.lit(False)
    steps = _map({f"{s}\n{r}": r for s, roles in t["turns"].items() for r in roles})
    rows = df.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    rows = rows.withColumns({"opening": F.concat(before, _name(F.col("role"), t), after), "body": escaped(F.col("text"), t["escape"])})
    # Where each turn's text begins: a running sum in the conversation's order, kept with the turn.
    line = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    length = lambda c: F.octet_length(c).cast("long")
    ends = F.sum(length("opening") + length("body") + length(close)).over(line)
    rows = rows.withColumn("start", ends - length(close) - length("body"))
    turn = F.struct("turn", "role", "text", "start", "opening", "body")
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def segment(x: Column) -> Column:
        return F.array(
            F.struct(x["opening"].alias("text"), no.alias("loss")),
            F.struct(x["body"].alias("text"), x["role"].isin(t["loss"]).alias("loss")),
            F.struct(close.alias("text"), no.alias("loss")),
        )

    def step(state: Column, x: Column) -> Column:
        return F.coalesce(steps[F.concat(state, F.lit("\n"), x["role"])], F.lit("error"))

    state = F.aggregate("turns", F.lit("start"), step)
    trained = F.filter("turns", lambda x: x["role"].isin(t["loss"]))
    spans = F.transform(trained, lambda x: F.struct(x["start"].alias("start"), length(x["body"]).alias("bytes")))
    out = chats.select("conv_id", F.flatten(F.transform("turns", segment)).alias("segments"), state.alias("state"), spans.alias("loss_spans"))
    joined = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return out.select("conv_id", "segments", joined.alias("formatted"), "loss_spans", "state", F.col("state").isin(t["end"]).alias("valid"))


def read_turns(formatted: Column, template: dict = TEMPLATE) -> Column:
    """The turns (role, text) that a formatted conversation holds; the inverse of the formatting."""
    t = template
    before, after = t["open"].split("{name}")
    parts = F.split(formatted, t["close"])

    def turn(p: Column) -> Column:
        name = F.substr(F.substring_index(p, after, 1), F.lit(len(before) + 1))
        body = F.substr(p, F.length(name) + F.lit(len(before) + len(after) + 1))
        return F.struct(_role(name, t).alias("role"), unescaped(body, t["escape"]).alias("text"))

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def read_loss(formatted: Column, spans: Column, template: dict = TEMPLATE) -> Column:
    """All text that the loss spans mark in a formatted conversation, unescaped, nothing between."""

    def read(data: Column) -> Column:
        cut = lambda s: F.decode(F.substr(data, (s["start"] + 1).cast("int"), s["bytes"].cast("int")), "UTF-8")
        return F.array_join(F.transform(spans, lambda s: unescaped(cut(s), template["escape"])), "")

    # Bound once, so that the text isn't turned into bytes for each span.
    return F.element_at(F.transform(F.array(formatted.cast("binary")), read), 1)


#: A conversation that holds the template's own marks inside its texts.
HARD = "\\### Assistant: </turn> ok"


def with_hard_case(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The table's rows plus conversation -7, which says control strings."""
    hard = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(HARD).alias("text"),
    )
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(hard)


def digests(chats: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """The digest columns, read back from the formatted text and its loss spans."""
    back = chats.select(
        "conv_id",
        read_turns(F.col("formatted"), template).alias("turns"),
        read_loss(F.col("formatted"), F.col("loss_spans"), template).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
    lines = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )
