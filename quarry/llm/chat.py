"""Chat formatting by schema fingerprints.

A record is a JSON text in any of several layouts.  The paths of its nested
fields are listed, sorted and hashed; the hash selects a declarative mapping
(``LAYOUTS``) that turns the record into canonical turns (role, text).  The
template marks turns; control strings inside texts, its own and those of
other templates, are escaped by one more backslash after their first
character, so reading back removes one.  Everything is DataFrame expressions.

Defined cases: a null text or role is empty; turns of a conversation are
ordered by turn (null first), then role and text, and repeated rows are
turns of their own; a null conversation id is one conversation; an unknown
layout (also one that only some elements of a list depart from) gives null
turns and keeps its fingerprint for inspection; a text that is itself a list
or an object is its JSON; a record
with an empty list of messages has no turns; extra columns do not matter.
A conversation is one value in the end (its digest needs all of it in
order), so it is bounded by what one row can hold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: control strings of this and of other common templates
CONTROL = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_REST = "|".join(c[1:].replace("|", r"\|").replace("]", r"\]") for c in CONTROL)
_ESCAPE = rf"([<\[])(\\*)({_REST})"
_UNESCAPE = rf"([<\[])\\(\\*)({_REST})"
TURNS = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def _role_out(role: Column) -> Column:
    """A role is one line: percent signs and line ends are coded."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


@dataclass(frozen=True)
class Layout:
    """Field paths of a layout, its schema, and for flat layouts (role, field) in order."""

    paths: tuple
    schema: str
    fields: tuple = ()
    container: str = ""
    role: str = ""
    text: str = ""
    roles: tuple = ()          # (name in the layout, canonical role)


_LIST = "array<struct<{0}:string,{1}:string>>"
LAYOUTS = {
    "messages": Layout(("messages", "messages[].content", "messages[].role"),
                       "messages " + _LIST.format("role", "content"), (), "messages", "role", "content"),
    "no_messages": Layout(("messages",), "messages " + _LIST.format("role", "content"), (), "messages", "role", "content"),
    "share": Layout(("conversations", "conversations[].from", "conversations[].value"),
                    "conversations " + _LIST.format("from", "value"), (), "conversations", "from", "value",
                    (("human", "user"), ("gpt", "assistant"))),
    "prompt": Layout(("completion", "prompt"), "prompt string, completion string",
                     (("user", "prompt"), ("assistant", "completion"))),
    "system_prompt": Layout(("completion", "prompt", "system"), "system string, prompt string, completion string",
                            (("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    "instruction": Layout(("input", "instruction", "output"), "instruction string, input string, output string",
                          (("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    "instruction_only": Layout(("instruction", "output"), "instruction string, output string",
                               (("user", "instruction"), ("assistant", "output"))),
}
_CONTAINERS = tuple(sorted({x.container for x in LAYOUTS.values() if x.container}))


def pin(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns computed once per row: a generator keeps the optimiser from copying them into lambdas."""
    for name, value in columns.items():
        df = df.select("*", F.explode(F.array(value)).alias(name))
    return df


def fingerprint(record: Column) -> Column:
    """Hash of the sorted nested field paths of a JSON record, over all elements of its containers."""
    none = F.array().cast("array<string>")
    top = F.coalesce(F.json_object_keys(record), none)
    schema = ", ".join(f"{c} array<map<string,string>>" for c in _CONTAINERS)
    parsed = F.from_json(record, schema, {"maxStringLen": "2000000000"})

    def inside(container):
        items = parsed[container]
        keys = F.array_distinct(F.flatten(F.transform(items, F.map_keys)))
        # a container that is no list of objects with fields has a path of its own, which no layout knows
        odd = F.array_contains(top, container) & F.coalesce(F.exists(items, lambda x: x.isNull() | (F.size(x) == 0)), F.lit(True))
        return F.concat(F.coalesce(F.transform(keys, lambda k: F.concat(F.lit(container + "[]."), k)), none),
                        F.when(odd, F.array(F.lit(container + "[]"))).otherwise(none))

    nested = [inside(c) for c in _CONTAINERS]
    return F.xxhash64(F.array_join(F.array_sort(F.concat(top, *nested)), "|"))


def _expected(layout: Layout) -> Column:
    return F.xxhash64(F.lit("|".join(sorted(layout.paths))))


def _turns(record: Column, layout: Layout) -> Column:
    parsed = F.from_json(record, layout.schema, {"maxStringLen": "2000000000"})
    if not layout.container:
        return F.array(*[F.struct(F.lit(r).alias("role"), F.coalesce(parsed[f], F.lit("")).alias("text"))
                         for r, f in layout.fields])

    def role(r):
        out = F.coalesce(r, F.lit(""))
        for name, canonical in layout.roles:
            out = F.when(r == name, canonical).otherwise(out)
        return out
    return F.transform(parsed[layout.container], lambda m: F.struct(
        role(m[layout.role]).alias("role"), F.coalesce(m[layout.text], F.lit("")).alias("text")))


def canonical_turns(records: DataFrame, record: str = "record") -> DataFrame:
    """``records`` with layout, fingerprint and turns (null for an unknown layout)."""
    df = pin(records, fingerprint=fingerprint(F.col(record)))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for name, spec in LAYOUTS.items():
        is_it = F.col("fingerprint") == _expected(spec)
        layout = F.when(is_it, F.lit(name)).otherwise(layout)
        turns = F.when(is_it, _turns(F.col(record), spec)).otherwise(turns)
    return pin(df.withColumn("layout", layout), turns=turns)


def render(turns: Column) -> Column:
    """Turns as one formatted text."""
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit(OPEN), _role_out(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(CLOSE))), "")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text, read from its markers."""
    parts = F.filter(F.split(formatted, F.lit(r"<\|im_end\|>\n")), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(
        _role_in(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), "\n", 1)).alias("role"),
        unescape(F.substr(p, F.locate("\n", p) + 1)).alias("text")))


def format_chats(records: DataFrame, record: str = "record") -> DataFrame:
    """``records`` with layout, fingerprint, turns and the formatted text."""
    return pin(canonical_turns(records, record), formatted=render(F.col("turns")))


def loss_text(turns: Column) -> Column:
    """All text under the loss mask, which covers the assistant's texts."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")


def records_of(conversations: DataFrame) -> DataFrame:
    """Rows by turn as one JSON record per conversation, in the layout its shape suggests."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = F.col("t")
    per = pin(conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t")),
              roles=F.transform("t", lambda x: x["role"]))
    is_ = lambda *r: F.col("roles") == F.array(*map(F.lit, r))
    shared = F.forall("roles", lambda r: r.isin("user", "assistant"))
    name = lambda r: F.when(r == "user", "human").otherwise("gpt")
    opts = {"ignoreNullFields": "false"}
    record = (F.when(is_("user", "assistant"), F.to_json(F.struct(
                  F.get(t, 0)["text"].alias("prompt"), F.get(t, 1)["text"].alias("completion")), opts))
              .when(is_("system", "user", "assistant"), F.to_json(F.struct(
                  F.get(t, 0)["text"].alias("system"), F.get(t, 1)["text"].alias("prompt"),
                  F.get(t, 2)["text"].alias("completion")), opts))
              .when(shared, F.to_json(F.struct(F.transform(t, lambda x: F.struct(
                  name(x["role"]).alias("from"), x["text"].alias("value"))).alias("conversations")), opts))
              .otherwise(F.to_json(F.struct(F.transform(t, lambda x: F.struct(
                  x["role"].alias("role"), x["text"].alias("content"))).alias("messages")), opts)))
    return pin(per.select("conv_id", record.alias("_r")), record=F.col("_r")).select("conv_id", "record")


def op10_chat_formatting(spark, sf_dir) -> DataFrame:
    """Digest of every conversation, read back from its formatted text."""
    from quarry.llm.io import read

    own = spark.sql("""select cast(-1 as bigint) conv_id, cast(turn as bigint) turn, role,
        '</s>[INST] ok [/INST]' text from values (0, 'user'), (1, 'assistant') as v(turn, role)""")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    back = pin(format_chats(records_of(rows)).select("conv_id", "layout", "formatted"), back=read_back(F.col("formatted")))
    back = pin(back, loss=loss_text(F.col("back")))
    all_turns = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(all_turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
