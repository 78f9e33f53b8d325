"""Tool-call linking for chat data, in DataFrame functions alone.

Items of conversations (calls, results, plain texts) are hash-joined by conversation and call identifier, put in an
order in which a call follows all it depends on, validated against the tools' schemas, and written as canonical JSON
(keys sorted, no white space, one line an item).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import persisted

ITEM = "conv_id bigint, turn bigint, nth int, kind string, role string, call_id string, name string, arguments string, depends_on array<string>, content string"
#: Types an argument may be asked to have, as schema_of_variant names them.
TYPES = {"string": r"STRING", "integer": r"BIGINT", "number": r"BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": r"BOOLEAN", "array": r"ARRAY<.*", "object": r"OBJECT<.*"}


@dataclass(frozen=True)
class Param:
    name: str
    type: str
    required: bool = True
    one_of: tuple[str, ...] = ()


@dataclass(frozen=True)
class Tool:
    name: str
    params: tuple[Param, ...]
    extra: bool = False


def parse_messages(messages: DataFrame) -> DataFrame:
    """Items from rows (conv_id, turn, role, text) whose JSON texts carry tool_calls (assistant) or tool_call_id (tool).

    An assistant text without a readable tool_calls array, a tool text without tool_call_id, and every other role are
    plain texts. Null texts are empty plain texts.
    """
    shape = "tool_calls array<struct<id:string,name:string,arguments:string,depends_on:array<string>>>, tool_call_id string, content string"
    read = messages.select("conv_id", "turn", "role", "text", F.from_json("text", shape).alias("j"))
    calls = F.when((F.col("role") == "assistant") & (F.size("j.tool_calls") > 0), F.transform("j.tool_calls", lambda c, i: F.struct(i.alias("nth"), F.lit("call").alias("kind"), c["id"].alias("call_id"), c["name"].alias("name"), c["arguments"].alias("arguments"), F.coalesce(c["depends_on"], F.array().cast("array<string>")).alias("depends_on"), F.lit(None).cast("string").alias("content"))))
    one = lambda kind, call_id, content: F.array(F.struct(F.lit(0).alias("nth"), F.lit(kind).alias("kind"), call_id.alias("call_id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"), F.array().cast("array<string>").alias("depends_on"), content.alias("content")))
    result = F.when((F.col("role") == "tool") & F.col("j.tool_call_id").isNotNull(), one("result", F.col("j.tool_call_id"), F.coalesce("j.content", F.lit(""))))
    items = F.coalesce(calls, result, one("text", F.lit(None).cast("string"), F.coalesce("text", F.lit(""))))
    return read.select("conv_id", "turn", "role", F.explode(items).alias("i")).select("conv_id", "turn", "i.nth", "i.kind", "role", "i.call_id", "i.name", "i.arguments", "i.depends_on", "i.content")


def _problems(arguments: Column, name: Column, tools: list[Tool]) -> Column:
    """What is wrong with a call's arguments; an empty array if nothing is."""
    value = F.try_parse_json(arguments)
    keys = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
    out = F.array(F.lit("unknown tool"))
    for t in tools:
        checks = []
        for p in t.params:
            there, path = F.array_contains(keys, p.name), f"$['{p.name}']"
            kind = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
            if p.required:
                checks.append(F.when(~there, F.lit(f"missing {p.name}")))
            checks.append(F.when(there & ~F.coalesce(kind, F.lit("VOID")).rlike(f"^({TYPES[p.type]})$"), F.lit(f"{p.name} is not {p.type}")))
            if p.one_of:
                checks.append(F.when(there & ~F.coalesce(F.try_variant_get(value, path, "string"), F.lit("")).isin(*p.one_of), F.lit(f"{p.name} is not allowed")))
        if not t.extra:
            checks.append(F.when(F.size(F.array_except(keys, F.array(*[F.lit(p.name) for p in t.params]).cast("array<string>"))) > 0, F.lit("unknown argument")))
        found = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
        out = F.when(name == t.name, found).otherwise(out)
    broken = ~F.coalesce(F.schema_of_variant(value), F.lit("VOID")).startswith("OBJECT")
    return F.when(broken, F.array(F.lit("arguments are not a JSON object"))).otherwise(out)


#: Columns that name a conversation; a null id is a conversation like any other.
_CONV = ["conv", "none"]


def _peeled(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv, none, call_id, stage) of the calls in conversations that have an edge against their written order.

    Kahn's rounds: a call's stage is the round in which all it depends on is placed; calls on or behind a cycle get none.
    """
    odd = edges.where(~F.col("in_order")).select(*_CONV).distinct()
    left = persisted(calls.join(odd, _CONV, "left_semi").select(*_CONV, "call_id"), "chat-calls")
    edges = persisted(edges.join(odd, _CONV, "left_semi").select(*_CONV, "call_id", "dep"), "chat-edges")
    done, stage = None, 0
    while True:
        free = persisted(left.join(edges, [*_CONV, "call_id"], "left_anti").withColumn("stage", F.lit(stage)), "chat-free")
        if free.isEmpty():
            break
        done = free if done is None else done.unionByName(free)
        left = persisted(left.join(free, [*_CONV, "call_id"], "left_anti"), "chat-calls")
        placed = free.select(*_CONV, F.col("call_id").alias("dep"))
        edges = persisted(edges.join(placed, [*_CONV, "dep"], "left_anti").select(*_CONV, "call_id", "dep"), "chat-edges")
        stage += 1
    rest = left.withColumn("stage", F.lit(None).cast("int"))
    return rest if done is None else done.unionByName(rest)


def _canonical() -> Column:
    """An item as one line of JSON, keys sorted; arguments that are no JSON stand as a string in "unread"."""
    arguments = F.coalesce(F.try_parse_json("arguments"), F.parse_json(F.to_json(F.struct(F.col("arguments").alias("unread")))))
    return (
        F.when(F.col("kind") == "call", F.to_json(F.struct(arguments.alias("arguments"), F.col("call_id").alias("id"), "name", "role", F.lit("call").alias("type"))))
        .when(F.col("kind") == "result", F.to_json(F.struct("content", F.col("call_id").alias("id"), "role", F.lit("result").alias("type"))))
        .otherwise(F.to_json(F.struct("content", "role", F.lit("text").alias("type"))))
    )


def link(items: DataFrame, tools: list[Tool]) -> DataFrame:
    """One row per item: conv_id, stage, turn, nth, kind, call_id, status, problems, json; read by (stage, turn, nth).

    status of a call: ok, invalid (see problems), unanswered, duplicate (an earlier call of the conversation has its id),
    cycle (it depends on itself by way of others, or on a call that does). Of a result: ok, orphan, duplicate. Of a text: ok.
    stage is 0 in conversations whose calls already follow what they depend on; elsewhere the round of the topological order,
    and a result has its call's; null for cycles. Dependencies on ids that are no call of the conversation are ignored. Calls
    and results without an id are unanswered and orphans. Items of one id at one (turn, nth) come by their canonical JSON, and
    what a call depends on is what the first says; items equal in all of these share one status. Rows with a null conv_id
    are one conversation. Empty input gives no rows; further columns are ignored.
    """
    items = items.select("conv_id", "turn", "nth", "kind", "role", "call_id", "name", "arguments", "depends_on", "content")
    items = items.withColumns({"conv": F.coalesce("conv_id", F.lit(0)), "none": F.col("conv_id").isNull(), "json": _canonical()})
    keys, place = [*_CONV, "call_id"], F.struct("turn", "nth", "json")
    named = items.where(F.col("call_id").isNotNull())
    call = named.where(F.col("kind") == "call").groupBy(*keys).agg(F.min(place).alias("call_at"), F.min(F.struct("turn", "nth", "json", F.array_sort("depends_on").alias("depends_on"))).getField("depends_on").alias("depends_on"))
    result = named.where(F.col("kind") == "result").groupBy(*keys).agg(F.min(place).alias("result_at"))
    edges = call.select(*keys, "call_at", F.explode(F.array_distinct("depends_on")).alias("dep")).join(call.select(*_CONV, F.col("call_id").alias("dep"), F.col("call_at").alias("dep_at")), [*_CONV, "dep"])
    edges = persisted(edges.select(*keys, "dep", (F.col("dep_at") < F.col("call_at")).alias("in_order")), "chat-deps")
    ids = call.select(*keys, "call_at").join(result, keys, "full")
    if edges.where(~F.col("in_order")).isEmpty():
        ids = ids.withColumns({"stage": F.lit(0), "cycle": F.lit(False)})
    else:
        peeled = _peeled(call, edges).withColumn("seen", F.lit(True))
        ids = ids.join(peeled, keys, "left").withColumn("cycle", F.coalesce("seen", F.lit(False)) & F.col("stage").isNull()).withColumn("stage", F.when(~F.col("cycle"), F.coalesce("stage", F.lit(0)))).drop("seen")
    linked = items.join(ids, keys, "left")
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    problems = F.when(is_call, _problems(F.col("arguments"), F.col("name"), tools)).otherwise(F.array().cast("array<string>"))
    checked = linked.withColumn("problems", problems)
    status = (
        F.when(is_call & F.coalesce(F.col("call_at") < place, F.lit(False)), "duplicate")
        .when(is_call & F.coalesce("cycle", F.lit(False)), "cycle")
        .when(is_call & (F.size("problems") > 0), "invalid")
        .when(is_call & F.col("result_at").isNull(), "unanswered")
        .when(is_result & F.col("call_at").isNull(), "orphan")
        .when(is_result & (F.col("result_at") < place), "duplicate")
        .otherwise("ok")
    )
    stage = F.when(F.coalesce("cycle", F.lit(False)), F.lit(None)).otherwise(F.coalesce("stage", F.lit(0))).cast("int")
    return checked.select("conv_id", stage.alias("stage"), "turn", "nth", "kind", "call_id", status.alias("status"), F.array_join("problems", "; ").alias("problems"), "json")


#: The tool of exchanges(): what is said in a turn.
SAY = Tool("say", (Param("role", "string", one_of=("system", "user")), Param("text", "string"), Param("turn", "integer")))
#: Turns among which a call of exchanges() finds what it depends on, and of how many texts one names its turn by a string.
REACH, ODD = 8, 5


def exchanges(messages: DataFrame) -> DataFrame:
    """Items of plain conversations, which hold no tool calls: each turn that isn't the assistant's is a call of `say`, named by
    its turn; an assistant's turn is the result for the turn before it.

    So that there is something to order and to reject, a call depends on the turn that is the length of its text modulo REACH
    (earlier, later or in a circle; on none if that is its own turn), texts whose length ODD divides give their turn as a
    string, and empty texts are left out of the arguments.
    """
    turn, reply, text = F.col("turn"), F.coalesce(F.col("role") == "assistant", F.lit(False)), F.coalesce("text", F.lit(""))
    given, n = F.when(text != "", text).alias("text"), F.length(text)
    said = F.when(n % ODD == 0, F.to_json(F.struct("role", given, turn.cast("string").alias("turn")))).otherwise(F.to_json(F.struct("role", given, turn.alias("turn"))))
    tag = lambda t: F.concat(F.lit("t"), t.cast("string"))
    return messages.select("conv_id", "turn", F.lit(0).alias("nth"), F.when(reply, "result").otherwise("call").alias("kind"), "role", tag(F.when(reply, turn - 1).otherwise(turn)).alias("call_id"), F.when(~reply, "say").alias("name"), F.when(~reply, said).alias("arguments"), F.when(~reply & (n % REACH != turn), F.array(tag(n % REACH))).otherwise(F.array().cast("array<string>")).alias("depends_on"), F.when(reply, text).alias("content"))
