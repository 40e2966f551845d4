"""Chat formatting with tool-call linking, in DataFrame functions only.

A message whose text is a JSON object with `tool_calls` makes calls; one with
`tool_call_id` is a result; any other text is content.  Calls and results are
hash-joined by conversation and identifier.  A call that quotes `${id}` of
another call in its arguments depends on it; calls are ordered by their depth
in this relation, and a result stands right behind its call's message.
Arguments are checked against JSON schemas and written, as the message is, as
canonical JSON: compact, keys sorted.

Defined results: a null text is null content; text that is no JSON object is
content as it is; of repeated identifiers in a conversation the first in
(turn, place) is the call or result and later ones are `repeated`; a result
without a call is an `orphan`, one not after its call is `early`; a call
without a result is `open`; calls in a cycle have depth -1; unknown tools are
valid if their arguments are an object.  Rows repeated in full are kept.  No
conversation is gathered in one task: order is given by sort keys.  A null
conv_id is a conversation, a null turn a turn that is not after any other.
Depths take a round for each call of the longest chain of references.
"""

from __future__ import annotations

from functools import reduce
from itertools import count
from json import dumps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import written

CALL = "struct<id:string,name:string,arguments:string,function:struct<name:string,arguments:string>>"
MESSAGE = f"struct<content:string,tool_call_id:string,tool_calls:array<{CALL}>>"
REFERENCE = r"\$\{([^}]+)\}"
ROUNDS = 8  # after which the depths found are written as one table

# JSON schema types, by how a variant's type begins.
TYPES = {
    "string": ("STRING",),
    "integer": ("BIGINT",),
    "number": ("BIGINT", "DOUBLE", "DECIMAL"),
    "boolean": ("BOOLEAN",),
    "object": ("OBJECT",),
    "array": ("ARRAY",),
    "null": ("VOID",),
}

SCHEMAS: dict[str, dict] = {
    "search": {"required": ["query"], "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}},
    "calculate": {"required": ["expression"], "properties": {"expression": {"type": "string"}}, "additionalProperties": False},
}


def canonical(json: Column) -> Column:
    """Compact JSON with sorted keys; null for text that is no JSON or repeats a key."""
    return F.to_json(F.try_parse_json(json))


def _is(kind: Column, names) -> Column:
    return reduce(lambda a, b: a | b, (kind.startswith(p) for n in ([names] if isinstance(names, str) else names) for p in TYPES[n]))


def valid(name: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    """Whether the arguments (JSON) are an object that the schema of the tool allows."""
    v = F.try_parse_json(arguments)
    good = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    for tool, schema in schemas.items():
        rules = []
        for key, rule in schema.get("properties", {}).items():
            path = '$["' + key.replace('"', '\\"') + '"]'
            got = F.try_variant_get(v, path, "variant")
            ok = F.lit(True)
            if "type" in rule:
                ok = ok & _is(F.schema_of_variant(got), rule["type"])
            if "enum" in rule:
                ok = ok & F.to_json(got).isin([dumps(x, separators=(",", ":"), ensure_ascii=False) for x in rule["enum"]])
            rules.append(got.isNull() | F.coalesce(ok, F.lit(False)))
        keys = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
        rules += [F.array_contains(keys, k) for k in schema.get("required", [])]
        if schema.get("additionalProperties") is False:
            rules.append(F.size(F.array_except(keys, F.array(*map(F.lit, schema.get("properties", {}))).cast("array<string>"))) == 0)
        if rules:
            good = good & F.when(name == tool, reduce(lambda a, b: a & b, rules)).otherwise(True)
    return F.coalesce(good, F.lit(False))


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join in which null keys are equal."""
    other = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    out = left.join(other, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)), how)
    if how == "full":
        out = out.withColumns({k: F.coalesce(k, f"_{k}") for k in keys})
    return out.drop(*(f"_{k}" for k in keys))


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, id, depth): 0 without known references, else one more than the deepest call referred to; -1 in or behind a cycle."""
    keys = ["conv_id", "id"]
    refs = calls.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all("arguments", F.lit(REFERENCE), F.lit(1)))).alias("to"))
    known = calls.select("conv_id", F.col("id").alias("to"))
    refs = written(joined(refs, known, ["conv_id", "to"], "left_semi"))
    if refs.isEmpty():
        return calls.select(*keys, F.lit(0).alias("depth"))
    done = written(joined(calls.select(*keys), refs, keys, "left_anti").withColumn("depth", F.lit(0)))
    for k in count(1):
        left = joined(refs, done, keys, "left_anti")
        if k % ROUNDS == 0:
            refs, done = written(left), written(done)
            left = refs
        at = joined(left, done.select("conv_id", F.col("id").alias("to"), "depth"), ["conv_id", "to"], "left")
        new = at.groupBy(*keys).agg(F.max("depth").alias("depth"), F.count_if(F.col("depth").isNull()).alias("open")).where("open = 0").select(*keys, (F.col("depth") + 1).alias("depth"))
        new = written(new)
        if new.isEmpty():
            break
        done = done.union(new)
    return joined(calls.select(*keys), done, keys, "left").withColumn("depth", F.coalesce("depth", F.lit(-1)))


def format_messages(conversations: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """One row for each message: conv_id, turn, order_turn, order_rank, status, n_calls, n_open, n_invalid, json.

    Ordered by (order_turn, order_rank, turn) a conversation has every result
    behind its call.
    """
    schemas = SCHEMAS if schemas is None else schemas
    m = conversations.select("conv_id", "turn", "role", "text")
    maybe = F.ltrim("text").startswith("{")
    m = m.withColumn("body", F.when(maybe, F.from_json("text", MESSAGE)))
    m = m.withColumn("calls", F.when(F.size("body.tool_calls") > 0, F.col("body.tool_calls"))).withColumn("result_of", F.when(F.col("calls").isNull(), F.col("body.tool_call_id")))
    m = m.withColumn("content", F.when(F.col("calls").isNotNull() | F.col("result_of").isNotNull(), F.col("body.content")).otherwise(F.col("text")))
    m = m.withColumn("msg", F.xxhash64("conv_id", "turn", "role", "text"))
    called = m.where("calls is not null").select("conv_id", "turn", "msg", F.posexplode("calls").alias("place", "call"))
    called = called.select("conv_id", "turn", "msg", "place", F.col("call.id").alias("id"), F.coalesce("call.name", "call.function.name").alias("name"), F.coalesce("call.arguments", "call.function.arguments", F.lit("{}")).alias("arguments")).dropDuplicates(["conv_id", "turn", "msg", "place"])
    called = written(called)
    if called.isEmpty():
        linked = m.withColumn("own", F.lit(None).cast("array<struct<depth:int,place:int,id:string,name:string,arguments:string,valid:boolean,repeated:boolean,answered:boolean>>")).withColumn("call_turn", F.lit(None).cast("long")).withColumn("call_msg", F.lit(None).cast("long")).withColumn("again", F.lit(False))
        return _serialised(linked)
    first = called.where("id is not null").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "msg", "place", "arguments")).alias("f")).select("conv_id", "id", "f.*")
    answers = m.where("result_of is not null").groupBy("conv_id", F.col("result_of").alias("id")).agg(F.min(F.struct("turn", "msg")).alias("r")).select("conv_id", "id", F.col("r.turn").alias("answer_turn"), F.col("r.msg").alias("answer_msg"))
    pairs = joined(first.withColumnsRenamed({"turn": "call_turn", "msg": "call_msg", "place": "call_place"}), answers, ["conv_id", "id"], "full")
    pairs = written(joined(pairs, depths(first), ["conv_id", "id"], "left"))
    at = joined(called, pairs.drop("arguments"), ["conv_id", "id"], "left")
    same = F.col("turn").eqNullSafe(F.col("call_turn")) & (F.col("msg") == F.col("call_msg")) & (F.col("place") == F.col("call_place"))
    is_first = F.when(F.col("call_msg").isNotNull(), same)
    own = at.groupBy("conv_id", "turn", "msg").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.coalesce("depth", F.lit(0)).alias("depth"), F.col("place").alias("place"), "id", "name", "arguments",
                    valid(F.col("name"), F.col("arguments"), schemas).alias("valid"), (~F.coalesce(is_first, F.lit(True))).alias("repeated"),
                    F.coalesce(is_first & (F.col("answer_turn") > F.col("turn")), F.lit(False)).alias("answered"),
                )
            )
        ).alias("own")
    )
    replies = pairs.where("answer_msg is not null").select("conv_id", F.col("id").alias("result_of"), "call_turn", "call_msg", "answer_turn", "answer_msg")
    linked = joined(joined(m, own, ["conv_id", "turn", "msg"], "left"), replies, ["conv_id", "result_of"], "left")
    linked = linked.withColumn("again", F.coalesce(~F.col("answer_turn").eqNullSafe(F.col("turn")) & F.col("answer_msg").isNotNull() | (F.col("answer_msg") != F.col("msg")), F.lit(False)))
    return _serialised(linked)


def _serialised(m: DataFrame) -> DataFrame:
    result = F.col("result_of").isNotNull()
    late = F.coalesce(F.col("turn") > F.col("call_turn"), F.lit(False))
    status = (
        F.when(result & F.col("again"), "repeated").when(result & F.col("call_msg").isNull(), "orphan").when(result & ~late, "early").when(result, "linked")
        .when(F.col("own").isNull(), "plain").when(F.exists("own", lambda c: ~c["answered"]), "open").otherwise("answered")
    )
    moved = result & late & ~F.col("again")
    calls = F.transform("own", lambda c: F.struct(F.coalesce(F.try_parse_json(c["arguments"]), F.try_parse_json(F.to_json(F.struct(c["arguments"].alias("text"))))).alias("arguments"), c["id"].alias("id"), c["name"].alias("name"), c["valid"].alias("valid")))
    json = F.to_json(F.struct(F.col("content"), F.col("role"), F.col("result_of").alias("tool_call_id"), calls.alias("tool_calls")))
    none = F.array().cast("array<boolean>")
    count = lambda f: F.size(F.coalesce(F.filter(F.transform("own", f), lambda x: x), none))
    return m.select(
        "conv_id", "turn", F.when(moved, F.col("call_turn")).otherwise(F.col("turn")).alias("order_turn"), F.when(moved, 1).otherwise(0).alias("order_rank"), status.alias("status"),
        F.greatest(F.coalesce(F.size("own"), F.lit(0)), F.lit(0)).alias("n_calls"), count(lambda c: ~c["answered"]).alias("n_open"), count(lambda c: ~c["valid"]).alias("n_invalid"), json.alias("json"),
    )
