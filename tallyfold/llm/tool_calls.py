"""Chat formatting: tool calls and their results linked by identifier, ordered, validated and written as canonical JSON.

A conversation keeps its recorded order but where a call waits for a result recorded after it, or a result for such a call:
these move down to the last event that they wait for, directly or through others. So only conversations that hold one are
looked at round by round, and pointers over chains double in each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.scratch import drop, settle

ENVELOPE = "struct<tool_calls:array<struct<id:string,name:string,arguments:string,after:array<string>>>,tool_call_id:string,content:string>"
TYPES = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "number": "BIGINT|DOUBLE|DECIMAL.*", "array": "ARRAY.*", "object": "OBJECT.*"}
NODE = ["conv_id", "node"]


def events(messages: DataFrame) -> DataFrame:
    """Each call, each result and each other message as a row: (conv_id, turn, seq, kind, role, call_id, name, arguments, after, content).
    What a message says beside its calls is a message before them."""
    parsed = messages.select("conv_id", "turn", "role", "text", F.when(F.ltrim("text").startswith("{"), F.from_json("text", ENVELOPE)).alias("e"))
    parsed = parsed.withColumns({"calls": F.col("e.tool_calls").isNotNull(), "result": F.col("e.tool_calls").isNull() & F.col("e.tool_call_id").isNotNull()})
    null, none = F.lit(None).cast("string"), F.array().cast("array<string>")
    calls = parsed.where("calls").select("conv_id", "turn", "role", F.posexplode("e.tool_calls").alias("seq", "c"))
    calls = calls.select("conv_id", "turn", "seq", F.lit("call").alias("kind"), "role", F.col("c.id").alias("call_id"), "c.name", "c.arguments", F.coalesce("c.after", none).alias("after"), null.alias("content"))
    rest = parsed.where("NOT coalesce(calls, false) OR e.content IS NOT NULL")
    kind = F.when(F.col("result"), "result").otherwise("message")
    content = F.when(F.col("calls") | F.col("result"), F.col("e.content")).otherwise(F.col("text"))
    rest = rest.select("conv_id", "turn", F.when(F.col("calls"), -1).otherwise(0).alias("seq"), kind.alias("kind"), "role", F.when(F.col("result"), F.col("e.tool_call_id")).alias("call_id"), null.alias("name"), null.alias("arguments"), none.alias("after"), content.alias("content"))
    return calls.unionByName(rest)


def _waits(every: DataFrame, nodes: DataFrame) -> DataFrame:
    """(conv_id, node, pos, to, to_pos): a result waits for its call, a call for the results of those it comes after, or for the calls themselves where they have none."""
    node = lambda kind, name: F.concat(F.lit(kind), F.col(name))
    call, result = (nodes.where(f"kind = '{k}'").select("conv_id", "call_id", "pos") for k in ("call", "result"))
    own = result.join(call.withColumnRenamed("pos", "to_pos"), ["conv_id", "call_id"]).select("conv_id", node("r", "call_id").alias("node"), "pos", node("c", "call_id").alias("to"), "to_pos")
    last = nodes.groupBy("conv_id", "call_id").agg(F.max(F.struct(F.substring("kind", 1, 1).alias("k"), "pos")).alias("end"))  # r after c
    after = every.where("kind = 'call' AND size(after) > 0 AND conv_id IS NOT NULL AND call_id IS NOT NULL").select("conv_id", "call_id", F.explode("after").alias("dep")).distinct()
    dep = last.select("conv_id", F.col("call_id").alias("dep"), F.concat("end.k", "call_id").alias("to"), F.col("end.pos").alias("to_pos"))
    other = after.join(dep, ["conv_id", "dep"]).join(call, ["conv_id", "call_id"]).select("conv_id", node("c", "call_id").alias("node"), "pos", "to", "to_pos")
    return own.unionByName(other)


def _latest(waits: DataFrame) -> DataFrame:
    """(conv_id, node, at): the last position of a node and all that it waits for. A pointer over a node with one pointer takes that one's in each round."""
    at = settle(waits.select("conv_id", "node", "pos").unionByName(waits.select("conv_id", F.col("to").alias("node"), F.col("to_pos").alias("pos"))).groupBy(*NODE).agg(F.max("pos").alias("at")))
    hops = settle(waits.select(*NODE, "to").distinct())
    while True:
        seen = hops.join(at.select("conv_id", F.col("node").alias("to"), F.col("at").alias("far")), ["conv_id", "to"]).groupBy(*NODE).agg(F.max("far").alias("far"))
        new = settle(at.join(seen, NODE, "left").select(*NODE, F.greatest("at", F.coalesce("far", "at")).alias("at"), (F.col("far") > F.col("at")).alias("moved")))
        drop(at)
        at = new.drop("moved")
        at._tallyfold_path = new._tallyfold_path
        if new.where("moved").isEmpty():
            drop(hops)
            return at
        one = hops.groupBy(*NODE).agg(F.count("*").alias("n"), F.min("to").alias("next")).withColumnRenamed("node", "to")
        older, hops = hops, settle(hops.join(one, ["conv_id", "to"]).select(*NODE, F.when(F.col("n") == 1, F.col("next")).otherwise(F.col("to")).alias("to")).distinct())
        drop(older)


def _depths(waits: DataFrame) -> DataFrame:
    """(conv_id, node, depth): the longest way down from a node over `waits`; null for one that is in a cycle or waits for one."""
    deep = settle(waits.select("node", "to", "conv_id").select("conv_id", F.explode(F.array("node", "to")).alias("node")).distinct().withColumn("depth", F.lit(0)))
    hops = settle(waits.select(*NODE, "to").distinct().withColumn("steps", F.lit(1)))
    open_nodes = hops.select(*NODE).distinct().count()
    while open_nodes:
        one = hops.groupBy(*NODE).agg(F.count("*").alias("n"), F.min(F.struct("to", "steps")).alias("next")).withColumnRenamed("node", "to")
        wide = hops.join(deep.select("conv_id", F.col("node").alias("to"), F.col("depth").alias("below")), ["conv_id", "to"]).join(one, ["conv_id", "to"], "left")
        wide = settle(wide.select(*NODE, "to", "steps", "below", "n", "next"))
        seen = wide.where("n IS NULL OR n = 1").groupBy(*NODE).agg(F.max(F.col("steps") + F.col("below")).alias("found"))
        older, deep = deep, settle(deep.join(seen, NODE, "left").select(*NODE, F.greatest("depth", F.coalesce("found", F.lit(0))).alias("depth")))
        drop(older, hops)
        single = F.col("n") == 1
        hops = settle(wide.where("n IS NOT NULL").select(*NODE, F.when(single, F.col("next.to")).otherwise(F.col("to")).alias("to"), F.when(single, F.col("steps") + F.col("next.steps")).otherwise(F.col("steps")).alias("steps")).groupBy(*NODE, "to").agg(F.max("steps").alias("steps")))
        drop(wide)
        left = hops.select(*NODE).distinct().count()
        if left == open_nodes:
            break  # each round ends a node unless all wait for a cycle
        open_nodes = left
    return deep.join(hops.select(*NODE).distinct().withColumn("cycle", F.lit(True)), NODE, "left").select(*NODE, F.when(F.col("cycle").isNull(), F.col("depth")).alias("depth"))


def order(every: DataFrame, nodes: DataFrame) -> DataFrame:
    """(conv_id, node, at, depth) of the calls and results that don't stay at their recorded place, or are in a cycle (depth null)."""
    waits = settle(_waits(every, nodes))
    late = waits.where("to_pos >= pos").select("conv_id").distinct()
    some = settle(waits.join(late, "conv_id", "left_semi"))
    drop(waits)
    if some.isEmpty():
        return some.select(*NODE, F.col("pos").alias("at"), F.lit(0).alias("depth"))
    at = _latest(some)
    to = at.select("conv_id", F.col("node").alias("to"), F.col("at").alias("to_at"))
    tight = settle(some.join(at, NODE).join(to, ["conv_id", "to"]).where("at = to_at").select(*NODE, "to"))
    out = settle(at.join(_depths(tight).withColumn("tight", F.lit(True)), NODE, "left").select(*NODE, "at", F.when(F.col("tight"), F.col("depth")).otherwise(0).alias("depth")))
    drop(some, at, tight)
    return out


def faults(name: str, arguments: str, shape: str):
    """Of a call with the given columns and the parameters of its tool as a map of key to (type, required): `missing:a`, `type:b`,
    `unknown:c`, `no such tool`, `no object`, in order."""
    none = F.array().cast("array<string>")
    value = F.try_parse_json(arguments)
    # Through an if, so that what is no object is never cast.
    given = F.expr(f"if(coalesce(startswith(schema_of_variant(try_parse_json({arguments})), 'OBJECT'), false), transform_values(try_cast(try_parse_json({arguments}) AS map<string, variant>), (k, v) -> schema_of_variant(v)), null)")
    kind = F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair))

    def of(types, known):
        wanted = lambda k: F.concat(F.lit("^("), F.element_at(kind, F.element_at(known, k)["type"]), F.lit(")$"))
        wrong = lambda k: F.when(~F.map_contains_key(known, k), F.concat(F.lit("unknown:"), k)).when(~F.coalesce(F.rlike(F.element_at(types, k), wanted(k)), F.lit(True)), F.concat(F.lit("type:"), k))
        missing = F.transform(F.filter(F.map_keys(known), lambda k: F.element_at(known, k)["required"] & ~F.map_contains_key(types, k)), lambda k: F.concat(F.lit("missing:"), k))
        return F.array_sort(F.concat(F.filter(F.transform(F.map_keys(types), wrong), lambda x: x.isNotNull()), missing))

    shaped = F.when(given.isNull() | value.isNull(), F.array(F.lit("no object"))).otherwise(of(given, F.col(shape)))
    return F.when(F.col(shape).isNull(), F.array(F.lit("no such tool"))).otherwise(F.coalesce(shaped, none))


def link_tools(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """(conv_id, at_turn, at_seq, depth, turn, seq, kind, call_id, linked, faults, json) of each call, result and message.

    messages has conv_id, turn, role and text; a text that is a JSON object with `tool_calls` holds calls (id, name,
    arguments, after) and perhaps `content`, one with `tool_call_id` a result. schemas has name, key, type (of TYPES) and
    required, one row a parameter. A result waits for its call, a call for the results of the calls it comes after (for those
    without result, for the calls). Sorted by at_turn, at_seq, depth, turn, seq a conversation is in topological order: at is
    the last position among an event and all that it waits for, depth its distance from there. Most events, and all
    messages, stay where they are recorded. Calls or results of one id are placed together. In a cycle, and for what waits for one
    and is recorded before its last event, depth is null. linked tells whether a call has a result, or a result its call; faults adds `no result`,
    `no call`, `cycle`, `repeated id` and `no id`. json is canonical: keys in order, no blanks. Null and malformed texts are messages; a
    null conv_id or id is linked with nothing, a null turn comes first; repeated rows come back repeated, their calls with the
    fault `repeated id`; other columns are ignored; very long texts are parsed whole; an empty table gives an empty one.
    """
    every = settle(events(messages))
    key = ["conv_id", "call_id"]
    nodes = settle(every.where("kind <> 'message' AND conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy(*key, "kind").agg(F.max(F.struct("turn", "seq")).alias("pos"), F.count("*").alias("same")))
    moved = order(every, nodes)
    flag = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("same")))
    known = nodes.groupBy(*key).agg(flag("call").alias("calls"), flag("result").alias("results"))
    place = moved.select("conv_id", F.substring("node", 2, 1 << 30).alias("call_id"), F.when(F.col("node").startswith("c"), "call").otherwise("result").alias("kind"), "at", "depth", F.lit(True).alias("moved"))
    shapes = schemas.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("key", F.struct("type", F.coalesce("required", F.lit(False)).alias("required"))))).alias("shape"))  # as many as a tool has parameters
    linked = every.where("kind <> 'message'").join(known, key, "left").join(place, [*key, "kind"], "left")
    none = F.array().cast("array<string>")
    note = lambda *pairs: F.filter(F.array(*(F.when(c, t) for c, t in pairs)), lambda x: x.isNotNull())
    text = lambda c: F.expr(f"coalesce(substring(to_json(named_struct('x', {c})), 6, length(to_json(named_struct('x', {c}))) - 6), '')")
    quoted = lambda c: F.when(F.col(c).isNull(), "null").otherwise(text(c))
    stuck = F.col("moved") & F.col("depth").isNull()
    spot = [F.when(F.col("moved"), F.col(f"at.{c}")).otherwise(F.col(c)).alias(f"at_{c}") for c in ("turn", "seq")]
    front = ["conv_id", *spot, F.when(F.col("moved"), F.col("depth")).otherwise(0).alias("depth"), "turn", "seq", "kind", "call_id"]
    args = F.coalesce(F.to_json(F.try_parse_json("arguments")), F.lit("null"))
    called = linked.where("kind = 'call'").join(shapes, "name", "left").select(
        *front, F.col("results").isNotNull().alias("linked"),
        F.concat(faults("name", "arguments", "shape"), note((F.col("call_id").isNull(), "no id"), (F.col("calls") > 1, "repeated id"), (stuck, "cycle"), (F.col("results").isNull(), "no result"))).alias("faults"),
        F.concat(F.lit('{"arguments":'), args, F.lit(',"id":'), quoted("call_id"), F.lit(',"name":'), quoted("name"), F.lit(',"role":'), quoted("role"), F.lit(',"type":"call"}')).alias("json"),
    )
    returned = linked.where("kind = 'result'").select(
        *front, F.col("calls").isNotNull().alias("linked"), note((F.col("calls").isNull(), "no call")).alias("faults"),
        F.concat(F.lit('{"content":'), F.coalesce(F.to_json(F.try_parse_json("content")), quoted("content")), F.lit(',"id":'), quoted("call_id"), F.lit(',"role":'), quoted("role"), F.lit(',"type":"result"}')).alias("json"),
    )
    here = [F.col(c).alias(f"at_{c}") for c in ("turn", "seq")]
    plain = every.where("kind = 'message'").select("conv_id", *here, F.lit(0).alias("depth"), "turn", "seq", "kind", "call_id", F.lit(False).alias("linked"), none.alias("faults"), F.concat(F.lit('{"content":'), quoted("content"), F.lit(',"role":'), quoted("role"), F.lit(',"type":"message"}')).alias("json"))
    return called.unionByName(returned).unionByName(plain)
