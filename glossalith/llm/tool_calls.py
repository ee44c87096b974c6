"""Tool-call linking: calls and results meet by identifier, in topological order, with checked arguments, as canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Kinds of schema_of_variant by the schema's word.
KINDS = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "FLOAT"], "boolean": ["BOOLEAN"], "object": ["OBJECT"], "array": ["ARRAY"]}


def canonical_json(text: Column) -> Column:
    """The JSON value with sorted keys and no spare white space; null when it isn't valid JSON."""
    return F.to_json(F.try_parse_json(text))


#: {tool: {field: (kind, required) or (kind, required, limits)}}; limits as in JSON Schema: minimum, maximum, minLength,
#: maxLength, enum.
Schemas = dict[str, dict[str, tuple]]


def _within(part: Column, kind: str, limits: dict) -> Column:
    ok = F.lit(True)
    text, number = F.try_variant_get(part, "$", "string"), F.try_variant_get(part, "$", "double")
    for name, limit in limits.items():
        if name == "enum":
            ok = ok & text.isin([str(x) for x in limit])
        elif name in ("minLength", "maxLength"):
            ok = ok & (F.length(text) >= limit if name == "minLength" else F.length(text) <= limit)
        elif name in ("minimum", "maximum"):
            ok = ok & (number >= limit if name == "minimum" else number <= limit)
        else:
            raise ValueError(f"unknown limit {name} of a {kind}")
    return ok


def valid_arguments(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Whether arguments (JSON text) is an object that fits schemas[name]. An unknown name or malformed JSON doesn't fit;
    fields beyond the schema are allowed."""
    value = F.try_parse_json(arguments)
    kind_of = lambda v: F.regexp_extract(F.schema_of_variant(v), r"^([A-Z]+)", 1)
    fits = F.lit(False)
    for tool, fields in schemas.items():
        ok = kind_of(value) == "OBJECT"
        for field, (kind, required, *limits) in fields.items():
            part = F.try_variant_get(value, f"$['{field}']", "variant")
            right = kind_of(part).isin(KINDS[kind]) | ((kind_of(part) == "DECIMAL") & F.lit(kind == "number"))
            right = right & _within(part, kind, limits[0] if limits else {})
            ok = ok & F.when(part.isNull(), F.lit(not required)).otherwise(F.coalesce(right, F.lit(False)))
        fits = F.when(name == tool, ok).otherwise(fits)
    return F.coalesce(fits, F.lit(False))


def topological_depth(calls: DataFrame, ws: Workspace) -> DataFrame:
    """(call_id, parents) with unique call_id -> (call_id, depth): steps on the longest way to a call that waits for none;
    null in a cycle and behind one. A parent that is no call counts as none.

    Chains of calls with one parent each are shortened by pointer doubling up to the next call with none or several: a
    pointer spans 2**k calls after round k, so a chain of n calls takes log2(n) rounds of one equi-join on unique keys.
    Calls with several parents are then ordered in rounds, each when all its parents are: as many rounds as such calls
    follow each other. No conversation is gathered.
    """
    known = calls.select(F.col("call_id").alias("parent"))
    waits = ws.save(calls.select("call_id", F.explode("parents").alias("parent")).distinct().join(known, "parent", "left_semi"), "waits")
    number = waits.groupBy("call_id").agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("up"))
    # a pointer rests on a call that waits for none or for several: its anchor
    state = calls.select("call_id").join(number, "call_id", "left").select("call_id", F.when(F.col("n") == 1, F.col("up")).alias("up"), F.when(F.col("n") == 1, 1).otherwise(0).cast("long").alias("steps"), F.coalesce("n", F.lit(0)).alias("n"), F.when(F.coalesce("n", F.lit(0)) != 1, F.col("call_id")).alias("anchor"))
    state = ws.save(state, "chain0")
    n, k = state.count(), 0
    while (1 << k) <= 2 * max(n, 1) and state.filter("anchor is null").limit(1).count():
        above = state.select(F.col("call_id").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("anchor").alias("anchor2")).hint("shuffle_hash")
        k += 1
        open_, rest = state.filter("anchor is null"), state.filter("anchor is not null")
        moved = open_.join(above, "up", "left").select("call_id", F.col("up2").alias("up"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), "n", F.col("anchor2").alias("anchor"))
        state = ws.save(rest.unionByName(moved), f"chain{k}")
        ws.drop(f"chain{k - 1}")
    # ways from calls with several parents to the anchors above them
    ways = ws.save(waits.join(state.filter("n > 1").select("call_id"), "call_id", "left_semi").join(state.select(F.col("call_id").alias("parent"), "anchor", "steps"), "parent").select("call_id", "anchor", (F.col("steps") + 1).alias("steps")), "ways")
    placed = ws.save(state.filter("n = 0").select(F.col("call_id").alias("anchor"), F.lit(0).cast("long").alias("at")), "placed0")
    k, several = 0, ways.limit(1).count() > 0
    while several:
        found = ways.join(placed, "anchor", "left").groupBy("call_id").agg(F.max(F.col("at") + F.col("steps")).alias("at"), F.count_if(F.col("at").isNull()).alias("missing")).filter("missing = 0")
        new = ws.save(found.select(F.col("call_id").alias("anchor"), "at").join(placed, "anchor", "left_anti"), f"found{k}")
        several = new.limit(1).count() > 0
        k += 1
        placed = ws.save(placed.unionByName(new), f"placed{k}")
        ws.drop(f"placed{k - 1}", f"found{k - 1}")
    return state.join(placed.hint("shuffle_hash"), "anchor", "left").select("call_id", (F.col("at") + F.col("steps")).alias("depth"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """calls (group_id, call_id, seq, name, arguments: JSON text, parents: array of call_id or null), results (group_id,
    call_id, seq, content) -> one row per call and per result without a call: group_id, call_id, name, status, depth,
    record.

    Status, the first that fits: orphan_result, duplicate_call (an id's later calls by seq), cycle, no_result,
    invalid_arguments, linked. An id's first result by (seq, content) counts; of rows that repeat a call in every column,
    the first to come. depth is the place in topological order;
    record is the canonical JSON of call and result, for orphans of the result alone; arguments that aren't JSON stay in it
    as text. Null ids never link: such calls are no_result, such results orphans. Long texts stay whole. Other columns are
    not read, whatever their names. Empty tables give an empty result.
    """
    ws = Workspace(calls.sparkSession, "tool-calls")
    rows = ws.save(calls.select("group_id", "call_id", "seq", "name", "arguments", "parents").withColumn("place", F.monotonically_increasing_id()), "calls")
    heads = rows.filter("call_id is not null").groupBy("call_id").agg(F.min(F.struct("seq", "arguments", "place")).alias("head"))
    first = rows.join(heads.select(F.col("call_id").alias("head_id"), F.col("head.place").alias("place")).hint("shuffle_hash"), "place", "left").withColumn("is_first", F.col("head_id").isNotNull() | F.col("call_id").isNull()).drop("head_id")
    depth = topological_depth(rows.join(heads.select(F.col("head.place").alias("place")), "place", "left_semi").select("call_id", "parents"), ws)
    answers = results.select("call_id", "seq", "content", "group_id").filter("call_id is not null").groupBy("call_id").agg(F.min(F.struct("seq", "content", "group_id")).alias("answer"))
    linked = first.join(depth.hint("shuffle_hash"), "call_id", "left").join(answers.hint("shuffle_hash"), "call_id", "left")
    status = (
        F.when(~F.col("is_first"), "duplicate_call")
        .when(F.col("call_id").isNotNull() & F.col("depth").isNull(), "cycle")
        .when(F.col("answer").isNull(), "no_result")
        .when(~valid_arguments(F.col("name"), F.col("arguments"), schemas), "invalid_arguments")
        .otherwise("linked")
    )
    options = {"ignoreNullFields": "false"}
    arguments = F.coalesce(F.try_parse_json("arguments"), F.col("arguments").cast("variant"))
    record = F.to_json(F.struct(arguments.alias("arguments"), F.col("call_id").alias("id"), "name", F.col("answer.content").alias("result")), options)
    done = linked.select("group_id", "call_id", "name", status.alias("status"), "depth", record.alias("record"))
    orphan = results.join(heads.select("call_id").hint("shuffle_hash"), "call_id", "left_anti")
    lone = F.to_json(F.struct(F.col("call_id").alias("id"), F.col("content").alias("result")), options)
    return done.unionByName(orphan.select("group_id", "call_id", F.lit(None).cast("string").alias("name"), F.lit("orphan_result").alias("status"), F.lit(None).cast("long").alias("depth"), lone.alias("record")))


#: What a turn's text may hold as JSON: calls, or the result of one.
SPOKEN = "tool_calls array<struct<id: string, name: string, arguments: string, function: struct<name: string, arguments: string>, after: array<string>>>, tool_call_id string, content string"


def spoken_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that turns (conv_id, turn, text) hold as JSON objects: {"tool_calls": [{"id", "name" and "arguments"
    or "function", "after": [ids]}]} and {"tool_call_id", "content"}. Ids count within a conversation; arguments may be
    JSON or text of JSON. Texts that are no such object give nothing."""
    read = turns.select("conv_id", "turn", F.from_json(F.when(F.col("text").rlike(r"^\s*\{"), F.col("text")), SPOKEN).alias("said"))
    own = lambda c: F.concat_ws(":", F.col("conv_id").cast("string"), c)
    known = lambda c: F.when(F.col("conv_id").isNotNull() & c.isNotNull(), own(c))
    call = read.filter("said.tool_calls is not null").select("conv_id", "turn", F.posexplode("said.tool_calls").alias("k", "c"))
    calls = call.select(
        F.col("conv_id").alias("group_id"), known(F.col("c.id")).alias("call_id"), (F.col("turn") * 1000 + F.col("k")).alias("seq"), F.coalesce("c.name", "c.function.name").alias("name"), F.coalesce("c.arguments", "c.function.arguments").alias("arguments"), F.transform("c.after", lambda x: own(x)).alias("parents")
    )
    results = read.filter("said.tool_call_id is not null").select(F.col("conv_id").alias("group_id"), known(F.col("said.tool_call_id")).alias("call_id"), (F.col("turn") * 1000).alias("seq"), F.col("said.content").alias("content"))
    return calls, results


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, turn, role, text) as calls and results: those that texts hold as JSON (see spoken_calls),
    and of all other turns, which are plain talk, these:

    A turn of any role but assistant (or of none) is a call named by its role, with its text and turn as arguments;
    it waits for the nearest call one or two turns before. An assistant's turn is the result of the turn before it.
    """
    spoken, told = spoken_calls(turns)
    said = F.from_json(F.when(F.col("text").rlike(r"^\s*\{"), F.col("text")), SPOKEN)
    turns = turns.filter(F.coalesce(said["tool_calls"].isNull() & said["tool_call_id"].isNull(), F.lit(True)))
    own = lambda c: F.concat_ws(":", F.col("conv_id").cast("string"), c.cast("string"))
    key = F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), own(F.col("turn")))
    is_call = F.coalesce(F.col("role") != "assistant", F.lit(True))
    asks = turns.filter(is_call)
    places = asks.select("conv_id", "turn").distinct()
    near = places.select("conv_id", F.explode(F.array(F.struct((F.col("turn") + 1).alias("turn"), F.col("turn").alias("before")), F.struct((F.col("turn") + 2).alias("turn"), F.col("turn").alias("before")))).alias("x")).groupBy("conv_id", F.col("x.turn").alias("turn")).agg(F.max("x.before").alias("before"))
    calls = asks.join(near, ["conv_id", "turn"], "left").select(
        F.col("conv_id").alias("group_id"), key.alias("call_id"), (F.col("turn") * 1000).alias("seq"), F.coalesce("role", F.lit("none")).alias("name"), F.to_json(F.struct("text", "turn")).alias("arguments"), F.when(F.col("before").isNotNull(), F.array(own(F.col("before")))).alias("parents")
    )
    before = F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), own(F.col("turn") - 1))
    results = turns.filter(~is_call).select(F.col("conv_id").alias("group_id"), before.alias("call_id"), (F.col("turn") * 1000).alias("seq"), F.col("text").alias("content"))
    return calls.unionByName(spoken), results.unionByName(told)
