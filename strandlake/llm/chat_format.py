"""Chat formatting with tool-call linking. DataFrame functions only.

An assistant's text may be a JSON object with tool_calls, an array of {id, name, arguments}, and a content; a tool's
text a JSON object with tool_call_id and content. All other text is plain. Results are hash-joined to calls by
(conversation, call id); each result is ordered behind its call, and otherwise turns keep their order; arguments are
checked against the tools' schemas; each message is serialised as one line of canonical JSON: keys sorted, no white
space, numbers as the JSON parser keeps them.

A message is a row, and its place is a key, (order_turn, order_step, order_index), not a count over its conversation: a
conversation of any length is spread over tasks. Sorting by (conv_id, these three, turn) gives a topological order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import Scratch, table, whole_text

#: Tool name -> parameter -> (JSON type, required). The tools whose calls the formatter accepts.
Schemas = dict[str, dict[str, tuple[str, bool]]]
DEFAULT_SCHEMAS: Schemas = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "calculate": {"expression": ("string", True)},
    "fetch": {"url": ("string", True), "headers": ("object", False)},
}
CALL = "array<struct<id string, name string, arguments variant>>"


def _schema_map(schemas: Schemas) -> Column:
    def params(p: dict[str, tuple[str, bool]]) -> Column:
        if not p:
            return F.expr("cast(map() as map<string, struct<type: string, required: boolean>>)")
        return F.create_map(*[x for k, (t, need) in sorted(p.items()) for x in (F.lit(k), F.struct(F.lit(t).alias("type"), F.lit(need).alias("required")))])

    if not schemas:
        return F.expr("cast(map() as map<string, map<string, struct<type: string, required: boolean>>>)")
    return F.create_map(*[x for name, p in sorted(schemas.items()) for x in (F.lit(name), params(p))])


def json_type(value: Column) -> Column:
    """JSON Schema's name for the type of a variant."""
    t = F.schema_of_variant(value)
    whole = t.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | t.rlike(r"^DECIMAL\(\d+,0\)$")
    return (
        F.when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array").when(t == "STRING", "string").when(t == "BOOLEAN", "boolean")
        .when(whole, "integer").when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), "number").otherwise("null")
    )


def problems(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Sorted array of what is wrong with a call; empty if it is valid."""
    spec = F.element_at(_schema_map(schemas), name)
    args = F.coalesce(F.try_variant_get(arguments, "$", "map<string,variant>"), F.expr("cast(map() as map<string, variant>)"))
    keys = F.map_keys(args)
    unknown = F.transform(F.filter(keys, lambda k: ~F.map_contains_key(spec, k)), lambda k: F.concat(F.lit("unknown:"), k))
    missing = F.transform(F.filter(F.map_keys(spec), lambda k: F.element_at(spec, k)["required"] & ~F.array_contains(keys, k)), lambda k: F.concat(F.lit("missing:"), k))

    def differs(k: Column) -> Column:
        want, got = F.element_at(spec, k)["type"], json_type(F.element_at(args, k))
        return ~((want == got) | ((want == "number") & (got == "integer")))

    wrong = F.transform(F.filter(keys, lambda k: F.coalesce(F.map_contains_key(spec, k) & differs(k), F.lit(False))), lambda k: F.concat(F.lit("type:"), k))
    return F.when(spec.isNull(), F.array(F.lit("unknown_tool"))).otherwise(F.array_sort(F.concat(unknown, missing, wrong)))


def format_chats(messages: DataFrame, schemas: Schemas | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per row of messages: conv_id, turn, role, order_turn, order_step, order_index, n_calls, n_linked, n_invalid, call_id, linked, json.

    n_linked counts an assistant's calls that have a result, n_invalid those that break their schema; call_id and linked
    belong to results (linked is null for other rows). Of calls in a conversation that share an id, the first counts. A
    null role is the empty role, a null text empty text, a null conversation a conversation of its own; repeated rows
    each get a row; text that is not such an object, or broken JSON, is plain.
    """
    schemas = DEFAULT_SCHEMAS if schemas is None else schemas
    body, who = whole_text(text), F.coalesce(F.col(role), F.lit(""))
    shaped = who.isin("assistant", "tool") & body.startswith("{")
    source = messages.select(
        F.monotonically_increasing_id().alias("row"), F.col(conv).alias("conv"), F.col(turn).alias("turn"), who.alias("role"), body.alias("text"),
        F.when(shaped, F.try_parse_json(body)).alias("v"),
    )
    parsed = source.select(
        "row", "conv", "turn", "role", "text",
        F.coalesce(F.try_variant_get("v", "$.content", "string"), F.lit("")).alias("content"),
        F.when(F.col("role") == "assistant", F.try_variant_get("v", "$.tool_calls", CALL)).alias("calls"),
        F.when(F.col("role") == "tool", F.try_variant_get("v", "$.tool_call_id", "string")).alias("call_id"),
    )
    parsed = Scratch(messages.sparkSession, "chat_format").save(parsed, "messages")
    calls = parsed.where(F.size("calls") > 0).select("row", "conv", "turn", F.posexplode("calls").alias("index", "call")).select("row", "conv", "turn", "index", "call.*")
    first = calls.where("id is not null").groupBy("conv", "id").agg(F.min(F.struct("turn", "index", "row")).alias("at"))
    results = parsed.where("call_id is not null").select("row", "conv", F.col("call_id").alias("id"))
    linked = results.join(first, results["conv"].eqNullSafe(first["conv"]) & (results["id"] == first["id"]), "left").select(results["row"], "at")
    done = results.select("conv", "id").distinct().withColumn("answered", F.lit(1))
    judged = calls.withColumn("problems", problems(F.col("name"), F.col("arguments"), schemas))
    judged = judged.join(done, judged["conv"].eqNullSafe(done["conv"]) & (judged["id"] == done["id"]), "left").drop(done["conv"], done["id"])
    per_row = judged.groupBy("row").agg(F.count(F.lit(1)).alias("n_calls"), F.count("answered").alias("n_linked"), F.count_if(F.size("problems") > 0).alias("n_invalid"))
    rows = parsed.join(linked, "row", "left").join(per_row, "row", "left")
    own = F.struct(F.col("turn").alias("t"), F.lit(0).alias("s"), F.lit(0).alias("i"))
    behind = F.struct(F.col("at.turn").alias("t"), F.lit(1).alias("s"), F.col("at.index").alias("i"))
    place = F.when(F.col("at").isNull(), own).otherwise(F.greatest(own, behind))
    is_calls, is_result = F.col("n_calls").isNotNull(), F.col("call_id").isNotNull()
    tool_calls = F.transform("calls", lambda c: F.struct(c["arguments"].alias("arguments"), c["id"].alias("id"), c["name"].alias("name")))
    json = (
        F.when(is_calls, F.to_json(F.struct("content", "role", tool_calls.alias("tool_calls"))))
        .when(is_result, F.to_json(F.struct("content", "role", F.col("call_id").alias("tool_call_id"))))
        .otherwise(F.to_json(F.struct(F.col("text").alias("content"), "role")))
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.withColumn("place", place).select(
        F.col("conv").alias(conv), F.col("turn").alias(turn), "role", F.col("place.t").alias("order_turn"), F.col("place.s").alias("order_step"), F.col("place.i").alias("order_index"),
        zero("n_calls"), zero("n_linked"), zero("n_invalid"), "call_id", F.when(is_result, F.col("at").isNotNull()).alias("linked"), json.alias("json"),
    )


def op6_chat_format(spark, sf_dir: str) -> DataFrame:
    """Nulls of call_id and linked as '' and false."""
    return format_chats(table(spark, sf_dir, "conversations")).withColumns({"call_id": F.coalesce("call_id", F.lit("")), "linked": F.coalesce("linked", F.lit(False))})


#: For tables whose texts are plain, as those given are; a text that is a JSON object shows as a difference.
ORACLE = """
SELECT conv_id, turn, coalesce(role, '') AS role, turn AS order_turn, 0 AS order_step, 0 AS order_index,
       0::BIGINT AS n_calls, 0::BIGINT AS n_linked, 0::BIGINT AS n_invalid, '' AS call_id, false AS linked,
       '{"content":' || CAST(to_json(coalesce(text, '')) AS VARCHAR) || ',"role":' || CAST(to_json(coalesce(role, '')) AS VARCHAR) || '}' AS json
FROM conversations
"""
