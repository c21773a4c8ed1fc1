"""Chat formatting: tool-call linking, with DataFrame functions only.

Calls and results are joined by their identifier, ordered topologically by what a call depends on, checked
against argument schemas and serialised as canonical JSON (sorted keys, no white space).

A message calls tools if its text is a JSON object with "tool_calls": [{"id", "name", "arguments",
"depends_on": [ids]}]; one of role tool answers with {"tool_call_id", "content"}. Plain exchanges are linked in the same way: a
user's turn calls RESPOND with the text as prompt, under the identifier of its turn, and an assistant's turn
answers the call of the turn before. Everything else is kept as a message of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.storage import cut, drop_cut

RESPOND = "respond"
#: Arguments of each tool: name, JSON type, whether it is required.
Schemas = dict[str, tuple[tuple[str, str, bool], ...]]
SCHEMAS: Schemas = {RESPOND: (("prompt", "string", True),)}
#: How schema_of_variant names the JSON types.
_TYPES = {"string": "STRING", "integer": "BIGINT", "number": r"BIGINT|DOUBLE|DECIMAL\(.*", "boolean": "BOOLEAN", "object": "OBJECT<.*", "array": "ARRAY<.*"}
_CALLS = "tool_calls array<struct<id: string, name: string, arguments: variant, depends_on: array<string>>>"


def _problems(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """What is wrong with a call's arguments, in the schema's order, joined by semicolons; empty if nothing is."""
    told = F.when(~F.coalesce(name, F.lit("")).isin(list(schemas)), F.lit("unknown tool"))
    for tool, fields in schemas.items():
        found = []
        for field, kind, required in fields:
            value = F.try_variant_get(arguments, f"$.{field}", "variant")
            has = F.schema_of_variant(value).rlike(rf"\A(?:{_TYPES[kind]})\z")
            found.append(F.when(value.isNull(), F.lit(f"{field}: missing") if required else F.lit(None)).when(~has, F.lit(f"{field}: not {kind}")))
            if required and kind == "string":
                found.append(F.when(F.try_variant_get(arguments, f"$.{field}", "string") == "", F.lit(f"{field}: empty")))
        told = told.when(name == tool, F.concat_ws("; ", *found))
    return told


def _levels(calls: DataFrame) -> DataFrame:
    """(conv, id, level): 0 without dependencies, else one more than the highest level depended on; null for calls
    in or behind a cycle, or that depend on a call that isn't there."""
    edges = cut(calls.select("conv", "id", F.explode("depends_on").alias("on")).distinct(), "chat-edges")
    ids = calls.select("conv", "id", F.size(F.coalesce(F.array_distinct("depends_on"), F.array().cast("array<string>"))).alias("n"))
    done = ids.where("n = 0").select("conv", "id", F.lit(0).alias("level"))
    if edges.head() is None:
        return done
    # each round settles the calls whose dependencies are all settled, as Kahn's algorithm does
    waiting = ids.where("n > 0")
    done = cut(done, "chat-levels")
    while True:
        met = edges.join(done.select("conv", F.col("id").alias("on"), "level"), ["conv", "on"]).groupBy("conv", "id").agg(F.count(F.lit(1)).alias("met"), (F.max("level") + 1).alias("level"))
        new = cut(waiting.join(met, ["conv", "id"]).where("met = n").join(done, ["conv", "id"], "left_anti").select("conv", "id", F.col("level").cast("int").alias("level")), "chat-new")
        if new.head() is None:
            return done
        grown = cut(done.unionByName(new), "chat-levels")
        drop_cut(done)
        drop_cut(new)
        done = grown


def link(messages: DataFrame, *, schemas: Schemas = SCHEMAS, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per call, per result without a call, and per other message.

    Columns: conv_id, turn, call_id, name, status (linked, unanswered, orphan or message), level (topological;
    ordering by level, then turn, then call_id is a topological order of the conversation; null in a cycle),
    problems (of the arguments; empty for a valid call), n_calls, n_results and record (canonical JSON). Of calls
    that share an identifier in their conversation the first turn's counts, ties by record; likewise of results.
    So repeated rows are linked once and counted. Null text counts as empty, a null role as a message of role
    null; null conversations form one conversation; a null turn can be called but not answered by its turn. An
    empty table gives an empty result; other columns are not looked at.
    """
    m = messages.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    m = m.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))
    is_json = F.col("text").startswith("{")
    m = m.withColumn("called", F.when(is_json & (F.col("role") == "assistant"), F.from_json("text", _CALLS)["tool_calls"]))
    m = m.withColumn("answered", F.when(is_json & (F.col("role") == "tool"), F.from_json("text", "tool_call_id string, content string")))
    many = F.coalesce(F.size("called"), F.lit(0)) > 0
    turn_id = lambda t: F.concat(F.col("conv"), F.lit(":"), F.coalesce(t.cast("string"), F.lit("null")))
    explicit = m.where(many).withColumn("c", F.explode("called")).select("conv_id", "conv", "turn", F.coalesce("c.id", F.lit("")).alias("id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.col("c.depends_on").alias("depends_on"))
    prompt = F.to_variant_object(F.struct(F.col("text").alias("prompt")))
    asked = m.where(F.col("role") == "user").select("conv_id", "conv", "turn", turn_id(F.col("turn")).alias("id"), F.lit(RESPOND).alias("name"), prompt.alias("arguments"), F.lit(None).cast("array<string>").alias("depends_on"))
    calls = explicit.unionByName(asked)
    calls = calls.withColumn("arguments", F.coalesce(F.to_json("arguments"), F.lit("null")))
    one = F.min(F.struct("turn", "name", "arguments", "depends_on", "conv_id"))
    calls = cut(calls.groupBy("conv", "id").agg(one.alias("c"), F.count(F.lit(1)).alias("n_calls")).select("conv", "id", "c.*", "n_calls"), "chat-calls")

    told = m.where(F.col("answered.tool_call_id").isNotNull()).select("conv_id", "conv", "turn", F.col("answered.tool_call_id").alias("id"), F.coalesce("answered.content", F.lit("")).alias("content"))
    replied = m.where((F.col("role") == "assistant") & ~many).select("conv_id", "conv", "turn", F.when(F.col("turn").isNotNull(), turn_id(F.col("turn") - 1)).otherwise(F.lit("")).alias("id"), F.col("text").alias("content"))
    results = told.unionByName(replied).groupBy("conv", "id").agg(F.min(F.struct("turn", "content", "conv_id")).alias("r"), F.count(F.lit(1)).alias("n_results"))

    both = calls.hint("shuffle_hash").join(results, ["conv", "id"], "full_outer").join(_levels(calls), ["conv", "id"], "left")
    problems = F.when(F.col("n_calls").isNotNull(), _problems(F.col("name"), F.parse_json(F.coalesce("arguments", F.lit("null"))), schemas)).otherwise(F.lit(""))
    raw = F.concat(F.lit('{"arguments":'), F.coalesce("arguments", F.lit("null")), F.lit(',"id":'), _quoted(F.col("id")), F.lit(',"name":'), _quoted(F.col("name")), F.lit(',"result":'), _quoted(F.col("r.content")), F.lit("}"))
    status = F.when(F.col("n_calls").isNull(), "orphan").when(F.col("n_results").isNull(), "unanswered").otherwise("linked")
    zero = F.lit(0).cast("long")
    linked = both.select(F.coalesce(F.col("conv_id"), F.col("r.conv_id")).alias("conv_id"), F.when(F.col("n_calls").isNull(), F.col("r.turn")).otherwise(F.col("turn")).alias("turn"), F.col("id").alias("call_id"), "name", status.alias("status"), F.when(F.col("n_calls").isNull(), F.lit(0)).otherwise(F.col("level")).alias("level"), problems.alias("problems"), F.coalesce("n_calls", zero).alias("n_calls"), F.coalesce("n_results", zero).alias("n_results"), raw.alias("record"))
    used = F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False)) | F.col("answered.tool_call_id").isNotNull()
    rest = m.where(~used)
    kept = F.concat(F.lit('{"content":'), _quoted(F.col("text")), F.lit(',"role":'), _quoted(F.col("role")), F.lit("}"))
    rest = rest.select("conv_id", "turn", F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("string").alias("name"), F.lit("message").alias("status"), F.lit(0).alias("level"), F.lit("").alias("problems"), zero.alias("n_calls"), zero.alias("n_results"), kept.alias("record"))
    return linked.unionByName(rest)


def _quoted(x: Column) -> Column:
    """A JSON string; null for null."""
    whole = F.to_json(F.struct(x.alias("x")))
    return F.when(x.isNull(), "null").otherwise(F.substring(whole, F.lit(6), F.length(whole) - 6))
