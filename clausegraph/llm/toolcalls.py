"""Chat formatting: tool-call linking, with DataFrame functions only.

Calls and results are joined by identifier (repeats of an identifier are folded first, so no key multiplies rows),
ordered topologically along ``after`` (the call whose result a call builds on), checked against parameter schemas, and
written as canonical JSON: keys in code-point order, no blanks, non-ASCII characters as they are.

A call names at most one ``after``, so the order is a forest; depths come by pointer doubling, in as many joins as the
logarithm of the longest chain. Calls on a cycle get depth null and status ``cycle``.

Defined results, one row per identifier: ``linked``, ``unanswered`` (no result), ``orphan`` (a result without call),
``cycle``. Of repeated calls or results of an identifier the smallest (in order of the columns) stays, and ``n_calls``
and ``n_results`` count them. An ``after`` that names no call is ignored. Rows without identifier are folded under the
null identifier and never link. Arguments that are no JSON object give the error ``not an object``. Extra columns are
ignored; texts of any length are kept whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegraph.llm.runtime import cut, table

#: Parameter schemas by tool: name -> (type, required, least length or value).
SCHEMAS: dict[str, dict[str, tuple[str, bool, int | None]]] = {"reply": {"question": ("string", True, 1), "turn": ("integer", True, 0)}}
_TYPES = {"string": "string", "integer": "bigint", "number": "decimal|double|float|bigint", "boolean": "boolean", "array": "array", "object": "object|struct"}


def canonical(json: Column) -> Column:
    """Canonical text of a JSON text; null if it is none. A variant keeps object keys sorted and has no blanks."""
    return F.to_json(F.try_parse_json(json))


def schema_errors(name: Column, arguments: Column, schemas: dict) -> Column:
    """Array of errors of JSON arguments against the schema of the named tool."""
    value = F.try_parse_json(arguments)
    keys = F.json_object_keys(arguments)
    cases = F.when(name.isNull() | ~name.isin(*schemas), F.array(F.lit("unknown tool")))
    for tool, parameters in schemas.items():
        errors = []
        for key, (kind, required, least) in sorted(parameters.items()):
            path = f"$.{key}"
            there = F.array_contains(keys, key)
            kind_of = F.lower(F.schema_of_variant(F.try_variant_get(value, path, "variant")))
            fits = kind_of.rlike(f"^({_TYPES[kind]})")
            error = F.when(~there, F.lit(f"{key}: missing") if required else F.lit(None)).when(~fits, F.lit(f"{key}: not {kind}"))
            if least is not None:
                size = F.length(F.try_variant_get(value, path, "string")) if kind == "string" else F.try_variant_get(value, path, "double")
                error = error.when(size < least, F.lit(f"{key}: under {least}"))
            errors.append(error)
        unknown = F.transform(F.array_sort(F.array_except(keys, F.array(*map(F.lit, sorted(parameters))))), lambda k: F.concat(k, F.lit(": unknown")))
        cases = cases.when(name == tool, F.concat(F.filter(F.array(*errors), lambda e: e.isNotNull()), unknown))
    return F.when(keys.isNull(), F.array(F.lit("not an object"))).otherwise(cases)


def depths(calls: DataFrame) -> DataFrame:
    """``calls(call_id, after)`` with unique ids -> call_id, depth (calls before it on its chain; null on or behind a cycle)."""
    known = calls.select(F.col("call_id").alias("k_id"))
    nodes = calls.select("call_id", "after").join(known, F.col("after") == F.col("k_id"), "left").select("call_id", F.col("k_id").alias("after"))
    nodes = cut(nodes.withColumn("depth", F.when(F.col("after").isNull(), 0).otherwise(1).cast("long")))
    left = nodes.where("after IS NOT NULL").count()
    for _ in range(math.ceil(math.log2(left + 1)) + 1 if left else 0):
        to = nodes.select(F.col("call_id").alias("t_id"), F.col("after").alias("t_after"), F.col("depth").alias("t_depth"))
        done, open_ = nodes.where("after IS NULL"), nodes.where("after IS NOT NULL")
        open_ = open_.join(to, F.col("after") == F.col("t_id")).select("call_id", F.col("t_after").alias("after"), (F.col("depth") + F.col("t_depth")).alias("depth"))
        nodes = cut(done.unionByName(open_))
        if nodes.where("after IS NOT NULL").isEmpty():
            break
    return nodes.select("call_id", F.when(F.col("after").isNull(), F.col("depth")).alias("depth"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict | None = None) -> DataFrame:
    """``calls(call_id, name, arguments, after)``, ``results(call_id, content)`` -> call_id, depth, status, errors,
    n_calls, n_results, message. Within one ``depth`` the order is free; sorting by depth is a topological order."""
    schemas = SCHEMAS if schemas is None else schemas
    one = calls.groupBy("call_id").agg(F.min(F.struct("name", "arguments", "after")).alias("c"), F.count("*").alias("n_calls"))
    one = cut(one.select("call_id", "c.*", "n_calls"))
    answers = results.groupBy(F.col("call_id").alias("r_id")).agg(F.min("content").alias("content"), F.count("*").alias("n_results"))
    joined = one.join(answers, F.col("call_id") == F.col("r_id"), "full_outer")
    placed = joined.join(depths(one.where("call_id IS NOT NULL")).withColumnRenamed("call_id", "d_id"), F.col("call_id") == F.col("d_id"), "left")
    is_call, answered = F.col("n_calls").isNotNull(), F.col("n_results").isNotNull()
    errors = F.when(is_call, schema_errors(F.col("name"), F.col("arguments"), schemas)).otherwise(F.array().cast("array<string>"))
    status = F.when(~is_call, "orphan").when(F.col("d_id").isNotNull() & F.col("depth").isNull(), "cycle").when(answered, "linked").otherwise("unanswered")
    text = lambda c: F.coalesce(F.to_json(F.col(c).cast("variant")), F.lit("null"))
    arguments = F.coalesce(canonical(F.col("arguments")), text("arguments"))
    message = F.concat(F.lit('{"arguments":'), arguments, F.lit(',"id":'), F.coalesce(text("call_id"), F.lit("null")), F.lit(',"name":'), text("name"), F.lit(',"result":'), text("content"), F.lit("}"))
    out = placed.withColumns({"errors": F.array_join(errors, "; "), "status": status, "message": message})
    return out.select(F.coalesce("call_id", "r_id").alias("call_id"), "depth", "status", "errors", F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), "message")


def of_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """User turns as ``reply`` calls, assistant turns as results of the turn before; a call builds on the answer given
    right before it. Identifiers are ``<conv_id>:<turn>``."""
    def at(shift: int) -> Column:
        return F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") + shift).cast("string"))

    rows = conversations.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    arguments = F.to_json(F.struct(F.col("text").alias("question"), "turn"))
    calls = rows.where("role = 'user'").select(at(0).alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"), at(-2).alias("after"))
    results = rows.where("role = 'assistant'").select(at(-1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_calls(*of_conversations(table(spark, sf_dir, "conversations")))


CALLS_SQL = """
WITH RECURSIVE rows AS (SELECT * FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
calls AS (
  SELECT conv_id || ':' || turn AS call_id, conv_id || ':' || (turn - 2) AS after, turn, min(text) AS text, count(*) AS n_calls
  FROM rows WHERE role = 'user' GROUP BY conv_id, turn),
answers AS (SELECT conv_id || ':' || (turn - 1) AS call_id, min(text) AS content, count(*) AS n_results FROM rows WHERE role = 'assistant' GROUP BY conv_id, turn),
walk AS (
  SELECT call_id, 0::BIGINT AS depth FROM calls WHERE after NOT IN (SELECT call_id FROM calls)
  UNION ALL SELECT c.call_id, w.depth + 1 FROM calls c JOIN walk w ON c.after = w.call_id)
SELECT coalesce(c.call_id, a.call_id) AS call_id, w.depth AS depth,
  CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN a.call_id IS NOT NULL THEN 'linked' ELSE 'unanswered' END AS status,
  CASE WHEN c.call_id IS NULL THEN '' ELSE concat_ws('; ', CASE WHEN c.text IS NULL THEN 'question: missing' WHEN c.text = '' THEN 'question: under 1' END, CASE WHEN c.turn < 0 THEN 'turn: under 0' END) END AS errors,
  coalesce(c.n_calls, 0)::BIGINT AS n_calls, coalesce(a.n_results, 0)::BIGINT AS n_results,
  '{"arguments":' || CASE WHEN c.call_id IS NULL THEN 'null' WHEN c.text IS NULL THEN '{"turn":' || c.turn || '}' ELSE '{"question":' || to_json(c.text)::VARCHAR || ',"turn":' || c.turn || '}' END
  || ',"id":' || coalesce(to_json(c.call_id)::VARCHAR, 'null') || ',"name":' || CASE WHEN c.call_id IS NULL THEN 'null' ELSE '"reply"' END
  || ',"result":' || coalesce(to_json(a.content)::VARCHAR, 'null') || '}' AS message
FROM calls c FULL OUTER JOIN answers a ON c.call_id = a.call_id LEFT JOIN walk w ON w.call_id = c.call_id
"""

QUERIES = {"op4_tool_calls": op4_tool_calls}
SQL = {"op4_tool_calls": CALLS_SQL}
