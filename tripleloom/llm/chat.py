"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, session_of

#: Types of a schema and what they admit (bool is no number).
TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}
#: Schemas of the tools that `conversation_calls` derives.
SCHEMAS = {
    "ask": {"properties": {"limit": {"type": "integer", "minimum": 1, "maximum": 8}, "query": {"type": "string", "minLength": 1}}, "required": ["limit", "query"]},
    "look": {"properties": {"query": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}, "required": ["query", "turn"]},
}
ROUNDS_BETWEEN_CHECKPOINTS = 4


def problem(value, schema: dict, at: str = "") -> str:
    """The first fault of a value against a schema (type, required, properties, enum, bounds), by name; '' if none. A type may be a
    list of names, of which one must fit; a name that is none fits nothing. Bounds hold for numbers, lengths for strings only."""
    kind = schema.get("type", "object" if "properties" in schema else None)
    kinds = kind if isinstance(kind, list) else [kind]
    if kind is not None and not any(fits(value, k) for k in kinds):
        return f"{at or 'arguments'}: not {' or '.join(map(str, kinds))}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at}: not in enum"
    if fits(value, "number") and ("minimum" in schema and value < schema["minimum"] or "maximum" in schema and value > schema["maximum"]):
        return f"{at}: out of range"
    if isinstance(value, str) and "minLength" in schema and len(value) < schema["minLength"]:
        return f"{at}: too short"
    if isinstance(value, list) and "items" in schema:
        return next((p for i, v in enumerate(value) if (p := problem(v, schema["items"], f"{at}[{i}]"))), "")
    if isinstance(value, dict) and "properties" in schema:
        for k in sorted(schema.get("required", [])):
            if k not in value:
                return f"{k}: missing"
        for k in sorted(value):
            if k not in schema["properties"]:
                if not schema.get("additionalProperties", False):
                    return f"{k}: unknown"
            elif found := problem(value[k], schema["properties"][k], k):
                return found
    return ""


def fits(value, kind: str) -> bool:
    return kind in TYPES and isinstance(value, TYPES[kind]) and not (isinstance(value, bool) and kind in ("integer", "number"))


def canonical(value) -> str:
    """JSON with sorted keys and no blanks; no NaN, and no lone surrogate, which UTF-8 can't hold (ValueError for both)."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    text.encode()
    return text


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): 0 for calls that wait for none, else one more than the highest they wait for. Calls
    in or behind a cycle have no row; what they wait for but isn't there, or is null, counts as done.

    One round for each level: calls whose last open dependency is done come next. No conversation is gathered anywhere."""
    key = ["conv_id", "call_id"]
    waits = calls.select("conv_id", "call_id", F.explode("depends_on").alias("on")).distinct()
    there = calls.select("conv_id", F.col("call_id").alias("on"))
    waits = saved(waits.join(there, ["conv_id", "on"], "left_semi"))
    done = saved(calls.select(*key).join(waits, key, "left_anti").withColumn("level", F.lit(0)))
    n = 0
    while True:
        n += 1
        finished = done.select("conv_id", F.col("call_id").alias("on"), "level")
        open_ = waits.join(done.select(*key), key, "left_anti")
        counted = open_.join(finished, ["conv_id", "on"], "left").groupBy(*key).agg(F.count("*").alias("all"), F.count("level").alias("ready"))
        new = saved(counted.filter(F.col("all") == F.col("ready")).select(*key, F.lit(n).alias("level")))
        if new.isEmpty():
            return done
        done = done.union(new)
        if n % ROUNDS_BETWEEN_CHECKPOINTS == 0:
            done = saved(done)


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row for each call: conv_id, turn, call_id, name, level, n_copies, linked, problem and record, its canonical JSON.

    calls: (conv_id, turn, call_id, name, arguments, depends_on); results: (conv_id, call_id, turn, content). Of calls with one id the
    first by turn, name and arguments counts and n_copies tells how many there were; likewise of results. Calls and results
    are joined by conversation and id. Rows without conv_id or call_id can't be linked and are left out. A call without result is
    kept with linked false. Arguments that are no JSON object, that UTF-8 or JSON can't hold or that are nested too deeply, and names
    without a schema, are problems; such arguments are null in the record. Rows come sorted by (conv_id, level, turn, call_id), a
    topological order of each conversation; level is null for calls in or behind a cycle, which come last."""
    session_of(calls)
    key = ["conv_id", "call_id"]
    one = (
        calls.filter("conv_id is not null and call_id is not null").groupBy(*key)
        .agg(F.min(F.struct("turn", "name", "arguments", "depends_on")).alias("c"), F.count("*").alias("n_copies")).select(*key, "c.*", "n_copies")
    )
    one = saved(one)
    answer = results.groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("a")).select(*key, "a.content", F.lit(True).alias("has"))
    joined = one.join(answer, key, "left").join(levels(one), key, "left")
    rows = joined.select("conv_id", "turn", "call_id", "name", "level", "n_copies", F.coalesce("has", F.lit(False)).alias("linked"), "arguments", "content")

    def write(batches):
        for b in batches:
            problems, records = [], []
            columns = (b.column(k).to_pylist() for k in range(b.num_columns))
            for _, turn, call_id, name, _, _, linked, arguments, content in zip(*columns, strict=True):
                whole = {"arguments": None, "id": call_id, "name": name, "result": content if linked else None, "turn": turn}
                try:
                    value = json.loads(arguments or "")
                    # the record holds the arguments one level deeper than they are
                    record = canonical(whole | {"arguments": value})
                    found = "arguments: not object" if not isinstance(value, dict) else problem(value, schemas[name]) if name in schemas else "name: unknown"
                except RecursionError:
                    record, found = canonical(whole), "arguments: nested too deeply"
                except ValueError:
                    record, found = canonical(whole), "arguments: not JSON"
                problems.append(found)
                records.append(record)
            new = [pa.array(problems, pa.string()), pa.array(records, pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[:7], *new], names=["conv_id", "turn", "call_id", "name", "level", "n_copies", "linked", "problem", "record"])

    kinds = dict(rows.dtypes)
    head = ", ".join(f"{c} {kinds[c]}" for c in rows.columns[:7])
    rows = rows.orderBy("conv_id", F.asc_nulls_last("level"), "turn", "call_id")
    return rows.mapInArrow(write, f"{head}, problem string, record string")


def conversation_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that stand for a conversation's turns: each user turn asks a tool, and the turn after it answers. Even
    turns ask with a limit, odd ones look with their turn; a turn waits for the user turn at half its number, rounded down."""
    c = conversations.filter("turn is not null")
    call_id = F.concat(F.lit("call_"), F.col("turn").cast("string"))
    asks = F.col("turn") % 2 == 0
    query = F.coalesce(F.col("text"), F.lit(""))
    quoted = F.expr("substring(to_json(struct(coalesce(text, '') as q)), 6, length(to_json(struct(coalesce(text, '') as q))) - 6)")
    arguments = F.when(asks, F.concat(F.lit('{"query": '), quoted, F.lit(', "limit": '), (F.col("turn") % 16 + 1).cast("string"), F.lit("}")))
    arguments = arguments.otherwise(F.concat(F.lit('{"turn": '), F.col("turn").cast("string"), F.lit(', "query": '), quoted, F.lit("}")))
    on = F.floor(F.col("turn") / 2).cast("bigint")
    depends = F.when(on < F.col("turn"), F.array(F.concat(F.lit("call_"), on.cast("string")))).otherwise(F.array().cast("array<string>"))
    users = c.filter("role = 'user'")
    calls = users.select("conv_id", "turn", call_id.alias("call_id"), F.when(asks, "ask").otherwise("look").alias("name"), arguments.alias("arguments"), depends.alias("depends_on"))
    answers = c.filter("role = 'assistant'").select("conv_id", F.concat(F.lit("call_"), (F.col("turn") - 1).cast("string")).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, answers


#: The same in DuckDB SQL, for what `conversation_calls` derives.
ORACLE = """
WITH RECURSIVE u AS (
  SELECT conv_id, turn, text, count(*) OVER (PARTITION BY conv_id, turn) AS n_copies,
    row_number() OVER (PARTITION BY conv_id, turn ORDER BY coalesce(text, '')) AS r
  FROM conversations WHERE role = 'user' AND turn IS NOT NULL AND conv_id IS NOT NULL),
c AS (SELECT conv_id, turn, n_copies, to_json(coalesce(text, ''))::VARCHAR AS q, coalesce(text, '') AS t FROM u WHERE r = 1),
a AS (SELECT conv_id, turn - 1 AS turn, min(text) AS content, count(*) AS n FROM conversations WHERE role = 'assistant' AND turn IS NOT NULL GROUP BY 1, 2),
lv(conv_id, turn, level) AS (
  SELECT conv_id, turn, 0 FROM c WHERE turn = 0 OR NOT EXISTS (SELECT 1 FROM c p WHERE p.conv_id = c.conv_id AND p.turn = c.turn // 2)
  UNION ALL
  SELECT c.conv_id, c.turn, lv.level + 1 FROM lv JOIN c ON c.conv_id = lv.conv_id AND c.turn // 2 = lv.turn AND c.turn > 0)
SELECT c.conv_id, c.turn, 'call_' || c.turn AS call_id, CASE WHEN c.turn % 2 = 0 THEN 'ask' ELSE 'look' END AS name, lv.level, c.n_copies,
  a.n IS NOT NULL AS linked,
  CASE WHEN c.turn % 2 = 0 AND c.turn % 16 + 1 > 8 THEN 'limit: out of range' WHEN c.t = '' THEN 'query: too short' ELSE '' END AS problem,
  '{"arguments":{' || CASE WHEN c.turn % 2 = 0 THEN '"limit":' || (c.turn % 16 + 1) || ',"query":' || c.q ELSE '"query":' || c.q || ',"turn":' || c.turn END
    || '},"id":"call_' || c.turn || '","name":"' || CASE WHEN c.turn % 2 = 0 THEN 'ask' ELSE 'look' END
    || '","result":' || coalesce(to_json(a.content)::VARCHAR, 'null') || ',"turn":' || c.turn || '}' AS record
FROM c LEFT JOIN a USING (conv_id, turn) JOIN lv USING (conv_id, turn)
"""
