"""Chat formatting: tool calls linked to their results, ordered, validated and serialised.

Calls and results meet in a hash join on (conversation, identifier). Calls are
ordered by level, the length of the longest chain of calls they depend on;
levels are found by pointer doubling along chains and round by round where chains
meet, each round written to the shared folder. Arguments are checked against the schemas of their tools, and
every call becomes one line of canonical JSON: sorted keys, no white space,
numbers and strings as Spark's VARIANT writes them. (level, seq) orders the lines
of a conversation, so no conversation is ever collected or sorted in one task.

Defined results: a call without an identifier links to nothing and has level 0;
calls sharing an identifier share the result and the level; of results sharing
one, the first (by seq, then content) is linked and the others are left over;
results of unknown calls are left over; dependencies on unknown calls or on
itself do not count; calls on or behind a cycle have no level; arguments that
are null or no JSON object are invalid and serialised as null; tools without a
schema are invalid; empty tables give no rows. All expressions are native.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, materialize, read

#: JSON types by what VARIANT calls them.
TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
         "boolean": "^BOOLEAN$", "array": "^ARRAY<", "object": "^OBJECT<", "null": "^VOID$"}


def quoted(text: Column) -> Column:
    """JSON of a string, null for null."""
    json = F.to_json(F.array(text))
    return F.when(text.isNull(), "null").otherwise(F.substr(json, F.lit(2), F.length(json) - 2))


def argument_errors(name: Column, arguments: str, schemas: dict[str, dict]) -> Column:
    """Sorted messages for a call whose parsed arguments are the VARIANT column ``arguments``.

    A schema is the JSON-Schema subset {"properties": {name: {"type", "enum", "minLength", "maxLength", "minimum",
    "maximum"}}, "required": [...], "additionalProperties": bool}."""
    def of(schema: dict) -> Column:
        found = []
        for key, rule in sorted(schema.get("properties", {}).items()):
            path = "$['" + key.replace("'", "\\'") + "']"
            value = F.try_variant_get(F.col(arguments), path, "variant")
            text, number = (F.try_variant_get(F.col(arguments), path, t) for t in ("string", "double"))
            tests = []
            if "type" in rule:
                tests.append((~F.schema_of_variant(value).rlike(TYPES[rule["type"]]), f"{key}: not of type {rule['type']}"))
            if "enum" in rule:
                tests.append((~text.isin(rule["enum"]), f"{key}: not one of the values"))
            tests += [(test, f"{key}: {what}") for rule_name, test, what in (
                ("minLength", F.length(text) < rule.get("minLength", 0), "too short"),
                ("maxLength", F.length(text) > rule.get("maxLength", 0), "too long"),
                ("minimum", number < rule.get("minimum", 0), "too small"),
                ("maximum", number > rule.get("maximum", 0), "too large")) if rule_name in rule]
            if key in schema.get("required", ()):
                found.append(F.when(value.isNull(), f"{key}: missing"))
            found += [F.when(value.isNotNull() & F.coalesce(test, F.lit(False)), what) for test, what in tests]
        if not schema.get("additionalProperties", True):
            keys = F.json_object_keys(F.to_json(F.col(arguments)))
            known = F.array(*[F.lit(k) for k in schema.get("properties", {})]).cast("array<string>")
            found.append(F.when(F.size(F.array_except(keys, known)) > 0, "unknown argument"))
        return F.array_sort(F.array_compact(F.array(*found).cast("array<string>")))

    chosen = reduce(lambda c, kv: c.when(name == kv[0], of(kv[1])), sorted(schemas.items()),
                    F.when(F.lit(False), F.array().cast("array<string>")))
    listed = chosen.otherwise(F.array(F.lit("unknown tool")))
    is_object = F.schema_of_variant(F.col(arguments)).startswith("OBJECT<")
    return F.when(F.coalesce(is_object, F.lit(False)), listed).otherwise(F.array(F.lit("arguments are no object")))


def _chains(waits: DataFrame) -> DataFrame:
    """(conv_id, call_id, up, off) of calls with one dependency: the nearest call above with none or several, and how far.

    Pointer doubling: every round each call takes over what its ``up`` points to, so a chain takes as many rounds as
    its length has binary digits. Calls on or behind a cycle keep pointing at calls with one dependency and are left out."""
    chain = materialize(waits.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.min("dep").alias("up"))
                        .filter("n = 1").select("conv_id", "call_id", "up", F.lit(1).cast("bigint").alias("off")), "chains")
    for _ in range(chain.count().bit_length() + 1):
        above = chain.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("up2"), F.col("off").alias("off2"))
        chain = materialize(chain.join(above, ["conv_id", "up"], "left").select(
            "conv_id", "call_id", F.coalesce("up2", "up").alias("up"), (F.col("off") + F.coalesce("off2", F.lit(0))).alias("off"),
            F.col("up2").isNotNull().alias("moved")), "chains")
        if chain.filter("moved").isEmpty():
            break
    return chain.filter("NOT moved").drop("moved") if "moved" in chain.columns else chain


def call_levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of the calls that have a level.

    Chains are shortened first; the rounds left are as many as calls with several dependencies stand above each other."""
    spark = calls.sparkSession
    nodes = calls.filter("conv_id IS NOT NULL AND call_id IS NOT NULL")
    known = nodes.select("conv_id", "call_id").distinct()
    waits = nodes.select("conv_id", "call_id", F.explode("depends_on").alias("dep")).filter("dep <> call_id").distinct()
    waits = materialize(waits.join(known.withColumnRenamed("call_id", "dep"), ["conv_id", "dep"], "left_semi"), "dependencies")
    chain = materialize(_chains(waits), "chains")
    several = waits.groupBy("conv_id", "call_id").count().filter("count > 1").drop("count")
    tops = chain.select("conv_id", F.col("call_id").alias("dep"), F.col("up"), "off")
    waits_on = waits.join(several, ["conv_id", "call_id"], "left_semi").join(tops, ["conv_id", "dep"], "left").select(
        "conv_id", "call_id", F.coalesce("up", "dep").alias("up"), F.coalesce("off", F.lit(0)).alias("off"),
        F.lit(None).cast("bigint").alias("at"))
    waits_on = materialize(waits_on, "waits")
    path = fresh_path(spark, "levels")
    new = materialize(known.join(waits.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti")
                      .withColumn("level", F.lit(0).cast("bigint")), "level")
    new.write.parquet(path)
    while not waits_on.isEmpty() and not new.isEmpty():
        done = new.select("conv_id", F.col("call_id").alias("up"), "level")
        waits_on = materialize(waits_on.join(done, ["conv_id", "up"], "left").select(
            "conv_id", "call_id", "up", "off", F.coalesce("at", F.col("level") + F.col("off")).alias("at")), "waits")
        ready = waits_on.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.count("at").alias("have"),
                                                           (F.max("at") + 1).alias("level"))
        new = materialize(ready.filter("n = have").drop("n", "have"), "level")
        new.write.mode("append").parquet(path)
        waits_on = materialize(waits_on.join(new, ["conv_id", "call_id"], "left_anti"), "waits")
    levels = spark.read.parquet(path)
    below = chain.join(levels.withColumnRenamed("call_id", "up"), ["conv_id", "up"]).select(
        "conv_id", "call_id", (F.col("level") + F.col("off")).alias("level"))
    return levels.unionByName(below).withColumn("level", F.col("level").cast("int"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Lines for ``calls`` (conv_id, call_id, seq, name, arguments: JSON text, depends_on: array of identifiers) and
    ``results`` (conv_id, call_id, seq, content): conv_id, call_id, seq, kind (call or result), level, linked,
    errors, record. Results are lines of their own only where no call has them. Other columns are not read."""
    calls = calls.select("conv_id", "call_id", "seq", "name", "arguments", "depends_on")
    results = results.select("conv_id", "call_id", "seq", "content")
    first = results.filter("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(
        F.min(F.struct(F.col("seq").alias("result_seq"), F.col("content"))).alias("result"))
    parsed = calls.withColumn("args", F.try_parse_json(F.col("arguments")))
    lines = (parsed.join(first.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
             .join(call_levels(calls), ["conv_id", "call_id"], "left"))
    errors = argument_errors(F.col("name"), "args", schemas)
    is_object = F.coalesce(F.schema_of_variant("args").startswith("OBJECT<"), F.lit(False))
    canonical = F.when(is_object, F.to_json(F.col("args"))).otherwise("null")
    level = F.when(F.col("call_id").isNull() | F.col("conv_id").isNull(), 0).otherwise(F.col("level"))
    record = F.concat(F.lit('{"arguments":'), canonical, F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"name":'),
                      quoted(F.col("name")), F.lit(',"result":'), quoted(F.col("result.content")), F.lit("}"))
    out = lines.select("conv_id", "call_id", "seq", F.lit("call").alias("kind"), level.alias("level"),
                       F.col("result").isNotNull().alias("linked"), errors.alias("errors"), record.alias("record"))
    taken = first.join(calls.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_semi").select(
        "conv_id", "call_id", F.col("result.result_seq").alias("seq"), F.col("result.content").alias("content"))
    spare = results.join(taken.select(*[F.col(c).alias(f"t_{c}") for c in taken.columns]),
                         reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in taken.columns]), "left_anti")
    left_over = spare.select(
        "conv_id", "call_id", "seq", F.lit("result").alias("kind"), F.lit(None).cast("int").alias("level"),
        F.lit(False).alias("linked"), F.array(F.lit("no call")).alias("errors"),
        F.concat(F.lit('{"id":'), quoted(F.col("call_id")), F.lit(',"result":'), quoted(F.col("content")), F.lit("}")).alias("record"))
    return out.unionByName(left_over)


def message_lines(turns: DataFrame) -> DataFrame:
    """Lines for turns (conv_id, turn, role, text) that neither call nor answer."""
    record = F.concat(F.lit('{"content":'), quoted(F.col("text")), F.lit(',"role":'), quoted(F.col("role")), F.lit("}"))
    return turns.select("conv_id", F.lit(None).cast("string").alias("call_id"), F.col("turn").alias("seq"),
                        F.lit("message").alias("kind"), F.lit(0).alias("level"), F.lit(False).alias("linked"),
                        F.array().cast("array<string>").alias("errors"), record.alias("record"))


SCHEMAS = {
    "ask": {"properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
            "required": ["prompt", "turn"], "additionalProperties": False},
    "follow_up": {"properties": {"prompt": {"type": "string", "minLength": 20, "maxLength": 400},
                                 "turn": {"type": "integer", "minimum": 2}, "after": {"type": "string"}},
                  "required": ["after", "prompt", "turn"], "additionalProperties": False},
}


def calls_of(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results in a table of turns (conv_id, turn, role, text): a user's turn calls ``ask``, or from the
    third turn on ``follow_up`` after the turn two before; an assistant's turn is the result of the turn before it."""
    ident = lambda turn: F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), turn.cast("string"))
    turn = F.col("turn")
    users, helpers = turns.filter("role = 'user'"), turns.filter("role = 'assistant'")
    later = F.coalesce(turn >= 2, F.lit(False))
    arguments = F.concat(F.lit('{"turn":'), F.coalesce(turn.cast("string"), F.lit("null")), F.lit(',"prompt":'), quoted(F.col("text")),
                         F.when(later, F.concat(F.lit(',"after":'), quoted(ident(turn - 2)))).otherwise(""), F.lit("}"))
    known = F.col("conv_id").isNotNull() & turn.isNotNull()
    calls = users.select("conv_id", F.when(known, ident(turn)).alias("call_id"), turn.alias("seq"),
                         F.when(later, "follow_up").otherwise("ask").alias("name"), arguments.alias("arguments"),
                         F.when(later, F.array(ident(turn - 2))).otherwise(F.array().cast("array<string>")).alias("depends_on"))
    results = helpers.select("conv_id", F.when(known, ident(turn - 1)).alias("call_id"), turn.alias("seq"),
                             F.col("text").alias("content"))
    return calls, results


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    others = turns.filter("coalesce(role, '') NOT IN ('user', 'assistant')")
    lines = link_calls(*calls_of(turns), SCHEMAS).unionByName(message_lines(others))
    return lines.withColumn("errors", F.concat_ws("; ", "errors"))


OP10_SQL = """
WITH t AS (SELECT conv_id, turn, role, text, 'call-' || conv_id || '-' || turn AS id,
                  'call-' || conv_id || '-' || (turn - 1) AS before, 'call-' || conv_id || '-' || (turn - 2) AS two
           FROM conversations),
u AS (SELECT * FROM t WHERE role = 'user'), a AS (SELECT * FROM t WHERE role = 'assistant'),
lv AS (WITH RECURSIVE r AS (
    SELECT conv_id, turn, 0 AS level FROM u WHERE turn < 2 OR NOT EXISTS (
        SELECT 1 FROM u v WHERE v.conv_id = u.conv_id AND v.turn = u.turn - 2)
    UNION ALL SELECT u.conv_id, u.turn, r.level + 1 FROM r JOIN u ON u.conv_id = r.conv_id AND u.turn = r.turn + 2 AND u.turn >= 2)
  SELECT * FROM r)
SELECT u.conv_id, u.id AS call_id, u.turn AS seq, 'call' AS kind, lv.level, a.id IS NOT NULL AS linked,
    concat_ws('; ', CASE WHEN u.turn >= 2 AND length(u.text) > 400 THEN 'prompt: too long' END,
        CASE WHEN u.turn >= 2 AND length(u.text) < 20 OR length(u.text) < 1 THEN 'prompt: too short' END) AS errors,
    '{"arguments":{' || CASE WHEN u.turn >= 2 THEN '"after":' || to_json(u.two) || ',' ELSE '' END || '"prompt":'
      || to_json(u.text) || ',"turn":' || u.turn || '},"id":' || to_json(u.id) || ',"name":'
      || CASE WHEN u.turn >= 2 THEN '"follow_up"' ELSE '"ask"' END || ',"result":'
      || coalesce(CAST(to_json(a.text) AS VARCHAR), 'null') || '}' AS record
FROM u JOIN lv USING (conv_id, turn) LEFT JOIN a ON a.before = u.id
UNION ALL
SELECT a.conv_id, a.before, a.turn, 'result', NULL, false, 'no call',
    '{"id":' || to_json(a.before) || ',"result":' || to_json(a.text) || '}'
FROM a WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.id = a.before)
UNION ALL
SELECT conv_id, NULL, turn, 'message', 0, false, '',
    '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":'
    || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}'
FROM t WHERE coalesce(role, '') NOT IN ('user', 'assistant')
"""
