"""Tool-call linking: results joined to their calls, ordered, checked against schemas, written as canonical JSON."""

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: JSON types by the name that Spark gives a variant's schema.
TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"),
         "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",)}


def canonical_json(text: Column) -> Column:
    """The JSON text with keys in code point order and no white space; null where it is no JSON."""
    return F.to_json(F.try_parse_json(text))


#: What a schema may say; anything else is an error of the schema's.
KEYWORDS = {"type", "minimum", "maximum", "minLength", "maxLength", "enum", "pattern", "items", "properties", "required",
            "additionalProperties"}


def value_errors(value: Column, rule: dict, name: str) -> list[Column]:
    """What is wrong with a variant: texts, null where a rule is kept or there is no value."""
    if unknown := set(rule) - KEYWORDS:
        raise ValueError(f"schema of {name}: unknown {', '.join(sorted(unknown))}")
    kind = F.schema_of_variant(value)
    number, text = F.try_variant_get(value, "$", "double"), F.try_variant_get(value, "$", "string")
    size, wrong = F.char_length(text), {}
    if "type" in rule:
        wrong["type"] = ~reduce(lambda x, y: x | y, [kind.startswith(t) for t in TYPES[rule["type"]]])
    if "enum" in rule:
        wrong["enum"] = ~F.to_json(value).isin([json.dumps(x, ensure_ascii=False) for x in rule["enum"]])
    tests = {"minimum": lambda x: number < x, "maximum": lambda x: number > x, "minLength": lambda x: size < x,
             "maxLength": lambda x: size > x, "pattern": lambda x: kind.startswith("STRING") & ~text.rlike(x)}
    wrong |= {key: test(rule[key]) for key, test in tests.items() if key in rule}
    if "items" in rule:
        each = F.try_variant_get(value, "$", "array<variant>")
        wrong["items"] = F.exists(each, lambda x: reduce(
            lambda p, q: p | q, [e.isNotNull() for e in value_errors(x, rule["items"], f"{name}[]")], F.lit(False)))
    found = [F.when(test, F.lit(f"{key} of {name}")) for key, test in wrong.items()]
    if {"properties", "required", "additionalProperties"} & set(rule):
        found += object_errors(value, F.json_object_keys(F.to_json(value)), rule, f"{name}.")
    return found


def object_errors(value: Column, keys: Column, schema: dict, inside: str) -> list[Column]:
    """What is wrong with the properties of an object variant that has the keys."""
    found = [F.when(~F.array_contains(keys, name), F.lit(f"missing {inside}{name}")) for name in schema.get("required", [])]
    for name, rule in schema.get("properties", {}).items():
        found += value_errors(F.try_variant_get(value, f"$.{name}", "variant"), rule, inside + name)
    if not schema.get("additionalProperties"):
        allowed = F.array(*[F.lit(n) for n in schema.get("properties", {})]).cast("array<string>")
        more = f" of {inside[:-1]}" if inside else ""
        found.append(F.when(F.size(F.array_except(keys, allowed)) > 0, F.lit(f"unknown argument{more}")))
    return found


def argument_errors(arguments: Column, schema: dict) -> Column:
    """Array of what is wrong with a call's arguments: the empty array where they keep to the schema.

    schema: {"required": [...], "properties": {name: rule}}, where a rule may give type, minimum, maximum, minLength,
    maxLength, enum, pattern (found anywhere), items (a rule for each of an array) and, for an object, required and
    properties again. Properties not named are errors unless "additionalProperties" is true. Any other keyword raises a
    ValueError. Text that is no JSON object has one error.
    """
    if unknown := set(schema) - {"type", "properties", "required", "additionalProperties"}:
        raise ValueError(f"schema: unknown {', '.join(sorted(unknown))}")
    keys = F.json_object_keys(arguments)
    checks = object_errors(F.try_parse_json(arguments), keys, schema, "")
    found = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
    return F.when(keys.isNull(), F.array(F.lit("no JSON object"))).otherwise(found)


def linked_messages(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Messages (conv_id, turn, role, text, call_id, tool, arguments) with their links, order, errors and JSON.

    A message with a tool is a call; one with a call_id and no tool is a result; the rest are plain. A result is
    linked to the call of its call_id in the conversation by a hash join, whatever the order of the two. Of calls with
    one id the first turn is the call, the others are `repeated`; of several results all are linked.

    link: plain, answered or unanswered (calls), linked or orphan (results), repeated. at, step: topological order of
    a conversation, to be sorted by (at, step, turn): a message keeps its turn, a result comes no earlier than its
    call. A call id has one call and results depend on nothing else, so this order needs no rounds. errors: of a
    call's arguments against the schema of its tool (`unknown tool` without one). json: the message as canonical JSON,
    keys in order, absent fields left out; arguments that are no JSON stay as text. Rows are returned as often as they
    come. Null conv_id or call_id links nothing. An empty table gives an empty table.
    """
    rows = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *[F.col(c).cast("string").alias(c) for c in ("role", "text", "call_id", "tool", "arguments")])
    is_call = F.col("tool").isNotNull()
    key = ["conv_id", "call_id"]
    # One row per id: the first call's turn and whether there is a result.
    ids = rows.where("conv_id is not null and call_id is not null").groupBy(*key).agg(
        F.min(F.when(is_call, F.struct(F.col("turn").isNull(), "turn"))).alias("call"),
        F.max(F.when(~is_call, F.lit(True))).alias("has_result"))
    ids = ids.select(*key, F.col("call").isNotNull().alias("has_call"), F.col("call.turn").alias("call_turn"), "has_result")
    joined = rows.join(ids.hint("shuffle_hash"), key, "left")
    link = (
        F.when(is_call & ~F.col("turn").eqNullSafe(F.col("call_turn")) & F.col("has_call"), "repeated")
        .when(is_call & F.col("has_result"), "answered").when(is_call, "unanswered")
        .when(F.col("call_id").isNull(), "plain").when(F.col("has_call"), "linked").otherwise("orphan"))
    errors = F.array(F.lit("unknown tool"))
    for name, schema in schemas.items():
        errors = F.when(F.col("tool") == name, argument_errors(F.col("arguments"), schema)).otherwise(errors)
    late = (F.col("link") == "linked") & (F.col("call_turn") >= F.coalesce("turn", F.col("call_turn")))
    out = joined.withColumn("link", link)
    return out.select(
        "conv_id", "turn", "role", "call_id", "link",
        F.when(late, F.col("call_turn")).otherwise(F.col("turn")).alias("at"), late.cast("int").alias("step"),
        F.when(is_call, errors).alias("errors"),
        F.to_json(F.struct(
            F.coalesce(canonical_json(F.col("arguments")), "arguments").alias("arguments"), "call_id",
            F.col("text").alias("content"), F.col("tool").alias("name"), "role")).alias("json"))
