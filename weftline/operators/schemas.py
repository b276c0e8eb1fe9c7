"""JSON texts checked against a schema: the schema becomes a small table of states, the texts rows of (path, state, value).

A state is a place of the schema, references resolved; it knows what its value must be and which state its members and items
have. Values are variants that go down one level at a time: a row either ends as violations or is exploded to its members,
and a value of a wrong type goes no further. All levels are one pass over the texts; nothing is joined but the table of
states, which is as small as the schema.

Rules: type (a list of them is a union; true is no integer), enum and const (of scalars), minLength, maxLength, pattern,
minimum, maxItems, items, required, properties, additionalProperties (false or a schema), $ref within the schema. Where $ref
stands, its neighbours don't count. Texts that are no JSON violate `json`; null texts have no violations.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLOSED = -1  # the state of members that may not be
_STATE = (
    "state int, types array<string>, enums array<string>, const string, min_length int, max_length int, pattern string, "
    "minimum double, max_items int, items int, additional int, required array<string>, members map<string,int>"
)


@dataclass
class State:
    state: int
    types: list[str] | None = None
    enums: list[str] | None = None
    const: str | None = None
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    minimum: float | None = None
    max_items: int | None = None
    items: int | None = None
    additional: int | None = None
    required: list[str] = field(default_factory=list)
    members: dict[str, int] = field(default_factory=dict)

    def row(self) -> tuple:
        return tuple(vars(self).values())

    def below(self) -> list[int]:
        return [s for s in (self.items, self.additional, *self.members.values()) if s is not None and s >= 0]


def _scalar(value) -> str:
    """JSON of a scalar as compared: whole numbers without a fraction."""
    if isinstance(value, (dict, list)):
        raise ValueError("enum and const are for scalars only")
    if isinstance(value, float) and value == int(value):
        value = int(value)
    return json.dumps(value, ensure_ascii=False)


def compile_schema(schema: dict) -> list[State]:
    """States of a schema; the first is the root's. Places that one $ref names are one state, so schemas may recur."""
    states: list[State] = []
    known: dict[int, int] = {}

    def resolved(node: dict) -> dict:
        while "$ref" in node:
            at = schema
            for part in node["$ref"].removeprefix("#").strip("/").split("/"):
                at = at[part.replace("~1", "/").replace("~0", "~")] if part else at
            node = at
        return node

    def add(node: dict) -> int:
        node = resolved(node)
        if id(node) in known:
            return known[id(node)]
        own = State(len(states))
        known[id(node)] = own.state
        states.append(own)
        kinds = node.get("type")
        own.types = None if kinds is None else kinds if isinstance(kinds, list) else [kinds]
        own.enums = [_scalar(v) for v in node["enum"]] if "enum" in node else None
        own.const = _scalar(node["const"]) if "const" in node else None
        own.min_length, own.max_length, own.pattern = node.get("minLength"), node.get("maxLength"), node.get("pattern")
        own.minimum = float(node["minimum"]) if "minimum" in node else None
        own.max_items, own.required = node.get("maxItems"), list(node.get("required", []))
        own.members = {name: add(sub) for name, sub in node.get("properties", {}).items()}
        own.items = add(node["items"]) if "items" in node else None
        more = node.get("additionalProperties", True)
        own.additional = CLOSED if more is False else add(more) if isinstance(more, dict) else None
        return own.state

    add(schema)
    return states


def depth(states: list[State]) -> int | None:
    """Levels of values that a schema tells of; None if it recurs."""
    done: dict[int, int] = {}

    def of(state: int, path: tuple[int, ...]) -> int:
        if state in path:
            raise RecursionError
        if state not in done:
            done[state] = 1 + max([of(s, (*path, state)) for s in states[state].below()], default=0)
        return done[state]

    try:
        return of(0, ())
    except RecursionError:
        return None


def _kind(value: Column, text: Column) -> Column:
    """Type of a value, given with its JSON. Variants keep a fraction of zeros as a decimal, so 2.0 is no integer; whole numbers
    beyond 64 bits are decimals too, of 19 digits or more, and those beyond 38 digits count as numbers."""
    first = F.substring(text, 1, 1)
    own = F.schema_of_variant(value)
    scalar = (
        F.when(own == "STRING", "string").when(own == "BOOLEAN", "boolean").when(own == "VOID", "null")
        .when((own == "BIGINT") | own.rlike(r"^DECIMAL\((19|[23][0-9]),0\)$"), "integer").otherwise("number")
    )
    return F.when(first == "{", "object").when(first == "[", "array").otherwise(scalar)


def _level(rows: DataFrame, states: DataFrame) -> DataFrame:
    """One level down. Rows (k, path, state, v, rule, expected, got): state is null for violations, which stay."""
    rows = rows.withColumn("text", F.to_json("v")).withColumn("kind", _kind(F.col("v"), F.col("text")))
    rows = rows.join(F.broadcast(states), "state", "left")
    rows = rows.withColumn("string", F.when(F.col("kind") == "string", F.col("v").cast("string")))
    rows = rows.withColumn("entries", F.when(F.col("kind") == "object", F.map_entries(F.col("v").cast("map<string,variant>"))))
    number = F.col("kind").isin("integer", "number")
    scalar = F.when(number, F.regexp_replace("text", r"\.0+$", "")).otherwise(F.col("text"))
    kinds = F.array_join("types", "|")
    right = F.col("types").isNull() | F.array_contains("types", F.col("kind")) | ((F.col("kind") == "integer") & F.array_contains("types", F.lit("number")))

    def row(path, state, v, rule, expected, got):
        return F.struct(path.alias("path"), state.cast("int").alias("state"), v.alias("v"), rule.alias("rule"), expected.cast("string").alias("expected"), got.cast("string").alias("got"))

    no_value, nothing, text_of = F.lit(None).cast("variant"), F.lit(None), F.lit

    def wrong(rule, expected, got, path=None):
        return row(F.col("path") if path is None else path, nothing, no_value, text_of(rule), expected, got)

    size = F.length("string")
    tests = [
        (F.col("enums").isNotNull() & ~F.array_contains("enums", scalar), "enum", F.array_join("enums", "|"), F.col("text")),
        (F.col("const") != scalar, "const", F.col("const"), F.col("text")),
        (size < F.col("min_length"), "minLength", F.col("min_length"), size),
        (size > F.col("max_length"), "maxLength", F.col("max_length"), size),
        (F.col("pattern").isNotNull() & ~F.rlike("string", F.col("pattern")), "pattern", F.col("pattern"), F.col("string")),
        (F.when(number, F.col("text").try_cast("double")) < F.col("minimum"), "minimum", F.col("minimum").cast("string"), F.col("text")),
        (F.when(F.col("kind") == "array", F.json_array_length("text")) > F.col("max_items"), "maxItems", F.col("max_items"), F.json_array_length("text")),
    ]
    own = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), wrong(rule, expected, got)) for test, rule, expected, got in tests]), lambda x: x.isNotNull())
    names = F.transform("entries", lambda e: e["key"])
    absent = F.transform(F.array_except("required", names), lambda name: wrong("required", name, F.lit(None)))

    def member(e):
        to = F.coalesce(F.try_element_at("members", e["key"]), F.col("additional"))
        path = F.concat("path", F.lit("."), e["key"])
        return F.when(to == CLOSED, wrong("additionalProperties", F.lit(None), e["key"])).when(to.isNotNull(), row(path, to, e["value"], nothing.cast("string"), nothing, nothing))

    def item(v, i):
        return row(F.concat("path", F.lit("["), i.cast("string"), F.lit("]")), F.col("items"), v, nothing.cast("string"), nothing, nothing)

    none = F.filter(F.array(wrong("", F.lit(None), F.lit(None))), lambda x: F.lit(False))
    in_object = F.when(F.col("entries").isNotNull(), F.concat(absent, F.filter(F.transform("entries", member), lambda x: x.isNotNull()))).otherwise(none)
    in_array = F.when((F.col("kind") == "array") & F.col("items").isNotNull(), F.transform(F.col("v").cast("array<variant>"), item)).otherwise(none)
    stays = F.array(row(F.col("path"), nothing, no_value, F.col("rule"), F.col("expected"), F.col("got")))
    out = F.when(F.col("state").isNull(), stays).when(~right, F.array(wrong("type", kinds, F.col("kind")))).otherwise(F.concat(own, in_object, in_array))
    return rows.select("k", F.explode(out).alias("r")).select("k", "r.*")


def violations(docs: DataFrame, schema: dict, key: str, text: str) -> DataFrame:
    """(key, path, rule, expected, got) of what the JSON texts of docs violate; texts that keep the schema have no rows.

    Paths are `$`, `.name` and `[i]`. Rows of one key are checked each. A schema that recurs is followed as deep as the
    values go, with a job for each level."""
    spark = docs.sparkSession
    compiled = compile_schema(schema)
    states = spark.createDataFrame([s.row() for s in compiled], _STATE)
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).filter("t IS NOT NULL").withColumn("v", F.try_parse_json("t"))
    bad = F.col("v").isNull()
    rows = rows.select(
        "k", F.lit("$").alias("path"), F.when(~bad, 0).alias("state"), "v", F.when(bad, "json").alias("rule"),
        F.lit(None).cast("string").alias("expected"), F.lit(None).cast("string").alias("got"),
    )
    levels = depth(compiled)
    if levels is not None:
        for _ in range(levels):
            rows = _level(rows, states)
    else:
        while not rows.filter("state IS NOT NULL").isEmpty():
            rows = _level(rows, states)
    return rows.select(F.col("k").alias(key), "path", "rule", "expected", "got")


def states_cte(schema: dict, name: str = "states") -> str:
    """The states as a table of constants in SQL, members as a list of structs."""

    def sql(v):
        if v is None:
            return "NULL"
        if isinstance(v, list):
            return "[" + ", ".join(map(sql, v)) + "]::VARCHAR[]"
        return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    rows = []
    for s in compile_schema(schema):
        *values, members = s.row()
        pairs = ", ".join(f"{{'name': {sql(n)}, 'state': {m}}}" for n, m in members.items())
        rows.append("(" + ", ".join(map(sql, values)) + f", [{pairs}]::STRUCT(name VARCHAR, state INTEGER)[])")
    columns = "state, types, enums, const, min_length, max_length, pattern, minimum, max_items, items, additional, required, members"
    return f"{name}({columns}) AS (VALUES {', '.join(rows)})"
