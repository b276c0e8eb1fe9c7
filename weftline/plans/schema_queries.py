"""Queries that check JSON of the given tables against schemas, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import schemas
from ..sources import pages as sources
from .audit_queries import query
from .site_queries import PG, table

PAGE_SCHEMA = {
    "type": "object",
    "required": ["page_id", "url", "kind", "path", "lang"],
    "additionalProperties": False,
    "properties": {
        "page_id": {"type": "integer", "minimum": 10},
        "url": {"type": "string", "pattern": "^https?://[a-z]+[.]", "maxLength": 44},
        "kind": {"type": ["integer", "null"]},
        "path": {"$ref": "#/definitions/path"},
        "lang": {"enum": ["en", "fr", "de", 1]},
    },
    "definitions": {
        "path": {
            "type": "object",
            "required": ["segments"],
            "properties": {"segments": {"type": "array", "maxItems": 1, "items": {"$ref": "#/definitions/segment"}}, "version": {"const": 1}},
            "additionalProperties": {"type": "string", "minLength": 2},
        },
        "segment": {"type": "string", "pattern": "^[^0-9]*$", "minLength": 3},
    },
}
EVENT_SCHEMA = {"type": "object", "required": ["k"], "additionalProperties": False, "properties": {"k": {"type": "integer", "minimum": 5}}}

#: Violations by a walk down the values. It takes a table of rows (k, j) named texts.
WALK = """walk AS (
  SELECT k, '$' AS path, 0 AS state, j::JSON AS v FROM texts WHERE json_valid(j)
  UNION ALL
  SELECT k, path || CASE kind WHEN 'array' THEN '[' || key || ']' ELSE '.' || key END,
         CASE kind WHEN 'array' THEN items ELSE coalesce(list_filter(members, lambda m: m.name = key)[1].state, additional) END,
         CASE kind WHEN 'array' THEN v -> key::INTEGER ELSE json_extract(v, '$."' || key || '"') END
  FROM (SELECT *, unnest(CASE kind WHEN 'object' THEN json_keys(v) WHEN 'array' THEN list_transform(range(json_array_length(v)::BIGINT), lambda i: i::VARCHAR) END) AS key
        FROM (SELECT w.k, w.path, w.v, s.*, KIND AS kind FROM walk w JOIN states s USING (state))
        WHERE kind IN ('object', 'array') AND (types IS NULL OR list_contains(types, kind)))
  WHERE CASE kind WHEN 'array' THEN items IS NOT NULL ELSE coalesce(list_filter(members, lambda m: m.name = key)[1].state, additional) >= 0 END
), nodes AS (
  SELECT *, types IS NULL OR list_contains(types, kind) OR (kind = 'integer' AND list_contains(types, 'number')) AS fits,
         CASE WHEN kind = 'string' THEN v ->> '$' END AS string, CASE WHEN kind IN ('integer', 'number') THEN regexp_replace(v::VARCHAR, '\\.0+$', '') ELSE v::VARCHAR END AS scalar
  FROM (SELECT w.k, w.path, w.v, s.*, KIND AS kind FROM walk w JOIN states s USING (state))
), violations AS (
  SELECT k, '$' AS path, 'json' AS rule, NULL::VARCHAR AS expected, NULL::VARCHAR AS got FROM texts WHERE NOT json_valid(j)
  UNION ALL SELECT k, path, 'type', array_to_string(types, '|'), kind FROM nodes WHERE NOT fits
  UNION ALL SELECT k, path, 'enum', array_to_string(enums, '|'), v::VARCHAR FROM nodes WHERE fits AND NOT list_contains(enums, scalar)
  UNION ALL SELECT k, path, 'const', const, v::VARCHAR FROM nodes WHERE fits AND const <> scalar
  UNION ALL SELECT k, path, 'minLength', min_length::VARCHAR, length(string)::VARCHAR FROM nodes WHERE fits AND length(string) < min_length
  UNION ALL SELECT k, path, 'maxLength', max_length::VARCHAR, length(string)::VARCHAR FROM nodes WHERE fits AND length(string) > max_length
  UNION ALL SELECT k, path, 'pattern', pattern, string FROM nodes WHERE fits AND NOT regexp_matches(string, pattern)
  UNION ALL SELECT k, path, 'minimum', minimum::DOUBLE::VARCHAR, v::VARCHAR FROM nodes WHERE fits AND kind IN ('integer', 'number') AND v::DOUBLE < minimum
  UNION ALL SELECT k, path, 'maxItems', max_items::VARCHAR, json_array_length(v)::VARCHAR FROM nodes WHERE fits AND kind = 'array' AND json_array_length(v) > max_items
  UNION ALL SELECT k, path, 'required', unnest(list_filter(required, lambda r: NOT list_contains(json_keys(v), r))), NULL FROM nodes WHERE fits AND kind = 'object'
  UNION ALL SELECT k, path, 'additionalProperties', NULL, unnest(list_filter(json_keys(v), lambda m: NOT list_contains(list_transform(members, lambda x: x.name), m))) FROM nodes WHERE fits AND kind = 'object' AND additional = -1
)""".replace("KIND", "CASE json_type(w.v) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'DOUBLE' THEN 'number' ELSE 'integer' END")

_KIND = ("true", "1", "1.5", '"one"', "null")


@query(
    "page_schema_violations",
    f"""WITH RECURSIVE {PG}, {schemas.states_cte(PAGE_SCHEMA)}, texts AS (
      SELECT page_id AS k, '{{"page_id":' || page_id || ',"url":' || to_json(url) || ',"kind":' || {list(_KIND)}[1 + page_id % 5]
        || ',"path":{{"segments":' || to_json(list_filter(string_split(path, '/'), lambda s: s <> '')) || ',"version":' || (page_id % 3) || ',"query":' || to_json(regexp_extract(url, '[?]([^#]*)', 1)) || '}}'
        || CASE WHEN page_id % 7 = 0 THEN ',"extra":{{}}' ELSE '' END || CASE WHEN page_id % 11 = 0 THEN '' ELSE ',"lang":' || to_json(regexp_extract(html, '<html lang="([^"]*)"', 1)) END
        || CASE WHEN page_id % 13 = 0 THEN '' ELSE '}}' END AS j FROM pg
    ), {WALK} SELECT k AS page_id, path, rule, expected, got FROM violations""",
)
def page_schema_violations(spark, sf_dir):
    """Records made of the pages, some of them odd on purpose, against a schema with references and a union."""
    i, text = F.col("page_id"), F.lit
    cell = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    segments = F.to_json(F.filter(F.split("path", "/"), lambda s: s != ""))
    record = F.concat(
        text('{"page_id":'), i.cast("string"), text(',"url":'), cell(F.col("url")), text(',"kind":'), F.get(F.array(*map(text, _KIND)), (i % 5).cast("int")),
        text(',"path":{"segments":'), segments, text(',"version":'), (i % 3).cast("string"), text(',"query":'), cell(F.regexp_extract("url", "[?]([^#]*)", 1)), text("}"),
        F.when(i % 7 == 0, ',"extra":{}').otherwise(""), F.when(i % 11 == 0, "").otherwise(F.concat(text(',"lang":'), cell(F.regexp_extract("html", '<html lang="([^"]*)"', 1)))),
        F.when(i % 13 == 0, "").otherwise("}"),
    )
    pages = sources.read_pages(spark, sf_dir).select("page_id", record.alias("record"))
    return schemas.violations(pages, PAGE_SCHEMA, "page_id", "record")


@query(
    "event_schema_violations",
    f"WITH RECURSIVE {schemas.states_cte(EVENT_SCHEMA)}, texts AS (SELECT event_id AS k, props AS j FROM events), {WALK} SELECT k AS event_id, path, rule, expected, got FROM violations",
)
def event_schema_violations(spark, sf_dir):
    return schemas.violations(table(spark, sf_dir, "events"), EVENT_SCHEMA, "event_id", "props")
