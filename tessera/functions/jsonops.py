"""JSON cells: strict guards, slices, canonical text and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def json_kind(text: Column) -> Column:
    """'array', 'object', 'string', 'number', 'boolean', 'null', or NULL for a text that does not parse."""
    shape = F.schema_of_variant(F.try_parse_json(text))
    return (
        F.when(shape.startswith("ARRAY"), "array").when(shape.startswith("OBJECT"), "object").when(shape == "STRING", "string")
        .when(shape == "BOOLEAN", "boolean").when(shape == "VOID", "null").when(shape.isNotNull(), "number")
    )


def is_object_array(text: Column) -> Column:
    """Whether the text is a JSON array of objects only (an empty array is); false where it does not parse."""
    items = F.try_parse_json(text).cast("array<variant>")
    kinds = F.transform(items, lambda v: F.schema_of_variant(v).startswith("OBJECT"))
    return F.coalesce((json_kind(text) == "array") & F.forall(kinds, lambda k: F.coalesce(k, F.lit(False))), F.lit(False))


def object_array(text: Column, schema: str) -> Column:
    """The array as structs of `schema` (missing keys NULL), or NULL where is_object_array is false."""
    return F.when(is_object_array(text), F.from_json(text, f"array<{schema}>"))


def string_array(text: Column) -> Column:
    """A JSON array of strings, trimmed and without blanks; malformed cells give an empty array."""
    parsed = F.when(json_kind(text) == "array", F.from_json(text, "array<string>"))
    return F.filter(F.transform(F.coalesce(parsed, F.array().cast("array<string>")), lambda s: F.trim(s)), lambda s: s.isNotNull() & (s != ""))


def object_slice(text: Column) -> Column:
    """From the first { to the last }."""
    return F.regexp_extract(text, r"(?s)(\{.*\})", 1)


def array_slice(text: Column) -> Column:
    """From the first [ to the last ]."""
    return F.regexp_extract(text, r"(?s)(\[.*\])", 1)


def canonical_json(columns: dict[str, Column]) -> Column:
    """JSON text of the columns with sorted keys; NULL values are left out."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]))


def fingerprint(columns: dict[str, Column], domain: Column | None = None, digits: int = 64) -> Column:
    """SHA-256 of the canonical JSON, after a domain and a zero byte where a domain is given."""
    body = canonical_json(columns)
    whole = body if domain is None else F.concat(domain, F.lit("\u0000"), body)
    return F.substring(F.sha2(whole, 256), 1, digits)


def cache_key(tool: Column, columns: dict[str, Column]) -> Column:
    return F.concat(tool, F.lit(":"), fingerprint(columns))


def content_text(content: Column) -> Column:
    """Text of a VARIANT that is a string, or an array of strings and {text: ...} parts."""
    kind = F.schema_of_variant(content)
    part = lambda p: F.when(F.schema_of_variant(p) == "STRING", p.cast("string")).otherwise(F.try_variant_get(p, "$.text", "string"))
    parts = F.filter(F.transform(content.cast("array<variant>"), part), lambda t: t.isNotNull())
    return F.when(kind == "STRING", content.cast("string")).when(kind.startswith("ARRAY"), F.array_join(parts, "\n"))


def sorted_map(m: Column) -> Column:
    """The map with its keys in order."""
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


def merge_maps(base: Column, over: Column) -> Column:
    """Union of two maps in which the second wins; NULL maps count as empty."""
    empty = F.create_map().cast("map<string,string>")
    b, o = F.coalesce(base, empty), F.coalesce(over, empty)
    return F.map_concat(F.map_filter(b, lambda k, _: ~F.array_contains(F.map_keys(o), k)), o)
