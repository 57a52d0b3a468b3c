"""Field types, merged schemas and the checks that a predicate fits a field."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class FieldType:
    """A field type: what it may be used for, whether exact uses go through a
    keyword twin, which type wins a conflict, and the Spark type."""

    name: str
    category: str
    priority: int
    spark: str
    match: bool = False
    term: bool = False
    range: bool = False
    sort: bool = False
    aggregation: bool = False
    keyword_twin: bool = False


#: Fixed values.
_TYPES = [
    FieldType("text", category="text", priority=100, spark="string", match=True, keyword_twin=True),
    FieldType("match_only_text", category="text", priority=99, spark="string", match=True, keyword_twin=True),
    FieldType("search_as_you_type", category="completion", priority=98, spark="string", match=True),
    FieldType("semantic", category="specialized", priority=95, spark="string", match=True),
    FieldType("keyword", category="keyword", priority=90, spark="string", term=True, range=True, sort=True, aggregation=True),
    FieldType("constant_keyword", category="keyword", priority=89, spark="string", term=True, sort=True, aggregation=True),
    FieldType("wildcard", category="keyword", priority=88, spark="string", term=True, sort=True, aggregation=True),
    FieldType("version", category="keyword", priority=87, spark="string", term=True, range=True, sort=True, aggregation=True),
    FieldType("unsigned_long", category="numeric", priority=82, spark="decimal(20,0)", term=True, range=True, sort=True, aggregation=True),
    FieldType("long", category="numeric", priority=80, spark="bigint", term=True, range=True, sort=True, aggregation=True),
    FieldType("integer", category="numeric", priority=78, spark="int", term=True, range=True, sort=True, aggregation=True),
    FieldType("short", category="numeric", priority=76, spark="smallint", term=True, range=True, sort=True, aggregation=True),
    FieldType("byte", category="numeric", priority=74, spark="tinyint", term=True, range=True, sort=True, aggregation=True),
    FieldType("double", category="numeric", priority=72, spark="double", term=True, range=True, sort=True, aggregation=True),
    FieldType("scaled_float", category="numeric", priority=71, spark="decimal(38,6)", term=True, range=True, sort=True, aggregation=True),
    FieldType("float", category="numeric", priority=70, spark="float", term=True, range=True, sort=True, aggregation=True),
    FieldType("half_float", category="numeric", priority=68, spark="float", term=True, range=True, sort=True, aggregation=True),
    FieldType("token_count", category="numeric", priority=66, spark="int", term=True, range=True, sort=True, aggregation=True),
    FieldType("date_nanos", category="date", priority=51, spark="timestamp", term=True, range=True, sort=True, aggregation=True),
    FieldType("date", category="date", priority=50, spark="timestamp", term=True, range=True, sort=True, aggregation=True),
    FieldType("boolean", category="boolean", priority=40, spark="boolean", term=True, sort=True, aggregation=True),
    FieldType("ip", category="ip", priority=35, spark="string", term=True, range=True, sort=True, aggregation=True),
    FieldType("geo_point", category="geo", priority=30, spark="struct<lat:double,lon:double>", sort=True, aggregation=True),
    FieldType("geo_shape", category="geo", priority=29, spark="binary", aggregation=True),
    FieldType("xy_point", category="cartesian", priority=28, spark="struct<x:double,y:double>"),
    FieldType("xy_shape", category="cartesian", priority=27, spark="binary"),
    FieldType("date_range", category="range", priority=26, spark="struct<gte:timestamp,lte:timestamp>", range=True, aggregation=True),
    FieldType("long_range", category="range", priority=25, spark="struct<gte:bigint,lte:bigint>", range=True, aggregation=True),
    FieldType("integer_range", category="range", priority=24, spark="struct<gte:int,lte:int>", range=True, aggregation=True),
    FieldType("double_range", category="range", priority=23, spark="struct<gte:double,lte:double>", range=True, aggregation=True),
    FieldType("float_range", category="range", priority=22, spark="struct<gte:float,lte:float>", range=True, aggregation=True),
    FieldType("ip_range", category="range", priority=21, spark="struct<gte:string,lte:string>", range=True, aggregation=True),
    FieldType("knn_vector", category="vector", priority=20, spark="array<float>"),
    FieldType("sparse_vector", category="vector", priority=19, spark="map<string,float>"),
    FieldType("completion", category="completion", priority=15, spark="string"),
    FieldType("flat_object", category="object", priority=12, spark="map<string,string>", term=True, aggregation=True),
    FieldType("nested", category="object", priority=11, spark="array<struct<>>", aggregation=True),
    FieldType("object", category="object", priority=10, spark="struct<>"),
    FieldType("join", category="object", priority=9, spark="string", aggregation=True),
    FieldType("rank_feature", category="specialized", priority=8, spark="double"),
    FieldType("rank_features", category="specialized", priority=7, spark="map<string,double>"),
    FieldType("percolator", category="specialized", priority=6, spark="string"),
    FieldType("binary", category="binary", priority=5, spark="binary"),
    FieldType("alias", category="alias", priority=1, spark="string"),
]

TYPES: dict[str, FieldType] = {t.name: t for t in _TYPES}


def register(field_type: FieldType) -> None:
    TYPES[field_type.name] = field_type


def allows(field_type: str, use: str) -> bool:
    """Whether a type may be used for match, term, range, sort or aggregation."""
    return field_type in TYPES and getattr(TYPES[field_type], use)


def check(field_type: str, use: str) -> None:
    """Raise where a use does not fit a type; text counts for exact uses too,
    through its keyword twin."""
    if field_type in TYPES and not allows(field_type, use) and not TYPES[field_type].keyword_twin:
        raise ValueError(f"{use} does not fit a {field_type} field")


def most_permissive(names: list[str]) -> str:
    return max(names, key=lambda n: (TYPES[n].priority if n in TYPES else 0, n))


def type_of(field: T.StructField) -> str:
    """Declared type of a column: its metadata, else what its Spark type suggests."""
    if "type" in field.metadata:
        return field.metadata["type"]
    kind = field.dataType.typeName()
    return {"string": "keyword", "bigint": "long", "long": "long", "integer": "integer", "short": "short", "byte": "byte", "double": "double", "float": "float", "boolean": "boolean", "timestamp": "date", "timestamp_ntz": "date", "date": "date", "binary": "binary", "struct": "object", "map": "flat_object"}.get(kind, "nested" if kind == "array" else "keyword")


@dataclass(frozen=True)
class MergedField:
    name: str
    type: str
    types: dict[str, str]

    @property
    def conflict(self) -> bool:
        return len(set(self.types.values())) > 1


def merge(schemas: Mapping[str, T.StructType], strategy: str = "most_common") -> dict[str, MergedField]:
    """Fields over all tables.  Conflicts go to the most common type (ties: higher
    priority), the most permissive one, or that of the last table by name;
    ``strict`` raises."""
    seen: dict[str, dict[str, str]] = {}
    for table in sorted(schemas):
        for f in schemas[table].fields:
            seen.setdefault(f.name, {})[table] = type_of(f)
    out = {}
    for name, types in seen.items():
        values = list(types.values())
        if strategy == "strict" and len(set(values)) > 1:
            raise ValueError(f"types of {name} conflict: {sorted(set(values))}")
        if strategy == "most_permissive":
            chosen = most_permissive(values)
        elif strategy == "most_recent":
            chosen = types[max(types)]
        else:
            counts = Counter(values)
            chosen = max(counts, key=lambda n: (counts[n], TYPES[n].priority if n in TYPES else 0, n))
        out[name] = MergedField(name, chosen, types)
    return out


def resolve(merged: Mapping[str, MergedField], name: str, use: str) -> str:
    """The column to use: the field itself where its type allows the use, else its
    keyword twin ``name.keyword``; an error where there is neither.  Fields that
    the tables do not have stay as they are."""
    if name not in merged or merged[name].type not in TYPES or allows(merged[name].type, use):
        return name
    twin = f"{name}.keyword"
    if TYPES[merged[name].type].keyword_twin and twin in merged and allows(merged[twin].type, use):
        return twin
    raise ValueError(f"{use} does not fit {name}, a {merged[name].type} field without a keyword twin")


def declared(fields: Mapping[str, str]) -> T.StructType:
    """A schema from field names and type names; ``a.b`` is field b of object a.
    The type names are kept in the columns' metadata."""
    tree: dict = {}
    for name, kind in fields.items():
        if kind not in TYPES:
            raise ValueError(f"no such field type: {kind}")
        *path, last = name.split(".") if TYPES[kind].name != "keyword" or not name.endswith(".keyword") else [name]
        at = tree
        for step in path:
            at = at.setdefault(step, {})
            if not isinstance(at, dict):
                raise ValueError(f"{step} in {name} is no object")
        at[last] = kind

    def build(at: dict) -> T.StructType:
        return T.StructType([T.StructField(n, build(k), True, {"type": "object"}) if isinstance(k, dict) else T.StructField(n, T._parse_datatype_string(TYPES[k].spark) if k not in ("object", "nested") else T._parse_datatype_string("map<string,string>" if k == "object" else "array<map<string,string>>"), True, {"type": k}) for n, k in at.items()])

    return build(tree)


def conflicts(merged: Mapping[str, MergedField]) -> list[MergedField]:
    return [f for f in merged.values() if f.conflict]
