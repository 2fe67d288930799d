"""Statements: which ones are handled by the registry, and how queries' names are bound for Spark."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from streamtable.errors import StreamtableError, TableKindError, TableNotFound
from streamtable.plans.registry import Registry

if TYPE_CHECKING:
    from streamtable.datastore import Datastore

#: Strings and comments are passed over; what is left are names of one or more parts, and single characters.
_TOKEN = re.compile(r"(?P<skip>'(?:[^'\\]|\\.|'')*'|--[^\n]*|/\*.*?\*/|\"[^\"]*\"(?!\s*\.))|(?P<name>(?:`[^`]+`|[^\W\d]\w*)(?:\s*\.\s*(?:`[^`]+`|[^\W\d]\w*))*)|.", re.S)
#: What comes before an alias.
_ALIASED = re.compile(r"\bAS\s+\Z", re.I)
INFORMATION = ("tables", "columns", "views", "schemata", "df_settings")


def _parts(name: str) -> list[str]:
    return [x.strip().strip("`") for x in re.findall(r"`[^`]+`|\w+", name)]


def _found(registry: Registry, parts: list[str], catalog: str, schema: str) -> tuple[tuple[str, str, str], int] | None:
    """The table that a name begins with, and how many parts that takes; longer readings come first."""
    for n in (3, 2, 1):
        if len(parts) < n:
            continue
        full = tuple((catalog, schema)[: 3 - n]) + tuple(parts[:n])
        if registry.has(full) or n > 1 and full[1] == "information_schema" and full[0] in registry.catalogs and full[2] in INFORMATION:
            return full, n
    return None


def _bound_name(full: tuple[str, str, str], n: int) -> str:
    return full[2] if n == 1 else ".".join(full)


def tables_in(registry: Registry, sql: str, catalog: str, schema: str) -> Iterator[tuple[tuple[str, str, str], str]]:
    """(table, the session's name for it) for each table that a query may name."""
    seen = set()
    for m in _TOKEN.finditer(sql):
        if m["name"] and not _ALIASED.search(sql, 0, m.start()) and (found := _found(registry, _parts(m["name"]), catalog, schema)) and (key := (found[0], _bound_name(*found))) not in seen:
            seen.add(key)
            yield found[0], f"`{key[1]}`"


#: What may follow a table's name other than its alias.
_AFTER = frozenset(
    "where group order having limit offset join inner left right full cross natural union intersect except minus on using window lateral semi anti tablesample "
    "pivot unpivot qualify fetch distribute cluster sort with select from set values".split()
)
_ALIAS = re.compile(r"\s*(?:(AS)\b|`|([^\W\d]\w*))", re.I)


def bound(registry: Registry, sql: str, catalog: str, schema: str) -> str:
    """The query with names of several parts as the single names that they are bound to, each under its last part as alias."""

    def put(m: re.Match) -> str:
        if not m["name"] or _ALIASED.search(sql, 0, m.start()):
            return m[0]
        parts = _parts(m["name"])
        found = _found(registry, parts, catalog, schema)
        if not found or found[1] == 1:
            return m[0]
        full, n = found
        if len(parts) > n:  # a column
            return ".".join(f"`{x}`" for x in (full[2], *parts[n:]))
        after = _ALIAS.match(sql, m.end())
        named = after and (after[1] or not after[2] or after[2].lower() not in _AFTER)
        return f"`{_bound_name(full, n)}`" + ("" if named else f" AS `{full[2]}`")

    return _TOKEN.sub(put, sql)


def is_query(sql: str) -> bool:
    return bool(re.match(r"\s*(?:--[^\n]*\n\s*)*\(*\s*(SELECT|WITH|VALUES|TABLE|FROM)\b", sql, re.I))


_N = r"((?:`[^`]+`|\w+)(?:\.(?:`[^`]+`|\w+))*)"
_RULES = [
    (re.compile(p, re.I | re.S), kind)
    for p, kind in (
        (rf"CREATE\s+(OR\s+REPLACE\s+)?(MATERIALIZED\s+)?VIEW\s+(IF\s+NOT\s+EXISTS\s+)?{_N}\s+AS\s+(.+)", "create_view"),
        (rf"CREATE\s+SCHEMA\s+(IF\s+NOT\s+EXISTS\s+)?{_N}", "create_schema"),
        (rf"CREATE\s+(?:DATABASE|CATALOG)\s+(IF\s+NOT\s+EXISTS\s+)?{_N}", "create_catalog"),
        (rf"CREATE\s+(OR\s+REPLACE\s+)?TABLE\s+(IF\s+NOT\s+EXISTS\s+)?{_N}\s+AS\s+(.+)", "create_table_as"),
        (rf"CREATE\s+(OR\s+REPLACE\s+)?TABLE\s+(IF\s+NOT\s+EXISTS\s+)?{_N}\s*\((.+)\)", "create_table"),
        (rf"DROP\s+TABLE\s+(IF\s+EXISTS\s+)?{_N}", "drop_table"),
        (rf"DROP\s+VIEW\s+(IF\s+EXISTS\s+)?{_N}", "drop_view"),
        (rf"DROP\s+SCHEMA\s+(IF\s+EXISTS\s+)?{_N}(?:\s+(CASCADE|RESTRICT))?", "drop_schema"),
        (rf"DROP\s+(?:DATABASE|CATALOG)\s+(IF\s+EXISTS\s+)?{_N}(?:\s+(CASCADE|RESTRICT))?", "drop_catalog"),
        (rf"INSERT\s+INTO\s+(?:TABLE\s+)?{_N}\s*(?:\(([^()]*)\)\s*)?((?:SELECT\b|WITH\b|VALUES\b|TABLE\b|FROM\b|\().*)", "insert"),
        (rf"(?:DESCRIBE|DESC)\s+(?:TABLE\s+)?{_N}", "describe"),
        (r"SHOW\s+TABLES", "show_tables"),
        (r"EXPLAIN\s+(ANALYZE\s+|FORMATTED\s+|EXTENDED\s+|CODEGEN\s+|COST\s+)?(.+)", "explain"),
    )
]


def _name(s: str) -> str:
    return ".".join(_parts(s))


def run(ds: "Datastore", sql: str) -> DataFrame:
    """Run one statement. Definitions give an empty result, INSERT the number of rows."""
    text = sql.strip().rstrip(";").strip()
    plain = re.sub(r"\A(?:\s*--[^\n]*\n|\s*/\*.*?\*/)*\s*", "", text, flags=re.S)
    if is_query(plain):
        return ds._plan(plain, ds.catalog, ds.schema)
    for pattern, kind in _RULES:
        if m := pattern.fullmatch(plain):
            return _HANDLERS[kind](ds, m) or ds.session.createDataFrame([], T.StructType([]))
    if re.match(r"(UPDATE|DELETE|MERGE|TRUNCATE|ALTER|COPY)\b", plain, re.I):
        raise TableKindError("topics only grow: rows are appended with INSERT")
    return ds.session.sql(bound(ds.registry, plain, ds.catalog, ds.schema))


def _create_view(ds, m):
    ds.create_view(_name(m[4]), m[5], if_not_exists=bool(m[3]), or_replace=bool(m[1]), materialize=bool(m[2]))


def _create_table(ds, m):
    from streamtable.types import TopicInfo, from_schema

    schema = T.StructType.fromDDL(m[4])
    time_column = next((f.name for f in schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))), "time")
    info: TopicInfo = from_schema(schema, time_column)
    ds.create_topic(_name(m[3]), info, if_not_exists=bool(m[2]), or_replace=bool(m[1]))


def _create_table_as(ds, m):
    from streamtable.types import from_schema

    df = ds._plan(m[4], ds.catalog, ds.schema)
    name, full = _name(m[3]), ds.resolve(_name(m[3]))
    if m[2] and not m[1] and ds.registry.has(full):
        return None
    times = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
    if not times:
        raise StreamtableError("a topic needs a timestamp column")
    topic = ds.create_topic(name, from_schema(df.schema, times[0]), or_replace=bool(m[1]))
    return _count(ds, topic.append(df))


def _count(ds, n: int) -> DataFrame:
    return ds.session.createDataFrame([(n,)], "count long")


def _insert(ds, m):
    name = _name(m[1])
    topic = ds.table(name)
    if topic.kind != "topic":
        raise TableKindError(f"{name} is a view")
    df = ds._plan(m[3], ds.catalog, ds.schema)
    names = [x.strip().strip("`") for x in m[2].split(",")] if m[2] else [c.name for c in topic.info.columns]
    if len(names) != len(df.columns):
        raise StreamtableError(f"{len(df.columns)} columns for {len(names)}")
    return _count(ds, topic.append(df.toDF(*names)))


def _explain(ds, m):
    from contextlib import redirect_stdout
    from io import StringIO

    df = ds._plan(m[2], ds.catalog, ds.schema)
    mode = (m[1] or "formatted").strip().lower()
    if mode == "analyze":
        df.write.format("noop").mode("overwrite").save()
        mode = "cost"
    with redirect_stdout(out := StringIO()):
        df.explain(mode)
    return ds.session.createDataFrame([(out.getvalue(),)], "plan string")


def _drop_view(ds, m):
    full = ds.resolve(_name(m[2]))
    if not m[1] and not ds.registry.has(full):
        raise TableNotFound(".".join(full))
    ds.drop(_name(m[2]), "view", bool(m[1]))


_HANDLERS = {
    "create_view": _create_view,
    "create_table": _create_table,
    "create_table_as": _create_table_as,
    "create_schema": lambda ds, m: ds.create_schema(_name(m[2]), bool(m[1])),
    "create_catalog": lambda ds, m: ds.create_catalog(_name(m[2]), bool(m[1])),
    "drop_table": lambda ds, m: ds.drop(_name(m[2]), "topic", bool(m[1])),
    "drop_view": _drop_view,
    "drop_schema": lambda ds, m: ds.drop_schema(_name(m[2]), bool(m[1]), (m[3] or "").upper() == "CASCADE"),
    "drop_catalog": lambda ds, m: ds.drop_catalog(_name(m[2]), bool(m[1]), (m[3] or "").upper() == "CASCADE"),
    "insert": _insert,
    "describe": lambda ds, m: ds.describe(_name(m[1])),
    "show_tables": lambda ds, m: ds.information_schema(ds.catalog, "tables"),
    "explain": _explain,
}
