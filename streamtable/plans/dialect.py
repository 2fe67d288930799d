"""Function names of the SQL dialect that Spark writes differently: calls are put into Spark's terms before a query is planned."""

from __future__ import annotations

import re
from collections.abc import Callable

from streamtable.errors import StreamtableError

_STRING = re.compile(r"'(?:[^'\\]|\\.|'')*'")
_SKIP = re.compile(r"'(?:[^'\\]|\\.|'')*'|--[^\n]*|/\*.*?\*/|\"[^\"]*\"|`[^`]*`", re.S)
_CALL = re.compile(r"([^\W\d]\w*)\s*\(")


def _literal(text: str, call: str) -> str:
    """What a string literal holds; some calls can only be put into Spark's terms if an argument is one."""
    if not _STRING.fullmatch(text.strip()):
        raise StreamtableError(f"{call} needs a string literal, not {text.strip()}")
    return text.strip()[1:-1].replace("''", "'")


def _sha(bits: int) -> Callable[[list[str]], str]:
    return lambda a: f"unhex(sha2({a[0]}, {bits}))"


def _digest(a: list[str]) -> str:
    method = _literal(a[1], "digest").lower()
    if method == "md5":
        return f"unhex(md5({a[0]}))"
    if method not in ("sha224", "sha256", "sha384", "sha512"):
        raise StreamtableError(f"no digest is called {method}")
    return _sha(int(method[3:]))(a)


def _encode(a: list[str]) -> str | None:
    kind = a[1].strip().strip("'").lower()
    return {"hex": f"lower(hex({a[0]}))", "base64": f"regexp_replace(base64(CAST({a[0]} AS BINARY)), '[^A-Za-z0-9+/]', '')"}.get(kind)


def _decode(a: list[str]) -> str | None:
    return {"hex": f"unhex({a[0]})", "base64": f"unbase64({a[0]})"}.get(a[1].strip().strip("'").lower())


def _regexp_match(a: list[str]) -> str:
    """The first match's groups, or the match itself if the pattern has none; null without a match."""
    groups = re.compile(_literal(a[1], "regexp_match").replace("\\\\", "\\")).groups
    found = [f"regexp_extract({a[0]}, {a[1]}, {k})" for k in (range(1, groups + 1) if groups else [0])]
    return f"CASE WHEN {a[0]} RLIKE {a[1]} THEN array({', '.join(found)}) END"


def _to_timestamp(unit: str) -> Callable[[list[str]], str | None]:
    # A number counts units since 1970; a text is a time.
    return lambda a: f"coalesce(timestamp_{unit}(try_cast({a[0]} AS BIGINT)), try_to_timestamp(CAST({a[0]} AS STRING)))" if len(a) == 1 else None


def _trunc(a: list[str]) -> str | None:
    if len(a) == 2 and not re.fullmatch(r"-?\d+", a[1].strip()):
        return None  # of a date
    scale = f"1e{int(a[1])}D" if len(a) == 2 else "1D"
    return f"CASE WHEN {a[0]} < 0 THEN CAST(ceil({a[0]} * {scale}) AS DOUBLE) ELSE CAST(floor({a[0]} * {scale}) AS DOUBLE) END / {scale}"


def _inner(x: str) -> str:
    return f"from_json({x}, 'array<string>')"


def _dims(a: list[str]) -> str:
    """Lengths of an array's levels, up to four, each from its first element. JSON makes the levels one type."""
    level, sizes = f"to_json({a[0]})", []
    for _ in range(4):
        sizes.append(f"CASE WHEN startswith({level}, '[') THEN size({_inner(level)}) END")
        level = f"get({_inner(level)}, 0)"
    return f"filter(array({', '.join(sizes)}), n -> n IS NOT NULL)"


# Column types as Arrow names them.
ARROW_NAMES = {
    "tinyint": "Int8", "smallint": "Int16", "int": "Int32", "bigint": "Int64", "float": "Float32", "double": "Float64", "boolean": "Boolean",
    "string": "Utf8", "binary": "Binary", "date": "Date32", "timestamp": "Timestamp(Microsecond, Some(\"UTC\"))", "timestamp_ntz": "Timestamp(Microsecond, None)", "void": "Null",
}


def _arrow_typeof(a: list[str]) -> str:
    names = ", ".join(f"'{k}', '{v}'" for k, v in ARROW_NAMES.items())
    return f"coalesce(try_element_at(map({names}), typeof({a[0]})), typeof({a[0]}))"


def _length(a: list[str]) -> str:
    return f"array_size({a[0]})" if len(a) == 1 else f"get({_dims(a)}, ({a[1]}) - 1)"


#: Calls by name. None leaves a call as it is.
CALLS: dict[str, Callable[[list[str]], str | None]] = {
    "approx_distinct": lambda a: f"approx_count_distinct({a[0]})",
    "approx_median": lambda a: f"percentile_approx({a[0]}, 0.5)",
    "approx_percentile_cont": lambda a: f"percentile_approx({', '.join(a)})",
    "approx_percentile_cont_with_weight": lambda a: f"percentile({a[0]}, {a[2]}, CAST({a[1]} AS BIGINT))",
    "make_array": lambda a: f"array({', '.join(a)})",
    "array_concat": lambda a: f"concat({', '.join(a)})",
    "array_dims": _dims,
    "array_length": _length,
    "array_ndims": lambda a: f"CAST(length(regexp_extract(typeof({a[0]}), '^(array<)*', 0)) / 6 AS INT)",
    "array_positions": lambda a: f"filter(transform({a[0]}, (v, k) -> CASE WHEN v = {a[1]} THEN k + 1 END), k -> k IS NOT NULL)",
    "array_replace": lambda a: f"transform({a[0]}, v -> CASE WHEN v = {a[1]} THEN {a[2]} ELSE v END)",
    "array_to_string": lambda a: f"array_join(transform({a[0]}, v -> CAST(v AS STRING)), {', '.join(a[1:])})",
    "trim_array": lambda a: f"slice({a[0]}, 1, greatest(size({a[0]}) - ({a[1]}), 0))",
    "regexp_match": _regexp_match,
    "to_timestamp_millis": _to_timestamp("millis"),
    "to_timestamp_micros": _to_timestamp("micros"),
    "to_timestamp_seconds": _to_timestamp("seconds"),
    "from_unixtime": lambda a: f"timestamp_seconds({a[0]})" if len(a) == 1 else None,
    "digest": _digest,
    "sha224": _sha(224),
    "sha256": _sha(256),
    "sha384": _sha(384),
    "sha512": _sha(512),
    "encode": _encode,
    "decode": _decode,
    "arrow_typeof": _arrow_typeof,
    "starts_with": lambda a: f"startswith({', '.join(a)})",
    "trunc": _trunc,
    "unnest": lambda a: f"explode({a[0]})",
}


def _end(sql: str, at: int) -> tuple[int, list[str]] | None:
    """The place behind the bracket that closes the one before `at`, and the arguments in between."""
    depth, begin, args = 0, at, []
    while at < len(sql):
        if m := _SKIP.match(sql, at):
            at = m.end()
            continue
        c = sql[at]
        if c in "([":
            depth += 1
        elif c in ")]":
            if depth == 0:
                last = sql[begin:at]
                return at + 1, [*args, last] if args or last.strip() else []
            depth -= 1
        elif c == "," and depth == 0:
            args.append(sql[begin:at])
            begin = at + 1
        at += 1
    return None


def rewrite(sql: str) -> str:
    """The query with its calls of CALLS in Spark's terms; strings, comments and quoted names stay."""
    out, at = [], 0
    while at < len(sql):
        if m := _SKIP.match(sql, at):
            out.append(m[0])
            at = m.end()
        elif (at == 0 or not (sql[at - 1].isalnum() or sql[at - 1] in "_.")) and (m := _CALL.match(sql, at)) and m[1].lower() in CALLS and (found := _end(sql, m.end())):
            end, args = found
            args = [rewrite(a).strip() for a in args]
            try:
                new = CALLS[m[1].lower()](args)
            except IndexError:
                raise StreamtableError(f"{m[1]} has too few arguments") from None
            out.append(new if new is not None else f"{m[1]}({', '.join(args)})")
            at = end
        else:
            out.append(sql[at])
            at += 1
    return "".join(out)
