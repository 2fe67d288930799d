"""SQL scalar functions that Spark lacks under these names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def gcd(a: Column, b: Column, steps: int = 93) -> Column:
    """Greatest common divisor of whole numbers: Euclid's steps as a fold; 93 are enough for any two longs."""
    start = F.struct(F.abs(a.cast("long")).alias("a"), F.abs(b.cast("long")).alias("b"))
    step = lambda s, _: F.when(s.b == 0, s).otherwise(F.struct(s.b.alias("a"), F.try_mod(s.a, s.b).alias("b")))
    return F.when(a.isNotNull() & b.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s.a))


def lcm(a: Column, b: Column) -> Column:
    """Least common multiple; 0 if either is."""
    return F.when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise(F.abs(F.call_function("div", a.cast("long"), gcd(a, b)) * b.cast("long")))


def trunc(x: Column, digits: int = 0) -> Column:
    """Towards zero at a decimal place."""
    scale = 10.0**digits
    whole = F.when(x < 0, F.ceil(x * scale)).otherwise(F.floor(x * scale)).cast("double")
    return whole / scale


def strpos(text: Column, part: Column) -> Column:
    """1-based place of a part, 0 if it isn't there."""
    return F.call_function("instr", text, part)


def to_hex(x: Column) -> Column:
    return F.lower(F.hex(x))


def digest(text: Column, method: str) -> Column:
    """A hash as bytes."""
    if method == "md5":
        return F.unhex(F.md5(text))
    if method not in ("sha224", "sha256", "sha384", "sha512"):
        raise ValueError(f"no digest is called {method}")
    return F.unhex(F.sha2(text, int(method[3:])))


def date_bin(microseconds: int, ts: Column, origin: str = "1970-01-01") -> Column:
    """Start of the interval of a fixed length, counted from the origin, that holds a time."""
    zero = F.unix_micros(F.lit(origin).cast("timestamp"))
    at = F.unix_micros(ts.cast("timestamp")) - zero
    return F.timestamp_micros(at - F.pmod(at, F.lit(microseconds)) + zero)


def array_positions(a: Column, value) -> Column:
    """All 1-based places of a value."""
    v = value if isinstance(value, Column) else F.lit(value)
    return F.filter(F.transform(a, lambda x, k: F.when(x == v, k + 1)), lambda k: k.isNotNull())


def array_replace(a: Column, old, new) -> Column:
    return F.transform(a, lambda x: F.when(x == F.lit(old), F.lit(new)).otherwise(x))


def trim_array(a: Column, n: int) -> Column:
    """Without its last n elements."""
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - n, F.lit(0)))


#: SQL functions that sessions of a datastore know besides Spark's own.
SQL = {
    "strpos": "(s STRING, p STRING) RETURNS INT RETURN instr(s, p)",
    "to_hex": "(x BIGINT) RETURNS STRING RETURN lower(hex(x))",
    "gcd": "(a BIGINT, b BIGINT) RETURNS BIGINT RETURN aggregate(sequence(1, 93), named_struct('a', abs(a), 'b', abs(b)), (s, i) -> if(s.b = 0, s, named_struct('a', s.b, 'b', try_mod(s.a, s.b))), s -> s.a)",
    "lcm": "(a BIGINT, b BIGINT) RETURNS BIGINT RETURN CASE WHEN a = 0 OR b = 0 THEN 0 ELSE abs(a div gcd(a, b) * b) END",
    "date_bin": "(width INTERVAL DAY TO SECOND, ts TIMESTAMP, origin TIMESTAMP DEFAULT TIMESTAMP'1970-01-01 00:00:00') RETURNS TIMESTAMP RETURN "
    "timestamp_micros(unix_micros(ts) - pmod(unix_micros(ts) - unix_micros(origin), unix_micros(timestamp_micros(0) + width)))",
}


def register(session: SparkSession) -> list[str]:
    """Make SQL available as temporary functions; returns their names."""
    for name, body in SQL.items():
        session.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(SQL)
