"""Scalar functions: each takes Columns and gives a Column that stays in the JVM wherever Spark can.

SQL rules hold throughout: null in, null out; a failing conversion or division gives null.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import ip, jsonfn

#: Fixed pairs: MySQL date-format letters and their java.time patterns.
DATE_LETTERS = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%c": "M", "%d": "dd", "%e": "d", "%H": "HH", "%k": "H", "%h": "hh", "%I": "hh", "%l": "h", "%i": "mm",
    "%s": "ss", "%S": "ss", "%f": "SSSSSS", "%p": "a", "%W": "EEEE", "%a": "EEE", "%M": "MMMM", "%b": "MMM", "%j": "DDD", "%T": "HH:mm:ss", "%r": "hh:mm:ss a", "%%": "%",
}
DAYS_TO_EPOCH = 719528
SECONDS_TO_EPOCH = 62167219200
VERSION = "0.1.0"


class Literal:
    """An argument that was written as a literal: its Python value stays known."""

    def __init__(self, value) -> None:
        self.value = value


def value_of(arg, what: str):
    if isinstance(arg, Literal):
        return arg.value
    raise ValueError(f"{what} must be a literal")


def col(arg) -> Column:
    return F.lit(arg.value) if isinstance(arg, Literal) else arg


def java_pattern(pattern: str) -> str:
    """A MySQL date format as a java.time pattern; other text is quoted."""
    out = []
    for part in re.findall(r"%.|[^%A-Za-z]+|[A-Za-z]+", pattern):
        out.append(DATE_LETTERS.get(part, part) if not part.isalpha() else f"'{part}'")
    return "".join(out)


def _format(arg) -> Column:
    pattern = value_of(arg, "a date format")
    return java_pattern(pattern) if "%" in pattern else pattern


def _truncate(x, digits=None):
    scale = F.pow(F.lit(10.0), col(digits)) if digits is not None else F.lit(1.0)
    return F.signum(x) * F.floor(F.abs(x) * scale) / scale


def _nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def _unit_interval(n: Column, unit: str) -> Column:
    unit = unit.lower().rstrip("s")
    names = {"year": "years", "month": "months", "week": "weeks", "day": "days", "hour": "hours", "minute": "mins", "second": "secs"}
    if unit not in names:
        raise ValueError(f"unknown interval unit {unit}")
    return F.make_interval(**{names[unit]: n if unit == "second" else n.cast("int")})


def _shift(sign: int) -> Callable:
    def run(x, n, unit=None):
        n = col(n) * sign
        if unit is None:
            return F.date_add(x, n.cast("int"))
        return x.cast("timestamp_ntz") + _unit_interval(n, value_of(unit, "an interval unit"))

    return run


def _clock(x: Column) -> Column:
    """Seconds of an HH:mm:ss text."""
    part = F.split(x.cast("string"), ":")
    return part[0].cast("long") * 3600 + F.coalesce(part[1].cast("long"), F.lit(0)) * 60 + F.coalesce(part[2].cast("double"), F.lit(0.0))


def _hms(seconds: Column) -> Column:
    s = F.abs(seconds).cast("long")
    return F.concat(F.when(seconds < 0, "-").otherwise(""), F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60))


def _seconds(x: Column) -> Column:
    return F.unix_timestamp(x.cast("timestamp"))


def _timediff(a, b):
    clock = r"^\d{1,3}:\d{2}(:\d{2}(\.\d+)?)?$"
    both = a.cast("string").rlike(clock) & b.cast("string").rlike(clock)
    return F.when(both, _hms(_clock(F.when(both, a.cast("string"))) - _clock(F.when(both, b.cast("string"))))).otherwise(_hms(F.unix_timestamp(a.try_cast("timestamp")) - F.unix_timestamp(b.try_cast("timestamp"))))


def _months(period: Column) -> Column:
    return F.floor(period / 100) * 12 + period % 100 - 1


def _period(months: Column) -> Column:
    return (F.floor(months / 12) * 100 + months % 12 + 1).cast("long")


def _timestampdiff(unit, start, end):
    return F.timestamp_diff(value_of(unit, "a unit").upper(), start.cast("timestamp"), end.cast("timestamp"))


def _case(*args):
    out = None
    for i in range(0, len(args) - 1, 2):
        cond, then = col(args[i]), col(args[i + 1])
        out = F.when(cond, then) if out is None else out.when(cond, then)
    return out.otherwise(col(args[-1])) if len(args) % 2 else out


def _quoted(arg) -> str:
    return "\\Q" + str(value_of(arg, "a delimiter")).replace("\\E", "\\E\\\\E\\Q") + "\\E"


#: Fixed names that a type may have, and Spark's.
TYPES = {
    "int": "int", "integer": "int", "long": "bigint", "bigint": "bigint", "short": "smallint", "byte": "tinyint", "float": "float", "double": "double",
    "string": "string", "varchar": "string", "text": "string", "keyword": "string", "bool": "boolean", "boolean": "boolean", "date": "date", "timestamp": "timestamp_ntz", "datetime": "timestamp_ntz",
}


def type_named(arg) -> str:
    name = str(value_of(arg, "a type")).lower()
    if name not in TYPES:
        raise ValueError(f"unknown type {name}")
    return TYPES[name]


def _now() -> Column:
    return F.current_timestamp()


def _utc() -> Column:
    return F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())


def _substring(x, start, length=None):
    return F.substr(x, col(start).cast("int"), col(length).cast("int")) if length is not None else F.substr(x, col(start).cast("int"))


def _ntz(x):
    return x.cast("timestamp_ntz")


MATH = {
    "abs": F.abs, "ceil": F.ceil, "floor": F.floor, "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)), "cbrt": F.cbrt,
    "round": lambda x, n=Literal(0): F.round(x, int(value_of(n, "a number of digits"))), "pow": lambda x, y: F.pow(x, y), "mod": lambda x, y: F.try_mod(x, y),
    "sign": lambda x: F.signum(x).cast("int"), "truncate": _truncate, "rand": lambda seed=None: F.rand(int(value_of(seed, "a seed"))) if seed else F.rand(),
    "log": lambda x, y=None: F.ln(x) if y is None else F.ln(col(y)) / F.ln(x), "log10": F.log10, "log2": F.log2, "exp": F.exp,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": lambda x: _nan_to_null(F.asin(x)), "acos": lambda x: _nan_to_null(F.acos(x)), "atan": F.atan, "atan2": F.atan2, "cot": F.cot,
    "degrees": F.degrees, "radians": F.radians, "e": F.e, "pi": F.pi,
    "bit_and": lambda x, y: x.bitwiseAND(y), "bit_or": lambda x, y: x.bitwiseOR(y), "bit_xor": lambda x, y: x.bitwiseXOR(y), "bit_not": F.bitwise_not,
}
STRING = {
    "upper": F.upper, "lower": F.lower, "trim": F.trim, "ltrim": F.ltrim, "rtrim": F.rtrim, "length": lambda x: F.length(x.cast("string")), "substring": _substring,
    "left": lambda x, n: F.left(x, col(n).cast("int")), "right": lambda x, n: F.right(x, col(n).cast("int")), "concat": lambda *x: F.concat(*(c.cast("string") for c in x)),
    "concat_ws": lambda sep, *x: F.concat_ws(str(value_of(sep, "a separator")), *map(col, x)), "replace": lambda x, a, b: F.replace(x, col(a), col(b)), "reverse": F.reverse,
    "repeat": lambda x, n: F.repeat(x, col(n).cast("int")), "locate": lambda sub, x, at=Literal(1): F.position(col(sub), x, col(at)), "instr": lambda x, sub: F.position(col(sub), x),
    "split": lambda x, d: F.split(x, _quoted(d)), "regexp": lambda x, p: F.regexp_like(x, col(p)), "regexp_replace": lambda x, p, r: F.regexp_replace(x, col(p), col(r)),
    "regexp_extract": lambda x, p, i=Literal(1): F.regexp_extract(x, value_of(p, "a pattern"), int(value_of(i, "a group"))), "like": lambda x, p: F.like(x, col(p)),
    "lpad": lambda x, n, p=Literal(" "): F.lpad(x, col(n).cast("int"), col(p)), "rpad": lambda x, n, p=Literal(" "): F.rpad(x, col(n).cast("int"), col(p)), "ascii": F.ascii, "chr": lambda n: F.char(n.cast("bigint")),
}
DATE = {
    "year": F.year, "month": F.month, "day": F.day, "hour": F.hour, "minute": F.minute, "second": F.second, "microsecond": lambda x: F.date_format(x, "SSSSSS").cast("int"),
    "dayofweek": F.dayofweek, "dayofyear": F.dayofyear, "weekofyear": F.weekofyear, "quarter": F.quarter, "dayname": lambda x: F.date_format(x, "EEEE"), "monthname": lambda x: F.date_format(x, "MMMM"),
    "now": _now, "curdate": F.current_date, "curtime": lambda: F.date_format(_now(), "HH:mm:ss"), "sysdate": _now, "utc_date": lambda: F.to_date(_utc()), "utc_time": lambda: F.date_format(_utc(), "HH:mm:ss"), "utc_timestamp": _utc,
    "date": lambda x: x.try_cast("date"), "time": lambda x: F.date_format(x, "HH:mm:ss"), "makedate": lambda y, n: F.date_add(F.make_date(y.cast("int"), F.lit(1), F.lit(1)), (n - 1).cast("int")),
    "maketime": lambda h, m, s: F.format_string("%02d:%02d:%02d", h.cast("int"), m.cast("int"), s.cast("int")), "date_add": _shift(1), "date_sub": _shift(-1),
    "addtime": lambda x, t: _ntz(x) + F.make_interval(secs=_clock(t)), "subtime": lambda x, t: _ntz(x) + F.make_interval(secs=-_clock(t)), "datediff": lambda a, b: F.datediff(a.try_cast("date"), b.try_cast("date")), "timediff": _timediff,
    "timestampdiff": _timestampdiff, "period_add": lambda p, n: _period(_months(p) + n), "period_diff": lambda a, b: (_months(a) - _months(b)).cast("long"),
    "from_days": lambda n: F.date_add(F.lit("1970-01-01").cast("date"), (n - DAYS_TO_EPOCH).cast("int")), "to_days": lambda x: F.datediff(x, F.lit("1970-01-01").cast("date")) + DAYS_TO_EPOCH,
    "to_seconds": lambda x: _seconds(x) + F.lit(SECONDS_TO_EPOCH), "from_unixtime": lambda x: _ntz(F.timestamp_seconds(x)), "unix_timestamp": lambda x=None: F.unix_timestamp() if x is None else _seconds(x), "last_day": F.last_day,
    "convert_tz": lambda x, a, b: F.convert_timezone(col(a), col(b), _ntz(x)), "date_format": lambda x, p: F.date_format(x, _format(p)), "str_to_date": lambda x, p: F.try_to_timestamp(x, F.lit(_format(p))).cast("timestamp_ntz"), "time_format": lambda x, p: F.date_format(x, _format(p)),
}
TYPE = {
    "int": lambda x: x.try_cast("int"), "long": lambda x: x.try_cast("bigint"), "float": lambda x: x.try_cast("float"), "double": lambda x: x.try_cast("double"), "string": lambda x: x.cast("string"), "bool": lambda x: x.try_cast("boolean"),
    "cast": lambda x, t: x.try_cast(type_named(t)), "convert": lambda x, t: x.try_cast(type_named(t)), "try_cast": lambda x, t: x.try_cast(type_named(t)), "typeof": F.typeof,
}
CONDITIONAL = {
    "isnull": lambda x: x.isNull(), "isnotnull": lambda x: x.isNotNull(), "ifnull": F.ifnull, "nvl2": F.nvl2, "nullif": F.nullif, "coalesce": F.coalesce, "if": lambda c, a, b: F.when(c, a).otherwise(b), "case": _case,
    "greatest": lambda *x: x[0] if len(x) == 1 else F.greatest(*x), "least": lambda *x: x[0] if len(x) == 1 else F.least(*x), "in": lambda x, *v: x.isin(*v), "between": lambda x, a, b: x.between(a, b),
}
CRYPTO = {
    "md5": F.md5, "sha1": F.sha1, "sha256": lambda x, n=Literal(256): F.sha2(x, int(value_of(n, "a digest size"))), "sha512": lambda x: F.sha2(x, 512), "base64": lambda x: F.base64(x.cast("binary")), "base64decode": lambda x: F.try_to_binary(x, F.lit("base64")).cast("string"),
    "urlencode": F.url_encode, "urldecode": F.try_url_decode, "hex": F.hex, "unhex": lambda x: F.unhex(x).cast("string"),
}
SYSTEM = {
    "version": lambda: F.lit(VERSION), "database": F.current_database, "user": F.current_user, "connection_id": lambda: F.lit(_application()), "session_user": F.session_user, "null": lambda: F.lit(None), "current_catalog": F.current_catalog, "current_schema": F.current_schema,
}


def _application() -> str:
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().sparkContext.applicationId


CATEGORIES = {"math": MATH, "string": STRING, "date": DATE, "type": TYPE, "conditional": CONDITIONAL, "cryptographic": CRYPTO, "ip": ip.FUNCTIONS, "json": jsonfn.FUNCTIONS, "system": SYSTEM}
#: Fixed alternative names.
ALIASES = {
    "ceiling": "ceil", "power": "pow", "trunc": "truncate", "random": "rand", "ln": "log", "bitwise_and": "bit_and", "bitwise_or": "bit_or", "bitwise_xor": "bit_xor", "bitwise_not": "bit_not",
    "ucase": "upper", "lcase": "lower", "len": "length", "char_length": "length", "character_length": "length", "substr": "substring", "mid": "substring", "position": "locate", "regex": "regexp", "regexp_like": "regexp", "char": "chr",
    "dayofmonth": "day", "dow": "dayofweek", "doy": "dayofyear", "week": "weekofyear", "current_timestamp": "now", "current_date": "curdate", "current_time": "curtime", "adddate": "date_add", "subdate": "date_sub",
    "toint": "int", "tolong": "long", "tofloat": "float", "todouble": "double", "tostring": "string", "tobool": "bool", "nvl": "ifnull", "sha2": "sha256", "base64encode": "base64", "unbase64": "base64decode",
    "is_json": "json_valid", "json_array_length": "json_length", "json_remove": "json_delete", "json_pretty": "json_format", "json_minify": "json_compact", "current_user": "user",
}
#: Functions that look at the written value of an argument, not only at its column.
RAW = frozenset("round truncate rand log substring left right concat_ws replace repeat locate instr split regexp regexp_replace regexp_extract like lpad rpad date_add date_sub timestampdiff convert_tz date_format str_to_date time_format cast convert try_cast case sha256".split()) | jsonfn.RAW | ip.RAW

FUNCTIONS: dict[str, Callable] = {name.lower(): f for group in CATEGORIES.values() for name, f in group.items()}


def resolve(name: str) -> str:
    low = name.lower()
    return ALIASES.get(low, low)


def call(name: str, args: list) -> Column:
    """name(args) as a Column; args are Columns or Literals."""
    key = resolve(name)
    if key not in FUNCTIONS:
        raise ValueError(f"unknown function {name}")
    given = list(args) if key in RAW else [col(a) for a in args]
    if key in RAW:
        first = key in ("concat_ws", "locate", "timestampdiff", "case", "json_object", "json_array", "cidrcontains")
        given = given if first or not given else [col(given[0]), *given[1:]]
        if key in ("locate", "timestampdiff") and len(given) > 1:
            given = [given[0], *(col(a) if i < (1 if key == "locate" else 2) else a for i, a in enumerate(given[1:]))]
    try:
        return FUNCTIONS[key](*given)
    except TypeError as e:
        raise ValueError(f"{name}: {e}") from e
