"""JSON functions over text columns.  Setting, deleting and pretty-printing keep key order and need Python."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def path_of(path: str) -> str:
    """"a.b[0]" or "$.a.b[0]" as a JSON path."""
    return path if path.startswith("$") else f"$.{path}" if not path.startswith("[") else f"${path}"


def _path(arg) -> str:
    from .scalar import value_of

    return path_of(str(value_of(arg, "a JSON path")))


def extract(x, path):
    return F.get_json_object(x, _path(path))


def extract_scalar(x, path):
    found = extract(x, path)
    return F.when(~F.ltrim(found).rlike(r"^[\[{]"), found)


def json_type(x):
    name = F.schema_of_variant(F.try_parse_json(x))
    return F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(name == "VOID", "null").when(name.isNotNull(), "number")


def _steps(path: str) -> list[str | int]:
    return [int(i) if i else k for k, i in re.findall(r"([^.\[\]$]+)|\[(\d+)\]", path)]


def _edit(text, path: str, change) -> str | None:
    try:
        root = json.loads(text)
        at, steps = root, _steps(path)
        for step in steps[:-1]:
            if isinstance(at, dict) and step not in at and change.__name__ == "put":
                at[step] = {}
            at = at[step]
        change(at, steps[-1])
        return json.dumps(root, ensure_ascii=False, separators=(",", ":"))
    except (ValueError, TypeError, KeyError, IndexError):
        return text if text is not None and change.__name__ == "drop" else None


def json_set(x, path, value):
    from .scalar import Literal, col

    where = _path(path)

    @F.pandas_udf("string")
    def run(texts: pd.Series, values: pd.Series) -> pd.Series:
        def one(text, value):
            def put(at, step):
                if isinstance(at, list) and step == len(at):
                    at.append(None)
                at[step] = json.loads(value)

            return _edit(text, where, put)

        return pd.Series([one(t, v) for t, v in zip(texts, values, strict=True)], dtype=object)

    return run(x, F.lit(json.dumps(value.value)) if isinstance(value, Literal) else F.substring_index(F.regexp_replace(F.to_json(F.struct(col(value).alias("v"))), r"^\{\"v\":(.*)\}$", "$1"), "\u0000", 1))


def json_delete(x, path):
    where = _path(path)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def drop(at, step):
            del at[step]

        return pd.Series([_edit(t, where, drop) for t in texts], dtype=object)

    return run(x)


def json_format(x):
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                return json.dumps(json.loads(text), indent=2, ensure_ascii=False)
            except (ValueError, TypeError):
                return None

        return pd.Series([one(t) for t in texts], dtype=object)

    return run(x)


def json_object(*args):
    from .scalar import col, value_of

    if len(args) % 2:
        raise ValueError("json_object takes pairs of key and value")
    return F.to_json(F.struct(*(col(v).alias(str(value_of(k, "a key"))) for k, v in zip(args[::2], args[1::2], strict=True))), {"ignoreNullFields": "false"})


def json_array(*args) -> Column:
    """Values of different types stay what they are."""
    from .scalar import col

    parts = [F.coalesce(F.regexp_replace(F.to_json(F.struct(col(a).alias("v"))), r"^\{\"v\":([\s\S]*)\}$", "$1"), F.lit("null")) for a in args]
    return F.concat(F.lit("["), F.concat_ws(",", *(F.when(p == "{}", "null").otherwise(p) for p in parts)), F.lit("]"))


FUNCTIONS = {
    "json_extract": extract, "json_extract_scalar": extract_scalar, "json_valid": lambda x: F.try_parse_json(x).isNotNull(), "json_keys": F.json_object_keys,
    "json_values": lambda x: F.map_values(F.from_json(x, "map<string,string>")), "json_length": lambda x: F.coalesce(F.json_array_length(x), F.size(F.json_object_keys(x))), "json_array": json_array, "json_object": json_object, "json_type": json_type,
    "json_set": json_set, "json_delete": json_delete, "json_array_contains": lambda x, v: F.array_contains(F.from_json(x, "array<string>"), v.cast("string")),
    "json_array_append": lambda x, v: F.concat(F.regexp_replace(F.rtrim(x), r"\s*\]$", ""), F.when(F.json_array_length(x) > 0, ",").otherwise(""), F.regexp_replace(F.to_json(F.struct(v.alias("v"))), r"^\{\"v\":([\s\S]*)\}$", "$1"), F.lit("]")),
    "json_format": json_format, "json_compact": lambda x: F.to_json(F.try_parse_json(x)),
}
RAW = frozenset(["json_extract", "json_extract_scalar", "json_set", "json_delete", "json_object", "json_array"])
