"""User-defined functions: versions, typed parameters, metadata and call statistics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

_TYPES = {"string": str, "int": int, "long": int, "float": float, "double": float, "bool": bool, "boolean": bool}
CATEGORIES = ("filter", "scorer", "aggregator", "scalar")


@dataclass
class Parameter:
    name: str
    type: str = "string"
    required: bool = False
    default: object = None

    def check(self, value):
        kind = _TYPES.get(self.type)
        if kind is None:
            raise ValueError(f"unknown type {self.type!r} of {self.name}")
        if kind is float and isinstance(value, int) and not isinstance(value, bool):
            value = float(value)
        if not isinstance(value, kind) or (isinstance(value, bool) and kind is not bool):
            raise ValueError(f"{self.name} is a {self.type}")
        return value


@dataclass
class Function:
    """build gets the columns as keyword arguments by name, and the parameters; it gives a Column.

    A builder made of Spark's own functions stays in the JVM; one that wraps a pandas UDF is
    Arrow-batched.
    """

    name: str
    version: str
    build: Callable[..., Column]
    columns: tuple[str, ...] = ()
    parameters: tuple[Parameter, ...] = ()
    category: str = "filter"
    author: str = ""
    tags: tuple[str, ...] = ()
    description: str = ""
    calls: int = field(default=0, compare=False)

    def arguments(self, given: dict) -> dict:
        known = {p.name: p for p in self.parameters}
        if extra := set(given) - set(known):
            raise ValueError(f"{self.name} has no parameter {sorted(extra)[0]!r}")
        out = {}
        for name, p in known.items():
            if name in given:
                out[name] = p.check(given[name])
            elif p.required:
                raise ValueError(f"{self.name} needs {name!r}")
            else:
                out[name] = p.default
        return out


def _version_key(version: str) -> tuple:
    return tuple(int(p) if p.isdigit() else -1 for p in version.split("."))


class Registry:
    def __init__(self) -> None:
        self._functions: dict[tuple[str, str], Function] = {}

    def register(self, function: Function) -> None:
        key = (function.name, function.version)
        if not function.name or not function.version:
            raise ValueError("a function has a name and a version")
        if function.category not in CATEGORIES:
            raise ValueError(f"unknown category {function.category!r}")
        if key in self._functions:
            raise ValueError(f"{function.name} {function.version} is registered already")
        self._functions[key] = function

    def unregister(self, name: str, version: str) -> None:
        if self._functions.pop((name, version), None) is None:
            raise KeyError(f"{name} {version}")

    def versions(self, name: str) -> list[str]:
        return sorted((v for n, v in self._functions if n == name), key=_version_key)

    def has(self, name: str) -> bool:
        return any(n == name for n, _ in self._functions)

    def get(self, name: str, version: str | None = None) -> Function:
        """The given version, or the latest."""
        version = version or (self.versions(name) or [None])[-1]
        if (name, version) not in self._functions:
            raise KeyError(f"no function {name!r} {version or ''}".rstrip())
        return self._functions[name, version]

    def list(self) -> list[Function]:
        return [self._functions[k] for k in sorted(self._functions)]

    def query(self, name: str | None = None, category: str | None = None, author: str | None = None, tags: tuple[str, ...] = ()) -> list[Function]:
        return [f for f in self.list() if (name is None or name in f.name) and (category is None or f.category == category) and (author is None or f.author == author) and set(tags) <= set(f.tags)]

    def column(self, name: str, version: str | None = None, parameters: dict | None = None) -> Column:
        """The function over the columns that it names."""
        f = self.get(name, version)
        f.calls += 1
        return f.build(**{c: F.col(c) for c in f.columns}, **f.arguments(parameters or {}))

    def apply(self, name: str, args: list[Column]) -> Column:
        """The latest version over columns given by place; parameters have their defaults."""
        f = self.get(name)
        if len(args) != len(f.columns):
            raise ValueError(f"{name} takes {len(f.columns)} columns")
        f.calls += 1
        return f.build(**dict(zip(f.columns, args, strict=True)), **f.arguments({}))

    def stats(self) -> dict[str, int]:
        return {f"{f.name}@{f.version}": f.calls for f in self.list()}


def text_distance(text: str, name: str = "text_distance") -> Function:
    """Texts within an edit distance of a target."""
    return Function(name, "1.0.0", lambda target, most, **c: F.levenshtein(c[text], F.lit(target), most) >= 0, (text,), (Parameter("target", "string", True), Parameter("most", "int", False, 2)), tags=("text",))


def haversine(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    """Kilometres on a sphere of the earth's mean radius."""
    a, b = F.radians(lat), F.radians(lon)
    a0, b0 = F.radians(F.lit(lat0)), F.radians(F.lit(lon0))
    h = F.pow(F.sin((a - a0) / 2), 2) + F.cos(a) * F.cos(a0) * F.pow(F.sin((b - b0) / 2), 2)
    return F.lit(2 * 6371.0) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def geo_filter(lat: str, lon: str, name: str = "geo_filter") -> Function:
    return Function(name, "1.0.0", lambda latitude, longitude, kilometres, **c: haversine(c[lat], c[lon], latitude, longitude) <= kilometres, (lat, lon), tuple(Parameter(p, "double", True) for p in ("latitude", "longitude", "kilometres")), tags=("geo",))


def score_boost(score: str = "_score", name: str = "score_boost") -> Function:
    return Function(name, "1.0.0", lambda boost, least, **c: c[score] * boost >= least, (score,), (Parameter("boost", "double", False, 1.0), Parameter("least", "double", False, 0.0)), "scorer")
