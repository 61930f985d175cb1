"""The Column functions of this package as SQL text: the same builders, run on expressions that write themselves down."""

from __future__ import annotations

import inspect
import itertools
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from rampart.functions import fuzzy, match, screen, text


def quote(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sql(value: object) -> str:
    if isinstance(value, Sql):
        return value.sql
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return quote(value)
    return f"{value}D" if isinstance(value, float) else str(value)


def _binary(sign: str, swapped: bool = False) -> Callable:
    def of(self: Sql, other: object) -> Sql:
        a, b = (_sql(other), self.sql) if swapped else (self.sql, _sql(other))
        return Sql(f"({a} {sign} {b})")

    return of


class Sql:
    """An expression as text, with the operators of a Column."""

    __hash__ = None

    def __init__(self, sql: str, name: str | None = None, cases: str | None = None) -> None:
        self.sql, self.name, self.cases = sql, name, cases

    __add__, __sub__, __mul__, __truediv__, __mod__ = map(_binary, ("+", "-", "*", "/", "%"))
    __radd__, __rsub__, __rmul__ = (_binary(x, True) for x in ("+", "-", "*"))
    __eq__, __ne__, __lt__, __le__, __gt__, __ge__ = map(_binary, ("=", "<>", "<", "<=", ">", ">="))
    __and__, __or__ = map(_binary, ("AND", "OR"))

    def __invert__(self) -> Sql:
        return Sql(f"(NOT {self.sql})")

    def __neg__(self) -> Sql:
        return Sql(f"(- {self.sql})")

    def __getitem__(self, field: str) -> Sql:
        return Sql(f"{self.sql}.`{field}`")

    def alias(self, name: str) -> Sql:
        return Sql(self.sql, name)

    def cast(self, kind: str) -> Sql:
        return Sql(f"CAST({self.sql} AS {kind})")

    def rlike(self, regex: object) -> Sql:
        return Sql(f"rlike({self.sql}, {_sql(regex)})")

    def between(self, low: object, high: object) -> Sql:
        return Sql(f"({self.sql} BETWEEN {_sql(low)} AND {_sql(high)})")

    def isNull(self) -> Sql:  # noqa: N802
        return Sql(f"({self.sql} IS NULL)")

    def isNotNull(self) -> Sql:  # noqa: N802
        return Sql(f"({self.sql} IS NOT NULL)")

    def when(self, condition: Sql, value: object) -> Sql:
        cases = f"{self.cases} WHEN {condition.sql} THEN {_sql(value)}"
        return Sql(f"({cases} END)", cases=cases)

    def otherwise(self, value: object) -> Sql:
        return Sql(f"({self.cases} ELSE {_sql(value)} END)")


class Functions:
    """Stands for ``pyspark.sql.functions``."""

    def __init__(self) -> None:
        self._numbers = itertools.count()

    def _call(self, name: str, *args: object) -> Sql:
        return Sql(f"{name}({', '.join(self._lambda(a) if callable(a) else _sql(a) for a in args)})")

    def _lambda(self, f: Callable) -> str:
        names = [f"v{next(self._numbers)}" for _ in inspect.signature(f).parameters]
        head = names[0] if len(names) == 1 else f"({', '.join(names)})"
        return f"{head} -> {_sql(f(*map(Sql, names)))}"

    def lit(self, value: object) -> Sql:
        return value if isinstance(value, Sql) else Sql(_sql(value))

    def col(self, name: str) -> Sql:
        return Sql(f"`{name}`")

    def expr(self, sql: str) -> Sql:
        return Sql(sql)

    def when(self, condition: Sql, value: object) -> Sql:
        return Sql("", cases="CASE").when(condition, value)

    def struct(self, *fields: Sql) -> Sql:
        return Sql("named_struct(" + ", ".join(f"{quote(f.name)}, {f.sql}" for f in fields) + ")")

    def size(self, value: Sql) -> Sql:
        return self._call("size", value)

    def create_map(self, *pairs: Sql) -> Sql:
        return self._call("map", *pairs)

    def __getattr__(self, name: str) -> Callable:
        return lambda *args: self._call(name, *args)


_lock = threading.Lock()


@contextmanager
def _written() -> Iterator[None]:
    """Meanwhile the builders write SQL."""
    modules, shim = (text, match, fuzzy, screen), Functions()
    with _lock:
        kept = [m.F for m in modules]
        try:
            for m in modules:
                m.F = shim
            yield
        finally:
            for m, f in zip(modules, kept, strict=True):
                m.F = f


def written(build: Callable, *parameters: str) -> str:
    """SQL text of what ``build`` makes of the parameters."""
    with _written():
        return build(*map(Sql, parameters)).sql
