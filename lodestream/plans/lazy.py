"""Column expressions that are written down before there is a Spark session.

Columns need a running session, the SQL beside them does not. A Lazy notes down
calls, attributes and operators; real() carries them out.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import wraps
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestream.functions.frames import over


class Lazy:
    def __init__(self, make: Callable[[], Any]) -> None:
        self._make = make

    def __call__(self, *args: Any, **named: Any) -> Lazy:
        return Lazy(lambda: self._make()(*map(real, args), **{k: real(v) for k, v in named.items()}))

    def __getattr__(self, name: str) -> Lazy:
        return Lazy(lambda: getattr(self._make(), name))

    def __getitem__(self, at: Any) -> Lazy:
        return Lazy(lambda: self._make()[real(at)])

    def __iter__(self):
        raise TypeError("not known before there is a session")

    __hash__ = object.__hash__


def _both(f: Callable) -> Callable:
    return lambda self, other: Lazy(lambda: f(real(self), real(other)))


def _turned(f: Callable) -> Callable:
    return lambda self, other: Lazy(lambda: f(real(other), real(self)))


def _divided(a: Any, b: Any) -> Any:
    """a / b; of columns as the SQL beside them has it, see frames.over."""
    return over(*[x if isinstance(x, Column) else F.lit(x) for x in (a, b)]) if isinstance(a, Column) or isinstance(b, Column) else a / b


for _name in ("add", "sub", "mul", "pow", "mod", "and", "or"):
    _f = getattr(operator, _name + "_" if _name in ("and", "or") else _name)
    setattr(Lazy, f"__{_name}__", _both(_f))
    setattr(Lazy, f"__r{_name}__", _turned(_f))
Lazy.__truediv__, Lazy.__rtruediv__ = _both(_divided), _turned(_divided)
for _name in ("eq", "ne", "lt", "le", "gt", "ge"):
    setattr(Lazy, f"__{_name}__", _both(getattr(operator, _name)))
for _name in ("neg", "invert"):
    setattr(Lazy, f"__{_name}__", (lambda f: lambda self: Lazy(lambda: f(real(self))))(getattr(operator, _name)))


def held(value: Any) -> Lazy:
    return Lazy(lambda: value)


def real(x: Any) -> Any:
    """What a Lazy stands for, in lists too; functions are given Lazy arguments and give real results."""
    if isinstance(x, Lazy):
        return x._make()
    if isinstance(x, (list, tuple)):
        return type(x)(map(real, x))
    if callable(x) and getattr(x, "__name__", "") == "<lambda>":
        return wraps(x)(lambda *args: real(x(*map(held, args))))
    return x
