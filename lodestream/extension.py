"""What a caller may plug in: signals, recipes of features, transformers and inferers of posteriors, plain functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions.frames import Keyed

#: What a signal adds to every bar: booleans.
SIGNALS = ("entry_long", "exit_long", "entry_short", "exit_short")


class Signal(Protocol):
    """Adds the columns SIGNALS to bars; it may look at a bar and those before it."""

    def generate(self, bars: DataFrame) -> DataFrame: ...


class Transformer(Protocol):
    """Changes a column of posteriors; the result is on the simplex again."""

    def transform(self, df: DataFrame, probs: str) -> DataFrame: ...


class Inferer(Protocol):
    """Draws what a consumer needs from a column of posteriors."""

    def infer(self, df: DataFrame, probs: str) -> DataFrame: ...

    def metadata(self) -> dict[str, Any]: ...


def infer(df: DataFrame, probs: str, transformers: Iterable[Transformer], inferer: Inferer) -> DataFrame:
    """Posteriors through every transformer in turn and then the inferer."""
    for t in transformers:
        df = t.transform(df, probs)
    return inferer.infer(df, probs)


def generated(bars: DataFrame, signal: Signal) -> DataFrame:
    """bars with the signal's columns, null as false; ValueError if it lacks one or loses a column of bars."""
    found = signal.generate(bars)
    if missing := [c for c in (*bars.columns, *SIGNALS) if c not in found.columns]:
        raise ValueError(f"{type(signal).__name__} gives no {', '.join(missing)}")
    return found.select(*bars.columns, *[F.coalesce(F.col(c).cast("boolean"), F.lit(False)).alias(c) for c in SIGNALS])


def held_side(k: Keyed) -> Column:
    """The side, 1, -1 or 0, that signals leave at the end of a bar: that of the last entry, until an exit of it; _row numbers the bars.

    Of a bar's signals the entry counts, long before short; an exit counts only
    for the side that is held, and is looked for after the entry's bar.
    """
    entry = F.when(F.col("entry_long"), 1).when(F.col("entry_short"), -1)
    last = lambda x: F.last(x, ignorenulls=True).over(k.so_far)
    entered, at = last(entry), F.max(F.when(entry.isNotNull(), F.col("_row"))).over(k.so_far)
    left = lambda c: F.max(F.when(F.col(c), F.col("_row"))).over(k.so_far)
    gone = F.when(entered > 0, left("exit_long")).otherwise(left("exit_short"))
    return F.when(entered.isNull() | F.coalesce(gone > at, F.lit(False)), 0).otherwise(entered)


def with_positions(signals: DataFrame, keyed: Keyed | None = None) -> DataFrame:
    """signals with position, as held_side has it."""
    k = keyed or Keyed()
    return signals.withColumn("_row", k.number()).withColumn("position", held_side(k)).drop("_row")


class CrossingMeans:
    """Long from when the fast mean rises above the slow one until it falls below, and short the other way round."""

    def __init__(self, fast: int, slow: int, column: str = "close", keyed: Keyed | None = None) -> None:
        self.fast, self.slow, self.column, self.keyed = fast, slow, column, keyed or Keyed()

    def generate(self, bars: DataFrame) -> DataFrame:
        k = self.keyed
        gap = F.signum(k.avg(self.column, self.fast) - k.avg(self.column, self.slow))
        found = bars.withColumn("_gap", gap).withColumn("_was", k.lag("_gap"))
        up, down = (F.col("_gap") > 0) & (F.col("_was") <= 0), (F.col("_gap") < 0) & (F.col("_was") >= 0)
        return found.withColumns({"entry_long": up, "exit_long": down, "entry_short": down, "exit_short": up}).drop("_gap", "_was")


def engineered(bars: DataFrame, fn: Callable[[DataFrame], DataFrame], keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """What a caller's function makes of bars, checked: the keys are there, and there is something beside them."""
    found = fn(bars)
    if missing := [c for c in keys if c not in found.columns]:
        raise ValueError(f"{getattr(fn, '__name__', 'the function')} loses {', '.join(missing)}")
    if len(found.columns) == len(keys):
        raise ValueError(f"{getattr(fn, '__name__', 'the function')} makes no feature")
    return found


@dataclass(frozen=True)
class Recipe:
    """A feature: the columns that it is made from, other recipes among them, and how."""

    name: str
    needs: tuple[str, ...]
    make: Callable[[Keyed], Column]
    kind: str = "feature"
    horizon: int = 1


class Registry:
    """Recipes by name. Views of it are registries too, so that filters can follow each other."""

    def __init__(self, recipes: Iterable[Recipe] = ()) -> None:
        self._recipes: dict[str, Recipe] = {}
        for r in recipes:
            self.add(r)

    def add(self, recipe: Recipe) -> None:
        if recipe.name in self._recipes:
            raise ValueError(f"there is a recipe {recipe.name} already")
        self._recipes[recipe.name] = recipe

    def __len__(self) -> int:
        return len(self._recipes)

    def __getitem__(self, name: str) -> Recipe:
        return self._recipes[name]

    def names(self) -> list[str]:
        return list(self._recipes)

    def where(self, condition: Callable[[Recipe], bool]) -> Registry:
        return Registry(r for r in self._recipes.values() if condition(r))

    def of_kind(self, kind: str) -> Registry:
        return self.where(lambda r: r.kind == kind)

    def from_only(self, *columns: str) -> Registry:
        """Recipes that need these columns alone, directly or through others."""
        return self.where(lambda r: self.sources(r.name) <= set(columns))

    def sources(self, name: str) -> set[str]:
        """The table's columns that a recipe needs in the end."""
        out: set[str] = set()
        for n in self._recipes[name].needs:
            out |= self.sources(n) if n in self._recipes else {n}
        return out

    def stages(self, names: Sequence[str]) -> list[list[str]]:
        """The recipes to make, those that others need first; ValueError for a circle."""
        depth: dict[str, int] = {}

        def place(name: str, under: tuple[str, ...]) -> int:
            if name in under:
                raise ValueError(f"recipes need each other: {' -> '.join([*under, name])}")
            if name not in depth:
                depth[name] = 1 + max((place(n, (*under, name)) for n in self._recipes[name].needs if n in self._recipes), default=-1)
            return depth[name]

        for n in names:
            place(n, ())
        return [[n for n, d in depth.items() if d == i] for i in range(max(depth.values(), default=-1) + 1)]

    def build(self, df: DataFrame, names: Sequence[str], keyed: Keyed | None = None) -> DataFrame:
        """df with the named features; what they need on the way is dropped again. A column that df has already is taken as it is."""
        k = keyed or Keyed()
        out = df
        for stage in self.stages([n for n in names if n not in df.columns]):
            out = out.select("*", *[self._recipes[n].make(k).alias(n) for n in stage if n not in df.columns])
        return out.select(*df.columns, *[n for n in names if n not in df.columns])
