"""Parameter schemas and operator chains: the declarative form of a signal plan."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Param:
    """One parameter: numbers are clamped to [low, high], integers rounded, enum values must be among ``options``."""

    name: str
    kind: str = "float"
    default: object = 0.0
    low: float = -math.inf
    high: float = math.inf
    options: tuple[str, ...] = ()

    def coerce(self, value: object) -> object:
        if self.kind == "bool":
            return bool(value)
        if self.kind == "enum":
            if value not in self.options:
                raise ValueError(f"{self.name}: {value!r} is not one of {self.options}")
            return value
        x = float(value)
        if not math.isfinite(x):
            raise ValueError(f"{self.name}: {value!r} is not finite")
        x = min(self.high, max(self.low, x))
        return math.floor(x + 0.5) if self.kind == "int" else x


#: Every operator's schema begins with these.
STANDARD = (Param("bypass", "bool", False), Param("input_gain", "float", 0.0, -36, 36), Param("output_gain", "float", 0.0, -36, 36))


@dataclass(frozen=True)
class Operator:
    """A registered operator: ``build(params) -> DataFrame transform`` and its schema."""

    kind: str
    impl: str
    build: Callable[[dict], Callable[[DataFrame], DataFrame]]
    schema: tuple[Param, ...] = ()
    weight: int = 0
    latency: Callable[[dict], int] = lambda p: 0

    def resolve(self, given: dict) -> dict:
        """Defaults filled in, values coerced; unknown names are refused."""
        params = {p.name: p for p in (*STANDARD, *self.schema)}
        if extra := set(given) - set(params):
            raise ValueError(f"{self.kind}: unknown parameters {sorted(extra)}")
        return {n: p.coerce(given.get(n, p.default)) for n, p in params.items()}


@dataclass
class Registry:
    """Operators by kind; the highest weight wins, ties go to the last registered."""

    rows: list[Operator] = field(default_factory=list)

    def register(self, op: Operator) -> None:
        self.rows.append(op)

    def kinds(self) -> list[str]:
        return sorted({o.kind for o in self.rows})

    def winner(self, kind: str, impl: str = "") -> Operator:
        found = [(o.weight, i, o) for i, o in enumerate(self.rows) if o.kind == kind and impl in ("", o.impl)]
        if not found:
            raise KeyError(f"no operator {kind}/{impl}")
        return max(found, key=lambda x: x[:2])[2]

    def chain(self, specs: list[dict]) -> Callable[[DataFrame], DataFrame]:
        """One transform for a list of {kind, impl?, params?}; bypassed stages are left out of the plan."""
        from tonaris.operators.pointwise import gain_db

        steps: list[Callable[[DataFrame], DataFrame]] = []
        for s in specs:
            op = self.winner(s["kind"], s.get("impl", ""))
            p = op.resolve(s.get("params", {}))
            if p["bypass"]:
                continue
            steps += [f for db, f in ((p["input_gain"], gain_db(p["input_gain"])), (None, op.build(p)), (p["output_gain"], gain_db(p["output_gain"]))) if db != 0.0]
        return lambda df: functools.reduce(lambda d, f: d.transform(f), steps, df)

    def latency(self, specs: list[dict]) -> int:
        ops = [(self.winner(s["kind"], s.get("impl", "")), s.get("params", {})) for s in specs]
        return sum(o.latency(o.resolve(p)) for o, p in ops if not o.resolve(p)["bypass"])


def unique_id(base: str, taken: set[str]) -> str:
    """``base``, or ``base-2``, ``base-3`` and so on if that is taken."""
    n, name = 1, base
    while name in taken:
        n += 1
        name = f"{base}-{n}"
    return name


class Stages:
    """An editable list of stages ({id, kind, impl?, params?}); ids that it hands out are never used again."""

    def __init__(self, specs: list[dict] | None = None):
        self.specs, self._given = list(specs or []), 0

    def _at(self, stage: str) -> int:
        found = [i for i, s in enumerate(self.specs) if s.get("id") == stage]
        if not found:
            raise KeyError(f"no stage {stage!r}")
        return found[0]

    def add(self, kind: str, impl: str = "", **params: object) -> str:
        """Append a stage and return its id: its implementation or kind, and a number."""
        if not kind:
            raise ValueError("a stage needs a kind")
        taken = {s.get("id") for s in self.specs}
        while True:
            self._given += 1
            stage = f"{impl or kind}-{self._given}"
            if stage not in taken:
                self.specs.append({"id": stage, "kind": kind, "impl": impl, "params": params})
                return stage

    def remove(self, stage: str) -> None:
        """Take out the first stage of this id."""
        del self.specs[self._at(stage)]

    def move(self, stage: str, to: int) -> None:
        """Put the first stage of this id at a place of the list."""
        at = self._at(stage)
        if not 0 <= to < len(self.specs):
            raise IndexError(f"no place {to} among {len(self.specs)} stages")
        self.specs.insert(to, self.specs.pop(at))
