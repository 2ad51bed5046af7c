"""Monotonic transforms of a regular axis: forward as a Column, forward and inverse on the driver."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


@dataclass(frozen=True)
class Transform:
    """Pass-through; the base of the others."""

    name: str = "id"

    def column(self, x: Column) -> Column:
        return x

    def forward(self, x: float) -> float:
        return x

    def inverse(self, y: float) -> float:
        return y

    def back_column(self, y: Column) -> Column | None:
        """inverse() as a Column; None if only the driver knows it."""
        return y if type(self) is Transform else None

    def to_json(self) -> dict:
        return {"name": self.name}


@dataclass(frozen=True)
class Log(Transform):
    """Zero maps to -inf (underflow), negative values to NaN (overflow)."""

    name: str = "log"

    def column(self, x: Column) -> Column:
        return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(-INF)).otherwise(F.lit(NAN))

    def forward(self, x: float) -> float:
        return math.log(x) if x > 0 else -INF if x == 0 else NAN

    def inverse(self, y: float) -> float:
        return math.exp(y)

    def back_column(self, y: Column) -> Column:
        return F.exp(y)


@dataclass(frozen=True)
class Sqrt(Transform):
    """Negative values map to NaN (overflow)."""

    name: str = "sqrt"

    def column(self, x: Column) -> Column:
        return F.sqrt(x)

    def forward(self, x: float) -> float:
        return math.sqrt(x) if x >= 0 else NAN

    def inverse(self, y: float) -> float:
        return y * y

    def back_column(self, y: Column) -> Column:
        return y * y


@dataclass(frozen=True)
class Pow(Transform):
    name: str = "pow"
    power: float = 1.0

    def column(self, x: Column) -> Column:
        return F.pow(x, F.lit(float(self.power)))

    def forward(self, x: float) -> float:
        try:
            y = math.pow(x, self.power)
        except ValueError:
            return NAN if x else INF
        return y

    def inverse(self, y: float) -> float:
        try:
            return math.pow(y, 1.0 / self.power)
        except ValueError:
            return NAN

    def back_column(self, y: Column) -> Column:
        return F.pow(y, F.lit(1.0 / self.power))

    def to_json(self) -> dict:
        return {"name": self.name, "power": self.power}


@dataclass(frozen=True)
class UserTransform(Transform):
    """Caller's own pair: `on_column` for rows, `to` and `back` for edges."""

    name: str = "user"
    on_column: Callable[[Column], Column] | None = None
    to: Callable[[float], float] | None = None
    back: Callable[[float], float] | None = None

    def column(self, x: Column) -> Column:
        return self.on_column(x)

    def forward(self, x: float) -> float:
        return self.to(x)

    def inverse(self, y: float) -> float:
        return self.back(y)

    def to_json(self) -> dict:
        raise TypeError("a user transform can't be stored")


def transform_from_json(d: dict) -> Transform:
    return {"id": Transform, "log": Log, "sqrt": Sqrt}[d["name"]]() if d["name"] != "pow" else Pow(power=d["power"])
