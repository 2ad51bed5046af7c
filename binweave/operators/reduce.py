"""Commands that make an axis smaller, and what they do to bin numbers."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from .axis import Axis


@dataclass(frozen=True)
class Command:
    """By value (lower, upper) or by number (begin, end); merge bins by `merge`.  `crop` discards what is cut off instead of moving it to the flow bins."""

    axis: int | None = None
    lower: float | None = None
    upper: float | None = None
    begin: int | None = None
    end: int | None = None
    merge: int = 1
    crop: bool = False

    @property
    def has_range(self) -> bool:
        return self.lower is not None or self.begin is not None


def _split(args: tuple, n: int) -> tuple:
    if len(args) == n:
        return None, *args
    if len(args) == n + 1:
        return args
    raise TypeError(f"expected {n} arguments, or {n + 1} with the axis first")


def shrink(*args) -> Command:
    """([axis,] lower, upper)"""
    axis, lower, upper = _split(args, 2)
    return Command(axis, lower=lower, upper=upper)


def crop(*args) -> Command:
    """([axis,] lower, upper)"""
    return replace(shrink(*args), crop=True)


def slice_(*args, crop: bool = False) -> Command:
    """([axis,] begin, end)"""
    axis, begin, end = _split(args, 2)
    if not begin < end:
        raise ValueError("a slice needs begin < end")
    return Command(axis, begin=begin, end=end, crop=crop)


def rebin(*args) -> Command:
    """([axis,] merge)"""
    axis, merge = _split(args, 1)
    if merge < 1:
        raise ValueError("merge > 0 needed")
    return Command(axis, merge=merge)


def shrink_and_rebin(*args) -> Command:
    axis, lower, upper, merge = _split(args, 3)
    return replace(shrink(axis, lower, upper), merge=rebin(merge).merge)


def crop_and_rebin(*args) -> Command:
    return replace(shrink_and_rebin(*args), crop=True)


def slice_and_rebin(*args, crop: bool = False) -> Command:
    axis, begin, end, merge = _split(args, 3)
    return replace(slice_(axis, begin, end, crop=crop), merge=rebin(merge).merge)


def normalised(commands: list[Command], rank: int) -> dict[int, Command]:
    """One command per axis: positional commands take the axes in order; a range and a rebin of one axis are fused."""
    positional = [c.axis is None for c in commands]
    if any(positional) and not all(positional):
        raise ValueError("name the axis in all commands or in none")
    if any(positional):
        if len(commands) > rank:
            raise ValueError("more commands than axes")
        commands = [replace(c, axis=i) for i, c in enumerate(commands)]
    out: dict[int, Command] = {}
    for c in commands:
        if not 0 <= c.axis < rank:
            raise ValueError(f"no axis {c.axis}")
        if (old := out.get(c.axis)) is None:
            out[c.axis] = c
            continue
        if old.has_range and c.has_range or old.merge > 1 and c.merge > 1:
            raise ValueError("an axis takes one range and one rebin")
        ranged = old if old.has_range else c
        out[c.axis] = replace(ranged, merge=max(old.merge, c.merge))
    return out


@dataclass(frozen=True)
class Plan:
    """New axis, and the map from old bin numbers (NULL: the cell goes)."""

    axis: Axis
    index: Column


def _bounds(axis: Axis, c: Command) -> tuple[int, int]:
    """Numbers of the first bin and of the one after the last; they may lie outside the axis."""
    if c.begin is not None:
        return c.begin, c.end
    if c.lower is None:
        return 0, axis.size
    if c.lower == c.upper:
        raise ValueError("the range is empty")
    end = axis.find(c.upper)
    at_edge = end <= axis.size and (axis.continuous or axis.ordered or end < axis.size) and axis.value(end) == c.upper
    return axis.find(c.lower), end if at_edge else end + 1


def plan(axis: Axis, c: Command | None, i: Column) -> Plan:
    """Cells outside the range move to the flow bins if the axis has them; a crop keeps a flow bin only where the range reaches past the axis."""
    if c is None:
        return Plan(axis, i)
    low, high = _bounds(axis, c)
    keep_low = axis.underflow and (low < 0 or not (c.crop and c.has_range))
    keep_high = axis.overflow and (high > axis.size or not (c.crop and c.has_range))
    begin, end = max(low, 0), min(high, axis.size)
    end -= (end - begin) % c.merge
    if begin >= end:
        raise ValueError("the range has no bins")
    size = (end - begin) // c.merge
    none = F.lit(None).cast("int")
    above = F.lit(size) if keep_high else none
    below = above if not axis.ordered else F.lit(-1) if keep_low else none
    inside = F.floor((i - begin) / c.merge).cast("int")
    return Plan(axis.reduced(begin, end, c.merge), F.when(i < begin, below).when(i >= end, above).otherwise(inside).cast("int"))
