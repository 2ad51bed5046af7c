"""A binned table as text: columns of text for any size; for small ones, which are collected, a list of cells or bars for one axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.binned import Binned


def _number(v) -> str:
    """A whole number with all its digits, a double with at most six."""
    return f"{v:g}" if isinstance(v, float) else f"{v:d}" if isinstance(v, int) else str(v)


def _show(row: dict) -> str:
    if set(row) == {"value"}:
        return _number(row["value"])
    return "(" + ", ".join(f"{k}={_number(v)}" for k, v in row.items()) + ")"


MOST = 100_000


def _few(h: Binned) -> list:
    if h.size > MOST:
        raise OverflowError(f"{h.size} cells are too many for one text; use cells_text")
    return h.ordered(h.table(dense=True)).collect()


def shown(c: Column) -> Column:
    """A number with at most six digits, as a column of text."""
    six = F.format_string("%.6g", c.cast("double"))
    plain = F.regexp_replace(F.regexp_replace(six, r"(\.\d*?)0+(?=$|e)", "$1"), r"\.(?=$|e)", "")
    return F.when(c.isNull(), "none").when(F.isnan(c.cast("double")), "nan").when(F.abs(c.cast("double")) == float("inf"), F.when(c > 0, "inf").otherwise("-inf")).otherwise(plain)


#: What an accumulator's text lists, by its name.
PARTS = {
    "weighted_sum": ["value", "variance"], "mean": ["count", "value", "variance"], "weighted_mean": ["sum_of_weights", "value", "variance"], "fraction": ["successes", "failures"],
}


def cells_text(h: Binned, coverage: str = "all") -> DataFrame:
    """Bin numbers, bins ("[1, 2)" or a value; "other" outside) and cells ("mean(3, 1.5, 0.25)", a count as its number) as text columns, for tables of any size."""
    out, name = h.indexed(coverage), h.accumulator.name
    bins = []
    for k, a in enumerate(h.axes):
        text = F.concat(F.lit("["), shown(F.col(f"lower{k}")), F.lit(", "), shown(F.col(f"upper{k}")), F.lit(")")) if a.continuous else F.coalesce(F.col(f"bin{k}"), F.lit("other"))
        bins.append(text.alias(f"bin{k}"))
    if name == "sum":
        cell = F.concat(F.lit("sum("), shown(F.col("large")), F.lit(" + "), shown(F.col("small")), F.lit(")"))
    elif name == "collector":
        cell = F.concat(F.lit("collector{"), F.array_join(F.transform("items", shown), ", "), F.lit("}"))
    elif name == "largecount":
        cell = F.col("digits")
    elif name in ("count", "bigcount") and not h.accumulator.real:
        cell = F.col("value").cast("string")
    elif name == "count":
        cell = shown(F.col("value"))
    else:
        cell = F.concat(F.lit(f"{name}("), F.concat_ws(", ", *(shown(F.col(c)) for c in PARTS.get(name, h.accumulator.read()))), F.lit(")"))
    return out.select(*h.keys, *bins, cell.alias("cell"))


def table(h: Binned) -> str:
    """Axes, then one entry per cell, the first axis fastest."""
    rows = _few(h)
    lines = ["binned("] + [f"  {a!r}," for a in h.axes]
    lines += ["  (" + " ".join(f"{r[k]:2d}" for k in h.keys) + "): " + _show({k: v for k, v in r.asDict().items() if k not in h.keys}) for r in rows]
    return "\n".join([*lines, ")"])


def bars(h: Binned, width: int = 78, ascii_only: bool = False) -> str:
    """One line per bin of a binned table of one axis: range, value, bar."""
    if h.rank != 1:
        raise ValueError("bars need exactly one axis")
    a = h.axes[0]
    rows = _few(h)

    def label(i: int) -> str:
        if not a.continuous:
            return str(a.value(i)) if 0 <= i < a.size else "other"
        b = a.bin(i)
        return f"[{b.lower:6.4g}, {b.upper:6.4g})"

    labels, values = [label(r["i0"]) for r in rows], [float(r["value"]) for r in rows]
    left, shown = max(map(len, labels)), [r["digits"] if "digits" in r else _number(r["value"]) for r in rows]
    right = max(map(len, shown))
    room = max(8, width - left - right - 4)
    lo, hi = min(0.0, *values), max(0.0, *values)
    unit = (hi - lo) / room or 1.0
    eighths = " ▏▎▍▌▋▊▉"
    out = [repr(h)]
    for name, text, v in zip(labels, shown, values):
        before = round(-lo / unit) if v >= 0 else round((v - lo) / unit)
        size = abs(v) / unit
        bar = "=" * round(size) if ascii_only else "█" * int(size) + eighths[int(size % 1 * 8)].strip()
        out.append(f"{name:<{left}} {text:>{right}} |" + " " * before + bar)
    return "\n".join(out)
