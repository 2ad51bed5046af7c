"""Numbers that no Spark type holds, as arrays of whole limbs (the smallest first), in built-in functions only.

The last limb has the sign, the others lie in [0, base).  Two bases are used: 10**18 for counts of any size, and 2**24 for sums of
doubles, which are whole multiples of 2**-1074.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"
TEN18, BITS24 = 10**18, 1 << 24
#: A sum of 2**39 doubles has no more limbs of 24 bits: exponents from -1074 to 1023, and the carries.
REAL_LIMBS = 91


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def carried(sums: Column, base: int) -> Column:
    """Limbs in their ranges from sums of limbs (array<decimal(38,0)> or of whole numbers), as many as there are."""
    start = F.struct(F.lit(0).cast(WIDE).alias("carry"), F.array().cast("array<bigint>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        total = (a["carry"] + s.cast(WIDE)).cast(WIDE)
        limb = F.pmod(total, F.lit(base).cast(WIDE)).cast(WIDE)
        return F.struct(((total - limb) / F.lit(base).cast("decimal(19,0)")).cast(WIDE).alias("carry"), F.array_append(a["out"], limb.cast("bigint")).alias("out"))

    def whole(all_: Column) -> Column:
        done = F.aggregate(F.slice(all_, F.lit(1), F.size(all_) - 1), start, step)
        return let(done, lambda d: F.array_append(d["out"], (d["carry"] + F.element_at(all_, -1).cast(WIDE)).cast("bigint")))

    return let(sums, whole)


def negated(limbs: Column, base: int) -> Column:
    return carried(F.transform(limbs, lambda x: -x), base)


def magnitude(limbs: Column, base: int) -> Column:
    return F.when(F.element_at(limbs, -1) < 0, negated(limbs, base)).otherwise(limbs)


def summed(limbs: str, n: int, base: int) -> Column:
    """Aggregate: the sum of a column of limbs."""
    return carried(_sums(f"get({limbs}, {k})" for k in range(n)), base)


def _sums(terms: Iterable[str]) -> Column:
    """Aggregate: an array of sums (as text, since so many calls to build it would take seconds)."""
    return F.expr("array(" + ", ".join(f"cast(coalesce(sum(cast({t} as decimal(19,0))), 0) as {WIDE})" for t in terms) + ")")


# --- whole numbers, base 10**18


def limbs_needed(most: int) -> int:
    return len(str(most)) // 18 + 2


def whole_limbs(value: Column, n: int) -> Column:
    """Of a decimal or bigint column."""
    zero = F.lit(0).cast(WIDE)
    return carried(F.array(value.cast(WIDE), *[zero] * (n - 1)), TEN18)


def constant_limbs(value: int, n: int) -> Column:
    out = []
    for _ in range(n - 1):
        value, limb = divmod(value, TEN18)
        out.append(limb)
    return F.array(*(F.lit(x).cast("bigint") for x in [*out, value]))


def extended(limbs: Column, n: int) -> Column:
    """The same number in n limbs, as many as it has or more."""
    return carried(F.concat(F.transform(limbs, lambda x: x.cast(WIDE)), F.array_repeat(F.lit(0).cast(WIDE), F.greatest(F.lit(0), F.lit(n) - F.size(limbs)))), TEN18)


def whole_product(a: Column, b: Column, n: int) -> Column:
    """Of numbers in n limbs each whose product needs no more."""
    term = lambda x, y, i, j: (F.get(x, F.lit(i)).cast("decimal(19,0)") * F.get(y, F.lit(j)).cast("decimal(19,0)")).cast(WIDE)

    def of(x: Column, y: Column) -> Column:
        parts = []
        for k in range(n):
            total = F.lit(0).cast(WIDE)
            for i in range(k + 1):
                total = (total + term(x, y, i, k - i)).cast(WIDE)
            parts.append(total)
        return carried(F.array(*parts), TEN18)

    size = let(magnitude(a, TEN18), lambda x: let(magnitude(b, TEN18), lambda y: of(x, y)))
    return F.when((F.element_at(a, -1) < 0) != (F.element_at(b, -1) < 0), let(size, lambda s: negated(s, TEN18))).otherwise(size)


def whole_text(limbs: Column) -> Column:
    """Decimal digits, with a minus sign below 0."""
    digits = lambda m: F.regexp_replace(F.array_join(F.reverse(F.transform(m, lambda x: F.lpad(x.cast("string"), 18, "0"))), ""), "^0+(?=.)", "")
    return F.concat(F.when(F.element_at(limbs, -1) < 0, F.lit("-")).otherwise(F.lit("")), let(magnitude(limbs, TEN18), digits))


def whole_double(limbs: Column) -> Column:
    """The nearest double, or one beside it."""
    return whole_text(limbs).cast("double")


# --- sums of doubles, base 2**24, in units of 2**-1074


def windowed(x: Column) -> list[Column]:
    """k, p0, p1, p2, p3 of a double: it is the sum of p[i] * 2**(24 * (k + i) - 1074); NULL for zeros and what isn't finite.  All have the sign of x."""
    size = F.abs(x)
    finite = (size > 0) & (size < float("inf"))
    k = F.when(finite, F.greatest(F.lit(0), F.floor((F.floor(F.log2(size)) + 1021) / 24))).cast("int")
    half = F.pow(F.lit(2.0), (537 - 12 * k).cast("double"))  # in two steps, as 2**1074 is no double
    rest = size * half * half
    out = []
    for i in (3, 2, 1, 0):
        part = F.floor(rest / float(1 << 24 * i)).cast("bigint")
        out.append(part)
        rest = rest - part.cast("double") * float(1 << 24 * i)
    return [k, *(F.when(x < 0, -p).otherwise(p) for p in reversed(out))]


def window_sums(k: str, parts: list[str], n: int = REAL_LIMBS) -> Column:
    """Aggregate: limbs of the sum of rows of windowed() columns."""
    case = lambda j: f"case {k} " + " ".join(f"when {j - i} then {p}" for i, p in enumerate(parts)) + " end"
    return carried(_sums(case(j) for j in range(n)), BITS24)


def real_limbs(x: Column, n: int = REAL_LIMBS) -> Column:
    """Limbs of one double (0 for what isn't finite)."""

    def of(w: Column) -> Column:
        k, parts = w["k"], [w[f"p{i}"] for i in range(4)]
        put = lambda _, j: F.coalesce(F.when(j == k, parts[0]).when(j == k + 1, parts[1]).when(j == k + 2, parts[2]).when(j == k + 3, parts[3]), F.lit(0)).cast(WIDE)
        return carried(F.transform(F.array_repeat(F.lit(0), n), put), BITS24)

    return let(x, lambda v: let(F.struct(*(c.alias(a) for c, a in zip(windowed(v), ["k", "p0", "p1", "p2", "p3"]))), of))


def real_sum(a: Column, b: Column) -> Column:
    return carried(F.zip_with(a, b, lambda x, y: (x.cast(WIDE) + y.cast(WIDE)).cast(WIDE)), BITS24)


def real_double(limbs: Column) -> Column:
    """The nearest double: the four highest limbs, and a last bit for what lies below them."""

    def of(m: Column) -> Column:
        top = F.greatest(F.coalesce(F.array_max(F.transform(m, lambda x, i: F.when(x != 0, i))), F.lit(0)), F.lit(3))

        def rounded(p: Column) -> Column:
            at = lambda back: F.get(m, p - back)
            below = F.exists(F.slice(m, F.lit(1), p - 3), lambda x: x != 0)
            low = at(2) * BITS24 + at(3)
            low = low + F.when(below & (low % 2 == 0), 1).otherwise(0)
            value = (at(0) * BITS24 + at(1)).cast("double") * float(1 << 48) + low.cast("double")
            half = F.pow(F.lit(2.0), (12 * (p - 3) - 537).cast("double"))
            return value * half * half

        return let(top, rounded)

    return F.when(F.element_at(limbs, -1) < 0, -let(negated(limbs, BITS24), of)).otherwise(let(limbs, of))
