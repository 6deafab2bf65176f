"""Arithmetic replies solved as native expressions (op 40).

The model's reply is arithmetic over numbers with ``+ - * / // %``, power (``^`` or ``**``), signs,
brackets of any depth and the functions of ``FUNCTIONS``, among them ``sum(range(a[, b[, c]]))``; or ``NA``. Rules are
those of the usual calculator language: power binds tightest, to the right, and tighter than a sign on its
left (-2**2 is -4); ``//`` and ``%`` round down; ``round`` goes to the even neighbour. There is no ``eval`` and no interpreter: patterns cut a
chain into terms, factors and powers, and array functions fold them in the JVM.

A fold over the number of brackets solves one innermost bracket (with its function) at a time and puts its value back as a
number (``n`` marks a negative one, so that (-2)**2 keeps its sign inside). Brackets and functions need an operator beside
them: 2(3) is no expression. What is none, divides by zero or leaves the range of doubles
gives a null result and an error, never a failed job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settings
from .text import let as _let

NUM = r"n?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?"
POWERS = rf"{NUM}(?:\^[-+]*{NUM})*"
FACTOR = rf"[-+]*{POWERS}"
CHAIN = rf"{FACTOR}(?:[-+*/%~]{FACTOR})*"
WHOLE = rf"^{CHAIN}$"
FUNCTIONS = ("abs", "max", "min", "pow", "range", "round", "sqrt", "sum")
CALL = rf"\b(?:{'|'.join(FUNCTIONS)})\("
#: A function or nothing, and a bracket without brackets inside.
INNERMOST = r"([a-z]*)\(([^()]*)\)"
#: A value right beside a bracket or a function: nothing says how they combine.
BARE_NEIGHBOURS = r"[\d.)][(a-z]|\)[\d.]"
RANGE = r"^r([^:]*):([^:]*):([^:]*)$"   # what range(...) leaves for sum(...)
BROKEN = "!"
SUM_RANGE = r"^sum\(range\((-?\d+),(-?\d+)\)\)$"
#: Digits of a bound up to which the sum is exact in decimals; larger ones are summed as doubles.
EXACT_DIGITS = 18


def _number(c: Column) -> Column:
    return F.replace(c, F.lit("n"), F.lit("-")).try_cast("double")


def _sign(signs: Column) -> Column:
    """1 or -1 for a run of sign characters."""
    minus = F.length(signs) - F.length(F.replace(signs, F.lit("-"), F.lit("")))
    return F.when(minus % 2 == 1, F.lit(-1.0)).otherwise(F.lit(1.0))


def _finite(c: Column) -> Column:
    """Null for NaN and infinities: their difference from themselves is NaN, which is no number equal to zero."""
    return _let(c, lambda v: F.when((v - v) == 0, v))


def _factor(c: Column) -> Column:
    """Signs, then a power chain: ``-a^-b`` is -(a^(-b))."""
    return _sign(F.regexp_extract(c, "^[-+]*", 0)) * F.aggregate(
        F.reverse(F.split(F.regexp_replace(c, "^[-+]*", ""), r"\^")), F.lit(None).cast("double"),
        lambda acc, p: _let(_sign(F.regexp_extract(p, "^[-+]*", 0)) * _number(F.regexp_replace(p, "^[-+]*", "")),
                            lambda base: F.when(acc.isNull(), base).otherwise(_finite(F.pow(F.abs(base), acc) * _odd(base, acc)))))


def _odd(base: Column, exponent: Column) -> Column:
    """Sign of a power: that of an odd whole power of a negative base; null for a broken power of one."""
    return F.when(base >= 0, F.lit(1.0)).when(exponent % 2 == 0, F.lit(1.0)).when(F.abs(exponent % 2) == 1, F.lit(-1.0))


def _modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor, exact as long as both are."""
    return _let(F.try_mod(a, b), lambda m: F.when((m != 0) & ((m < 0) != (b < 0)), m + b).otherwise(m))


def _term(c: Column) -> Column:
    """``* / % ~`` (``~`` is whole division) folded from the left."""
    parts = F.regexp_extract_all(F.concat(F.lit("*"), c), F.lit(rf"[*/%~]{FACTOR}"), 0)

    def step(acc: Column, part: Column) -> Column:
        op = F.substring(part, 1, 1)
        return _let(_factor(F.substring(part, F.lit(2), F.length(part))), lambda v: _finite(
            F.when(op == "*", acc * v).when(op == "/", F.try_divide(acc, v)).when(op == "~", F.rint(F.try_divide(acc - _modulo(acc, v), v)))
            .otherwise(_modulo(acc, v))))

    return F.aggregate(parts, F.lit(1.0), step)


def _chain(c: Column) -> Column:
    """Terms added up from the left; null if ``c`` is no chain."""
    # a sign that follows a number separates terms and counts for its whole term; any other belongs to its factor
    cut = F.split(F.regexp_replace(c, rf"({NUM})([-+])", "$1\n$2"), "\n")
    values = F.transform(cut, lambda t, i: F.when(i == 0, _term(t)).otherwise(
        _sign(F.substring(t, 1, 1)) * _term(F.substring(t, F.lit(2), F.length(t)))))
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(c.rlike(WHOLE), total)


def _text(v: Column) -> Column:
    """A value as a number inside a larger expression."""
    return F.concat(F.when(v < 0, F.lit("n")).otherwise(F.lit("")), F.abs(v).cast("string"))


def _whole(v: Column) -> Column:
    return F.when(v == F.floor(v), v)


def _range_sum(text: Column) -> Column:
    """Sum of a range in closed form: no sequence is materialised."""
    low, high, by = (F.regexp_extract(text, RANGE, i).try_cast("double") for i in (1, 2, 3))
    return F.when(text.rlike(RANGE), _let(F.greatest(F.ceil((high - low) / F.nullif(by, F.lit(0.0))).cast("double"), F.lit(0.0)),
                                          lambda n: n * low + by * n * (n - 1) / 2))


def _call(name: Column, inner: Column) -> Column:
    """Text that a bracket leaves: its value as a number, or ``BROKEN``."""
    def solved(v: Column) -> Column:
        n, first, second = F.size(v), F.get(v, 0), F.get(v, 1)
        scale = F.pow(F.lit(10.0), second)
        bounds = F.when(n == 1, F.array(F.lit(0.0), first, F.lit(1.0))).when(n == 2, F.array(first, second, F.lit(1.0))).when(n == 3, v)
        ranged = _let(F.transform(bounds, _whole), lambda r: F.when(
            F.get(r, 2) != 0, F.concat(F.lit("r"), F.array_join(F.transform(r, lambda x: x.cast("string")), ":"))))
        value = (F.when((name == "") & (n == 1), first)
                 .when((name == "abs") & (n == 1), F.abs(first))
                 .when((name == "sqrt") & (n == 1), F.when(first >= 0, F.sqrt(first)))
                 .when((name == "pow") & (n == 2), F.pow(F.abs(first), second) * _odd(first, second))
                 .when((name == "round") & (n == 1), F.bround(first, 0))
                 .when((name == "round") & (n == 2) & (second == F.floor(second)), F.bround(first * scale, 0) / scale)
                 .when((name == "min") & (n > 1), F.array_min(v))
                 .when((name == "max") & (n > 1), F.array_max(v)))
        return F.when(F.exists(v, lambda x: x.isNull()), F.lit(BROKEN)).when(name == "range", F.coalesce(ranged, F.lit(BROKEN))) \
            .otherwise(F.coalesce(_text(_finite(value)), F.lit(BROKEN)))

    return F.when(name == "sum", F.coalesce(_text(_finite(_range_sum(inner))), F.lit(BROKEN))) \
        .otherwise(_let(F.transform(F.split(inner, ","), _chain), solved))


def _without_brackets(e: Column) -> Column:
    """One innermost bracket after the other replaced by its value."""
    def step(acc: Column, _: Column) -> Column:
        return _let(F.regexp_extract(acc, INNERMOST, 0), lambda found: F.when(found == "", F.lit(BROKEN)).otherwise(F.concat(
            F.substring(acc, F.lit(1), F.instr(acc, found) - 1),
            _call(F.regexp_extract(found, INNERMOST, 1), F.regexp_extract(found, INNERMOST, 2)),
            F.substring(acc, F.instr(acc, found) + F.length(found), F.length(acc)))))

    brackets = F.length(e) - F.length(F.replace(e, F.lit("("), F.lit("")))
    return F.when(brackets == 0, e).otherwise(F.aggregate(F.sequence(F.lit(1), brackets), e, step))


def solve(df: DataFrame, col: str = "expression") -> DataFrame:
    """Add ``result`` (double) and ``error`` for an expression column."""
    c = F.col(col)
    spaced = F.when(~c.rlike(r"[\w.]\s+[\w.]"), F.regexp_replace(c, r"\s+", ""))       # "3 4" is no number
    powers = F.replace(F.replace(spaced, F.lit("**"), F.lit("^")), F.lit("//"), F.lit("~"))
    # exponents get a capital, so that small letters are functions only
    plain = F.regexp_replace(F.regexp_replace(powers, r"(?<![a-z\d])(\d+\.?\d*|\.\d+)e(?=[-+]?\d)", "$1E"), r"\bmath\.(?=sqrt)", "")
    letters = F.regexp_replace(plain, CALL, "(").rlike("[a-z]")
    x = df.withColumn("_e", F.when(~letters & ~plain.rlike(BARE_NEIGHBOURS), plain))
    e = F.col("_e")
    lo, hi = F.regexp_extract("_e", SUM_RANGE, 1), F.regexp_extract("_e", SUM_RANGE, 2)
    small = (F.length(lo) <= EXACT_DIGITS) & (F.length(hi) <= EXACT_DIGITS)

    def total(kind: str) -> Column:
        a, b = lo.try_cast(kind), hi.try_cast(kind)
        # closed form of lo + (lo+1) + ... + (hi-1): no sequence is materialised
        return F.when(b > a, (b - a) * (a + b - 1) / 2).otherwise(F.lit(0)).cast("double")

    summed = F.when(small, total("decimal(19,0)")).otherwise(_finite(total("double")))
    x = x.withColumn("_flat", F.when(~e.rlike(SUM_RANGE), _without_brackets(e)))
    # adding up may leave the range of doubles too
    x = x.withColumn("result", F.when(F.startswith(c, F.lit("NA")), F.lit(None).cast("double"))
                     .when(e.rlike(SUM_RANGE), summed).otherwise(_finite(_chain(F.col("_flat")))))
    x = x.withColumn("error", F.when(F.startswith(c, F.lit("NA")), F.lit(settings.NO_MATH))
                     .when(F.col("result").isNull(), F.lit("Cannot evaluate expression")))
    return x.drop("_e", "_flat")
