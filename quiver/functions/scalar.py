"""Scalar and aggregate functions by lower-case name; each takes Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s ]+"


def _d(x: Column) -> Column:
    return x.cast("double")


def _text(x: Column) -> Column:
    return x.cast("string")


def _substring(s: Column, start: Column, n: Column | None = None) -> Column:
    return F.substring(s, start.cast("int") + 1, (n if n is not None else F.length(s)).cast("int"))


def _boolean(x: Column) -> Column:
    low = F.lower(_text(x))
    return F.when(low == "true", True).when(low == "false", False)


def _range(a: Column, b: Column, step: Column | None = None) -> Column:
    step = F.lit(1) if step is None else step
    a, b, step = (c.cast("long") for c in (a, b, step))
    forward = ((step > 0) & (a <= b)) | ((step < 0) & (a >= b))
    return F.when(step == 0, F.sequence(a, b + 1, step)).when(forward, F.sequence(a, b, F.when(forward, step).otherwise(F.lit(1)))).when(a.isNotNull() & b.isNotNull(), F.array().cast("array<bigint>"))


def _log(fn, x: Column) -> Column:
    """Not a number below 0, minus infinity at 0."""
    x = _d(x)
    return F.when(x < 0, F.lit(float("nan"))).when(x == 0, F.lit(float("-inf"))).otherwise(fn(x))


SCALARS = {
    "coalesce": lambda *x: F.coalesce(*x),
    "timestamp": lambda: F.unix_millis(F.current_timestamp()),
    "tofloat": lambda x: _text(x).try_cast("double"),
    "toboolean": _boolean,
    "tostring": _text,
    "exists": lambda x: x.isNotNull(),
    "tolower": F.lower, "tolowercase": F.lower, "toupper": F.upper, "touppercase": F.upper,
    "trim": lambda x: F.regexp_replace(x, f"^{_SPACE}|{_SPACE}$", ""),
    "ltrim": lambda x: F.regexp_replace(x, f"^{_SPACE}", ""),
    "rtrim": lambda x: F.regexp_replace(x, f"{_SPACE}$", ""),
    "replace": F.replace,
    "substring": _substring,
    "split": lambda s, d: F.split(s, F.concat(F.lit("\\Q"), d, F.lit("\\E"))),
    "left": F.left, "right": F.right,
    "head": lambda x: F.try_element_at(x, F.lit(1)),
    "last": lambda x: F.try_element_at(x, F.lit(-1)),
    "tail": lambda x: F.slice(x, F.lit(2), F.greatest(F.size(x), F.lit(0))),
    "range": _range,
    "abs": F.abs,
    "ceil": lambda x: F.ceil(_d(x)).cast("double"),
    "floor": lambda x: F.floor(_d(x)).cast("double"),
    "round": lambda x: F.floor(_d(x) + F.lit(0.5)).cast("double"),
    "sign": lambda x: F.sign(_d(x)).cast("int"),
    "rand": lambda: F.rand(),
    "sqrt": lambda x: F.sqrt(_d(x)), "exp": lambda x: F.exp(_d(x)), "log": lambda x: _log(F.ln, x), "log10": lambda x: _log(F.log10, x), "e": F.e,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "atan2": F.atan2, "cot": F.cot, "pi": F.pi, "degrees": F.degrees, "radians": F.radians,
}


#: Functions of numbers: of strings they take what parses, of other things null.
MATH = frozenset("abs ceil floor round sign sqrt exp log log10 sin cos tan asin acos atan atan2 cot degrees radians".split())


def _integer(x: Column) -> Column:
    s = _text(x)
    number = F.typeof(x).isin("double", "float")
    truncated = F.when(number, F.when(_d(s.try_cast("double")) >= 0, F.floor(s.try_cast("double"))).otherwise(F.ceil(s.try_cast("double"))))
    return F.when(F.typeof(x) == "boolean", F.when(s == "true", 1).otherwise(0)).when(number, truncated).when(s.rlike(r"^\s*[+-]?\d+\s*$"), s.try_cast("bigint")).cast("bigint")


SCALARS["tointeger"] = SCALARS["toint"] = _integer


def aggregate(name: str, args: list[Column], distinct: bool) -> Column:
    if name == "count":
        return F.count(F.lit(1)) if not args else F.countDistinct(args[0]) if distinct else F.count(args[0])
    x = args[0]
    if name == "sum":
        return F.coalesce((F.sum_distinct if distinct else F.sum)(_d(x)), F.lit(0.0))
    if name == "avg":
        return F.avg(_d(x)) if not distinct else F.sum_distinct(_d(x)) / F.countDistinct(x)
    if name in ("min", "max"):
        return getattr(F, name)(x)
    if name == "collect":
        return F.sort_array(F.collect_set(x)) if distinct else F.collect_list(x)
    if name == "percentilecont":
        return F.call_function("percentile", _d(x), args[1] if len(args) > 1 else F.lit(0.5))
    return F.when(F.count(x) >= 2, (F.stddev_samp if name == "stdev" else F.stddev_pop)(_d(x)))

