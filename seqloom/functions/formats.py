"""Python's format strings as column expressions, so that headers of records need no Python in the tasks."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPEC = re.compile(r"(?:(?P<fill>.)?(?P<align>[<>=^]))?(?P<sign>[+\- ])?(?P<zero>0)?(?P<width>\d+)?(?P<comma>,)?(?:\.(?P<digits>\d+))?(?P<kind>[bdeEfFosxX%])?", re.S)
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def padded(text: Column, width: int, fill: str, align: str) -> Column:
    """The text with fill characters up to a width; longer texts stay whole. ``=`` puts them after the sign."""
    lacks = F.greatest(F.lit(width) - F.length(text), F.lit(0))

    def filled(n: Column) -> Column:
        return F.repeat(F.lit(fill), n.cast("int"))

    if align == "<":
        return F.concat(text, filled(lacks))
    if align == "^":
        before = F.floor(lacks / 2)
        return F.concat(filled(before), text, filled(lacks - before))
    if align == "=":
        sign = F.regexp_extract(text, r"^([+\- ]?)", 1)
        return F.concat(sign, filled(lacks), F.substr(text, F.length(sign) + 1))
    return F.concat(filled(lacks), text)


def formatted(value: Column, of: T.DataType, spec: str) -> Column:
    """What ``format(value, spec)`` gives in Python; NULL is an empty text before padding.

    Numbers are rounded by their decimal digits, halves away from zero (Python rounds their binary value, halves to even).
    """
    m = _SPEC.fullmatch(spec)
    numeric = isinstance(of, T.NumericType)
    kind = m and (m["kind"] or ("s" if not numeric else "d" if isinstance(of, _WHOLE) else "f" if m["digits"] else ""))
    if m is None or (kind == "s") == numeric or (kind in ("s", "") and m["comma"]) or (kind in "bdoxX" and kind and (m["digits"] or not isinstance(of, _WHOLE))):
        raise ValueError(f"format {spec!r} is not one of a column of type {of.simpleString()}")
    sign, comma, digits = m["sign"] or "", m["comma"] or "", m["digits"] or "6"
    if kind == "s":
        text = value.cast("string") if m["digits"] is None else F.substring(value.cast("string"), 1, int(m["digits"]))
    elif kind == "":
        text = value.cast("string")
    elif kind in "boxX":  # of the absolute value, then the sign: the JVM writes negative numbers as complements
        text = F.bin(F.abs(value)) if kind == "b" else F.format_string(f"%{kind}", F.abs(value).cast("long"))
        text = F.concat(F.when(value < 0, "-").otherwise({"+": "+", " ": " "}.get(sign, "")), text)
    elif kind == "d":
        text = F.format_string(f"%{sign.strip('-')}{comma}d", value.cast("long"))
    else:
        number = value.cast("double") * (100 if kind == "%" else 1)
        flags = f"{sign.strip('-')}{comma}"
        text = F.format_string(f"%{flags}.{digits}{'f' if kind in 'fF%' else kind}{'%%' if kind == '%' else ''}", number)
    text = F.when(value.isNull(), F.lit("")).otherwise(text)
    if m["width"] is None:
        return text
    align = m["align"] or ("=" if m["zero"] else ">" if numeric else "<")
    return padded(text, int(m["width"]), m["fill"] or ("0" if m["zero"] else " "), align)


def filled_in(template: str, df: DataFrame) -> Column:
    """The template with its fields taken from the row's columns: ``{name}``, ``{score:.2f}``, ``{name:>12}``, ``{{`` for a brace."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    pieces = []
    for text, field, spec, conversion in string.Formatter().parse(template):
        pieces.append(F.lit(text))
        if field is None:
            continue
        if field not in kinds:
            raise KeyError(f"no column {field!r}, only {list(kinds)}")
        value, of = F.col(f"`{field}`"), kinds[field]
        if conversion:
            value, of = value.cast("string"), T.StringType()
        pieces.append(formatted(value, of, spec) if spec else F.coalesce(value.cast("string"), F.lit("")))
    return F.concat(*pieces) if pieces else F.lit("")
