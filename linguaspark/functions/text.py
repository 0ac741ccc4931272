"""Scalar column helpers for the string rules the catalogs follow.

All are built-in Spark expressions (JVM side, inside whole-stage codegen).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white-space set removed by an ECMAScript-style trim
# (WhiteSpace and LineTerminator code points), written as a Java regex class.
_JS_WS = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
_JS_TRIM_RE = f"^{_JS_WS}+|{_JS_WS}+$"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_trim(c) -> Column:
    """Trim all Unicode white space at both ends (Spark's ``trim`` strips spaces only)."""
    return F.regexp_replace(col_(c), _JS_TRIM_RE, "")


def is_blank(c) -> Column:
    """True when the string is empty after a full white-space trim."""
    return js_trim(c) == F.lit("")


def falsy(c) -> Column:
    """Null or empty string: the values a truthiness test rejects."""
    c = col_(c)
    return c.isNull() | (c == F.lit(""))


def half_up_round(c) -> Column:
    """Round half toward +infinity (``floor(x + 0.5)``), unlike ``round`` which rounds half away from zero."""
    return F.floor(col_(c) + F.lit(0.5))


def base64_utf8(c) -> Column:
    """Unchunked base64 of the UTF-8 bytes (Spark chunks at 76 characters by default)."""
    return F.regexp_replace(F.base64(F.encode(col_(c), "UTF-8")), "[\\r\\n]", "")


def count_newlines(c) -> Column:
    c = col_(c)
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def json_string_literal(c) -> Column:
    """The JSON text of a string value, quotes included (``JSON.stringify``-style)."""
    return _strip_brackets(F.to_json(F.array(col_(c))))


def _strip_brackets(j: Column) -> Column:
    # to_json(array(s)) is '["..."]'; drop the surrounding brackets. Not a
    # regex: '.' would stop at line terminators such as U+0085 in the value.
    return F.substring(j, F.lit(2), F.length(j) - F.lit(2))


def integer_like(c) -> Column:
    """Array-index-like member names, which object member order puts first."""
    c = col_(c)
    return c.rlike("^(0|[1-9][0-9]{0,9})$") & (c.try_cast("bigint") < F.lit(4294967295))
