"""Scalar column functions. Everything is a built-in expression, so it stays in codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# The longest numeric prefix that a text-to-number cast of the embedded
# database accepts, and the shape of a plain unsigned number.
REAL_PREFIX = r"^\s*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)"
INTEGER_PREFIX = r"^\s*([+-]?[0-9]+)"
PLAIN_NUMBER = r"^([0-9]+\.?[0-9]*|\.[0-9]+)\z"
STRICT_INTEGER = r"^\s*[+-]?[0-9]+\s*\z"

BIGINT_MAX = 9223372036854775807
BIGINT_MIN = -9223372036854775808


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lenient_double(c: ColumnOrName) -> Column:
    """Leading number of a text as double; 0 when there is none, null for null.

    ANSI casts throw on such text, so telemetry is never cast directly.
    """
    text = _c(c).cast("string")
    number = F.regexp_extract(text, REAL_PREFIX, 1).try_cast("double")
    return F.when(text.isNotNull(), F.coalesce(number, F.lit(0.0)))


def lenient_bigint(c: ColumnOrName) -> Column:
    """Leading integer of a text as bigint; 0 when there is none, null for null.

    Integers beyond 64 bits saturate.
    """
    text = _c(c).cast("string")
    digits = F.regexp_extract(text, INTEGER_PREFIX, 1)
    beyond = (
        F.when(digits == "", F.lit(0))
        .when(digits.startswith("-"), F.lit(BIGINT_MIN))
        .otherwise(F.lit(BIGINT_MAX))
    )
    return F.when(text.isNotNull(), F.coalesce(digits.try_cast("bigint"), beyond))


def strict_int(c: ColumnOrName) -> Column:
    """Integer of a text that is nothing but an integer, else null (never throws)."""
    text = _c(c).cast("string")
    return F.when(text.rlike(STRICT_INTEGER), F.trim(text).try_cast("bigint"))


def is_plain_number(c: ColumnOrName) -> Column:
    """True for unsigned digits with at most one dot: no sign, no exponent, no boolean."""
    return _c(c).cast("string").rlike(PLAIN_NUMBER)


def dotted_part(c: ColumnOrName, n: int) -> Column:
    """n-th (1-based) segment of a dotted name, null when there are fewer."""
    return F.nullif(F.split_part(_c(c), F.lit("."), F.lit(n)), F.lit(""))


def last_part(c: ColumnOrName) -> Column:
    """Last segment of a dotted name."""
    return F.substring_index(_c(c), ".", -1)


def variant_path(*keys: str) -> str:
    """JSON path over object keys; keys are quoted, so dashes and dots in them are safe."""
    return "$" + "".join(f"['{k}']" for k in keys)


def path_get(
    v: ColumnOrName,
    paths: Sequence[str],
    default: object = None,
    as_type: str = "string",
    falsy_empty: bool = False,
) -> Column:
    """First non-null value among several paths of a VARIANT, else ``default``.

    With ``falsy_empty`` an empty text counts as absent as well.
    """
    found = [F.try_variant_get(_c(v), p, as_type) for p in paths]
    if falsy_empty:
        found = [F.nullif(f, F.lit("")) for f in found]
    if default is not None:
        found.append(F.lit(default).cast(as_type))
    return F.coalesce(*found)


def contains_any(c: ColumnOrName, needles: Sequence[str]) -> Column:
    """True when any of the texts occurs in the column, as plain substrings."""
    hit = _c(c).contains(needles[0])
    for needle in needles[1:]:
        hit = hit | _c(c).contains(needle)
    return hit


def pct_dev(x: ColumnOrName, ref: ColumnOrName) -> Column:
    """Absolute deviation of x from ref, in percent of ref, on doubles."""
    x, ref = _c(x).cast("double"), _c(ref).cast("double")
    return F.try_divide(F.abs(x - ref), ref) * F.lit(100.0)


def as_int_text(c: ColumnOrName) -> Column:
    """Number truncated to an integer, as text."""
    return _c(c).try_cast("bigint").cast("string")


def thousands(c: ColumnOrName) -> Column:
    """Number truncated to an integer, with thousands separators."""
    return F.format_number(_c(c).try_cast("bigint"), 0)


def msg(fmt: str, *cols: ColumnOrName) -> Column:
    """Message text from a printf format."""
    return F.format_string(fmt, *[_c(c) for c in cols])


def status_mark(c: ColumnOrName, style: str = "vitals") -> Column:
    """Display sign of a status; the appendix shows a warning sign for all but PASS and CRITICAL."""
    c = _c(c)
    # Display signs.
    passed, warned, critical, unknown = "✅", "⚠️", "\U0001f6a8", "❓"
    mark = F.when(c == "PASS", F.lit(passed)).when(c == "CRITICAL", F.lit(critical))
    if style == "appendix":
        return mark.otherwise(F.lit(warned))
    return mark.when(c == "WARNING", F.lit(warned)).otherwise(F.lit(unknown))
