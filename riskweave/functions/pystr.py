"""Python string semantics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters for which Python's str.isspace() is true.
PY_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Java's White_Space property lacks the four separators Python counts as space.
_JAVA_SPACE = r"\s\x1c-\x1f"


def java_regex(pattern: str, ignore_case: bool = True) -> str:
    """A Python ``re`` pattern as a Java one with the same meaning on str.

    Unicode classes on (U), ``\\n`` the only line end (d), and ``\\s`` widened to
    what Python takes as space, with and without an enclosing character class.
    """
    out, in_class, i = [], False, 0
    while i < len(pattern):
        pair = pattern[i : i + 2]
        if pair == r"\s":
            out.append(_JAVA_SPACE if in_class else f"[{_JAVA_SPACE}]")
            i += 2
        elif pair[0] == "\\":
            out.append(pair)
            i += 2
        else:
            in_class = pair[0] == "[" or (in_class and pair[0] != "]")
            out.append(pair[0])
            i += 1
    return ("(?idU)" if ignore_case else "(?dU)") + "".join(out)


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def py_strip(col: Column) -> Column:
    """``str.strip()``."""
    return F.btrim(col, F.lit(PY_SPACE))


def ignore_case_contains(text: Column, literals) -> Column:
    """Whether any lower-case ASCII literal may occur in the text in any case.

    A cheap test ahead of a case-insensitive pattern.  Lower-casing leaves the letters that fold
    onto s and i alone, so texts that hold one pass when a literal needs it.
    """
    out = F.lit(False)
    folded = F.lower(text)
    for word in literals:
        out = out | F.contains(folded, F.lit(word))
    for letter, others in (("s", "\u017f"), ("i", "\u0130\u0131")):
        if any(letter in word for word in literals):
            for other in others:
                out = out | F.contains(text, F.lit(other))
    return out


def split_lines(col: Column) -> Column:
    """``text.split('\\n')``: an empty text is one empty line."""
    return F.split(col, "\n", -1)


def bind(col: Column, body) -> Column:
    """``body(x)`` with ``x`` evaluated once, however often ``body`` names it."""
    return F.get(F.transform(F.array(col), body), F.lit(0))


def literal_map(values: dict, key: Column, default) -> Column:
    """A fixed dictionary lookup as one CASE expression."""
    out = None
    for name, value in values.items():
        out = F.when(key == name, value) if out is None else out.when(key == name, value)
    return out.otherwise(default)


def hash_bits(seed, salt: str, *cols) -> Column:
    """A 32-bit unsigned hash of (seed, salt, columns) that any SQL engine with md5 can repeat."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(salt), *[F.col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_unit(seed, salt: str, *cols) -> Column:
    """The hash as a fraction in [0, 1)."""
    return hash_bits(seed, salt, *cols) / F.lit(float(2**32))


def py_fixed(col: Column, digits: int) -> Column:
    """``f"{x:.{digits}f}"``: nearest decimal to the exact binary value, ties to even.

    Java's own formatter rounds the shortest decimal text half up, which differs on
    values such as 6.55.  The residual against the tie is taken without error by
    splitting the double in two halves.
    """
    scale = 10.0**digits
    x = F.abs(col.cast("double"))
    below = F.floor(x * scale).cast("double")
    odd = below * 2 + 1
    tie = odd / (2 * scale)
    split = tie * F.lit(134217729.0)
    high = split - (split - tie)
    residual = (high * (2 * scale) - odd) + (tie - high) * (2 * scale)
    up = (x > tie) | (
        (x == tie) & ((residual > 0) | ((residual == 0) & (F.pmod(below, F.lit(2.0)) == 1)))
    )
    nearest = (below + F.when(up, 1.0).otherwise(0.0)) / scale
    sign = F.when(col < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    value = F.when(x >= 1e14, x).otherwise(nearest) * sign
    return F.format_string(f"%.{digits}f", value)
