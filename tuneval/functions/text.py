"""Text column expressions.

Java's ``\\s`` is ASCII-only, Python's ``str.strip``/``split`` are
Unicode-aware, so every whitespace rule here uses ``(?U)`` (SURVEY T6).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c):
    return F.col(c) if isinstance(c, str) else c


# Python's whitespace set (what str.strip() removes), built by rule.
PY_WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
# the same set as a Java regex class (one or more), for splitting like str.split()
WS_RUN = "[" + "".join(f"\\u{ord(ch):04x}" for ch in PY_WHITESPACE) + "]+"


def utrim(c) -> Column:
    """B2: ``x.strip()`` (Python's whitespace set); NULL becomes ''.

    A native character trim, not a regex."""
    return F.coalesce(F.btrim(_col(c), F.lit(PY_WHITESPACE)), F.lit(""))


def rtrim_ws(c) -> Column:
    """``x.rstrip()``."""
    return F.rtrim(_col(c), F.lit(PY_WHITESPACE))


def or_empty(c) -> Column:
    """B1: missing value becomes ''."""
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def words(c) -> Column:
    """``x.split()``: tokens between runs of Python whitespace."""
    return F.filter(F.split(F.coalesce(_col(c), F.lit("")), WS_RUN), lambda t: t != "")


def word_count(c) -> Column:
    """G1: ``len(x.split())``."""
    return F.size(words(c))


def char_count(c, ch: str) -> Column:
    """occurrences of one character."""
    x = F.coalesce(_col(c), F.lit(""))
    return (F.length(x) - F.length(F.replace(x, F.lit(ch), F.lit("")))).cast("int")


def truncate(c, n: int) -> Column:
    """First n characters (``x[:n]``)."""
    return F.substring(_col(c), 1, n)


def fence_strip_prefix(c) -> Column:
    """Drop 7+3 chars around a ```json fence, 3+3 around a bare fence.

    Mirrors the reference's blind slicing: the trailing 3 characters are
    dropped even when there is no closing fence.
    """
    x = _col(c)
    n = F.length(x)
    return (F.when(x.startswith("```json"), _slice(x, 7, n - 3))
             .when(x.startswith("```"), _slice(x, 3, n - 3))
             .otherwise(x))


def _slice(x: Column, start: int, end: Column) -> Column:
    """Python ``x[start:end]`` (0-based start, exclusive end >= 0)."""
    ln = end - F.lit(start)
    return F.when(ln > 0, x.substr(F.lit(start + 1), ln.cast("int"))).otherwise(F.lit(""))


def fence_strip_regex(c) -> Column:
    """F3b (only ``\\n`` ends a line, as in Python): ``re.sub(r'^```json\\s*|```$', '', x.strip(), flags=re.M).strip()``."""
    x = utrim(c)
    return F.when(x.contains("```"), utrim(F.regexp_replace(x, r"(?mdU)^```json\s*|```$", ""))).otherwise(x)


def strip_prompt_echo(full, prompt) -> Column:
    """Remove every occurrence of the prompt, then strip."""
    return utrim(F.replace(_col(full), _col(prompt), F.lit("")))
