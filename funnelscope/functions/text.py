"""Text column functions with Python's white-space, line and title-case rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from funnelscope import fixed_values as fv


def let(value: Column, use) -> Column:
    """Evaluate ``value`` once per row and hand it to ``use`` as a bound variable."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(fv.PY_SPACES))


def rstrip(c: Column, chars: str = fv.PY_SPACES) -> Column:
    return F.rtrim(c, F.lit(chars))


def collapse(c: Column) -> Column:
    """Every run of white space becomes one space, ends trimmed."""
    return strip(F.regexp_replace(c, rf"(?U){fv.PY_SPACE_CLASS}+", " "))


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def unix_lines(c: Column) -> Column:
    """All line boundaries as ``\\n``; the boundary at the very end is dropped.

    Most texts hold only ``\\n``; a plain search finds that out far faster than replacing would.
    """
    def unify(v):
        return F.when(v.rlike(fv.OTHER_LINE_BREAKS), F.regexp_replace(v, fv.LINE_BREAKS, "\n")).otherwise(v)

    def drop_last(v):
        return F.when(v.endswith("\n"), F.left(v, F.length(v) - 1)).otherwise(v)
    return let(let(c, unify), drop_last)


def lines(c: Column) -> Column:
    return let(c, lambda v: F.when(v == "", F.array().cast("array<string>")).otherwise(F.split(unix_lines(v), "\n")))


def title_case(c: Column) -> Column:
    """Capital after every non-letter, so ``acme-co`` gives ``Acme-Co``."""
    pieces = F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.initcap(p)), "")


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def join_natural(items: Column) -> Column:
    """Distinct items in first-seen order as ``a, b and c``; null for an empty array."""
    def spell(d):
        n = F.size(d)
        return (F.when(n == 0, F.lit(None).cast("string"))
                 .when(n == 1, F.element_at(d, 1))
                 .otherwise(F.concat(F.array_join(F.slice(d, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "),
                                     F.lit(" and "), F.try_element_at(d, F.lit(-1)))))
    return let(F.array_distinct(items), spell)


def fill(template: str, **parts: Column) -> Column:
    """A phrase with ``{name}`` slots filled by columns (null parts count as empty)."""
    out, rest = [], template
    while rest:
        i = rest.find("{")
        if i < 0:
            out.append(F.lit(rest))
            break
        j = rest.index("}", i)
        if i:
            out.append(F.lit(rest[:i]))
        out.append(F.coalesce(parts[rest[i + 1:j]], F.lit("")))
        rest = rest[j + 1:]
    return F.concat(*out)


def or_else(c: Column, default: str) -> Column:
    """``default`` where the text is null or empty."""
    return F.when(F.length(c) > 0, c).otherwise(F.lit(default))


def py_slice(c: Column, start: Column, end: Column) -> Column:
    """``c[start:end]`` for zero-based positions; negative ones count from the end."""
    n = F.length(c)
    a = F.when(start < 0, F.greatest(n + start, F.lit(0))).otherwise(F.least(start, n))
    b = F.when(end < 0, F.greatest(n + end, F.lit(0))).otherwise(F.least(end, n))
    return F.substring(c, a + 1, F.greatest(b - a, F.lit(0)))


def find(c: Column, needle: str) -> Column:
    """Zero-based position of ``needle`` or -1."""
    return F.locate(needle, c) - 1
