"""Column expressions over paths, patterns, durations and rates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_relpath(path: Column, root: str) -> Column:
    """B2: the part of ``path`` below ``root`` with forward slashes; null where nothing is left or it lies elsewhere."""
    base = root.replace("\\", "/").rstrip("/") + "/"
    whole = F.replace(path, F.lit("\\"), F.lit("/"))
    rest = F.substring(whole, len(base) + 1, 1 << 30)
    return F.when(whole.startswith(base) & (rest != ""), rest)


def dest_key(prefix: Column | str, relpath: Column) -> Column:
    """B3: ``relpath`` under ``prefix``; empty, ``.`` and ``..`` segments go, so a key cannot leave the prefix."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    kept = F.array_join(F.filter(F.split(relpath, "/"), lambda s: ~s.isin("", ".", "..")), "/")
    head = F.regexp_replace(prefix, "^/+|/+$", "")
    return F.when(head == "", kept).when(kept == "", head).otherwise(F.concat(head, F.lit("/"), kept))


def glob_regex(pattern: str) -> str:
    """One anchored regular expression for a glob. A star also crosses slashes; ``**/`` in front may match nothing."""
    out, i, depth = "", 0, 0
    if pattern.startswith("**/"):
        out, i = "(?:.*/)?", 3
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("/**/", i):
            out, i = out + "/(?:.*/)?", i + 4
            continue
        if c == "*":
            while i + 1 < len(pattern) and pattern[i + 1] == "*":
                i += 1
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[":
            end = pattern.find("]", i + (3 if pattern[i + 1 : i + 2] in ("!", "^") else 2))
            if end < 0:
                raise ValueError(f"unclosed class in {pattern!r}")
            body = pattern[i + 1 : end]
            negated = body[:1] in ("!", "^")
            out += f"[{'^' * negated}{re.sub(r'([\\\[\]&^])', r'\\\1', body[negated:])}]"
            i = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += re.escape(c)
        i += 1
    if depth:
        raise ValueError(f"unclosed alternatives in {pattern!r}")
    return out


def globs(path: Column, patterns: list[str]) -> Column:
    """Whether any of the patterns matches the whole path."""
    if not patterns:
        return F.lit(False)
    return path.rlike("(?s)^(?:" + "|".join(glob_regex(p) for p in patterns) + ")$")


def selected(path: Column, include: list[str], exclude: list[str]) -> Column:
    """B1: not excluded, and included or nothing asked for."""
    wanted = globs(path, include) if include else F.lit(True)
    return wanted & ~globs(path, exclude)


def selection_regex(include: list[str], exclude: list[str]) -> str:
    """B1 as one regular expression for a whole path: not excluded, and included or nothing asked for."""
    never = "(?!(?:" + "|".join(glob_regex(p) for p in exclude) + ")$)" if exclude else ""
    return f"(?s)^{never}(?:" + ("|".join(glob_regex(p) for p in include) if include else ".*") + ")$"


def matches(path: Column, regex: Column) -> Column:
    """Whether a path matches the expression in a column, which is compiled when it differs from the row's before."""
    return F.regexp_instr(path, regex) > 0


def split_name(path: Column) -> tuple[Column, Column, Column]:
    """(folder with its slash, stem, extension with its dot); a leading dot begins no extension."""
    return (F.regexp_extract(path, "^((?:.*/)?)([^/]*)$", 1), F.regexp_extract(path, r"^(?:.*/)?(.[^/]*?|[^/]?)(\.[^./]*)?$", 1), F.regexp_extract(path, r"^(?:.*/)?(.[^/]*?|[^/]?)(\.[^./]*)?$", 2))


def duration_ms(text: Column) -> Column:
    """K1: '7d', '15m', '1.5h', '500ms' or a bare number as milliseconds; null where it is none of these."""
    s = F.lower(F.trim(text))
    number, unit = F.regexp_extract(s, r"^([0-9]+\.?[0-9]*|\.[0-9]+)\s*(ms|s|m|h|d)?$", 1), F.regexp_extract(s, r"^([0-9]+\.?[0-9]*|\.[0-9]+)\s*(ms|s|m|h|d)?$", 2)
    times = F.when(unit == "s", 1_000).when(unit == "m", 60_000).when(unit == "h", 3_600_000).when(unit == "d", 86_400_000).otherwise(1)
    return F.when(number != "", F.floor(F.expr("try_cast(0 as double)") + number.try_cast("double") * times + 0.5).cast("long"))


def byte_rate(text: Column) -> Column:
    """K1: '20MB/s', '1Gbps', '1MiB', '512' as bytes per second; null where it is none of these."""
    pattern = r"^([0-9]+\.?[0-9]*|\.[0-9]+)\s*(ki|mi|gi|ti|k|m|g|t)?(bps|bytes|byte|b)?\s*(/sec|/s)?$"
    s = F.lower(F.trim(text))
    number, scale, unit, per = (F.regexp_extract(s, pattern, i) for i in (1, 2, 3, 4))
    times = F.when(scale == "k", 1e3).when(scale == "m", 1e6).when(scale == "g", 1e9).when(scale == "t", 1e12).when(scale == "ki", 1024.0).when(scale == "mi", 1024.0**2).when(scale == "gi", 1024.0**3).when(scale == "ti", 1024.0**4).otherwise(1.0)
    value = number.try_cast("double") * times / F.when(unit == "bps", 8.0).otherwise(1.0)
    return F.when((number != "") & ~((unit == "bps") & (per != "")), F.floor(value + 0.5).cast("long"))
