"""Globs as regular expressions for rlike."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_GLOB = re.compile(r"[*?\[{]")


def to_regex(glob: str) -> str:
    """** crosses folders, * and ? don't, [..] is a class, {a,b} are alternatives; dot files match. Nested braces and extended globs are refused."""
    if re.search(r"[@!+?*]\(", glob) or glob.startswith("!"):
        raise ValueError(f"unsupported glob: {glob}")
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            if glob.startswith("**", i):
                if glob.startswith("**/", i):
                    out, i = out + "(?:[^/]+/)*", i + 3
                else:
                    out, i = out + ".*", i + 2
                continue
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = end
        elif c == "{":
            depth += 1
            out += "(?:"
        elif c == "}" and depth:
            depth -= 1
            out += ")"
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    if depth:
        raise ValueError(f"unclosed brace: {glob}")
    return out


def patterns_regex(patterns: Iterable[str]) -> str | None:
    """One anchored expression for a list of patterns: ./ is dropped, a trailing / means everything below, and a pattern without wildcards also means everything below it. None for an empty list, which matches nothing."""
    parts = []
    for p in patterns:
        p = p.removeprefix("./")
        if p.endswith("/"):
            p += "**"
        body = to_regex(p)
        parts.append(body if _GLOB.search(p) else f"{body}(?:/.*)?")
    return f"^(?s:{'|'.join(parts)})$" if parts else None


def glob_match(path: Column, patterns: Iterable[str]) -> Column:
    regex = patterns_regex(patterns)
    return F.coalesce(path.rlike(regex), F.lit(False)) if regex else F.lit(False)
