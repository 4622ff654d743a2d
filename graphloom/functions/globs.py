"""Ignore globs as Columns (FP11): gitignore rules over paths."""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(lines: Iterable[str]) -> list[tuple[str, bool]]:
    """``(regex, negated)`` of every rule, in order; blank lines and comments
    are none. The regex matches the path of a file, or of a folder with a slash
    at its end."""
    rules = []
    for line in lines:
        text = re.sub(r"(?<!\\)[ \t\r\n]+$", "", line)
        if not text or text.startswith("#"):
            continue
        negated = text.startswith("!")
        body = translated(text[1:] if negated else text)
        if body is not None:
            rules.append((body, negated))
    return rules


def translated(glob: str) -> str | None:
    """Regex of one glob without its ``!``.

    A slash at the start or inside binds the glob to the root; one at the end
    asks for a folder. ``*`` and ``?`` stay inside a name, ``**`` as a whole
    name stands for any number of them.
    """
    folder = glob.endswith("/")
    names = glob.strip("/").split("/") if glob.strip("/") else []
    if not names:
        return None
    bound = "/" in glob.rstrip("/")
    out = "^" if bound or names[0] == "**" else "(?:^|/)"
    for k, name in enumerate(names):
        last = k == len(names) - 1
        if name == "**":
            out += ".+" if last else "(?:.+/)?"
        else:
            out += _name(name) + ("" if last else "/")
    return out + ("/$" if folder else "/?$")


def _name(glob: str) -> str:
    out, k = "" if glob.strip("*") else "(?=[^/])", 0  # a name is never empty
    while k < len(glob):
        c = glob[k]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\" and k + 1 < len(glob):
            k += 1
            out += _plain(glob[k])
        elif c == "[" and (close := glob.find("]", k + 2)) > 0:
            inside = glob[k + 1:close]
            invert = inside[0] in "!^"
            chars = "".join(x if x == "-" or x.isalnum() else "\\" + x for x in inside[invert:])
            out += f"(?!/)[{'^' if invert else ''}{chars}]"
            k = close
        else:
            out += _plain(c)
        k += 1
    return out


def _plain(c: str) -> str:
    return c if c.isalnum() or c in "_-" or ord(c) > 127 else "\\" + c


def ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """Whether a file is ignored: the last matching rule decides, and nothing
    below an ignored folder comes back. Case does not count. Neighbouring rules
    of one kind become one pattern."""
    runs = [("(?i)(?:" + "|".join(r for r, _ in some) + ")", negated) for negated, some in
            ((n, list(g)) for n, g in groupby(rules, key=lambda r: r[1]))]

    def verdict(p: Column) -> Column:
        out = F.when(F.lit(False), F.lit(False))
        for regex, negated in reversed(runs):
            out = out.when(p.rlike(regex), F.lit(not negated))
        return out.otherwise(False)

    names = F.split(path, "/")
    above = F.transform(F.slice(names, 1, F.size(names) - 1), lambda _, k: F.concat(
        F.array_join(F.slice(names, F.lit(1), k + 1), "/"), F.lit("/")))
    return F.exists(above, verdict) | verdict(path)
