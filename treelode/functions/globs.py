"""Include and exclude globs and ignore rules, compiled on the driver into Column predicates."""
from __future__ import annotations

import glob
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def expand_braces(pattern: str) -> list[str]:
    """`a{b,c}` becomes `ab` and `ac`; nested and repeated braces work, a lone brace is literal."""
    found = re.search(r"\{([^{}]*,[^{}]*)\}", pattern)
    if not found:
        return [pattern]
    before, after = pattern[:found.start()], pattern[found.end():]
    return [p for option in found.group(1).split(",") for p in expand_braces(before + option + after)]


def glob_regex(patterns: Sequence[str], hidden: bool) -> str:
    """One case-insensitive regex for all patterns; without `hidden`, wildcards skip dot names."""
    plain = [p for pattern in patterns for p in expand_braces(pattern)]
    # The standard library ends a translation in its own end-of-text anchor.
    parts = [re.sub(r"\\[Zz]\Z", "", glob.translate(p, recursive=True, include_hidden=hidden, seps="/")) for p in plain]
    return r"(?i)\A(?:" + "|".join(parts) + r")\z"


def scan_pattern(include: str) -> str:
    """Scan pattern of an include entry. The extension test of the scan follows it."""
    if "*" in include and (".ts" in include or ".md" in include):
        return include
    base = include[:-3] if include.endswith("/**") else include[:-1] if include.endswith("/") else include
    return f"{base}/**/*"


def included(path: Column, include: Sequence[str], exclude: Sequence[str]) -> Column:
    """Matches an include entry and no exclude entry."""
    inside = path.rlike(glob_regex([scan_pattern(p) for p in include], hidden=False)) if include else F.lit(False)
    return inside & ~path.rlike(glob_regex(exclude, hidden=True)) if exclude else inside


def ignore_rules(lines: Sequence[str]) -> list[tuple[str, bool]]:
    """Ordered (regex, ignores) pairs from the lines of an ignore file.

    A regex is tested against a path in which directories end in a slash.
    """
    rules = []
    for line in lines:
        line = re.sub(r"(?<!\\)[ \t]+\Z", "", line.rstrip("\r\n"))
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else line
        line = line[1:] if line.startswith(("\\#", "\\!")) else line
        only_dirs = line.endswith("/")
        body = line.rstrip("/") if only_dirs else line
        anchored = "/" in body
        body = body.lstrip("/")
        if body:
            lead = "" if anchored else "(?:.*/)?"
            rules.append((rf"(?is)\A{lead}{_ignore_body(body)}{'/' if only_dirs else '/?'}\z", not negated))
    return rules


def _ignore_body(body: str) -> str:
    out, i = [], 0
    while i < len(body):
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
        elif body[i:] == "**" and (i == 0 or body[i - 1] == "/"):
            out.append(".+")
            i += 2
        elif body[i] == "*":
            out.append("[^/]*")
            i += 1
            while body[i:i + 1] == "*":
                i += 1
        elif body[i] == "?":
            out.append("[^/]")
            i += 1
        elif body[i] == "[" and (found := re.match(r"\[([!^]?)((?:\\.|[^\]\\/])+)\]", body[i:])):
            members = found.group(2).replace("[", r"\[").replace("&&", r"\&&")
            out.append(f"[{'^' if found.group(1) else ''}{members}]")
            i += found.end()
        else:
            if body[i] == "\\" and i + 1 < len(body):
                i += 1
            out.append(re.sub(r"([^\w/])", r"\\\1", body[i]))
            i += 1
    return "".join(out)


def ignored(path: Column, rules: Sequence[tuple[str, bool]]) -> Column:
    """Whether the path or a directory above it is ignored; in each, the last matching rule decides."""
    if not rules:
        return F.lit(False)
    runs: list[tuple[list[str], bool]] = []
    for regex, ignores in rules:  # neighbours of one kind become one regex
        if runs and runs[-1][1] == ignores:
            runs[-1][0].append(regex)
        else:
            runs.append(([regex], ignores))
    joined = [("|".join(f"(?:{r})" for r in regexes), ignores) for regexes, ignores in runs]

    def decide(prefix: Column) -> Column:
        last_first = list(reversed(joined))
        chain = F.when(prefix.rlike(last_first[0][0]), F.lit(last_first[0][1]))
        chain = reduce(lambda c, r: c.when(prefix.rlike(r[0]), F.lit(r[1])), last_first[1:], chain)
        return chain.otherwise(F.lit(False))

    parts = F.split(path, "/", -1)
    depth = F.size(parts)
    prefixes = F.transform(F.sequence(F.lit(1), depth), lambda n: F.concat(
        F.array_join(F.slice(parts, 1, n), "/"), F.when(n < depth, F.lit("/")).otherwise(F.lit(""))))
    return F.exists(prefixes, decide)
