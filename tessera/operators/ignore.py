"""Ignore rules: gitignore syntax compiled to regular expressions on the driver.

The rules of a root are few, so they become one expression that the JVM evaluates: a path is ignored if the
last rule that matches it, or a directory above it, is not negated.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    pattern: str
    negated: bool


def _glob(text: str) -> str:
    """A glob of one path segment or more as a regular expression."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if text.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif text.startswith("/**", i) and i + 3 == len(text):
            out.append("/.*")
            i += 3
        elif c == "*":
            out.append("[^/]*")
            i += 2 if text.startswith("**", i) else 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[" and (end := text.find("]", i + 2)) > 0:
            body = text[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]")
            i = end + 1
        else:
            if c == "\\" and i + 1 < len(text):
                i += 1
                c = text[i]
            out.append(re.escape(c))
            i += 1
    return "".join(out)


def parse_rules(text: str) -> list[Rule]:
    """The rules of one ignore file, in order; comments and blank lines left out."""
    rules = []
    for raw in text.splitlines():
        line = raw.rstrip() if not raw.endswith("\\ ") else raw
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else line
        line = line[1:] if line.startswith("\\") and line[1:2] in ("#", "!") else line
        directory = line.endswith("/")
        body = line.strip("/") if directory else line.lstrip("/")
        anchored = "/" in line.rstrip("/")
        head = "^" if anchored else "^(?:.*/)?"
        # a rule for a directory matches what lies below it; any other also the path itself
        rules.append(Rule(head + _glob(body) + ("/.*$" if directory else "(?:/.*)?$"), negated))
    return rules


def ignored(path: Column, rules: list[Rule]) -> Column:
    """Whether the last matching rule of a relative path ignores it."""
    verdict = F.lit(False)
    for rule in rules:
        verdict = F.when(path.rlike(rule.pattern), F.lit(not rule.negated)).otherwise(verdict)
    return verdict


TEMPLATE = """\
# Paths left out of the index, in gitignore syntax.

# generated and vendored code
dist/
build/
node_modules/
vendor/
*.min.js
*.map

# lock files and snapshots
*.lock
package-lock.json
*.snap

# data
*.csv
*.parquet
"""
