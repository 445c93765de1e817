"""A lexer for brace languages. Sources are read as Latin-1, so that places are byte offsets."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

IDENT = r"[A-Za-z_$\x80-\xff][\w$\x80-\xff]*"
GO = re.compile(
    rf"(?P<space>[ \t\r]+)|(?P<line>\n)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>\"(?:\\.|[^\"\\\n])*\"?|`[^`]*`?|'(?:\\.|[^'\\\n])*'?)"
    rf"|(?P<ident>{IDENT})|(?P<number>\d[\w.]*)|(?P<op>:=|\.\.\.|[^\w\s])",
    re.S,
)
JS = re.compile(
    rf"(?P<space>[ \t\r]+)|(?P<line>\n)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?)"
    rf"|(?P<regex>(?<=[(,=:\[!&|?{{}};\n])\s*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*)"
    rf"|(?P<ident>#?{IDENT})|(?P<number>\d[\w.]*)|(?P<op>=>|\.\.\.|[^\w\s])",
    re.S,
)


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    end: int
    line: int


def lex(source: bytes, pattern: re.Pattern) -> list[Token]:
    return list(tokens(source, pattern))


def tokens(source: bytes, pattern: re.Pattern) -> Iterator[Token]:
    """Tokens without white space and comments; line breaks stay."""
    text, place, line = source.decode("latin-1"), 0, 1
    while place < len(text):
        m = pattern.match(text, place)
        if m is None or m.end() == place:
            place += 1
            continue
        kind = m.lastgroup
        if kind not in ("space", "comment"):
            yield Token(kind, m[0], m.start(), m.end(), line)
        line += m[0].count("\n")
        place = m.end()


def name_of(token: Token) -> str:
    return token.text.encode("latin-1").decode("utf-8", "replace")


PAIRS = {"(": ")", "[": "]", "{": "}"}


def matching(tokens: list[Token], at: int) -> int:
    """Place of the bracket that closes the one at ``at``; the last token if none does."""
    stack = []
    for i in range(at, len(tokens)):
        t = tokens[i]
        if t.kind == "op":
            if t.text in PAIRS:
                stack.append(PAIRS[t.text])
            elif stack and t.text == stack[-1]:
                stack.pop()
                if not stack:
                    return i
    return len(tokens) - 1
