"""Symbols of Ruby sources: classes, modules and methods, by the words that open a block and their ``end``."""

from __future__ import annotations

import re

from tessera.operators.extract.lexing import IDENT, lex, name_of
from tessera.operators.extract.rows import Extracted, Symbol

RUBY = re.compile(
    r"(?P<space>[ \t\r\f\v]+|\\\n)|(?P<comment>(?<![^\n])=begin\b.*?(?:\n=end[^\n]*|\Z)|\#[^\n]*|(?<![^\n])__END__\b.*)"
    r"|(?P<string><<[~-]?(['\"]?)([A-Z_]\w*)\4[^\n]*\n.*?\n[ \t]*\5\b|\"(?:\\.|[^\"\\])*\"?|'(?:\\.|[^'\\])*'?|`(?:\\.|[^`\\])*`?|(?<=[(,=~\s])/(?![\s=/])(?:\\.|[^/\\\n])+/[a-z]*)"
    rf"|(?P<line>\n|;)|(?P<symbol>::|:{IDENT}[?!]?|{IDENT}[?!]?:(?!:))|(?P<ident>@{{0,2}}{IDENT}[?!]?)|(?P<number>\d[\w.]*)|(?P<op>=>|==|&\.|\.\.|[^\w\s])",
    re.S,
)
OPENS = frozenset("begin case for".split())
STARTS = frozenset("if unless while until".split())  # with a block only where a statement begins
KINDS = {"class": "class", "module": "interface"}


def extract(source: bytes) -> Extracted:
    tokens, found, stack = lex(source, RUBY), Extracted(), []
    loop_line = -1  # the line of a while, until or for whose "do" is its own

    def begins(i: int) -> bool:
        before = tokens[i - 1] if i else None
        return before is None or before.kind == "line" or (before.kind == "op" and before.text in "=({[|&,") or (before.kind == "ident" and before.text in ("then", "do", "else", "begin", "ensure", "return", "private", "public", "protected"))

    for i, t in enumerate(tokens):
        if t.kind != "ident" or (i and tokens[i - 1].kind == "op" and tokens[i - 1].text in (".", "&.")) or (i and tokens[i - 1].text == "def"):
            continue
        if t.text in KINDS and begins(i) and i + 1 < len(tokens):
            k = i + 1
            if tokens[k].text == "<":  # class << self
                stack.append(None)
                continue
            while k + 2 < len(tokens) and tokens[k + 1].text == "::":
                k += 2
            stack.append((Symbol(name_of(tokens[k]), KINDS[t.text], t.start, t.end), i))
            found.symbols.append(stack[-1][0])
        elif t.text == "def" and i + 1 < len(tokens):
            k = i + 1
            while k + 2 < len(tokens) and tokens[k + 1].text == ".":  # def self.name
                k += 2
            symbol = Symbol(name_of(tokens[k]), "function", t.start, t.end)
            found.symbols.append(symbol)
            after, depth = k + 1, 0
            while after < len(tokens) and (depth or tokens[after].kind != "line"):
                depth += (tokens[after].text == "(") - (tokens[after].text == ")")
                if not depth and tokens[after].text == "=" and tokens[after].kind == "op" and (tokens[after - 1].text == ")" or after > k + 1):  # an endless method
                    while after < len(tokens) and tokens[after].kind != "line":
                        after += 1
                    symbol.end = tokens[after - 1].end
                    break
                after += 1
            else:
                stack.append((symbol, i))
        elif t.text in OPENS or (t.text in STARTS and begins(i)):
            stack.append(None)
            if t.text in ("while", "until", "for"):
                loop_line = t.line
        elif t.text == "do":
            if t.line != loop_line:
                stack.append(None)
            loop_line = -1
        elif t.text == "end" and stack:
            top = stack.pop()
            if top is not None:
                top[0].end = t.end
    for top in stack:  # a source that breaks off
        if top is not None:
            top[0].end = tokens[-1].end
    return found
