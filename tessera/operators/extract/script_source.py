"""Symbols of JavaScript and TypeScript sources: functions, classes, their methods, and interfaces."""

from __future__ import annotations

from tessera.operators.extract.lexing import JS, Token, lex, matching, name_of
from tessera.operators.extract.rows import Extracted, Symbol

MODIFIERS = frozenset("static async get set public private protected readonly override abstract declare accessor".split())
RESERVED = frozenset("if for while switch catch function return new await typeof with do else super".split())


def _body(tokens: list[Token], i: int, end: int) -> int | None:
    """Place of the brace that opens a body behind a parameter list, or None for a bare signature."""
    depth = 0
    while i < end:
        t = tokens[i]
        if t.kind == "op":
            if t.text == "{" and depth == 0:
                before = tokens[i - 1]
                if before.kind == "op" and before.text in (":", "|", "&", "<"):  # an object type, not a body
                    i = matching(tokens, i)
                else:
                    return i
            elif t.text in (";", "}") and depth == 0:
                return None
            elif t.text in "([":
                i = matching(tokens, i)
        i += 1
    return None


def extract(source: bytes, typed: bool = False) -> Extracted:
    tokens = [t for t in lex(source, JS) if t.kind != "line"]
    found = Extracted()

    def text(k: int) -> str:
        return tokens[k].text if 0 <= k < len(tokens) else ""

    def opening(i: int, end: int) -> int | None:
        """The next brace that opens a class or interface body, past type arguments."""
        while i < end:
            if text(i) == "{" and tokens[i].kind == "op":
                return i
            i += 1
        return None

    def members(a: int, b: int, owner: str) -> None:
        i = a
        while i < b:
            first = i
            while (text(i) in MODIFIERS or text(i) == "*") and text(i + 1) not in ("(", "=", ";", ":"):
                i += 1
            if tokens[i].kind == "ident" and text(i + 1) in ("(", "<") and text(i) not in RESERVED:
                k = i + 1
                while k < b and text(k) != "(":
                    k += 1
                brace = _body(tokens, matching(tokens, k) + 1, b) if k < b else None
                if brace is not None:
                    end = matching(tokens, brace)
                    found.symbols.append(Symbol(name_of(tokens[i]), "method", tokens[first].start, tokens[end].end, owner))
                    walk(brace + 1, end)
                    i = end + 1
                    continue
            if tokens[i].kind == "op" and text(i) in "({[":
                end = matching(tokens, i)
                walk(i + 1, end)
                i = end
            i += 1

    def walk(a: int, b: int) -> None:
        i = a
        while i < b:
            t = tokens[i]
            if t.kind == "ident" and t.text == "function" and text(i - 1) != ".":
                k = i + 1 + (text(i + 1) == "*")
                if k < b and tokens[k].kind == "ident":
                    p = k
                    while p < b and text(p) != "(":
                        p += 1
                    brace = _body(tokens, matching(tokens, p) + 1, b) if p < b else None
                    if brace is not None:
                        end = matching(tokens, brace)
                        start = tokens[i - 1] if text(i - 1) == "async" else t
                        found.symbols.append(Symbol(name_of(tokens[k]), "function", start.start, tokens[end].end))
                        walk(brace + 1, end)
                        i = end + 1
                        continue
            elif t.kind == "ident" and t.text in ("class", "interface") and text(i - 1) != "." and i + 1 < b and tokens[i + 1].kind == "ident":
                brace = opening(i + 2, b) if t.text == "class" or typed else None
                if brace is not None and text(i + 1) not in ("extends", "implements"):
                    end = matching(tokens, brace)
                    found.symbols.append(Symbol(name_of(tokens[i + 1]), t.text, t.start, tokens[end].end))
                    if t.text == "class":
                        members(brace + 1, end, name_of(tokens[i + 1]))
                    i = end + 1
                    continue
            i += 1

    walk(0, len(tokens))
    return found
