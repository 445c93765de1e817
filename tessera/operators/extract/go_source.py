"""Symbols and candidate uses of Go sources, by a lexer and the shape of Go's declarations.

A long source is read in pieces of whole declarations, cut at line breaks outside of brackets, so that no list of
tokens is of the whole source.
"""

from __future__ import annotations

from collections.abc import Iterator

from tessera.operators.extract.lexing import GO, PAIRS, Token, matching, name_of, tokens
from tessera.operators.extract.rows import Extracted, Occurrence, Piece, Symbol

PIECE = 1 << 15  # tokens

VALUES = frozenset("nil true false iota".split())
KEYWORDS = frozenset(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range "
    "return select struct switch type var".split()
)


def _is(t: Token | None, text: str) -> bool:
    return t is not None and t.kind in ("op", "ident", "line") and t.text == text


class _Reader:
    def __init__(self, held: list[Token], qualifiers: set[str]):
        self.tokens = held
        self.found = Extracted()
        self.hidden: set[int] = set()  # tokens that declare a name
        self.qualifiers = qualifiers  # of the imports of all the source

    def get(self, i: int) -> Token | None:
        return self.tokens[i] if 0 <= i < len(self.tokens) else None

    def run(self) -> Extracted:
        self.declare()
        for k, t in enumerate(self.tokens):  # declarations inside functions also have fields to leave out
            if t.kind == "ident" and t.text in ("struct", "interface") and _is(self.get(k + 1), "{"):
                self.members(k + 1, t.text)
        self.uses()
        return self.found

    def declare(self) -> None:
        i = 0
        while i < len(self.tokens):
            t = self.tokens[i]
            if t.kind == "ident" and t.text == "package":
                self.hidden.add(i + 1)
                i += 2
            elif t.kind == "ident" and t.text == "import":
                i = self.group(i + 1, self.import_spec)
            elif t.kind == "ident" and t.text == "type":
                i = self.group(i + 1, self.type_spec)
            elif t.kind == "ident" and t.text == "func":
                i = self.function(i)
            elif t.kind == "op" and t.text in "({[":
                i = matching(self.tokens, i) + 1
            else:
                i += 1

    def group(self, i: int, spec) -> int:
        """One spec, or those in parentheses; returns the place behind."""
        if not _is(self.get(i), "("):
            return spec(i)
        end = matching(self.tokens, i)
        i += 1
        while i < end:
            i = i + 1 if self.tokens[i].kind == "line" or _is(self.tokens[i], ";") else spec(i)
        return end + 1

    def spec_end(self, i: int) -> int:
        """The first break outside of brackets from ``i`` on."""
        while i < len(self.tokens):
            t = self.tokens[i]
            if t.kind == "line" or t.kind == "op" and t.text in (";", ")", "}"):
                return i
            i = matching(self.tokens, i) + 1 if t.kind == "op" and t.text in "([{" else i + 1
        return i

    def import_spec(self, i: int) -> int:
        end = self.spec_end(i)
        alias = self.get(i)
        path = next((t for t in self.tokens[i:end] if t.kind == "string"), None)
        for k in range(i, end):
            self.hidden.add(k)
        if path is not None and alias is not None:
            if alias.kind == "ident" and alias.text != "_":
                self.qualifiers.add(alias.text)
                self.found.occurrences.append(Occurrence(name_of(alias), "import", alias.start, alias.end, alias.line))
            elif alias.kind == "string" and (inner := path.text.strip('"`')):
                self.qualifiers.add(inner.rsplit("/", 1)[-1])
        return max(end, i + 1)

    def type_spec(self, i: int) -> int:
        end, name = self.spec_end(i), self.get(i)
        if name is None or name.kind != "ident":
            return max(end, i + 1)
        self.hidden.add(i)
        k = i + 1
        if _is(self.get(k), "[") and self.generic(k):
            k = matching(self.tokens, k) + 1
        what = self.get(k)
        kind = "alias" if _is(what, "=") else "interface" if _is(what, "interface") else "class"
        self.found.symbols.append(Symbol(name_of(name), kind, name.start, self.tokens[end - 1].end, encloses=False))
        return max(end, i + 1)

    def generic(self, i: int) -> bool:
        """Whether the brackets hold type parameters, not an array length: a name and something behind it."""
        first, second = self.get(i + 1), self.get(i + 2)
        return first is not None and first.kind == "ident" and second is not None and not _is(second, "]")

    def function(self, i: int) -> int:
        start, k, parent, kind = self.tokens[i], i + 1, None, "function"
        if _is(self.get(k), "("):
            end = matching(self.tokens, k)
            inside, depth = [], 0
            for t in self.tokens[k + 1 : end]:
                depth += (t.text == "[") - (t.text == "]") if t.kind == "op" else 0
                if t.kind == "ident" and depth == 0:
                    inside.append(t)
            parent, kind, k = name_of(inside[-1]) if inside else None, "method", end + 1
        name = self.get(k)
        if name is None or name.kind != "ident":
            return k + 1
        self.hidden.add(k)
        end = last = k
        j = k + 1
        while j < len(self.tokens):
            t = self.tokens[j]
            if t.kind == "line":
                break
            if t.kind == "ident" and t.text in ("struct", "interface") and _is(self.get(j + 1), "{"):
                last = matching(self.tokens, j + 1)
            elif _is(t, "{"):
                last = matching(self.tokens, j)
                j = last + 1
                break
            elif t.kind == "op" and t.text in "([":
                last = matching(self.tokens, j)
            else:
                last = j
            j = last + 1
        end = self.tokens[max(last, end)].end
        self.found.symbols.append(Symbol(name_of(name), kind, start.start, end, parent if kind == "method" else None))
        return max(j, k + 1)

    def members(self, at: int, what: str) -> None:
        """Hide field names of a struct and method names of an interface."""
        end, i = matching(self.tokens, at), at + 1
        while i < end:
            if self.tokens[i].kind == "line" or _is(self.tokens[i], ";"):
                i += 1
                continue
            stop = min(self.spec_end(i), end)
            if what == "interface":
                if self.tokens[i].kind == "ident" and _is(self.get(i + 1), "("):
                    self.hidden.add(i)
            else:
                names = [i] if self.tokens[i].kind == "ident" else []
                k = i + 1
                while names and _is(self.get(k), ",") and (n := self.get(k + 1)) is not None and n.kind == "ident":
                    names.append(k + 1)
                    k += 2
                if k < stop and self.tokens[k].kind != "string" and not _is(self.tokens[k], "."):
                    self.hidden.update(names)
            i = max(stop, i + 1)

    def uses(self) -> None:
        for k, t in enumerate(self.tokens):
            if t.kind != "ident" or t.text in KEYWORDS or t.text in VALUES or t.text == "_" or k in self.hidden:
                continue
            before, after = self.get(k - 1), self.get(k + 1)
            if _is(before, "."):
                kind = "attribute"
            elif t.text in self.qualifiers and _is(after, "."):
                kind = "import"
            elif _is(after, "("):
                kind = "call"
            else:
                kind = "reference"
            self.found.occurrences.append(Occurrence(name_of(t), kind, t.start, t.end, t.line))


def _cut(source: bytes, size: int) -> Iterator[list[Token]]:
    """The tokens in pieces that end at a line break outside of brackets."""
    held: list[Token] = []
    stack: list[str] = []
    for t in tokens(source, GO):
        held.append(t)
        if t.kind == "op":
            if t.text in PAIRS:
                stack.append(PAIRS[t.text])
            elif stack and t.text == stack[-1]:
                stack.pop()
        elif t.kind == "line" and not stack and len(held) >= size:
            yield held
            held = []
    yield held


def extract(source: bytes) -> Extracted:
    out = Extracted()
    for piece in pieces(source):
        out.symbols += piece.found.symbols
        out.occurrences += piece.found.occurrences
    return out


def pieces(source: bytes, size: int = PIECE) -> Iterator[Piece]:
    """What a source's pieces hold, in their order."""
    qualifiers: set[str] = set()
    place = line = 0
    for n, held in enumerate(_cut(source, size)):
        end = held[-1].end if held else len(source)
        if n == 0 and b"import" in source[end:]:  # perhaps an import behind the first piece, whose name counts before it
            for part in _cut(source, size):
                _Reader(part, qualifiers).declare()
        found = _Reader(held, qualifiers).run()
        yield Piece(found, line, source[place:end].decode("utf-8", "replace").split("\n"))
        place, line = end, held[-1].line if held else line
