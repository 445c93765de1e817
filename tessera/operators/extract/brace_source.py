"""Symbols of Rust, Java, C, C++, C#, PHP, Swift and Kotlin sources, by one lexer and a table for each language.

A scope is a class-like body (or a namespace) that opens with a word of the table. Functions are told by their
word (``fn``, ``func``, ``fun``, ``function``) or, in languages that have none, by a name, a parameter list and
a body. Bodies of functions are read for what they nest. Text that does not parse yields what could be read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from tessera.operators.extract.lexing import IDENT, Token, lex, matching, name_of
from tessera.operators.extract.rows import Extracted, Symbol


@dataclass(frozen=True)
class Scope:
    """What a word that opens a body means: the symbol's kind (None: no symbol), that of its functions, their parent."""

    kind: str | None
    members: str = "function"
    parent: bool = False


@dataclass(frozen=True)
class Language:
    pattern: re.Pattern
    scopes: dict[str, Scope]
    words: frozenset[str] = frozenset()  # that begin a function
    modifiers: frozenset[str] = frozenset()
    signatures: bool = False  # functions without a body count
    expression: str = ""  # opens a body that is one expression
    lines: bool = False  # a line break can end a declaration
    bare: bool = False  # a class-like declaration needs no body
    reserved: frozenset[str] = field(default_factory=frozenset)


def _lexer(strings: str, comments: str = r"//[^\n]*|/\*.*?(?:\*/|\Z)", op: str = r"::|=>|->|[^\w\s]") -> re.Pattern:
    return re.compile(
        rf"(?P<space>[ \t\r\f\v]+)|(?P<line>\n)|(?P<comment>{comments})|(?P<string>{strings})|(?P<ident>{IDENT})|(?P<number>\d[\w.]*)|(?P<op>{op})", re.S
    )


DOUBLE, SINGLE = r'"(?:\\.|[^"\\\n])*"?', r"'(?:\\.|[^'\\\n])*'?"
TRIPLE = r'"""(?:\\.|[^\\])*?(?:"""|\Z)'
DIRECTIVE = r"\#(?:\\\r?\n|[^\n])*|//[^\n]*|/\*.*?(?:\*/|\Z)"
FLOW = frozenset("if for while switch catch return new throw else do try synchronized sizeof using lock foreach when case super this static_assert alignas decltype fixed checked unchecked nameof typeof await yield".split())
CLASS = Scope("class", "method", True)
LANGUAGES = {
    "rust": Language(
        _lexer(r'b?r(\#*)".*?"\5|b?"(?:\\.|[^"\\])*"?|b?\'(?:\\(?:x..|u\{[^}]*\}|.)|[^\'\\\n])\'|\'\w+'),
        {"struct": Scope("class"), "enum": Scope("class"), "impl": Scope("class", "method"), "trait": Scope("interface", "method"), "mod": Scope(None)},
        frozenset({"fn"}), frozenset("pub async const unsafe extern default".split()), bare=True),
    "java": Language(
        _lexer(f"{TRIPLE}|{DOUBLE}|{SINGLE}"),
        {"class": CLASS, "enum": Scope("class"), "record": Scope("class", "method"), "interface": Scope("interface")}, signatures=True, reserved=FLOW),
    "c": Language(_lexer(f"{DOUBLE}|{SINGLE}", DIRECTIVE), {"struct": Scope("class"), "union": Scope("class"), "enum": Scope("class")}, reserved=FLOW),
    "cpp": Language(
        _lexer(rf'R"([^(\s]*)\(.*?\)\5"|{DOUBLE}|{SINGLE}', DIRECTIVE),
        {"class": Scope("class"), "struct": Scope("class"), "namespace": Scope(None), "union": Scope(None), "enum": Scope(None)}, reserved=FLOW),
    "c_sharp": Language(
        _lexer(rf'\$?@\$?"(?:""|[^"])*"?|\$?{DOUBLE}|{SINGLE}', DIRECTIVE),
        {"class": CLASS, "struct": Scope("class", "method"), "record": Scope("class", "method"), "interface": Scope("interface", "method"), "namespace": Scope(None), "enum": Scope(None)},
        signatures=True, expression="=>", bare=True, reserved=FLOW),
    "php": Language(
        _lexer(rf'<<<[ ]?["\']?(\w+)["\']?\n.*?\n[ \t]*\5\b|"(?:\\.|[^"\\])*"?|\'(?:\\.|[^\'\\])*\'?', r"\#(?!\[)[^\n]*|//[^\n]*|/\*.*?(?:\*/|\Z)|\?>.*?(?:<\?php|<\?=|\Z)|(?<!.)[^<]*<\?php"),
        {"class": CLASS, "interface": Scope("interface", "method"), "trait": Scope(None, "method"), "enum": Scope(None, "method"), "namespace": Scope(None)},
        frozenset({"function"}), frozenset("public private protected static abstract final readonly".split()), signatures=True),
    "swift": Language(
        _lexer(rf"{TRIPLE}|{DOUBLE}"),
        {"class": CLASS, "struct": CLASS, "enum": CLASS, "actor": CLASS, "extension": CLASS, "protocol": Scope("interface")},
        frozenset({"func"}), frozenset("public private internal fileprivate open static class final override mutating nonmutating required convenience dynamic async indirect".split()), lines=True),
    "kotlin": Language(
        _lexer(rf"{TRIPLE}|{DOUBLE}|{SINGLE}"),
        {"class": CLASS, "interface": CLASS, "object": Scope("class", "method")},
        frozenset({"fun"}), frozenset("public private internal protected open override abstract final suspend inline operator infix tailrec external data sealed enum annotation inner companion const value expect actual".split()),
        signatures=True, expression="=", lines=True, bare=True),
}


class _Reader:
    def __init__(self, source: bytes, language: str):
        self.of, self.name = LANGUAGES[language], language
        self.tokens = lex(source, self.of.pattern)
        if not self.of.lines:
            self.tokens = [t for t in self.tokens if t.kind != "line"]
        self.found = Extracted()

    def text(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def ident(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "ident"

    def op(self, i: int, text: str) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "op" and self.tokens[i].text == text

    def skip_lines(self, i: int) -> int:
        while i < len(self.tokens) and self.tokens[i].kind == "line":
            i += 1
        return i

    def first(self, i: int, begin: int) -> int:
        """The first token of the declaration whose word is at ``i``: its modifiers, or all since the last one."""
        if not self.of.modifiers:
            return begin if begin <= i else i
        while True:
            k = i - 1
            if self.op(k, ")") and self.name == "rust":  # pub(crate)
                while k > begin and not self.op(k, "("):
                    k -= 1
                k -= 1
            elif k >= 0 and self.tokens[k].kind == "string" and self.name == "rust" and self.text(k - 1) == "extern":
                k -= 1
            if k < begin or not self.ident(k) or self.text(k) not in self.of.modifiers:
                return i
            i = k

    def add(self, name: int, kind: str, first: int, last: int, parent: str | None = None) -> None:
        last = min(last, len(self.tokens) - 1)
        while last > name and self.tokens[last].kind == "line":
            last -= 1
        self.found.symbols.append(Symbol(name_of(self.tokens[name]), kind, self.tokens[first].start, self.tokens[last].end, parent))

    def angle(self, i: int) -> int:
        """The place behind type arguments that open at ``i``."""
        depth = 0
        while i < len(self.tokens):
            if self.op(i, "<"):
                depth += 1
            elif self.op(i, ">"):
                depth -= 1
                if depth == 0:
                    return i + 1
            elif self.tokens[i].kind == "op" and self.text(i) in ";{}":
                return i
            i += 1
        return i

    def body(self, i: int, end: int) -> tuple[int | None, int]:
        """From a header on: (place of the brace that opens its body or None, last token of the header)."""
        while i < end:
            t = self.tokens[i]
            if t.kind == "op":
                if t.text == "{":
                    return i, i
                if t.text == ";":
                    return None, i
                if t.text == "}":
                    return None, i - 1
                if t.text in "([":
                    i = matching(self.tokens, i)
            elif t.kind == "line":
                after = self.skip_lines(i)
                if not (self.op(after, "{") or self.op(after, ":") or self.text(after) in ("where", "throws") or self.op(i - 1, ",") or self.op(i - 1, ":")):
                    return None, i - 1
            i += 1
        return None, end - 1

    def scope(self, i: int, begin: int, end: int, owner: str | None) -> int | None:
        """A class-like declaration whose word is at ``i``; the place behind it, or None if it is none."""
        of, k = self.of.scopes[self.text(i)], i + 1
        if self.op(i - 1, ".") or self.op(i - 1, "::") or self.op(i - 1, "->"):
            return None
        if self.name == "cpp" and self.text(i) == "enum" and self.text(k) in ("class", "struct"):
            k += 1
        if self.name == "kotlin" and self.text(i) == "object" and not self.ident(k) and "companion" in (self.text(i - 1),):
            k = i  # a companion goes by its word
        if self.text(i) == "impl":
            if self.op(k, "<"):
                k = self.angle(k)
            while self.op(k, "&") or self.op(k, "!") or (self.ident(k) and self.op(k + 1, "::")):
                k += 1 + self.ident(k)
        while self.op(k, "[") or self.text(k) in ("alignas", "__attribute__"):  # attributes
            k = matching(self.tokens, k + (not self.op(k, "["))) + 1
        named = self.ident(k) and self.text(k) not in ("extends", "implements", "where")
        if not named and (of.kind is not None or self.name not in ("cpp", "rust", "php")):
            return None
        if self.text(i) == "record" and not (self.op(k + 1, "(") or self.op(k + 1, "<") or self.op(k + 1, "{") or self.op(k + 1, ":") or self.text(k + 1) == "implements"):
            return None
        brace, last = self.body(k + 1 if named else k, end)
        if self.name in ("c", "cpp") and named and of.kind is not None:
            inside = self.tokens[k + 1 : brace if brace is not None else last]
            if brace is None or any(t.kind == "op" and t.text in "(=*," for t in inside if t.text != ","):
                return None  # a use of the type, such as a function's result
        if brace is None and not self.of.bare:
            return None if self.name != "php" else last + 1
        close = matching(self.tokens, brace) if brace is not None else last
        first = self.first(i, begin)
        if self.name in ("c", "cpp"):
            first = i
        if of.kind is not None and named:
            self.add(k, of.kind, first, close)
        if brace is not None:
            self.walk(brace + 1, close, of.members, name_of(self.tokens[k]) if named and of.parent else None)
        return close + 1

    def function(self, i: int, begin: int, end: int, kind: str, owner: str | None) -> int | None:
        """A function whose word is at ``i``."""
        k = i + 1
        if self.op(k, "&"):
            k += 1
        if self.name == "kotlin":
            if self.op(k, "<"):
                k = self.angle(k)
            at = k
            while at < end and not self.op(at, "(") and self.tokens[at].kind != "line":
                at = self.angle(at) if self.op(at, "<") else at + 1
            k = at - 1
        if not self.ident(k):
            return None
        p = self.angle(k + 1) if self.op(k + 1, "<") else k + 1
        if not self.op(p, "("):
            return None
        p = matching(self.tokens, p) + 1
        close = self.closing(p, end)
        if close is None:
            return None
        brace, last = close
        if brace is None and not self.of.signatures:
            return last + 1
        stop = matching(self.tokens, brace) if brace is not None else last
        self.add(k, kind, self.first(i, begin), stop, owner if kind == "method" else None)
        if brace is not None:
            self.walk(brace + 1, stop, "function", None)
        return stop + 1

    def closing(self, i: int, end: int) -> tuple[int | None, int] | None:
        """Behind a parameter list: (brace of the body or None, last token of a body that is one expression or none)."""
        while i < end:
            t = self.tokens[i]
            if t.kind == "op":
                if self.of.expression and t.text == self.of.expression:
                    return None, self.expression(i + 1, end)
                if t.text == "{":
                    return i, i
                if t.text == ";":
                    return None, i
                if t.text == "}":
                    return None, i - 1
                if t.text in "([":
                    i = matching(self.tokens, i)
            elif t.kind == "line":
                after = self.skip_lines(i)
                if not (self.op(after, "{") or self.op(after, "->") or self.text(after) in ("where", "throws") or (self.of.expression and self.op(after, self.of.expression))):
                    return None, i - 1
            i += 1
        return None, end - 1

    def expression(self, i: int, end: int) -> int:
        """The last token of an expression: it ends by a semicolon or, where lines count, at the end of a line."""
        i = self.skip_lines(i)
        while i < end:
            t = self.tokens[i]
            if t.kind == "op" and t.text in "([{":
                i = matching(self.tokens, i)
            elif t.kind == "op" and t.text == ";":
                return i
            elif t.kind == "op" and t.text == "}":
                return i - 1
            elif t.kind == "line":
                after = self.skip_lines(i)
                if not (self.op(after, ".") or self.op(after, "?") or (self.tokens[i - 1].kind == "op" and self.text(i - 1) in "+-*/=,&|")):
                    return i - 1
            i += 1
        return end - 1

    def typed(self, i: int, begin: int, end: int, kind: str, owner: str | None) -> int | None:
        """A function without a word of its own: the name at ``i``, a parameter list, then a body."""
        if self.text(i) in self.of.reserved or not self.op(i + 1, "(") or self.op(i - 1, ".") or self.op(i - 1, "->") or self.op(i - 1, "="):
            return None
        built = i == begin or (self.op(i - 1, "~")) or not (self.ident(i - 1) or (self.tokens[i - 1].kind == "op" and self.text(i - 1) in (">", "]", "*", "&", "?", "::", ")")))
        modifiers = [self.text(k) for k in range(begin, i)]
        constructor = self.name in ("java", "c_sharp") and all(m in ("public", "private", "protected", "internal", "static") for m in modifiers)
        if self.name in ("c", "cpp") and built and not (self.name == "cpp" and (owner or kind)):
            return None
        if any(m in ("=", "return", "new", "else", "throw") for m in modifiers):
            return None
        p = first = matching(self.tokens, i + 1) + 1
        close = None
        while p < end and close is None:
            t = self.tokens[p]
            if t.kind == "op" and t.text == "{":
                close = (p, p)
            elif t.kind == "op" and t.text == ";":
                close = (None, p)
            elif self.of.expression and t.kind == "op" and t.text == self.of.expression:
                close = (None, self.expression(p + 1, end))
            elif t.kind == "op" and t.text == ":" and self.name in ("cpp", "c_sharp"):  # initialisers
                p += 1
                while p < end and not (self.op(p, "{") and not (self.ident(p - 1) and self.name == "cpp")):
                    if self.op(p, ";"):
                        return None
                    p = matching(self.tokens, p) + 1 if self.tokens[p].kind == "op" and self.text(p) in "([{" else p + 1
            elif self.name == "java" and p == first and t.text != "throws" and t.text != "[":
                return None  # such as an enum's constant
            elif t.kind == "ident" or (t.kind == "op" and t.text in ("->", ",", ".", "::", "<", ">", "&", "*", "[", "]", "?", "@")):
                p += 1
            elif t.kind == "op" and t.text == "(" and self.ident(p - 1):
                p = matching(self.tokens, p) + 1
            else:
                return None
        if close is None:
            return None
        brace, last = close
        if brace is None and self.text(last) == ";" and last == p and (built or not self.of.signatures):
            return None
        stop = matching(self.tokens, brace) if brace is not None else last
        own = "function" if constructor else kind
        self.add(i, own, begin, stop, owner if own == "method" else None)
        if brace is not None:
            self.nested(brace + 1, stop)
        return stop + 1

    def nested(self, a: int, b: int) -> None:
        """Classes inside a function's body, where a call looks like a function."""
        i = a
        while i < b:
            nxt = self.scope(i, i, b, None) if self.ident(i) and self.text(i) in self.of.scopes and self.of.scopes[self.text(i)].kind else None
            i = nxt if nxt is not None else i + 1

    def walk(self, a: int, b: int, kind: str, owner: str | None) -> None:
        """Declarations from ``a`` to ``b``; functions there are of ``kind``, with ``owner`` as their parent."""
        i = begin = a
        while i < b:
            t = self.tokens[i]
            nxt = None
            if t.kind == "ident":
                if t.text in self.of.scopes:
                    nxt = self.scope(i, begin, b, owner)
                elif t.text in self.of.words:
                    nxt = self.function(i, begin, b, kind, owner)
                elif not self.of.words:
                    nxt = self.typed(i, begin, b, kind, owner)
            if nxt is not None:
                i = begin = max(nxt, i + 1)
                continue
            if t.kind == "op" and t.text in "{([":
                close = matching(self.tokens, i)
                if t.text == "{" and self.of.words:  # blocks, closures, accessors
                    self.walk(i + 1, close, "function", None)
                elif t.text == "[" and i == begin and self.name != "c_sharp":
                    begin = close + 1
                i = close
                if t.text == "{":
                    begin = i + 1
            elif t.kind == "op" and (t.text in ";}" or (t.text == ":" and self.text(i - 1) in ("public", "private", "protected") and self.name == "cpp") or (t.text == "#" and self.name == "rust")):
                begin = i + 1
            elif t.kind == "op" and t.text == "," and self.name == "java" and kind == "function":  # enum constants
                begin = i + 1
            i += 1


def extract(source: bytes, language: str) -> Extracted:
    reader = _Reader(source, language)
    reader.walk(0, len(reader.tokens), "function", None)
    return reader.found
