"""Rows that extraction makes, and what all languages share."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(slots=True)
class Symbol:
    name: str
    kind: str
    start: int
    end: int
    parent: str | None = None
    docstring: str | None = None
    decorators: list[str] | None = None
    id: str = ""
    encloses: bool = True

    def key(self) -> int:
        """A hash of what its id is made of, within a source."""
        return hash((self.kind, self.parent, self.name))


@dataclass(slots=True)
class Occurrence:
    name: str
    kind: str
    start: int
    end: int
    line: int
    enclosing: str | None = None


@dataclass
class Extracted:
    symbols: list[Symbol] = field(default_factory=list)
    occurrences: list[Occurrence] = field(default_factory=list)


@dataclass
class Piece:
    """A stretch of a source that holds its symbols whole: what it holds, the lines before it, and its own lines.

    ``again`` has the key of every id that comes twice in the source, where that is known before.
    """

    found: Extracted
    first: int
    lines: list[str]
    again: set[int] | None = None


def identify(found: Extracted, path: str, seen: set[str] | None = None, again: set[int] | None = None) -> Extracted:
    """Give ids in order of place; the second symbol of an id gets '@' and its place. Link occurrences.

    ``seen`` are the ids of the source's pieces before; with ``again``, those alone that can come twice.
    """
    found.symbols.sort(key=lambda s: (s.start, -s.end))
    seen = set() if seen is None else seen
    for s in found.symbols:
        s.id = f"{path}:{s.kind}:{s.parent}.{s.name}" if s.parent else f"{path}:{s.kind}:{s.name}"
        if again is not None and s.key() not in again:
            continue
        if s.id in seen:
            s.id += f"@{s.start}"
        seen.add(s.id)
    found.occurrences.sort(key=lambda o: o.start)
    open_symbols: list[Symbol] = []
    waiting = iter([*(s for s in found.symbols if s.encloses), None])
    following = next(waiting)
    for o in found.occurrences:
        while following is not None and following.start <= o.start:
            while open_symbols and open_symbols[-1].end <= following.start:
                open_symbols.pop()
            open_symbols.append(following)
            following = next(waiting)
        while open_symbols and open_symbols[-1].end <= o.start:
            open_symbols.pop()
        o.enclosing = open_symbols[-1].id if open_symbols else None
    return found
