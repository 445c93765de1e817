"""Languages by file extension.

The values below are fixed: results must equal those that users of existing indexes have.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import paths

# Languages that the chunker knows, by suffix.
CHUNK_LANGUAGES = {
    ".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript",
    ".tsx": "typescript", ".rs": "rust", ".go": "go", ".rb": "ruby", ".java": "java", ".c": "c", ".h": "c",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".cs": "c_sharp", ".php": "php", ".swift": "swift",
    ".kt": "kotlin", ".scala": "scala", ".lua": "lua", ".r": "r", ".R": "r", ".jl": "julia", ".ex": "elixir",
    ".exs": "elixir", ".erl": "erlang", ".hrl": "erlang", ".hs": "haskell", ".ml": "ocaml", ".mli": "ocaml",
    ".sh": "bash", ".bash": "bash", ".zsh": "bash", ".yaml": "yaml", ".yml": "yaml", ".json": "json",
    ".toml": "toml", ".md": "markdown", ".sql": "sql",
}

# Languages with symbols, by suffix.
SYMBOL_LANGUAGES = {
    ".py": "python", ".pyi": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "tsx", ".go": "go", ".rs": "rust",
    ".java": "java", ".c": "c", ".h": "c", ".cs": "c_sharp", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp",
    ".hpp": "cpp", ".hh": "cpp", ".rb": "ruby", ".php": "php", ".swift": "swift", ".kt": "kotlin", ".kts": "kotlin",
}


def language(path: Column, table: dict[str, str]) -> Column:
    """The language of a path's lower-cased suffix, or null. A constant map, so no join."""
    low = {k: v for k, v in table.items() if k == k.lower()}
    pairs = F.create_map(*[F.lit(x) for kv in low.items() for x in kv])
    return F.element_at(pairs, F.lower(paths.suffix(path)))


def has_symbols(path: Column) -> Column:
    return language(path, SYMBOL_LANGUAGES).isNotNull()


def is_watched(path: Column) -> Column:
    return F.lower(paths.suffix(path)).isin(sorted(CHUNK_LANGUAGES))
