"""Discovery and selection predicates (C1-C21) as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import paths

# The rules must give the verdicts that users of existing indexes have.
MAX_FILE_BYTES = 1024 * 1024
SNIFF_BYTES = 8192
SKIP_DIRS = (
    ".git", ".hg", ".svn", "node_modules", "vendor", "dist", "build", "__pycache__", ".pytest_cache", ".mypy_cache",
    ".ruff_cache", ".tox", "venv", ".venv", "env", ".env", "site-packages", ".eggs", "*.egg-info", "target", "out",
    ".next", ".nuxt", "coverage", ".coverage",
)
SECRET_NAMES = (
    ".env", ".env.local", ".env.development", ".env.production", ".env.test", ".env.staging", "credentials.json",
    "service-account.json", "service_account.json", "secrets.json", "secrets.yaml", "secrets.yml", ".netrc", ".npmrc",
    ".pypirc", "id_rsa", "id_ed25519", "id_ecdsa", "id_dsa",
)
SECRET_SUFFIXES = (".pem", ".key", ".p12", ".pfx", ".crt", ".cer", ".der", ".jks", ".keystore")
SECRET_PREFIXES = (".env.", "credentials.")
CACHE_NAME = "^[0-9a-f]{12}$"
INDEX_NAME = r"^index_[0-9a-f]{16}\.json$"
SIDECAR_NAME = r"^index_[0-9a-f]{16}\.meta\.json$"
TEMP_NAME = r"^index_[0-9a-f]{16}(?:\.meta)?(?:\.\d+\.[0-9a-f]{8})?\.tmp$"
GRANTED = ("true", "1", "yes")


def any_of(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def escapes_root(path: Column, root: str) -> Column:
    """The resolved path lies outside the root."""
    return ~paths.inside(path, root)


def is_secret(path: Column) -> Column:
    """C3, case-sensitive."""
    name = paths.name(path)
    ends = [name.endswith(s) for s in SECRET_SUFFIXES]
    starts = [name.startswith(s) for s in SECRET_PREFIXES]
    return name.isin(*SECRET_NAMES) | any_of(ends) | any_of(starts)


def in_skipped_dir(path: Column, glob_egg_info: bool = True) -> Column:
    """C4: a directory above the file is skipped by name; ``*.egg-info`` is a glob unless told otherwise."""
    parts = paths.stem_parts(path)
    found = F.arrays_overlap(parts, F.array(*map(F.lit, SKIP_DIRS)))
    return found | F.exists(parts, lambda p: p.endswith(".egg-info")) if glob_egg_info else found


def is_binary(content: Column) -> Column:
    """A NUL byte near the start, or no content at all to read."""
    head = F.substring(content.cast("binary"), 1, SNIFF_BYTES)
    return F.coalesce(F.contains(head, F.lit(bytearray(b"\0"))), F.lit(True))


def is_oversized(size: Column) -> Column:
    """More than a MiB, or unknown."""
    return F.coalesce(size > MAX_FILE_BYTES, F.lit(True))


def under_git(path: Column) -> Column:
    """C8."""
    return F.array_contains(F.split(path, "/"), ".git")


def is_test_file(path: Column, compat: bool = True) -> Column:
    """C17; without ``compat`` Go's test files count too."""
    parts, name = F.split(path, "/"), paths.name(path)
    by_part = F.exists(parts, lambda p: (p == "tests") | p.startswith("test_") | p.endswith("_test"))
    by_name = name.startswith("test_") | name.endswith("_test.py") | (name == "conftest.py")
    return by_part | by_name if compat else by_part | by_name | name.endswith("_test.go")


def name_contains(name: Column, query: str) -> Column:
    """C11: substring, any case; '%' and '_' are ordinary characters."""
    return F.lower(name).contains(F.lit(query.lower()))


def name_equals(name: Column, query: str) -> Column:
    """Equal in any case; the query is trimmed."""
    return F.lower(name) == F.lit(query.strip().lower())


def recent(mtime: Column, now: float, grace_s: int) -> Column:
    """Inside the grace window; 0 or less switches it off, an unknown time is not recent."""
    return F.coalesce(F.lit(now) - mtime < F.lit(float(grace_s)), F.lit(False)) if grace_s > 0 else F.lit(False)


def grace_seconds(raw: str | None, default: int = 3600) -> int:
    try:
        return default if raw is None else max(0, int(raw))
    except ValueError:
        return default


def granted(raw: str | None) -> bool:
    """Destructive work is allowed."""
    return (raw or "").strip().lower() in GRANTED


def require_query(query: str | None) -> str:
    """C20: a query must hold something."""
    if not query or not query.strip():
        raise ValueError("query must not be empty")
    return query


def require_choice(value: str | None, choices: tuple[str, ...], what: str) -> None:
    if value is not None and value not in choices:
        raise ValueError(f"{what} must be one of {', '.join(choices)}")


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(int(value), high))
