"""A repository behind a public Git host's web interface: its tree by one request, its files raw."""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request

API = "https://api.github.com"
RAW = "https://raw.githubusercontent.com"
PREFIX = "github:"
TIMEOUT_S = 15.0


class RemoteTree:
    """``listing()`` and ``fetch(path)`` of ``owner/name`` at ``ref``; sent to the tasks as it is."""

    def __init__(self, repo: str, ref: str = "HEAD", token: str | None = None, api: str = API, raw: str = RAW):
        self.repo, self.ref, self.token, self.api, self.raw = repo, ref, token, api.rstrip("/"), raw.rstrip("/")

    @property
    def key(self) -> str:
        return f"{PREFIX}{self.repo}@{self.ref}"

    @classmethod
    def of_key(cls, key: str, **settings) -> RemoteTree | None:
        """The tree that a key names, or None for a local project."""
        repo, at, ref = key.removeprefix(PREFIX).rpartition("@")
        return cls(repo, ref, **settings) if key.startswith(PREFIX) and at and repo and ref else None

    def _get(self, url: str) -> bytes:
        headers = {"Authorization": f"Bearer {self.token}"} if self.token else {}
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=TIMEOUT_S) as answer:
            return answer.read()

    def listing(self) -> list[str]:
        tree = json.loads(self._get(f"{self.api}/repos/{self.repo}/git/trees/{urllib.parse.quote(self.ref)}?recursive=1"))
        return [x["path"] for x in tree.get("tree", []) if x.get("type") == "blob"]

    def fetch(self, path: str) -> bytes | None:
        try:
            return self._get(f"{self.raw}/{self.repo}/{urllib.parse.quote(self.ref)}/{urllib.parse.quote(path)}")
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            return None
