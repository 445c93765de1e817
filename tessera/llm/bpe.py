"""BPE encoding and decoding with a word-level vocabulary file (operator 1).

Method: contiguous rank array. A word is a short list of parts with, beside it, the ranks of the adjacent
pairs. The lowest rank is searched by a plain scan, its right part is deleted, and the two neighbouring
ranks are looked up again. Words longer than ``SHORT`` parts take a heap over the same merges, because the
scan is quadratic; results are equal.

Words repeat, so every Python worker keeps a bounded memo of encoded words. Memory per worker: the
vocabulary, ``MEMO`` words and one Arrow batch. There is no shuffle, and a lost task is simply run again.

Cases: a null text counts as empty; an empty or all-white text has no ids; special-token strings in a text
become their special ids (as the file's library does by default); rows are independent, so ties, repeated
rows, null ids and empty tables need nothing; columns other than id and text never reach the operator.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from tessera.llm.common import bound_batches

SHORT = 192
MEMO = 200_000
NONE = 1 << 40
SCHEMA = "doc_id long, n_tokens long, ids array<int>, decoded string"
DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _byte_letters() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for U+0100 onwards in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, source: str | bytes):
        spec = json.loads(source if isinstance(source, bytes) else Path(source).read_bytes())
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        letters = _byte_letters()
        self.inner = [vocab[x] for x in letters]
        self.final = [vocab[x + end] for x in letters]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            left, right = vocab[a], vocab[b]
            self.merges.setdefault(left << 32 | right, (rank, vocab[a + b]))
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.split_special = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        self.words, self.words_exact, self.odd = self._patterns(spec["pre_tokenizer"])
        self.memo: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def _patterns(pre: dict) -> tuple[regex.Pattern, regex.Pattern, frozenset[str]]:
        """The file's own split pattern, the same for texts with odd characters, and the odd characters.

        White space is the Unicode property; Python's own class also takes in U+001C to U+001F. Odd are characters
        newer than Python's tables that one regular-expression library knows as letters or numbers and the file's
        own library does not.
        """
        (split,) = (x for x in pre["pretokenizers"] if x["type"] == "Split")
        pattern, space = split["pattern"]["Regex"], r"\p{White_Space}"
        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        new = "".join(c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn")
        known = {c for name in (r"\p{L}", r"\p{N}") for c, _ in Split(Regex(name), "removed", invert=True).pre_tokenize_str(new)}
        odd = "[" + ("".join(sorted(set(new) - known)) or "[a]--[a]") + "]"
        exact = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||{odd}]")
        exact = exact.replace(r"[\p{L}]+", rf"[[\p{{L}}]--{odd}]+").replace(r"|[\p{N}]|", rf"|[[\p{{N}}]--{odd}]|")
        return (
            regex.compile(pattern.replace(r"\s", space)), regex.compile("(?V1)" + exact.replace(r"\s", space)),
            frozenset(new) - known)

    def encode_word(self, word: str) -> tuple[int, ...]:
        data = word.encode("utf-8")
        parts = [self.inner[b] for b in data]
        parts[-1] = self.final[data[-1]]
        return tuple(self._scan(parts) if len(parts) <= SHORT else self._heap(parts))

    def _scan(self, parts: list[int]) -> list[int]:
        merges = self.merges
        none = (NONE, 0)
        pairs = [merges.get(a << 32 | b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs:
            best = min(pairs)
            if best is none or best[0] == NONE:
                break
            i = pairs.index(best)
            parts[i] = best[1]
            del parts[i + 1], pairs[i]
            if i:
                pairs[i - 1] = merges.get(parts[i - 1] << 32 | parts[i], none)
            if i < len(pairs):
                pairs[i] = merges.get(parts[i] << 32 | parts[i + 1], none)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        """The same merges for a long word: a heap of (rank, place) over a doubly linked list."""
        merges, n = self.merges, len(parts)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m[0], i, parts[i], parts[i + 1]) for i in range(n - 1) if (m := merges.get(parts[i] << 32 | parts[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = merges[a << 32 | b][1], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and (y := after[x]) >= 0 and (m := merges.get(parts[x] << 32 | parts[y])):
                    heapq.heappush(heap, (m[0], x, parts[x], parts[y]))
        return [x for x in parts if x >= 0]

    def _plain(self, text: str, ids: list[int]) -> None:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        memo, encode, first = self.memo, self.encode_word, len(ids)
        for word in self.words.findall(text):
            known = memo.get(word)
            if known is None:
                if not self.odd.isdisjoint(word):  # never kept in the memo, so that every such text comes here
                    ids[first:] = [i for w in self.words_exact.findall(text) for i in encode(w)]
                    return
                known = encode(word)
                if len(memo) >= MEMO:
                    memo.clear()
                if len(word) <= SHORT:
                    memo[word] = known
            ids += known

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        if not text:
            return ids
        place = 0
        if "<" in text:
            for found in self.split_special.finditer(text):
                self._plain(text[place : found.start()], ids)
                ids.append(self.special[found[0]])
                place = found.end()
        self._plain(text[place:] if place else text, ids)
        return ids

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so tokens are joined by one space."""
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def load(source: str | bytes) -> WordBpe:
    """The encoder of a file's path or content, built once a worker."""
    return WordBpe(source)


def _sent(docs: DataFrame, path: str):
    """The file's content (some MB, whatever the input) as a broadcast: only the driver needs to reach the path."""
    return docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())


def encode_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text of every document."""
    sent = _sent(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(sent.value)
        for batch in batches:
            ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())),
                 pa.array([bpe.decode(x) for x in ids], pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_column).cast("long"), F.col(text_column)).mapInArrow(run, SCHEMA)


def encode_digests(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """As :func:`encode_documents`, but ids and decoded text leave the worker as digests only."""
    sent = _sent(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(sent.value)
        for batch in batches:
            counts, first, second = [], [], []
            for value in batch.column(1):
                ids = bpe.encode(value.as_py())
                counts.append(len(ids))
                first.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                second.append(hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_column).cast("long"), F.col(text_column)).mapInArrow(run, DIGEST_SCHEMA)
