"""Token counts by byte-pair merging, without token identifiers.

A text is cut into pre-tokens by the byte-level pattern. Each distinct
pre-token starts as one symbol per byte; the adjacent pair of lowest merge rank
is popped from a heap again and again and its two links are joined in a linked
list, until no pair has a rank. The count is the initial symbols less the
merges made.

Memory is bounded: the merge table, one Arrow batch, and a memo of at most
``MEMO`` pre-tokens per worker, which only saves time.

Edge cases: null and empty texts count zero; every row is counted on its own, so
repeats and ties need no rule; special strings inside a text count as one token
each, as the library does by default; extra columns are not read.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
MEMO = 300_000
#: Longer pre-tokens are rare and would crowd the memo.
MEMO_CHARS = 64

# The byte-level pre-tokeniser's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary's strings."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    return letters


class Merger:
    """Counts tokens of texts with the merges of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError(f"{path}: only plain byte-level BPE files are handled")
        letters = byte_letters()
        self.symbol = {letters[b]: b for b in range(256)}
        self.first = bytes(range(256))
        ids = {letters[b]: b for b in range(256)}
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            whole = ids.setdefault(left + right, 256 + rank)
            self.rank.setdefault(ids[left] << 32 | ids[right], rank)
            self.made.append(whole)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.find = regex.compile(PATTERN).findall
        self.memo: dict[str, int] = {}

    def merged(self, symbols: bytes) -> int:
        """Initial symbols less merges of one pre-token."""
        n = len(symbols)
        if n < 2:
            return n
        rank, made = self.rank.get, self.made
        ids = list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        count, pop, push = n, heapq.heappop, heapq.heappush
        while heap:
            r, i = pop(heap)
            j = after[i]
            # An entry is stale when its left symbol is gone or the pair has changed since.
            if ids[i] < 0 or j >= n or rank(ids[i] << 32 | ids[j]) != r:
                continue
            ids[i], ids[j] = made[r], -1
            count -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (x := rank(ids[i] << 32 | ids[k])) is not None:
                    push(heap, (x, i))
            h = before[i]
            if h >= 0 and (x := rank(ids[h] << 32 | ids[i])) is not None:
                push(heap, (x, h))
        return count

    def _plain(self, text: str) -> int:
        total, memo, get = 0, self.memo, self.memo.get
        for piece in self.find(text):
            n = get(piece)
            if n is None:
                n = self.merged(piece.encode("utf-8", "surrogatepass"))
                if len(piece) <= MEMO_CHARS:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[piece] = n
            total += n
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None:
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


_MERGERS: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    if path not in _MERGERS:
        _MERGERS[path] = Merger(path)
    return _MERGERS[path]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row; no shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path)
        for batch in batches:
            texts = batch.column(1)
            tokens = [m.count(t.as_py()) for t in texts]
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes, pa.array(tokens, pa.int64()), pa.array([t > limit for t in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
