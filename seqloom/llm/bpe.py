"""Byte-level BPE encoding and decoding by a monoid tree reduction.

A text is cut in halves down to leaves; each leaf is encoded alone. Two neighbours are joined by encoding again a
window about their border. The window grows, twice as wide each time, until each end lies where a letter or digit meets
a space or line feed, or at the node's own end. No match of the splitting pattern holds a non-space before a space, no
match that ends there looks beyond it and none looks back, so tokens outside the window are those of the joint text.
Joining is associative and exact. That is proven for ``public_tokenizers.PATTERN`` only, so other patterns need ``safe``, a
regular expression for the places where they split whatever stands around. Decoding concatenates the bytes of the halves.

Defined cases: null counts as empty; an empty text has no tokens (digests of the empty string); repeated rows each give
a row; texts of any length take memory in proportion to their own length. Other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame

from .common import only, slices

LEAF = 1024
_safe = re.compile(r"(?<=[^\W_])[ \n]")


class TreeBPE:
    """Encodes and decodes with the ranks of a file, in the format of tiktoken's, and a splitting pattern."""

    def __init__(self, path: str, pattern: str, leaf: int = LEAF, safe: str | None = None):
        if safe is None and pattern != public_tokenizers.PATTERN:
            raise ValueError("state in safe where this pattern always splits")
        self.safe = re.compile(safe) if safe else _safe
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.leaf = max(2, leaf)
        self._encode = tiktoken.Encoding("tree", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        top = max(ranks.values(), default=-1) + 1
        self.pieces: list[bytes] = [b""] * top
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.names = [str(i) for i in range(top)]

    def encode(self, text: str) -> list[int]:
        return self._node(text, 0, len(text))

    def _node(self, text: str, a: int, b: int) -> list[int]:
        if b - a <= self.leaf:
            return self._encode(text[a:b])
        m = (a + b) // 2
        return self.join(text, a, m, b, self._node(text, a, m), self._node(text, m, b))

    def join(self, text: str, a: int, m: int, b: int, left: list[int], right: list[int]) -> list[int]:
        """The tokens of text[a:b] from those of text[a:m] and text[m:b]."""
        width = 32
        while True:
            lo, hi = max(a, m - width), min(b, m + width)
            p = max((x.start() for x in self.safe.finditer(text, lo, m)), default=None)
            q = x.start() if (x := self.safe.search(text, m, hi)) else None
            if (p is not None or lo == a) and (q is not None or hi == b):
                break
            width *= 2
        p, q = a if p is None else p, b if q is None else q
        if p == a:
            left = []
        elif gone := len(self._encode(text[p:m])):
            del left[-gone:]
        left += self._encode(text[p:q])
        left += right[len(self._encode(text[m:q])) :]
        return left

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 1 << 14:
            return b"".join([self.pieces[i] for i in ids])
        m = len(ids) // 2
        return self.decode(ids[:m]) + self.decode(ids[m:])


@functools.lru_cache(maxsize=2)
def coder(path: str, pattern: str, leaf: int = LEAF, safe: str | None = None) -> TreeBPE:
    return TreeBPE(path, pattern, leaf, safe)


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def bpe_encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, leaf: int = LEAF, safe: str | None = None) -> DataFrame:
    """doc_id, ids array<int>, decoded string: the tokens of each text and what they decode to."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern, leaf, safe)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [c.encode(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(x).decode("utf-8") for x in ids], pa.string())],
                    names=["doc_id", "ids", "decoded"],
                )

    return only(docs, "doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>, decoded string")


def bpe_digests(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, leaf: int = LEAF, safe: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the same encoding, without moving tokens out of the worker."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern, leaf, safe)
        names = c.names
        for batch in batches:
            for part in slices(batch, "text"):
                n, ids_sha, text_sha = [], [], []
                for text in part.column("text").to_pylist():
                    ids = c.encode(text or "")
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return only(docs, "doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
