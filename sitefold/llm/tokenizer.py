"""Byte-level BPE over the array kernel: each distinct pre-token is encoded once per worker.

The vocabulary file is a parameter; executors read it from the same path as the driver.
"""

from __future__ import annotations

import base64
from pathlib import Path

import numpy as np

from . import kernel as K

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens that a worker keeps at most; it then starts afresh.
CACHE = 400_000


def encoding(vocabulary: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(vocabulary).open("rb"))}
    return tiktoken.Encoding(Path(vocabulary).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Lengths(dict):
    """Tokens of a pre-token: the frequent ones that it starts with, and those that the worker has met."""

    def __init__(self, encode, table: dict[str, int]):
        super().__init__(table)
        self.encode = encode

    def __missing__(self, text: str) -> int:
        n = self[text] = len(self.encode(text))
        return n


class _Ids(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, text: str) -> bytes:
        ids = self[text] = np.array(self.encode(text), np.uint32).tobytes()
        return ids


class Encoder:
    """Token counts and token ids of texts. Pre-tokens are found by their own characters, so no two are taken for each other."""

    _own: dict[str, "Encoder"] = {}

    def __init__(self, vocabulary: str):
        self.enc = encoding(vocabulary)
        self.table: dict[str, int] = {}
        self.lengths = _Lengths(self.enc.encode_ordinary, {})
        self.ids = _Ids(self.enc.encode_ordinary)

    @classmethod
    def get(cls, vocabulary: str) -> "Encoder":
        """One for each worker process and vocabulary."""
        if vocabulary not in cls._own:
            cls._own[vocabulary] = cls(vocabulary)
        return cls._own[vocabulary]

    def counts(self, texts: list[str | None], table: dict[str, int] | None = None) -> np.ndarray:
        """Tokens of each text, 0 for None and empty ones. table: lengths of frequent pre-tokens in tokens."""
        out = np.zeros(len(texts), np.int64)
        if table is not None and table is not self.table:
            self.table, self.lengths = table, _Lengths(self.enc.encode_ordinary, table)
        for first, end, cps, offsets in K.blocks(texts):
            s, e, doc = K.pretoken_spans(cps, offsets)
            if len(self.lengths) > CACHE + len(self.table):
                self.lengths = _Lengths(self.enc.encode_ordinary, self.table)
            which, words = K.distinct_texts(cps, s)
            n = np.fromiter(map(self.lengths.__getitem__, words), np.int64, len(words))
            out[first:end] = np.bincount(doc, n[which], end - first).astype(np.int64)
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids of each text as uint32."""
        out: list[np.ndarray] = []
        for first, end, cps, offsets in K.blocks(texts):
            s, e, doc = K.pretoken_spans(cps, offsets)
            if len(self.ids) > CACHE:
                self.ids.clear()
            which, words = K.distinct_texts(cps, s)
            parts = list(map(self.ids.__getitem__, words))
            size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
            flat, at = np.frombuffer(b"".join(parts), np.uint32), np.cumsum(size) - size
            n = size[which]
            ids = flat[np.repeat(at[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            per = np.zeros(end - first + 1, np.int64)
            np.cumsum(np.bincount(doc, n, end - first).astype(np.int64), out=per[1:])
            out += [ids[per[k] : per[k + 1]] for k in range(end - first)]
        return out
