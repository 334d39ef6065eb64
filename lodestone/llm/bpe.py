"""Problem 7: token ids of a public byte-level BPE vocabulary, by backtracking over longest matches.

A pre-token (a match of the vocabulary's split pattern) is encoded left to right: the automaton over the vocabulary gives the longest
token that matches at each place, by a prefix search there (its failure links are not followed); it is tried first. A token may follow another only if the pair is compatible,
that is, if BPE merging applied to their joined bytes gives just these two tokens back; answers are kept in a table. If nothing fits
behind the tokens so far, the last one is taken back and replaced by the next shorter one. Places from which a try failed are
marked, so each is tried once and the work is linear in the length (times the longest token at worst). The outcome is exactly the one BPE merging gives.

Encodings of pre-tokens are kept in a table per task, since words repeat; it is emptied when large, which costs time only.

Decoding uses one byte string of all tokens and a table of offsets.
"""

from __future__ import annotations

import base64
import re
import sys
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The file of the vocabulary among the public tokenizers, and the pattern that its texts are split by (fixed values).
VOCABULARY = "byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Folder of the public vocabularies, unless given.
TOKENIZERS = "/opt/tokenizers"
_KEPT = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


class _Known(dict):
    """Encodings of pre-tokens met so far."""

    def __init__(self, coder: BacktrackingEncoder):
        self.coder = coder

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > _KEPT:
            self.clear()
        # A lone surrogate cannot come out of Spark; it would count as the replacement character.
        got = self[word] = tuple(self.coder.encode_piece(word.encode("utf-8", "replace")))
        return got


class BacktrackingEncoder:
    """Encoder and decoder over a table of token bytes to ranks in which every single byte is a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import ahocorasick
        import regex

        self.split_any = regex.compile(pattern).findall
        # On ASCII texts the standard library's automaton gives the same pieces in a third of the time.
        self.split_ascii = re.compile(pattern.replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9").replace(" ?a-zA-Z+", " ?[a-zA-Z]+").replace(" ?0-9+", " ?[0-9]+"), re.ASCII).findall
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.by_text = {t.decode("latin-1"): i for t, i in ranks.items()}
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, i in self.by_text.items():
            self.trie.add_word(t, i)
        self.trie.make_automaton()
        self.sizes = [len(self.tokens.get(i, b"")) for i in range(max(ranks.values()) + 1)]
        self.most = max(self.sizes)
        self.next_shorter: dict[str, int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.known = _Known(self)
        size = max(ranks.values()) + 1
        self.offsets = np.zeros(size + 1, np.int64)
        for i, t in self.tokens.items():
            self.offsets[i + 1] = len(t)
        self.offsets = np.cumsum(self.offsets)
        self.blob = b"".join(self.tokens.get(i, b"") for i in range(size))

    def merged(self, data: bytes) -> list[int]:
        """Plain BPE merging: the pair of lowest rank first, the leftmost of equals. Only for short strings: the pair table asks it."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives both back."""
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            known = self.fits[left, right] = self._compatible(left, right)
        return known

    def _halves(self, token: int) -> tuple[int, int]:
        """The two tokens that the last merge made this token of; (token, token) for a single byte."""
        got = self.parts.get(token)
        if got is None:
            data, limit = self.tokens[token], token
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if rank >= limit:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            got = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (token, token)
            self.parts[token] = got
        return got

    def _compatible(self, left: int, right: int) -> bool:
        # The pair is undone merge by merge, the later merge first; it is incompatible if a merge across the border would have come earlier.
        limit = 1 << 60
        while True:
            across = self.ranks.get(self.tokens[left] + self.tokens[right])
            if across is not None and across < limit:
                return False
            if left > right:
                limit = left
                before, left = left, self._halves(left)[1]
                if left == before:
                    limit, before, right = right + 1, right, self._halves(right)[0]
                    if right == before:
                        return True
            else:
                limit = right + 1
                before, right = right, self._halves(right)[0]
                if right == before:
                    limit, before, left = left, left, self._halves(left)[1]
                    if left == before:
                        return True

    def _longest(self, text: str) -> int:
        """The longest token that the text begins with: the automaton bounds it, since not every prefix of a token is one."""
        n = self.trie.longest_prefix(text)
        got = self.by_text.get(text[:n])
        while got is None:
            n -= 1
            got = self.by_text.get(text[:n])
        return got

    def _shorter(self, text: str) -> int:
        """The longest token that this token's text begins with, itself left out; -1 for a single byte."""
        got = self.next_shorter.get(text)
        if got is None:
            got = self.next_shorter[text] = self._longest(text[:-1]) if len(text) > 1 else -1
        return got

    def encode_piece(self, data: bytes) -> list[int]:
        """Tokens of one pre-token."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n, text, longest, most = len(data), data.decode("latin-1"), self._longest, self.most
        fits, sizes = self.fits, self.sizes
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest(text[:most])
        while True:
            end = at + sizes[token]
            fit = not dead[end]
            if fit and out:
                last = out[-1]
                fit = fits.get((last, token))
                if fit is None:
                    fit = self.compatible(last, token)
            if fit:
                out.append(token)
                if end == n:
                    return out
                at = end
                token = longest(text[at : at + most])
                continue
            token = self._shorter(text[at:end])
            while token < 0:
                # Nothing fits here: the token before is taken back and its place tried with the next shorter one.
                dead[at] = 1
                taken = out.pop()
                at -= sizes[taken]
                token = self._shorter(text[at : at + sizes[taken]])

    def split(self, text: str) -> list[str]:
        return self.split_ascii(text) if text.isascii() else self.split_any(text)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.split(text))))

    def sizes_of(self, words: list[str]) -> list[int]:
        return [len(x) for x in map(self.known.__getitem__, words)]

    def count(self, text: str) -> int:
        return sum(map(len, map(self.known.__getitem__, self.split(text))))

    def decode_bytes(self, ids: list[int]) -> bytes:
        o, blob = self.offsets, self.blob
        return b"".join(blob[o[i] : o[i + 1]] for i in ids)

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def encoder(folder: str = TOKENIZERS, name: str = VOCABULARY) -> BacktrackingEncoder:
    return BacktrackingEncoder(load_ranks(f"{folder}/{name}"))


def shared_ranks(spark, folder: str = TOKENIZERS, name: str = VOCABULARY):
    """The vocabulary (a fixed file under 1 MB) as a broadcast variable, so that executors need no file."""
    with open(f"{folder}/{name}", "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def ranks_of(file_bytes: bytes) -> dict[bytes, int]:
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in file_bytes.splitlines() if line.strip())}


def worker_encoder(file_bytes: bytes) -> BacktrackingEncoder:
    """The encoder of this Python process: workers are reused, so tables outlive a task."""
    kept = sys.__dict__.setdefault("_lodestone_encoders", {})
    key = hash(file_bytes)
    if key not in kept:
        kept[key] = BacktrackingEncoder(ranks_of(file_bytes))
    return kept[key]


def token_ids(documents: DataFrame, folder: str = TOKENIZERS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and ids of each document; null and empty texts give an empty list, repeated rows one list each. Order and rows are kept.

    No shuffle: each batch is encoded where it is read. Only key and text are read.
    """
    vocabulary = shared_ranks(documents.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_encoder(vocabulary.value)
        for b in batches:
            lists = [coder.encode(t) if t else () for t in b.column(1).to_pylist()]
            ends = np.cumsum([0] + [len(x) for x in lists], dtype=np.int32)
            flat = np.fromiter(chain.from_iterable(lists), np.int32, int(ends[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {kind}, ids array<int>")


def decoded(encoded: DataFrame, folder: str = TOKENIZERS, key: str = "doc_id") -> DataFrame:
    """key and text of token_ids() rows."""
    vocabulary = shared_ranks(encoded.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_encoder(vocabulary.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([coder.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=[key, "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, "ids").mapInArrow(run, f"{key} {kind}, text string")
