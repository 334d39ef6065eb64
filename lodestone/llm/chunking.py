"""Problem 9: oversized texts cut at natural boundaries, by agglomerative merging.

A text of more than `limit` tokens is first cut into atomic segments: lines and sentences, where one is too long its clauses, then
words, then tokens. Boundaries have a strength: blank line, line, sentence, clause, word, none. All adjacent pairs are held in a
heap; the pair with the weakest boundary is merged first (of equals the one that makes the smaller segment, then the earlier), as
long as the segments and the overlap fit the limit together; a pair that does not fit is a cut. So the strongest boundaries remain.
Each later piece begins with the last `overlap` tokens of the piece before, or up to a quarter fewer in order to begin at a boundary.

Texts of at most `limit` bytes cannot have more tokens, so the JVM leaves them out before anything goes to Python; the rest is
encoded once, with the encoder of bpe.py. No shuffle.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import TOKENIZERS, BacktrackingEncoder, shared_ranks, worker_encoder

LIMIT, OVERLAP = 2048, 128
# The ends of sentences and clauses.
SENTENCE_ENDS = ".!?。！？…"
CLAUSE_ENDS = ",;:，；：、"
# Ends of lines and sentences, with the white space that belongs to the end.
# No branch can begin inside a run that an earlier place has tried, so the search is linear on padding of any kind.
_ENDS = re.compile(r"[\n\r]\s*+|(?<![.!?\u2026])[.!?\u2026]++(?=\s)|[\u3002\uff01\uff1f]++")
BLANK_LINE, LINE, SENTENCE, CLAUSE, WORD, NONE = 5, 4, 3, 2, 1, 0


def _strength(before: str, after: str) -> int:
    """Strength of the boundary between two neighbouring pre-tokens. A line break that begins the later one does not count yet."""
    if before.isspace():
        breaks = before.count("\n") or before.count("\r")
        return BLANK_LINE if breaks > 1 else LINE if breaks else NONE if after[0].isspace() else WORD
    if after.isspace():
        return NONE
    last = before[-1]
    if last in SENTENCE_ENDS and (after[0].isspace() or ord(last) > 0x2000):
        return SENTENCE
    if last in CLAUSE_ENDS and (after[0].isspace() or ord(last) > 0x2000):
        return CLAUSE
    return WORD if after[0].isspace() else NONE


def _units(coder: BacktrackingEncoder, words: list[str], sizes: list[int], most: int) -> list[tuple[int, int, int]]:
    """(start in characters, tokens, strength of the boundary before) of the atomic segments of a text in pre-tokens.

    A segment over `most` tokens is taken apart at the ends of its clauses; parts still over it at all words, then at all pre-tokens,
    then between characters. So the loop over single pre-tokens is the exception.
    """
    starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
    tokens = np.concatenate([[0], np.cumsum(np.fromiter(sizes, np.int64, len(sizes)))])
    at = np.unique(np.searchsorted(starts, [m.end() for m in _ENDS.finditer("".join(words))]))
    at = [int(i) for i in at if 0 < i < len(words)]
    out: list[tuple[int, int, int]] = []

    def add(a: int, b: int, strength: int, least: int) -> None:
        if tokens[b] - tokens[a] <= most:
            out.append((int(starts[a]), int(tokens[b] - tokens[a]), strength))
        elif b - a == 1:
            # A pre-token over the limit (a long run of one kind of character) is cut between characters; each part is counted anew.
            wide = max(1, most // 4)
            for k in range(0, len(words[a]), wide):
                out.append((int(starts[a]) + k, coder.count(words[a][k : k + wide]), strength if k == 0 else NONE))
        else:
            inner = [(i, s) for i in range(a + 1, b) if (s := _strength(words[i - 1], words[i])) >= least]
            for (i, s), (j, _) in zip([(a, strength), *inner], [*inner, (b, 0)]):
                add(i, j, s, WORD if least == CLAUSE else NONE)

    for a, b in zip([0, *at], [*at, len(words)]):
        add(a, b, BLANK_LINE if a == 0 else _strength(words[a - 1], words[a]), CLAUSE)
    return out


def _merge(sizes: list[int], strengths: list[int], most: int) -> list[int]:
    """Indexes of the units at which a segment begins after all merges."""
    n = len(sizes)
    size, nxt, prev, alive = sizes[:], list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(strengths[i], size[i - 1] + size[i], i) for i in range(1, n)]
    heapq.heapify(heap)
    while heap:
        strength, total, i = heapq.heappop(heap)
        if not alive[i]:
            continue
        left = prev[i]
        now = size[left] + size[i]
        if now > most:
            continue
        if now != total:
            heapq.heappush(heap, (strength, now, i))
            continue
        size[left] = now
        alive[i] = False
        nxt[left] = nxt[i]
        if nxt[i] < n:
            prev[nxt[i]] = left
    return [i for i in range(n) if alive[i]]


def split_text(coder: BacktrackingEncoder, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """(start, body start, end, tokens) of each piece in characters; the text from start to body start repeats the piece before.

    A text of at most `limit` tokens gives none.
    """
    words = coder.split(text)
    word_sizes = coder.sizes_of(words)
    if sum(word_sizes) <= limit:
        return []
    units = _units(coder, words, word_sizes, limit - overlap)
    cuts = [units[i][0] for i in _merge([u[1] for u in units], [u[2] for u in units], limit - overlap)]
    word_starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
    pieces: list[tuple[int, int, int, int]] = []
    start = 0
    for begin, end in zip(cuts, [*cuts[1:], len(text)]):
        if begin:
            start = _overlap_start(coder, text, words, word_sizes, word_starts, start, begin, overlap)
        tokens = coder.count(text[start:end])
        while tokens > limit and start < begin:
            # A token has at least one character's worth of bytes, so this rarely takes more than one step.
            start = min(begin, start + tokens - limit)
            tokens = coder.count(text[start:end])
        pieces.append((start, begin, end, tokens))
    return pieces


def _overlap_start(coder: BacktrackingEncoder, text: str, words: list[str], sizes: list[int], word_starts: np.ndarray, least: int, cut: int, overlap: int) -> int:
    """Where the piece that goes on at `cut` begins: at most `overlap` tokens before, not before the piece before."""
    i = int(np.searchsorted(word_starts, cut))
    held, best = 0, (NONE - 1, cut)
    if word_starts[i] == cut:
        while i and word_starts[i - 1] >= least and held + sizes[i - 1] <= overlap:
            i -= 1
            held += sizes[i]
            strength = _strength(words[i - 1], words[i]) if i else BLANK_LINE
            if best[0] <= strength or held * 4 < overlap * 3:
                best = (strength, int(word_starts[i]))
    if held * 4 >= overlap * 3 or i == 0 or int(word_starts[i]) == least:
        return best[1]
    # A long pre-token stands before the cut: its last tokens, from a whole character on.
    start = max(least, cut - coder.most * overlap)
    ids = coder.encode(text[start:cut])
    back = len(coder.decode_bytes(ids[-overlap:]).decode("utf-8", "ignore"))
    return max(start, cut - back)


def split_documents(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, piece_no (from 1), text, start_char, body_char, end_char, n_tokens of the pieces of each document over the limit.

    Documents of at most `limit` tokens, empty and null texts give no row; repeated rows one set of pieces each. The texts from
    body_char to end_char put together give the document again.
    """
    vocabulary = shared_ranks(documents.sparkSession, folder)
    schema = "doc_id long, piece_no int, text string, start_char int, body_char int, end_char int, n_tokens int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_encoder(vocabulary.value)
        for b in batches:
            rows = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows += [(key, k + 1, text[s:e], s, m, e, n) for k, (s, m, e, n) in enumerate(split_text(coder, text, limit, overlap))]
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
            columns = zip(*rows) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=[f.split()[0] for f in schema.split(", ")])

    return documents.where(F.octet_length("text") > limit).select("doc_id", "text").mapInArrow(run, schema)
