"""Problem 8: evaluation texts inside the corpus, by the q-gram lemma.

Texts are reduced to their words (runs of letters and digits, lower case) with one blank between. A window of `words` consecutive
words of an item that occurs in a document with at most `edits` character edits shares with it at least w - q + 1 - edits * q of its
q-grams (w its length), on diagonals at most `edits` apart. So: all q-grams of a batch of documents are looked up at once among the
items' q-grams, hits counted by document, item and diagonal band (bands overlap by half, so that every run of diagonals lies whole in
one), bands that reach the least bound of the item's windows kept, and these verified by alignment within the band: for the longest
run of equal whole words, and for windows within the edit budget.

Items are a fixed, small list (benchmark); a list of any size is worked off in blocks of MOST_ITEMS, so what is broadcast stays
bounded. Documents are read once for a block, only key and text, and never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS, EDITS = 12, 2
#: Longest q-gram: eight bytes make one 64-bit number.
MOST_Q = 8
BAND = 8
MOST_ITEMS = 20_000
PORTION = 4 << 20
#: Places of eight-byte q-grams of a document that are looked up: every so many.
STRIDE = 4
#: Hits that are written out at a time.
MOST_HITS = 4 << 20
_BITS = 20
_WORD = re.compile(r"[^\W_]+")


def plain(text: str | None) -> str:
    return " ".join(_WORD.findall(text)).lower() if text else ""


def _windows(text: str, words: int) -> list[tuple[int, int]]:
    """Begin and end in bytes of the windows of `words` words of a plain text."""
    data = text.encode()
    blanks = [i for i, b in enumerate(data) if b == 32]
    starts, ends = [0, *(i + 1 for i in blanks)], [*blanks, len(data)]
    return list(zip(starts, ends[words - 1 :])) if data else []


class Passages:
    """Finds the items' passages in plain() documents: one filter for all items that can have the same q and stride, so a few items of
    short words do not shorten the q-grams of the others."""

    def __init__(self, items: list[tuple[int, str]], words: int = WORDS, edits: int = EDITS):
        kinds: dict[tuple[int, int], list] = {}
        for key, text in items:
            t = plain(text)
            windows = _windows(t, words)
            if windows:
                shortest = min(b - a for a, b in windows)
                q = max(1, min(MOST_Q, shortest // (edits + 1)))
                # See QGramFilter: the wide stride needs windows of which, after all edits, a looked-up q-gram is left for certain.
                wide = q == MOST_Q and shortest - q + 1 - edits * q - (STRIDE - 1) * (edits + 1) >= 1
                kinds.setdefault((q, STRIDE if wide else 1), []).append((key, t, windows))
        self.filters = [QGramFilter(some, q, stride, words, edits) for (q, stride), some in sorted(kinds.items())]

    def search(self, docs: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(document, item id, longest exact run in words, fewest edits of a window) of each item that a document holds."""
        return sorted(x for f in self.filters for x in f.search(docs))


class QGramFilter:
    """Finds passages of items (id, plain text, windows) in plain() documents."""

    def __init__(self, items: list[tuple[int, str, list[tuple[int, int]]]], q: int, stride: int, words: int = WORDS, edits: int = EDITS):
        self.words, self.edits, self.q = words, edits, q
        self.ids, self.windows = [i for i, _, _ in items], [w for _, _, w in items]
        self.texts = [np.frombuffer(t.encode(), np.uint8) for _, t, _ in items]
        # Of q-grams of eight bytes only those at every fourth place of the documents are looked up. The q-grams that `edits` edits leave
        # to a window are in edits + 1 runs at most, and a run of r has at least (r - 3) / 4 of those places.
        self.stride = stride
        # Of each window: the places of its q-grams, and how many of those looked up must be found.
        self.bounds, self.full = [], []
        for w in self.windows:
            a, b = np.array(w).T
            left = b - a - self.q + 1 - edits * self.q
            some = left - (self.stride - 1) * (edits + 1)
            end = np.maximum(a, b - self.q + 1)
            self.full.append((a, end, np.maximum(1, left)))
            self.bounds.append((a, end, np.maximum(1, -(-some // self.stride))))
        self.every_window = np.concatenate([np.stack(x) for x in self.bounds], 1) if self.bounds else np.zeros((3, 0), np.int64)
        self.window_count = np.array([len(w) for w in self.windows], np.int64)
        self.window_first = np.cumsum(self.window_count) - self.window_count
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        self.least = np.array([x[2].min() for x in self.bounds] or [1])
        grams = [self._grams(t) for t in self.texts]
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        every = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.grams, self.item, self.place = every[order], item[order], place[order]
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[self._slot(self.grams)] = True
        self.longest = max([len(t) for t in self.texts] or [0])

    def _grams(self, data: np.ndarray) -> np.ndarray:
        n = len(data) - self.q + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        # Doubling: after a step each number holds twice as many bytes; the last step overlaps if q is no power of two.
        out, held = data.astype(np.uint64), 1
        while held < self.q:
            more = min(held, self.q - held)
            out = out[:-more] | (out[more:] << np.uint64(8 * more))
            held += more
        return out

    @staticmethod
    def _slot(g: np.ndarray) -> np.ndarray:
        return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int64)

    def regions(self, docs: list[bytes], low_item: int = 0, high_item: int | None = None) -> list[tuple[int, int, int]]:
        """(document, item, first diagonal of the band) that reach the bound; diagonal = place in the document - place in the item.

        Hits are counted before they are written out. Over MOST_HITS the documents are taken in halves, a single document in two parts
        that overlap by more than the longest item, or, if it is short, the items in halves.
        """
        high_item = len(self.texts) if high_item is None else high_item
        if low_item == high_item or not docs:
            return []
        data = b"\n".join(docs)
        starts = np.cumsum([0] + [len(d) + 1 for d in docs[:-1]])
        if self.stride > 1:
            half_grams = np.frombuffer(data + b"\n" * (-len(data) % 4), "<u4").astype(np.uint64)
            g = half_grams[:-1] | (half_grams[1:] << np.uint64(32))
        else:
            g = self._grams(np.frombuffer(data, np.uint8))
        at = np.flatnonzero(self.maybe[self._slot(g)])
        found = g[at]
        at = at * self.stride
        low, high = np.searchsorted(self.grams, found, "left"), np.searchsorted(self.grams, found, "right")
        times = high - low
        at, low, times = at[times > 0], low[times > 0], times[times > 0]
        if not len(at):
            return []
        if int(times.sum()) > MOST_HITS:
            half, room = len(docs) // 2, 2 * (self.longest + BAND + self.edits)
            if half:
                return self.regions(docs[:half], low_item, high_item) + [(half + d, i, f) for d, i, f in self.regions(docs[half:], low_item, high_item)]
            if len(docs[0]) > 4 * room:
                begin = len(docs[0]) // 2 // STRIDE * STRIDE
                left, right = self.regions([docs[0][: begin + room]], low_item, high_item), self.regions([docs[0][begin:]], low_item, high_item)
                return left + [(d, i, f + begin) for d, i, f in right]
            if high_item - low_item > 1:
                middle = (low_item + high_item) // 2
                return self.regions(docs, low_item, middle) + self.regions(docs, middle, high_item)
        doc = np.searchsorted(starts, at, "right") - 1
        entry = np.repeat(low - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        item, diagonal = self.item[entry], np.repeat(at - starts[doc], times) - self.place[entry] + self.longest
        doc = np.repeat(doc, times)
        if high_item - low_item < len(self.texts):
            mine = (item >= low_item) & (item < high_item)
            entry, item, diagonal, doc = entry[mine], item[mine], diagonal[mine], doc[mine]
            if not len(entry):
                return []
        key = (doc.astype(np.int64) << 41) | (item.astype(np.int64) << 26)
        half = BAND // 2
        # Band b holds the diagonals b * half to b * half + BAND - 1, so each diagonal is in two bands.
        bands = np.concatenate([key | (diagonal // half), (key | (diagonal // half - 1))[diagonal >= half]])
        bands, hits = np.unique(bands, return_counts=True)
        items = (bands >> 26) & 0x7FFF
        bands = bands[hits >= self.least[items]]
        if not len(bands):
            return []
        # The lemma holds for each window on its own: of its q-grams, at places of the item, enough must lie in the band.
        own, place = key | (diagonal // half), self.place[entry]
        order = np.argsort(own, kind="stable")
        own, place = own[order], place[order]
        kept = [self._with_window(bands[i : i + 20_000], own, place) for i in range(0, len(bands), 20_000)]
        return [(int(b >> 41), int((b >> 26) & 0x7FFF), int(b & 0x3FFFFFF) * half - self.longest) for part in kept for b in part]

    def _with_window(self, bands: np.ndarray, own: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The bands in which the hits (sorted by half band) suffice for one window of the item."""
        item = (bands >> 26) & 0x7FFF
        ends = np.cumsum(self.lengths[item] + 1)
        base = ends - self.lengths[item] - 1
        seen = np.zeros(ends[-1] + 1, np.int32)
        for part in (bands, bands + 1):
            low, many = np.searchsorted(own, part, "left"), np.searchsorted(own, part, "right")
            many = many - low
            hit = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
            seen[np.repeat(base, many) + place[hit] + 1] = 1
        total = np.cumsum(seen)
        many = self.window_count[item]
        first = np.cumsum(many) - many
        w = np.repeat(self.window_first[item] - first, many) + np.arange(many.sum())
        begin, end, bound = self.every_window[:, w]
        at = np.repeat(base, many)
        return bands[np.logical_or.reduceat(total[at + end] - total[at + begin] >= bound, first)]

    def diagonals(self, data: np.ndarray, item: int, first: int) -> np.ndarray:
        """Equality of the item with the document on each diagonal of the band; one row a diagonal."""
        text = self.texts[item]
        a, b = max(0, first), min(len(data), first + len(text) + BAND - 1)
        part = np.full(len(text) + BAND - 1, 10, np.uint8)
        if a < b:
            part[a - first : b - first] = data[a:b]
        return np.lib.stride_tricks.sliding_window_view(part, len(text)) == text

    def reaching(self, same: np.ndarray, item: int) -> np.ndarray:
        """The lemma with all q-grams: the windows that have as many in the band as their edits must leave."""
        total = np.cumsum(same, 1, dtype=np.int32)
        whole = total[:, self.q - 1 :].copy()
        whole[:, 1:] -= total[:, : -self.q]
        seen = np.concatenate([[0], np.cumsum((whole == self.q).any(0), dtype=np.int32)])
        begin, end, bound = self.full[item]
        return np.flatnonzero(seen[end] - seen[begin] >= bound)

    def exact_run(self, data: np.ndarray, item: int, first: int, equal: np.ndarray) -> int:
        """Most consecutive words of the item that stand whole in the document on one diagonal of the band."""
        text, best = self.texts[item], 0
        for d, same in enumerate(equal, first):
            edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).view(np.int8)))
            for s, e in zip(edges[::2], edges[1::2]):
                if e - s < 2 * self.words - 1:
                    continue
                # A word counts if it begins and ends in both texts within the run.
                run = text[s:e].tobytes()
                cut_left = s > 0 and text[s - 1] != 32 or s + d > 0 and data[s + d - 1] != 32
                cut_right = e < len(text) and text[e] != 32 or e + d < len(data) and data[e + d] != 32
                words = run.split(b" ")
                inner = words[1:] if cut_left and run[:1] != b" " else words
                inner = inner[:-1] if cut_right and run[-1:] != b" " else inner
                best = max(best, sum(1 for w in inner if w))
        return best

    def fewest_edits(self, data: np.ndarray, item: int, first: int, some: np.ndarray) -> int:
        """Fewest edits of one of some windows of the item in the document within the band; edits + 1 if none is within the budget."""
        k, most = self.edits, self.edits + 1
        text, windows = self.texts[item], [self.windows[item][w] for w in some]
        low, width = first - k, BAND + 2 * k
        offsets = np.arange(width)
        begin, length = np.array([a for a, _ in windows]), np.array([b - a for a, b in windows])
        cost = np.zeros((len(windows), width), np.int32)
        best = most
        padded = np.concatenate([text, np.zeros(1, np.uint8)])
        for i in range(int(length.max())):
            place = np.minimum(begin + i, len(text))
            target = place[:, None] + low + offsets[None]
            inside = (target >= 0) & (target < len(data))
            char = np.where(inside, data[np.clip(target, 0, len(data) - 1)], 10)
            through = cost + (char != padded[place][:, None])
            skipped = np.concatenate([cost[:, 1:] + 1, np.full((len(windows), 1), most)], 1)
            step = np.minimum(through, skipped)
            step = np.minimum.accumulate(step - offsets, 1) + offsets
            cost = np.minimum(step, most)
            done = length == i + 1
            if done.any():
                best = min(best, int(cost[done].min()))
            if best == 0:
                break
        return best

    def search(self, docs: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(document, item id, longest exact run in words, fewest edits of a window) of each item that a document holds.

        Documents are taken in portions of PORTION bytes (or one longer document), so memory does not follow the batch.
        """
        out, first, size = [], 0, 0
        for i, d in enumerate(docs):
            size += len(d)
            if size >= PORTION or i + 1 == len(docs):
                out += [(first + k, *rest) for k, *rest in self._search(docs[first : i + 1])]
                first, size = i + 1, 0
        return out

    def _search(self, docs: list[bytes]) -> list[tuple[int, int, int, int]]:
        best: dict[tuple[int, int], tuple[int, int]] = {}
        arrays: dict[int, np.ndarray] = {}
        for doc, item, first in self.regions(docs):
            data = arrays.setdefault(doc, np.frombuffer(docs[doc], np.uint8))
            same = self.diagonals(data, item, first)
            some = self.reaching(same, item)
            if not len(some):
                continue
            run, edits = best.get((doc, item), (0, self.edits + 1))
            run = max(run, self.exact_run(data, item, first, same))
            edits = 0 if run >= self.words else min(edits, self.fewest_edits(data, item, first, some))
            best[doc, item] = (run, edits)
        return [(d, self.ids[i], run, e) for (d, i), (run, e) in sorted(best.items()) if run >= self.words or e <= self.edits]


def leaked_passages(documents: DataFrame, items: DataFrame, words: int = WORDS, edits: int = EDITS) -> DataFrame:
    """doc_id, item_id, exact_words, edits of each document that holds a window of `words` words of an item within `edits` edits.

    exact_words is the longest run of the item's words that the document holds unchanged. Null and empty texts hold nothing; items of
    fewer words are never found; repeated rows of a document give one row each. Word runs are cut by everything but letters and
    digits, and the case of letters is ignored.
    """
    spark = documents.sparkSession
    picked = documents.select("doc_id", "text").where("text is not null")
    listed = items.select("item_id", "text").where("text is not null")
    blocks = max(1, -(-listed.count() // MOST_ITEMS))
    out = None
    for i in range(blocks):
        block = listed if blocks == 1 else listed.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i)
        shared = spark.sparkContext.broadcast(sorted((r.item_id, r.text) for r in block.collect()))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = Passages(shared.value, words, edits)
            for b in batches:
                keys = b.column(0)
                found = finder.search([plain(t).encode() for t in b.column(1).to_pylist()])
                at, item, exact, cost = zip(*found) if found else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int32())), pa.array(item, pa.int64()), pa.array(exact, pa.int32()), pa.array(cost, pa.int32())], names=["doc_id", "item_id", "exact_words", "edits"])

        part = picked.mapInArrow(run, "doc_id long, item_id long, exact_words int, edits int")
        out = part if out is None else out.unionByName(part)
    return out
