"""Problem 4: several values packed into one field, one row each.

A field is read as a lattice: atoms with possible delimiters between them. Quoted spans, and a title that follows a CWE number, are
atoms as a whole; any other delimiter may split or belong to an item. How likely a text is an item is learned from the whole column
by expectation-maximisation: the model holds the frequency of each item shape (letters and digits abstracted; a word before a hyphen
or colon stays, so that `cve-9-9` and `https://a.a/a` are values of their own) and for each delimiter how often it splits. The
E-step is a forward-backward pass over the lattices, the M-step a sum. The final split of each field is the best path (Viterbi).

Scale: fields are first reduced to patterns (shapes and delimiters) with counts, which are far fewer than rows; EM runs over patterns,
distributed, and returns to the driver some ten delimiter rates and the frequencies of the shapes that make up LEAST_SHARE of a field's
items or more, of which there can be 1 / LEAST_SHARE at most at any size. Rarer shapes count in the total and take the smoothed
probability of unseen ones. The rows are read once for the counts and once for the split.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import SCANNERS, STAND_INS, folded
from ..session import cut

ROUNDS = 3
#: Least share of a field's items that a shape must have for its own frequency.
LEAST_SHARE = 5e-5
#: Atoms of a field up to which every span of them may be an item; in longer fields spans of up to LONGEST atoms, and all that lie
#: between neighbouring delimiters of one kind (see reaches).
EVERY_SPAN, LONGEST = 64, 12

_DELIMITER = re.compile(r"\s*([,;|])\s*| *([/+&]) *|\s+(and)\s+| *([\r\n\t])\s*|( ) *", re.IGNORECASE)
_CWE = r"cwe[-_ ]?\d+"
_TITLE = re.compile(_CWE + r"\s*:\s*", re.IGNORECASE)
_TITLE_END = re.compile(r"(?:\s*[,;|/+&\r\n\t]|\s+and\s|\s)\s*(?:[,;|]\s*)*[\"']?" + _CWE + r"\b|(?:\s*[,;|])+\s*$", re.IGNORECASE)
_NAMES = {"\r": "line", "\n": "line", "\t": "tab", " ": "blank"}
_RUN = re.compile(r"([A-Za-z\u0080-￿]+)(?=(-|://)?)|(\d+)|([^A-Za-z0-9\u0080-￿])")


def shape(text: str) -> str:
    """The abstraction of an unquoted text."""
    return "".join((m[1].lower() if m[2] else "a") if m[1] else "9" if m[3] else m[4] for m in _RUN.finditer(text))


def _close(s: str, at: int, quote: str, end: int, listed: bool) -> int:
    """Place of the quote that closes the one at `at`, or -1. A doubled quote does not close, nor an escaped one in a bracketed list."""
    i = at + 1
    while i < end:
        if listed and s[i] == "\\":
            i += 2
            continue
        if s[i] == quote:
            if s[i + 1 : i + 2] == quote and i + 1 < end:
                i += 2
                continue
            return i
        i += 1
    return -1


def lattice(field: str) -> tuple[list[tuple[int, int]], list[str], list[str], dict[int, str]]:
    """Spans and shapes of the atoms, the delimiters between them, and the values of quoted atoms."""
    begin, end = len(field) - len(field.lstrip()), len(field.rstrip())
    listed = end - begin > 1 and field[begin] == "[" and field[end - 1] == "]"
    if listed:
        begin, end = begin + 1, end - 1
        begin += len(field[begin:end]) - len(field[begin:end].lstrip())
    spans, shapes, delimiters, quoted, at = [], [], [], {}, begin
    while True:
        stop = None
        if at < end and (field[at] == '"' or listed and field[at] == "'"):
            shut = _close(field, at, field[at], end, listed)
            if shut > 0 and (shut + 1 >= end or _DELIMITER.match(field, shut + 1, end)):
                inner, q = field[at + 1 : shut], field[at]
                if listed:
                    inner = re.sub(r"\\(.)", r"\1", inner)
                quoted[len(spans)] = inner.replace(q + q, q)
                stop, kind = shut + 1, '"'
        if stop is None and (title := _TITLE.match(field, at, end)):
            close = _TITLE_END.search(field, title.end(), end)
            stop = close.start() if close else end
            kind = "cwe-9: title"
        if stop is None:
            close = _DELIMITER.search(field, at, end)
            stop = close.start() if close else end
            kind = shape(field[at:stop])
        spans.append((at, stop))
        shapes.append(kind)
        mark = _DELIMITER.match(field, stop, end)
        if not mark or mark.end() == stop:
            # A blank between two plain words is a kind of its own: prose has many, lists hardly any.
            return spans, shapes, ["gap" if d == "blank" and shapes[i] == shapes[i + 1] == "a" else d for i, d in enumerate(delimiters)], quoted
        said = next(x for x in mark.groups() if x)
        delimiters.append(_NAMES.get(said, said.lower()))
        at = mark.end()


#: Belief about how often a delimiter splits, before any data. For those that rarely stand inside of a value it keeps FIRM_WEIGHT of
#: the weight of the data (lists of few kinds of values are else as well explained by whole fields as values), for the rest that of two places.
BELIEF = {",": 0.95, ";": 0.95, "|": 0.95, "line": 0.95, "tab": 0.95, "blank": 0.8, "gap": 0.3, "and": 0.8, "+": 0.8, "&": 0.5, "/": 0.3}
FIRM = {",", ";", "|", "line", "tab"}
FIRM_WEIGHT = 1.0
#: Price of each further atom of an item.
FURTHER = 0.3

_FIRST, _EACH, _UNSEEN, _UNSEEN_EACH, _FURTHER = math.log(0.05), math.log(0.5), math.log(1e-4), math.log(0.1), math.log(FURTHER)
_WHOLE = {'"', "cwe-9: title"}
_SAID = {"line": "\n", "tab": "\t", "blank": " ", "gap": " ", "and": " and "}


def reaches(delimiters: list[str]) -> list[list[int]]:
    """For each end the starts of spans, latest first.

    A long field has, besides spans of up to LONGEST atoms, those of any length that fill the room between neighbouring delimiters of
    a kind: of each kind alone, of each kind and the firm ones, of the firm ones, and of none (the whole field).
    """
    n = len(delimiters) + 1
    if n <= EVERY_SPAN:
        return [list(range(e - 1, -1, -1)) for e in range(1, n + 1)]
    starts = [set(range(max(0, e - LONGEST), e)) for e in range(1, n + 1)]
    kinds = set(delimiters)
    for splits in {frozenset(x) for d in kinds for x in ({d}, {d} | FIRM & kinds)} | {frozenset(FIRM & kinds), frozenset()}:
        begin = 0
        for e in range(1, n + 1):
            if e == n or delimiters[e - 1] in splits:
                starts[e - 1].add(begin)
                begin = e
    return [sorted(x, reverse=True) for x in starts]


class Model:
    """Frequencies of item shapes and rates at which delimiters split."""

    def __init__(self, shapes: dict[str, float] | None = None, rates: dict[str, float] | None = None, total: float | None = None, longest: int = 1):
        """total: sum over all shapes, the rare ones included; longest: most atoms of a shape."""
        self.total = total if total is not None else sum(shapes.values()) if shapes else 0.0
        self.shapes, self.rates, self.longest = shapes or {}, rates or {}, longest

    def item(self, kind: str | None, atoms: int) -> float:
        """Logarithm of the probability: the items of long fields are beyond the range of a float. kind None: a shape never seen."""
        # Before anything is learned every atom of an item costs the same; an unseen shape stays possible at any time.
        if not self.total:
            return _FIRST + atoms * _EACH
        seen, unseen = self.shapes.get(kind, 0.0) if kind is not None else 0.0, _UNSEEN + atoms * _UNSEEN_EACH
        if seen:
            known = math.log(seen) + (atoms - 1) * _FURTHER
            unseen = max(known, unseen) + math.log1p(math.exp(-abs(known - unseen)))
        return unseen - math.log(self.total + 1)

    def rate(self, delimiter: str) -> float:
        return min(0.999, max(0.001, self.rates.get(delimiter, BELIEF[delimiter])))

    def spans(self, shapes: list[str], delimiters: list[str]) -> list[list[tuple[int, float]]]:
        """For each end the spans (start, logarithm of the probability as an item whose inner delimiters do not split)."""
        out = []
        said, stay = [_SAID.get(d, d) for d in delimiters], [math.log(1 - self.rate(d)) for d in delimiters]
        for e, starts in enumerate(reaches(delimiters), 1):
            row, kind, keep, at = [], shapes[e - 1], 0.0, e - 1
            for s in starts:
                if s < at:
                    if (at == e - 1 and shapes[at] in _WHOLE) or any(x in _WHOLE for x in shapes[s:at]):
                        break
                    # Shapes of more atoms than any that was seen need not be spelt out.
                    kind = "".join(x + y for x, y in zip(shapes[s:at], said[s:at])) + kind if kind is not None and e - s <= self.longest else None
                    keep += sum(stay[s:at])
                    at = s
                row.append((s, self.item(kind, e - s) + keep))
            out.append(row)
        return out

    def expected(self, shapes: list[str], delimiters: list[str], shape_counts: dict, split_counts: dict, weight: float) -> None:
        """Adds the expected counts of a lattice: shape_counts[shape, atoms], split_counts[delimiter] = [splits, occurrences]."""
        spans, n = [[(s, math.exp(x)) for s, x in row] for row in self.spans(shapes, delimiters)], len(shapes)
        said = [_SAID.get(d, d) for d in delimiters]
        forward, backward = [1.0] + [0.0] * n, [0.0] * n + [1.0]
        cut_rate = [1.0] + [self.rate(d) for d in delimiters] + [1.0]
        for e in range(1, n + 1):
            forward[e] = cut_rate[e] * sum(forward[s] * p for s, p in spans[e - 1])
        for e in range(n, 0, -1):
            for s, p in spans[e - 1]:
                backward[s] += p * cut_rate[e] * backward[e]
        if not forward[n]:
            return
        for e in range(1, n + 1):
            for s, p in spans[e - 1]:
                x = forward[s] * p * cut_rate[e] * backward[e] / forward[n]
                if x > 1e-6:
                    shape_counts["".join(a + b for a, b in zip(shapes[s : e - 1], said[s : e - 1])) + shapes[e - 1], e - s] += weight * x
        for i, d in enumerate(delimiters, 1):
            split_counts[d][0] += weight * forward[i] * backward[i] / forward[n]
            split_counts[d][1] += weight

    def best(self, shapes: list[str], delimiters: list[str]) -> list[tuple[int, int]]:
        """Atoms (from, to) of each item on the best path."""
        spans, n = self.spans(shapes, delimiters), len(shapes)
        score, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
        for e in range(1, n + 1):
            edge = math.log(self.rate(delimiters[e - 1])) if e < n else 0.0
            for s, p in spans[e - 1]:
                x = score[s] + p + edge
                if x > score[e]:
                    score[e], back[e] = x, s
        out, e = [], n
        while e:
            out.append((back[e], e))
            e = back[e]
        return out[::-1]


def _patterns(fields: DataFrame) -> DataFrame:
    """field_name, shapes, delimiters, n: the different lattices and how often each occurs. Counted within a batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: dict[tuple, int] = defaultdict(int)
            for name, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                _, shapes, delimiters, _ = lattice(value)
                counts[name, tuple(shapes), tuple(delimiters)] += 1
            names, shapes, delimiters = zip(*counts) if counts else ((), (), ())
            texts = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(map(list, shapes), texts), pa.array(map(list, delimiters), texts), pa.array(counts.values(), pa.int64())], names=["field_name", "shapes", "delimiters", "n"])

    made = fields.select("field_name", "value").mapInArrow(run, "field_name string, shapes array<string>, delimiters array<string>, n long")
    return made.groupBy("field_name", "shapes", "delimiters").agg(F.sum("n").alias("n"))


def learn(fields: DataFrame, rounds: int = ROUNDS) -> dict[str, Model]:
    """A model for each field_name of fields (field_name, value)."""
    patterns = cut(_patterns(fields))
    models: dict[str, Model] = defaultdict(Model)
    for _ in range(rounds):
        now = dict(models)

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            shapes: dict[str, dict[tuple[str, int], float]] = defaultdict(lambda: defaultdict(float))
            splits: dict[str, dict[str, list[float]]] = defaultdict(lambda: defaultdict(lambda: [0.0, 0.0]))
            for b in batches:
                for name, atoms, delimiters, n in zip(*(c.to_pylist() for c in b.columns)):
                    now.get(name, Model()).expected(atoms, delimiters, shapes[name], splits[name], float(n))
            rows = [(f, "s", k, x, float(atoms)) for f, c in shapes.items() for (k, atoms), x in c.items()] + [(f, "d", k, *v) for f, c in splits.items() for k, v in c.items()]
            kinds = [pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)], names=["field_name", "kind", "name", "x", "y"])

        # Of a shape y is its number of atoms, of a delimiter the number of its places.
        parts = patterns.mapInArrow(run, "field_name string, kind string, name string, x double, y double")
        sums = parts.groupBy("field_name", "kind", "name").agg(F.sum("x").alias("x"), F.when(F.col("kind") == "s", F.max("y")).otherwise(F.sum("y")).alias("y"))
        sums = cut(sums.where("kind = 'd' or x > 0"))
        totals = sums.where("kind = 's'").groupBy("field_name").agg(F.sum("x").alias("total"))
        learned = sums.join(F.broadcast(totals), "field_name", "left").where(F.expr(f"kind = 'd' or x >= total * {LEAST_SHARE}")).collect()
        models = defaultdict(Model)
        for field in {r.field_name for r in learned}:
            mine = [r for r in learned if r.field_name == field]
            shapes = [r for r in mine if r.kind == "s"]
            rates = {r.name: (r.x + BELIEF[r.name] * (w := r.y * FIRM_WEIGHT if r.name in FIRM else 2)) / (r.y + w) for r in mine if r.kind == "d" and r.y}
            models[field] = Model({r.name: r.x for r in shapes}, rates, max((r.total for r in shapes), default=0.0), int(max((r.y for r in shapes), default=1)))
    return dict(models)


def split_field(model: Model, value: str, memo: dict | None = None) -> list[str]:
    """The items of one field, empty slots left out."""
    spans, shapes, delimiters, quoted = lattice(value)
    key = (tuple(shapes), tuple(delimiters))
    path = memo.get(key) if memo is not None else None
    if path is None:
        path = model.best(shapes, delimiters)
        if memo is not None:
            if len(memo) > 100_000:
                memo.clear()
            memo[key] = path
    items = [quoted[a].strip() if b == a + 1 and a in quoted else value[spans[a][0] : spans[b - 1][1]].strip() for a, b in path]
    return [x for x in items if x]


def split_values(fields: DataFrame, key: str = "seq", models: dict[str, Model] | None = None) -> DataFrame:
    """key, field_name, pos (from 1), item of each field (key, field_name, value) that holds two values or more.

    Null, blank and stand-in values give no row; empty slots take no position; repeated items and rows are kept.
    """
    given = fields.where(F.col("value").isNotNull() & ~folded(F.col("value")).isin(["", *STAND_INS])).select(key, "field_name", "value")
    learned = learn(given) if models is None else models
    kind = fields.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos: dict[str, dict] = defaultdict(dict)
        for b in batches:
            rows, names, places, items = [], [], [], []
            for i, (name, value) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                got = split_field(learned.get(name) or Model(), value, memos[name])
                if len(got) > 1:
                    rows += [i] * len(got)
                    names += [name] * len(got)
                    places += range(1, len(got) + 1)
                    items += got
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int32())), pa.array(names, pa.string()), pa.array(places, pa.int32()), pa.array(items, pa.string())], names=[key, "field_name", "pos", "item"])

    return given.mapInArrow(run, f"{key} {kind}, field_name string, pos int, item string")


def packed_findings(findings: DataFrame) -> DataFrame:
    """The packed fields of findings: cwe_id of rows from scanners, refs of all rows."""
    by_scanner = F.coalesce(folded(F.col("source")).isin(SCANNERS), F.lit(False))
    pairs = F.array(F.struct(F.lit("cwe_id").alias("field_name"), F.when(by_scanner, F.col("cwe_id")).alias("value")), F.struct(F.lit("refs").alias("field_name"), F.col("refs").alias("value")))
    return findings.select("seq", F.explode(pairs).alias("p")).select("seq", "p.field_name", "p.value")
