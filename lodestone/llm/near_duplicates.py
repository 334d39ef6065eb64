"""Problem 5: reports of one defect with small edits, by multi-index hashing.

Two reports are alike if they are about the same file, at most 5 lines apart, have different ids, and share at least 0.6 of the
distinct words of title and description.

Fingerprints. A report gets symbols of 8 bits, each the low byte of the smallest hash of its words under one hash function, so
that each symbol of two reports agrees with the probability of their similarity (and 1/256 of the rest). All words count, also those
that most rows of a block have: they are part of the similarity that defines a pair. The distance of two fingerprints is the number
of symbols that differ.

Tables. The fingerprint is cut into segments that cover it whole, each with a table keyed by the block (file and lines) and the segment's
content. Of each segment the Hamming ball of radius 1 is enumerated: one key for each symbol left open, which covers all contents that
differ in that symbol only. Rows that share a key are candidates; their complete distance, over all symbols, is verified, then the
exact similarity.

Segments are as long as the block asks for, by the usual rule that what is looked up should have about log2(rows of the block) bits. In
blocks of up to HOT rows: 16 segments of 2 symbols, so by the pigeonhole principle every pair at a distance of up to 31 of 32 is met. Up
to ALL_PAIRS rows: no segments, all pairs of fingerprints are compared. In larger ones: 72 segments of 8, since keys of fewer symbols would
make reports collide that have only boilerplate in common; a pair is met if a segment of it differs in one symbol at most. Expected recall
depends on the similarity only, not on how common the shared words are: 0.9997 at 0.6, and above that more. Tests and README hold figures
against brute force.

Lines: block number = line / 6. Rows at most 5 lines apart are in the same or in neighbouring blocks; each row is entered in its
own block, and carried into the next.

Movement. Block sizes are counted first, from ids, paths and lines only; the hot ones (more than HOT rows) are written as a table, which
the optimizer broadcasts if its files are small and joins by block otherwise. Rows of hot blocks are reduced to classes first (same file,
line and words), so copies meet nothing; pairs of classes become pairs of rows last. The segments of a hot block are dealt to up to
MOST_PARTS parts, and a class is sent to each part once, with the segments of the part: the keys for the symbols left open, the many that
they are, are made in the task. A task holds one part at a time. In blocks of over WHOLE rows a part is instead what agrees in one half
of one segment (if a segment differs in one symbol, one of its halves does not). Candidates are held against one bit of all symbols before
they are written: of pairs that are unlike, whose number grows with the square of a block, next to none gets on. Rows of cold blocks move
once, by stretches of 64 blocks of a file, and meet their tables within the task, in bounded portions. Project directories are looked up
in a broadcast set if there are at most MOST_TARGETS, else by a join.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import spelled, with_file_key
from ..functions.text import key_or_null
from ..session import checkpoint_dir, cut

THRESHOLD, LINES = 0.6, 5
#: Rows of a block from which it is hot.
HOT = 256
#: Most project directories looked up in memory (some 3 MB).
MOST_TARGETS = 100_000
#: Symbols in a segment and number of segments, in cold and in hot blocks.
COLD_SEGMENT, COLD_SEGMENTS = 2, 16
HOT_SEGMENT, HOT_SEGMENTS = 8, 72
#: Rows of a hot block up to which all pairs of fingerprints are compared.
ALL_PAIRS = 2_048
#: Rows of a hot block for each part that its segments are dealt to, most parts (a divisor of the segments), and rows up to which a part takes a block whole.
IN_PART, MOST_PARTS, WHOLE = 20_000, 12, 2_000_000
#: Least number of agreeing symbols of a candidate in cold blocks (expected at similarity 0.6: 19 of 32, standard deviation 2.8).
AGREEING = 9
#: In hot blocks one bit of each symbol is carried along, to verify the distance: most bits that differ (expected at 0.6: 115 of 576, standard deviation 9.6).
HOT_DIFFERING = 156

_SEEDS = np.random.default_rng(20240229).integers(1, 2**63, (2, HOT_SEGMENT * HOT_SEGMENTS), dtype=np.uint64)


def _words(title: str | None, description: str | None) -> set[str]:
    from re import findall

    return set(findall("[a-z0-9]+", f"{title or ''} {description or ''}".lower()))


def _word_hash(w: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(w)


class _Hashes(dict):
    """Hashes of words already met; emptied when large, which costs time only."""

    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[w] = _word_hash(w)
        return h


def fingerprints(sets: list[list[int]], symbols: int = HOT_SEGMENT * HOT_SEGMENTS) -> np.ndarray:
    """Symbols (uint8, one row for each set of word hashes); an empty set gives zeros."""
    out = np.zeros((len(sets), symbols), np.uint8)
    full = [i for i, s in enumerate(sets) if s]
    if full:
        flat = np.fromiter((h for i in full for h in sets[i]), np.uint64)
        starts = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
        for k in range(symbols):
            x = (flat ^ _SEEDS[1, k]) * (_SEEDS[0, k] | np.uint64(1))
            x ^= x >> np.uint64(32)
            x *= np.uint64(0x9E3779B97F4A7C15)
            low = np.minimum.reduceat(x, starts)
            out[full, k] = ((low * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(56)).astype(np.uint8)
    return out


def _table_keys(block: np.ndarray, prints: np.ndarray, size: int, segments: range) -> Iterator[np.ndarray]:
    """For each of the segments and each symbol left open: the table keys of all rows."""
    for s in segments:
        part = prints[:, s * size : (s + 1) * size].astype(np.uint64)
        for left_out in range(size):
            key = block ^ np.uint64(s * 16 + left_out + 1)
            for j in range(size):
                if j != left_out:
                    key = (key ^ part[:, j]) * np.uint64(0xC2B2AE3D27D4EB4F)
                    key ^= key >> np.uint64(29)
            yield key


def _alike(a: set[str], b: set[str]) -> bool:
    common = len(a & b)
    return common > 0 and common >= THRESHOLD * (len(a) + len(b) - common)


def _file_hash(path: str, targets: frozenset[str] | None) -> int:
    from re import sub

    if targets is not None:
        path = sub(r"[\\/]+", "/", path.strip(" \t\n\r\x0b\f\u00a0\u3000").lower())
        parts = path.split("/")
        path = next(("/".join(parts[i:]) for i, x in enumerate(parts) if x in targets), path)
    return _word_hash(path)


def _blocks(files: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (files * np.uint64(0xD6E8FEB86659FD93)) ^ (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _located(batch: pa.RecordBatch, targets: frozenset[str] | None, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the file and number of the block of each row (path, line)."""
    out = []
    for p in batch.column("path").to_pylist():
        h = known.get(p)
        if h is None:
            if len(known) > 200_000:
                known.clear()
            h = known[p] = _file_hash(p, targets)
        out.append(h)
    return np.array(out, np.uint64), batch.column("line").to_numpy().astype(np.int64) // (LINES + 1)


def _pairs_within(row: np.ndarray, own: int, seq: np.ndarray, ids: list[str], line: np.ndarray, words: list[set[str]], block: np.ndarray) -> set[tuple[int, int]]:
    """Alike pairs of rows of whole cold blocks, by tables sorted in memory. Entry i puts row[i] into block[i]; the first `own` are no carried ones."""
    cache = _Hashes()
    prints = fingerprints([[cache[w] for w in s] for s in words], COLD_SEGMENT * COLD_SEGMENTS)
    tried: set[tuple[int, int]] = set()
    found: set[tuple[int, int]] = set()
    for keys in _table_keys(block, prints[row], COLD_SEGMENT, range(COLD_SEGMENTS)):
        order = np.argsort(keys, kind="stable")
        keys, step = keys[order], 1
        # Entries of one key stand together; each is compared with the next ones as long as the key is the same.
        near = np.flatnonzero(keys[1:] == keys[:-1])
        while len(near):
            x, y = order[near], order[near + step]
            fit = (x < own) | (y < own)
            x, y = row[x[fit]], row[y[fit]]
            fit = (np.abs(line[x] - line[y]) <= LINES) & (seq[x] != seq[y])
            x, y = x[fit], y[fit]
            fit = (prints[x] == prints[y]).sum(1) >= AGREEING
            for i, j in zip(x[fit].tolist(), y[fit].tolist()):
                pair = (i, j) if seq[i] < seq[j] else (j, i)
                if pair not in tried:
                    tried.add(pair)
                    if ids[i] != ids[j] and _alike(words[i], words[j]):
                        found.add((int(seq[pair[0]]), int(seq[pair[1]])))
            step += 1
            near = near[near + step < len(keys)]
            near = near[keys[near] == keys[near + step]]
    return found


_PORTION = 20_000


def _cold_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of rows (stretch, block, after, own, carried, seq, id_key, line, text) sorted by stretch."""
    held: list[pa.RecordBatch] = []

    def flush(rows: pa.Table) -> pa.RecordBatch:
        c = {n: rows.column(n) for n in rows.column_names}
        words = [_words(t, None) for t in c["text"].to_pylist()]
        own, carried = np.flatnonzero(c["own"].to_numpy()), np.flatnonzero(c["carried"].to_numpy())
        block = np.concatenate([c["block"].to_numpy()[own], c["after"].to_numpy()[carried]]).view(np.uint64)
        got = _pairs_within(np.concatenate([own, carried]), len(own), c["seq"].to_numpy(), c["id_key"].to_pylist(), c["line"].to_numpy().astype(np.int64), words, block)
        a, b = zip(*got) if got else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["seq_a", "seq_b"])

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= _PORTION:
            rows = pa.Table.from_batches(held)
            stretch = rows.column("stretch").to_numpy()
            whole = int(np.searchsorted(stretch != stretch[-1], False)) if stretch[0] == stretch[-1] else int(np.flatnonzero(stretch != stretch[-1])[-1]) + 1
            if whole:
                yield flush(rows.slice(0, whole))
                held = rows.slice(whole).to_batches()
    if held:
        yield flush(pa.Table.from_batches(held))


_ENTRIES = 100_000
#: Candidates gathered before copies among them are dropped.
_GATHERED = 2_000_000


def _parts(block: np.ndarray, size: np.ndarray, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows of blocks of the given sizes (0: not hot): rows chosen, key of the part that each is sent to, symbols to be sent."""
    symbols = prints.reshape(len(prints), HOT_SEGMENTS, HOT_SEGMENT)
    rows = np.flatnonzero((size > 0) & (size <= ALL_PAIRS))
    if len(rows):
        yield rows, block[rows], prints[rows, :0]
    parts = np.where((size > ALL_PAIRS) & (size <= WHOLE), np.minimum(-(-size // IN_PART), MOST_PARTS), 0)
    for n in np.unique(parts[parts > 0]).tolist():
        rows = np.flatnonzero(parts == n)
        for i in range(n):
            yield rows, block[rows] ^ np.uint64((i + 1) * 0x9FB21C651E98DF25 % 2**64), symbols[rows, i::n].reshape(len(rows), -1)
    rows = np.flatnonzero(size > WHOLE)
    if len(rows):
        half = HOT_SEGMENT // 2
        for s in range(HOT_SEGMENTS):
            for at in (0, half):
                key = block[rows] ^ np.uint64((2 * s + at + 1) * 0xD6E8FEB86659FD93 % 2**64)
                for j in range(at, at + half):
                    key = (key ^ symbols[rows, s, j].astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
                    key ^= key >> np.uint64(29)
                yield rows, key, symbols[rows, s, half - at : HOT_SEGMENT - at]


def _binary(a: np.ndarray) -> pa.Array:
    """The rows of bytes as values."""
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(np.arange(len(a) + 1, dtype=np.int32) * np.int32(a.shape[1])), pa.py_buffer(np.ascontiguousarray(a))])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries (part, rep, carried, bits, symbols) of classes (block, after, own_n, after_n, rep, text) for each part that they are sent to."""
    cache = _Hashes()
    for b in batches:
        prints = fingerprints([[cache[w] for w in _words(t, None)] for t in b.column("text").to_pylist()])
        bits, rep = np.packbits(prints & 1, axis=1), b.column("rep").to_numpy()
        for at, n, carried in (("block", "own_n", False), ("after", "after_n", True)):
            sizes = b.column(n).fill_null(0).to_numpy()
            for rows, part, symbols in _parts(b.column(at).to_numpy().view(np.uint64), sizes, prints):
                yield pa.RecordBatch.from_arrays([pa.array(part.view(np.int64)), pa.array(rep[rows]), pa.array(np.full(len(rows), carried)), _binary(bits[rows]), _binary(symbols)], names=["part", "rep", "carried", "bits", "symbols"])


def _near(part: np.ndarray, rep: np.ndarray, carried: np.ndarray, bits: np.ndarray, symbols: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Candidates among entries of whole parts with as many symbols each."""
    width, gathered, held = symbols.shape[1], [], 0

    def candidates() -> pa.RecordBatch:
        x, y = np.divmod(np.unique(np.concatenate(gathered)), len(rep))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[x], rep[y])), pa.array(np.maximum(rep[x], rep[y]))], names=["rep_a", "rep_b"])

    size = min(HOT_SEGMENT, width)
    for keys in _table_keys(part, symbols, size, range(width // size)) if width else [part]:
        order = np.argsort(keys, kind="stable")
        keys, step = keys[order], 1
        near = np.flatnonzero(keys[1:] == keys[:-1])
        while len(near):
            x, y = order[near], order[near + step]
            fit = (part[x] == part[y]) & (rep[x] != rep[y]) & ~(carried[x] & carried[y])
            x, y = x[fit], y[fit]
            fit = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int32) <= HOT_DIFFERING
            x, y = x[fit], y[fit]
            if len(x):
                gathered.append(np.minimum(x, y) * len(rep) + np.maximum(x, y))
                held += len(x)
                if held > _GATHERED:
                    yield candidates()
                    gathered, held = [], 0
            step += 1
            near = near[near + step < len(keys)]
            near = near[keys[near] == keys[near + step]]
    if gathered:
        yield candidates()


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates (rep_a, rep_b) of entries sorted by part: some symbols agree, and near enough in the complete distance."""
    held: list[tuple[np.ndarray, ...]] = []

    def flat(c: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ends = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
        data = c.buffers()[2]
        return np.frombuffer(data if data is not None else b"", np.uint8)[ends[0] : ends[-1]], np.diff(ends)

    def flush(rows: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        # Entries of one part have as many symbols each; parts of a length are taken together.
        for w in sorted({r[4].shape[1] for r in rows}):
            yield from _near(*[np.concatenate([r[i] for r in rows if r[4].shape[1] == w]) for i in range(5)])

    for b in batches:
        if not b.num_rows:
            continue
        part, rep, carried = (b.column(n).to_numpy(zero_copy_only=False) for n in ("part", "rep", "carried"))
        bits = flat(b.column("bits"))[0].reshape(b.num_rows, -1)
        bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.uint64)
        symbols, widths = flat(b.column("symbols"))
        starts = np.concatenate([[0], np.cumsum(widths)])
        cuts = [0, *(np.flatnonzero(np.diff(part) != 0) + 1).tolist(), b.num_rows]
        # Runs of entries of one width within the batch, cut where the last part of it begins.
        cuts = [c for c in cuts if c in (0, b.num_rows) or widths[c] != widths[c - 1] or c == cuts[-2]]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and part[lo] != held[-1][0][-1] and sum(len(h[0]) for h in held) >= _ENTRIES:
                done, held = held, []
                yield from flush(done)
            held.append((part[lo:hi].view(np.uint64), rep[lo:hi].copy(), carried[lo:hi].copy(), bits[lo:hi].copy(), symbols[starts[lo] : starts[hi]].reshape(hi - lo, -1).copy()))
    if held:
        yield from flush(held)


def _stored(df: DataFrame, schema: str, name: str) -> DataFrame:
    """Written to the checkpoint folder, in files so small that work on them spreads; the optimizer knows their size."""
    at = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", 5_000).parquet(at)
    return df.sparkSession.read.schema(schema).parquet(at)


#: Rows of a class from which its pairs are made in more than one task.
_SHARE = 2_000


def _hot_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of rows (block, after, own_n, after_n, seq, id_key, line, text) of hot blocks; own_n and after_n are the blocks' sizes, null where they are not hot."""

    def words(text: str) -> Column:
        return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))

    said = rows.withColumn("words", F.array_sort(words("text"))).where("size(words) > 0").withColumn("said", F.md5(F.array_join("words", " "))).drop("words")
    fields = "block long, after long, own_n long, after_n long, seq long, id_key string, line int, text string, said string"
    rows = _stored(said.select([f.split()[0] for f in fields.split(", ")]), fields, "hot-rows")
    place = ["block", "line", "said"]
    same = [F.first(n).alias(n) for n in ("after", "own_n", "after_n", "text")]
    classes = rows.groupBy(*place).agg(F.min("seq").alias("rep"), F.count("*").alias("n"), F.min("id_key").alias("least"), F.max("id_key").alias("most"), *same)
    classes = _stored(classes, "block long, line int, said string, rep long, n long, least string, most string, after long, own_n long, after_n long, text string", "classes")
    made = classes.select("block", "after", "own_n", "after_n", "rep", "text").mapInArrow(_entries, "part long, rep long, carried boolean, bits binary, symbols binary")
    near = made.repartition("part").sortWithinPartitions("part").mapInArrow(_met, "rep_a long, rep_b long").distinct()
    left, right = (classes.select(F.col("rep").alias(f"rep_{x}"), F.col("n").alias(f"n_{x}"), F.col("line").alias(f"line_{x}"), words("text").alias(f"words_{x}")) for x in "ab")
    both = near.join(left, "rep_a").join(right, "rep_b").where(f"abs(line_a - line_b) <= {LINES}")
    shared = F.size(F.array_intersect("words_a", "words_b"))
    alike = both.where((shared > 0) & (shared >= (F.size("words_a") + F.size("words_b") - shared) * THRESHOLD)).select("rep_a", "rep_b", "n_b")
    # Copies pair up in their own block; where that is cold, its tables find them.
    alike = alike.unionByName(classes.where("own_n is not null and least != most").select(F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b"), F.col("n").alias("n_b")))
    # From pairs of classes to pairs of rows; large classes in shares, so that no task makes all pairs of one.
    members = rows.join(classes.select(*place, "rep", "n"), place)
    first = members.select(F.col("rep").alias("rep_a"), F.col("seq").alias("seq_a"), F.col("id_key").alias("id_a"))
    second = members.select(F.col("rep").alias("rep_b"), F.expr(f"pmod(xxhash64(seq), n div {_SHARE} + 1)").alias("share"), F.col("seq").alias("seq_b"), F.col("id_key").alias("id_b"))
    pairs = alike.withColumn("share", F.explode(F.expr(f"sequence(0L, n_b div {_SHARE})"))).join(first, "rep_a").join(second, ["rep_b", "share"])
    pairs = pairs.where("id_a != id_b and (rep_a != rep_b or seq_a < seq_b)")
    return pairs.select(F.least("seq_a", "seq_b").alias("seq_a"), F.greatest("seq_a", "seq_b").alias("seq_b"))


def similar_reports(findings: DataFrame, scans: DataFrame) -> DataFrame:
    """seq_a, seq_b (smaller first) of each pair of reports that are alike.

    Rows with null or blank id, null path or null line are in no pair; rows without any word are similar to none. Repeated rows of
    one id are no pair.
    """
    spark = findings.sparkSession
    rows = findings.select("seq", key_or_null(F.col("finding_id")).alias("id_key"), F.col("file_path").alias("path"), F.col("line_number").cast("int").alias("line"), "title", "description")
    rows = rows.where("id_key is not null and line is not null and path is not null")
    names = scans.select(F.element_at(F.filter(F.split(spelled(F.col("target_path")), "/"), lambda x: x != ""), -1).alias("seg")).where("seg is not null").distinct().limit(MOST_TARGETS + 1).toPandas()["seg"]
    if len(names) <= MOST_TARGETS:
        targets = spark.sparkContext.broadcast(frozenset(names))
    else:
        targets = spark.sparkContext.broadcast(None)
        rows = with_file_key(rows, scans, "path", "file_key").drop("path").withColumnRenamed("file_key", "path")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            files, place = _located(b, targets.value, known)
            block = np.concatenate([_blocks(files, place), _blocks(files, place + 1)])
            own = np.repeat([1, 0], len(files))
            yield pa.RecordBatch.from_arrays([pa.array(block.view(np.int64)), pa.array(own.astype(np.int64))], names=["block", "own"])

    sizes = rows.select("path", "line").mapInArrow(places, "block long, own long").groupBy("block").agg(F.count("*").alias("n"), F.sum("own").alias("own")).where(f"n > {HOT}")
    at = f"{checkpoint_dir(spark)}/hot-{uuid.uuid4().hex}"
    # Blocks with carried rows only have no pair; their rows go nowhere.
    sizes.select("block", (F.col("own") > 0).alias("met"), "n").write.parquet(at)
    hot = spark.read.schema("block long, met boolean, n long").parquet(at)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            files, place = _located(b, targets.value, known)
            made = [_blocks(files, place), _blocks(files, place + 1), *(_blocks(files ^ np.uint64(1), p // 64) for p in (place, place + 1))]
            yield pa.RecordBatch.from_arrays([*[pa.array(x.view(np.int64)) for x in made], *[b.column(x) for x in ("seq", "id_key", "line", "text")]], names=["block", "after", "stretch", "next", "seq", "id_key", "line", "text"])

    text = rows.select("seq", "id_key", "path", "line", F.concat_ws(" ", "title", "description").alias("text"))
    spread = text.mapInArrow(placed, "block long, after long, stretch long, next long, seq long, id_key string, line int, text string")
    own_hot, after_hot = (hot.select(F.col("block").alias(b), F.col("met").alias(f"{x}_met"), F.when(F.col("met"), F.col("n")).alias(f"{x}_n")) for b, x in (("block", "own"), ("after", "after")))
    marked = spread.join(own_hot, "block", "left").join(after_hot, "after", "left")
    own_cold, after_cold, same = F.col("own_met").isNull(), F.col("after_met").isNull(), F.col("stretch") == F.col("next")

    def routed(*ways: tuple[Column, Column, Column, Column]) -> DataFrame:
        """A copy of each row for each way that is open to it: (open, key, whether as own, whether as carried row)."""
        each = F.explode(F.filter(F.array(*[F.struct(o.alias("open"), k.alias("key"), x.alias("own"), c.alias("carried")) for o, k, x, c in ways]), lambda w: w["open"]))
        return marked.select("block", "after", "seq", "id_key", "line", "text", each.alias("w")).select("*", "w.key", "w.own", "w.carried").drop("w")

    # A row is sent to its cold stretch once, with both blocks; into the next stretch if it is carried over the border.
    yes, no = F.lit(True), F.lit(False)
    cold = routed((own_cold | after_cold & same, F.col("stretch"), own_cold, after_cold & same), (after_cold & ~same, F.col("next"), no, yes)).withColumnRenamed("key", "stretch")
    found = cold.repartition("stretch").sortWithinPartitions("stretch").mapInArrow(_cold_pairs, "seq_a long, seq_b long")
    if hot.isEmpty():
        return found
    return found.unionByName(_hot_pairs(marked.where("own_n is not null or after_n is not null")))


def _components(edges: DataFrame, most_rounds: int) -> DataFrame:
    """u, root (smallest v reached) of the u that are not roots themselves, for edges (u, v), by alternating large-star and small-star
    steps; each round is cut through the checkpoint folder. Only a count comes to the driver."""
    before = None
    for _ in range(most_rounds):
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        edges = cut(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.groupBy("u").agg(F.min("v").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def similar_groups(findings: DataFrame, scans: DataFrame, most_rounds: int = 30) -> DataFrame:
    """seq, group_id (smallest seq reached over links) and links (number of reports alike) of each report that has any.

    Reports of one place (path as written, line) with the same words form a class; only one of each class is held against the others, so
    copies never become pairs. A report is alike to all of its own and of the linked classes but those with its own id: their number is
    the size of these classes less the rows of its id in them. Two classes hang together unless both have one and the same id only.
    """
    rows = findings.select("seq", key_or_null(F.col("finding_id")).alias("id_key"), "file_path", "line_number", "title", "description")
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "title", "description")), F.lit("[a-z0-9]+"), F.lit(0))))
    place = ["file_path", "line_number", "said"]
    rows = rows.where("id_key is not null and file_path is not null and line_number is not null").withColumn("said", words).where("size(said) > 0").withColumn("said", F.md5(F.array_join("said", " ")))
    classes = cut(rows.groupBy(*place).agg(F.min(F.struct("seq", "title", "description")).alias("r"), F.count("*").alias("n"), F.min("id_key").alias("least"), F.max("id_key").alias("most")))
    shown = classes.select(F.col("r.seq").alias("seq"), F.col("r.seq").cast("string").alias("finding_id"), "file_path", "line_number", "r.title", "r.description")
    pairs = cut(similar_reports(shown, scans))
    known = classes.select(F.col("r.seq").alias("rep"), "n", "least", "most")
    member = rows.join(classes.select(*place, F.col("r.seq").alias("rep")), place).select("seq", "id_key", "rep")
    ids = cut(member.groupBy("rep", "id_key").agg(F.count("*").alias("own")))
    both = pairs.select(F.col("seq_a").alias("u"), F.col("seq_b").alias("v")).unionByName(pairs.select(F.col("seq_b").alias("u"), F.col("seq_a").alias("v")))
    others = both.join(known.select(F.col("rep").alias("v"), F.col("n").alias("m")), "v").groupBy(F.col("u").alias("rep")).agg(F.sum("m").alias("around"))
    # An id in several classes: its rows in linked classes are not alike.
    split = ids.join(ids.groupBy("id_key").agg(F.count("*").alias("k")).where("k > 1"), "id_key", "left_semi")
    there = split.select(F.col("rep").alias("v"), "id_key", F.col("own").alias("m"))
    again = split.withColumnRenamed("rep", "u").join(both, "u").join(there, ["v", "id_key"]).groupBy(F.col("u").alias("rep"), "id_key").agg(F.sum("m").alias("again"))
    counted = ids.join(known, "rep").join(others, "rep", "left").join(again, ["rep", "id_key"], "left")
    links = counted.select("rep", "id_key", (F.col("n") + F.coalesce("around", F.lit(0)) - F.col("own") - F.coalesce("again", F.lit(0))).alias("links")).where("links > 0")
    one_id = [known.where("least = most").select(F.col("rep").alias(f"seq_{x}"), F.col("least").alias(f"id_{x}")) for x in "ab"]
    tied = pairs.join(one_id[0], "seq_a", "left").join(one_id[1], "seq_b", "left").where("not coalesce(id_a = id_b, false)")
    roots = _components(tied.select(F.col("seq_b").alias("u"), F.col("seq_a").alias("v")), most_rounds)
    return member.join(links, ["rep", "id_key"]).join(roots.select(F.col("u").alias("rep"), "root"), "rep", "left").select("seq", F.coalesce("root", "rep").alias("group_id"), "links")
