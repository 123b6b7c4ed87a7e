"""Repeated passages by a suffix array over chosen suffixes.

A suffix at every byte would be hundreds of times the input, so suffixes start
at anchors: a byte is one if the hash of the GRAM bytes there is the least
among all those inside some WINDOW-byte string. Equal strings of WINDOW bytes
contain equal anchors at equal places, so each repeated string is seen at an
anchor whose leading GRAM bytes repeat.

1. Anchors' leading bytes are counted, as hashes, combining map-side. The
   repeated ones become a bitmap of fixed size.
2. Each anchor that the bitmap lets through has surroundings: the bytes that a
   WINDOW-byte string through it can reach. Their hashes are counted. Equal
   surroundings settle each other. Only leading bytes with different
   surroundings go on, again as a bitmap.
3. The suffixes at those, with their surroundings, are range-partitioned by
   their leading bytes at sampled splitters and sorted inside the buckets.
   Equal leading bytes never straddle a boundary. Within a run, the strings at
   each offset are sorted and neighbours compared: equal ones are repeated.
4. Leading bytes with more than HOT suffixes (a passage in a third of all
   documents) would make one bucket. Their distinct surroundings are compared
   as rows dealt out by the hash of the whole string, so one passage spreads
   over all tasks.
5. What is repeated around an anchor goes back to all anchors with these
   surroundings, and from there to their documents, which cut the bytes out.

Strings are compared by hashes: leading bytes and surroundings, which bring
ranges to anchors, by 64 bits each and both together; whole strings inside a
run or at one offset by 64 bits. Tables are emptied as soon as nothing reads
them, and each large shuffle is done with before the next one starts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap_bits, bitmap_bytes, bitmap_has, bitmap_rows, discard, lean, materialise, row_slices, with_mark

WINDOW = 200
GRAM = 64
HOT = 16384
#: Bytes of a text whose anchors are chosen at a time.
CHUNK = 1 << 18
BLOCK_ROWS = 4096

_REACH = WINDOW - GRAM  # bytes before an anchor that a string through it can have
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_CODES = np.random.Generator(np.random.PCG64(20)).integers(0, _MASK, 256, np.uint64, endpoint=True)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hashes of all substrings of one length, by sums over powers of a base modulo 2^64."""

    def __init__(self, most: int):
        self.up, self.down = _powers(_BASE, most), _powers(pow(_BASE, -1, 1 << 64), most)

    def hashes(self, raw: np.ndarray, length: int) -> np.ndarray:
        """Along the last axis of raw (uint8)."""
        n = raw.shape[-1]
        sums = np.zeros((*raw.shape[:-1], n + 1), np.uint64)
        np.cumsum(_CODES[raw] * self.up[:n], axis=-1, out=sums[..., 1:])
        x = (sums[..., length:] - sums[..., : n + 1 - length]) * self.down[: n + 1 - length]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        return x


def _sliding(best, a: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        a = best(a[:-size], a[size:])
        size *= 2
    return best(a[: len(a) - (width - size)], a[width - size :]) if size < width else a


def anchors(raw: bytes, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """Places and leading-byte hashes of a text's anchors; none below WINDOW bytes."""
    if len(raw) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    whole, width, found = np.frombuffer(raw, np.uint8), WINDOW - GRAM + 1, []
    for at in range(0, len(raw) - WINDOW + 1, CHUNK):
        h = rolling.hashes(whole[at : at + CHUNK + WINDOW - 1], GRAM)
        least = _sliding(np.minimum, h, width)
        pad = np.zeros(width - 1, np.uint64)
        reached = _sliding(np.maximum, np.concatenate([pad, least, pad]), width)
        places = np.flatnonzero(h == reached)
        found.append((places + at, h[places]))
    if len(found) == 1:
        return found[0]
    places, first = np.unique(np.concatenate([f[0] for f in found]), return_index=True)
    return places, np.concatenate([f[1] for f in found])[first]


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rolling = Rolling(CHUNK + WINDOW)
    for part in row_slices(batches):
        found = [anchors(t.encode(), rolling)[1] for t in part.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["gram"])


ANCHORS = "gram long, key long, before int, length int, id long, text_hash long, place long"
SUFFIXES = "gram long, hot boolean, key long, before int, around binary"
#: Surroundings that a task remembers having sent.
SEEN = 1_000_000


def window_hashes(around: list[bytes], before: np.ndarray, rolling: Rolling) -> np.ndarray:
    """Row i, column c: hash of the string that starts c - _REACH bytes from the anchor, or i if it leaves the text."""
    lengths = np.array([len(a) for a in around])
    first = _REACH - before
    cols = np.arange(_REACH + WINDOW)
    inside = (cols >= first[:, None]) & (cols < (first + lengths)[:, None])
    raw = np.zeros(inside.shape, np.uint8)
    raw[inside] = np.frombuffer(b"".join(around), np.uint8)
    h = rolling.hashes(raw, WINDOW)
    starts = np.arange(h.shape[1])
    good = (starts >= first[:, None]) & (starts + WINDOW <= (first + lengths)[:, None])
    return np.where(good, h, np.arange(len(around), dtype=np.uint64)[:, None])


def repeated_range(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: whether any of its strings is also another row's, and the first and last such column."""
    h = np.ascontiguousarray(h.T)
    order = np.argsort(h, axis=1)
    ranked = np.take_along_axis(h, order, axis=1)
    same = ranked[:, 1:] == ranked[:, :-1]
    hit = np.zeros(h.shape, bool)
    hit[:, 1:] |= same
    hit[:, :-1] |= same
    flags = np.zeros(h.shape, bool)
    np.put_along_axis(flags, order, hit, axis=1)
    flags = flags.T
    return flags.any(axis=1), flags.argmax(axis=1), flags.shape[1] - 1 - flags[:, ::-1].argmax(axis=1)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes in, what is repeated around them out; runs of equal leading bytes are compared together."""
    rolling = Rolling(_REACH + WINDOW)

    def block(rows: pa.Table) -> pa.RecordBatch:
        h = window_hashes(rows.column("around").to_pylist(), rows.column("before").to_numpy(), rolling)
        hit, lo, hi = repeated_range(h)
        at = np.flatnonzero(hit)
        grams, keys = (rows.column(c).combine_chunks().take(pa.array(at)) for c in ("gram", "key"))
        return pa.RecordBatch.from_arrays([grams, keys, pa.array(lo[at], pa.int32()), pa.array(hi[at], pa.int32())], ["gram", "key", "lo", "hi"])

    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        while held.num_rows >= 2 * BLOCK_ROWS:
            leads = held.column("gram").to_numpy()
            ends = np.flatnonzero(leads[1:] != leads[:-1]) + 1
            cut = int(ends[np.searchsorted(ends, BLOCK_ROWS)]) if len(ends) and ends[-1] >= BLOCK_ROWS else 0
            if not cut:
                break  # the run goes on; HOT bounds its length
            yield block(held.slice(0, cut))
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield block(held)


#: A string through an anchor has this many bytes before it, or GRAM + this many from it on.
_SIDE = _REACH // 2


def _windows(before_side: bool):
    """A mapInArrow function: surroundings in, a row per string through the anchor out.

    before_side: strings with _SIDE bytes or more before the anchor; else the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, cols = Rolling(_REACH + WINDOW), np.arange(_REACH + 1)
        wanted = cols <= _REACH - _SIDE if before_side else cols > _REACH - _SIDE
        for part in row_slices(batches, 1024):
            h = window_hashes(part.column("around").to_pylist(), part.column("before").to_numpy(), rolling)
            at, col = np.nonzero((h >= np.uint64(part.num_rows)) & wanted)
            yield pa.RecordBatch.from_arrays([part.column("kind").take(pa.array(at)), pa.array(col, pa.int32()), pa.array(h[at, col].view(np.int64))], ["kind", "col", "string_hash"])

    return run


def hot_ranges(hot: DataFrame) -> DataFrame:
    """(gram, key, lo, hi) of suffixes whose leading bytes are very frequent, without any bucket of them; a stored table.

    Every string through an anchor holds the _SIDE bytes before it or GRAM +
    _SIDE bytes from it on, so only surroundings that share these with others
    are expanded into strings.
    """
    kinds = hot.groupBy("gram", "key").agg(F.first("before").alias("before"), F.first("around").alias("around"))
    left = F.when(F.col("before") >= _SIDE, F.xxhash64("gram", F.expr(f"substring(around, before + 1 - {_SIDE}, {_SIDE})")))
    right = F.when(F.length("around") >= F.col("before") + GRAM + _SIDE, F.xxhash64("gram", F.expr(f"substring(around, before + 1, {GRAM + _SIDE})")))
    kinds = materialise(kinds.withColumns({"left": left, "right": right, "kind": F.monotonically_increasing_id()}), "suffix-hot")
    rows = None
    for side in ("left", "right"):
        shared = materialise(kinds.where(F.col(side).isNotNull()).groupBy(side).agg(F.count("*").alias("n")).where("n > 1").select(side), "suffix-sides")
        part = kinds.join(shared, side, "left_semi").select("kind", "before", "around").mapInArrow(lean(_windows(side == "left")), "kind long, col int, string_hash long")
        rows = part if rows is None else rows.unionByName(part)
    rows = materialise(rows, "suffix-windows")
    # A string meets its equals at the same place before their anchors; without col it would meet itself at another anchor
    repeated = materialise(rows.groupBy("string_hash", "col").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "suffix-repeated")
    bits = bitmap_bits(repeated.count())
    marks = hot.sparkSession.sparkContext.broadcast(bitmap_bytes(repeated, F.col("string_hash"), bits))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(marks.value, np.uint8)
        for batch in batches:
            yield batch.filter(pa.array(bitmap_has(seen, bits, batch.column("string_hash").to_numpy())))

    found = rows.mapInArrow(lean(likely), rows.schema).join(repeated, ["string_hash", "col"], "left_semi").groupBy("kind").agg(F.min("col").alias("lo"), F.max("col").alias("hi"))
    out = materialise(kinds.select("kind", "gram", "key").join(found, "kind").drop("kind"), "suffix-hot-ranges")
    marks.destroy()
    discard(kinds, rows, repeated)
    return out


class Chosen:
    """Anchors of texts that a bitmap lets through, with their surroundings; made once per task."""

    def __init__(self, marks: bytes, bits: int):
        self.rolling, self.marks, self.bits = Rolling(CHUNK + WINDOW), np.frombuffer(marks, np.uint8), bits

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """Document number, place, leading-byte hash, bytes before, surroundings and their hash of each."""
        found: list[tuple] = []
        around: list[bytes] = []
        for i, text in enumerate(texts):
            raw = text.encode()
            at, h = anchors(raw, self.rolling)
            keep = bitmap_has(self.marks, self.bits, h)
            at, h = at[keep], h[keep]
            first = np.maximum(at - _REACH, 0)
            found.append((np.full(len(at), i), at, h, at - first))
            around += [raw[f:e] for f, e in zip(first.tolist(), (at + WINDOW).tolist())]
        doc, place, gram, before = (np.concatenate(x) for x in zip(*found))
        key = np.fromiter((xxhash.xxh64_intdigest(a, b) for a, b in zip(around, before.tolist())), np.uint64, len(around))
        return doc, place, gram, before, around, key


def repeated_intervals(docs: DataFrame, hot_above: int = HOT) -> tuple[DataFrame, list[DataFrame]]:
    """docs (id, text, text_hash) -> (id, text_hash, first, last): byte intervals covered by repeated strings; and the stored tables that these read."""
    spark = docs.sparkSession
    long_enough = docs.where(F.octet_length("text") >= WINDOW)
    grams = long_enough.select("text").mapInArrow(lean(_grams), "gram long").groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    grams = materialise(grams, "suffix-grams")
    bits = bitmap_bits(grams.count())
    seen = spark.sparkContext.broadcast(bitmap_bytes(grams, F.col("gram"), bits))

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = Chosen(seen.value, bits)
        for part in row_slices(batches, 64):
            doc, place, gram, before, around, key = chosen.of(part.column("text").to_pylist())
            at = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram.view(np.int64)), pa.array(key.view(np.int64)), pa.array(before, pa.int32()), pa.array([len(a) for a in around], pa.int32()),
                 part.column("id").take(at), part.column("text_hash").take(at), pa.array(place, pa.int64())],
                ["gram", "key", "before", "length", "id", "text_hash", "place"],
            )

    found = materialise(long_enough.select("id", "text_hash", "text").mapInArrow(lean(surroundings), ANCHORS), "suffix-anchors")
    kinds = found.groupBy("gram", "key").agg(F.count("*").alias("n"), F.min(F.col("before") * 1024 + F.col("length")).alias("extent"))
    kinds = kinds.select("gram", "key", "n", F.floor(F.col("extent") / 1024).alias("before"), (F.col("extent") % 1024).alias("length"))
    kinds = materialise(kinds, "suffix-kinds")
    seen.destroy()
    discard(grams)
    whole = kinds.where((F.col("n") > 1) & (F.col("length") >= WINDOW)).select(
        "gram", "key", (F.lit(_REACH) - F.col("before")).cast("int").alias("lo"), (F.lit(_REACH - WINDOW) - F.col("before") + F.col("length")).cast("int").alias("hi")
    )
    mixed = materialise(kinds.groupBy("gram").agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).where("kinds > 1"), "suffix-mixed")
    frequent = mixed.where(F.col("n") > hot_above)
    n_mixed, n_hot = mixed.agg(F.count("*"), F.count(F.when(F.col("n") > hot_above, 1))).first()
    mixed_bits, hot_bits = bitmap_bits(n_mixed), bitmap_bits(n_hot)
    unsettled = spark.sparkContext.broadcast(bitmap_bytes(mixed, F.col("gram"), mixed_bits))
    hot_marks = spark.sparkContext.broadcast(bitmap_bytes(frequent, F.col("gram"), hot_bits) if n_hot else b"")

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, marks, sent = Chosen(unsettled.value, mixed_bits), np.frombuffer(hot_marks.value, np.uint8), set()
        for part in row_slices(batches, 64):
            _, _, gram, before, around, key = chosen.of(part.column("text").to_pylist())
            if len(sent) > SEEN:
                sent.clear()
            new = []
            for i, k in enumerate(key.tolist()):
                if k not in sent:  # equal surroundings are settled already
                    sent.add(k)
                    new.append(i)
            gram = gram[new]
            hot = bitmap_has(marks, hot_bits, gram) if len(marks) else np.zeros(len(gram), bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram.view(np.int64)), pa.array(hot), pa.array(key[new].view(np.int64)), pa.array(before[new], pa.int32()), pa.array([around[i] for i in new], pa.binary())],
                ["gram", "hot", "key", "before", "around"],
            )

    suffix = materialise(long_enough.select("text").mapInArrow(lean(suffixes), SUFFIXES), "suffix-suffixes")
    unsettled.destroy()
    hot_marks.destroy()
    discard(mixed)
    # Sampled splitters over the leading bytes; gram settles a run's order
    calm = suffix.where("not hot").withColumn("lead", F.expr(f"substring(around, before + 1, {GRAM})"))
    calm = calm.repartitionByRange(F.col("lead")).sortWithinPartitions("lead", "gram").drop("lead", "hot")
    parts = [materialise(calm.mapInArrow(lean(_compare), "gram long, key long, lo int, hi int"), "suffix-calm-ranges")]
    if n_hot:
        parts.append(hot_ranges(suffix.where("hot")))
    discard(suffix)
    ranges = whole
    for part in parts:
        ranges = ranges.unionByName(part)
    # All strings through an anchor overlap in its leading bytes, so what they cover is one interval
    ranges = materialise(ranges.groupBy("gram", "key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "suffix-ranges")
    discard(kinds, *parts)
    # Anchors around which nothing repeats don't travel
    range_bits = bitmap_bits(ranges.count(), per_row=8)
    found_rows = with_mark(found.select("gram", "key", "id", "text_hash", "place"), F.col("key"), bitmap_rows(ranges, F.col("key"), range_bits), range_bits, "ranged").where("ranged").drop("ranged")
    start = F.col("place") - _REACH
    intervals = found_rows.join(ranges, ["gram", "key"]).select("id", "text_hash", (start + F.col("lo")).alias("first"), (start + F.col("hi") + WINDOW).alias("last"))
    return intervals, [found, ranges]


def cut(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The bytes outside the spans, the number of those inside, and of maximal runs."""
    kept, end, removed, runs, first = [], 0, 0, 0, True
    for a, b in sorted(spans):
        if first or a > end:
            kept.append(raw[end:a])
            removed += b - a
            runs += 1
            end, first = b, False
        elif b > end:
            removed += b - end
            end = b
    kept.append(raw[end:])
    return b"".join(kept), removed, runs


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, hot_above: int = HOT) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept binary; or with digests kept_sha256 in hex.

    Removed is each byte covered by a string of WINDOW bytes that also starts
    anywhere else, judged on the input; all copies go, the first included.
    Edge cases: null text is empty; texts below WINDOW bytes stay whole; very
    long texts are read in overlapping chunks; two rows with equal text remove
    each other, also if their ids are equal or null; an empty table gives an
    empty result; other columns, whatever their names, are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("text_hash"))
    intervals, read = repeated_intervals(rows, hot_above)
    spans = materialise(intervals.groupBy("id", "text_hash").agg(F.collect_set(F.struct("first", "last")).alias("spans")), "suffix-spans")
    discard(*read)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches, 64):
            out = []
            for text, found in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                raw = (text or "").encode()
                kept, removed, runs = cut(raw, [(s["first"], s["last"]) for s in found or []])
                out.append((len(raw), removed, runs, hashlib.sha256(kept).hexdigest() if digests else kept))
            numbers = [pa.array([o[i] for o in out], pa.int64()) for i in range(3)]
            last = pa.array([o[3] for o in out], pa.string() if digests else pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("id"), *numbers, last], names)

    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256" if digests else "kept"]
    # Only texts that may have spans are shuffled to them; the others stay where they are read
    bits = bitmap_bits(spans.count())
    rows = with_mark(rows, F.col("text_hash"), bitmap_rows(spans, F.col("text_hash"), bits), bits, "touched")
    joined = rows.where("touched").alias("d").join(spans.alias("s"), F.expr("d.id <=> s.id and d.text_hash = s.text_hash"), "left").select("d.id", "d.text", "s.spans")
    untouched = rows.where("not touched").select("id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    return joined.unionByName(untouched).mapInArrow(lean(finish), f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, {names[-1]} {'string' if digests else 'binary'}")
