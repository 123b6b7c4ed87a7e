"""SimHash near-duplicates through deletion-variant signatures.

Two fingerprints that differ in at most two of 64 bits agree, in one of their
two 32-bit halves, but for one bit. So each half is indexed under 32 variants,
each with one bit wildcarded, and an equality join on (half, wildcard, rest)
finds every candidate. Buckets are only counted, with their least and greatest
member, combining map-side: a bucket of two is a pair to verify. A fuller one
is never expanded into its pairs; its members are verified through
one-bit midpoints instead: two fingerprints differ in at most two bits exactly
if some 64-bit value is within one bit of both, so each member meets the others
at its own value and its 64 one-bit neighbours, at most 65 distinct members at
each, and all of them linked. Both ways are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap_bits, bitmap_bytes, bitmap_has, lean, materialise, parallelism, row_slices, split_by_mark

SHINGLE = 3
SEED = 42
MAX_BITS = 2


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64-bit SimHash over word shingles; 0 without words."""
    words = text.encode().lower().split()  # of bytes: ASCII letters and white space only
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(whole[s:e], SEED) for s, e in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())), np.uint64, len(words) - k + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 32768):
        part = hashes[at : at + 32768].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in row_slices(batches):
        found = np.array([fingerprint(t or "") for t in part.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], ["id", "fp"])


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def signatures(fps: DataFrame) -> DataFrame:
    """(signature, fp): 64 rows per fingerprint. The 39 bits are half, wildcard position, the half without that bit."""
    low32 = F.lit(0xFFFFFFFF)
    half = F.when(F.col("place") < 32, F.col("fp").bitwiseAND(low32)).otherwise(F.shiftrightunsigned("fp", 32).bitwiseAND(low32))
    bit = F.expr("shiftleft(1L, place % 32)")
    rest = half.bitwiseAND(F.bitwise_not(bit))
    return fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("place")).select((F.col("place") * F.lit(1 << 32) + rest).alias("signature"), "fp")


#: Spreads the 64 wildcard positions over a bitmap.
_SPREAD = 2654435769


def _mark(signature: Column) -> Column:
    return F.shiftright(signature, 32) * F.lit(_SPREAD) + signature.bitwiseAND(F.lit(0xFFFFFFFF))


def _marked(fps: DataFrame, wanted: DataFrame) -> DataFrame:
    """signatures(fps) as far as they may be among the wanted ones, by a bitmap of fixed size, so that few rows are shuffled."""
    bits = bitmap_bits(wanted.count())
    marks = fps.sparkSession.sparkContext.broadcast(bitmap_bytes(wanted, _mark(F.col("signature")), bits))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, place = np.frombuffer(marks.value, np.uint8), np.arange(64, dtype=np.uint64)
        bit, shift = np.uint64(1) << (place % np.uint64(32)), np.where(place < 32, 0, 32).astype(np.uint64)
        for part in row_slices(batches, 4096):
            fp = part.column(0).to_numpy().view(np.uint64)
            rest = (fp[:, None] >> shift) & np.uint64(0xFFFFFFFF) & ~bit
            row, col = np.nonzero(bitmap_has(seen, bits, place * np.uint64(_SPREAD) + rest))
            signature = (place[col] << np.uint64(32)) + rest[row, col]
            yield pa.RecordBatch.from_arrays([pa.array(signature.view(np.int64)), pa.array(fp[row].view(np.int64))], ["signature", "fp"])

    return fps.mapInArrow(lean(pick), "signature long, fp long")


def links(fps: DataFrame) -> DataFrame:
    """(a, b), a < b: edges whose components are those of all pairs of distinct fps within two bits."""
    fps = fps.repartition(parallelism(fps.sparkSession))  # 64 rows come of each, and distinct fingerprints lie in few files
    indexed = signatures(fps)
    buckets = indexed.groupBy("signature").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    buckets = materialise(buckets, "simhash-buckets")
    pairs = buckets.where((F.col("n") == 2) & (distance(F.col("a"), F.col("b")) <= MAX_BITS)).select("a", "b")
    crowded = buckets.where("n > 2").select("signature")
    members = _marked(fps, crowded).join(crowded, "signature", "left_semi").select("fp").distinct()
    flips = F.array(F.lit(0), *[F.lit((1 << i) - (1 << 64) * (i == 63)).cast("long") for i in range(64)])
    near = members.select("fp", F.explode(flips).alias("flip")).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("midpoint"), "fp")
    stars = near.groupBy("midpoint").agg(F.sort_array(F.collect_list("fp")).alias("all")).where("size(all) > 1")  # 65 at most
    stars = stars.select(F.col("all")[0].alias("a"), F.explode(F.slice("all", 2, 64)).alias("b"))
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for nodes with an edge.

    Labels spread along edges, then each label takes its own label's label, so
    rounds grow with the logarithm of a component's diameter. Every round is
    stored in the shared folder; minima combine map-side.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other"), "simhash-edges")
    labels = materialise(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("component")), "simhash-labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("other"), F.col("component").alias("theirs")), "other").groupBy("node").agg(F.min("theirs").alias("theirs"))
        spread = labels.join(around, "node").select("node", F.col("component").alias("before"), F.least("component", "theirs").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        spread = spread.join(jump, "component").select("node", "before", F.least("component", "further").alias("component"))
        spread = materialise(spread, "simhash-labels")
        labels = spread.select("node", "component")
        if not spread.where("component <> before").limit(1).count():
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fp (signed 64-bit), component_id (smallest id reachable over links of at most two bits).

    Equal fingerprints are one node whatever their number, so only distinct
    ones are indexed. Edge cases: null or empty text has fingerprint 0 and is
    linked like any other; very long texts are read whole, their bits counted
    in blocks; a bit set in exactly half the shingles is 0; null ids are never
    the smallest unless all are null; repeated rows share a component; an empty
    table gives an empty result; other columns, whatever their names, are
    ignored.
    """
    marked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(lean(_fingerprints), "id long, fp long")
    marked = materialise(marked, "simhash-fingerprints")
    nodes = materialise(marked.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes")
    found = components(links(nodes.select("fp")))
    nodes = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(least, "component").select("fp", "component_id")
    return marked.join(nodes, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- Similar documents: the same index over wider symbols ---------------------
#
# Documents of a similarity of 0.8 differ in some ten of 64 bits, more than any
# index of half fingerprints reaches. Here a fingerprint's symbols are least
# hashes instead of bits: two documents agree in each with a chance of their
# Jaccard similarity. SEGMENTS segments of SYMBOLS symbols are indexed under one
# variant for each wildcarded symbol, joined by equality and verified.

WORDS = 5
LEAST = 0.8
SEGMENTS, SYMBOLS = 6, 6
#: Growth of a bucket's leaders from round to round.
STEP = 32
#: Of all symbols, those in which a pair must agree to be compared after a bucket's first round, where most pairs are far from similar.
LIKELY = 23
#: Segments that are indexed at a time; what they link is left out of the next.
PASS = 2
_ODD = np.random.Generator(np.random.PCG64(9)).integers(0, (1 << 64) - 1, 2 * SEGMENTS * SYMBOLS + 4, np.uint64, endpoint=True) | np.uint64(1)
_PART = 16384


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> np.uint64(31)
    x = x * _ODD[-1]
    return x ^ x >> np.uint64(29)


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """Distinct hashes of a text's word shingles, sorted; fewer words than a shingle are one, and so are none."""
    each = text.encode().lower().split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, each), np.uint64, len(each))
    k = min(words, max(1, len(h)))
    out = np.zeros(max(1, len(h) - k + 1), np.uint64)
    for j in range(k if len(h) else 0):
        out = _mix(out * _ODD[-2] + h[j : j + len(out)])
    return np.unique(out)


def symbols(shingles: np.ndarray) -> np.ndarray:
    """SEGMENTS x SYMBOLS least hashes of a set."""
    odd = _ODD[: SEGMENTS * SYMBOLS, None]
    least = [((x := shingles[at : at + _PART] * odd) ^ x >> np.uint64(32)).min(axis=1) for at in range(0, len(shingles), _PART)]
    return np.minimum.reduce(least).reshape(SEGMENTS, SYMBOLS)


def variants(each: np.ndarray) -> np.ndarray:
    """(documents, SEGMENTS, SYMBOLS) symbols -> signatures of the same shape: each segment without one symbol."""
    place = _ODD[SEGMENTS * SYMBOLS : -4].reshape(SEGMENTS, SYMBOLS)
    mixed = _mix(each * place + place)
    return _mix(mixed.sum(axis=2, keepdims=True, dtype=np.uint64) - mixed + place * _ODD[-3])


def node_of(id_col: Column, text: Column) -> Column:
    """A document's identity: id and text; null ids are the last in order."""
    return F.struct(id_col.isNull().alias("no_id"), F.coalesce(id_col.cast("long"), F.lit(0)).alias("id"), F.xxhash64(text).alias("text_hash"))


def node_hash(node: Column) -> Column:
    return F.xxhash64(node["no_id"], node["id"], node["text_hash"])


def _jaccard(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for part in row_slices(batches):
        keep = []
        for one, other in zip(part.column("one").to_pylist(), part.column("other").to_pylist()):
            a, b = np.frombuffer(one, "<u4"), np.frombuffer(other, "<u4")
            shared = 0 if min(len(a), len(b)) < least * max(len(a), len(b)) else len(np.intersect1d(a, b, assume_unique=True))
            keep.append(shared >= least * (len(a) + len(b) - shared) and shared > 0)
        yield pa.RecordBatch.from_arrays([part.column("node"), part.column("leader")], ["node", "leader"]).filter(pa.array(keep, pa.bool_()))


def _sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, shingles): sorted 32-bit hashes of the documents (node, text) that are, or by a bitmap may be, in nodes; a stored table."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches, 64):
            found = [np.unique((shingle_hashes(t or "", words) >> np.uint64(32)).astype("<u4")).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(found, pa.binary())], ["node", "shingles"])

    _, involved = split_by_mark(docs, node_hash(F.col("node")), nodes, node_hash(F.col("node")))
    kind = docs.schema["node"].dataType.simpleString()
    return materialise(involved.mapInArrow(lean(sets), f"node {kind}, shingles binary").dropDuplicates(["node"]), "similar-sets")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of (node, leader) whose shingle sets have the least similarity; a stored table."""
    kind = pairs.schema["node"].dataType.simpleString()
    both = pairs.join(sets.withColumnRenamed("shingles", "one"), "node").join(sets.select(F.col("node").alias("leader"), F.col("shingles").alias("other")), "leader")
    return materialise(both.select("node", "leader", "one", "other").mapInArrow(lambda batches: _jaccard(batches, least), f"node {kind}, leader {kind}"), "similar-pairs")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = LEAST) -> DataFrame:
    """One row per document: node (no_id, id, text_hash), like (the node of a document that it's similar to; null for those that stay).

    Similar means a Jaccard similarity of at least least over the sets of
    shingles of so many lower-cased words. Each document is linked to one of a
    lesser id at most, so following like leads to the one document of its group
    that stays. In each bucket of the index the document with the least id
    leads; members like it are linked and leave; the others choose leaders
    again, STEP times as many each round, until none is left to compare. So no
    bucket of similar documents is expanded into its pairs, no member is
    dropped unseen, and no two documents that stay were found similar.

    Bounds: similar pairs that no segment shares are missed, two in a thousand
    at a similarity of 0.8, fewer above; so are those that meet only after a
    bucket's first round and agree in fewer than LIKELY symbols, eight in a
    thousand of these. Verification compares 32-bit hashes.

    Edge cases: null text is empty; texts without words are alike; fewer words
    than a shingle are one shingle; very long texts are read whole; equal ids
    are ordered by text, null ids come last; repeated rows (same id and text)
    are one node, each with its row; an empty table gives an empty result;
    other columns, whatever their names, are ignored.
    """
    rows = docs.select(node_of(F.col(id_col), F.col(text_col)).alias("node"), F.col(text_col).alias("text"))
    kind = rows.schema["node"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches):
            each = np.array([symbols(shingle_hashes(t or "", words)) for t in part.column("text").to_pylist()])
            each = each.reshape(-1, SEGMENTS, SYMBOLS).astype(np.uint64)
            flat = variants(each).reshape(len(each), SEGMENTS * SYMBOLS).view(np.int64)
            low = each.reshape(len(each), SEGMENTS * SYMBOLS).astype(np.uint8).view(np.int8)
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(flat.tolist(), pa.list_(pa.int64())), pa.array(low.tolist(), pa.list_(pa.int8()))], ["node", "signatures", "sketch"])

    sketches = materialise(rows.mapInArrow(lean(sketch), f"node {kind}, signatures array<long>, sketch array<tinyint>"), "similar-sketches")
    mine, linked = node_hash(F.col("node")), None
    for first in range(0, SEGMENTS, PASS):
        alive = sketches
        if linked is not None:
            if first > PASS:
                linked = materialise(linked, "similar-linked")
            clear, maybe = split_by_mark(sketches, mine, linked, mine)
            alive = clear.unionByName(maybe.join(linked, "node", "left_anti"))
        part = F.slice("signatures", first * SYMBOLS + 1, PASS * SYMBOLS)
        entries, leaders, sets = materialise(alive.select("node", "sketch", F.explode(part).alias("signature")), "similar-entries"), 1, None
        while entries.limit(1).count():
            if leaders == 1:
                heads = entries.groupBy("signature").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader <> last")
                heads = materialise(heads.select("signature", "leader"), "similar-leaders")
                _, shared = split_by_mark(entries, F.col("signature"), heads, F.col("signature"))
                members = shared.join(heads, "signature").where("leader <> node")
            else:  # few are left
                heads = entries.groupBy("signature", F.pmod(mine, F.lit(leaders)).alias("seat")).agg(F.min(F.struct("node", "sketch")).alias("head"))
                heads = materialise(heads.select("signature", F.col("head.node").alias("leader"), F.col("head.sketch").alias("led")), "similar-leaders")
                # Two leaders meet once
                leads = heads.select("signature", F.col("leader").alias("node"), F.lit(True).alias("leads"))
                entries = entries.join(leads, ["signature", "node"], "left").withColumn("leads", F.coalesce("leads", F.lit(False)))
                agree = F.aggregate(F.zip_with("sketch", "led", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
                once = (F.col("leader") < F.col("node")) | ((F.col("leader") > F.col("node")) & ~F.col("leads"))
                members = entries.join(heads, "signature").where(once & (agree >= LIKELY))
            members = materialise(members.select("signature", "node", "sketch", "leader"), "similar-members")
            # Members that no leader took go on among themselves; leaders have met everyone
            rest = (members if leaders == 1 else entries.where("not leads")).select("signature", "node", "sketch")
            if members.limit(1).count():
                if sets is None:  # of all that any later round of this pass compares
                    sets = _sets(rows, materialise(members.select("node").union(members.select("leader")).distinct(), "similar-nodes"), words)
                pairs = members.select(F.greatest("node", "leader").alias("node"), F.least("node", "leader").alias("leader")).distinct()
                links = _verified(pairs, sets, least)
                linked = links if linked is None else linked.unionByName(links)
                rest = rest.join(links, "node", "left_anti")
            entries, leaders = materialise(rest, "similar-entries"), leaders * STEP
    if linked is None:
        return sketches.select("node", F.lit(None).cast(kind).alias("like"))
    return sketches.select("node").join(linked.groupBy("node").agg(F.min("leader").alias("like")), "node", "left")
