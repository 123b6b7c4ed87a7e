"""Quality rules, with line frequencies across the documents of a host.

One pass over the texts yields each document's counts and the hashes of its
normalised lines; all else works on hashes. A line is above the limit when more
than max(least_docs, share * host's documents) distinct documents of its host
hold it. Such lines are removed, and a document that loses more than
max_removed of its words is depleted and rejected. The text without these lines
is an output of its own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialise, row_slices

#: Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Spread of a host's lines when limits are handed back to documents.
SALTS = 16

STATS = "row long, id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<hash: long, words: long>>"


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more, first ones included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts, n, upto = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            n += i + 3 - max(i, upto)
            upto = i + 3
    return n


def text_stats(text: str) -> tuple[int, int, int, int, int, list[dict]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with each normalised line once."""
    raw = text.encode()
    words = raw.split()  # of bytes: at ASCII white space only
    seen: set[bytes] = set()
    dup, lines = 0, Counter()
    for line in raw.split(b"\n"):
        if parts := line.split():
            if line in seen:
                dup += 1
            else:
                seen.add(line)
            lines[line_hash(parts)] += len(parts)
    spaces, symbols = (sum(map(text.count, chars)) for chars in (SPACE, SYMBOLS))
    return len(words), len(text) - spaces, symbols, dup, repeat_words(words), [{"hash": h, "words": n} for h, n in lines.items()]


def line_hash(parts: list[bytes]) -> int:
    """Signed hash of a normalised line."""
    h = xxhash.xxh64_intdigest(b" ".join(parts).lower())
    return h - (1 << 64) if h >> 63 else h


def without_lines(text: str, hashes: set[int]) -> str:
    """The text without the lines of these hashes; other lines stay as they are."""
    return "\n".join(line for line in text.split("\n") if not ((parts := line.encode().split()) and line_hash(parts) in hashes))


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("hash", pa.int64()), ("words", pa.int64())]))
    for part in row_slices(batches):
        found = [text_stats(t or "") for t in part.column("text").to_pylist()]
        columns = list(zip(*found)) if found else [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [part.column("row"), part.column("id"), part.column("host"), *[pa.array(c, pa.int64()) for c in columns[:5]], pa.array(columns[5], kind)],
            ["row", "id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"],
        )


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", least_docs: int = 10, share: float = 0.01, max_removed: float = 0.5, texts: bool = True) -> DataFrame:
    """One row per document: id, the counts, base_failed, kept, n_removed_words, and with texts cleaned_text, without the removed lines.

    Edge cases: null text stays null in cleaned_text; null or empty text has no words and fails; a null host is a
    host of its own; a line twice in one document counts it once; very long
    texts count whole; a line in exactly as many documents as the limit stays;
    repeated rows are documents of their own; an empty table gives an empty
    result; other columns, whatever their names, are ignored.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"))
    if texts:
        rows = materialise(rows, "quality-rows")  # row numbers that hold for the statistics and the texts
    stats = materialise(rows.mapInArrow(_stats, STATS), "quality-stats")
    limits = stats.groupBy("host").agg(F.greatest(F.lit(float(least_docs)), F.count("*") * F.lit(share)).alias("limit"))
    lines = stats.select("row", "host", F.explode("lines").alias("line")).select("row", "host", "line.*")
    counts = lines.groupBy("host", "hash").agg(F.count("*").alias("docs")).where(F.col("docs") > least_docs)
    common = counts.alias("c").join(limits.alias("l"), F.expr("c.host <=> l.host and c.docs > l.limit")).select("c.host", "hash")
    # A very common line's documents meet its limit in SALTS places, not one
    common = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    removed = (
        salted.alias("d").join(common.alias("c"), F.expr("d.host <=> c.host and d.hash = c.hash and d.salt = c.salt"))
        .groupBy("d.row").agg(F.sum("d.words").alias("n_removed_words"), *([F.collect_set("d.hash").alias("hashes")] if texts else []))
    )
    if texts:
        removed = materialise(removed, "quality-removed")
    out = stats.drop("lines").join(removed, "row", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    depleted = F.col("n_removed_words") > F.col("n_words") * F.lit(max_removed)
    if texts:
        out = out.join(rows.select("row", "text"), "row")
    out = out.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "n_removed_words", *(["text", "hashes"] if texts else []),
    )
    if not texts:
        return out

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches):
            pairs = zip(part.column("text").to_pylist(), part.column("hashes").to_pylist())
            cleaned = [without_lines(t, set(hashes)) if t and hashes else t for t, hashes in pairs]
            yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(cleaned, pa.string())], [*part.schema.names[:-2], "cleaned_text"])

    kinds = ", ".join(f"`{name}` {kind}" for name, kind in out.dtypes[:-2])
    return out.mapInArrow(clean, f"{kinds}, cleaned_text string")
