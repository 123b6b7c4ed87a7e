"""BPE encoding and decoding through a table of distinct words.

A word here is a run of white space with the run of other characters after it;
the tokenizer never merges across the start of such a word, so a text's ids are
its words' ids in order. Words of all texts are counted; each distinct word
among the most frequent ones is encoded once for all tasks, and this table,
of at most table_rows words, is broadcast. Each other word is encoded once by
the task that meets it. A text's ids are then looked up by position and never
leave the task. Decoding looks each id's piece up in the vocabulary's table.

encode_decode_joined() is the method in its plain form: every distinct word is
encoded once, a shuffled join brings its ids to each place where it occurs, and
another brings each id's piece. It moves every occurrence of every word, which
the README has figures of.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialise, row_slices

#: Code points with the Unicode property White_Space.
_SPACES = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORDS = re.compile(f"[{_SPACES}]*[^{_SPACES}]+|[{_SPACES}]+")
#: Rows and word length of the broadcast table: a bound of some 10 MB.
TABLE_ROWS = 1 << 17
TABLE_CHARS = 48
#: Other words a task remembers, and words it counts, before it starts anew.
MEMO_WORDS = 200_000


def top_words(counts: DataFrame, rows: int, bins: int = 1024) -> DataFrame:
    """(word, n) rows with the largest n, at most so many; ties at the border stay out, so the choice is always the same.

    Histograms of a bounded number of bins close in on the border, so nothing
    is sorted as a whole.
    """
    low, high, above = 1, (counts.agg(F.max("n")).first()[0] or 0) + 1, 0  # above: words with n >= high
    while low < high:
        step = -(-(high - low) // bins)
        at = F.floor((F.col("n") - low) / step)
        found = counts.where((F.col("n") >= low) & (F.col("n") < high)).groupBy(at.alias("bin")).count().collect()
        for k, words in sorted(found, reverse=True):
            if above + words > rows:
                low, high = low + k * step, min(high, low + (k + 1) * step)
                break
            above += words
        else:
            high = low
        if step == 1 and low < high:
            low = high
    return counts.where(F.col("n") >= low)


def counted(words_of, batches: Iterator[pa.RecordBatch], most: int = MEMO_WORDS) -> Iterator[pa.RecordBatch]:
    """(word, n) sums over a task's texts, handed on whenever there are many."""
    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    counts: Counter = Counter()
    for part in row_slices(batches):
        for text in part.column(0).to_pylist():
            if text:
                counts.update(words_of(text))
        if len(counts) > most:
            yield flush()
            counts.clear()
    yield flush()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return counted(WORDS.findall, batches)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts."""
    return docs.select(F.col(text_col)).mapInArrow(lean(_count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Encoder:
    """Encodes batches of words with the tokenizers library; made once per task."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def encode(self, words: list[str]) -> list[bytes]:
        """Each word's ids as little-endian unsigned 32-bit integers."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]


def word_table(docs: DataFrame, tokenizer_path: str, text_col: str = "text", table_rows: int = TABLE_ROWS) -> DataFrame:
    """(word, ids binary): the most frequent distinct words, each encoded once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path)
        for part in row_slices(batches, 4096):
            words = part.column(0)
            yield pa.RecordBatch.from_arrays([words, pa.array(encoder.encode(words.to_pylist()), pa.binary())], ["word", "ids"])

    counts = materialise(word_counts(docs, text_col).where(F.length("word") <= TABLE_CHARS), "bpe-words")
    return top_words(counts, table_rows).select("word").mapInArrow(lean(encode), "word string, ids binary")


def pieces(tokenizer_path: str) -> list[bytes]:
    """id -> bytes, for a byte-level vocabulary file; as many rows as the vocabulary has."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab = dict(spec["model"]["vocab"]) | {t["content"]: t["id"] for t in spec["added_tokens"]}
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    out = [b""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        out[i] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
    return out


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, table_rows: int = TABLE_ROWS) -> DataFrame:
    """One row per document: id, n_tokens and ids array<int>, decoded string; or with digests their SHA-256 in hex.

    The digests are taken in the task, so that ids of long texts don't travel
    only to be hashed. Edge cases: null text is empty and has no ids; white
    space alone is one word; words longer than the table's bound are encoded
    as they come; very long texts are encoded whole; repeated rows give
    repeated results; an empty table gives an empty result; other columns,
    whatever their names, are ignored. The file at tokenizer_path must be on
    every executor.
    """
    rows = word_table(docs, tokenizer_path, text_col, table_rows).collect()  # at most table_rows short words
    shared = docs.sparkSession.sparkContext.broadcast({word: bytes(ids) for word, ids in rows})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, piece = Encoder(tokenizer_path), pieces(tokenizer_path)
        table = dict(shared.value)
        room = len(table) + MEMO_WORDS
        for part in row_slices(batches, 128):
            words = [WORDS.findall(t) if t else [] for t in part.column(1).to_pylist()]
            new = list(set(chain.from_iterable(words)).difference(table))
            if len(table) + len(new) > room:
                table = dict(shared.value)
                new = list(set(chain.from_iterable(words)).difference(table))
            table.update(zip(new, encoder.encode(new)))
            columns: list[list] = [[], [], []]
            for each in words:
                ids = b"".join(map(table.__getitem__, each))
                numbers = np.frombuffer(ids, "<u4")
                decoded = b"".join(map(piece.__getitem__, numbers.tolist()))
                columns[0].append(len(numbers))
                if digests:
                    decoded = decoded.decode("utf-8", "replace").encode()
                    columns[1].append(hashlib.sha256(ids).hexdigest())
                    columns[2].append(hashlib.sha256(decoded).hexdigest())
                else:
                    columns[1].append(numbers.astype(np.int32))
                    columns[2].append(decoded.decode("utf-8", "replace"))
            for long in [w for w in new if len(w) > TABLE_CHARS]:
                del table[long]
            kind = pa.string() if digests else pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], kind), pa.array(columns[2], pa.string())], names)

    names = [id_col, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
    schema = f"`{id_col}` long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(lean(run), schema)


def encode_decode_joined(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_decode(), by joins: words with their places, the table of distinct words, ids with theirs, the table of pieces.

    Edge cases as there; a text's places meet in one row again, so a text must
    fit into a task.
    """
    spark = docs.sparkSession

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([WORDS.findall(t or "") for t in part.column(1).to_pylist()], pa.list_(pa.string()))], ["row", "words"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path)
        for part in row_slices(batches, 4096):
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in encoder.encode(part.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["word", "word_ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches):
            out = []
            for ids, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                decoded = b"".join(found or []).decode("utf-8", "replace").encode()
                out.append((len(ids or []), hashlib.sha256(np.array(ids or [], "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            columns = [pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = materialise(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "bpe-rows")
    places = rows.select("row", "text").mapInArrow(lean(split), "row long, words array<string>").select("row", F.posexplode("words").alias("place", "word"))
    places = materialise(places, "bpe-places")
    words = materialise(places.select("word").distinct().mapInArrow(lean(encode), "word string, word_ids array<int>"), "bpe-table")
    ids = places.join(words, "word").select("row", "place", F.posexplode("word_ids").alias("at", "token"))
    vocabulary = spark.createDataFrame(list(enumerate(pieces(tokenizer_path))), "token int, piece binary")  # as many rows as the vocabulary has
    joined = ids.join(vocabulary, "token")
    whole = joined.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "at", "token", "piece"))).alias("all"))
    out = rows.select("row", "id").join(whole, "row", "left").select("id", F.col("all.token").alias("tokens"), F.col("all.piece").alias("pieces"))
    return out.mapInArrow(lean(digest), f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")
