"""Language identification, words first, backing off to shorter n-grams.

The model holds the words of labelled documents and the n-grams of these words.
A known word adds its log frequency in each language; an unknown one, whatever
its length, adds the mean over its known 4-grams, else 3-grams, 2-grams, single
characters. Words and n-grams are 64-bit hashes in sorted arrays, so the model
travels as a few flat buffers that Python workers map without copying.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, materialise, row_slices

_RUNS = re.compile(r"[^\W\d_]+")
#: Bound of the model: labelled documents of each language that it's fitted on (a hash picks them). All their words and n-grams count.
TRAIN_DOCS = 5_000
#: Letters of a run whose n-grams are held at a time.
PIECE = 4096
#: Bytes of evidence that a task remembers.
MEMO_BYTES = 24 << 20
#: Counts that a task holds before it hands them on.
HELD = 300_000
#: Weight of an unknown word's evidence.
BACKOFF = 0.5
ORDERS = (4, 3, 2, 1)


def remainder(id_col: Column) -> Column:
    """crc32 of the id's decimal text, mod 5; held-out documents have 0."""
    return F.crc32(id_col.cast("string")) % 5


def letter_runs(text: str) -> list[str]:
    """Runs of letters; the pattern also takes numerals that are no digits, which are cut out."""
    found = _RUNS.findall(text)
    if all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]


def gram_hash(gram: str, order: int) -> int:
    """64 bits; order 0 is a word."""
    return xxhash.xxh64_intdigest(gram, order)


def grams(word: str, n: int) -> list[str]:
    padded = f"<{word}>" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def pieces(word: str, n: int) -> Iterator[list[str]]:
    """grams(word, n), a bounded number at a time."""
    padded = f"<{word}>" if n > 1 else word
    last = len(padded) - n + 1
    for at in range(0, last, PIECE):
        yield [padded[i : i + n] for i in range(at, min(at + PIECE, last))]


_WORDS = "lang string, word string, n long"
_COUNTS = "lang string, order int, gram long, n long"


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of words by language, handed on whenever there are many."""
    words: Counter = Counter()

    def flush() -> pa.RecordBatch:
        langs, names = zip(*words) if words else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(names, pa.string()), pa.array(words.values(), pa.int64())], ["lang", "word", "n"])

    for part in row_slices(batches):
        for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
            words.update(zip(repeat(lang), letter_runs(text.lower())))
        if len(words) > HELD:
            yield flush()
            words.clear()
    yield flush()


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counted words and their n-grams, as hashes; order 0 is a word."""
    found: defaultdict[tuple[str, int], Counter] = defaultdict(Counter)

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, order), counts in found.items():
            hashes = np.fromiter((gram_hash(g, order) for g in counts), np.uint64, len(counts))
            columns = [pa.array([lang] * len(counts), pa.string()), pa.array(np.full(len(counts), order, np.int32)), pa.array(hashes.view(np.int64)), pa.array(counts.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "order", "gram", "n"])
        found.clear()

    for part in row_slices(batches, 1024):
        for lang, word, n in zip(*(part.column(c).to_pylist() for c in ("lang", "word", "n"))):
            found[lang, 0][word] += n
            for order in ORDERS:
                counts = found[lang, order]
                for piece in pieces(word, order):
                    for g in piece:
                        counts[g] += n
        if sum(map(len, found.values())) > HELD:
            yield from flush()
    yield from flush()


class Model:
    """Log frequencies. For each order: sorted hashes, and of each hash its (language, log) pairs; other languages have the order's least."""

    def __init__(self, langs: list[str], tables: list[tuple[np.ndarray, ...]]):
        """tables, for (0, *ORDERS): hashes, first pair of each hash and the end, languages and logs of the pairs, least log of each language."""
        self.langs, self.tables = langs, tables

    @classmethod
    def of(cls, lang: np.ndarray, order: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Model:
        """From count rows, one per language, order and hash."""
        langs, col = np.unique(lang, return_inverse=True)
        tables = []
        for o in (0, *ORDERS):
            at = np.flatnonzero(order == o)
            at = at[np.lexsort((col[at], gram[at]))]
            hashes, first = np.unique(gram[at], return_index=True)
            total = np.bincount(col[at], n[at], len(langs)) + 0.5 * max(1, len(hashes))
            logs = np.log((n[at] + 0.5) / total[col[at]])
            tables.append((hashes, np.append(first, len(at)).astype(np.int64), col[at].astype(np.int16), logs.astype(np.float32), np.log(0.5 / total).astype(np.float32)))
        return cls(langs.tolist(), tables)

    def rows(self, table: int, places: np.ndarray) -> np.ndarray:
        """Log frequencies of the table's hashes at these places, a column per language."""
        _, first, cols, logs, least = self.tables[table]
        out = np.tile(least, (len(places), 1))
        sizes = first[places + 1] - first[places]
        row = np.repeat(np.arange(len(places)), sizes)
        pair = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first[places], sizes)
        out[row, cols[pair]] = logs[pair]
        return out

    def find(self, table: int, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes, -1 for unknown ones."""
        known = self.tables[table][0]
        if not len(known):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        return np.where(known[at] == hashes, at, -1)

    def packed(self) -> tuple[list[str], list[tuple[np.ndarray, ...]]]:
        """What Model(*...) takes; plain values, so that any worker can read them."""
        return self.langs, self.tables


class Scorer:
    """Scores texts by tokens, remembering each token's evidence.

    Evidence is a row of: log scores per language, posteriors per language,
    number of words. New words of a slice of texts are looked up together; a
    token of one word shares its word's row.
    """

    def __init__(self, model: Model):
        self.model, self.n = model, len(model.langs)
        self.width = 2 * self.n + 1
        self.most = max(4096, MEMO_BYTES // (4 * self.width))
        self.reset()

    def reset(self) -> None:
        self.memo: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.rows, self.used = np.zeros((4096, self.width), np.float32), 1  # row 0: no evidence

    def _evidence(self, logs: np.ndarray) -> np.ndarray:
        p = np.exp(logs - logs.max(axis=1, keepdims=True))
        p = p / p.sum(axis=1, keepdims=True)
        return np.concatenate([logs, p, np.ones((len(logs), 1))], axis=1).astype(np.float32)

    def _append(self, rows: np.ndarray) -> int:
        """Stores rows and returns the first one's place."""
        at = self.used
        if at + len(rows) > len(self.rows):
            room = np.zeros((max(len(self.rows) // 2, len(rows)), self.width), np.float32)
            self.rows = np.concatenate([self.rows[:at], room])
        self.rows[at : at + len(rows)] = rows
        self.used += len(rows)
        return at

    def _learn_words(self, words: list[str]) -> None:
        """Known words' rows; the others back off to the mean over their known n-grams of the longest order that has any."""
        hashes = np.fromiter((gram_hash(w, 0) for w in words), np.uint64, len(words))
        place = self.model.find(0, hashes)
        hit = np.flatnonzero(place >= 0)
        at = self._append(self._evidence(self.model.rows(0, place[hit]))) if len(hit) else 0
        self.words.update(zip((words[i] for i in hit.tolist()), range(at, at + len(hit))))
        rest = [words[i] for i in np.flatnonzero(place < 0).tolist()]
        for table, order in enumerate(ORDERS, 1):
            short, again = [], []
            for w in rest:
                if len(w) <= PIECE:
                    short.append(w)
                    continue
                n, total = 0, np.zeros(self.n)
                for piece in pieces(w, order):
                    found = self.model.find(table, np.fromiter((gram_hash(g, order) for g in piece), np.uint64, len(piece)))
                    found = found[found >= 0]
                    n += len(found)
                    total += self.model.rows(table, found).sum(axis=0, dtype=np.float64)
                if n:
                    self.words[w] = self._append(self._evidence(total[None] / n * BACKOFF))
                else:
                    again.append(w)
            if short:
                each = [grams(w, order) for w in short]
                flat = list(chain.from_iterable(each))
                names = {g: i for i, g in enumerate(dict.fromkeys(flat))}
                found = self.model.find(table, np.fromiter((gram_hash(g, order) for g in names), np.uint64, len(names)))
                known = found >= 0
                logs = np.zeros((len(names), self.n + 1))
                logs[known, : self.n], logs[known, self.n] = self.model.rows(table, found[known]), 1
                sizes = np.fromiter(map(len, each), np.int64, len(each))
                filled = np.flatnonzero(sizes)
                sums = np.zeros((len(each), self.n + 1))
                if len(filled):
                    index = np.fromiter(map(names.__getitem__, flat), np.int64, len(flat))
                    sums[filled] = np.add.reduceat(logs[index], (np.cumsum(sizes) - sizes)[filled], axis=0)
                done = np.flatnonzero(sums[:, self.n])
                if len(done):
                    at = self._append(self._evidence(sums[done, : self.n] / sums[done, self.n :] * BACKOFF))
                    self.words.update(zip((short[i] for i in done.tolist()), range(at, at + len(done))))
                again += [short[i] for i in np.flatnonzero(sums[:, self.n] == 0).tolist()]
            rest = again
        self.words.update(dict.fromkeys(rest, 0))  # no character that the model has seen

    def learn(self, tokens: set[str]) -> None:
        """Rows of tokens that aren't remembered yet."""
        split = {t: letter_runs(t) for t in tokens}
        new = list({w for ws in split.values() for w in ws}.difference(self.words))
        for at in range(0, len(new), 8192):
            self._learn_words(new[at : at + 8192])
        several = []
        for t, ws in split.items():
            if len(ws) == 1:
                self.memo[t] = self.words[ws[0]]
            elif ws:
                several.append(t)
            else:
                self.memo[t] = 0
        if several:
            at = self._append(np.array([self.rows[[self.words[w] for w in split[t]]].sum(axis=0) for t in several]))
            self.memo.update(zip(several, range(at, at + len(several))))

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text."""
        lists = [t.lower().split() if t and self.n else [] for t in texts]
        new = set(chain.from_iterable(lists)).difference(self.memo)
        if new and self.used + len(new) > self.most:
            self.reset()
            new = set(chain.from_iterable(lists))
        self.learn(new)
        return [self._verdict(t, tokens) for t, tokens in zip(texts, lists)]

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]

    def _verdict(self, text: str | None, tokens: list[str]) -> tuple[str, float]:
        if not text or not self.n:
            return "und", 0.0
        at = np.fromiter(map(self.memo.__getitem__, tokens), np.int64, len(tokens))
        total = np.zeros(self.width)
        for k in range(0, len(at), 65536):
            total += self.rows[at[k : k + 65536]].sum(axis=0, dtype=np.float64)
        if not total[-1]:  # no letter, or none that any language has shown
            return (self.model.langs[0], 1.0 / self.n) if any(map(str.isalpha, text)) else ("und", 0.0)
        best = int(np.argmax(total[: self.n]))
        return self.model.langs[best], float(min(1.0, max(0.0, total[self.n + best] / total[-1])))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> Model:
    """A model of the labelled documents that aren't held out; of each language a hash picks about train_docs, or all if there are fewer."""
    labelled = docs.where((remainder(F.col(id_col)) != 0) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    labelled = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    parts = 1 << 30
    shares = labelled.groupBy("lang").agg(F.ceil(F.lit(float(parts * train_docs)) / F.count(F.lit(1))).alias("share"))  # a row per language
    sample = labelled.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("id"), F.lit(parts)) < F.col("share")).select("lang", "text")
    words = materialise(sample.mapInArrow(lean(_count_words), _WORDS).groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid-words")
    counts = words.mapInArrow(lean(_count_grams), _COUNTS).groupBy("lang", "order", "gram").agg(F.sum("n").alias("n"))
    rows = materialise(counts, "langid-counts").toArrow()  # the sample bounds it
    if not rows.num_rows:
        return Model([], [])
    lang = rows.column("lang").combine_chunks().dictionary_encode()
    names = np.array(lang.dictionary.to_pylist(), dtype=object)
    place = np.argsort(np.argsort(names))  # languages in order
    codes = place[lang.indices.to_numpy()]
    model = Model.of(codes, rows.column("order").to_numpy(), rows.column("gram").to_numpy().view(np.uint64), rows.column("n").to_numpy())
    return Model(sorted(names.tolist()), model.tables)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score.

    score is the mean posterior of the predicted language over the text's
    words. Predictions see the text alone. Edge cases: null text, or text
    without a letter, is `und` with score 0; a text whose letters no language
    has shown is of the first language, with an even score; without labelled
    documents all are `und`; very long texts and runs are scored whole, a
    bounded number of n-grams at a time; equal evidence goes to the first
    language by name; a null id is neither held out nor learned from; repeated
    rows give repeated results; an empty table gives an empty result; other
    columns, whatever their names, are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, lang_col, train_docs).packed())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(*model.value))
        for part in row_slices(batches):
            found = scorer.predict_all(part.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                [id_col, "held_out", "lang_pred", "score"],
            )

    held = F.coalesce(remainder(F.col(id_col)) == 0, F.lit(False)).alias("held_out")
    return docs.select(F.col(id_col).cast("long"), held, F.col(text_col)).mapInArrow(lean(run), f"`{id_col}` long, held_out boolean, lang_pred string, score double")


def least_score(languages: int) -> float:
    """A score little above what chance gives among so many languages: a fifth above an even share, one half at most."""
    return min(0.5, 1.2 / max(1, languages))


def accepts(model, least: float, text_col: str = "text"):
    """A mapInArrow function that keeps whole rows whose text is of a language with at least this score.

    model: the broadcast of Model.packed(). Rows pass in small slices; no column changes.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(*model.value))
        for part in row_slices(batches):
            found = scorer.predict_all(part.column(text_col).to_pylist())
            yield part.filter(pa.array([lang != "und" and score >= least for lang, score in found], pa.bool_()))

    return lean(keep)
