"""URL filters: rules first, then words of the host and path, scored.

Where no rule fits, the host's labels are split into words by unigram Viterbi
over word counts of the pages' own texts, and a multinomial naive Bayes over
the words of host and path decides. It is learned from the pages that a rule
decides. Counts of all words and tokens are tables: the most frequent words are
broadcast, substrings of distinct hosts are joined with the others, and tokens
with their weights.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import counted, top_words
from .common import materialise, row_slices

#: The contract's rules.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Words that are broadcast, of so many letters at most; the others are joined.
HEAD_WORDS = 50_000
HEAD_CHARS = 48
#: Least size of the vocabulary that the counts are smoothed over.
LEAST_VOCABULARY = 1 << 16
#: Weights are whole multiples of 1 / UNIT, so that their sums don't depend on an order.
UNIT = 1 << 36
#: Hosts that a task remembers.
MEMO = 100_000

_TAG = re.compile(r"<[^>]*>")
_WORD = re.compile(r"[a-z]+")
_LABEL = re.compile(r"[a-z]+|[0-9]+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ://, up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return counted(lambda html: _WORD.findall(_TAG.sub(" ", html).lower()), batches)


class Segmenter:
    """Splits a run of letters into the words of greatest joint probability.

    counts are the words that every host may hold, total the sum of all words'
    counts, and more those words of one host that counts doesn't have.
    """

    def __init__(self, counts: dict[str, int], total: int | None = None):
        self.total = (sum(counts.values()) if total is None else total) + 1
        self.logs = {w: math.log(n / self.total) for w, n in counts.items()}
        self.lengths = sorted({len(w) for w in counts})
        self.memo: dict[str, list[str]] = {}

    def letters(self, text: str, more: dict[str, int] | None = None) -> list[str]:
        """Each unknown piece costs 10 / total, and a tenth for each letter."""
        more = {w: math.log(n / self.total) for w, n in (more or {}).items()}
        lengths = sorted({*self.lengths, *map(len, more)}) if more else self.lengths
        start_cost, letter_cost = math.log(10.0 / self.total), math.log(10.0)
        best, back = [0.0], [0]
        open_score, open_at = 0.0, 0  # the best start of an unknown piece: best[s] + s * letter_cost
        for end in range(1, len(text) + 1):
            score, start = open_score + start_cost - end * letter_cost, open_at
            for n in lengths:
                if n > end:
                    break
                word = text[end - n : end]
                log = self.logs.get(word)
                if log is None and more:
                    log = more.get(word)
                if log is not None and (best[end - n] + log, end - n) > (score, start):
                    score, start = best[end - n] + log, end - n
            best.append(score)
            back.append(start)
            if score + end * letter_cost >= open_score:
                open_score, open_at = score + end * letter_cost, end
        out, end = [], len(text)
        while end:
            out.append(text[back[end] : end])
            end = back[end]
        return out[::-1]

    def host(self, host: str, more: dict[str, int] | None = None) -> list[str]:
        if host not in self.memo:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[host] = [w for run in _LABEL.findall(host) for w in (["0"] if run.isdigit() else self.letters(run, more))]
        return self.memo[host]


def tokens(segmenter: Segmenter, host: str, path: str, more: dict[str, int] | None = None) -> list[str]:
    """Words of the host, and the path's words with numbers alike."""
    parts = ["0" if p.isdigit() else p for p in _LABEL.findall(path.lower())]
    return [f"h:{w}" for w in segmenter.host(host, more)] + [f"p:{p}" for p in parts]


def _rare_words(hosts: DataFrame, words: DataFrame, head) -> DataFrame:
    """(host, more array of (word, n)): words of a host's substrings that the broadcast head doesn't have."""
    lengths = [r[0] for r in words.select(F.length("word")).distinct().collect()]  # distinct lengths of words: few

    def substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sizes = head.value, sorted(lengths)
        for part in row_slices(batches):
            for host in part.column(0).to_pylist():
                found: set[str] = set()
                for run in _LABEL.findall(host):
                    for n in sizes:
                        if run.isdigit() or n > len(run):
                            break
                        found.update(w for i in range(len(run) - n + 1) if (w := run[i : i + n]) not in known)
                        if len(found) > MEMO:
                            yield pa.RecordBatch.from_arrays([pa.array([host] * len(found), pa.string()), pa.array(found, pa.string())], ["host", "word"])
                            found = set()
                yield pa.RecordBatch.from_arrays([pa.array([host] * len(found), pa.string()), pa.array(found, pa.string())], ["host", "word"])

    return hosts.mapInArrow(substrings, "host string, word string").distinct().join(words, "word").groupBy("host").agg(F.collect_list(F.struct("word", "n")).alias("more"))


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", head_words: int = HEAD_WORDS) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, score (log odds of block; null where a rule decides).

    Edge cases: a null url, or one without ://, has an empty host and path and
    fits no rule; null html adds no words; without pages that rules decide, the
    rest is allowed; ties of the score are allowed; very long urls and html are
    read whole; repeated rows give repeated results; an empty table gives an
    empty result; other columns, whatever their names, are ignored.
    """
    spark = pages.sparkSession
    words = materialise(pages.select(html_col).mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "url-words")
    total = words.agg(F.sum("n")).first()[0] or 0
    head = spark.sparkContext.broadcast({w: n for w, n in top_words(words.where(F.length("word") <= HEAD_CHARS), head_words).collect()})

    parsed = pages.select(F.col(id_col).cast("long").alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    parsed = parsed.withColumn("fits", rule_of(F.col("host"), F.col("path"), rules)).select("id", "host", "path", "fits.rule", "fits.verdict")

    more = materialise(_rare_words(parsed.select("host").distinct(), words, head), "url-rare")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(head.value, total)
        for part in row_slices(batches):
            rows = zip(*(part.column(c).to_pylist() for c in ("host", "path", "more")))
            found = [tokens(segmenter, host, path, {m["word"]: m["n"] for m in rare or ()}) for host, path, rare in rows]
            yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(found, pa.list_(pa.string()))], ["id", "host", "path", "rule", "verdict", "tokens"])

    parsed = parsed.join(more, "host", "left").select("id", "host", "path", "rule", "verdict", "more")
    parsed = parsed.mapInArrow(split, "id long, host string, path string, rule string, verdict string, tokens array<string>")
    parsed = materialise(parsed.withColumn("row", F.monotonically_increasing_id()), "url-tokens")

    block = F.sum((F.col("verdict") == "block").cast("long")).alias("block")
    allow = F.sum((F.col("verdict") != "block").cast("long")).alias("allow")
    ruled = parsed.where("verdict is not null")
    counts = materialise(ruled.select("verdict", F.explode("tokens").alias("token")).groupBy("token").agg(block, allow), "url-counts")
    vocabulary, n_block, n_allow = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("block"), F.lit(0)), F.coalesce(F.sum("allow"), F.lit(0))).first()
    pages_block, pages_allow = (n or 0 for n in ruled.agg(block, allow).first())
    out = parsed.select(F.col("id").alias(id_col), "host", "path", "rule", "verdict", "row")
    if not (pages_block and pages_allow):
        return out.select(id_col, "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))

    smooth = 0.5 * max(vocabulary, LEAST_VOCABULARY)
    base = math.log((n_allow + smooth) / (n_block + smooth))
    weights = counts.select("token", F.round((F.log((F.col("block") + 0.5) / (F.col("allow") + 0.5)) + base) * UNIT).cast("long").alias("w"))
    each = parsed.where("verdict is null").select("row", F.explode("tokens").alias("token")).join(weights, "token", "left")
    scores = each.groupBy("row").agg((F.sum(F.coalesce("w", F.lit(round(base * UNIT)))) / UNIT).alias("sum"))
    score = F.when(F.col("verdict").isNull(), F.coalesce("sum", F.lit(0.0)) + math.log(pages_block / pages_allow))
    out = out.join(scores, "row", "left").withColumn("score", score)
    verdict = F.coalesce("verdict", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return out.select(id_col, "host", "path", "rule", verdict.alias("verdict"), "score")
