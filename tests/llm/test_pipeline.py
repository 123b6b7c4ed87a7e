"""The pipeline's stages, on odd rows and on a real table."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest

pytest.importorskip("tarnfield.llm")
import corpus_pipeline
from tarnfield.llm import langid
from tarnfield.llm.common import materialise, table

from .cases import DOCS, documents

STAGES = dict(corpus_pipeline.STAGES)


def test_stages_keep_columns_and_take_odd_rows(spark, sf_dir):
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "tokens":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.collect()
        assert stage(spark, documents(spark, []), sf_dir).count() == 0


def test_exact_keeps_one_row_of_each_group(spark, sf_dir):
    got = [(r.doc_id, r.text) for r in STAGES["exact"](spark, documents(spark), sf_dir).collect()]
    norm = lambda t: "".join((t or "").split(" "))
    assert len(got) == len({"".join(c for c in norm(t) if c not in "\t\n\x0b\x0c\r") for _, t in got})
    assert sum(i == 5 for i, _ in got) == 0 and sum(i == 1 for i, _ in got) == 1
    same = [(5, "a b c", "en", "a")] * 3
    assert STAGES["exact"](spark, documents(spark, same), sf_dir).count() == 1


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    k = min(k, max(1, len(words)))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def similar_pairs(rows, least=0.8):
    """All pairs of (id, text) with that Jaccard similarity, over an inverted index."""
    sets, index, shared = {i: shingles(t) for i, t in rows}, defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            index[x].append(i)
    for ids in index.values():
        shared.update(combinations(sorted(ids), 2))
    return {(a, b) for (a, b), n in shared.items() if n >= least * (len(sets[a]) + len(sets[b]) - n)}


def check_near(rows, kept):
    """No two rows that stay are similar, and every row that goes is linked to one that stays."""
    pairs = similar_pairs(rows)
    assert not [p for p in pairs if p[0] in kept and p[1] in kept]
    group = {i: i for i, _ in rows}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in pairs:
        group[max(root(a), root(b))] = min(root(a), root(b))
    assert {root(i) for i in kept} == {root(i) for i, _ in rows}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"edit{rng.random()}"
    return " ".join(out)


def test_near_links_edited_copies(spark, sf_dir):
    """Copies with few edits go, also from a large group of them; texts that share only half stay."""
    rng = random.Random(11)
    texts, n = [], 0
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(150)]
        texts += [" ".join(words), edited(rng, words, 1), edited(rng, words, 2).upper(), " ".join(words[5:]), " ".join(words[75:] + [f"n{rng.random()}" for _ in range(75)])]
    hot = [f"h{i}" for i in range(200)]
    texts += [edited(rng, hot, rng.randrange(1, 5)) for _ in range(150)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    kept = {r.doc_id for r in STAGES["near"](spark, documents(spark, rows), sf_dir).collect()}
    check_near([r[:2] for r in rows], kept)
    assert all(i * 5 + 4 in kept and not {i * 5 + 1, i * 5 + 2, i * 5 + 3} & kept for i in range(12))


def test_near_repeated_ids_and_rows(spark, sf_dir):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(3, b, "en", "s"), (5, a, "en", "s"), (5, b.upper(), "en", "s"), (7, a, "en", "s"), (8, "only one", "en", "s"), (8, "only one", "en", "s"), (None, a, "en", "s"), (9, None, "en", "s"), (10, " ", "en", "s")]
    got = [(r.doc_id, r.text) for r in STAGES["near"](spark, documents(spark, rows), sf_dir).collect()]
    assert sorted(got, key=repr) == sorted([(3, b), (5, a), (8, "only one"), (9, None)], key=repr)


def test_stages_leave_clashing_columns_alone(spark, sf_dir):
    from pyspark.sql import functions as F

    names = ("position", "row_hash", "node", "_node", "_position", "_marked", "_at", "_block", "_stays", "copy", "kept", "like", "signature", "value", "block", "order", "bucket", "words", "lang_pred", "score", "with space")
    docs = documents(spark).select("doc_id", "text", "lang", "source", *[F.col("doc_id").alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        assert all(r[n] == r.doc_id for r in out.collect() for n in names), name


def test_run_against_plain_python(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.collect()
    scorer = langid.Scorer(langid.fit(docs))
    first = [r for r in rows if (p := scorer.predict(r.text))[0] != "und" and p[1] >= langid.least_score(len(scorer.model.langs))]
    assert len(first) > 0.9 * len(rows)
    groups = {}
    for r in first:
        norm = "".join(c for c in r.text if c not in " \t\n\x0b\x0c\r")
        groups[norm] = min(groups.get(norm, r), r, key=lambda x: (-len(x.text), x.doc_id))
    second = list(groups.values())
    size = lambda t: len(t.encode().split())
    mixed = docs
    for name in ("language", "exact", "near", "mix"):
        mixed = materialise(STAGES[name](spark, mixed, sf_dir), "test")
        if name == "exact":
            assert sorted(r.doc_id for r in mixed.collect()) == sorted(r.doc_id for r in second)
        if name == "near":
            third = mixed.collect()
            check_near([(r.doc_id, r.text) for r in second], {r.doc_id for r in third})
            total = sum(size(r.text) for r in third)
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in third}
    assert 0.8 * total < sum(size(r.text) for r in mixed.collect()) < 1.4 * total  # each source ends in a whole document
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in mixed.collect())
    assert len(DOCS) and all(len(r.ids_sha256) == 64 for r in out)
