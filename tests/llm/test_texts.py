"""Operators that map over texts, against plain Python."""

import hashlib
import re
import struct
import zlib

import pytest

pytest.importorskip("tarnfield.llm")
from tarnfield.llm import bpe, langid, pii, quality, queries
from tarnfield.llm.common import table

from .cases import DOCS, as_rows, documents


def all_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def check_bpe(rows, df):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    want = []
    for doc_id, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert as_rows(df) == sorted(map(repr, want))


@pytest.mark.parametrize("table_rows", [1 << 17, 5])
def test_bpe_as_the_library(spark, sf_dir, table_rows):
    docs = all_docs(spark, sf_dir)
    check_bpe([(r.doc_id, r.text) for r in docs.collect()], bpe.encode_decode(docs, queries.tokenizer_path(), digests=True, table_rows=table_rows))
    check_bpe([r[:2] for r in DOCS], bpe.encode_decode(documents(spark), queries.tokenizer_path(), digests=True, table_rows=table_rows))


def test_bpe_by_joins_as_the_library(spark, sf_dir):
    short = all_docs(spark, sf_dir).where("length(text) < 3000")
    check_bpe([(r.doc_id, r.text) for r in short.collect()], bpe.encode_decode_joined(short, queries.tokenizer_path()))
    check_bpe([r[:2] for r in DOCS], bpe.encode_decode_joined(documents(spark), queries.tokenizer_path()))


def test_bpe_white_space_words():
    """Cutting before white space never changes ids, for every kind and mix of white space."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    spaces = ["\t", "\n", "\x0b", "\x0c", "\r", " ", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u180e", "\u2000", "\u200a", "\u200b", "\u2028", "\u2029", "\u202f", "\u205f", "\u3000", "\ufeff"]
    runs = [a + b + c for a in spaces for b in ["", " ", "\n", "  "] for c in ["", " ", "\u3000", "\x1c"]]
    for run in runs:
        for left, right in (("a", "b"), ("!", "1"), ("it", "'s"), ("", "x"), ("9", "")):
            text = left + run + right
            want = t.encode(text, add_special_tokens=False).ids
            assert want == [i for w in bpe.WORDS.findall(text) for i in t.encode(w, add_special_tokens=False).ids], repr(text)


def test_bpe_general_form(spark):
    got = {r.doc_id: r for r in bpe.encode_decode(documents(spark), queries.tokenizer_path()).collect()}
    assert got[1].decoded == DOCS[0][1] and len(got[1].ids) == got[1].n_tokens
    assert got[2].ids == [] and got[2].decoded == ""
    assert bpe.encode_decode(documents(spark, []), queries.tokenizer_path()).count() == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0,
                "phone": lambda: 10 <= len(digits) <= 15,
            }[kind]()
            if ok:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda x: (x[1], pii.BASE.index(x[0])))


TRICKY = [
    "a@b.c@d.e f@g", "@b.c@d.e", "a@b.c.d@e.f", "x@@y.z", "a.b@c-d.e-f.", "%@1.2", "1.2.3.4.5.6.7.8", "001.002.003.0255", "1..2.3.4", "256.1.1.1 1.1.1.1",
    "4111-1111-1111-1111", "4111  1111 1111 1111", "4111 1111 1111 1111 4111 1111 1111 1111", "4111111111111111x", "+1 (555) 555-5555", "+15555555555-", "++1 5555555555", "+1 2 3", "+1555 5555 5555 5555 5",
    "é a@b.c \U0001f600 1.1.1.1", "a@b.c,a@b.c", "1.1.1.1@1.1",
]


def test_pii_base_spans(spark, sf_dir):
    for text in TRICKY + [r[1] for r in DOCS if r[1] and len(r[1]) < 1000]:
        assert pii.base_spans(text) == plain_base(text), text
    for r in all_docs(spark, sf_dir).collect():
        assert pii.find(r.text)[1] == plain_base(r.text)


def test_pii_query(spark, sf_dir):
    rows = {r.doc_id: r for r in queries.op2_pii(spark, sf_dir).collect()}
    for r in all_docs(spark, sf_dir).collect():
        base = plain_base(r.text)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        got = rows[r.doc_id]
        assert got.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [got[f"n_{k}"] for k in pii.BASE] == [sum(b[0] == k for b in base) for k in pii.BASE]
        assert {*joined.split(",")} <= {*got.spans.split(","), ""}


def test_pii_method_and_edges(spark):
    got = {r.doc_id: r.spans for r in pii.find_pii(documents(spark)).collect()}
    assert [s.kind for s in got[11]] == ["iban", "national_id", "local_phone", "local_phone"]
    assert got[2] == [] and got[3] == []
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765431")
    assert pii.find("nothing 123-45-6789 nearby")[0] == []  # no checksum, no context
    assert pii.find_pii(documents(spark, [])).count() == 0
    for run in ("1" * 200_000, "a" * 200_000, "a@" * 50_000, "1." * 50_000, "+1" * 50_000, "1 " * 100_000, "+1" + " " * 100_000, "A" * 100_000 + "@b"):
        pii.find(run)  # in linear time


def test_quality_counts():
    n, chars, symbols, dup, repeat, lines = quality.text_stats("a b c a b c\na b\na b\n \n#x|")
    assert (n, symbols, dup) == (11, 2, 1)
    assert chars == len("abcabcabab#x|")
    words = "a b c a b c a b a b #x|".split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + d for i, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)}
    assert repeat == len(inside)
    assert sorted(x["words"] for x in lines) == [1, 4, 6]  # of both "a b" lines together


def test_quality_lines_and_edges(spark):
    filler = [" ".join(f"{w}{i}" for w in ("own", "line", "with", "words", "of", "its", "making")) for i in range(2000)]
    rows = [(i, "\n".join(["Common  Boiler Plate line"] + filler[i * 10 : i * 10 + 10]), "en", "h") for i in range(60)]
    rows += [(100 + i, "\n".join(["common boiler plate LINE"] * 3 + [f"x{i} y{i} z{i}"]), "en", "h") for i in range(3)]
    got = {r.doc_id: r for r in quality.quality(documents(spark, rows)).collect()}
    assert got[0].kept and got[0].n_removed_words == 4
    assert not got[100].kept and got[100].n_removed_words == 12
    odd = quality.quality(documents(spark)).collect()
    assert len(odd) == len(DOCS)
    assert all(r.base_failed and not r.kept for r in odd if r.doc_id in (2, 3, 4))
    assert quality.quality(documents(spark, [])).count() == 0


def test_langid_held_out_accuracy(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    docs = table(spark, sf_dir, "documents")
    got = langid.identify(docs).withColumnRenamed("doc_id", "id")
    rows = got.join(docs, got["id"] == docs["doc_id"]).select("id", "held_out", "lang_pred", "score", "lang").collect()
    assert all(r.held_out == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and sum(r.lang_pred == r.lang for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_langid_predictions_see_text_only(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = all_docs(spark, sf_dir)
    held = langid.remainder(F.col("doc_id")) == 0
    changed = docs.withColumn("lang", F.when(~held, F.col("lang")).otherwise("xx")).withColumn("source", F.lit("?"))
    assert as_rows(langid.identify(docs)) == as_rows(langid.identify(changed))


def test_langid_edges(spark):
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.identify(documents(spark)).collect()]
    assert len(got) == len(DOCS)
    assert all(p == "und" and s == 0 for i, p, s in got if i in (2, 3, 4, 10))
    assert all(p != "und" for i, p, s in got if i in (1, 5, 6, 7))
    unlabelled = [(i, t, None, s) for i, t, _, s in DOCS]
    assert {r.lang_pred for r in langid.identify(documents(spark, unlabelled)).collect()} == {"und"}
    assert langid.identify(documents(spark, [])).count() == 0


def test_langid_needs_a_letter(spark):
    """Numerals that the letter pattern takes are no letters, also if the model has seen them."""
    rows = [(i, f"words of some text {i} ½ ² Ⅷ", "en", "s") for i in range(20)] + [(100, "½ ²", None, "s"), (101, "Ⅷ ½a", None, "s")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(documents(spark, rows)).collect()}
    assert got[100] == ("und", 0.0) and got[101][0] == "en"
    assert langid.letter_runs("a½b ²") == ["a", "b"]


def test_langid_learns_every_language(spark):
    """A sample of a few documents of each language, however many languages and however rare."""
    rows = [(i, f"alpha{i % 7} common words", "aa", "s") for i in range(600)]
    code = lambda k: "".join("abcdefghij"[int(c)] for c in f"{k:03}")
    rows += [(1000 + 10 * k + j, f"wort{code(k)} seltene{code(k)} rede{code(k)}", f"l{k:03}", "s") for k in range(230) for j in range(4)]
    rows += [(9000, f"wort{code(229)} rede{code(229)}", None, "s"), (9001, f"seltene{code(7)}", None, "s")]
    got = {r.doc_id: r.lang_pred for r in langid.identify(documents(spark, rows), train_docs=20).collect()}
    assert got[9000] == "l229" and got[9001] == "l007" and got[3] == "aa"


def plain_prediction(rows, text):
    """The scorer as a plain sum over words, from the counts of all rows."""
    import math
    from collections import Counter

    langs = sorted({lang for lang, _ in rows})
    counts = {o: {lang: Counter() for lang in langs} for o in (0, *langid.ORDERS)}
    for lang, t in rows:
        for w in langid.letter_runs(t.lower()):
            counts[0][lang][w] += 1
            for o in langid.ORDERS:
                counts[o][lang].update(langid.grams(w, o))
    known = {o: set().union(*c.values()) for o, c in counts.items()}
    log = lambda o, lang, g: math.log((counts[o][lang][g] + 0.5) / (sum(counts[o][lang].values()) + 0.5 * len(known[o])))
    total, post, n = dict.fromkeys(langs, 0.0), dict.fromkeys(langs, 0.0), 0
    for w in langid.letter_runs(text.lower()):
        logs = [log(0, lang, w) for lang in langs] if w in known[0] else None
        for o in langid.ORDERS:
            if logs is None and (seen := [g for g in langid.grams(w, o) if g in known[o]]):
                logs = [langid.BACKOFF * sum(log(o, lang, g) for g in seen) / len(seen) for lang in langs]
        if logs:
            n += 1
            for lang, x in zip(langs, logs):
                total[lang] += x
                post[lang] += math.exp(x - max(logs)) / sum(math.exp(y - max(logs)) for y in logs)
    best = max(langs, key=total.get)
    return (best, post[best] / n) if n else ("und", 0.0)


def test_langid_as_a_plain_scorer(spark, sf_dir):
    docs = all_docs(spark, sf_dir)
    rows = [(r.lang, r.text) for r in docs.collect() if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 5]
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    for r in docs.collect()[::9]:
        if r.text and any(map(str.isalpha, r.text)):
            lang, score = plain_prediction(rows, r.text)
            assert got[r.doc_id].lang_pred == lang and got[r.doc_id].score == pytest.approx(score, abs=1e-3)


def test_langid_long_runs(spark):
    """Runs too long for words teach their n-grams, and are judged as a whole."""
    rows = [(i, "".join("abcdef"[(i + j * j) % 6] for j in range(300)), "aa", "s") for i in range(20)]
    rows += [(100 + i, "".join("uvwxyz"[(i + j * j) % 6] for j in range(300)), "zz", "s") for i in range(20)]
    turned = rows[0][1][:170] + rows[20][1] * 40
    rows += [(1000, turned, None, "s"), (1001, rows[0][1] + "u", None, "s")]
    got = {r.doc_id: r.lang_pred for r in langid.identify(documents(spark, rows)).collect()}
    assert got[1000] == "zz" and got[1001] == "aa"
    assert got[3] == "aa" and got[103] == "zz"
    for order in langid.ORDERS:
        assert [g for piece in langid.pieces(turned, order) for g in piece] == langid.grams(turned, order)


def test_quality_texts_lose_common_lines(spark):
    body = lambda i: f"first {i}\n\n  own  {i}\tline "
    rows = [(i, f"Common  Line\n{body(i)}\ncommon line", "en", "h" if i % 2 else None) for i in range(40)] + [(99, None, "en", "h"), (98, "Common line", "en", "other")]
    got = {r.doc_id: r for r in quality.quality(documents(spark, rows)).collect()}
    assert all(got[i].cleaned_text == body(i) and got[i].n_removed_words == 4 for i in range(40))
    assert got[99].cleaned_text is None and got[98].cleaned_text == "Common line"
    plain = quality.quality(documents(spark, rows), texts=False)
    assert as_rows(plain) == as_rows(quality.quality(documents(spark, rows)).drop("cleaned_text"))


def test_pii_iban_before_upper_case_words():
    found = lambda text: [text[s:e] for k, s, e, _ in pii.find(text)[0] if k == "iban"]
    assert found("IBAN DE89370400440532013000 BIC COBADEFFXXX") == ["DE89370400440532013000"]
    assert found("DE89 3704 0044 0532 0130 00 EUR 250") == ["DE89 3704 0044 0532 0130 00"]
    assert found("DE89370400440532013000 GB82WEST12345698765432") == ["DE89370400440532013000", "GB82WEST12345698765432"]
    assert found("DE88370400440532013000 BIC COBADEFFXXX") == []
    assert found("iban gb82 west 1234 5698 7654 32 is mine, IBAN GB82 WEST 1234 5698 7654 32 IS MINE") == ["gb82 west 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 32"]
    assert found("GB82 WEST 1234 5698 7654 321, ZZ82 WEST 1234 5698 7654 32") == []
    pii.find("DE89 " * 40_000)  # in linear time


def test_pii_secrets():
    found = lambda text: [text[s:e] for k, s, e, _ in pii.find(text)[0] if k == "secret"]
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    for text in (f'a token = "{key}" b', f"API_KEY: {key}", f"password={key}, x", f"Authorization: secret_key => '{key}'", f"TOKEN = {key.upper()}!!"):
        assert [x.strip("!,").lower() for x in found(text)] == [key], text
    assert found("-----BEGIN RSA PRIVATE KEY-----\nabc") == ["-----BEGIN RSA PRIVATE KEY-----"]
    assert found("AKIA" + "A1" * 8) == ["AKIA" + "A1" * 8]
    assert found("the token = something else, a token of 12345678 and secret: aaaaaaaa1") == []
    assert found(f"a placeholder token = {key}") == [] or pii.score(f"placeholder {key}", "secret", 12, 52) == pytest.approx(0.5)


def test_pii_many_spans_in_linear_time():
    import time

    text = lambda n: "x@example.org phone 555-123-4567, " * n
    began = time.perf_counter()
    few = pii.find(text(1000))
    middle = time.perf_counter()
    many = pii.find(text(8000))
    assert len(many[0]) == 8 * len(few[0]) and len(many[1]) == 8000
    assert time.perf_counter() - middle < 24 * (middle - began) + 1


def test_pii_no_further_span_over_a_base_one():
    text = "ip 10.0.0.1 token = a1b2c3d4@mail.example.org end; iban DE89370400440532013000"
    spans, base = pii.find(text)
    for k, s, e, _ in spans:
        assert (k, s, e) in base or not any(s < y and x < e for _, x, y in base)
    assert [k for k, *_ in spans] == ["ip", "email", "iban"]
