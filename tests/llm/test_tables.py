"""Operators that group and join, against plain Python."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
import xxhash

pytest.importorskip("tarnfield.llm")
from tarnfield.llm import exact_dedup, mixing, queries, simhash, suffix_dedup, url_filter, warc
from tarnfield.llm.common import table

from .cases import DOCS, PAGES, as_rows, documents, pages


def docs_of(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


# --- exact dedup -------------------------------------------------------------


def test_exact_dedup_edges(spark):
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    got = exact_dedup.exact_dedup(documents(spark)).collect()
    assert len(got) == len(DOCS)
    groups = defaultdict(list)
    for i, t, *_ in DOCS:
        groups[norm(t)].append((-len(t or ""), math.inf if i is None else i, i))
    want = sorted(repr((i, min(groups[norm(t)])[2], len(groups[norm(t)]))) for i, t, *_ in DOCS)
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size)) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.exact_dedup(documents(spark, [])).count() == 0


def test_exact_dedup_hashes_survivors_only(spark):
    rows = [(i, f"text number {i} " * 20, "en", "a") for i in range(300)] + [(1000 + i, "copy " * 100, "en", "a") for i in range(200)]
    got = exact_dedup.exact_dedup(documents(spark, rows))
    assert Counter(r.group_size for r in got.collect()) == {1: 300, 200: 200}
    assert not any(x in got._jdf.queryExecution().toString() for x in ("Python", "Arrow"))


# --- mixing ------------------------------------------------------------------


def fill(sizes, weights, total):
    """Shares by weight; excess is shared again among the rest until none is above 3 times its size."""
    target, full = {}, set()
    while True:
        rest = [s for s in sizes if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        w = sum(weights[s] for s in rest)
        target = {s: 3.0 * sizes[s] if s in full else left * weights[s] / w for s in sizes}
        over = [s for s in rest if target[s] > 3 * sizes[s] * (1 + 1e-12)]
        if not over:
            return target
        full.update(over)


def check_mix(rows, docs):
    size = lambda t: len((t or "").encode().split())
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += size(t)
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want = fill(sizes, weights, sum(sizes.values()))
    got = mixing.mix(docs, carry={"src": docs["source"]}).collect()
    assert sorted((r.doc_id or -99, r["size"]) for r in got) == sorted((i or -99, size(t)) for i, t, *_ in rows)
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.src], rel=1e-9) and r.source_size == sizes[r.src]
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.src] += r.taken
    for s in names:
        assert abs(taken[s] - want[s]) <= 1
    assert as_rows(mixing.mix(docs).drop("position")) == as_rows(mixing.mix(docs.repartition(3)).drop("position"))
    return got


def test_mixing(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    check_mix([tuple(r) for r in docs.collect()], docs)
    check_mix(DOCS, documents(spark))
    skewed = [(i, "w " * (i % 7 + 1), "en", "big" if i % 3 else f"s{i % 11}") for i in range(500)]
    got = check_mix(skewed, documents(spark, skewed))
    assert all(0 <= r.position < 1 for r in got if r.taken)
    assert mixing.mix(documents(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(documents(spark, DOCS[1:4])).collect()] == [0, 0, 0]


def test_positions_invert_the_schedule(spark):
    """Up to each time, a source has been given the integral of its weight schedule."""
    rows = [(i, "w " * 10, "en", "abc"[i % 3]) for i in range(3000)]
    mixed = mixing.copies(mixing.mix(documents(spark, rows))).collect()
    for r in mixed[::50]:
        t, q = r.position, (r.copy * r.source_size + r.start) / r.target
        assert r.ramp * t + (1 - r.ramp) * t * t == pytest.approx(q, abs=1e-9)
    order = [r.position for r in mixing.in_training_order(mixing.copies(mixing.mix(documents(spark, rows)))).collect()]
    assert order == sorted(order)


# --- simhash -----------------------------------------------------------------


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(items):
    """(id, fp) -> smallest id reachable over all pairs."""
    fps = sorted({f for _, f in items})
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = {}
    for i, f in items:
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return {f: least.get(root(f)) for f in fps}


def test_simhash_query(spark, sf_dir):
    docs = docs_of(spark, sf_dir).collect()
    items = [(r.doc_id, plain_fingerprint(r.text)) for r in docs]
    comp = plain_components(items)
    want = sorted(repr((i, f"{f:016x}", comp[f])) for i, f in items)
    assert as_rows(queries.op9_simhash(spark, sf_dir)) == want


def test_simhash_links_are_those_of_all_pairs(spark):
    """Random fingerprints with chains and crowded neighbourhoods, the top bit included."""
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(200)}
    for centre in rng.sample(sorted(fps), 20):
        f = centre
        for _ in range(15):
            f ^= 1 << rng.randrange(64)
            fps.add(f)
            if rng.random() < 0.5:
                fps.add(f ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    hot = rng.getrandbits(64)
    fps |= {hot ^ 1 << i for i in range(64)} | {hot ^ 3 << i for i in range(62)} | {hot ^ 1 << 63}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    nodes = sorted(fps)
    comp = plain_components([(signed(f), f) for f in nodes])
    edges = simhash.links(spark.createDataFrame([(signed(f),) for f in nodes], "fp long"))
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2 for r in edges.collect())
    got = {r.node: r.component for r in simhash.components(edges).collect()}
    assert {signed(f): got.get(signed(f), signed(f)) for f in nodes} == {signed(f): c for f, c in comp.items()}


def test_simhash_edges(spark):
    got = simhash.near_duplicates(documents(spark)).collect()
    items = [(i, plain_fingerprint(t)) for i, t, *_ in DOCS]
    comp = plain_components(items)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, signed(f), comp[f])) for i, f in items)
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


# --- suffix dedup ------------------------------------------------------------


def plain_cut(texts):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + 200] for r in raws for i in range(len(r) - 199))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - 199):
            if seen[r[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(c for c, g in zip(r, gone) if not g)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def check_cut(df, rows, **more):
    want = sorted(repr((i, *x)) for (i, _), x in zip(rows, plain_cut([t for _, t in rows])))
    assert as_rows(suffix_dedup.remove_repeats(df, digests=True, **more)) == want


@pytest.mark.parametrize("hot_above", [suffix_dedup.HOT, 3])
def test_suffix_dedup(spark, sf_dir, hot_above):
    docs = docs_of(spark, sf_dir)
    check_cut(docs, [(r.doc_id, r.text) for r in docs.collect()], hot_above=hot_above)
    check_cut(documents(spark), [r[:2] for r in DOCS], hot_above=hot_above)


@pytest.mark.parametrize("hot_above", [suffix_dedup.HOT, 3])
def test_suffix_dedup_lengths_around_the_window(spark, hot_above):
    """Shared strings of 195 to 420 bytes, in chains where different partners cover different parts."""
    rng = random.Random(7)
    junk = lambda n: "".join(rng.choice("abcdefgh ij") for _ in range(n))
    base = junk(900)
    rows = []
    for i in range(120):
        a, n = rng.randrange(500), rng.choice([195, 199, 200, 201, 205, 230, 260, 300, 350, 420])
        rows.append((i, junk(rng.randrange(150)) + base[a : a + n] + junk(rng.randrange(150)), "en", "s"))
    rows += [(500, "z" * 450, "en", "s"), (501, "é" * 99 + "q", "en", "s"), (502, "é" * 100, "en", "s"), (503, "é" * 100, "en", "s")]
    check_cut(documents(spark, rows), [r[:2] for r in rows], hot_above=hot_above)
    assert suffix_dedup.remove_repeats(documents(spark, [])).count() == 0


def test_suffix_runs_at_the_border_between_ways(spark):
    """A passage in so many texts that its leading bytes are just not, and just, too frequent for a bucket."""
    rng = random.Random(9)
    junk = lambda n: "".join(rng.choice("abcdefgh ij") for _ in range(n))
    passage = junk(260)
    rows = [(i, junk(180) + passage + junk(180), "en", "s") for i in range(40)]
    for hot_above in (39, 40, 41):
        check_cut(documents(spark, rows), [r[:2] for r in rows], hot_above=hot_above)


def test_suffix_anchors_over_chunks(monkeypatch):
    rng = random.Random(3)
    raw = bytes(rng.choice(b"abcd") for _ in range(5000))
    whole = suffix_dedup.anchors(raw, suffix_dedup.Rolling(1 << 13))
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    parts = suffix_dedup.anchors(raw, suffix_dedup.Rolling(1 << 13))
    assert set(whole[0]) <= set(parts[0]) and len(set(parts[0])) == len(parts[0])
    by_place = dict(zip(*parts))
    assert all(by_place[p] == h for p, h in zip(*whole))


# --- URL filter --------------------------------------------------------------


def plain_url(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def plain_rule(host, path):
    best = None
    for rule, verdict in url_filter.RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return best or (None, None)


def test_url_filter(spark, sf_dir):
    for df, rows in ((documents_pages := table(spark, sf_dir, "pages"), documents_pages.collect()), (pages(spark), pages(spark).collect())):
        want = Counter()
        for r in rows:
            host, path = plain_url(r.url)
            want[r.page_id, host, path, plain_rule(host, path)[0]] += 1
        got = url_filter.filter_urls(df).collect()
        assert Counter((r.page_id, r.host, r.path, r.rule) for r in got) == want
        for r in got:
            assert r.verdict in ("allow", "block")
            if r.rule:
                assert r.verdict == plain_rule(r.host, r.path)[1]
    assert url_filter.filter_urls(pages(spark, [])).count() == 0


def test_url_segments():
    s = url_filter.Segmenter({"best": 50, "casino": 20, "be": 60, "st": 5, "news": 40, "new": 30, "sonline": 1, "online": 30})
    assert s.letters("bestcasinoonline") == ["best", "casino", "online"]
    assert s.host("best2.newsonline.beonline") == ["best", "0", "news", "online", "be", "online"]
    assert "".join(s.letters("zzqqbest")) == "zzqqbest"


def best_split(text, counts):
    """The greatest joint log probability over all ways to cut a short text."""
    total = sum(counts.values()) + 1
    cost = lambda w: math.log(counts[w] / total) if w in counts else math.log(10 / total) - len(w) * math.log(10)
    if not text:
        return 0.0
    return max(cost(text[:n]) + best_split(text[n:], counts) for n in range(1, len(text) + 1))


def test_url_segments_are_the_best_of_all():
    rng = random.Random(6)
    for _ in range(60):
        counts = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 5))): rng.randrange(1, 500) for _ in range(6)}
        text = "".join(rng.choice("abc") for _ in range(9))
        cut = url_filter.Segmenter(counts).letters(text)
        total = sum(counts.values()) + 1
        score = sum(math.log(counts[w] / total) if w in counts else math.log(10 / total) - len(w) * math.log(10) for w in cut)
        assert "".join(cut) == text and score == pytest.approx(best_split(text, counts))


def test_url_verdicts_as_a_plain_naive_bayes(spark, sf_dir):
    import re

    df = table(spark, sf_dir, "pages")
    rows = df.collect()
    words = Counter(w for r in rows for w in re.findall(r"[a-z]+", re.sub(r"<[^>]*>", " ", r.html or "").lower()))
    segmenter = url_filter.Segmenter(words)
    split = [(r.page_id, *(hp := plain_url(r.url)), plain_rule(*hp)[1], url_filter.tokens(segmenter, *hp)) for r in rows]
    counts = {v: Counter(t for *_, ruled, ts in split if ruled == v for t in ts) for v in ("block", "allow")}
    n = {v: sum(ruled == v for *_, ruled, _ in split) for v in counts}
    smooth = 0.5 * max(len(counts["block"] | counts["allow"]), url_filter.LEAST_VOCABULARY)
    log = lambda t, v: math.log((counts[v][t] + 0.5) / (sum(counts[v].values()) + smooth))
    got = {r.page_id: r for r in url_filter.filter_urls(df).collect()}
    assert all(n.values()) and any(ruled is None for *_, ruled, _ in split)
    for page, _, _, ruled, ts in split:
        if ruled is None:
            score = math.log(n["block"] / n["allow"]) + sum(log(t, "block") - log(t, "allow") for t in ts)
            assert got[page].score == pytest.approx(score, abs=1e-6) and got[page].verdict == ("block" if score > 0 else "allow")


def test_url_scores_follow_the_rules(spark):
    html = "casino poker win garden flower plant " * 50
    rows = [(i, f"http://casinopoker{i % 9}.net/win/{i}", html) for i in range(60)] + [(100 + i, f"http://gardenflower{i % 9}.org/fr/plant/{i}", html) for i in range(60)]
    rows += [(300, "http://winpoker.info/casino/1", html), (301, "http://flowerplant.info/garden/1", html)]
    got = {r.page_id: r for r in url_filter.filter_urls(pages(spark, rows)).collect()}
    assert got[300].verdict == "block" and got[301].verdict == "allow"


def test_url_counts_are_whole(spark):
    """Rare and long words segment hosts as frequent ones do, and each token has its own count."""
    long = "supercalifragilisticexpialidocious"
    html = "casino poker win garden flower plant " * 50
    rows = [(i, f"http://{long}poker{i % 9}.net/win/{i}", html) for i in range(60)] + [(100 + i, f"http://gardenflower{i % 9}.org/fr/plant/{i}", html) for i in range(60)]
    rows += [(300, f"http://garden{long}{long}.info/", f"{long} " * 40), (301, "http://flowerplant.info/garden/1", html)]
    whole = {r.page_id: r for r in url_filter.filter_urls(pages(spark, rows)).collect()}
    assert whole[300].verdict == "block" and whole[301].verdict == "allow"
    few = url_filter.filter_urls(pages(spark, rows), head_words=2).collect()
    assert {r.page_id: (r.verdict, r.score) for r in few} == {i: (r.verdict, r.score) for i, r in whole.items()}


# --- WARC --------------------------------------------------------------------


def test_warc_edges(spark, tmp_path):
    rows = warc.archive_pages(pages(spark), path=f"file://{tmp_path}/arc").collect()
    assert len(rows) == len(PAGES)
    want = []
    groups = defaultdict(list)
    for i, _, h in PAGES:
        groups[h or ""].append(i)
    for i, _, h in PAGES:
        raw = (h or "").encode()
        top = max((x for x in groups[h or ""] if x is not None), default=None)
        revisit = len(raw) >= 1000 and top is not None and i != top
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))
    assert warc.archive_pages(pages(spark, [])).count() == 0


def test_warc_records_are_whole(spark, tmp_path):
    import gzip

    warc.archive_pages(pages(spark), path=f"file://{tmp_path}/arc").count()
    found = [x for f in (tmp_path / "arc").glob("*.gz") for x in warc.records(gzip.open(f))]
    assert len(found) == len(PAGES) and all("x-injected" not in h for h, _ in found)
    revisits = [h for h, _ in found if h["warc-type"] == "revisit"]
    assert revisits and all(h["warc-profile"] == warc.REVISIT_PROFILE and h["warc-refers-to"].endswith(":7>") for h in revisits)
