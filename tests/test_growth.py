"""What must hold at any depth, length and size: key counts, numbering by ranges, scans of stores, files that grow."""

import json
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarnfield.functions import json as J
from tarnfield.operators import dictionary, encoding, formats, shapes
from tarnfield.plans.sidecar import Options, ship
from tarnfield.session import prepared
from tarnfield.sources import lines, store
from tarnfield.streaming import follow, tail


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    return prepared(spark)


def keys_in(value):
    if isinstance(value, dict):
        for k, v in value.items():
            yield k
            yield from keys_in(v)
    elif isinstance(value, list):
        for v in value:
            yield from keys_in(v)


def test_key_frequency_at_any_depth(spark):
    deep = {"leaf": 1}
    for i in range(150):
        deep = {"down": deep, "list": [{"in": i}, []]}
    tricky = {'a"b': 'x":', "c\\": ['":', '"', "\\\":{"], "": {"é\n": None, "": ":"}, "plain": 'say "k": 1', "t": "\t"}
    records = [deep, tricky, {"leaf": {"leaf": {"leaf": []}}}, {}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "line_no long, raw string").withColumn("v", J.parsed(F.col("raw")))
    want, first = Counter(), {}
    for i, r in enumerate(records):
        for k in keys_in(r):
            want[k] += 1
            first.setdefault(k, i)
    assert {r.key: (r.n, r.first_seen) for r in dictionary.key_frequency(df).collect()} == {k: (n, first[k]) for k, n in want.items()}


def test_codes_leave_out_all_keys_of_the_data(spark):
    rows = [(c, 5, 0) for c in "abcdefghijklmnopqrstuvwxyz"] + [("long name", 9, 1), ("other", 9, 2), ("aa", 1, 3)]
    got = [(r.key, r.code) for r in dictionary.train(spark.createDataFrame(rows, "key string, n long, first_seen long"), 4).orderBy(F.desc("n"), "code").collect()]
    assert got == [("long name", "ab"), ("other", "ac"), ("a", "ad"), ("b", "ae")]


def test_dictionary_by_ranges(spark):
    rng = random.Random(2)
    values = ["".join(rng.choice("abcé\U0001f600Z") for _ in range(rng.randrange(4))) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x string")
    want = {v: i for i, v in enumerate(sorted(set(values), key=str.encode))}
    for splitters in (5, 64, 10_000):
        assert {r.value: r.id for r in encoding.dictionary(df, "x", splitters=splitters).collect()} == want


def test_numbering_by_ranges_of_lines(spark, monkeypatch):
    monkeypatch.setattr(shapes, "BUCKET_LINES", 7)
    monkeypatch.setattr(shapes, "BATCH_ROWS", 5)
    rng = random.Random(4)
    rows = [(f, n, rng.choice("pqr")) for f in ("one", None, "two") for n in rng.sample(range(200), 90)]
    df = spark.createDataFrame(rows, "file string, line_no long, shape string")
    split = df.withColumn("line_no", F.struct(F.floor(F.col("line_no") / 50).alias("block"), F.col("line_no").alias("row")))
    place, major = {}, {}
    for f in ("one", None, "two"):
        mine = sorted((n, s) for x, n, s in rows if x == f)
        first = {s: min(n for n, t in mine if t == s) for _, s in mine}
        for s in first:
            place |= {(f, n): i for i, n in enumerate(n for n, t in mine if t == s)}
        major |= {(f, n): i for i, (n, s) in enumerate(sorted(mine, key=lambda x: (first[x[1]], x[0])))}
    for table, line in ((df, "line_no"), (split, "line_no.row")):
        got = shapes.numbered(table).select("file", F.col(line).alias("n"), "window", "window_row").collect()
        assert {(r.file, r.n): r.window * 5 + r.window_row for r in got} == place and len(got) == len(rows)
        got = shapes.shape_major(table).select("file", F.col(line).alias("n"), "out_no").collect()
        assert {(r.file, r.n): r.out_no for r in got} == major and len(got) == len(rows)


def test_datadog_time_that_is_none(spark):
    df = spark.createDataFrame([('{"ts":"no time","a":1}',), ('{"a":2}',)], "raw string").select(J.as_map(J.parsed(F.col("raw"))).alias("m"))
    got = [json.loads(r[0]) for r in df.select(formats.formatted(F.col("m"), "datadog", F.lit(7))).collect()]
    assert got == [{"timestamp": None, "a": 1}, {"timestamp": 7, "a": 2}]


def test_shipping_from_a_store(spark, tmp_path):
    texts = [json.dumps(r) for r in [{"ts": "2024-01-01T00:00:00Z", "a": None, "b": [1]}, {"timestamp": "2024-02-01T00:00:00Z", "b": 1.5}, {"a": "x"}, {"ts": "2025-01-01T00:00:00Z", "a": {"c": 1}}]]
    rows = lines.classified(spark.createDataFrame([("f", i, t) for i, t in enumerate([*texts, "", "{"])], "file string, line_no long, raw string"))
    store.write(rows, str(tmp_path / "s"), {"a": "string"})
    stored = store.read(spark, str(tmp_path / "s"))
    for options in (Options(fields=["b", "a"], until="2024-06-01T00:00:00Z"), Options(since="2024-01-15T00:00:00Z"), Options(fields=["a"], format="elastic"), Options()):
        got, want = (sorted(map(tuple, ship(x, options, "line_no").collect())) for x in (stored, rows))
        assert got == want and got
    plan = ship(stored, Options(fields=["b"], since="2024-01-01T00:00:00Z", until="2024-06-01T00:00:00Z"))._jdf.queryExecution().executedPlan().toString()
    pushed, schema = plan.split("PushedFilters: [")[1].split("\n")[0], plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "time__ms" in pushed and "IsNull(time__ms)" in pushed
    assert "raw" not in schema and "f__a" not in schema


def drained(spark, path, out, **more):
    query = follow.start(follow.follow_growing(spark, path, **more).select("raw"), "parquet", f"{out}/rows", f"{out}/state")
    query.awaitTermination()
    return sorted(r.raw for r in spark.read.schema("raw string").parquet(f"{out}/rows").collect())


def test_growing_files(spark, tmp_path):
    log, out = tmp_path / "logs" / "a.log", str(tmp_path / "out")
    log.parent.mkdir()
    log.write_text("﻿one\r\ntwo\nthr", encoding="utf-8")
    pattern = f"{log.parent}/*.log"
    assert drained(spark, pattern, out) == ["one", "two"]
    with log.open("a") as f:
        f.write("ee\n\nfour\n")
    assert drained(spark, pattern, out) == ["", "four", "one", "three", "two"]
    os.rename(log, log.with_name("old.log"))
    log.write_text("five\n")
    with log.with_name("old.log").open("a") as f:
        f.write("late\n")
    assert drained(spark, pattern, out) == ["", "five", "four", "late", "one", "three", "two"]
    log.write_text("6\n")  # truncated
    assert drained(spark, pattern, out) == ["", "6", "five", "four", "late", "one", "three", "two"]


def test_growing_ranges_and_limits(tmp_path):
    """Every line is in exactly one range, wherever ranges end; a limited reader takes so many lines at a time."""
    path = tmp_path / "x.log"
    texts = ["a" * n for n in (0, 1, 5, 30, 0, 0, 2, 9)] * 3
    path.write_text("".join(f"{t}\n" for t in texts) + "open")
    for chunk in (1, 2, 7, 31, 1000):
        reader = tail._Ranges({"path": str(path), "bytesPerTask": str(chunk)})
        end = reader.latestOffset()
        got = [t for part in reader.partitions({}, end) for _, _, t in tail.lines_of(part)]
        assert got == texts
    reader, at, got = tail._Limited({"path": str(tmp_path / "*.log"), "linesPerTrigger": "7"}), {}, []
    (tmp_path / "y.log").write_text("p\nq\n")
    while True:
        rows, end = reader.read(at)
        rows = list(rows)
        if end == at:
            break
        assert len(rows) <= 7 and rows == list(reader.readBetweenOffsets(at, end))
        at, got = end, got + [r[2] for r in rows]
    assert got == [*texts, "p", "q"]
