"""Encodings, dictionaries, codecs, containers and streams."""

import json
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tarnfield.functions import json as J
from tarnfield.operators import codecs, dictionary, encoding
from tarnfield.session import prepared
from tarnfield.sources import container, lines


@pytest.fixture(scope="module")
def s(spark):
    return prepared(spark)


def numbers(s, values, kind="long"):
    return s.createDataFrame([(0, i, v) for i, v in enumerate(values)], f"g int, line_no int, x {kind}")


def column(df, name, order="line_no"):
    return [r[name] for r in df.orderBy(order).collect()]


SERIES = [[], [None], [None, None, 5, None, 7, 7], [2**30, -(2**31), 2**53, None, 0], [1704067200000 + i * i for i in range(50)]]


@pytest.mark.parametrize("values", SERIES)
def test_delta_round_trip(s, values):
    df = encoding.delta(numbers(s, values), "x", "g")
    last, want = 0, []
    for v in values:
        want.append(None if v is None else v - last)
        last = last if v is None else v
    assert column(df, "delta") == want
    assert column(encoding.undelta(df, "g"), "value") == values


@pytest.mark.parametrize("values", [[], [3], [3, 9], SERIES[4], [-5, 10, 2**50, 0, 1]])
def test_delta_of_delta_round_trip(s, values):
    df = encoding.delta_of_delta(numbers(s, values), "x", "g")
    got = column(df, "dod")
    assert got == [v if i < 2 else v - 2 * values[i - 1] + values[i - 2] for i, v in enumerate(values)]
    assert column(encoding.undelta_of_delta(df, "g"), "value") == values


@pytest.mark.parametrize("values", [[], [None], [True, True, None, None, False, True], [False] * 10])
def test_runs_round_trip(s, values):
    runs = encoding.run_lengths(numbers(s, values, "boolean"), "x", "g")
    assert sum(r.length for r in runs.collect()) == len(values)
    assert column(encoding.expand_runs(runs, "g"), "value", "place") == values


def test_enum_keeps_empty_text_and_many_values(s):
    values = ["", None, "b", "a", "b"] + [f"level{i:04}" for i in range(400)]
    df = numbers(s, values, "string")
    coded = encoding.enum_encode(df, "x", "g")
    assert column(coded, "id")[:5] == [0, None, 2, 1, 2]
    back = encoding.enum_decode(coded.select("g", "line_no", "id"), encoding.dictionary(df, "x", "g"), "g")
    assert column(back, "value") == values


def test_encoding_choice(s):
    rows = [{"seq": i, "big": i * 10**6, "flag": i % 2 == 0, "cat": "abc"[i % 3], "long": "x" * 20, "none": None, "level": f"l{i}" * 9, "ts": f"2024-01-01T00:00:{i:02}Z", "half": i + 0.5, "whole": float(i)} for i in range(40)]
    df = lines.classified(s.createDataFrame([("f", i, json.dumps(r)) for i, r in enumerate(rows)], "file string, line_no int, raw string"))
    p = encoding.profile(encoding.cells(df.withColumn("m", J.as_map(F.col("v")))))
    got = {r.key: (r.a, r.b) for r in p.select("key", encoding.choose_default().alias("a"), encoding.choose_logs().alias("b")).collect()}
    assert {k: v[0] for k, v in got.items()} == {
        "seq": "DELTA_ZIGZAG", "big": "INT_VARINT", "flag": "BOOL_RLE", "cat": "ENUM_IDS", "long": "RAW_JSON", "none": "RAW_JSON", "level": "RAW_JSON", "ts": "RAW_JSON", "half": "RAW_JSON", "whole": "DELTA_ZIGZAG",
    }
    assert got["ts"][1] == "TIME_DOD" and got["level"][1] == "ENUM_IDS" and got["seq"][1] == "DELTA_ZIGZAG"


def records(s, rows):
    return lines.classified(s.createDataFrame([(i, r) for i, r in enumerate(rows)], "line_no int, raw string"))


def test_key_frequency_at_every_depth(s):
    rows = ['{"a":{"b":[{"c":1},{"c":2,"d":{"a":0}}]}}', '[{"a":1}]', "5", "{bad", '{"b":null}']
    got = {r.key: (r.n, r.first_seen) for r in dictionary.key_frequency(records(s, rows)).collect()}
    assert got == {"a": (3, 0), "b": (2, 0), "c": (2, 0), "d": (1, 0)}


def test_training_leaves_out_codes_that_are_keys(s):
    rows = ['{"a":1,"message":1,"level":1}', '{"message":1,"level":1}', '{"message":1,"b":2}']
    got = {r.key: r.code for r in dictionary.train(dictionary.key_frequency(records(s, rows)), 3).collect()}
    assert got == {"message": "c", "level": "d", "a": "e"}


def test_rename_round_trip(s):
    pairs = {"message": "c", "k": "d"}
    rows = ['{"message":{"k":[{"k":1,"x":null}]},"x":"é"}', "{bad"]
    df = dictionary.rename_all(records(s, rows).select("line_no", "raw"), "raw", pairs)
    assert column(df, "renamed") == ['{"c":{"d":[{"d":1,"x":null}]},"x":"é"}', None]
    assert column(dictionary.rename_all(df, "renamed", dictionary.inverted(pairs), "back"), "back")[0] == rows[0]


def test_canonical(s):
    df = records(s, ['{"b":[{"z":1,"a":2}],"a":{"d":1,"c":null}}', "{bad"]).withColumn("c", J.canonical(F.col("raw")))
    assert column(df, "c") == ['{"a":{"c":null,"d":1},"b":[{"a":2,"z":1}]}', None]


def test_codec_resolution(s):
    assert codecs.resolve(s) == "brotli" and codecs.resolve(s, "gzip") == "gzip"
    s.conf.set(codecs.CONF, "zstd")
    try:
        assert codecs.resolve(s) == "zstd" and codecs.resolve(s, "gzip") == "gzip"
        s.conf.set(codecs.CONF, "nothing")
        assert codecs.resolve(s) == "brotli"
    finally:
        s.conf.unset(codecs.CONF)
    with pytest.raises(ValueError):
        codecs.resolve(s, "lzma")
    for name in ("brotli", "gzip", "zstd", "identity"):
        assert codecs.decompress(codecs.compress(b"abc" * 100, name), name) == b"abc" * 100
    assert codecs.choose_auto(b"abc" * 1000) in ("brotli", "gzip")


SAMPLE = [json.dumps({"id": i, "name": f"user{i % 5}", "ok": i % 3 == 0, "n": None if i % 4 else i, "o": {"x": [i]}, "t": 1704067200000 + i}) for i in range(100)]


@pytest.mark.parametrize("codec", ["brotli", "gzip", "zstd", "identity", "hybrid", "auto"])
@pytest.mark.parametrize("columnar", [False, True])
def test_container_round_trip(codec, columnar):
    text = SAMPLE[:50] + ["", "  "] + SAMPLE[50:]
    data = container.encode_lines(text, codec, columnar)
    got = list(container.container_lines(data))
    assert [json.loads(x) if x.strip() else None for x in got] == [json.loads(x) if x.strip() else None for x in text]
    some = [x for x in container.container_lines(data, ["t", "missing", "id"]) if x.strip()]
    assert some[3] == '{"t":1704067200003,"id":3}'


def test_container_errors():
    data = container.encode_lines(SAMPLE, "gzip")
    header, body = container.unseal(data)
    assert header["codec"] == "gzip" and data[-len(body) - 4 : -len(body)] == zlib.crc32(body).to_bytes(4, "little")
    for bad, why in ((data[:-1] + bytes([data[-1] ^ 1]), "CRC"), (b"XXXX" + data[4:], "magic"), (data[:8], "short"), (data[:4] + b"\xff\xff\xff\x7f" + data[8:], "header"), (container.seal({"version": 2}, b""), "version")):
        with pytest.raises(container.ContainerError, match=why):
            container.unseal(bad)


def test_columns_round_trip():
    rng = random.Random(1)
    columns = [
        [None, None], list(range(20)), [None, *range(20)], [0, None, 2], [2**30, -(2**31), 2**53, None], [True, None, False, False], ["a", None, "b"], ["", "a"], ["x" * 17, "y"],
        [1, "a", None, {"b": [1.5]}], [rng.randrange(-(10**12), 10**12) for _ in range(50)], [1.5, 2],
    ]
    for values in columns:
        assert container.column_values(container.encode_column(values), len(values)) == values


def test_containers_in_spark(s, tmp_path):
    df = s.createDataFrame([(f"f{i % 2}", i, line) for i, line in enumerate(SAMPLE)], "file string, line_no int, raw string")
    for r in container.containers(df, "zstd", columnar=True).collect():
        (tmp_path / f"{r.file}{container.SUFFIX}").write_bytes(bytes(r.container))
    got = lines.read_any(s, f"{tmp_path}/f0{container.SUFFIX}", fields="id, ok").orderBy("line_no").collect()
    assert [json.loads(r.raw) for r in got] == [{"id": i, "ok": i % 3 == 0} for i in range(0, 100, 2)]


def test_stream_dedup_state_is_bounded(s, tmp_path):
    from tarnfield.streaming import follow

    src = tmp_path / "in"
    src.mkdir()
    (src / "1.ndjson").write_text("\n".join(f'{{"a":{i % 5}}}' for i in range(50)))

    def run():
        rows = follow.follow_lines(s, str(src), files_per_batch=1)
        q = follow.start(follow.dedup_recent(rows.select(F.col("raw").alias("line")), buckets=1, most=6, kept=3), "parquet", str(tmp_path / "out"), str(tmp_path / "state"))
        q.awaitTermination()
        assert follow.health(q)["active"] is False
        return sorted(r.line for r in s.read.schema("bucket long, line string").parquet(str(tmp_path / "out")).collect())

    assert run() == [f'{{"a":{i}}}' for i in range(5)]
    (src / "2.ndjson").write_text("\n".join(f'{{"a":{i}}}' for i in (3, 4, 7)))
    assert run() == sorted([f'{{"a":{i}}}' for i in range(5)] + ['{"a":7}'])  # the checkpoint remembers


def test_stream_dedup_drops_what_the_bounded_state_forgot(s, tmp_path):
    from tarnfield.streaming import follow

    src = tmp_path / "in"
    src.mkdir()

    def run(name, values):
        (src / name).write_text("\n".join(f'{{"a":{i}}}' for i in values))
        rows = follow.follow_lines(s, str(src), files_per_batch=1).select(F.col("raw").alias("line"))
        q = follow.start(follow.dedup_all(follow.dedup_recent(rows, buckets=1, most=6, kept=3)), "parquet", str(tmp_path / "out"), str(tmp_path / "state"))
        q.awaitTermination()
        assert all("rocksdbGetCount" in op["customMetrics"] for op in q.lastProgress["stateOperators"]) and len(q.lastProgress["stateOperators"]) == 2
        return sorted(r.line for r in s.read.schema("bucket long, line string").parquet(str(tmp_path / "out")).collect())

    assert run("1.ndjson", [i % 20 for i in range(100)]) == sorted(f'{{"a":{i}}}' for i in range(20))  # forgotten within a batch
    assert run("2.ndjson", [0, 1, 20, 0]) == sorted(f'{{"a":{i}}}' for i in range(21))  # and before a restart


def test_stream_dedup_recent_is_distinct_beyond_its_bound(s, sf_dir, monkeypatch):
    """The query's rows are its SQL's, also where recent lines are too few to remember all."""
    from functools import partial

    import duckdb

    from tarnfield.plans.catalog import ORACLES, QUERIES
    from tarnfield.streaming import follow

    monkeypatch.setattr(follow, "dedup_recent", partial(follow.dedup_recent, buckets=2, most=8, kept=4))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
    rel = con.sql(ORACLES["stream_dedup_recent"])
    got = QUERIES["stream_dedup_recent"](s, sf_dir).select(*rel.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, rel.fetchall()))


def test_stream_dedup_by_time(s, tmp_path):
    from tarnfield.streaming import follow

    src = tmp_path / "in"
    src.mkdir()
    (src / "1.ndjson").write_text("\n".join(['{"id":1,"t":"2024-01-01T00:00:00Z"}', '{"id":1,"t":"2024-01-01T00:00:30Z"}', '{"id":2,"t":"2024-01-01T00:01:00Z"}']))
    rows = follow.follow_lines(s, str(src)).select(F.try_variant_get("v", "$.id", "int").alias("id"), F.try_to_timestamp(F.try_variant_get("v", "$.t", "string")).alias("t"))
    found = []
    follow.start_each(follow.dedup_within(rows, "t", "5 minutes", "id"), lambda df, _: found.extend(r.id for r in df.collect()), str(tmp_path / "state")).awaitTermination()
    assert sorted(found) == [1, 2]


def test_columns_read_back_whatever_their_encoding():
    cases = [[1, 2, 3, None, 5], [None, 1, 2], [10**18, -5], [True, None, False, False], ["a", "b", "a", None], ["", None], ["x" * 300] * 5, [None, None], [1.5, "a", {"b": [1]}], [], [str(i) for i in range(300)], [1, True]]
    for values in cases:
        data = container.encode_column(values)
        assert container.column_values(data, len(values)) == values
        assert len(data) <= len(container._as_json(values))


def test_null_times_stay_null():
    """Code 0 is null; differences go on from 0 there."""
    codes = [1704067200000, 1704067201000, None, 1704067203000]
    data = bytes([container.TIME_DOD]) + b"".join(container.varint(container._code(x)) for x in codes)
    assert container.column_values(data, 4) == ["2024-01-01T00:00:00.000Z", "2024-01-01T00:00:01.000Z", None, codes[3] - 1704067201000]


def test_hash31_of_any_text(spark):
    from tarnfield.functions import values as V

    texts = ["", "abc", "é\u4e2d", "a\U0001f600b", "x" * 100, None]

    def plain(text):
        h = 0
        for unit in memoryview(text.encode("utf-16-le")).cast("H"):
            h = (h * 31 + unit) & 0xFFFFFFFF
        return h

    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", V.hash31(F.col("t")).alias("h")).collect()
    assert {r.t: r.h for r in got} == {t: None if t is None else plain(t) for t in texts} and plain("abc") == 96354


def test_hybrid_windows_of_mixed_data():
    rng = random.Random(3)
    noise = bytes(rng.randrange(256) for _ in range(70_000))
    for payload in (b"", b"a" * 300_000, noise, b"line of text\n" * 20_000 + noise + b"x" * 100_000):
        body = container.hybrid_body(payload)
        assert container.decode_body(body, "hybrid") == payload
