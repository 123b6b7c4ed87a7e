"""The line model, presence, projection and formats on small literal inputs."""

import json

import pytest
from pyspark.sql import functions as F

from tarnfield.functions import json as J
from tarnfield.functions import values as V
from tarnfield.operators import filters, formats, project, shapes
from tarnfield.plans.sidecar import Options, ship
from tarnfield.session import prepared
from tarnfield.sources import lines, store


@pytest.fixture(scope="module")
def s(spark):
    return prepared(spark)


def text_lines(s, rows):
    return s.createDataFrame([("f", i, r) for i, r in enumerate(rows)], "file string, line_no int, raw string")


def kinds(df):
    return [r.line_kind for r in df.orderBy("line_no").collect()]


def test_split_keeps_blank_and_last_lines(s):
    df = s.createDataFrame([(1, '﻿{"a":1}\r\n\n  \n{"a":2}\n'), (2, ""), (3, None)], "k int, t string")
    got = [(r.k, r.line_no, r.raw) for r in lines.split_text(df, "t", "k").collect()]
    assert got == [(1, 0, '{"a":1}'), (1, 1, ""), (1, 2, "  "), (1, 3, '{"a":2}'), (1, 4, ""), (2, 0, "")]


def test_line_kinds(s):
    rows = ['{"a":1}', "", " 　﻿\t", "{bad", "null", "[1,2]", "5", '"abc"', "{}", '{"a":1,"a":2}', None]
    df = lines.classified(text_lines(s, rows))
    assert kinds(df) == ["record", "blank", "blank", "malformed", "other", "other", "other", "other", "record", "record", "malformed"]
    last = df.where("line_no = 9").select(F.try_variant_get("v", "$.a", "int")).first()[0]
    assert last == 2
    columnar = lines.classified(text_lines(s, ["  ", '{"a":1}']), keep_blank_text=False).orderBy("line_no").collect()
    assert columnar[0].raw == "" and columnar[1].raw == '{"a":1}'
    with pytest.raises(Exception, match="MALFORMED|parse"):
        lines.strict(text_lines(s, ["{bad"])).collect()


def test_readers(s, tmp_path):
    (tmp_path / "a.ndjson").write_bytes('﻿{"a":1}\r\n\r\n{"a":2}\n'.encode())
    (tmp_path / "b.json").write_text('{"b":\n 1}')
    (tmp_path / "c.json").write_text("{broken")
    exact = lines.read_lines(s, f"{tmp_path}/a.ndjson").orderBy("line_no").collect()
    assert [r.raw for r in exact] == ['{"a":1}', "", '{"a":2}', ""]
    split = lines.read_lines_split(s, f"{tmp_path}/a.ndjson").orderBy("file", "line_no").collect()
    assert [r.raw for r in split] == ['{"a":1}', "", '{"a":2}']
    docs = [json.loads(r.raw) for r in lines.read_json_documents(s, f"{tmp_path}/*").collect()]
    assert sorted(map(str, docs)) == ["{'a': 1}", "{'a': 2}", "{'b': 1}"]
    assert lines.read_any(s, f"{tmp_path}/a.ndjson").where("is_record").count() == 2


def projected(s, rows, fields):
    df = lines.classified(text_lines(s, rows)).where("is_record").orderBy("line_no")
    return [r[0] for r in df.select(project.project_text(F.col("v"), fields)).collect()]


def test_projection(s):
    rows = ['{"user_id":1,"event":"x","meta":{"ip":"1"}}', '{"user_id":2}', '{"event":null}', '{"other":1}']
    assert projected(s, rows, ["event", "user_id"]) == ['{"event":"x","user_id":1}', '{"user_id":2}', '{"event":null}', "{}"]
    assert projected(s, rows, ["nothing"]) == ["{}"] * 4
    assert projected(s, rows, [])[0] == '{"event":"x","meta":{"ip":"1"},"user_id":1}'
    assert projected(s, rows[:1], ["meta"]) == ['{"meta":{"ip":"1"}}']
    assert project.parse_fields(" a, ,b ,,c") == ["a", "b", "c"] and project.parse_fields(None) == []


def test_typed_projection_of_odd_names(s):
    df = lines.classified(text_lines(s, ['{"a b":1,"it\'s":2,"x.y":"z"}', '{"a b":"no number"}']))
    got = project.project_columns(df, {"a b": "long", "it's": "long", "x.y": "string"}, "line_no").orderBy("line_no").collect()
    assert tuple(got[0]) == (0, 1, 2, "z") and tuple(got[1]) == (1, None, None, None)


def test_values_survive(s):
    big = [0, -1, 2**30, 2**31, -(2**31), 2**53, 1704067200000]
    rows = [json.dumps({"n": n, "s": "", "u": "é\U0001f600", "z": None, "b": False, "l": [], "o": {}}) for n in big]
    for row, out in zip(rows, projected(s, rows, [])):
        assert json.loads(out) == json.loads(row)
    df = lines.classified(text_lines(s, ['{"v":1}', '{"v":1.0}', '{"v":1e3}', '{"v":1.5}', '{"v":"1"}', '{"v":null}', "{}"]))
    ints = df.orderBy("line_no").select(J.is_integer_value(J.lookup(J.as_map(F.col("v")), "v"))).collect()
    assert [r[0] for r in ints] == [True, True, True, False, False, False, False]


def test_truthiness(s):
    rows = ['{"a":%s,"b":"B"}' % a for a in ("null", '""', "0", "0.0", "false", '"x"', "1", "true", "[]", "{}", '"0"')] + ['{"b":"B"}']
    df = lines.classified(text_lines(s, rows)).withColumn("m", J.as_map(F.col("v"))).orderBy("line_no")
    got = [r[0] for r in df.select(J.text_of(J.or_else(J.lookup(F.col("m"), "a"), J.lookup(F.col("m"), "b"))) == "B").collect()]
    assert [bool(g) for g in got] == [True] * 5 + [False] * 6 + [True]


TIMES = [
    '{"i":0,"ts":"2024-01-01T00:00:00Z"}', '{"i":1,"ts":"2024-01-02T00:00:00.000Z"}', '{"i":2,"ts":"2024-01-03T00:00:00Z"}', '{"i":3}', '{"i":4,"ts":null}',
    '{"i":5,"ts":"someday"}', '{"i":6,"ts":"","timestamp":"2024-01-05T00:00:00Z"}', '{"i":7,"ts":0,"timestamp":"2024-01-01T00:00:00Z"}', '{"i":8,"ts":1704153600000}',
]


def kept(s, since, until):
    df = lines.classified(text_lines(s, TIMES)).withColumn("m", J.as_map(F.col("v")))
    return [r.line_no for r in df.where(filters.in_range(filters.record_time(F.col("m")), since, until)).orderBy("line_no").collect()]


def test_time_range(s):
    assert kept(s, None, None) == list(range(9))
    assert kept(s, "2024-01-02T00:00:00Z", "2024-01-03T00:00:00Z") == [1, 2, 3, 4, 5, 8]
    assert kept(s, "2024-01-02T00:00:00Z", None) == [1, 2, 3, 4, 5, 6, 8]
    assert kept(s, "whenever", "2024-01-01T00:00:00Z") == [0, 3, 4, 5, 7]


def shipped(s, rows, **options):
    out = ship(lines.classified(text_lines(s, rows)), Options(**options), "line_no").orderBy("line_no").collect()
    return [json.loads(r.line) for r in out]


def test_elastic(s):
    rows = ['{"ts":"t","level":"info","message":"m"}', '{"timestamp":"u","msg":"n","@timestamp":"own","x":null}', '{"ts":null,"message":"","service":"s"}', "{}"]
    assert shipped(s, rows, format="elastic") == [
        {"@timestamp": "t", "message": "m", "level": "info"},
        {"@timestamp": "own", "message": "n", "msg": "n", "x": None},
        {"message": "", "service": "s"},
        {},
    ]


def test_datadog(s):
    rows = ['{"ts":"2024-01-01T00:00:00Z","level":"info","msg":"n"}', '{"ts":"2024-01-01T00:00:00Z","timestamp":5,"status":"own","level":"x"}']
    assert shipped(s, rows, format="datadog") == [{"timestamp": 1704067200000, "status": "info", "message": "n", "msg": "n"}, {"timestamp": 5, "status": "own"}]
    assert shipped(s, ['{"a":1}'], format="datadog")[0]["timestamp"] > 1_600_000_000_000
    with pytest.raises(ValueError):
        formats.formatted(F.col("m"), "syslog")


def test_filter_sees_fields_that_are_not_projected(s):
    got = shipped(s, TIMES, fields=["i"], since="2024-01-03T00:00:00Z")
    assert [r["i"] for r in got] == [2, 3, 4, 5, 6]


def test_dedup_is_an_option_and_of_the_output(s):
    rows = ['{"a":1,"b":1}', '{"a":1,"b":2}', '{"a":2,"b":1}']
    df = lines.classified(text_lines(s, rows))
    assert ship(df, Options(fields=["a"])).count() == 3
    assert ship(df, Options(fields=["a"], dedup=True)).count() == 2


def test_interleaved_shapes(s):
    rows = ['{"a":1}', '{"b":1}', '{"a":2}', '{"b":2}', '{"a":3}']
    df = shapes.with_shape(lines.classified(text_lines(s, rows)).where("is_record"))
    assert [r.raw for r in df.orderBy("line_no").collect()] == rows
    major = shapes.shape_major(df).orderBy("out_no").collect()
    assert [r.line_no for r in major] == [0, 2, 4, 1, 3]
    got = {r["shape"]: (r.n_rows, r.first_line, r.n_windows) for r in shapes.groups(df).collect()}
    assert got == {"a": (3, 0, 1), "b": (2, 1, 1)}
    assert {r.key: r.n_rows for r in shapes.key_union(df).collect()} == {"a": 3, "b": 2}


def test_windows_of_batches(s):
    df = s.range(10_000).select(F.lit("f").alias("file"), F.lit("k").alias("shape"), F.col("id").alias("line_no"))
    got = {r.window: r.n for r in shapes.numbered(df).groupBy("window").agg(F.count("*").alias("n")).collect()}
    assert got == {0: 4096, 1: 4096, 2: 1808}


def test_store_round_trip_and_pruning(s, tmp_path):
    rows = ['{"a":1,"b":"x","c":{"d":1}}', "", "  ", '{"a":null}', "{bad", '{"b":""}']
    path = f"{tmp_path}/store"
    store.write(lines.classified(text_lines(s, rows)), path, {"a": "long", "b": "string"}, codec="gzip")
    df = store.read(s, path)
    assert [r.line for r in store.to_lines(df).orderBy("line_no").collect()] == rows
    assert [r.line for r in store.to_lines(df, ["b"]).orderBy("line_no").collect()] == ['{"b":"x"}', "", "  ", "{}", "{bad", '{"b":""}']
    assert [(r.has__a, r.f__a) for r in df.orderBy("line_no").collect() if r.is_record] == [(True, 1), (True, None), (False, None)]
    plan = store.select(df.where(F.col("f__a") > 0), {"b": None})._jdf.queryExecution().toString()
    scan = plan[plan.rindex("ReadSchema") :]
    assert "f__b" in scan and "v:" not in scan.split("\n")[0] and "GreaterThan(f__a,0)" in plan
    out = f"{tmp_path}/text"
    store.write_text(store.to_lines(df), out)
    assert [r.raw for r in lines.read_lines_split(s, out).orderBy("line_no").collect()] == rows


def test_numbers(s):
    df = s.createDataFrame([(n,) for n in (0, 1, -1, 63, 64, -64, -65, 2**40, -(2**40), None)], "n long")
    got = df.select("n", V.zigzag(F.col("n")).alias("z"), V.unzigzag(V.zigzag(F.col("n"))).alias("back"), V.varint_bytes(V.zigzag(F.col("n"))).alias("b")).collect()
    for r in got[:-1]:
        assert r.z == (2 * r.n if r.n >= 0 else -2 * r.n - 1) and r.back == r.n and r.b == max(1, -(-r.z.bit_length() // 7))


def test_hash_and_codes(s):
    assert s.range(1).select(V.hash31(F.lit("abc"))).first()[0] == 96354
    codes = [r.c for r in s.range(26 + 676 + 2).select(V.base26(F.col("id")).alias("c"), "id").orderBy("id").collect()]
    assert codes[:2] == ["a", "b"] and codes[25:28] == ["z", "aa", "ab"] and codes[-3:] == ["zz", "aaa", "aab"]


def test_empty_tables(s):
    df = lines.classified(text_lines(s, []))
    assert ship(df, Options(fields=["a"], since="2024-01-01T00:00:00Z", format="elastic")).count() == 0
    assert shapes.groups(shapes.with_shape(df)).count() == 0
