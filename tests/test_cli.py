"""The command line, end to end on small files."""

import json
import time

import pytest

from tarnfield.__main__ import main
from tarnfield.sources import container, lines, store
from tarnfield.streaming import follow

ROWS = ['{"ts":"2024-01-01T00:00:00Z","level":"info","message":"a","n":1}', "", '{"ts":"2024-01-02T00:00:00Z","level":"warn","message":"b","n":2}', '{"level":"info","n":2}', "{bad"]


@pytest.fixture
def source(tmp_path):
    (tmp_path / "in.ndjson").write_text("\n".join(ROWS))
    return tmp_path


def test_document_round_trip(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"b":[{"z":1,"a":"é"}],"a":1.5}')
    assert main(["compress", f"{tmp_path}/d.json", f"{tmp_path}/d.bin", "--codec", "gzip"]) == 0
    main(["decompress", f"{tmp_path}/d.bin", f"{tmp_path}/back.json"])
    assert (tmp_path / "back.json").read_text() == '{"a":1.5,"b":[{"a":"é","z":1}]}'


@pytest.mark.parametrize("columnar", [[], ["--columnar"]])
def test_lines_round_trip(spark, source, columnar, capsys):
    main(["compress-ndjson", f"{source}/in.ndjson", f"file://{source}/boxes", *columnar])
    box = capsys.readouterr().out.split()[0]
    main(["decompress-ndjson", box, f"{source}/text", "--fields", "n,level"] if columnar else ["decompress-ndjson", box, f"{source}/text"])
    got = [r.raw for r in lines.read_lines_split(spark, f"{source}/text").orderBy("line_no").collect()]
    assert got == (['{"n":1,"level":"info"}', "", '{"n":2,"level":"warn"}', '{"n":2,"level":"info"}', ""] if columnar else ROWS)


def test_ship(spark, source, capsys):
    main(["ship", f"{source}/in.ndjson", "--fields", "n,ts", "--since", "2024-01-02T00:00:00Z"])
    assert sorted(capsys.readouterr().out.split("\n")[:-1]) == ['{"n":2,"ts":"2024-01-02T00:00:00Z"}', '{"n":2}']
    main(["ship", f"{source}/in.ndjson", "--fields", "n", "--dedup"])
    assert sorted(capsys.readouterr().out.split()) == ['{"n":1}', '{"n":2}']


def test_ship_follow_resumes(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "1.ndjson").write_text("\n".join(ROWS))
    counter = follow.LineCounter()
    spark.streams.addListener(counter)
    args = ["ship", f"{tmp_path}/logs", "--fields", "n", "--format", "elastic", "--follow", "--out", f"{tmp_path}/out", "--state", f"{tmp_path}/state"]
    main(args)
    (tmp_path / "logs" / "2.ndjson").write_text('{"n":9}')
    main(args)
    for _ in range(100):  # progress is reported asynchronously
        if sum(counter.lines.values()) == 6:
            break
        time.sleep(0.1)
    spark.streams.removeListener(counter)
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect()) == ['{"n":1}', '{"n":2}', '{"n":2}', '{"n":9}']
    assert sum(counter.lines.values()) == 6


def test_ingest(spark, source):
    main(["ingest", f"{source}/in.ndjson", f"{source}/store", "--hot", "n:long,level:string"])
    df = store.read(spark, f"{source}/store")
    assert sorted(tuple(r) for r in store.select(df, {"n": None, "level": None}).collect()) == [(1, "info"), (2, "info"), (2, "warn")]


def test_follow_containers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}{container.SUFFIX}").write_bytes(container.encode_lines([json.dumps({"a": i, "b": k}) for k in range(5)] * 3, "zstd", columnar=True))
    rows = container.follow_containers(spark, f"{tmp_path}/in", "a")
    follow.start(rows, "parquet", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.schema(container.LINES).parquet(f"{tmp_path}/out").groupBy("raw").count().collect()
    assert {r.raw: r["count"] for r in got} == {'{"a":0}': 15, '{"a":1}': 15}


def test_windows_and_dictionaries_in_containers():
    import random

    rng = random.Random(2)
    mixed = "".join(json.dumps({"message": "x" * 40}) + "\n" for _ in range(3000)) + json.dumps({"noise": "".join(rng.choices("abcdefghijklmnop", k=90_000))})
    body = container.hybrid_body(mixed.encode())
    assert container.decode_body(body, "hybrid") == mixed.encode()
    windows = container.HYBRID_MAGIC + (1).to_bytes(4, "little") + b"\x01" + (3).to_bytes(4, "little") + len(z := container.compress(b"abc", "gzip")).to_bytes(4, "little") + z
    assert container.decode_body(windows, "hybrid") == b"abc"
    pairs = {"message": "a", "level": "b"}
    data = container.encode_lines(['{"message":1,"x":{"level":2}}', ""], "gzip", pairs=pairs)
    assert list(container.container_lines(data)) == ['{"message":1,"x":{"level":2}}', ""]
    assert b'"a":1' in container.decode_body(container.unseal(data)[1], "gzip")
    assert list(container.container_lines(container.encode_document('{"message":1}', pairs=pairs))) == ['{"message":1}']
