"""Command line: containers in and out, ingest to a store, and shipping of logs.

    python -m tarnfield compress in.json out         one JSON document to a container
    python -m tarnfield decompress in out
    python -m tarnfield compress-ndjson in out-dir    each line file to a container
    python -m tarnfield decompress-ndjson in out-dir [--fields a,b]
    python -m tarnfield ingest in store               containers or line files to a Parquet store
    python -m tarnfield ship in [--fields a,b] [--since T] [--until T] [--format F] [--dedup] [--follow --out DIR --state DIR]
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.codecs import NAMES, resolve
from .operators.formats import FORMATS
from .operators.project import parse_fields
from .plans.sidecar import Options, ship
from .session import session
from .sources import container, lines, store


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tarnfield")
    verbs = top.add_subparsers(dest="verb", required=True)
    for verb in ("compress", "decompress", "compress-ndjson", "decompress-ndjson", "ingest"):
        p = verbs.add_parser(verb)
        p.add_argument("source")
        p.add_argument("target")
        if verb in ("compress", "compress-ndjson"):
            p.add_argument("--codec", choices=NAMES)
        if verb == "compress-ndjson":
            p.add_argument("--columnar", action="store_true")
        if verb == "decompress-ndjson":
            p.add_argument("--fields", default="")
        if verb == "ingest":
            p.add_argument("--hot", default="", help="hot fields as name:type, comma-separated")
    p = verbs.add_parser("ship")
    p.add_argument("source")
    p.add_argument("--fields", default="")
    p.add_argument("--since")
    p.add_argument("--until")
    p.add_argument("--format", choices=FORMATS, default="ndjson")
    p.add_argument("--dedup", action="store_true")
    p.add_argument("--follow", action="store_true")
    p.add_argument("--out")
    p.add_argument("--state")
    p.add_argument("--every", help="trigger interval of follow mode; without it, what is there is taken and it ends")
    return top


def _lines(spark: SparkSession, path: str):
    return lines.classified(container.read_containers(spark, path) if path.endswith(container.SUFFIX) else lines.read_lines(spark, path))


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = session()
    if a.verb == "compress":
        text = lines.read_whole(spark, a.source).first()["content"]  # one document
        with open(a.target, "wb") as f:
            f.write(container.encode_document(text, resolve(spark, a.codec)))
    elif a.verb == "decompress":
        with open(a.source, "rb") as f, open(a.target, "w") as out:
            out.write("\n".join(container.container_lines(f.read())))
    elif a.verb == "compress-ndjson":
        boxes = container.containers(lines.read_lines(spark, a.source), resolve(spark, a.codec), a.columnar)
        for path, size in container.write_containers(boxes, a.target).collect():
            print(path, size)
    elif a.verb == "decompress-ndjson":
        store.write_text(container.read_containers(spark, a.source, a.fields).withColumnRenamed("raw", "line"), a.target)
    elif a.verb == "ingest":
        hot = dict(x.split(":", 1) for x in parse_fields(a.hot))
        store.write(_lines(spark, a.source), a.target, hot)
    else:
        options = Options(parse_fields(a.fields), a.since, a.until, a.format, a.dedup)
        if a.follow:
            from .streaming import follow

            follow.start(ship(follow.follow_lines(spark, a.source), options).select(F.col("line").alias("value")), "text", a.out, a.state, a.every).awaitTermination()
        else:
            for row in ship(_lines(spark, a.source), options, *([] if a.dedup else ["file", "line_no"])).toLocalIterator():
                print(row.line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
