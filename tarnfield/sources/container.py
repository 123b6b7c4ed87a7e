"""Interchange with binary record containers (optional; Parquet is the native store).

A container is, all numbers little-endian: the magic, u32 length of a JSON
header, the header, u32 CRC-32 of the body, the body. The header names the
codec. A body under a codec holds text, or for columnar data a line bitmap
frame and column frames, separated by line ends.

One container is one task's work, as its body is one compressed stream; many
containers are read in parallel. Reading takes the wanted fields as an option,
since only their columns are decoded.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.codecs import MAJORITY, PROBE_BYTES, WINDOW_BYTES, choose_auto, compress, decompress

# Fixed values of the format.
MAGIC = b"JCO1"
HYBRID_MAGIC = b"HYB1"
BITMAP_MAGIC = b"BM"
SUFFIX = ".juc"
FRAME_MAGIC = 0xC1
VERSION = 1
HYBRID_CODECS = ("brotli", "gzip", "zstd")
NULL_ENUM = 255
INT_VARINT, DELTA_ZIGZAG, TIME_DOD, BOOL_RLE, ENUM_IDS, RAW_JSON = 0, 1, 2, 3, 4, 6
WINDOW_ROWS = 4096
LEAST_RECORDS = 3
LEAST_CHARS = 64


class ContainerError(ValueError):
    """A container that breaks the format."""


def seal(header: dict, body: bytes) -> bytes:
    head = json.dumps(header, separators=(",", ":"), ensure_ascii=False).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, struct.pack("<I", zlib.crc32(body)), body])


def unseal(data: bytes) -> tuple[dict, bytes]:
    if len(data) < 12:
        raise ContainerError("too short for a container")
    if data[:4] != MAGIC:
        raise ContainerError("wrong magic")
    (n,) = struct.unpack_from("<I", data, 4)
    if 12 + n > len(data):
        raise ContainerError("header length beyond the end")
    header = json.loads(data[8 : 8 + n])
    if header.get("version") != VERSION:
        raise ContainerError(f"unsupported version {header.get('version')}")
    (crc,), body = struct.unpack_from("<I", data, 8 + n), data[12 + n :]
    if crc != zlib.crc32(body):
        raise ContainerError(f"CRC mismatch: expected {crc}, got {zlib.crc32(body)}")
    return header, body


def decode_body(body: bytes, codec: str) -> bytes:
    """The body's bytes; a hybrid body is windows of their own codecs, or one stream of an unnamed codec."""
    if codec != "hybrid":
        return decompress(body, codec)
    if body[:4] == HYBRID_MAGIC:
        (n,), at, out = struct.unpack_from("<I", body, 4), 8, []
        for _ in range(n):
            which, _, size = struct.unpack_from("<BII", body, at)
            at += 9
            out.append(decompress(body[at : at + size], HYBRID_CODECS[which]))
            at += size
        return b"".join(out)
    if not body:
        return b""
    for name in HYBRID_CODECS:
        try:
            return decompress(body, name)
        except (OSError, pa.ArrowException):
            continue
    raise ContainerError("no codec reads the body")


class Bytes:
    """A place in a frame, with checked reads."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ContainerError("frame is cut off")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, kind: str) -> int:
        return struct.unpack("<" + kind, self.take(struct.calcsize("<" + kind)))[0]

    def varint(self) -> int:
        out = shift = 0
        while True:
            b = self.take(1)[0]
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7


def bits(data: bytes, n: int) -> list[bool]:
    return [bool(data[i >> 3] >> (i & 7) & 1) for i in range(n)]


def pack(flags: list[bool]) -> bytes:
    out = bytearray((len(flags) + 7) // 8)
    for i, f in enumerate(flags):
        out[i >> 3] |= f << (i & 7)
    return bytes(out)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _unsigned(code: int) -> int | None:
    return None if code == 0 else (code - 1) >> 1 if (code - 1) % 2 == 0 else -(code >> 1)


def _code(n: int | None) -> int:
    return 0 if n is None else (2 * n if n >= 0 else -2 * n - 1) + 1


def column_values(data: bytes, rows: int) -> list:
    """A column's values; numbers are exact, of any size."""
    kind, r = data[0], Bytes(data, 1)
    if kind == INT_VARINT:
        return [_unsigned(r.varint()) for _ in range(rows)]
    if kind == DELTA_ZIGZAG:
        out, last = [], 0
        for _ in range(rows):
            step = _unsigned(r.varint())
            last += step or 0
            out.append(None if step is None else last)
        return out
    if kind == TIME_DOD:
        codes = [_unsigned(r.varint()) for _ in range(rows)]
        out = []
        for i, x in enumerate(codes):  # a null counts as 0 for the differences after it
            out.append(x or 0 if i < 2 else 0 if x is None else x + 2 * out[-1] - out[-2])
        out = [None if x is None else t for x, t in zip(codes, out)]
        return [None if t is None else datetime.fromtimestamp(t / 1000, UTC).strftime("%Y-%m-%dT%H:%M:%S.") + f"{t % 1000:03d}Z" if 10**12 < t < 2 * 10**14 else t for t in out]
    if kind == BOOL_RLE:
        out = []
        while len(out) < rows and r.at < len(data):
            value = (None, False, True)[r.take(1)[0]]
            out += [value] * r.varint()
        return (out + [None] * rows)[:rows]
    if kind == ENUM_IDS:
        words = [r.take(r.varint()).decode() for _ in range(r.take(1)[0])]
        return [None if i == NULL_ENUM else words[i] for i in r.take(rows)]
    if kind == RAW_JSON:
        return [json.loads(r.take(r.varint())) for _ in range(rows)]
    return [None] * rows


def _all_of(kind: type, values: list) -> bool:
    return any(v is not None for v in values) and all(v is None or type(v) is kind for v in values)


def _as_numbers(values: list) -> bytes | None:
    return bytes([INT_VARINT]) + b"".join(varint(_code(v)) for v in values) if _all_of(int, values) else None


def _as_differences(values: list) -> bytes | None:
    """To the value before; the format starts from the first row, so it must have one."""
    if not _all_of(int, values) or values[0] is None:
        return None
    out, last = bytearray([DELTA_ZIGZAG]), 0
    for v in values:
        out += varint(0 if v is None else _code(v - last))
        last = last if v is None else v
    return bytes(out)


def _as_runs(values: list) -> bytes | None:
    if not _all_of(bool, values):
        return None
    out = bytearray([BOOL_RLE])
    for value, run in groupby(values):
        out.append(0 if value is None else 1 + value)
        out += varint(sum(1 for _ in run))
    return bytes(out)


def _as_word_numbers(values: list) -> bytes | None:
    """Each distinct text once, rows by its number; an empty text would read as null elsewhere."""
    if not _all_of(str, values) or "" in (words := set(values) - {None}) or len(words) >= NULL_ENUM:
        return None
    place = {w: i for i, w in enumerate(sorted(words))} | {None: NULL_ENUM}
    texts = [w.encode() for w in sorted(words)]
    return bytes([ENUM_IDS, len(words)]) + b"".join(varint(len(t)) + t for t in texts) + bytes(map(place.__getitem__, values))


def _as_json(values: list) -> bytes:
    texts = [json.dumps(v, separators=(",", ":"), ensure_ascii=False).encode() for v in values]
    return bytes([RAW_JSON]) + b"".join(varint(len(t)) + t for t in texts)


def encode_column(values: list) -> bytes:
    """The smallest of the encodings that can hold the values; of equally small ones the first."""
    tried = (f(values) for f in (_as_differences, _as_numbers, _as_runs, _as_word_numbers, _as_json))
    return min((found for found in tried if found is not None), key=len)


def shape_id(keys: list[str]) -> int:
    """64-bit FNV-1a of the sorted keys joined by U+0001, over UTF-16 units."""
    h = 0xCBF29CE484222325
    for unit in memoryview("\x01".join(keys).encode("utf-16-le")).cast("H"):
        h = (h ^ unit) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def encode_frame(keys: list[str], rows: list[dict]) -> bytes:
    columns = [encode_column([r.get(k) for r in rows]) for k in keys]
    names = [struct.pack("<I", len(b)) + b for b in (k.encode() for k in keys)]
    head = struct.pack("<BIQH", FRAME_MAGIC, len(rows), shape_id(keys), len(keys))
    return b"".join([head, *names, pack([k in r for r in rows for k in keys]), *[struct.pack("<I", len(c)) + c for c in columns]])


def frames(payload: bytes) -> Iterator[tuple[str, object]]:
    """("lines", flags) and ("rows", (n, keys, presence, column slices)); columns aren't decoded here."""
    r = Bytes(payload)
    while r.at < len(payload):
        if payload[r.at] in b"\r\n":
            r.at += 1
        elif payload[r.at : r.at + 2] == BITMAP_MAGIC:
            r.at += 2
            n = r.number("I")
            yield "lines", bits(r.take((n + 7) // 8), n)
        elif payload[r.at] == FRAME_MAGIC:
            _, rows, _, n = struct.unpack("<BIQH", r.take(15))
            keys = [r.take(r.number("I")).decode() for _ in range(n)]
            there = bits(r.take((rows * n + 7) // 8), rows * n)
            yield "rows", (rows, keys, there, [r.take(r.number("I")) for _ in keys])
        else:
            raise ContainerError(f"no frame starts with byte {payload[r.at]:#x}")


def is_columnar(payload: bytes) -> bool:
    return payload[:1] == bytes([FRAME_MAGIC]) or payload[:2] == BITMAP_MAGIC


def columnar_lines(payload: bytes, fields: list[str] | None) -> Iterator[str]:
    """JSON lines in stored order, blank ones in their places; only wanted columns are decoded."""
    flags: list[bool] | None = None

    def rows() -> Iterator[str]:
        for kind, part in parts:
            if kind == "rows":
                n, keys, there, slices = part
                wanted = [k for k in fields if k in keys] if fields else keys
                at = {k: keys.index(k) for k in wanted}
                values = {k: column_values(slices[at[k]], n) for k in wanted}
                for i in range(n):
                    yield json.dumps({k: values[k][i] for k in wanted if there[i * len(keys) + at[k]]}, separators=(",", ":"), ensure_ascii=False)

    parts = frames(payload)
    if payload[:2] == BITMAP_MAGIC:
        flags = next(parts)[1]
    made = rows()
    for flag in flags or ():
        yield next(made, "") if flag else ""
    if flags is None:
        yield from made


def container_lines(data: bytes, fields: list[str] | None = None) -> Iterator[str]:
    """A container's lines; fields project in either layout. One document is one line."""
    header, body = unseal(data)
    payload = decode_body(body, header["codec"])
    back = (header.get("keyDict") or {}).get("inverse", {}) if header.get("keyDictInline") else {}
    if header.get("ndjson") and is_columnar(payload):
        yield from columnar_lines(payload, fields)
        return
    for line in payload.decode().split("\n") if header.get("ndjson") else [payload.decode()]:
        if (back or fields) and line.strip():
            value = json.loads(line, object_pairs_hook=lambda items: {back.get(k, k): x for k, x in items})
            if fields and isinstance(value, dict):
                value = {f: value[f] for f in fields if f in value}
            line = json.dumps(value, separators=(",", ":"), ensure_ascii=False)
        yield line


def columnar_payload(lines: list[str]) -> bytes | None:
    """The bitmap and frames of lines, or None for inputs too small to gain."""
    found: list[dict | None] = []
    for line in lines:
        try:
            value = json.loads(line)
        except ValueError:
            value = None
        found.append(value if isinstance(value, dict) else None)
    rows = [r for r in found if r is not None]
    if len(rows) < LEAST_RECORDS or sum(map(len, lines)) + len(lines) - 1 < LEAST_CHARS:
        return None
    shapes: dict[tuple[str, ...], list[dict]] = {}
    for row in rows:
        shapes.setdefault(tuple(sorted(row, key=lambda k: k.encode("utf-16-be"))), []).append(row)
    out = [BITMAP_MAGIC + struct.pack("<I", len(found)) + pack([r is not None for r in found])]
    out += [encode_frame(list(keys), group[i : i + WINDOW_ROWS]) for keys, group in shapes.items() for i in range(0, len(group), WINDOW_ROWS)]
    return b"\n".join(out)


def hybrid_body(payload: bytes) -> bytes:
    """The smaller of one stream under the best codec, and windows under codecs that a probe of each picks; a clear majority takes them all."""
    solid = min((compress(payload, c) for c in HYBRID_CODECS), key=len)
    windows = [payload[at : at + WINDOW_BYTES] for at in range(0, len(payload), WINDOW_BYTES)]
    picks = [min(range(len(HYBRID_CODECS)), key=lambda i: (len(compress(raw[:PROBE_BYTES], HYBRID_CODECS[i])), i)) for raw in windows]
    if picks and picks.count(top := max(set(picks), key=picks.count)) >= MAJORITY * len(picks):
        picks = [top] * len(picks)
    parts = [HYBRID_MAGIC, struct.pack("<I", len(windows))]
    for raw, i in zip(windows, picks):
        data = compress(raw, HYBRID_CODECS[i])
        parts += [struct.pack("<BII", i, len(raw), len(data)), data]
    return min(solid, b"".join(parts), key=len)


def packed(payload: bytes, codec: str, ndjson: bool, pairs: dict[str, str] | None = None) -> bytes:
    """A container of a payload under a codec; pairs is the key dictionary it was renamed with."""
    name = choose_auto(payload) if codec == "auto" else codec
    body = hybrid_body(payload) if name == "hybrid" else compress(payload, name)
    header = {"version": VERSION, "codec": name, "createdAt": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.000Z"), "ndjson": ndjson, "keyDictInline": bool(pairs), "options": {}}
    if pairs:
        header["keyDict"] = {"forward": pairs, "inverse": {c: k for k, c in pairs.items()}}
    return seal(header, body)


def renamed(text: str, pairs: dict[str, str], sort: bool = False) -> str:
    value = json.loads(text, object_pairs_hook=lambda items: {pairs.get(k, k): x for k, x in (sorted(items) if sort else items)})
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def encode_lines(lines: list[str], codec: str = "brotli", columnar: bool = False, pairs: dict[str, str] | None = None) -> bytes:
    """A container of lines; columnar output keeps records shape by shape, as the format has no line order.

    A key dictionary applies to row-wise lines only; malformed lines then raise.
    """
    payload = columnar_payload(lines) if columnar else None
    if payload is not None:
        return packed(payload, codec, True)
    if pairs:
        lines = [renamed(line, pairs) if line.strip() else line for line in lines]
    return packed("\n".join(lines).encode(), codec, True, pairs)


def encode_document(text: str, codec: str = "brotli", pairs: dict[str, str] | None = None) -> bytes:
    """A container of one JSON document, keys sorted at every depth and then renamed."""
    return packed(renamed(text, pairs or {}, sort=True).encode(), codec, False, pairs)


def _reader(fields: str | None):
    """A mapInArrow function from (file, content) to (file, line_no, raw)."""
    wanted = [f.strip() for f in fields.split(",") if f.strip()] if fields else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lines = list(container_lines(batch.column(1)[i].as_py(), wanted))
                name = [batch.column(0)[i].as_py()] * len(lines)
                yield pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array(range(len(lines)), pa.int32()), pa.array(lines, pa.string())], ["file", "line_no", "raw"])

    return read


LINES = "file string, line_no int, raw string"


def read_containers(spark: SparkSession, path: str, fields: str | None = None) -> DataFrame:
    """(file, line_no, raw) of containers; a broken one fails the query with its reason."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    return files.mapInArrow(_reader(fields), LINES)


def follow_containers(spark: SparkSession, path: str, fields: str | None = None) -> DataFrame:
    """As read_containers(), as a stream: each new container is read once."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).load(path).select(F.col("path").alias("file"), "content")
    return files.mapInArrow(_reader(fields), LINES)


def write_containers(boxes: DataFrame, uri: str) -> DataFrame:
    """Writes (file, container) rows under a folder and returns (path, bytes) of what was written.

    uri: a folder that the executors share, of any file system that Arrow
    opens. Each file is written beside its place and moved there, so a task
    that runs twice leaves one whole file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(uri)
        store.create_dir(top)
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                path = f"{top}/{name.rsplit('/', 1)[-1]}{SUFFIX}"
                part = f"{path}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as f:
                    f.write(data)
                store.move(part, path)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(data)], pa.int64())], ["path", "bytes"])

    return boxes.select("file", "container").mapInArrow(write, "path string, bytes long")


def containers(lines: DataFrame, codec: str = "brotli", columnar: bool = False) -> DataFrame:
    """(file, container binary): one container per input file's (file, line_no, raw) lines."""

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values("line_no")
        return pd.DataFrame({"file": [ordered["file"].iloc[0]], "container": [encode_lines(ordered["raw"].tolist(), codec, columnar)]})

    return lines.select("file", "line_no", "raw").groupBy("file").applyInPandas(make, "file string, container binary")
