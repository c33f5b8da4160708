"""Media columns: an Aho-Corasick automaton finds magic bytes, validators confirm structure and length.

What a validator confirms at the start of a value gives its type, whatever type was declared; what it confirms
further in is carved out. Text is stored as the samples of a WAV file and read back through the same sniffing.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import sliced, small_batches, table

#: The magic bytes of each format.
MAGIC = {
    b"RIFF": "audio/wav",
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"\xff\xd8\xff": "image/jpeg",
    b"%PDF-": "application/pdf",
    b"PK\x03\x04": "application/zip",
    b"\x1f\x8b\x08": "application/gzip",
}
#: Fixed value: what closes a ZIP archive; the automaton finds it too, so that no archive's start searches for it.
ZIP_END = b"PK\x05\x06"


def wav(data: bytes, at: int) -> int:
    """Each validator gives the length of the value that begins at `at`, or 0 if it isn't one."""
    if len(data) < at + 12 or data[at + 8 : at + 12] != b"WAVE":
        return 0
    end, p, seen = at + 8 + struct.unpack_from("<I", data, at + 4)[0], at + 12, set()
    if end > len(data):
        return 0
    while p + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, p)
        seen.add(name)
        p += 8 + size + size % 2
    return end - at if p == end and {b"fmt ", b"data"} <= seen else 0


def png(data: bytes, at: int) -> int:
    p, first = at + 8, True
    while p + 12 <= len(data):
        size, name = struct.unpack_from(">I4s", data, p)
        if p + 12 + size > len(data) or first and name != b"IHDR" or zlib.crc32(data[p + 4 : p + 8 + size]) != struct.unpack_from(">I", data, p + 8 + size)[0]:
            return 0
        p, first = p + 12 + size, False
        if name == b"IEND":
            return p - at
    return 0


def gif(data: bytes, at: int) -> int:
    def blocks(p: int) -> int:
        while p < len(data) and data[p]:
            p += 1 + data[p]
        return p + 1

    if len(data) < at + 13:
        return 0
    p = at + 13 + (3 << (data[at + 10] & 7) + 1 if data[at + 10] & 128 else 0)
    while p < len(data):
        if data[p] == 0x3B:
            return p + 1 - at
        if data[p] == 0x21:
            p = blocks(p + 2)
        elif data[p] == 0x2C and p + 10 < len(data):
            p = blocks(p + 11 + (3 << (data[p + 9] & 7) + 1 if data[p + 9] & 128 else 0))
        else:
            return 0
    return 0


def jpeg(data: bytes, at: int) -> int:
    p = at + 2
    while p + 4 <= len(data) and data[p] == 0xFF and 0xC0 <= data[p + 1] <= 0xFE:
        kind, size = struct.unpack_from(">xBH", data, p)
        p += 2 + size
        if size < 2:
            return 0
        if kind == 0xDA:
            while (p := data.find(b"\xff", p)) >= 0 and p + 1 < len(data):
                if data[p + 1] == 0xD9:
                    return p + 2 - at
                if data[p + 1] and not 0xD0 <= data[p + 1] <= 0xD7 and data[p + 1] != 0xFF:
                    break
                p += 1 + (data[p + 1] != 0xFF)
            if p < 0:
                return 0
    return 0


def pdf(data: bytes, at: int) -> int:
    after = data.find(b"%PDF-", at + 5)
    end = data.rfind(b"%%EOF", at, after if after > 0 else len(data))
    return end + 5 - at if end > 0 and data.find(b"startxref", at, end) > 0 else 0


def archive(data: bytes, at: int, end: int) -> int:
    """end: the place of the first end record after `at`, or -1."""
    if end < 0 or end + 22 > len(data):
        return 0
    size, start, note = struct.unpack_from("<IIH", data, end + 12)
    return end + 22 + note - at if at + start + size == end and end + 22 + note <= len(data) else 0


def gzipped(data: bytes, at: int) -> int:
    stream = zlib.decompressobj(31)
    try:
        p = at
        while p < len(data) and not stream.eof:
            part = data[p : p + 65536]
            p += len(part)
            while part and not stream.eof:
                stream.decompress(part, 1 << 20)
                part = stream.unconsumed_tail
    except zlib.error:
        return 0
    return p - len(stream.unused_data) - at if stream.eof else 0


VALID = {"audio/wav": wav, "image/png": png, "image/gif": gif, "image/jpeg": jpeg, "application/pdf": pdf, "application/gzip": gzipped}


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        out.add_word(magic.decode("latin-1"), (len(magic), kind))
    out.add_word(ZIP_END.decode("latin-1"), (len(ZIP_END), None))
    out.make_automaton()
    return out


def sniff(data: bytes, find: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, length, type) of every confirmed value; carving goes on inside a container, past its start."""
    hits = [(last + 1 - n, kind) for last, (n, kind) in find.iter(data.decode("latin-1"))]
    ends = [start for start, kind in hits if kind is None]
    out = []
    for start, kind in hits:
        if kind == "application/zip":
            k = bisect_left(ends, start)
            size = archive(data, start, ends[k] if k < len(ends) else -1)
        else:
            size = VALID[kind](data, start) if kind else 0
        if size:
            out.append((start, size, kind))
    return out


def as_wav(payload: bytes, rate: int = 8000) -> bytes:
    """A mono WAV file whose 8-bit samples are the payload, which must have an even length."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload


def samples(media: bytes) -> bytes:
    """The bytes of a WAV file's data chunk."""
    p = 12
    while p + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, p)
        if name == b"data":
            return media[p + 8 : p + 8 + size]
        p += 8 + size + size % 2
    raise ValueError("no data chunk")


def store_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 64) -> DataFrame:
    """Rows (id_col, n_bytes, declared, media): each text's UTF-8 bytes, zero-padded to a positive multiple of block, as WAV samples.

    Null texts are empty, and an empty text gives one block of zeros. `declared` says no more than that these are bytes.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(x or "").encode() for x in batch.column(1).to_pylist()]
            media = [as_wav(x.ljust(max(block, -(-len(x) // block) * block), b"\0")) for x in raw]
            sizes = list(map(len, raw))
            yield from sliced([batch.column(0), pa.array(sizes, pa.int64()), pa.array(["application/octet-stream"] * len(raw)), pa.array(media, pa.binary())], [id_col, "n_bytes", "declared", "media"], sizes)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, declared string, media binary")


def inspect_media(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", declared_col: str = "declared", length_col: str = "n_bytes") -> DataFrame:
    """What sniffing finds in a media column, and features of the samples that it reads back.

    (id_col, n_bytes, declared, detected, corrected, carved, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature). detected: the confirmed type at byte 0, else null; corrected: whether it differs from the
    declared one; carved: array of (start, length, type) confirmed further in. A value that isn't WAV is its own payload.
    Null media count as no bytes. Equal media give equal values.
    """
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType
    span = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("type", pa.string())])
    fields = [("n_bytes", pa.int64()), ("declared", pa.string()), ("detected", pa.string()), ("corrected", pa.bool_()), ("carved", pa.list_(span)), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = automaton()
        for batch in batches:
            rows = []
            for n, declared, media in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                media = media or b""
                found = sniff(media, find)
                top = next((k for start, _, k in found if start == 0), None)
                inner = [dict(zip(("start", "length", "type"), x, strict=True)) for x in found if x[0]]
                payload = samples(media) if top == "audio/wav" else media
                wave = np.frombuffer(payload, np.uint8)
                signed = wave.astype(np.int16) - 128
                crossings = int(np.count_nonzero(np.diff(signed < 0)))
                feature = f"{top or 'unknown'};peak={int(np.abs(signed).max(initial=0))};energy={int((signed.astype(np.int64) ** 2).sum())};crossings={crossings};carved={len(inner)}"
                rows.append((n, declared, top, top is not None and top != declared, inner, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            if rows:
                arrays = [pa.array(x, k) for x, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [id_col, *(n for n, _ in fields)])

    schema = f"`{id_col}` {kind.simpleString()}, n_bytes long, declared string, detected string, corrected boolean, carved array<struct<start:long,length:long,type:string>>, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return df.select(id_col, length_col, declared_col, media_col).mapInArrow(run, schema)


def op7_media_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as WAV samples, sniffed and read back."""
    return inspect_media(store_text(table(spark, sf_dir, "documents"))).drop("declared", "carved")
