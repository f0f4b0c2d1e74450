"""Media columns: lossless 8-bit audio storage of byte payloads, and signature sniffing of stored bytes.

An Aho-Corasick automaton finds all magic bytes of a value in one scan. At each hit the format's validator walks the
structure and confirms its length; only confirmed media count. The outermost one at the start corrects the declared
type; those within are carved out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, written

UNIT = 64
RATE = 16000
UNKNOWN = "application/octet-stream"


def _riff(data: bytes, at: int, memo: dict) -> tuple[str, int] | None:
    """RIFF: chunk sizes must fill the stated length; WAVE needs fmt and data, WEBP an image chunk, AVI a LIST."""
    if len(data) < at + 12:
        return None
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    kind, pos, seen = data[at + 8 : at + 12], at + 12, []
    if end > len(data):
        return None
    while pos + 8 <= end:
        seen.append(data[pos : pos + 4])
        size = struct.unpack_from("<I", data, pos + 4)[0]
        pos += 8 + size + (size & 1)
    if pos not in (end, end + 1):
        return None
    if kind == b"WAVE" and b"fmt " in seen and b"data" in seen:
        return "audio/wav", end - at
    if kind == b"WEBP" and seen and seen[0] in (b"VP8 ", b"VP8L", b"VP8X"):
        return "image/webp", end - at
    if kind == b"AVI " and b"LIST" in seen:
        return "video/avi", end - at
    return None


def _png(data: bytes, at: int, memo: dict) -> tuple[str, int] | None:
    """PNG: IHDR first, every chunk's CRC right, up to IEND."""
    pos, first = at + 8, True
    while pos + 12 <= len(data):
        size = struct.unpack_from(">I", data, pos)[0]
        end = pos + 12 + size
        if end > len(data) or (first and data[pos + 4 : pos + 8] != b"IHDR"):
            return None
        if zlib.crc32(memoryview(data)[pos + 4 : end - 4]) != struct.unpack_from(">I", data, end - 4)[0]:
            return None
        if data[pos + 4 : pos + 8] == b"IEND":
            return "image/png", end - at
        pos, first = end, False
    return None


def _gif(data: bytes, at: int, memo: dict) -> tuple[str, int] | None:
    """GIF: screen descriptor, then blocks up to the trailer, with at least one image."""
    n, image = len(data), False
    if n < at + 13:
        return None
    flags = data[at + 10]
    pos = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
    while pos < n:
        mark = data[pos]
        if mark == 0x3B:
            return ("image/gif", pos + 1 - at) if image else None
        if mark == 0x21:
            pos += 2
        elif mark == 0x2C and pos + 10 <= n:
            flags = data[pos + 9]
            pos += 10 + (3 << (flags & 7) + 1 if flags & 0x80 else 0) + 1
            image = True
        else:
            return None
        while pos < n and data[pos]:
            pos += 1 + data[pos]
        pos += 1
    return None


def _jpeg(data: bytes, at: int, memo: dict) -> tuple[str, int] | None:
    """JPEG: segments with lengths up to the scan, then entropy-coded bytes up to EOI; a frame header is needed."""
    pos, n, frame = at + 2, len(data), False
    while pos + 4 <= n:
        if data[pos] != 0xFF:
            return None
        mark = data[pos + 1]
        if mark == 0xFF:
            pos += 1
            continue
        if mark == 0xD9:
            return ("image/jpeg", pos + 2 - at) if frame else None
        if not 0xC0 <= mark <= 0xFE or 0xD0 <= mark <= 0xD8:
            return None
        frame = frame or (0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC))
        pos += 2 + struct.unpack_from(">H", data, pos + 2)[0]
        if mark == 0xDA:
            while True:
                pos = data.find(b"\xff", pos)
                if pos < 0 or pos + 1 >= n:
                    return None
                if data[pos + 1] == 0 or 0xD0 <= data[pos + 1] <= 0xD7:
                    pos += 2
                else:
                    break
            if data[pos : pos + 2] == b"\xff\xd9":
                return ("image/jpeg", pos + 2 - at) if frame else None
    if data[pos : pos + 2] == b"\xff\xd9" and frame:
        return "image/jpeg", pos + 2 - at
    return None


def _gzip(data: bytes, at: int, memo: dict) -> tuple[str, int] | None:
    """gzip: a whole member that inflates with the right check sum."""
    if len(data) < at + 18 or data[at + 3] & 0xE0:
        return None
    inflate = zlib.decompressobj(31)
    try:
        pos = at
        while not inflate.eof and pos < len(data):
            chunk = data[pos : pos + 65536]
            inflate.decompress(chunk)  # what comes out is dropped, so memory stays bounded
            pos += len(chunk)
    except zlib.error:
        return None
    return ("application/gzip", pos - len(inflate.unused_data) - at) if inflate.eof else None


def _places(data: bytes, mark: bytes) -> list[int]:
    out, at = [], data.find(mark)
    while at >= 0:
        out.append(at)
        at = data.find(mark, at + len(mark))
    return out


def _zip_ends(data: bytes) -> dict[int, int]:
    """Where archives start and end, by their end records: each states how far back its directory and first header lie."""
    out: dict[int, int] = {}
    for end in _places(data, b"PK\x05\x06"):
        if end + 22 <= len(data):
            size, start, note = struct.unpack_from("<IIH", data, end + 12)
            at = end - size - start
            if at >= 0 and data[at + start : at + start + 4] == b"PK\x01\x02" and end + 22 + note <= len(data):
                out.setdefault(at, end + 22 + note)
    return out


def _zip(data: bytes, at: int, memo: dict) -> tuple[str, int] | None:
    """ZIP: the end record whose directory place agrees with this first local header."""
    if "zip" not in memo:
        memo["zip"] = _zip_ends(data)
    end = memo["zip"].get(at)
    return ("application/zip", end - at) if end else None


def _pdf(data: bytes, at: int, memo: dict) -> tuple[str, int] | None:
    """PDF: a version, a startxref, and the last end mark before another PDF starts."""
    if "pdf" not in memo:
        memo["pdf"] = {mark: _places(data, mark) for mark in (b"%PDF-", b"startxref", b"%%EOF")}
    starts, refs, ends = memo["pdf"].values()
    k = bisect_right(starts, at)
    stop = starts[k] if k < len(starts) else len(data)
    last = bisect_right(ends, stop) - 1
    if not data[at + 5 : at + 8].replace(b".", b"").isdigit() or last < 0 or ends[last] < at:
        return None
    ref = bisect_right(refs, ends[last]) - 1
    return ("application/pdf", ends[last] + 5 - at) if ref >= 0 and refs[ref] > at else None


def _flac(data: bytes, at: int, memo: dict) -> tuple[str, int] | None:
    """FLAC: a stream-info block of 34 bytes and further blocks up to the last; its frames state no length, so it reaches to the value's end."""
    pos, first = at + 4, True
    while pos + 4 <= len(data):
        head = data[pos]
        size = int.from_bytes(data[pos + 1 : pos + 4], "big")
        if first and (head & 0x7F or size != 34):
            return None
        pos, first = pos + 4 + size, False
        if head & 0x80:
            return ("audio/flac", len(data) - at) if data[pos : pos + 1] == b"\xff" else None
    return None


def _ogg(data: bytes, at: int, memo: dict) -> tuple[str, int] | None:
    """Ogg: pages of version 0 with their lacing, up to the last of the stream."""
    pos = at
    while data[pos : pos + 5] == b"OggS\0" and pos + 27 <= len(data):
        count, flags = data[pos + 26], data[pos + 5]
        pos += 27 + count + sum(data[pos + 27 : pos + 27 + count])
        if pos > len(data):
            return None
        if flags & 4:
            return "audio/ogg", pos - at
    return None


#: Magic bytes of formats and the checks of their structure.
SIGNATURES = (
    (b"RIFF", _riff),
    (b"\x89PNG\r\n\x1a\n", _png),
    (b"GIF87a", _gif),
    (b"GIF89a", _gif),
    (b"\xff\xd8\xff", _jpeg),
    (b"\x1f\x8b\x08", _gzip),
    (b"PK\x03\x04", _zip),
    (b"%PDF-", _pdf),
    (b"fLaC", _flac),
    (b"OggS", _ogg),
)

_AUTOMATON: list = []


def _automaton():
    if not _AUTOMATON:
        a = ahocorasick.Automaton()
        for magic, check in SIGNATURES:
            a.add_word(magic.decode("latin-1"), (len(magic), check))
        a.make_automaton()
        _AUTOMATON.append(a)
    return _AUTOMATON[0]


def sniff(data: bytes | None) -> list[tuple[str, int, int]]:
    """(type, offset, length) of all media in data whose structure is confirmed, by offset."""
    if not data:
        return []
    found, memo = [], {}  # what validators find out about the whole value is kept, so that many magic bytes cost one scan
    for last, (n, check) in _automaton().iter(data.decode("latin-1")):
        hit = check(data, last + 1 - n, memo)
        if hit:
            found.append((hit[0], last + 1 - n, hit[1]))
    return found


def sniffed(df: DataFrame, content: str = "content", declared: str = "declared_type") -> DataFrame:
    """df with true_type, corrected, carved (array of (type, offset, length, bytes)) beside its columns.

    true_type: of the confirmed media at offset 0, else the declared type if it is none of the known ones, else
    application/octet-stream. corrected: whether that differs from the declared type. carved: media confirmed further in.
    Null content is empty content; null declared type counts as different from any. Existing columns of those three
    names are replaced; rows are neither dropped nor merged.
    """
    kept = [c for c in df.columns if c not in ("true_type", "corrected", "carved")]
    known = {"audio/wav", "image/webp", "video/avi", "image/png", "image/gif", "image/jpeg", "application/gzip", "application/zip", "application/pdf", "audio/flac", "audio/ogg"}
    part = pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, content):
            types, fixed, carved = [], [], []
            for raw, said in zip(b.column(content).to_pylist(), b.column(declared).to_pylist(), strict=True):
                found = sniff(raw)
                kind = found[0][0] if found and found[0][1] == 0 else (said if said and said not in known else UNKNOWN)
                types.append(kind)
                fixed.append(kind != said)
                carved.append([{"type": t, "offset": o, "length": n, "bytes": raw[o : o + n]} for t, o, n in found if o])
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [pa.array(types, pa.string()), pa.array(fixed), pa.array(carved, pa.list_(part))], [*kept, "true_type", "corrected", "carved"])

    added = df.sparkSession.createDataFrame([], "true_type string, corrected boolean, carved array<struct<type:string,offset:long,length:long,bytes:binary>>").schema
    return df.select(*kept).mapInArrow(run, T.StructType(df.select(*kept).schema.fields + added.fields))


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """payload as the samples of an 8-bit mono PCM WAVE file."""
    pad = len(payload) & 1
    head = b"RIFF" + struct.pack("<I", 36 + len(payload) + pad) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8)
    return b"".join((head, b"data", struct.pack("<I", len(payload)), payload, b"\0" * pad))


def samples(media: bytes) -> bytes:
    """The samples of a WAVE file, found by walking its chunks."""
    pos, end = 12, 8 + struct.unpack_from("<I", media, 4)[0]
    while pos + 8 <= end:
        size = struct.unpack_from("<I", media, pos + 4)[0]
        if media[pos : pos + 4] == b"data":
            return media[pos + 8 : pos + 8 + size]
        pos += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def stored_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, declared_type, content): texts as stored WAVE files, in a table in the shared folder.

    The payload is the UTF-8 text (null: empty) and bytes 0 up to a positive multiple of 64. The declared type is the
    unknown one, which sniffing corrects. Repeated rows are stored as often, null doc_ids are kept, an empty table is an
    empty one, and further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            raw = [(t or "").encode() for t in b.column("text").to_pylist()]
            media = [wav(x + b"\0" * (-len(x) % UNIT if x else UNIT)) for x in raw]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array([UNKNOWN] * len(raw)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "declared_type", "content"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return written(rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, declared_type string, content binary"), "media")


def media_features(stored: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of stored texts.

    All of it comes from the stored bytes: each value is sniffed, and its samples are read where a WAVE file is
    confirmed from end to end. feature: true type, what it was declared as, rate, samples, sum of the samples' distances
    from silence, zero crossings, and the types and lengths carved from within. Repeated rows come back as often; an empty
    table gives no rows; further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "content", 8 << 20):
            rows = []
            for media, said in zip(b.column("content").to_pylist(), b.column("declared_type").to_pylist(), strict=True):
                found = sniff(media)
                if not found or found[0] != ("audio/wav", 0, len(media)):
                    raise ValueError("stored media are damaged")
                payload = samples(media)
                wave = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
                crossings = int(np.count_nonzero((wave[1:] < 0) != (wave[:-1] < 0)))
                carved = ",".join(f"{t}:{n}" for t, _, n in found[1:])
                feature = f"{found[0][0]} from {said}; rate {RATE}; samples {len(payload)}; loudness {int(np.abs(wave).sum(dtype=np.int64))}; crossings {crossings}; carved [{carved}]"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes")] + [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = dict(stored.dtypes)["doc_id"]
    return stored.select("doc_id", "n_bytes", "declared_type", "content").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
