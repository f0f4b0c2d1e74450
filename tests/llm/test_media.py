import gzip
import hashlib
import io
import struct
import wave
import zipfile
import zlib

from quillgrid.llm import media


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "x" * 100)
        z.writestr("b.txt", "y")
    return out.getvalue()


GIF = b"GIF89a\1\0\1\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
JPEG = b"\xff\xd8\xff\xe0\0\4ab\xff\xc0\0\5\x08\0\1\xff\xda\0\4xy12\xff\x003\xff\xd9"
PDF = b"%PDF-1.4\nstartxref\n0\n%%EOF"


def test_validators_and_carving():
    files = {"image/png": png(), "image/gif": GIF, "image/jpeg": JPEG, "application/zip": zipped(), "application/gzip": gzip.compress(b"abc" * 50), "application/pdf": PDF, "audio/wav": media.wav(b"12345")}
    blob, want = b"lead ", []
    for k, f in files.items():
        assert media.sniff(f)[0] == (k, 0, len(f)), k
        for cut in (f[: len(f) // 2], f[:12]):
            assert not any(o == 0 for _, o, _ in media.sniff(cut)), k
        if k != "application/pdf":
            want.append((k, len(blob), len(f)))
            blob += f + b" and "
    assert [x for x in media.sniff(blob) if x[0] != "application/pdf"] == want
    broken = bytearray(png())
    broken[30] ^= 1
    assert media.sniff(bytes(broken)) == []
    assert media.sniff(b"RIFF GIF89a \xff\xd8\xff PK\3\4 %PDF- OggS fLaC \x1f\x8b\x08") == [] == media.sniff(b"") == media.sniff(None)


def test_sniffed_frame(spark):
    data = [(1, png(), "image/jpeg", "x"), (2, b"words", "text/plain", "x"), (3, None, None, "x"), (4, b"words", "image/png", "x"), (5, b"ab" + GIF, "text/plain", "x"), (5, b"ab" + GIF, "text/plain", "x")]
    df = spark.createDataFrame(data, "id long, content binary, declared_type string, carved string")
    got = {r.id: r for r in media.sniffed(df).collect()}
    assert (got[1].true_type, got[1].corrected) == ("image/png", True)
    assert (got[2].true_type, got[2].corrected) == ("text/plain", False)
    assert (got[3].true_type, got[3].corrected) == (media.UNKNOWN, True) and got[4].true_type == media.UNKNOWN
    assert [(c.type, c.offset, bytes(c.bytes)) for c in got[5].carved] == [("image/gif", 2, GIF)]
    assert media.sniffed(df.limit(0)).count() == 0


def test_round_trip(spark):
    long = "é" * 300000
    data = [(1, None), (2, ""), (3, "a" * 64), (4, "b" * 65), (5, long), (6, "x GIF89a RIFF"), (6, "x GIF89a RIFF"), (None, "\0 end")]
    df = spark.createDataFrame([(d, t, "n", 1) for d, t in data], "doc_id long, text string, content string, n_bytes int")
    stored = media.stored_texts(df)
    raw = {(r.doc_id, r.n_bytes): bytes(r.content) for r in stored.collect()}
    got = media.media_features(stored).collect()
    assert len(got) == len(data)
    by = {r.doc_id: r for r in got}
    for d, t in data:
        b = (t or "").encode()
        p = b + b"\0" * (64 if not b else -len(b) % 64)
        r = by[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        m = raw[d, len(b)]
        assert (r.media_bytes, r.media_sha256) == (len(m), hashlib.sha256(m).hexdigest())
        with wave.open(io.BytesIO(m)) as w:
            assert w.getsampwidth() == w.getnchannels() == 1 and w.readframes(w.getnframes()) == p
    assert by[1].feature == by[2].feature and "audio/wav" in by[1].feature
    assert media.media_features(media.stored_texts(df.limit(0))).count() == 0
