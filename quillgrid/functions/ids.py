"""Identity: fingerprints, record ids, tree node ids, keyed digests."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the URL namespace of name-based UUIDs (RFC 9562).
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def fingerprint(content: Column, name: Column | None = None) -> Column:
    """SHA-256 of the content, and of the file name where given, as hex."""
    raw = content.cast("binary")
    return F.sha2(raw if name is None else F.concat(raw, name.cast("binary")), 256)


def uuid5(name: Column, namespace: str = NAMESPACE_URL) -> Column:
    """Name-based UUID (SHA-1) by cutting and marking the hex digest; no UDF."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    part = lambda at, n: F.substring(h, at, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def record_id(collection: Column, source: Column, digest: Column, model: Column, namespace: Column, local_key: Column) -> Column:
    """The deterministic id of a record: equal bytes give equal ids, so that ingesting again is an upsert."""
    return uuid5(F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in (collection, source, digest, model, namespace, local_key))))


def node_id(item: Column) -> Column:
    """URL-safe base64 without padding of a struct's JSON."""
    return F.rtrim(F.translate(F.base64(F.encode(F.to_json(item), "utf-8")), "+/\r\n", "-_"), F.lit("="))


def node_of(text: Column, schema: str) -> Column:
    """The struct of a node id; null if it is none."""
    plain = F.translate(text, "-_", "+/")
    padded = F.rpad(plain, ((F.length(plain) + 3) / 4).cast("int") * 4, F.lit("="))
    return F.from_json(F.decode(F.try_to_binary(padded, F.lit("base64")), "utf-8"), schema)


def canonical_md5(values: Column) -> Column:
    """MD5 of a map's JSON with sorted keys: a cache key that does not depend on order."""
    entries = F.array_sort(F.map_entries(values))
    return F.md5(F.to_json(F.map_from_entries(entries)).cast("binary"))


def hmac(key: bytes, message: Column, digest: str = "sha256") -> Column:
    """Hex HMAC of message by a literal key, from the built-in digests."""
    plain = {"sha256": lambda x: F.sha2(x, 256), "md5": F.md5}[digest]
    key = hashlib.new(digest, key).digest() if len(key) > 64 else key
    inner, outer = (bytes(b ^ pad for b in key.ljust(64, b"\0")) for pad in (0x36, 0x5C))
    return plain(F.concat(F.lit(outer), F.unhex(plain(F.concat(F.lit(inner), message.cast("binary"))))))
