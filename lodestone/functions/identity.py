"""Content identity: fingerprints of inputs, digests of parameters, hashed credentials."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The version mark of a fingerprint, the marks of text and token inputs, and the separator.
VERSION, TEXT, TOKENS, NUL = b"ec2", b"s", b"t", b"\x00"


def _bytes(value: bytes) -> Column:
    return F.lit(bytearray(value))


def _utf8(c: Column) -> Column:
    return F.encode(c, "utf-8")


def _little_endian(c: Column) -> Column:
    """A long as eight bytes, the lowest first."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(c, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(8)]))


def _head(model: Column, dimensions: Column | None, encoding: Column | None, digest: Column | None) -> list[Column]:
    dims = F.coalesce(dimensions, F.lit(0)) if dimensions is not None else F.lit(0)
    parts = [_bytes(VERSION), _utf8(model), _utf8(dims.cast("string")), _utf8(F.coalesce(encoding, F.lit(""))) if encoding is not None else _bytes(b""), _utf8(digest) if digest is not None else _bytes(b"")]
    return [x for p in parts for x in (p, _bytes(NUL))]


def text_key(model: Column, text: Column, dimensions: Column | None = None, encoding: Column | None = None, digest: Column | None = None) -> Column:
    """SHA-256 over version, model, dimensions, encoding, parameter digest and the (normalised) text; a user is no part."""
    return F.sha2(F.concat(*_head(model, dimensions, encoding, digest), _bytes(TEXT + NUL), _utf8(text)), 256)


def token_key(model: Column, tokens: Column, dimensions: Column | None = None, encoding: Column | None = None, digest: Column | None = None) -> Column:
    """The same for an array of token ids, as little-endian 64-bit integers; never equal to a text's."""
    body = F.aggregate(tokens, _bytes(b""), lambda acc, t: F.concat(acc, _little_endian(t.cast("long"))))
    return F.sha2(F.concat(*_head(model, dimensions, encoding, digest), _bytes(TOKENS + NUL), body), 256)


def params_digest(params: Column) -> Column:
    """Digest of a map of parameter names to canonical JSON values, in order of name; empty for none.

    Values count as they are given: those of sources.requests.parse are as Spark's JSON functions write them, so that two spellings of
    one number agree; with its `line`, they are spelt as in the log, and two spellings differ."""
    entries = F.array_sort(F.map_entries(params))
    body = F.aggregate(entries, _bytes(b""), lambda acc, e: F.concat(acc, _utf8(e["key"]), _bytes(NUL), _utf8(e["value"]), _bytes(NUL)))
    return F.when(F.coalesce(F.size(params), F.lit(0)) < 1, "").otherwise(F.sha2(body, 256))


def bare_credential(credential: Column) -> Column:
    return F.regexp_replace(credential, "^Bearer ", "")


def credential_hash(credential: Column) -> Column:
    """SHA-256 of the credential without its scheme."""
    return F.sha2(bare_credential(credential), 256)


def caller_hash(credential: Column) -> Column:
    """Eight hexadecimal digits for display; empty for anonymous callers."""
    return F.when(F.coalesce(credential, F.lit("")) == "", "").otherwise(F.left(credential_hash(credential), F.lit(8)))


def shard(key: Column, shards: int = 16) -> Column:
    """The shard of a key: its first byte XOR its last."""
    return F.when(F.length(key) == 0, 0).otherwise(F.ascii(key).bitwiseXOR(F.ascii(F.right(key, F.lit(1)))) % shards)
