"""Chunk decoding and name decryption: Arrow-batched for what the JVM has no function for, built-in AES otherwise."""

from __future__ import annotations

import ctypes
import ctypes.util
import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType


@lru_cache(1)
def _lz4():
    for name in (ctypes.util.find_library("lz4"), "liblz4.so.1"):
        if name:
            try:
                return ctypes.CDLL(name)
            except OSError:
                continue
    return None


def lz4_block(data: bytes, size: int) -> bytes | None:
    """A raw LZ4 block that decodes to exactly `size` bytes, else None.

    The library tells the true length; without it the Arrow codec decodes, which can't, so that only a digest can tell.
    """
    if lib := _lz4():
        out = ctypes.create_string_buffer(max(1, size))
        return out.raw[:size] if lib.LZ4_decompress_safe(data, out, len(data), size) == size else None
    try:
        return pa.Codec("lz4_raw").decompress(data, size).to_pybytes()
    except Exception:  # noqa: BLE001  malformed input: not this codec
        return None


def decode_chunk(raw: bytes, size: int, md5: bytes | None, stored_first: bool) -> bytes | None:
    """The first of LZ4, zlib and stored whose digest fits (stored first if so asked); without a digest the first that decodes."""

    def zipped() -> bytes | None:
        try:
            return zlib.decompress(raw)
        except zlib.error:
            return None

    stored = lambda: raw if len(raw) == size else None
    tries = [lambda: lz4_block(raw, size), zipped]
    for attempt in [stored, *tries] if stored_first else [*tries, stored]:
        out = attempt()
        if out is not None and (md5 is None or hashlib.md5(out).digest() == md5):
            return out
    return None


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB at most, unless the session has a limit of its own.

    A worker holds a batch, what it makes of it and copies of both on their way; at 64 MB, the default, that is what grows until batches are full.
    """
    if spark.conf.get(name := "spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":
        spark.conf.set(name, "8m")


def _hand_back() -> None:
    """Return memory that this process has freed to the system, where the C library can: workers stay, and what they keep adds up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


@F.arrow_udf(BinaryType())
def decoded(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """decode_chunk of raw, size, md5, stored_first over Arrow batches; null where nothing fits or the input is null."""
    for raw, size, md5, stored_first in batches:
        rows = zip(raw, size, md5, stored_first, strict=True)
        yield pa.array((decode_chunk(r.as_py(), n.as_py(), m.as_py(), bool(s.as_py())) if r.is_valid else None for r, n, m, s in rows), pa.binary())
        _hand_back()


@F.arrow_udf(BinaryType())
def encoded(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """plain by its kind, 0: stored, 1: zlib, else: an LZ4 block."""
    lz4 = pa.Codec("lz4_raw")
    pack = {0: lambda x: x, 1: zlib.compress}
    for plain, kind in batches:
        rows = zip(plain, kind, strict=True)
        yield pa.array((pack.get(k.as_py(), lambda x: lz4.compress(x).to_pybytes())(p.as_py()) if p.is_valid else None for p, k in rows), pa.binary())
        _hand_back()


def aes_encrypted(text: Column, key_hex_text: str, iv_hex: str) -> Column:
    """AES-256-CBC of the text under a 32-character key, in base64 with _ for /; the fixed iv is not part of it."""
    sealed = F.aes_encrypt(text.cast("binary"), F.lit(key_hex_text.encode()), F.lit("CBC"), F.lit("PKCS"), F.unhex(F.lit(iv_hex)))
    return F.replace(F.base64(F.substring(sealed, 17, 2**31 - 1)), F.lit("/"), F.lit("_"))


def aes_name(sealed: Column, key_text: str, iv_hex: str) -> Column:
    """The name that aes_encrypted made; <undecryptable:...> with its first 16 characters where that fails."""
    data = F.concat(F.unhex(F.lit(iv_hex)), F.try_to_binary(F.replace(sealed, F.lit("_"), F.lit("/")), F.lit("base64")))
    plain = F.try_aes_decrypt(data, F.lit(key_text.encode()), F.lit("CBC"), F.lit("PKCS"))
    return F.coalesce(plain.cast("string"), F.concat(F.lit("<undecryptable:"), F.substring(sealed, 1, 16), F.lit(">")))
