"""Hashes and line endings of content."""

from __future__ import annotations

import hashlib

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Suffixes that are text whatever their bytes.
TEXT_SUFFIXES = (".txt", ".md", ".py", ".js", ".ts", ".json", ".yaml", ".yml", ".toml", ".csv")
BINARY_PROBE, ENDING_PROBE = 512, 8192


def hasher(algorithm: str = "sha256"):
    """An object of hashlib's kind; 'blake3' needs that package."""
    if algorithm == "blake3":
        import blake3

        return blake3.blake3()
    return hashlib.new(algorithm)


def digest(data: bytes, algorithm: str = "sha256") -> str:
    h = hasher(algorithm)
    h.update(data)
    return h.hexdigest()


def usable_hash(norm: Column | str = "norm_hash", raw: Column | str = "raw_hash") -> Column:
    """The normalised hash, else the raw one; empty counts as none."""
    return F.nullif(F.coalesce(norm if isinstance(norm, Column) else F.col(norm), raw if isinstance(raw, Column) else F.col(raw)), F.lit(""))


def normalized_hash(text: Column) -> Column:
    """sha-256 after CRLF became LF; a lone CR stays. Null where the first bytes hold NUL."""
    return F.when(F.contains(F.substring(text, 1, BINARY_PROBE), F.lit("\0")), F.lit(None).cast("string")).otherwise(F.sha2(F.replace(text, F.lit("\r\n"), F.lit("\n")), 256))


def line_ending(text: Column) -> Column:
    """binary, mixed, crlf or lf (also for texts without a line end), judged on the head of the text."""
    head = F.substring(text, 1, ENDING_PROBE)
    crlf = F.contains(head, F.lit("\r\n"))
    lf = F.contains(F.replace(head, F.lit("\r\n"), F.lit("")), F.lit("\n"))
    return F.when(F.contains(F.substring(text, 1, BINARY_PROBE), F.lit("\0")), "binary").when(crlf & lf, "mixed").when(crlf, "crlf").otherwise("lf")


class Fingerprint:
    """Hashes and line ending of content that is read in chunks; no more than one chunk is held.

    raw, fast (XXH64, seed 0), norm (after CRLF became LF; null where the head holds NUL) and ending.
    """

    def __init__(self, known_text: bool = False, algorithm: str = "sha256"):
        self._raw, self._norm = hasher(algorithm), hasher(algorithm)
        self._fast = xxhash.xxh64()
        self._known, self._head, self._cr = known_text, b"", b""

    def update(self, data: bytes) -> None:
        self._raw.update(data)
        self._fast.update(data)
        self._head += data[: max(ENDING_PROBE - len(self._head), 0)]
        data = self._cr + data
        self._cr = data[-1:] if data.endswith(b"\r") else b""  # it may belong to an LF that is yet to come
        self._norm.update(data[: len(data) - len(self._cr)].replace(b"\r\n", b"\n"))

    def result(self) -> tuple[str, str, str | None, str]:
        self._norm.update(self._cr)
        self._cr = b""
        norm, head = self._norm.hexdigest(), self._head
        crlf, lf = b"\r\n" in head, b"\n" in head.replace(b"\r\n", b"")
        ending = "mixed" if crlf and lf else "crlf" if crlf else "lf"
        if not self._known and b"\0" in head[:BINARY_PROBE]:
            norm, ending = None, "binary"
        return self._raw.hexdigest(), self._fast.hexdigest(), norm, ending


def normalized_bytes(data: bytes, known_text: bool = False, algorithm: str = "sha256") -> tuple[str | None, str]:
    """Normalised hash and line ending of bytes."""
    one = Fingerprint(known_text, algorithm)
    one.update(data)
    return one.result()[2:]


@F.pandas_udf(StringType())
def xxh64_seed0(data: pd.Series) -> pd.Series:
    """Hex XXH64 with seed 0; the built-in xxhash64 has seed 42 and serves for internal blocking."""
    return data.map(lambda b: None if b is None else xxhash.xxh64_hexdigest(b if isinstance(b, bytes) else b.encode()))
