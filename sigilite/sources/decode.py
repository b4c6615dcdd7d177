"""Bytes to text: byte order marks, signatures of binary files, lossy UTF-8."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Byte order marks, the longer ones first, and the encodings they stand for.
MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
# How binary files begin.
SIGNATURES = (
    b"%PDF", b"%!PS", b"\x89PNG\r\n\x1a\n", b"GIF87a", b"GIF89a", b"\xff\xd8\xff", b"PK\x03\x04", b"PK\x05\x06", b"\x7fELF", b"Rar!\x1a\x07", b"\x1f\x8b", b"BM",
    b"OggS", b"fLaC", b"\x00\x00\x01\x00", b"II*\x00", b"MM\x00*", b"\xfd7zXZ\x00", b"7z\xbc\xaf'\x1c", b"ustar", b"\xca\xfe\xba\xbe", b"RIFF",
)
#: Bytes at the start in which a NUL makes a file binary.
NUL_WINDOW = 8192


def encoding_of(raw: bytes) -> str:
    """utf-8-sig, utf-32, utf-16 by the mark; else binary by signature or NUL; else utf-8."""
    for mark, name in MARKS:
        if raw.startswith(mark):
            return name
    return "binary" if raw.startswith(SIGNATURES) or b"\0" in raw[:NUL_WINDOW] else "utf-8"


def decode_bytes(raw: bytes | None) -> str | None:
    """The text, bad sequences replaced; None for null and binary content."""
    if raw is None or (name := encoding_of(raw)) == "binary":
        return None
    return raw.decode(name, "replace")


def text_encoding(content: Column) -> Column:
    """``encoding_of`` as a Column; null stays null."""
    starts = lambda b: F.startswith(content, F.lit(b))
    out = F.when(content.isNull(), None)
    for mark, name in MARKS:
        out = out.when(starts(mark), name)
    binary = F.lit(False)
    for s in SIGNATURES:
        binary = binary | starts(s)
    nul = F.contains(F.substring(content, 1, NUL_WINDOW), F.lit(b"\0"))
    return out.when(binary | nul, "binary").otherwise("utf-8")


def decode_text(content: Column) -> Column:
    """The text of a binary column, null where it is binary. UTF-8 never leaves the JVM; UTF-16 and UTF-32 go through Arrow."""

    def wide(raws: pd.Series) -> pd.Series:
        return raws.map(lambda r: None if r is None else decode_bytes(bytes(r)))

    name = text_encoding(content)
    utf8 = lambda c: F.make_valid_utf8(c.cast("string"))
    far = F.pandas_udf(wide, "string")(F.when(name.isin("utf-16", "utf-32"), content))
    return F.when(name == "utf-8", utf8(content)).when(name == "utf-8-sig", utf8(F.substring(content, 4, 2_000_000_000))).otherwise(far)
