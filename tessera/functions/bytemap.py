"""The byte alphabet of GPT-2 style models: every byte as one printable character, and back, in JVM expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _stays(b: int) -> bool:
    return 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF


#: The characters of the bytes 0 to 255: themselves where they print, the others from U+0100 on in byte order.
ALPHABET = "".join(chr(b) if _stays(b) else chr(0x100 + sum(not _stays(x) for x in range(b))) for b in range(256))
FROM_ALPHABET = {c: b for b, c in enumerate(ALPHABET)}
#: The bytes that change, as ISO-8859-1 characters, and what they change to.
CHANGED = "".join(chr(b) for b in range(256) if not _stays(b))
CHANGED_TO = "".join(ALPHABET[b] for b in range(256) if not _stays(b))


def to_mapped(binary: Column) -> Column:
    """Bytes to their characters."""
    return F.translate(F.decode(binary, "ISO-8859-1"), CHANGED, CHANGED_TO)


def from_mapped(text: Column) -> Column:
    """Characters of the alphabet to bytes; null if any is outside it."""
    inside = ~text.rlike("[^" + "".join(f"\\x{{{ord(c):x}}}" for c in ALPHABET) + "]")
    # translate() takes a NUL on its right side as "drop", so byte 0 goes by itself.
    plain = F.replace(F.translate(text, CHANGED_TO[1:], CHANGED[1:]), F.lit(CHANGED_TO[0]), F.lit("\0"))
    return F.when(inside, F.encode(plain, "ISO-8859-1"))


def encode_bytes(data: bytes) -> str:
    return "".join(map(ALPHABET.__getitem__, data))


def decode_text(text: str) -> bytes | None:
    """Bytes of a mapped text; None if a character is outside the alphabet."""
    try:
        return bytes(map(FROM_ALPHABET.__getitem__, text))
    except KeyError:
        return None


def byte_classes() -> str:
    """For each byte its class (L letter, N number, S space, O other) where it stands alone.

    ASCII bytes by their own character, the others by their alphabet character.
    """
    out = []
    for b in range(256):
        kind = unicodedata.category(chr(b) if b < 0x80 else ALPHABET[b])[0]
        space = b == 0x20 or 0x09 <= b <= 0x0D
        out.append("S" if space else kind if kind in "LN" else "O")
    return "".join(out)
