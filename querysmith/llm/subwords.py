"""Hashed byte n-grams of whole texts, in numpy: what the classifiers here read."""

from __future__ import annotations

import re

_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")


def has_letter(text: str | None) -> bool:
    """Whether a character of Unicode's letter categories is in the text; digits of other kinds (²) and numerals (Ⅷ) aren't."""
    return bool(text) and any(found[0].isalpha() for found in _LETTER.finditer(text))


def letters(text: str) -> bytes:
    """Lower-case letters, with one space for whatever is between words."""
    return (" " + _OTHER.sub(" ", text.lower()) + " ").encode("utf-8", "surrogatepass")


def counts(raw: bytes, buckets: int, widths: tuple[int, ...] = (2, 3, 4), block: int = 1 << 20):
    """How often each bucket's n-grams occur: exact over the whole text, in blocks that overlap by an n-gram."""
    import numpy as np

    out = np.zeros(buckets, np.int64)
    data = np.frombuffer(raw, np.uint8)
    shift = np.uint32(32 - (buckets - 1).bit_length())
    for at in range(0, max(len(data), 1), block):
        for width in widths:
            part = data[at : at + block + width - 1].astype(np.uint32)
            n = len(part) - width + 1
            if n < 1:
                continue
            code = np.full(n, width, np.uint32)
            for k in range(width):
                code = code * np.uint32(257) + part[k : k + n]
            out += np.bincount((code * np.uint32(2654435769) >> shift).astype(np.int64), minlength=buckets)
    return out
