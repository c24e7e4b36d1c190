"""Normalised text with a way back to the original positions.

Texts are handled as arrays of code points, a whole Arrow batch at a time: one table lookup folds width and case and drops
everything but letters and digits; markup and page lines are found by pattern beforehand and masked.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np

#: Markup and page lines that may interrupt a passage.
MASKED = re.compile(
    r"</?[a-zA-Z][^<>\n]{0,200}>|&(?:nbsp|lt|gt|amp|quot|apos|ensp|emsp|#\d{1,6}|#x[0-9a-fA-F]{1,5});"
    r"|^[ \t　]*(?:第[ \t　]*[\d０-９]+[ \t　]*[页頁](?:[ \t　]*[共/][ \t　]*[\d０-９]+[ \t　]*[页頁])?|[Pp][Aa][Gg][Ee][ \t]+\d+(?:[ \t]*(?:/|of)[ \t]*\d+)?|[-—–][ \t]*\d+[ \t]*[-—–])[ \t　]*(?:<[^<>\n]{0,20}>)?[ \t]*\r?$",
    re.M,
)


@cache
def _fold() -> np.ndarray:
    """Code point -> folded code point of the basic plane; 0 where it is dropped."""
    out = np.zeros(0x10000, np.uint32)
    for cp in range(0x10000):
        if 0xD800 <= cp < 0xE000:
            continue
        n = unicodedata.normalize("NFKC", chr(cp)).lower()
        n = [x for x in n if x.isalnum()]
        if len(n) == 1 and ord(n[0]) < 0x10000:
            out[cp] = ord(n[0])
        elif n:  # a ligature or compatibility sign that stands for several characters keeps itself
            out[cp] = cp
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(folded code points, position of each in the text)."""
    cps = code_points(text)
    folded = np.where(cps < 0x10000, _fold()[np.minimum(cps, 0xFFFF)], cps)
    if "<" in text or "&" in text or "\n" in text:
        for m in MASKED.finditer(text):
            folded[m.start() : m.end()] = 0
    at = np.flatnonzero(folded)
    return folded[at], at
