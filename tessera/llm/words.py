"""Ordinary words as background for the training of ``pii``: Chinese ones from the dictionary by which the ICU library of
Spark's distribution finds word boundaries, English ones from a public tokenizer's vocabulary. Nothing of it is kept."""

from __future__ import annotations

import base64
import glob
import os
import re
import zipfile
from collections.abc import Iterator

import numpy as np

DICTIONARY = "com/ibm/icu/impl/data/icudata/brkitr/cjdict.dict"


def trie_entries(u: list[int]) -> Iterator[tuple[str, int]]:
    """(key, value) of a serialized trie of 16-bit units, as ICU documents its form.

    A node begins with a unit that says whether a value ends here (from 0x8000), a value stands here and the node goes on
    (from 0x40, type in the low six bits), the next units must follow as they are (0x30 to 0x3f), or paths part (below).
    """
    todo: list[tuple[int, str, int]] = [(0, "", -1)]  # (place, key so far, type left over from a value or number of paths)

    def value(at: int, lead: int, one: int, two: int, three: int, shift: int, bias: int) -> tuple[int, int]:
        if lead < two:
            return (lead >> shift) - bias, at
        if lead < three:
            return (((lead - two) << 16) >> shift if not shift else ((lead & 0x7FC0) - two) << 10) | u[at], at + 1
        return (u[at] << 16) | u[at + 1], at + 2

    def delta(at: int) -> tuple[int, int]:
        d = u[at]
        if d < 0xFC00:
            return d, at + 1
        if d < 0xFFFF:
            return ((d - 0xFC00) << 16) | u[at + 1], at + 2
        return (u[at + 1] << 16) | u[at + 2], at + 3

    while todo:
        at, key, node = todo.pop()
        if node < 0:
            node, at = u[at], at + 1
        if node >= 0x8000:
            yield key, value(at, node & 0x7FFF, 0x3FFF, 0x4000, 0x7FFF, 0, 0)[0]
        elif node >= 0x40:
            v, at = value(at, node, 0xFF, 0x4040, 0x7FC0, 6, 1)
            yield key, v
            todo.append((at, key, node & 0x3F))
        elif node >= 0x30:
            n = node - 0x30 + 1
            todo.append((at + n, key + "".join(map(chr, u[at : at + n])), -1))
        else:
            if node == 0:
                node, at = u[at], at + 1
            parts = [(at, node + 1)]
            while parts:
                at, n = parts.pop()
                while n > 5:  # halves: a unit, the distance of what is below it, then what isn't
                    d, after = delta(at + 1)
                    parts.append((after + d, n >> 1))
                    at, n = after, n - (n >> 1)
                for k in range(n):
                    ch, at = chr(u[at]), at + 1
                    if k == n - 1:
                        todo.append((at, key + ch, -1))
                        break
                    lead, at = u[at], at + 1
                    v, at = value(at, lead & 0x7FFF, 0x3FFF, 0x4000, 0x7FFF, 0, 0)
                    if lead >= 0x8000:
                        yield key + ch, v
                    else:
                        todo.append((at + v, key + ch, -1))


def chinese_words(most: int = 40_000) -> list[str]:
    """The likeliest words of two to four Han characters."""
    import pyspark

    jar = glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "icu4j-*.jar"))[0]
    with zipfile.ZipFile(jar) as z:
        data = z.read(DICTIONARY)
    head = int.from_bytes(data[:2], "big")
    begin, end = (int.from_bytes(data[head + k : head + k + 4], "big") for k in (0, 4))
    units = np.frombuffer(data[head + begin : head + end], ">u2").tolist()
    found = [(v, w) for w, v in trie_entries(units) if re.fullmatch(r"[一-鿿]{2,4}", w)]
    return [w for _, w in sorted(found)[:most]]


def english_words(ranks: str) -> list[str]:
    """Lower-case words of three letters or more from a rank file of lines ``base64-token rank``."""
    with open(ranks, "rb") as f:
        tokens = (base64.b64decode(line.split()[0]) for line in f if line.strip())
        return [t[1:].decode() for t in tokens if re.fullmatch(rb" [a-z]{3,}", t)]
