"""python -m tessera.llm.han_build: write the table of readings and simplified forms of Han characters.

Both come from the Unicode data in the ICU library that Spark's own distribution brings along (transliterators
``Han-Latin`` and ``Traditional-Simplified``): one line a syllable with its characters, then one line of pairs.
"""

from __future__ import annotations

import re
from collections import defaultdict
from pathlib import Path

from tessera.session import build_session

OUT = Path(__file__).with_name("models") / "han.txt"
FIRST, LAST = 0x4E00, 0x9FFF


def main() -> None:
    jvm = build_session("han", 1)._jvm
    get = jvm.com.ibm.icu.text.Transliterator.getInstance
    chars = [chr(c) for c in range(FIRST, LAST + 1)]
    sounds = get("Han-Latin; NFD; [:Nonspacing Mark:] Remove; NFC").transliterate("\n".join(chars)).split("\n")
    simple = get("Traditional-Simplified").transliterate("\n".join(chars)).split("\n")
    by: dict[str, list[str]] = defaultdict(list)
    for ch, s in zip(chars, sounds, strict=True):
        s = re.sub(r"[^a-z]", "", s.lower())
        if s:
            by[s].append(ch)
    pairs = [a + b for a, b in zip(chars, simple, strict=True) if a != b and len(b) == 1]
    lines = [f"{s} {''.join(cs)}" for s, cs in sorted(by.items())]
    OUT.write_text("\n".join([*lines, "= " + "".join(pairs)]) + "\n", encoding="utf-8")
    print(len(by), sum(map(len, by.values())), len(pairs))


if __name__ == "__main__":
    main()
