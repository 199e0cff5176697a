"""Splitting texts into pre-tokens, and numbering them."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import regex

#: Classes of a pattern that the standard library's engine lacks or knows otherwise.
_CLASSES = re.compile(r"\\p\{[LN]\}|\\[sS]|\\.|\[\^?|\]")
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


@lru_cache
def _ranges(name: str) -> str:
    """The characters of a class up to U+FFFF, as the inside of brackets."""
    plane = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x10000))))
    runs = (m[0] for m in regex.finditer(f"{name}+", plane))
    return "".join(f"\\u{ord(r[0]):04x}-\\u{ord(r[-1]):04x}" for r in runs)


def _plain(pattern: str) -> str | None:
    """The pattern without the classes, or None where it has more than they are known for."""
    inside, out, at = False, [], 0
    for m in _CLASSES.finditer(pattern):
        out.append(pattern[at : m.start()])
        at, found = m.end(), m[0]
        if found.startswith("[") and not inside:
            inside = True
        elif found == "]":
            inside = False
        elif found.startswith("\\"):
            name = "\\s" if found == "\\S" else found
            if found not in ("\\p{L}", "\\p{N}", "\\s", "\\S") or found == "\\S" and inside:
                return None
            found = _ranges(name) if inside else f"[{'^' if found == '\\S' else ''}{_ranges(name)}]"
        else:
            return None
        out.append(found)
    out.append(pattern[at:])
    return None if "(?i" in pattern else "".join(out)


@lru_cache
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of the pattern in a text, in order.

    The standard library's engine is some times faster; it gets the classes
    spelt out, and the texts without characters above U+FFFF.
    """
    full, plain = regex.compile(pattern).findall, _plain(pattern)
    if plain is None:
        return full
    quick, astral = re.compile(plain).findall, _ASTRAL.search
    return lambda text: full(text) if astral(text) else quick(text)


class Numbers(dict):
    """Pre-token -> number, in the order of first sight."""

    def __missing__(self, word: str) -> int:
        self[word] = found = len(self)
        return found
