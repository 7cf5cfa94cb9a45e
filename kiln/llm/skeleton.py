"""The skeleton of a text: what is left when look, case, marks, breaks and residue of markup are taken away."""

from __future__ import annotations

import re
import unicodedata

from kiln.llm.lookalike import CYRILLIC_LATIN, GREEK_LATIN

_FOLD = str.maketrans({k.lower(): v.lower() for k, v in (CYRILLIC_LATIN | GREEK_LATIN).items()} | {"ё": "e", "ß": "ss"})
_BREAK = re.compile(r"(?<=\w)[-¬­]\s*\n\s*(?=\w)")
_RESIDUE = re.compile(r"<ref[^<>]*>[^<>]*</ref>|\{\{[^{}]*\}\}|\$\^\{?\d+\}?\$|</?[a-zA-Z][^<>\n]*>|\]\([^()\s]+\)|\[\[[^\[\]|]+\||&[a-z]{2,8};|\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?")
_SUP = re.compile(r"<sup>\d+</sup>")


def plain(text: str) -> str:
    """Text without residue of markup and broken words, its words and lines as they are."""
    t = text
    if "<" in t or "{" in t or "[" in t or "&" in t or "\\" in t or "$" in t:
        t = _RESIDUE.sub(" ", _SUP.sub("", t))
    if any(unicodedata.category(c) == "Cf" for c in set(t) if ord(c) > 126):
        t = "".join(c for c in t if ord(c) < 127 or unicodedata.category(c) != "Cf" or c == "­")
    return _BREAK.sub("", t)


def fold(word: str) -> str:
    """Letters and digits of a piece of text, folded over look, case and marks."""
    t = unicodedata.normalize("NFKD", word.lower()) if not word.isascii() else word.lower()
    return "".join(c for c in t.translate(_FOLD) if c.isalnum())
