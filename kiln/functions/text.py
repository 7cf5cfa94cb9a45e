"""Text predicates and measures as Columns. Patterns use \\p{L} and \\p{N}: Java's \\w is ASCII by default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that leave a line open, and leads of captions.
FUNCTION_WORDS = ["and", "or", "of", "the", "in", "with", "by", "to", "и", "или", "в", "на", "с", "по", "der", "die", "das", "und", "oder", "mit"]
CAPTION = r"^(Fig\.|Figure|Table|Рис\.|Таблица|Bild|Tabelle) ?[0-9]+"
PAGE_NUMBER = r"^[-—·]? ?[0-9]{1,3} ?[-—·]?$"
WORD = r"\p{L}+(?:[-'][\p{L}]+)*"
NUMBER = r"[0-9]+(?:[.,][0-9]+)?"
#: Words, numbers, other signs: the default token counter.
TOKEN = r"\p{L}+|[0-9]+|[^\p{L}0-9\s]"
CITATION = r" ?\[[0-9]+(?:, ?[0-9]+)*\]"


def block_kind(text: Column) -> Column:
    """heading (# but no numbered caption), formula ($$), table (<table), image (![), else paragraph; null stays null."""
    return (
        F.when(text.isNull(), None)
        .when(text.rlike(r"^#{1,6} ") & ~F.regexp_replace(text, r"^#{1,6} ", "").rlike(CAPTION), "heading")
        .when(text.startswith("$$"), "formula")
        .when(text.startswith("<table"), "table")
        .when(text.startswith("!["), "image")
        .otherwise("paragraph")
    )


def ends_sentence(text: Column) -> Column:
    """Sentence mark, closed formula or table at the end."""
    return text.rlike(r"[.!?:;…][\"»”)]?\s*$|\$\$\s*$|</table>\s*$")


def ends_strictly(text: Column) -> Column:
    """As ends_sentence, but not on an abbreviation or an initial."""
    return ends_sentence(text) & ~text.rlike(r"(^| )(Fig|al|No|vs|cf|рис|табл|др|Abb|Bd|\p{Lu})\.\s*$")


def starts_mid(text: Column) -> Column:
    return text.rlike(r"^[\p{Ll}0-9$]")


def continues(left: Column, right: Column) -> Column:
    """The right text carries the left one on."""
    tail = left.rlike(r"(^| )(" + "|".join(FUNCTION_WORDS) + r")\s*$")
    return ~ends_strictly(left) & (starts_mid(right) | left.rlike(r"-\s*$") | tail)


def tokens(text: Column, pattern: str = TOKEN) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def count_tokens(text: Column) -> Column:
    return F.size(tokens(F.coalesce(text, F.lit(""))))


def language(text: Column, share: float = 0.3) -> Column:
    """ru where Cyrillic letters are more than share of the letters; no letters: en."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.when(F.length(F.regexp_replace(text, r"[^\p{IsCyrillic}]", "")) > share * letters, "ru").otherwise("en")


def squeeze(text: Column) -> Column:
    """Blanks collapsed, none before punctuation, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r" ([,.;:!?])", "$1"))


def clip_bytes(text: Column, n: int) -> Column:
    """The longest head of text of at most n bytes in UTF-8, no character cut: continuation bytes at the end go with their character."""
    head = F.hex(F.substring(F.encode(text, "UTF-8"), 1, n + 1))
    # Of n + 1 bytes drop the last, or all that belong to the character it is part of.
    cut = F.regexp_replace(head, r"^((?:..)*?)(?:[0-7].|[C-F].(?:[89AB].)*)$", "$1")
    return F.when(F.octet_length(text) <= n, text).otherwise(F.decode(F.unhex(cut), "UTF-8"))
