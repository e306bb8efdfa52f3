"""Scripts and languages by character classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scripts other than Chinese and English, and accented Latin letters but for micro and angstrom signs.
BANNED = (
    r"\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{FF65}-\x{FF9F}\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{AC00}-\x{D7AF}"
    r"\x{600}-\x{6FF}\x{750}-\x{77F}\x{8A0}-\x{8FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}\x{900}-\x{97F}\x{400}-\x{4FF}"
)
ACCENTED = r"\x{AA}\x{BA}\x{C0}-\x{C4}\x{C6}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}"
FOREIGN = f"[{BANNED}{ACCENTED}]"

# What the stricter reader admits besides; all else counts as foreign.
ALLOWED = (
    r"\x09\x0A\x0D\x20-\x7E\x{4E00}-\x{9FFF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}\x{370}-\x{3FF}\x{2000}-\x{206F}\x{2070}-\x{209F}\x{20A0}-\x{20CF}"
    r"\x{2100}-\x{214F}\x{2150}-\x{218F}\x{2190}-\x{22FF}\x{2460}-\x{24FF}\x{25A0}-\x{25FF}\x{FE00}-\x{FE0F}\x{B0}\x{B1}\x{D7}\x{F7}\x{B7}\x{B5}\x{C5}\x{BD}\x{BC}\x{BE}\x{203B}"
)
NOT_ALLOWED = f"[^{ALLOWED}]"

# A letter beyond ASCII that is neither Chinese nor Greek nor a mathematical alphanumeric.
FOREIGN_LETTER = r"[\p{L}&&[^A-Za-z\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{370}-\x{3FF}\x{2100}-\x{214F}\x{1D400}-\x{1D7FF}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}\x{B5}]]"


def has_foreign_script(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(FOREIGN)


def outside_allowed(text: Column) -> Column:
    """The allow-list variant: an unknown symbol is foreign too."""
    text = F.coalesce(text, F.lit(""))
    return text.rlike(NOT_ALLOWED) | text.rlike(f"[{BANNED}]")


def has_foreign_letter(text: Column) -> Column:
    """The category variant: punctuation, numbers and symbols of any script pass."""
    return F.coalesce(text, F.lit("")).rlike(FOREIGN_LETTER)


def cjk_ratio(text: Column) -> Column:
    """Chinese characters among Chinese characters and ASCII letters."""
    text = F.coalesce(text, F.lit(""))
    return F.regexp_count(text, F.lit(r"[\x{3400}-\x{9FFF}]")) / F.greatest(F.regexp_count(text, F.lit(r"[A-Za-z\x{3400}-\x{9FFF}]")), F.lit(1))


def english_score_ok(language: Column, score: Column, floor: float = 0.5) -> Column:
    return F.lower(language).startswith("en") & (score >= floor)


def lenient_int(value: Column) -> Column:
    """Whole number of a loose string: thousands separators go, fractions are cut, anything else is null."""
    return F.replace(F.trim(value), F.lit(","), F.lit("")).try_cast("double").try_cast("long")
