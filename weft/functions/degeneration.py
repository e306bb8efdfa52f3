"""Detectors of degenerate text."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions.text import SANITIZE, bind, strip

# Loops of repeated units, sentence ends, the low-information suffix.
EXACT_LOOP = r"(?s)(?<u>.{16,160}?)\k<u>{2,}"
SPACED_LOOP = r"(?s)(.{20,140}?)(?:\s*\1){2,}"
SHORT_LOOP = r"(?s)(.{12})\1\1"
SENTENCE_ENDS = r"[。！？!?；;\n]+"
LOW_INFO = r"[0-9０-９\s.,，。:;!?！？%％()\[\]{}+\-*/_=…·\"“”'<>]{64,}$"
STOP_WORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "it", "this", "that", "in", "on", "at", "to", "of", "and", "or", "with",
    "has", "have", "having", "looks", "appears", "image", "picture", "shows", "了", "的", "是", "在", "有", "和", "与", "这", "那", "图", "图片", "显示",
)
CLAUSE_END = r"</(?:p|div|h[1-6]|li|ul|ol)>|<br\s*/?>|[.!?。！？；;]+|\n"
SENTENCE_MARKS, TRIM_REACH = "。！？!?\n", 56


def _recurs(text: Column, size: int, reach: int, times: int) -> Column:
    """Some aligned window of `size` characters stands `times` more within the next `reach`.

    Linear in the text; what a loop needs, checked before a pattern with back
    references is tried at each position.
    """
    blocks = -(-reach // size) + 1

    def check(w: Column) -> Column:
        def again(j: Column) -> Column:
            ahead = F.array_join(F.slice(w, j + 2, F.lit(blocks)), "")
            return F.length(ahead) - F.length(F.replace(ahead, F.get(w, j), F.lit(""))) >= size * times

        return F.when(F.size(w) < 2, F.lit(False)).otherwise(F.exists(F.sequence(F.lit(0), F.size(w) - 2), again))

    return bind(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % size), F.lit(0)), check)


def exact_loop(text: Column) -> Column:
    """A unit of 16 to 160 characters three times in a row.

    Two units in a row hold an aligned window of 16, which stands again at most 160 on.
    """
    text = F.coalesce(text, F.lit(""))
    return F.when(_recurs(text, 16, 160, 1), text.rlike(EXACT_LOOP)).otherwise(False)


def duplicate_lines(text: Column, least: int = 12) -> Column:
    """Two stripped lines of at least `least` characters agree."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip), lambda x: F.length(x) >= least)
    return bind(lines, lambda x: F.size(x) != F.size(F.array_distinct(x)))


def repeated(text: Column) -> Column:
    """A unit of 20 to 140 characters three times over, blanks between allowed, or duplicate lines."""
    compact = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")
    # The first unit holds an aligned window of 8, which stands twice more within two units and blanks.
    loop = bind(compact, lambda x: F.when(_recurs(x, 8, 2 * 141, 2), x.rlike(SPACED_LOOP)).otherwise(False))
    return loop | duplicate_lines(text)


def sentence_repeat(text: Column) -> Column:
    """A sentence of at least 6 characters three times, sorted neighbours telling."""
    units = F.array_sort(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), SENTENCE_ENDS), strip), lambda x: F.length(x) >= 6))
    thrice = bind(units, lambda u: F.exists(F.transform(u, lambda x, i: F.coalesce((x == F.get(u, i + 1)) & (x == F.get(u, i + 2)), F.lit(False))), lambda b: b))
    return thrice


def has_loop(text: Column) -> Column:
    return sentence_repeat(text) | F.coalesce(text, F.lit("")).rlike(SHORT_LOOP)


def low_information_tail(text: Column) -> Column:
    """struct<found, keep>: a long suffix of digits and punctuation, and how many characters come before it."""
    whole = F.coalesce(text, F.lit(""))
    tail = F.substring(whole, F.greatest(F.length(whole) - 639, F.lit(1)), F.length(whole))
    noisy = F.regexp_extract(tail, f"({LOW_INFO})", 1)

    def judge(n: Column) -> Column:
        compact = F.regexp_replace(n, r"\s+", "")
        marks = F.length(F.regexp_replace(compact, r"\p{Nd}", ""))
        kinds = F.size(F.array_distinct(F.filter(F.split(compact, ""), lambda c: c != "")))
        found = (F.length(compact) > 0) & (marks / F.greatest(F.length(compact), F.lit(1)) >= 0.30) & (kinds <= 24)
        return F.struct(found.alias("found"), F.when(found, whole_sentences(F.substring(whole, F.lit(1), F.length(whole) - F.length(n)))).alias("keep"))

    def whole_sentences(kept: Column) -> Column:
        """Length of what is kept, cut back to the last sentence mark if that is near."""
        near = F.right(kept, F.lit(TRIM_REACH))
        complete = F.length(F.regexp_extract(near, f"(?s)^(.*[{SENTENCE_MARKS}])", 1))
        return F.length(kept) - F.when(complete > 0, F.length(near) - complete).otherwise(0)

    return bind(noisy, judge)


def prose_loop(text: str) -> int | None:
    """Characters to keep before a prose loop in the last 1800; None without one. Units of symbols are exempt."""
    start = max(0, len(text) - 1800)
    tail = text[start:]
    # Two units in a row hold an aligned window of 16, which stands again at most 180 on.
    if not any(tail.find(tail[i : i + 16], i + 16, i + 196) >= 0 for i in range(0, len(tail) - 16, 16)):
        return None
    for m in re.finditer(r"(.{16,180}?)\1{2,}", tail, re.S):
        letters = re.findall(r"[a-zA-Z一-鿿]", m[1])
        if len(letters) >= 8 and len(set(letters)) >= 3:
            return start + m.start() + len(m[1])
    return None


def _clauses(text: str, reach: int, least: int, most: int) -> list[tuple[frozenset, int]]:
    """(terms, end) of the clauses in the last `reach` characters: `least` to `most` characters, two terms at least, closed."""
    offset, start, out = max(0, len(text) - reach), max(0, len(text) - reach), []
    for mark in re.finditer(CLAUSE_END, text[offset:], re.I):
        at = offset + mark.start()
        if at - start < least:
            # Too short to stand alone: the mark belongs to the clause that goes on.
            continue
        # Of a stretch too long for one clause, its last part counts.
        body = plain_text(text[max(start, at - most) : at])
        terms = [w for w in re.findall(r"[a-zA-Z]{2,}|[\u4e00-\u9fff]{1,4}", body.lower()) if w not in STOP_WORDS]
        start = offset + mark.end()
        if len(terms) >= 2:
            out.append((frozenset(terms), start))
    return out


def plain_text(text: str) -> str:
    """Generated prose without its markup, as sanitize_generated in one Python string."""
    for pattern, by in SANITIZE:
        text = re.sub(pattern, by, text)
    return text.lstrip()


def stutter(text: str) -> int | None:
    """Characters to keep before a stutter: the last eight clauses keep to one term in few different words. None without one.

    What is kept ends with the third clause that holds the term.
    """
    clauses = _clauses(text, 2200, 3, 260)
    recent = [terms for terms, _ in clauses[-8:]]
    seen = Counter(t for terms in recent for t in terms)
    if len(recent) < 8 or len(seen) > 0.58 * sum(seen.values()):
        return None
    # Of terms equally frequent, the first in order of the alphabet.
    term, n = min(seen.items(), key=lambda x: (-x[1], x[0]))
    return [end for terms, end in clauses if term in terms][:3][-1] if n >= 6 else None


def token_cycle(ids: list, least: int = 8, most: int = 96, repeats: int = 3) -> int:
    """The shortest period with which a token list ends `repeats` times over; 0 if there is none.

    Units of symbols are exempt: one holds eight letters at least, three of them different.
    """
    for p in range(least, min(most, len(ids) // repeats) + 1):
        if all(ids[-i] == ids[-i - p] for i in range(1, p * (repeats - 1) + 1)):
            letters = re.findall(r"[a-zA-Z\u4e00-\u9fff]", "".join(map(str, ids[-p:])))
            if len(letters) >= 8 and len(set(letters)) >= 3:
                return p
    return 0


def cycle_period(toks: Column) -> Column:
    """token_cycle of arrays of tokens, whole batches of which cross by Arrow."""

    @F.pandas_udf("long")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: token_cycle([] if x is None else list(x[-96 * 3 :])))

    return run(toks)


def near_duplicate_clauses(text: str, ratio: float = 0.93) -> bool:
    """The last three clauses are nearly equal."""
    from difflib import SequenceMatcher

    parts = [p.strip() for p in re.split(r"[.!?。！？；;\n]+", text) if p.strip()][-3:]
    return len(parts) == 3 and all(SequenceMatcher(None, parts[i], parts[i + 1]).ratio() >= ratio for i in range(2))


def over_texts(column: Column, check, kind: str) -> Column:
    """A Python check over whole texts in Arrow batches, for what no pattern or array expression says."""

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([check(t or "") for t in texts], dtype=object)

    return run(column)
