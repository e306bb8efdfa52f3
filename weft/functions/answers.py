"""Reading answers out of texts: numbers, boxes, letters, thoughts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions.text import bind, strip
from weft.functions.tokens import token_count

THOUGHT_START, THOUGHT_END = "<|thought_start|>", "<|thought_end|>"
# Phrases before a final answer, in the order of their builders.
MARKERS = ("the final answer is", "the answer is", "therefore,", "in conclusion,", "conclusion,", "in summary,", "thus,", "so,")
TAIL_TOKENS = 15
# Numbers, boxes and letters as the readers of answers know them.
NUMBER = r"-?\d+\.?\d*"
BOX_NUMBER = r"\\boxed\s*\{\s*(-?\d+(?:\.\d+)?)\s*\}"
BOX = r"\\boxed\s*\{\s*([^{}]+?)\s*\}"
ANSWER_LETTER = r"(?i)(?:answer|答案|选项)\s*[:：]?\s*([ABCD])"
# A letter with nothing but blanks and punctuation behind it up to the end.
STANDALONE = r"(?i)(?:^|[\s\x{3000}])([ABCDE])(?=[\s.,!?:;)\]\x{3000}]|$)(?=[ \t\r\n.,!?;:)\]}）】。、，；：！？]*$)"


def norm_math(text: Column) -> Column:
    """Boxes opened, left and right marks, dollars and commands gone; letters, digits and Chinese in lower case."""
    out = F.coalesce(text, F.lit(""))
    out = F.regexp_replace(out, r"\\boxed\s*\{([^{}]*)\}", "$1")
    out = F.regexp_replace(out, r"\\(left|right)[()\[\]{}|]", "")
    out = F.replace(out, F.lit("$"), F.lit(""))
    out = F.regexp_replace(out, r"\\[a-zA-Z]+(\s*\{[^{}]*\})?", "")
    return F.lower(F.regexp_replace(out, r"[^0-9A-Za-z\x{4E00}-\x{9FFF}]+", ""))


def contains_expected(solution: Column, candidates: Column) -> Column:
    """Some candidate, normalised and not empty, stands in the normalised solution."""
    whole = norm_math(solution)
    return (whole != "") & F.exists(candidates, lambda c: (norm_math(c) != "") & F.contains(whole, norm_math(c)))


def _last_index(text: Column, mark: str) -> Column:
    """Position from 1 of the last occurrence; 0 if there is none."""
    at = F.locate(mark[::-1], F.reverse(text))
    return F.when(at > 0, F.length(text) - at - len(mark) + 2).otherwise(F.lit(0))


def split_by_marker(raw: Column, markers: tuple = MARKERS, tail_tokens: int = TAIL_TOKENS) -> Column:
    """struct<thought, answer, status> by the last answer phrase in a solution.

    Too many lines or tokens behind it, or nothing in front of its line, leave all as the answer.
    """

    def ends(x: Column) -> Column:
        low = F.lower(x)
        found = F.array(*[F.struct(_last_index(low, m).cast("int").alias("at"), F.lit(-i).alias("rank"), F.lit(len(m)).alias("n")) for i, m in enumerate(markers)])
        return bind(F.array_max(found), lambda best: bind(_last_index(F.substring(x, F.lit(1), best["at"] - 1), "\n"), lambda line: parts(x, best, line)))

    def parts(x: Column, best: Column, line: Column) -> Column:
        both = F.struct(F.substring(x, best["at"] + best["n"], F.length(x)).alias("tail"), strip(F.substring(x, F.lit(1), line)).alias("thought"))
        return bind(both, lambda p: bind(verdict(x, best, p), lambda status: result(x, line, p, status)))

    def verdict(x: Column, best: Column, p: Column) -> Column:
        lines = F.length(p["tail"]) - F.length(F.replace(p["tail"], F.lit("\n"), F.lit("")))
        return (
            F.when(x == "", "empty")
            .when(best["at"] == 0, "no_marker")
            .when(lines >= 2, "marker_invalid_many_newlines")
            .when(token_count(p["tail"]) > tail_tokens, "marker_tail_too_long")
            .when(p["thought"] == "", "marker_but_no_prefix")
            .otherwise("marker_ok")
        )

    def result(x: Column, line: Column, p: Column, status: Column) -> Column:
        ok = status == "marker_ok"
        answer = F.when(ok, strip(F.substring(x, line + 1, F.length(x)))).when(status != "empty", x)
        return F.struct(F.when(ok, p["thought"]).alias("thought"), answer.alias("answer"), status.alias("status"))

    return bind(strip(F.replace(F.coalesce(raw, F.lit("")), F.lit("\r\n"), F.lit("\n"))), ends)


def truth_number(answer: Column) -> Column:
    """The number behind the last ####, else the last number."""
    bare = F.replace(answer, F.lit(","), F.lit(""))
    tail = strip(F.substring_index(bare, "####", -1)).try_cast("double")
    last = F.try_element_at(F.regexp_extract_all(bare, F.lit(NUMBER), F.lit(0)), F.lit(-1)).try_cast("double")
    return F.coalesce(F.when(F.contains(answer, F.lit("####")), tail), last)


def parse_prediction(text: Column) -> Column:
    """struct of what a numeric prediction holds: box, fallback, final answer, thought."""
    raw = strip(F.coalesce(text, F.lit("")))
    start, end = F.locate(THOUGHT_START, raw), F.locate(THOUGHT_END, raw)
    tags = (start > 0) & (end > start)
    inner = strip(F.substring(raw, start + len(THOUGHT_START), end - start - len(THOUGHT_START)))
    has_box = raw.rlike(BOX_NUMBER)
    boxed = F.regexp_extract(raw, BOX_NUMBER, 1).try_cast("double")
    last = F.try_element_at(F.regexp_extract_all(F.replace(raw, F.lit(","), F.lit("")), F.lit(NUMBER), F.lit(0)), F.lit(-1)).try_cast("double")
    return F.struct(
        raw.alias("raw"),
        has_box.alias("has_box"),
        boxed.alias("boxed_value"),
        last.alias("fallback_value"),
        F.coalesce(boxed, last).alias("final_answer"),
        boxed.isNotNull().alias("from_box"),
        (has_box & boxed.isNotNull()).alias("has_box_and_valid"),
        tags.alias("has_cot_tags"),
        F.when(tags, inner).alias("cot_text"),
        F.when(tags, token_count(inner)).otherwise(0).cast("long").alias("cot_tokens"),
    )


def truth_letter(answer: Column) -> Column:
    return F.nullif(F.regexp_extract(F.upper(strip(answer)), "[ABCD]", 0), F.lit(""))


def parse_letter(text: Column) -> Column:
    """struct<boxed, fallback, final_answer>: the first box that holds one letter, else the last letter named as the answer or standing at the end."""
    raw = strip(F.coalesce(text, F.lit("")))
    inside = F.regexp_extract(raw, BOX, 1)
    boxed = F.when(inside.rlike("^[ABCDabcd]$"), F.upper(inside))
    letters = F.concat(F.regexp_extract_all(raw, F.lit(ANSWER_LETTER), F.lit(1)), F.regexp_extract_all(raw, F.lit(STANDALONE), F.lit(1)))
    last = F.upper(F.try_element_at(letters, F.lit(-1)))
    fallback = F.when(last.isin("A", "B", "C", "D"), last)
    return F.struct(boxed.alias("boxed"), fallback.alias("fallback"), F.coalesce(boxed, fallback).alias("final_answer"))


def choice_prompt(question: Column, labels: Column, texts: Column, suffix: str) -> Column:
    """Question, options by label, and an instruction."""
    options = F.array_sort(F.arrays_zip(labels.alias("l"), texts.alias("t")))
    return F.concat(question, F.lit("\n"), F.array_join(F.transform(options, lambda o: F.concat(o["l"], F.lit(". "), o["t"])), "\n"), F.lit("\n" + suffix))


def box_is_complete(text: Column) -> Column:
    """Whether the last box is closed, outside an open thought, and math delimiters are paired.

    Braces are matched by their running depth over the marks behind the box: it is
    closed where the depth first returns to zero. A doubled backslash before a
    delimiter counts as one.
    """
    text = F.coalesce(text, F.lit(""))

    def judge(b: Column) -> Column:
        marks = F.regexp_extract_all(b["body"], F.lit(r"(?<!\\)[{}]"), F.lit(0))
        depth = F.aggregate(
            marks,
            F.struct(F.lit(0).alias("d"), F.lit(False).alias("done")),
            lambda a, m: F.when(a["done"], a).otherwise(F.struct((a["d"] + F.when(m == "{", 1).otherwise(-1)).alias("d"), (a["d"] + F.when(m == "{", 1).otherwise(-1) == 0).alias("done"))),
        )
        plain = F.regexp_replace(b["x"], r"(?<!\\)\\\\([()\[\]])", r"\\$1")
        times = lambda p: F.regexp_count(plain, F.lit(p))
        paired = (times(r"\\\(") <= times(r"\\\)")) & (times(r"\\\[") <= times(r"\\\]")) & (times(r"(?<!\\)\$") % 2 == 0)
        thinking = F.contains(b["x"], F.lit(THOUGHT_START)) & ~F.contains(b["x"], F.lit(THOUGHT_END))
        return F.contains(b["x"], F.lit("\\boxed")) & F.startswith(b["body"], F.lit("{")) & depth["done"] & ~thinking & paired

    body = F.ltrim(F.substring_index(text, "\\boxed", -1))
    return bind(F.struct(text.alias("x"), F.regexp_replace(body, r"^\s+", "").alias("body")), judge)
