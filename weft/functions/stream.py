"""Packed token streams: a rendered chat as tokens in which control tags stay whole.

A stream is an array of strings; line breaks are tokens, other white space is not.
Everything is found by the positions of end marks, so the work is linear.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions.text import bind, strip

START, END, IMAGE, EOS = "<|im_start|>", "<|im_end|>", "<img>", "<|endoftext|>"
#: Control tags, image marks and line breaks, then the portable tokens.
TOKEN = r"<\|[^<>\r\n|]+\|>|<img>|\n|\p{L}+|\p{N}|[^\s\p{L}\p{N}]"
# Image marks of the sources, which no packed row may hold.
SOURCE_MARK = r"(?i)</?image>|<image[_-]?\d*>|\[image(?:[_ -]?\d+)?\]|<\/?img[_-]?\d+>|<img[_-]?\d+>|IMAGE_TOKEN|DEFAULT_IMAGE_TOKEN"
CONTROL = r"<\|[^<>\r\n]+\|>"
VIEWS = 5
_SPAN = "array<struct<role:string,start:int,content:int,end:int,closed:boolean,stray:boolean>>"


def stream(text: Column, eos: bool = False) -> Column:
    """Tokens of a rendered chat, closed by EOS on demand."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.concat(found, F.array(F.lit(EOS))) if eos else found


def role_spans(toks: Column) -> Column:
    """array<struct<role, start, content, end, closed, stray>>: one entry for each stretch up to an end mark.

    `start` is the stretch's first start mark (-1 without one, role null), `content` the position behind the role's line,
    `end` the end mark or the stream's length; `stray` tells of tokens other than line breaks in front of the start mark.
    """

    def parse(x: Column) -> Column:
        ends = F.filter(F.transform(x, lambda t, i: F.when(t == END, i)), lambda i: i.isNotNull())
        return bind(ends, lambda e: F.filter(F.transform(F.concat(e, F.array(F.size(x))), lambda to, j: one(x, F.when(j == 0, F.lit(0)).otherwise(F.get(e, j - 1) + 1), to, j < F.size(e))), lambda s: s["closed"] | s["stray"] | (s["start"] >= 0)))

    def one(x: Column, low: Column, high: Column, closed: Column) -> Column:
        return bind(F.struct(low.alias("low"), high.alias("high"), F.slice(x, low + 1, high - low).alias("t")), lambda b: located(b, closed))

    def located(b: Column, closed: Column) -> Column:
        at = F.array_position(b["t"], START).cast("int")
        gap = F.exists(F.when(at > 0, F.slice(b["t"], 1, at - 1)).otherwise(b["t"]), lambda t: t != "\n")
        head = F.when(at > 0, F.slice(b["t"], at + 1, F.size(b["t"]))).otherwise(F.array().cast("array<string>"))
        return bind(F.struct(at.alias("at"), (gap | ((at == 0) & closed)).alias("stray"), head.alias("h")), lambda s: named(b, s, closed))

    def named(b: Column, s: Column, closed: Column) -> Column:
        line = F.array_position(s["h"], "\n").cast("int")
        role = strip(F.array_join(F.when(line > 0, F.slice(s["h"], 1, line - 1)).otherwise(s["h"]), ""))
        start = F.when(s["at"] > 0, b["low"] + s["at"] - 1).otherwise(F.lit(-1))
        content = F.when((s["at"] > 0) & (line > 0), b["low"] + s["at"] + line).otherwise(b["high"])
        return F.struct(F.when(s["at"] > 0, role).alias("role"), start.alias("start"), content.alias("content"), b["high"].alias("end"), closed.alias("closed"), s["stray"].alias("stray"))

    return bind(toks, parse).cast(_SPAN)


def target_mask(toks: Column) -> Column:
    """1 for the content and end mark of each closed assistant span; what follows an unclosed one is 0."""
    last = lambda b: F.when(F.size(b["s"]) == 0, F.lit(0)).otherwise(F.element_at(b["s"], -1)["end"] + F.element_at(b["s"], -1)["closed"].cast("int"))

    def ones(b: Column) -> Column:
        parts = F.transform(
            b["s"],
            lambda s, i: bind(
                F.struct((s["end"] + s["closed"].cast("int")).alias("to"), F.when(i == 0, F.lit(0)).otherwise(F.get(b["s"], i - 1)["end"] + 1).alias("from"), ((s["role"] == "assistant") & s["closed"]).alias("counts")),
                lambda r: F.concat(F.array_repeat(F.lit(0), F.when(F.coalesce(r["counts"], F.lit(False)), s["content"] - r["from"]).otherwise(r["to"] - r["from"])), F.array_repeat(F.lit(1), F.when(F.coalesce(r["counts"], F.lit(False)), r["to"] - s["content"]).otherwise(F.lit(0)))),
            ),
        )
        return F.concat(F.flatten(parts), F.array_repeat(F.lit(0), F.size(b["t"]) - last(b)))

    return bind(toks, lambda t: bind(F.struct(t.alias("t"), role_spans(t).alias("s")), ones))


def strict_reason(toks: Column, most: int, least_answer: int) -> Column:
    """Why a stream is no training row: too long or empty, an assistant without its end mark, too few answer tokens; null if it is one."""

    def reason(b: Column) -> Column:
        answers = F.filter(b["s"], lambda s: s["role"] == "assistant")
        n = F.aggregate(answers, F.lit(0), lambda a, s: a + s["end"] - s["content"])
        return (
            F.when((F.size(b["t"]) == 0) | (F.size(b["t"]) > most), "too_long_or_empty")
            .when(F.exists(answers, lambda s: ~s["closed"]), "missing_assistant_end")
            .when((F.size(answers) == 0) | (n < least_answer), "assistant_too_short")
        )

    return bind(toks, lambda t: bind(F.struct(t.alias("t"), role_spans(t).alias("s")), reason))


def audit(text: Column, toks: Column, mask: Column, images: Column, missing: Column, meta: Column) -> Column:
    """All errors of a packed row, by kind, in fixed order.

    `images` names its views, `missing` counts those without a file, `meta` is JSON with an array `views`.
    """
    box = F.struct(F.coalesce(text, F.lit("")).alias("x"), toks.alias("t"), F.coalesce(mask, F.array().cast("array<int>")).alias("m"), role_spans(toks).alias("all"))

    def with_spans(b: Column) -> Column:
        spans = F.filter(b["all"], lambda s: s["closed"] & (s["start"] >= 0))
        dialogue = F.transform(F.filter(spans, lambda s: s["role"] != "system"), lambda s: s["role"])
        answers = F.filter(spans, lambda s: s["role"] == "assistant")
        return bind(F.struct(b["x"].alias("x"), b["t"].alias("t"), b["m"].alias("m"), b["all"].alias("all"), spans.alias("s"), dialogue.alias("d"), answers.alias("a"), target_mask(b["t"]).alias("good")), checks)

    def checks(b: Column) -> Column:
        spoken = F.array_join(F.transform(b["a"], lambda s: F.array_join(F.slice(b["t"], s["content"] + 1, s["end"] - s["content"]), " ")), "\n")
        header = F.exists(b["a"], lambda s: F.exists(F.slice(b["m"], s["start"] + 2, F.greatest(s["content"] - s["start"] - 1, F.lit(0))), lambda v: v != 0))
        outside = F.exists(F.arrays_zip(b["m"].alias("m"), b["good"].alias("g")), lambda z: (z["m"] != 0) & (F.coalesce(z["g"], F.lit(0)) == 0))
        views = F.from_json(meta, "struct<views:array<string>>", {"mode": "PERMISSIVE"})
        valid = F.coalesce(F.try_parse_json(meta).isNotNull(), F.lit(False))
        found = [
            (F.exists(b["all"], lambda s: s["stray"]), "text_outside_chatml"),
            (F.exists(b["all"], lambda s: ~s["closed"] & (s["start"] >= 0)), "missing_end_mark"),
            (F.size(b["t"]) != F.size(b["m"]), "mask_length"),
            (F.regexp_count(b["x"], F.lit(IMAGE)) != 1, "image_mark_count"),
            (F.coalesce(F.get(b["s"], 0)["role"], F.lit("")) != "user", "first_role"),
            (F.exists(b["s"], lambda s: ~s["role"].isin("user", "assistant", "system")), "unknown_role"),
            (F.exists(F.arrays_zip(b["d"].alias("p"), F.slice(b["d"], 2, F.greatest(F.size(b["d"]), F.lit(1))).alias("q")), lambda z: z["p"] == z["q"]), "non_alternating"),
            (F.exists(F.regexp_extract_all(b["x"], F.lit(CONTROL), F.lit(0)), lambda t: ~t.isin(START, END)), "control_tag"),
            (b["x"].rlike(SOURCE_MARK), "source_image_mark"),
            (F.contains(b["x"], F.lit("�")), "replacement_character"),
            (F.exists(b["a"], lambda s: F.coalesce(F.get(b["t"], s["start"] + 2), F.lit("")) != "\n"), "assistant_header"),
            (header, "mask_on_header"),
            (outside, "mask_outside_assistant"),
            (~F.exists(b["m"], lambda v: v != 0), "empty_mask"),
            (F.coalesce(F.size(images), F.lit(-1)) != VIEWS, "image_count"),
            (F.coalesce(missing, F.lit(0)) > 0, "missing_images"),
            (valid & (F.coalesce(F.size(views["views"]), F.lit(0)) != VIEWS), "view_count"),
            (~valid, "invalid_meta"),
            (F.contains(spoken, F.lit(IMAGE)) | spoken.rlike(SOURCE_MARK), "image_mark_in_answer"),
        ]
        return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), name) for test, name in found]))

    return bind(box, with_spans)
