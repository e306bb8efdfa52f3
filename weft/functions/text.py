"""Cleaning and normalising text, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Zero-width characters and emoji ranges that cleaning removes.
CONTROL = r"[\x{200B}-\x{200F}\x{FEFF}]"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}]"
#: White space in the Unicode sense.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

# Code points with the Unicode properties Emoji_Presentation or Extended_Pictographic, in ranges.
PICTOGRAPH = (
    r"[\x{A9}\x{AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{2199}\x{21A9}\x{21AA}\x{231A}\x{231B}\x{2328}\x{2388}\x{23CF}\x{23E9}-\x{23F3}\x{23F8}-\x{23FA}\x{24C2}\x{25AA}\x{25AB}\x{25B6}\x{25C0}\x{25FB}-\x{25FE}"
    r"\x{2600}-\x{2605}\x{2607}-\x{2612}\x{2614}-\x{2685}\x{2690}-\x{2705}\x{2708}-\x{2712}\x{2714}\x{2716}\x{271D}\x{2721}\x{2728}\x{2733}\x{2734}\x{2744}\x{2747}\x{274C}\x{274E}\x{2753}-\x{2755}\x{2757}\x{2763}-\x{2767}"
    r"\x{2795}-\x{2797}\x{27A1}\x{27B0}\x{27BF}\x{2934}\x{2935}\x{2B05}-\x{2B07}\x{2B1B}\x{2B1C}\x{2B50}\x{2B55}\x{3030}\x{303D}\x{3297}\x{3299}\x{1F000}-\x{1F0FF}\x{1F10D}-\x{1F10F}\x{1F12F}\x{1F16C}-\x{1F171}\x{1F17E}\x{1F17F}"
    r"\x{1F18E}\x{1F191}-\x{1F19A}\x{1F1AD}-\x{1F1FF}\x{1F201}-\x{1F20F}\x{1F21A}\x{1F22F}\x{1F232}-\x{1F23A}\x{1F23C}-\x{1F23F}\x{1F249}-\x{1F53D}\x{1F546}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F774}-\x{1F77F}\x{1F7D5}-\x{1F7FF}"
    r"\x{1F80C}-\x{1F80F}\x{1F848}-\x{1F84F}\x{1F85A}-\x{1F85F}\x{1F888}-\x{1F88F}\x{1F8AE}-\x{1F8FF}\x{1F90C}-\x{1F93A}\x{1F93C}-\x{1F945}\x{1F947}-\x{1FAFF}\x{1FC00}-\x{1FFFD}]"
)

# Tags that vision-language cleaning removes, in this order.
CHAT_TAG = r"(?i)<\|(?:im|thought)_(?:start|end)\|>"
IMAGE_TAG = r"(?i)(?:<\s*/?\s*(?:image(?:_\d+)?|img|IMG_CONTEXT|图像|圖像|图片|圖片|图|圖|影像|画像|图象)\s*>|\[\s*(?:image|img)\s*\])"
HTML_TAG = r"(?i)</?(?:b|br|p|div|span|strong|em|h[1-6])(?:\s[^<>]*)?/?>"
PSEUDO_TAG = r"</?[A-Za-z_\x{4E00}-\x{9FFF}][^<>\n]{0,31}>"

# Markup that generated prose loses.
SANITIZE = (
    (r"(?i)<\s*img\s*/?\s*>", ""),
    (r"(?i)<\s*(?:br\s*/?|/(?:p|div|h[1-6]|li|ul|ol))\s*>", "\n"),
    (r"(?i)<\s*/?\s*(?:p|div|h[1-6]|span|section|article|header|footer|main|strong|b|em|i|ul|ol|li)(?:\s+[^<>]*?)?\s*>", ""),
    (r"[ \t]+\n", "\n"),
    (r"\n{3,}", "\n\n"),
)


def bind(value: Column, body) -> Column:
    """body(value) with the value computed once, for expressions that use it often."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(text: Column) -> Column:
    """Without white space at the ends (all Unicode spaces, unlike trim)."""
    return F.btrim(text, F.lit(SPACES))


def clean_text(text: Column) -> Column:
    """Without zero-width characters, emoji and NUL, stripped; null becomes empty."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), CONTROL, ""), EMOJI, "")
    return strip(F.replace(bare, F.lit("\0"), F.lit("")))


def normalize_light(text: Column) -> Column:
    """The form whose md5 is the duplicate signature: blank runs become one space, none beside line breaks."""
    spaced = F.regexp_replace(clean_text(text), r"[ \t\r\f\x0B]+", " ")
    return strip(F.regexp_replace(spaced, r"[ \t]*\n[ \t]*", "\n"))


def signature(text: Column) -> Column:
    return F.md5(normalize_light(text).cast("binary"))


def clean_chat_text(text: Column) -> Column:
    """Without zero-width characters and NUL; three line breaks or more become two."""
    bare = F.replace(F.regexp_replace(F.coalesce(text, F.lit("")), CONTROL, ""), F.lit("\0"), F.lit(""))
    return F.regexp_replace(strip(bare), r"\n{3,}", "\n\n")


def normalize_breaks(text: Column) -> Column:
    """LF line breaks, blank runs as one space, stripped."""
    lf = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return strip(F.regexp_replace(lf, r"[ \t]+", " "))


def canonical_prompt(text: Column) -> Column:
    """Lower case with single spaces, for matching prompts."""
    return F.lower(F.regexp_replace(strip(F.coalesce(text, F.lit(""))), r"[\s\p{Z}]+", " "))


def strip_markup(text: Column) -> Column:
    """Without chat tags, image marks, HTML and pseudo tags; blanks collapse in each line, empty lines go."""
    out = F.coalesce(text, F.lit(""))
    for pattern in (CHAT_TAG, IMAGE_TAG, HTML_TAG, PSEUDO_TAG):
        out = F.regexp_replace(out, pattern, " ")
    lines = F.split(F.replace(out, F.lit("\0"), F.lit(" ")), r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]")
    tidy = F.transform(lines, lambda x: strip(F.regexp_replace(x, r"[\s\p{Z}\x1F]+", " ")))
    return F.array_join(F.filter(tidy, lambda x: x != ""), "\n")


def safe_history(text: Column) -> Column:
    """A turn of the history without chat tags and image marks."""
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), rf"{CHAT_TAG}|<img>", ""))


def without_pictographs(text: Column) -> Column:
    """clean_text with emoji by their Unicode properties: presentation as emoji, or a pictograph in text."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), CONTROL, ""), PICTOGRAPH, "")
    return strip(F.replace(bare, F.lit("\0"), F.lit("")))


def template_join(first: str, inner: Column, second: str, outer: Column) -> Column:
    """Two labelled sections: `first` above the input, `second` above the output."""
    return F.concat(F.lit(f"{first}:\n"), inner, F.lit(f"\n\n{second}:\n"), outer)


def thought_and_answer(text: Column, parts: tuple[str, ...], conclusion: str) -> Column:
    """struct<thought, answer>: the filled sections joined by blank lines (null if none), and the conclusion or else the whole text."""
    sections = F.filter(F.array(*[tagged_section(text, p) for p in parts]), lambda x: x != "")
    return F.struct(F.when(F.size(sections) > 0, F.array_join(sections, "\n\n")).alias("thought"), F.coalesce(F.nullif(tagged_section(text, conclusion), F.lit("")), strip(text)).alias("answer"))


def normalize_image_token(text: Column) -> Column:
    """Every image mark as <img>."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), IMAGE_TAG, "<img>")


def sanitize_generated(text: Column, mode: Column) -> Column:
    """Generated prose without markup, in the modes chat and vision; other modes keep the text."""
    out = text
    for pattern, by in SANITIZE:
        out = F.regexp_replace(out, pattern, by)
    return F.when(mode.isin("chat", "vision"), F.regexp_replace(out, r"^[\s\p{Z}]+", "")).otherwise(text)


def first_filled(*columns: Column) -> Column:
    """The first of the columns that is neither null nor blank."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in columns])


def url_source(prefix: str, url: Column) -> Column:
    """`prefix|host`, with port and user as in the address."""
    return F.concat(F.lit(prefix + "|"), F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def tagged_section(text: Column, tag: str) -> Column:
    """What stands between <tag> and </tag>, stripped; empty if there is none."""
    return strip(F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?s)<{tag}>(.*?)</{tag}>", 1))


def chat_blocks(text: Column) -> Column:
    """Array of the cleaned contents of all chat blocks, empty ones left out."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?s)<\|im_start\|>(.*?)<\|im_end\|>"), F.lit(1))
    return F.filter(F.transform(found, clean_text), lambda x: x != "")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def safe_name(path: Column) -> Column:
    """A path as a file name: anything but letters, digits, dot, dash and underscore becomes an underscore."""
    return F.regexp_replace(path, r"[^A-Za-z0-9._-]+", "_")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def decode_data_url(value: Column) -> Column:
    """Bytes of a base64 value with or without a data: prefix; null if it is malformed."""
    return F.try_to_binary(F.regexp_replace(value, r"^data:[^,]*,", ""), F.lit("base64"))
