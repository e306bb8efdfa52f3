"""Line-first quality rules, in native expressions only.

Each line is judged by punctuation, navigation and boilerplate rules; failing
lines go, and a document that loses too much of its text is rejected.

Defined cases: a null, empty or blank text has no words and no lines with
words; it fails the base rules and is not kept. Repeated rows and ids are
judged row by row. Other columns are ignored, whatever their names. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import let, word_array

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Largest share of a document's word characters that failing lines may hold.
MAX_LOST_PERCENT = 50
HAS_WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: A line ends well with one of these, closing quotes and brackets aside.
TERMINAL = r"[.!?:;,…]['\"»”’)\]]*[\x20\x09-\x0D]*$"
#: A paragraph cut off in its last sentence holds this: two sentence ends at least.
SENTENCES = r"(?:[.!?]['\"»”’)\]]*[\x20\x09-\x0D].*){2}"
#: Menus and bread crumbs: several separators in a line.
NAVIGATION = r"(?:[|»›>•·].*){2}"
BOILERPLATE = (
    r"(?i)(?:^|[ \t(])(?:cookie policy|accept cookies|enable javascript|javascript is disabled|all rights reserved|terms of (use|service)"
    r"|privacy policy|sign (in|up) (to|now|here)|log ?in to|subscribe to our|click here|read more|share (on|this)|follow us"
    r"|skip to (main )?content|back to top|add to cart|page not found|lorem ipsum|copyright (©|\(c\)))"
)
#: Shouting and decorated words.
SHOUT_PERCENT, SYMBOLS_PER_100_WORDS = 60, 20

_POSITION_BITS = 63


def _repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur at least twice.

    Window hashes share a long with their position, are sorted as primitives,
    and neighbours that agree are compared word by word.
    """
    n = F.size(words)
    bits = F.length(F.bin(n)).cast("int")
    packed = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.call_function("shiftleft", F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)), bits).bitwiseOR(i.cast("long")),
    )

    def positions(box: Column) -> Column:
        s, k = box["s"], box["k"]
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1
        at = lambda x: x.bitwiseAND(mask).cast("int")

        def same(x: Column, y: Column) -> Column:
            right = lambda v: F.call_function("shiftrightunsigned", v, k)
            equal = right(x) == right(y)
            for step in range(3):
                equal = equal & (F.get(box["w"], at(x) + step) == F.get(box["w"], at(y) + step))
            return F.coalesce(equal, F.lit(False))

        return F.array_sort(F.transform(F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1))), at))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))

    box = F.struct(F.sort_array(packed).alias("s"), bits.alias("k"), words.alias("w"))
    return F.when(n < 4, F.lit(0).cast("long")).otherwise(let(let(box, positions), covered))


def line_fails(line: Column) -> Column:
    """A line with words fails by its ending (unless it holds sentences), as a menu, as boilerplate or as decoration.

    Counts are taken only in lines that hold a run of capitals or a symbol at all.
    """
    shouts = F.when(
        line.rlike(r"\p{Lu}{2}"),
        (F.regexp_count(line, F.lit(r"\p{Lu}")) * 100 > F.regexp_count(line, F.lit(r"\p{L}")) * SHOUT_PERCENT) & (F.length(F.regexp_replace(line, r"[\x20\x09-\x0D]", "")) > 20),
    ).otherwise(False)
    decorated = F.when(line.rlike(SYMBOLS), F.regexp_count(line, F.lit(SYMBOLS)) * 100 > F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")) * SYMBOLS_PER_100_WORDS).otherwise(False)
    return ~(line.rlike(TERMINAL) | line.rlike(SENTENCES)) | line.rlike(NAVIGATION) | line.rlike(BOILERPLATE) | shouts | decorated


def apply_rules(docs: DataFrame, max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """doc_id, the base counts, verdicts and `clean_text` (lines that passed) for each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(F.col("doc_id"), text.alias("t"), word_array(F.col("text")).alias("w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(HAS_WORD)).alias("l"))
    judged = split.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("w")).alias("n_repeat_words"),
        F.size("l").cast("long").alias("n_lines"),
        F.filter("l", lambda x: ~line_fails(x)).alias("good"),
    )
    good_chars = F.length(F.regexp_replace(F.array_join("good", ""), r"[\x20\x09-\x0D]+", "")).cast("long")
    counted = judged.withColumn("lost_chars", F.col("word_chars") - good_chars)
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return counted.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("lost_chars") * 100 <= F.col("word_chars") * max_lost_percent)).alias("kept"),
        "n_lines",
        (F.col("n_lines") - F.size("good")).cast("long").alias("n_failed_lines"),
        "lost_chars",
        F.array_join("good", "\n").alias("clean_text"),
    )


def op1_quality_rules(spark, sf_dir):
    return apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("clean_text")


_BOILER_SQL = BOILERPLATE.replace("'", "''")
_TERMINAL_SQL, _SENTENCES_SQL = TERMINAL.replace("'", "''"), SENTENCES.replace("'", "''")
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS win FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS p FROM w)),
c AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, win) AS n FROM g) WHERE n > 1),
v AS (SELECT r, count(DISTINCT p + o) AS n FROM c, (SELECT unnest([0, 1, 2]) AS o) GROUP BY r),
k AS (SELECT w.r, doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(v.n, 0) AS n_repeat_words, len(l) AS n_lines,
             list_filter(l, lambda x: (regexp_matches(x, '{_TERMINAL_SQL}') OR regexp_matches(x, '{_SENTENCES_SQL}')) AND NOT regexp_matches(x, '{NAVIGATION}')
               AND NOT regexp_matches(x, '{_BOILER_SQL}')
               AND NOT (regexp_matches(x, '\p{{Lu}}{{2}}') AND len(regexp_extract_all(x, '\p{{Lu}}')) * 100 > len(regexp_extract_all(x, '\p{{L}}')) * {SHOUT_PERCENT}
                        AND len(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) > 20)
               AND NOT len(regexp_extract_all(x, '[#*$%&|<>]')) * 100 > len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) * {SYMBOLS_PER_100_WORDS}) AS good
      FROM w LEFT JOIN v ON w.r = v.r),
f AS (SELECT *, word_chars - len(regexp_replace(array_to_string(good, ''), '[\x20\x09-\x0D]+', '', 'g')) AS lost,
             n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS bad FROM k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bad AS base_failed,
       NOT bad AND lost * 100 <= word_chars * {MAX_LOST_PERCENT} AS kept, n_lines, n_lines - len(good) AS n_failed_lines, lost AS lost_chars
FROM f
"""
