"""A portable tokeniser and masks over token arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions.text import bind

#: Runs of letters, single digits, single other characters: additive over concatenated turns.
TOKEN = r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN)).cast("long")


def find_subsequence(values: Column, needle: Column) -> Column:
    """Index from 0 of the first occurrence of one array in another; -1 if there is none."""
    def search(b: Column) -> Column:
        n, m = F.size(b["v"]), F.size(b["s"])
        hits = F.filter(F.sequence(F.lit(0), F.greatest(n - m, F.lit(0))), lambda i: (F.get(b["v"], i) == F.get(b["s"], 0)) & (F.slice(b["v"], i + 1, m) == b["s"]))
        return F.when((m == 0) | (m > n), F.lit(-1)).otherwise(F.coalesce(F.get(hits, 0), F.lit(-1)))

    return bind(F.struct(values.alias("v"), needle.alias("s")), search)


def next_labels(ids: Column, mask: Column, ignore: int = -100) -> Column:
    """Label of each position: the next id where the next position counts, else `ignore`."""
    shifted = lambda b: F.transform(b["v"], lambda x, i: F.when(F.coalesce(F.get(b["m"], i + 1), F.lit(0)) == 1, F.get(b["v"], i + 1)).otherwise(F.lit(ignore)))
    return bind(F.struct(ids.alias("v"), mask.alias("m")), shifted)


def pad_right(ids: Column, length: Column, pad: int = 0) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad).cast("int"), F.greatest(length - F.size(ids), F.lit(0)).cast("int")))


def token_weights(toks: Column) -> Column:
    """Training weight of each token: digits 1.2, single core operators 1.05, letters and others 1."""
    return F.transform(toks, lambda t: F.when(t.rlike(r"\p{Nd}") & ~t.rlike(r"\p{L}"), 1.2).when(t.rlike(r"^[+\-*/=^%＋－×÷＝％]$"), 1.05).otherwise(1.0))


def fill_in_middle(ids: Column, start: Column, length: Column, mark: int) -> Column:
    """The span moves behind a mark at the end, another mark takes its place."""
    m = F.array(F.lit(mark))
    return F.concat(F.slice(ids, 1, start), m, F.slice(ids, start + length + 1, F.size(ids)), m, F.slice(ids, start + 1, length))
