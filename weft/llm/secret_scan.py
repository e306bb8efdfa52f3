"""Secret scan, in native expressions only.

Fixed patterns give the base spans. On top, long tokens with letters and digits
that touch no base span go through a battery of three randomness tests over the
inferred encoding: chi-squared uniformity over its alphabet, runs of character
classes, lag-one serial correlation. Each is standardised under randomness; one
statistic adds up what speaks for an ordinary token (letters repeat, classes
come in long runs, neighbours depend on each other). Its p-value is the chance
that an ordinary token of that encoding and length looks so random (NULLS). The
p-values enter a Benjamini-Hochberg procedure within each stratum of encoding
and length; they are counted in a histogram of fixed size, so the control covers
the whole corpus in one small aggregate.

Defined cases: null and empty texts have no spans (sha256 of the empty string).
Spans count code points, end exclusive. Repeated rows are scanned row by row.
Other columns are kept, but for one named `spans`, which the result replaces. An
empty table gives an empty result. Tokens that fit no alphabet (both + or / and
- or _) are not tested.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import let, unused

#: The base kinds in their listed order: pattern, group that the length holds for, least length.
KINDS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
#: Tokens that the battery tests: at least MIN_TOKEN characters, a letter and a digit among them.
MIN_TOKEN = 20
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_TOKEN
#: Alphabets, the narrowest that fits wins.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "heX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower": "abcdefghijklmnopqrstuvwxyz0123456789",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "alnum": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: Maximal runs of one character class.
CLASS_RUN = "[a-z]+|[A-Z]+|[0-9]+|[+/_-]+"
#: The statistic of ordinary tokens of n characters is near normal below its middle: mean a + b n, deviation c + d n.
#: Fitted to the lower quantiles (0.05 to 0.002) of identifiers glued from words of four languages (snake, kebab, camel,
#: path, constants, bare), with counters, dates and versions; for hex, of padded counters, time stamps and filled words.
NULLS = {
    "hex": (-1.1, 0.454, -0.84, 0.078),
    "base32": (-2.1, 0.263, 0.2, 0.034),
    "lower": (-1.5, 0.259, -0.21, 0.048),
    "alnum": (0.9, 0.194, 1.0, 0.021),
    "base64": (7.0, 0.109, 2.45, 0.001),
}
NULL_OF = {"heX": "hex", "upper": "lower", "base64url": "base64"}
#: Share of the serial test in the statistic.
SERIAL_SHARE = 0.5
#: A token that a test alone calls this far from random (in deviations, two-sided about 1e-4) is not random, such as a listed alphabet.
VETO = 4.0
FALSE_DISCOVERY = 0.05
#: Bins of -log10 p: this many for each power of ten, up to the twentieth.
BINS_PER_POWER, MAX_POWER = 20, 20
LONGEST_BUCKET = 10
BLOCK, CUT = 128, 1024


def serial_order(alphabet: str) -> str:
    """Consonants, then digits and signs, then vowels: languages alternate between the ends."""
    vowel = [c for c in alphabet if c in "aeiouAEIOU"]
    consonant = [c for c in alphabet if c.isalpha() and c not in vowel]
    return "".join([*consonant, *(c for c in alphabet if not c.isalpha()), *vowel])


def class_constants(alphabet: str) -> tuple[float, float]:
    """For random tokens: the chance that two neighbours differ in class, and the covariance of two such events in a row."""
    kind = lambda c: 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3
    share = [v / len(alphabet) for v in Counter(map(kind, alphabet)).values()]
    q = 1 - sum(p * p for p in share)
    return q, sum(p * (1 - p) ** 2 for p in share) - q * q


def _prefix(values: Column, join, none) -> Column:
    """Inclusive running `join` of an array of longs from `none` on, in blocks so that long arrays stay near linear."""
    start = F.array(F.lit(none).cast("long"))

    def local(block: Column) -> Column:
        runs = F.aggregate(block, start, lambda a, x: F.concat(a, F.array(join(F.element_at(a, -1), x))))
        return F.slice(runs, 2, F.greatest(F.size(block), F.lit(1)))

    def shift(blocks: Column) -> Column:
        offsets = local(F.transform(blocks, lambda b: F.element_at(b, -1)))
        return let(offsets, lambda o: F.flatten(F.transform(blocks, lambda b, i: F.transform(b, lambda x: F.when(i == 0, x).otherwise(join(F.get(o, i - 1), x))))))

    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda b: local(F.slice(x, b * BLOCK + 1, F.lit(BLOCK))))
    return F.when(F.size(values) == 0, F.array().cast("array<bigint>")).otherwise(let(values, lambda x: let(cut(x), shift)))


def _running(lengths: Column) -> Column:
    return _prefix(lengths, lambda a, x: a + x, 0)


def _running_max(values: Column) -> Column:
    return _prefix(values, lambda a, x: F.greatest(a, x), 0)


def find_spans(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as array<struct<start,end,value,hit>> in code points.

    \\G chains the matches, so that what lies between them is captured too and
    gives the positions; `value` is the pattern's `group`, `hit` the whole match.
    """
    chained = F.lit(rf"(?s)\G(.*?)({pattern})")
    part = lambda i: F.regexp_extract_all(text, chained, F.lit(i))
    found = let(
        F.struct(part(1).alias("g"), part(2).alias("m"), part(2 + group).alias("v")),
        lambda b: let(
            F.struct(b["m"].alias("m"), b["v"].alias("v"), _running(F.transform(F.arrays_zip(b["g"].alias("a"), b["m"].alias("b")), lambda z: (F.length(z["a"]) + F.length(z["b"])).cast("long"))).alias("e")),
            lambda c: F.transform(c["e"], lambda e, i: F.struct((e - F.length(F.get(c["m"], i))).alias("start"), e.alias("end"), F.get(c["v"], i).alias("value"), F.get(c["m"], i).alias("hit"))),
        ),
    )
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,value:string,hit:string>>"))


def _upper_tail(z: Column) -> Column:
    """Normal tail probability (Abramowitz and Stegun 26.2.17)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    q = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, q).otherwise(1 - q)


def _encoding(body: Column) -> Column:
    """What the tests need of the narrowest alphabet that fits; null if none does."""

    def entry(name: str, alphabet: str) -> Column:
        q, covariance = class_constants(alphabet)
        a, b, c, d = NULLS[NULL_OF.get(name, name)]
        numbers = {"k": float(len(alphabet)), "q": q, "cov": covariance, "a": a, "b": b, "c": c, "d": d}
        return F.struct(F.lit(name).alias("e"), F.lit(serial_order(alphabet)).alias("order"), *[F.lit(x).alias(n) for n, x in numbers.items()])

    return F.coalesce(*[F.when(body.rlike("^[" + x.replace("-", r"\-") + "]+$"), entry(name, x)) for name, x in ALPHABETS.items()])


def _battery(token: Column) -> Column:
    """struct<encoding, bucket, bin, plausible> of one token; encoding is null where no alphabet fits."""

    def scored(x: Column) -> Column:
        s, e = x["s"], x["e"]
        n, k = F.length(s).cast("double"), e["k"]
        squares = F.aggregate(F.split(e["order"], ""), F.lit(0.0), lambda a, c: a + F.pow((F.length(s) - F.length(F.replace(s, c, F.lit("")))).cast("double"), F.lit(2.0)))
        index = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.call_function("locate", c, e["order"]).cast("double") - (k + 1) / 2)
        uniform = (k / n * squares - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        changes = F.regexp_count(s, F.lit(CLASS_RUN)).cast("double") - 1
        runs = (changes - (n - 1) * e["q"]) / F.sqrt((n - 1) * e["q"] * (1 - e["q"]) + 2 * (n - 2) * e["cov"])
        products = lambda i: F.aggregate(F.zip_with(F.slice(i, 1, F.size(i) - 1), F.slice(i, 2, F.size(i) - 1), lambda p, r: p * r), F.lit(0.0), lambda a, v: a + v)
        serial = let(index, products) / ((k * k - 1) / 12) / F.sqrt(n - 1)
        return let(F.struct(uniform.alias("u"), runs.alias("r"), serial.alias("s"), n.alias("n")), lambda z: judged(e, z))

    def judged(e: Column, z: Column) -> Column:
        statistic = z["u"] - z["r"] + SERIAL_SHARE * F.abs(z["s"])
        p = _upper_tail((e["a"] + e["b"] * z["n"] - statistic) / (e["c"] + e["d"] * z["n"]))
        power = F.least(F.lit(float(MAX_POWER)), -F.log10(F.greatest(p, F.lit(1e-300))))
        return F.struct(
            e["e"].alias("encoding"),
            F.least(F.lit(LONGEST_BUCKET), F.floor(F.log2(z["n"])).cast("int")).alias("bucket"),
            F.floor(F.greatest(power, F.lit(0.0)) * BINS_PER_POWER).cast("int").alias("bin"),
            ((z["u"] >= -VETO) & (F.abs(z["r"]) <= VETO) & (F.abs(z["s"]) <= VETO)).alias("plausible"),
        )

    body = F.rtrim(token, F.lit("="))
    return let(let(body, lambda s: F.struct(s.alias("s"), _encoding(s).alias("e"))), scored)


def _base(text: Column) -> Column:
    """The base spans of all kinds, sorted."""

    def one(rank: int, kind: str) -> Column:
        pattern, group, least = KINDS[kind]
        kept = F.filter(find_spans(text, pattern, group), lambda s: F.length(s["value"]) >= least)
        return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    return F.sort_array(F.concat(*[one(rank, kind) for rank, kind in enumerate(KINDS)]))


def _tested(text: Column, base: Column) -> Column:
    """Tokens that touch no base span, with their battery: one sort and running ends, however many spans there are."""
    tokens = find_spans(text, TOKEN)
    last = len(KINDS)
    every = F.sort_array(F.concat(F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), F.lit("").alias("hit"))), F.transform(tokens, lambda s: F.struct(s["start"].alias("start"), F.lit(last).alias("rank"), s["end"].alias("end"), s["hit"].alias("hit")))))
    far = 1 << 62

    def free(x: Column) -> Column:
        # Base ends up to here, and base starts from here on (mirrored, so that a running maximum serves).
        ends = _running_max(F.transform(x, lambda s: F.when(s["rank"] < last, s["end"]).otherwise(F.lit(0).cast("long"))))
        starts = F.reverse(_running_max(F.reverse(F.transform(x, lambda s: F.when(s["rank"] < last, far - s["start"]).otherwise(F.lit(0).cast("long"))))))
        alone = lambda y: F.filter(y["x"], lambda s, i: (s["rank"] == last) & (F.get(y["e"], i) <= s["start"]) & (far - F.get(y["s"], i) >= s["end"]))
        return let(F.struct(x.alias("x"), ends.alias("e"), starts.alias("s")), alone)

    judged = F.transform(let(every, free), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), _battery(s["hit"]).alias("b")))
    fits = F.filter(judged, lambda s: s["b"]["encoding"].isNotNull())
    return F.when(text.rlike(TOKEN), fits).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,b:struct<encoding:string,bucket:int,bin:int,plausible:boolean>>>"))


def discovery_bins(docs: DataFrame, false_discovery: float = FALSE_DISCOVERY) -> DataFrame:
    """encoding, bucket, least_bin: one row at most for each of the 8 x 11 strata."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tested = docs.select(text.alias("t")).filter(F.col("t").rlike(TOKEN)).select(F.explode(_tested(F.col("t"), _base(F.col("t")))).alias("x")).select("x.b.*").filter("plausible")
    counts = tested.groupBy("encoding", "bucket", "bin").agg(F.count("*").alias("n"))
    return passing_bins(counts, false_discovery)


def passing_bins(counts: DataFrame, false_discovery: float) -> DataFrame:
    """Benjamini-Hochberg on counts of p-value bins: the least bin of each stratum that passes."""
    stratum = Window.partitionBy("encoding", "bucket")
    above = stratum.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("m", F.sum("n").over(stratum)).withColumn("rank", F.sum("n").over(above))
    passed = F.pow(F.lit(10.0), -F.col("bin") / float(BINS_PER_POWER)) <= false_discovery * F.col("rank") / F.col("m")
    return ranked.filter(passed).groupBy("encoding", "bucket").agg(F.min("bin").alias("least_bin"))


def scan(docs: DataFrame, false_discovery: float = FALSE_DISCOVERY) -> DataFrame:
    """All columns of docs with `spans`: array<struct<start,rank,end,kind>>, sorted.

    Kind `random` marks what the battery adds outside the base spans.
    """
    # One number for each of at most 88 strata: a bound that no input moves.
    found = discovery_bins(docs, false_discovery).collect()
    entries = [x for r in found for x in (F.lit(f"{r['encoding']}:{r['bucket']}"), F.lit(r["least_bin"]))]
    bins = F.create_map(*entries) if entries else F.create_map(F.lit(""), F.lit(1 << 30))
    base, tested = unused(docs, "base"), unused(docs, "tested")
    text = F.coalesce(F.col("text"), F.lit(""))
    staged = docs.withColumn(base, _base(text)).withColumn(tested, _tested(text, F.col(base)))
    chosen = F.filter(tested, lambda s: s["b"]["plausible"] & F.coalesce(s["b"]["bin"] >= F.try_element_at(bins, F.concat_ws(":", s["b"]["encoding"], s["b"]["bucket"])), F.lit(False)))
    extra = F.transform(chosen, lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), s["end"].alias("end"), F.lit("random").alias("kind")))
    return staged.withColumn("spans", F.when(F.size(chosen) > 0, F.sort_array(F.concat(F.col(base), extra))).otherwise(F.col(base))).drop(base, tested)


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span replaced; overlapping spans merge into the first.

    The text is cut into blocks once and each stretch between spans is taken from
    its blocks, so the work follows the length and the number of spans.
    """

    def between(blocks: Column, a: Column, b: Column) -> Column:
        i, j = F.floor(a / CUT).cast("int"), F.floor(b / CUT).cast("int")
        head = F.coalesce(F.get(blocks, i), F.lit(""))
        one = F.substring(head, (a % CUT + 1).cast("int"), (b - a).cast("int"))
        more = F.concat(F.substring(head, (a % CUT + 1).cast("int"), F.lit(CUT)), F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(F.coalesce(F.get(blocks, j), F.lit("")), F.lit(1), (b % CUT).cast("int")))
        return F.when(i == j, one).otherwise(more)

    def pieces(x: Column) -> Column:
        reach = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(x["e"], i - 1))
        cut = F.transform(x["s"], lambda s, i: F.when(s["start"] >= reach(i), F.concat(between(x["b"], reach(i), s["start"]), F.lit(mark))).otherwise(F.lit("")))
        return F.concat(F.array_join(cut, ""), between(x["b"], F.element_at(x["e"], -1), F.length(text).cast("long")))

    blocks = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % CUT), F.lit(0))
    box = F.struct(spans.alias("s"), _running_max(F.transform(spans, lambda s: s["end"])).alias("e"), blocks.alias("b"))
    return F.when(F.size(spans) > 0, let(box, pieces)).otherwise(text)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op6_secret_scan(spark, sf_dir):
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_joined(F.filter("spans", lambda s: s["kind"] != "random")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def _sql() -> str:
    """The same in SQL: spans by relations, the battery by list functions."""
    words = "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
    kinds = {"assign": (words + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 3, 8), "access": ("AKIA[A-Z0-9]+", 2, 16), "hex": ("[0-9a-f]{32,}", 2, 32), "token": ("[A-Za-z0-9+/_-]+={0,2}", 2, MIN_TOKEN)}
    found = " UNION ALL ".join(
        f"SELECT r, {i} AS rank, '{kind}' AS kind, {least} AS least, unnest(regexp_extract_all(t, '(?s)(.*?)({p})', 1)) AS g, unnest(regexp_extract_all(t, '(?s)(.*?)({p})', 2)) AS m, unnest(regexp_extract_all(t, '(?s)(.*?)({p})', {group})) AS v, generate_subscripts(regexp_extract_all(t, '(?s)(.*?)({p})', 2), 1) AS i FROM d"
        for i, (kind, (p, group, least)) in enumerate(kinds.items())
    )
    rows = []
    for i, (name, alphabet) in enumerate(ALPHABETS.items()):
        q, covariance = class_constants(alphabet)
        numbers = (float(len(alphabet)), q, covariance, *map(float, NULLS[NULL_OF.get(name, name)]))
        rows.append(f"({i}, '{name}', '[{alphabet.replace('-', chr(92) + '-')}]+', '{serial_order(alphabet)}', " + ", ".join(f"{x!r}::DOUBLE" for x in numbers) + ")")
    tail = "exp(-x * x / 2) / 2.5066282746310002 * (w * (0.319381530 + w * (-0.356563782 + w * (1.781477937 + w * (-1.821255978 + w * 1.330274429)))))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT r, rank, kind, v, m, sum(len(g) + len(m)) OVER (PARTITION BY r, rank ORDER BY i) AS stop, least FROM ({found})),
s AS (SELECT r, rank, kind, stop - len(m) AS start, stop, rtrim(v, '=') AS v FROM f WHERE CASE WHEN kind = 'token' THEN len(rtrim(v, '=')) ELSE len(v) END >= least),
tok AS (SELECT * FROM s WHERE kind = 'token' AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')),
base AS (SELECT * FROM s WHERE kind <> 'token'),
free AS (SELECT row_number() OVER () AS id, * FROM tok WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.r = tok.r AND base.start < tok.stop AND tok.start < base.stop)),
e(nr, encoding, fits, ord, k, q, cov, a, b, c, d) AS (VALUES {", ".join(rows)}),
x AS (SELECT free.*, e.*, len(v)::DOUBLE AS n FROM free JOIN e ON regexp_full_match(v, fits) QUALIFY row_number() OVER (PARTITION BY id ORDER BY nr) = 1),
y AS (SELECT *, list_sum(list_transform(string_split(ord, ''), lambda o: pow((len(v) - len(replace(v, o, '')))::DOUBLE, 2))) AS squares,
        len(regexp_extract_all(v, '{CLASS_RUN}'))::DOUBLE - 1 AS changes, list_transform(string_split(v, ''), lambda o: instr(ord, o)::DOUBLE - (k + 1) / 2) AS idx FROM x),
z AS (SELECT *, (k / n * squares - n - (k - 1)) / sqrt(2 * (k - 1) * (n - 1) / n) AS u, (changes - (n - 1) * q) / sqrt((n - 1) * q * (1 - q) + 2 * (n - 2) * cov) AS run,
        list_sum(list_transform(range(1, len(idx)), lambda j: idx[j] * idx[j + 1])) / ((k * k - 1) / 12) / sqrt(n - 1) AS ser FROM y),
h AS (SELECT *, (a + b * n - (u - run + {SERIAL_SHARE} * abs(ser))) / (c + d * n) AS z FROM z WHERE u >= -{VETO} AND abs(run) <= {VETO} AND abs(ser) <= {VETO}),
h2 AS (SELECT *, abs(z) AS x, 1 / (1 + 0.2316419 * abs(z)) AS w FROM h),
h3 AS (SELECT *, CASE WHEN z >= 0 THEN {tail} ELSE 1 - {tail} END AS p FROM h2),
h4 AS (SELECT r, start, stop, encoding, least({LONGEST_BUCKET}, floor(log2(n))) AS bucket, floor(greatest(least({MAX_POWER}, -log10(greatest(p, 1e-300))), 0) * {BINS_PER_POWER}) AS bin FROM h3),
c AS (SELECT encoding, bucket, bin, count(*) AS n FROM h4 GROUP BY ALL),
rk AS (SELECT *, sum(n) OVER (PARTITION BY encoding, bucket) AS m, sum(n) OVER (PARTITION BY encoding, bucket ORDER BY bin DESC) AS rank FROM c),
ok AS (SELECT encoding, bucket, min(bin) AS least_bin FROM rk WHERE pow(10.0, -bin / {float(BINS_PER_POWER)}) <= {FALSE_DISCOVERY} * rank / m GROUP BY ALL),
al AS (SELECT r, rank, kind, start, stop FROM base UNION ALL SELECT r, {len(KINDS)}, 'random', start, stop FROM h4 JOIN ok USING (encoding, bucket) WHERE bin >= least_bin),
j AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (kind <> 'random'), '') AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM al GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j ON d.r = j.r
"""


SQL = _sql()
