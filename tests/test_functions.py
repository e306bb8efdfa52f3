"""Small hand-written cases of functions and operators."""

from pyspark.sql import functions as F

from weft.functions import answers, chat, degeneration, lang, rewards, text, tokens
from weft.operators import budget, dedup, mixing, packing, prefix, profile, temporal


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_clean_text(spark):
    assert one(spark, text.clean_text(F.col("t")), t="　a​☀b\U0001f600\0 \n") == "ab"


def test_normalize_light(spark):
    assert one(spark, text.normalize_light(F.col("t")), t="a \t b  \n  c ") == "a b\nc"


def test_strip_markup(spark):
    assert one(spark, text.strip_markup(F.col("t")), t="<|im_start|><image>Hi  <b>there</b>\n\n<惊讶> x") == "Hi there\nx"


def test_sanitize_keeps_comparisons(spark):
    assert one(spark, text.sanitize_generated(F.col("t"), F.lit("chat")), t="a < b<br/>c<p>d") == "a < b\ncd"
    assert one(spark, text.sanitize_generated(F.col("t"), F.lit("math")), t="<p>d") == "<p>d"


def test_scripts(spark):
    assert not one(spark, lang.has_foreign_script(F.col("t")), t="plain 汉字 5µ Å αβ")
    for t in ("é", "привет", "かな", "한국"):
        assert one(spark, lang.has_foreign_script(F.col("t")), t=t)
    assert one(spark, lang.outside_allowed(F.col("t")), t="ก")


def test_lenient_int(spark):
    assert [one(spark, lang.lenient_int(F.col("t")), t=t) for t in ("1,234", "2.9", "x", " 7 ")] == [1234, 2, None, 7]


MSGS = "array<struct<role:string,content:string>>"


def msgs(spark, *turns):
    return spark.createDataFrame([([{"role": r, "content": c} for r, c in turns],)], f"m {MSGS}")


def test_alternation_of_short_chats(spark):
    check = lambda *t: msgs(spark, *t).select(chat.alternates(F.col("m")).alias("x")).first()["x"]
    assert check(("user", "a")) and check(("user", "a"), ("assistant", "b"))
    assert not check() and not check(("user", "a"), ("user", "b"))


def test_trim_and_fit(spark):
    d = msgs(spark, ("system", "s"), ("user", "a b"), ("assistant", "c"), ("user", "d"))
    assert [m["role"] for m in d.select(chat.trim_ends(F.col("m")).alias("x")).first()["x"]] == ["user", "assistant"]
    assert d.select(F.size(chat.fit_prefix(F.col("m"), F.lit(5)))).first()[0] == 0


def test_reject_reasons(spark):
    reason = lambda *t: msgs(spark, *t).select(chat.normalise(F.col("m"), "Describe.")["reason"].alias("x")).first()["x"]
    kept = msgs(spark, ("human", "<image>"), ("gpt", "b")).select(chat.render(chat.normalise(F.col("m"), "Describe.")["msgs"]).alias("x")).first()["x"]
    assert kept.startswith("<|im_start|>user\n<img>\nDescribe.<|im_end|>")
    assert spark.createDataFrame([([None],)], f"m {MSGS}").select(chat.normalise(F.col("m"), "x")["reason"].alias("x")).first()["x"] == "turn_not_object"
    assert reason(("user", "a"), ("user", "c"), ("assistant", "b")) == "non_alternating"
    assert reason(("user", "a"), ("assistant", "b")) is None
    assert reason(("user", "a"), ("robot", "b")) == "unknown_role"
    assert reason(("user", "a"), ("assistant", " ")) == "empty_assistant"
    assert reason(("user", "a")) == "too_few_turns"
    assert reason(("assistant", "a"), ("user", "b")) == "bad_end_roles"
    assert reason(("user", "a"), ("assistant", "Looping words " * 5)) == "loop"


def test_numeric_rewards(spark):
    body = "<|thought_start|>" + "word " * 60 + "<|thought_end|>\\boxed{42}"
    p = spark.createDataFrame([(body, "#### 42")], "t string, g string").select(answers.parse_prediction(F.col("t")).alias("p"), answers.truth_number(F.col("g")).alias("g"))
    r = p.select(rewards.number_reward(F.lit(False), F.col("p.final_answer") == F.col("g"), F.col("p.from_box"), F.col("p.has_cot_tags"), F.col("p.cot_tokens")).alias("x"), "p.cot_tokens", "g").first()
    assert r["cot_tokens"] == 60 and r["g"] == 42.0 and abs(r["x"] - (1.3 + 0.2 * 10 / 206)) < 1e-9
    assert one(spark, degeneration.exact_loop(F.col("t")), t="this phrase repeats again. " * 3 + "\\boxed{42}")


def test_letters(spark):
    read = lambda t: one(spark, answers.parse_letter(F.col("t"))["final_answer"], t=t)
    assert read(r"so \boxed{ b }") == "B" and read("Answer: C since A is wrong") == "C"
    assert read("it is D.") == "D" and read("A cat sat") is None and read(r"\boxed{AB}") is None


def test_marker_split(spark):
    split = lambda t: one(spark, answers.split_by_marker(F.col("t")), t=t)
    assert split("We add.\nThe answer is 4")["status"] == "marker_ok"
    assert split("We add.\nThe answer is 4")["thought"] == "We add."
    assert split("The answer is 4")["status"] == "marker_but_no_prefix"
    assert split("x\nso, a\nb\nc")["status"] == "marker_invalid_many_newlines"
    assert split("x\nso, " + "w " * 20)["status"] == "marker_tail_too_long"
    assert split("nothing")["status"] == "no_marker" and split(" ")["status"] == "empty"


def test_boxes(spark):
    good = [r"$\boxed{7}$", r"\boxed{\frac{1}{2}}", r"\boxed{1} then \boxed{2}", r"\( \boxed{7} \)", r"\boxed {x\}y} tail {", r"\\(\boxed{7}\\)", r"\$ \boxed{7}", r"<|thought_start|>a<|thought_end|>\boxed{7}"]
    bad = [r"$\boxed{7}", r"<|thought_start|>\boxed{7}", r"\boxed{7", r"\boxed", r"\boxed{1} then \boxed{2", r"\[ \boxed{7}", r"\boxed x{7}", "", r"\\(\boxed{7}", None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "i long, t string")
    assert [r["c"] for r in d.select("i", answers.box_is_complete(F.col("t")).alias("c")).orderBy("i").collect()] == [True] * len(good) + [False] * len(bad)


def test_numeric_tails(spark):
    tail = lambda t: tuple(one(spark, degeneration.low_information_tail(F.col("t")), t=t))
    noise = "12.5%, 13..7-8 " * 8
    assert tail("It grew. And then " + noise) == (True, len("It grew. And then"))
    assert tail("It grew! And then " + noise) == (True, len("It grew!"))
    assert tail("It grew!" + "x" * 60 + noise)[1] == 68 and tail("In 2024 it grew by 12 %.") == (False, None) and tail("1" * 80) == (False, None)


def test_math_is_no_prose_loop():
    assert degeneration.prose_loop("x^2+1=y; " * 12) is None
    assert degeneration.prose_loop("the same words come again. " * 4) is not None


def test_token_cycle():
    assert degeneration.token_cycle(list("abcdefgh") * 3) == 8 and degeneration.token_cycle(list(range(200))) == 0


def test_running_total_equals_one_pass(spark):
    d = spark.range(0, 1000).select((F.col("id") * 7919 % 1009).alias("k"), (F.col("id") % 13).alias("v"))
    rows = {r["k"]: r["t"] for r in prefix.running_total(d, ["k"], F.col("v"), "t", buckets=16).collect()}
    total = 0
    for r in sorted(d.collect()):
        total += r["v"]
        assert rows[r["k"]] == total


def test_budgets(spark):
    d = spark.createDataFrame([(i, n) for i, n in enumerate((5, 7, 1, 9, 2))], "i long, n long")
    ids = lambda x: sorted(r["i"] for r in x.collect())
    assert ids(budget.stop_after(d, ["i"], F.col("n"), 12)) == [0, 1]
    assert ids(budget.break_before(d, ["i"], F.col("n"), 12)) == [0, 1]
    assert ids(budget.skip_what_does_not_fit(d, ["i"], F.col("n"), 9)) == [0, 2, 4]
    assert ids(budget.cap_files(d.withColumn("f", F.lit(1)), ["f"], ["i"], F.col("n"), 12)) == [0, 1]


def test_first_fit_by_runs_equals_one_pass(spark):
    import random

    rng = random.Random(5)
    for target in (50, 400, 3000):
        sizes = [rng.choice([1, 2, 5, 30, 90, 400]) for _ in range(120)]
        d = spark.createDataFrame(list(enumerate(sizes)), "i long, n long")
        want, total = [], 0
        for i, n in enumerate(sizes):
            if total + n <= target:
                total += n
                want.append(i)
        assert sorted(r["i"] for r in budget.skip_what_does_not_fit(d, ["i"], F.col("n"), target, fold_rows=10).collect()) == want


def test_too_few_rows_raise(spark):
    import pytest

    from weft.operators import sampling

    with pytest.raises(ValueError, match="2 rows of 3"):
        sampling.quota(spark.range(2), "id", "s", 3, "rows")
    with pytest.raises(TypeError):
        prefix.running_total(spark.createDataFrame([("a",)], "k string"), ["k"], F.lit(1), "t")


def test_keep_first_of_hot_key(spark):
    d = spark.range(0, 500).select("id", F.when(F.col("id") < 400, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    assert dedup.keep_first(d, F.col("k"), ["id"]).count() == 101


def test_packed_blocks_conserve_tokens(spark):
    d = spark.createDataFrame([(i, list(range(i * 10, i * 10 + n))) for i, n in enumerate((3, 0, 7, 12, 1))], "k long, ids array<int>")
    blocks = packing.fixed_blocks(d, "k", "ids", 5).orderBy("block").collect()
    flat = [x for r in d.orderBy("k").collect() for x in r["ids"]]
    assert [x for b in blocks for x in b["ids"]] == flat[: len(flat) // 5 * 5]
    assert [(b["source"], b["offset"]) for b in blocks] == [(0, 0), (2, 2), (3, 0), (3, 5)]


def test_masks_have_one_entry_for_each_token(spark):
    d = msgs(spark, ("user", "a b"), ("assistant", "c, d"))
    n = d.select(F.size(chat.assistant_mask(F.col("m"))).alias("a"), tokens.token_count(chat.render(F.col("m"))).alias("b")).first()
    assert n["a"] == n["b"]


def test_nearest_rank(spark):
    d = spark.createDataFrame([("x", i) for i in range(1, 11)], "g string, v long")
    r = profile.nearest_rank(d, ["g"], "v", (0.5, 0.9)).first()
    assert (r["p50"], r["p90"], r["max"], r["mean"]) == (6, 10, 10, 5.5)


def test_range_join_on_edges(spark):
    p = spark.createDataFrame([(1, 0.0), (2, 9.99), (3, 10.0), (4, 25.0)], "i long, v double")
    r = spark.createDataFrame([(0, 0.0, 10.0), (1, 5.0, 25.0)], "b long, lo double, hi double")
    assert sorted((x["i"], x["b"]) for x in temporal.range_join(p, "v", r, "lo", "hi", 4.0).collect()) == [(1, 0), (2, 0), (2, 1), (3, 1)]


def test_batches_keep_the_budget(spark):
    d = spark.createDataFrame([(0, i, n) for i, n in enumerate((4, 4, 5, 9, 2))], "s long, i long, n long")
    rows = mixing.token_budget_batches(d, "s", ["i"], "n", 12).orderBy("i").collect()
    assert [r["batch"] for r in rows] == [0, 0, 1, 2, 3]


def test_loop_prefilters_change_nothing(spark):
    import random
    import re

    rng = random.Random(3)
    rows = []
    for n in range(300):
        unit = "".join(rng.choice("abc d") for _ in range(rng.choice([14, 15, 16, 17, 20, 21, 31, 33, 80, 140, 141, 159, 160, 161])))
        gap = rng.choice(["", "", " ", "\n "])
        rows.append((n, "".join(rng.choice("xyz ") for _ in range(rng.randrange(40))) + gap.join([unit] * rng.choice([2, 3, 4])) + "end" * rng.randrange(2)))
    d = spark.createDataFrame(rows, "i long, t string")
    got = {r["i"]: (r["a"], r["b"]) for r in d.select("i", degeneration.exact_loop(F.col("t")).alias("a"), degeneration.repeated(F.col("t")).alias("b")).collect()}
    for i, t in rows:
        loop = bool(re.search(r"(?P<u>.{16,160}?)(?P=u){2,}", t, re.S))
        lines = [x.strip() for x in t.split("\n") if len(x.strip()) >= 12]
        spaced = bool(re.search(r"(.{20,140}?)(?:\s*\1){2,}", re.sub(r"\s+", " ", t), re.S)) or len(lines) != len(set(lines))
        assert got[i] == (loop, spaced), t
