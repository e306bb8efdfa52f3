"""Conversations as arrays of struct<role, content>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.text import bind, strip, strip_markup
from weft.functions.tokens import token_count

# Names of roles in the sources, chat tags, repeated-unit loop.
ROLES = {"human": "user", "user": "user", "question": "user", "instruction": "user", "gpt": "assistant", "assistant": "assistant", "answer": "assistant", "response": "assistant"}
FORBIDDEN = ("<|im_start|>", "<|im_end|>", "<|thought_start|>", "<|thought_end|>")
LOOP = r"(?s)(.{12,80})(?:\1){3,}"
# Guesses, documents and failures in answers.
SPECULATIVE = r"可能|也许|似乎|或许|大概|推测|看起来像"
OCR = r"表格|图表|文字|字幕|标志|品牌|广告|海报|菜单|屏幕|网页|界面|文档|二维码|公式|坐标轴|矩阵"
BAD_GENERATION = r"根据你的描述|设计了一个新的问题|作为(?:一个|一名)?AI|无法看到图片"
THOUGHT_START, THOUGHT_END = "<|thought_start|>", "<|thought_end|>"


def gather(turns: DataFrame) -> DataFrame:
    """conv_id, msgs: the turns of each conversation in order."""
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content")))).alias("m"))
    return listed.select("conv_id", F.transform("m", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("msgs"))


def map_role(role: Column) -> Column:
    """user, assistant or null."""
    plain = F.lower(strip(F.coalesce(role, F.lit(""))))
    out = F.lit(None).cast("string")
    for name, to in ROLES.items():
        out = F.when(plain == name, to).otherwise(out)
    return out


def unify(msgs: Column) -> Column:
    """Known roles with stripped, non-empty contents."""
    mapped = F.transform(msgs, lambda m: F.struct(map_role(m["role"]).alias("role"), strip(m["content"]).alias("content")))
    return F.filter(mapped, lambda m: m["role"].isNotNull() & (m["content"] != ""))


def render(msgs: Column) -> Column:
    """ChatML text of all turns."""
    return F.array_join(F.transform(msgs, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))), "")


def thinking_turn(question: Column, thought: Column, answer: Column) -> Column:
    """ChatML of one question whose answer is preceded by a thought between its tags."""
    return F.concat(F.lit("<|im_start|>user\n"), question, F.lit(f"<|im_end|>\n<|im_start|>assistant\n{THOUGHT_START}\n"), thought, F.lit(f"\n{THOUGHT_END}\n"), answer, F.lit("<|im_end|>\n"))


def build_messages(question: Column, thought: Column, answer: Column, system: str) -> Column:
    """System and thought only where there is a thought."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    plain = F.array(turn("user", question), turn("assistant", answer))
    wrapped = F.array(turn("system", F.lit(system)), turn("user", question), turn("assistant", F.concat(F.lit(THOUGHT_START + "\n"), thought, F.lit("\n" + THOUGHT_END + "\n"), answer)))
    return F.when(F.coalesce(thought, F.lit("")) != "", wrapped).otherwise(plain)


def drop_system(msgs: Column) -> Column:
    """Without system turns and empty thought marks."""
    empty = F.lit(THOUGHT_START + "\n" + THOUGHT_END + "\n")
    return F.transform(F.filter(msgs, lambda m: m["role"] != "system"), lambda m: F.struct(m["role"].alias("role"), F.replace(m["content"], empty, F.lit("")).alias("content")))


def _roles(msgs: Column) -> Column:
    return F.transform(msgs, lambda m: m["role"])


def trim_ends(msgs: Column) -> Column:
    """From the first user turn to the last assistant turn; empty if they don't stand so."""
    roles = _roles(msgs)
    first, back = F.array_position(roles, "user"), F.array_position(F.reverse(roles), "assistant")
    last = F.size(msgs) - back + 1
    return F.when((first > 0) & (back > 0) & (last > first), F.slice(msgs, first.cast("int"), (last - first + 1).cast("int"))).otherwise(F.slice(msgs, 1, 0))


def alternates(msgs: Column) -> Column:
    """No two neighbours share a role; true for a single turn, false for none."""
    steps = F.when(F.size(msgs) < 2, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.size(msgs) - 1))
    return (F.size(msgs) > 0) & F.forall(steps, lambda i: F.get(msgs, i)["role"] != F.get(msgs, i - 1)["role"])


def has_both_roles(msgs: Column) -> Column:
    return F.exists(msgs, lambda m: m["role"] == "user") & F.exists(msgs, lambda m: m["role"] == "assistant")


def turn_tokens(msgs: Column) -> Column:
    """Rendered tokens of each turn."""
    return F.transform(msgs, lambda m: token_count(F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))))


def fit_prefix(msgs: Column, budget: Column) -> Column:
    """The longest prefix that ends with an assistant turn and fits the token budget."""
    counts = turn_tokens(msgs)
    ends = F.filter(
        F.transform(msgs, lambda m, i: F.when((m["role"] == "assistant") & (F.aggregate(F.slice(counts, 1, i + 1), F.lit(0).cast("long"), lambda a, x: a + x) <= budget), i + 1)),
        lambda i: i.isNotNull(),
    )
    return F.slice(msgs, 1, F.coalesce(F.array_max(ends), F.lit(0)))


def trim_history(msgs: Column, budget: Column) -> Column:
    """The latest turns within the budget, from a user turn on."""
    counts = turn_tokens(msgs)
    n = F.size(msgs)
    starts = F.filter(F.transform(msgs, lambda m, i: F.when((m["role"] == "user") & (F.aggregate(F.slice(counts, i + 1, n), F.lit(0).cast("long"), lambda a, x: a + x) <= budget), i + 1)), lambda i: i.isNotNull())
    return F.when(F.array_min(starts).isNull(), F.slice(msgs, 1, 0)).otherwise(F.slice(msgs, F.array_min(starts), n))


def first_user_last_assistant(msgs: Column) -> tuple[Column, Column]:
    pick = lambda role, at: F.try_element_at(F.filter(msgs, lambda m: (m["role"] == role) & (strip(m["content"]) != "")), F.lit(at))["content"]
    return pick("user", 1), pick("assistant", -1)


def normalise(msgs: Column, default_prompt: str, marker: str = "<img>") -> Column:
    """struct<msgs, reason>: turns with mapped roles and cleaned contents and one image mark at the head, or why there are none.

    Ten reasons, the first that holds in this order wins. An empty user turn becomes the default prompt.
    """
    known = F.transform(msgs, lambda m: F.struct(map_role(m["role"]).alias("role"), strip_markup(m["content"]).alias("content"), m.isNull().alias("missing")))
    filled = F.transform(known, lambda m: F.struct(m["role"].alias("role"), F.when((m["role"] == "user") & (m["content"] == ""), F.lit(default_prompt)).otherwise(m["content"]).alias("content"), m["missing"].alias("missing")))

    def judge(x: Column) -> Column:
        has = lambda test: F.exists(x, test)
        first_bad = F.get(F.filter(F.transform(x, lambda m: F.when(m["missing"], "turn_not_object").when(m["role"].isNull(), "unknown_role").when(m["content"] == "", "empty_assistant")), lambda r: r.isNotNull()), 0)
        marks = F.aggregate(x, F.lit(1), lambda a, m: a + F.regexp_count(m["content"], F.lit(marker)))
        reason = F.coalesce(
            first_bad,
            F.when(F.size(x) < 2, "too_few_turns")
            .when((F.get(x, 0)["role"] != "user") | (F.get(x, F.size(x) - 1)["role"] != "assistant"), "bad_end_roles")
            .when(~alternates(x), "non_alternating")
            .when(~has(lambda m: m["role"] == "assistant"), "no_assistant")
            .when(has(lambda m: (m["role"] == "assistant") & m["content"].rlike(LOOP)), "loop")
            .when(marks != 1, "image_marker_count")
            .when(has(lambda m: (m["role"] == "assistant") & F.contains(m["content"], F.lit(marker))), "assistant_image_marker"),
        )
        marked = F.transform(x, lambda m, i: F.struct(m["role"].alias("role"), F.when(i == 0, F.concat(F.lit(marker + "\n"), m["content"])).otherwise(m["content"]).alias("content")))
        return bind(reason, lambda r: F.struct(F.when(r.isNull(), marked).alias("msgs"), r.alias("reason")))

    return bind(filled, judge)


def replay_ok(msgs: Column) -> Column:
    """The strict variant: system turns aside, trimmed ends alternate and hold no protocol tags or noise."""
    plain = F.filter(msgs, lambda m: m["role"] != "system")
    bad = lambda m: (strip(m["content"]) == "") | m["content"].contains("�") | m["content"].contains("\0") | F.exists(F.array(*[F.lit(t) for t in FORBIDDEN]), lambda t: F.contains(m["content"], t))
    ends = trim_ends(plain)
    return ~F.exists(plain, bad) & (F.size(ends) >= 2) & (F.size(ends) % 2 == 0) & alternates(ends)


def prompt_key(msgs: Column) -> Column:
    users = F.array_join(F.transform(F.filter(msgs, lambda m: m["role"] == "user"), lambda m: m["content"]), "\n")
    return F.lower(strip(F.regexp_replace(users, r"[\s\p{Z}]+", " ")))


def with_image_marker(msgs: Column, marker: str = "<img>") -> Column:
    """Exactly one marker, at the head of the first user turn."""
    bare = F.transform(msgs, lambda m: F.struct(m["role"].alias("role"), F.replace(m["content"], F.lit(marker), F.lit("")).alias("content")))
    at = F.array_position(_roles(msgs), "user") - 1
    return F.transform(bare, lambda m, i: F.struct(m["role"].alias("role"), F.when(i == at, F.concat(F.lit(marker + "\n"), m["content"])).otherwise(m["content"]).alias("content")))


def ensure_image_marker(msgs: Column, marker: str = "<img>") -> Column:
    """A marker at the head of the first user turn if no user turn has one; those that are there stay."""
    present = F.exists(msgs, lambda m: (m["role"] == "user") & F.contains(m["content"], F.lit(marker)))
    at = F.array_position(_roles(msgs), "user") - 1
    return F.when(present, msgs).otherwise(F.transform(msgs, lambda m, i: F.struct(m["role"].alias("role"), F.when(i == at, strip(F.concat(F.lit(marker + "\n"), m["content"]))).otherwise(m["content"]).alias("content"))))


def platform_messages(user: Column, answer: Column, system: str) -> Column:
    """System turn, question, and an answer behind an empty thought."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("system", F.lit(system)), turn("user", user), turn("assistant", F.concat(F.lit(f"{THOUGHT_START}\n{THOUGHT_END}\n"), answer)))


def assistant_mask(msgs: Column) -> Column:
    """1 for the tokens of assistant contents and their end marks, 0 elsewhere, over the rendered tokens."""
    head = lambda m: token_count(F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n")))
    body = lambda m: token_count(m["content"]) + token_count(F.lit("<|im_end|>"))
    ones = lambda n, v: F.array_repeat(v, n.cast("int"))
    return F.flatten(F.transform(msgs, lambda m: F.concat(ones(head(m), F.lit(0)), ones(body(m), (m["role"] == "assistant").cast("int")))))


def quality(msgs: Column) -> Column:
    """struct of turns, assistant_chars, alternating, image_markers and flags of what the answers say."""
    answers = F.transform(F.filter(msgs, lambda m: m["role"] == "assistant"), lambda m: m["content"])
    marks = F.aggregate(msgs, F.lit(0), lambda a, m: a + F.regexp_count(m["content"], F.lit("<image>|<img>")))
    flags = lambda x: F.struct(F.length(x).alias("assistant_chars"), x.rlike(SPECULATIVE).alias("speculative"), x.rlike(OCR).alias("ocr_doc"), x.rlike(BAD_GENERATION).alias("bad_generation"))
    return bind(
        bind(F.array_join(answers, "\n"), flags),
        lambda f: F.struct(F.size(answers).alias("turns"), f["assistant_chars"].alias("assistant_chars"), alternates(msgs).alias("alternating"), marks.alias("image_markers"), f["speculative"].alias("speculative"), f["ocr_doc"].alias("ocr_doc"), f["bad_generation"].alias("bad_generation")),
    )


def qa_messages(pairs: Column, most: int = 4) -> Column:
    """Question and answer pairs (struct<q, a>) as alternating turns, the first `most` of them."""
    turn = lambda role, x: F.struct(F.lit(role).alias("role"), x.alias("content"))
    return F.flatten(F.transform(F.slice(pairs, 1, most), lambda p: F.array(turn("user", p["q"]), turn("assistant", p["a"]))))
