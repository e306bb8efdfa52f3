"""Length and token gates, renders, mixes, orders and reports beside the main query modules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weft.functions import chat, degeneration, lang, records, rewards, text
from weft.functions.hashing import hash32, uniform
from weft.functions.tokens import token_count
from weft.operators import budget, dedup, mixing, prefix, profile, sampling
from weft.plans.chat import _LINE, _MSGS
from weft.plans.clean import CLEAN_SQL, _h, _strip
from weft.plans.common import on
from weft.plans.scoring import _CANDIDATES, _REWARD

D, C, B = "documents", "conversations", "benchmark"
_N = r"len(regexp_extract_all(text, '\p{L}+|\p{N}|[^\s\p{L}\p{N}]'))"

# Reasons of the audit of Chinese rows, in its order.
ZH_HIGH_RISK = r"诊断|治疗|药物|用药|疾病|症状|医院|医生|法律|律师|诉讼|判刑|合同纠纷|股票|基金|证券|投资建议|贷款|保险|收益率|政治|选举|总统|主席|政府政策|军事|战争|自杀|自残|杀人|伤害他人|炸弹|爆炸物|毒品|制毒|歧视|仇恨|色情|强奸|犯罪|违法|武器"
ZH_CURRENT = r"最新|目前|现任|今年|今日|实时|价格|票价|汇率|截止.{0,4}年|20(?:2[4-9]|3\d)年"
ZH_NOISE = r"关注.{0,8}(?:账号|博主)|点赞.{0,8}收藏|抽奖|优惠券|下单|购买链接|扫码|加微信|作为一个AI|语言模型|无法回答"
ZH_CONTEXT = r"根据上文|根据本文|根据所给材料|如图所示|见下图|本书作者|这篇文章中"
MATH = r"(?i)(?:\\boxed|\b(?:solve|calculate|equation|algebra|geometry|derivative|integral|proof)\b|(?:求解|计算|方程|几何|导数|积分|证明|概率|因式分解)|\d\s*[+*/=]\s*\d)"
SEGMENTATION = r"分词处理|根据标题写摘要"
EVAL_SUFFIX = "\nPut your final answer in LaTeX boxed form like $\\boxed{answer}$."


def _classes(d):
    """Reasons against a question (the source and a phrase by id) and its answer (the text)."""
    phrase = F.get(F.array(*[F.lit(x) for x in ("", "诊断", "目前的情况", "扫码", "如图所示", "<|im_end|>", "求解", "http://a", "�")]), (F.col("doc_id") % 9).cast("int"))
    x = d.select("doc_id", F.concat("source", phrase).alias("user"), F.col("text").alias("answer")).withColumn("both", F.concat("user", F.lit("\n"), "answer"))
    tags = F.array(*[F.lit(t) for t in chat.FORBIDDEN])
    checks = [
        ((F.col("user") == "") | (F.col("answer") == ""), "empty"), (F.exists(tags, lambda t: F.contains("both", t)), "protocol_injection"), (F.contains("both", F.lit("�")) | F.contains("both", F.lit("\0")), "encoding_noise"),
        (lang.cjk_ratio(F.col("both")) < 0.65, "not_chinese_dominant"), (F.col("user").rlike(MATH), "math_like"), (F.col("both").rlike(ZH_HIGH_RISK), "high_risk"), (F.col("both").rlike(ZH_CURRENT), "time_sensitive"),
        (F.col("both").rlike(ZH_NOISE), "ad_or_boilerplate"), (F.col("both").rlike(ZH_CONTEXT), "missing_context"),
        (F.contains("both", F.lit("```")) | F.contains(F.lower("both"), F.lit("<html")) | F.contains("both", F.lit("http://")) | F.contains("both", F.lit("https://")), "code_or_link"), (degeneration.duplicate_lines(F.col("answer")), "repetition"),
    ]
    return x.select("doc_id", F.array_join(F.array_compact(F.array(*[F.when(c, n) for c, n in checks])), ",").alias("reasons"))


def _thought_gate(d):
    """Even ids carry their text as a thought, odd ones as an answer; whichever is too long goes, and half of those without thought."""
    n = token_count(F.col("text"))
    thinks = F.col("doc_id") % 2 == 0
    return d.select("doc_id", F.when(thinks & (n > 450), "drop_long_thought").when(~thinks & (n > 300), "drop_long_answer").when(~thinks & (uniform("gate", F.col("doc_id")) < 0.5), "drop_sampled").otherwise("keep").alias("decision"))


def _length_gate(d):
    n = token_count(F.col("text"))
    return d.select("doc_id", (n <= 512).alias("by_tokens"), (F.length("text") <= 6000).alias("by_chars"), (F.length("text") <= 2048).alias("as_thought"))


def _component_dedup(d):
    """Prompts of three components in turn; one that an earlier component holds goes."""
    key = d.select("doc_id", "lang", text.canonical_prompt(F.substring_index("text", "\n", 1)).alias("key"))
    parts = [key.filter(F.col("lang") == "en"), key.filter(F.col("lang") == "de"), key.filter(~F.col("lang").isin("en", "de"))]
    kept = dedup.distinct_by_components([p.filter("length(key) > 3") for p in parts], "key", "doc_id")
    return kept[0].unionByName(kept[1]).unionByName(kept[2]).select("doc_id", "lang")


def _rendered(t):
    g = chat.gather(t).select("conv_id", F.md5(chat.render(chat.drop_system(F.col("msgs"))).cast("binary")).alias("sig"))
    return dedup.keep_first(g, F.col("sig"), ["conv_id"]).select("conv_id")


def _first_response(d):
    """The first response of a nested list, or the reference where there is none."""
    response = F.transform(F.sequence(F.lit(1), F.col("doc_id").cast("int") % 3), lambda i: F.struct(F.concat("source", F.lit("-"), i.cast("string")).alias("response"), F.lit("m").alias("response_model")))
    listed = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<struct<response:string,response_model:string>>")).otherwise(response)
    return d.select("doc_id", records.first_response(listed, F.col("lang")).alias("answer"))


def _supervised(d):
    """Rows, all and supervised tokens for each source, language and split, with the share of supervised train tokens."""
    split = F.when(F.pmod(hash32("mixs", F.col("doc_id")), F.lit(10)) == 0, "eval").otherwise("train")
    n = token_count(F.col("text"))
    x = d.select(F.concat_ws(":", "source", "lang", split).alias("key"), n.alias("n"), F.greatest(n - 8, F.lit(0)).alias("s"), (split == "train").alias("train"))
    g = x.groupBy("key", "train").agg(F.count("*").alias("rows"), F.sum("n").alias("tokens"), F.sum("s").alias("supervised"))
    total = F.sum(F.when(F.col("train"), F.col("supervised")).otherwise(0)).over(Window.partitionBy())
    return g.select("key", "rows", "tokens", "supervised", F.round(F.when(F.col("train"), F.col("supervised") / F.greatest(total, F.lit(1))).otherwise(0.0), 9).alias("train_share"))


def _loose(d, l):
    """Strict and loose accuracy by prompt and by instruction; loose adds what passes without the first line."""
    x = d.join(l, "doc_id").select("doc_id", F.array((F.col("quality") == 1), F.col("toxic") == 0, F.col("doc_id") % 2 == 0).alias("s"), F.array((F.col("quality") == 1) | (F.col("doc_id") % 5 == 0), F.col("toxic") == 0, F.lit(True)).alias("l"))
    ratio = lambda c: F.round(F.sum(F.size(F.filter(c, lambda v: v))) / F.sum(F.size(c)), 9)
    whole = lambda c: F.round(F.avg(F.forall(c, lambda v: v).cast("int")), 9)
    return x.agg(whole("s").alias("strict_prompt"), ratio("s").alias("strict_instruction"), whole("l").alias("loose_prompt"), ratio("l").alias("loose_instruction"))


def _by_kind(d, l):
    x = d.join(l, "doc_id").select(F.explode(F.arrays_zip(F.array(F.lit("quality"), F.lit("clean"), F.lit("even")).alias("kind"), F.array(F.col("quality") == 1, F.col("toxic") == 0, F.col("doc_id") % 2 == 0).alias("ok"))).alias("x"))
    return x.groupBy("x.kind").agg(F.round(F.avg(F.col("x.ok").cast("int")), 9).alias("accuracy"), F.count("*").alias("n"))


def _mix_rows(d):
    """Text rows for 20 % beside the English rows, two thirds German and one third French, each going round at most three times."""
    vision, share = d.filter("lang = 'en'").count(), 0.2
    german, french = mixing.split_of_mix(vision, share, (2, 1))
    a = mixing.cycle_to(d.filter("lang = 'de'").select("doc_id"), ["doc_id"], german, 3)
    b = mixing.cycle_to(d.filter("lang = 'fr'").select("doc_id"), ["doc_id"], french, 3)
    return a.withColumn("part", F.lit("de")).unionByName(b.withColumn("part", F.lit("fr"))).select("part", "doc_id", "round")


def _pool(d):
    """Which row of its pool each draw of each update reads: two of three general rows are German in even updates, one in odd ones."""
    updates = prefix.row_numbers(d.select("doc_id"), ["doc_id"], "u").select("u")
    return mixing.pool_draws(updates, "u", {"de": d.filter("lang = 'de'").select("doc_id"), "fr": d.filter("lang = 'fr'").select("doc_id")}, "doc_id", {"de": (2, 1), "fr": (1, 2)})


def _ranks(d):
    """Batches dealt to four ranks in turn, within each shard."""
    x = d.select("doc_id", F.floor(F.col("doc_id") / 256).alias("shard"), token_count(F.col("text")).alias("n"))
    out = mixing.token_budget_batches(x, "shard", ["n", "doc_id"], "n", 8192)
    return out.select("doc_id", F.pmod("batch", F.lit(4)).cast("long").alias("rank"))


def _pad_tail(d):
    return mixing.pad_to_multiple(d.filter("lang = 'de'").select("doc_id"), ["doc_id"], 10).select("doc_id", "place")


def _accuracy_reward(d):
    from weft.plans.scoring import letters

    right = F.coalesce(F.col("p.final_answer") == F.col("want"), F.lit(False))
    reward = rewards.letter_reward(F.lit(100), right, F.col("p.boxed").isNotNull(), F.lit(False), F.lit(0))
    return letters(d).agg(F.round(F.avg(right.cast("int")), 9).alias("accuracy"), F.round(F.avg(reward), 9).alias("mean_reward"))


def _loop_reward(d):
    """Answers that repeat themselves lose their reward however right they are."""
    unit = F.concat("lang", F.lit(" "), "source", F.lit(" says it once more. "))
    said = F.concat(F.repeat(unit, F.when(F.col("doc_id") % 3 == 0, 3).otherwise(1)), F.lit("\\boxed{7}"))
    return d.select("doc_id", F.round(rewards.number_reward(degeneration.exact_loop(said), F.col("doc_id") % 2 == 0, F.lit(True), F.lit(False), F.lit(0)), 9).alias("reward"))


def _loops(d):
    s = d.select(degeneration.sentence_repeat(F.col("text")).cast("int").alias("loop"), (F.col("doc_id") % 2).alias("right"), token_count(F.col("text")).alias("n"))
    return s.agg(F.round(F.avg("right"), 9).alias("accuracy"), F.round(F.avg("loop"), 9).alias("loop_rate"), F.round(F.avg("n"), 6).alias("mean_tokens"))


def _short_chats(t):
    """First exchanges with one image mark: two turns, at most 400 characters of answer, no document, failure or loop in it."""
    g = chat.gather(t).select("conv_id", chat.with_image_marker(F.slice(chat.trim_ends(F.filter("msgs", lambda m: m["role"] != "system")), 1, 2)).alias("msgs"))
    q = g.select("conv_id", F.size("msgs").alias("n"), chat.quality(F.col("msgs")).alias("q"), F.exists("msgs", lambda m: (m["role"] == "assistant") & degeneration.has_loop(m["content"])).alias("loop"))
    ok = (F.col("n") == 2) & (F.col("q.turns") == 1) & F.col("q.alternating") & ~F.col("q.ocr_doc") & ~F.col("q.bad_generation") & ~F.col("loop") & (F.col("q.assistant_chars") <= 400) & (F.col("q.image_markers") == 1)
    return q.filter(ok).select("conv_id")


def _fanout(t):
    """Widths of 200, 400 and 800 tokens; a conversation enters the wider ones only if its last answer's prefix has 150 or 300 tokens."""
    least = F.create_map(F.lit(200), F.lit(0), F.lit(400), F.lit(150), F.lit(800), F.lit(300))
    widths = chat.gather(t).withColumn("ctx", F.explode(F.array(F.lit(200), F.lit(400), F.lit(800))))
    fitted = widths.select("conv_id", "ctx", chat.fit_prefix(F.col("msgs"), F.col("ctx")).alias("m")).withColumn("n", F.aggregate(chat.turn_tokens(F.col("m")), F.lit(0).cast("long"), lambda a, x: a + x))
    return fitted.filter((F.size("m") > 0) & (F.col("n") >= F.try_element_at(least, F.col("ctx")))).select("conv_id", "ctx", F.size("m").cast("long").alias("n_turns"), "n")


def _replay_candidates(d):
    from weft.plans.scoring import scored

    s = scored(d).withColumn("t", F.col("cand") * 0.25).withColumn("n", token_count(F.col("text")))
    return s.filter((F.col("t") <= 0.5) & (F.col("reward") >= 1.1) & F.col("correct") & F.col("p.has_cot_tags") & F.col("p.from_box") & F.col("n").between(180, 350)).select("prompt", "cand")


def _groups(d):
    return profile.islands(d.select("doc_id", "lang"), "doc_id", "lang", "doc_id").select("lang", "first", "n", F.array_join(F.col("values").cast("array<string>"), ",").alias("ids"))


def _flag_sums(d):
    x = F.col("text")
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(x.contains("http")).alias("links"), F.count_if(degeneration.duplicate_lines(x)).alias("dup_lines"), F.count_if(x.rlike(r"\p{Nd}{4}")).alias("numbers"), F.count_if(F.length(x) > 4000).alias("long"))


QUERIES = {
    "token_floor": on(D, lambda d: d.select("doc_id", token_count(F.col("text")).alias("n")).filter(F.col("n").between(100, 1000))),
    "length_gate": on(D, _length_gate),
    "thought_gate": on(D, _thought_gate),
    "instruction_drop": on(D, lambda d: d.select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("请分词处理"), "text")).otherwise(F.col("text")).alias("i")).filter(~F.col("i").rlike(SEGMENTATION)).select("doc_id")),
    "keyword_classes": on(D, _classes),
    "flag_sums": on(D, _flag_sums),
    "pictograph_clean": on(D, lambda d: d.select("doc_id", text.without_pictographs(F.concat("text", F.lit("©a😀b☃c🇩🇪"))).alias("txt"))),
    "safe_history": on(D, lambda d: d.select("doc_id", text.safe_history(F.concat(F.lit("<|im_start|><img>"), "text", F.lit("<|IM_END|>"))).alias("txt"))),
    "template_join": on(D, lambda d: d.select("doc_id", text.template_join("Instruction", F.col("source"), "Answer", F.col("text")).alias("txt"))),
    "platform_wrap": on(B, lambda b: b.select("item_id", chat.render(chat.platform_messages(F.col("text"), F.lit("ok"), "Be brief.")).alias("txt"))),
    "eval_suffix": on(B, lambda b: b.select("item_id", F.concat("text", F.lit(EVAL_SUFFIX)).alias("prompt"))),
    "thought_assembly": on(D, lambda d: d.select("doc_id", text.thought_and_answer(F.concat(F.lit("<SUMMARY> "), "source", F.lit(" </SUMMARY>"), F.when(F.col("doc_id") % 2 == 0, "<REASONING>why</REASONING>").otherwise(""), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<CONCLUSION>"), "text", F.lit("</CONCLUSION>"))).otherwise("")), ("SUMMARY", "CAPTION", "REASONING"), "CONCLUSION").alias("x")).select("doc_id", "x.*")),
    "safe_name": on("pages", lambda p: p.select("page_id", text.safe_name(F.col("url")).alias("name"))),
    "file_cap": on(D, lambda d: budget.cap_files(d.select("doc_id", F.floor(F.col("doc_id") / 64).alias("file"), F.octet_length("text").alias("b")), ["file"], ["doc_id"], F.col("b") + 1, 60_000).select("doc_id", "file")),
    "strata_fill": on(D, lambda d: sampling.strata_then_fill(d, "source", "doc_id", "strata2", 2, 60).select("doc_id", "source", "later")),
    "holdout_split": on(D, lambda d: sampling.holdout(d.select("doc_id"), ["doc_id"]).select("doc_id", "split")),
    "paged_rows": on(D, lambda d: sampling.paged(d.select("doc_id"), ["doc_id"], "pages", 20, 130).select("doc_id", "page")),
    "length_order": on(D, lambda d: prefix.row_numbers(d.select((F.col("doc_id") % 3).alias("kind"), token_count(F.col("text")).alias("n"), "doc_id"), ["kind", "n", "doc_id"], "place").select("doc_id", "place")),
    "buffer_shuffle": on(D, lambda d: sampling.buffer_shuffle(d.select("doc_id"), ["doc_id"], "buf", 100).select("doc_id", "place")),
    "shuffle_take": on(D, lambda d: d.select("doc_id").withColumn("h", hash32("take", F.col("doc_id"))).orderBy("h", "doc_id").limit(77).select("doc_id")),
    "dedup_xxh3": on(D, lambda d: dedup.keep_first(d.select("doc_id", records.xxh3(text.clean_text(F.col("text")), 64).alias("h")), F.col("h"), ["doc_id"]).select("doc_id")),
    "xxh3_128_hash": on(D, lambda d: d.select("doc_id", records.xxh3(F.concat_ws("//", "source", F.col("doc_id").cast("string")), 128).alias("h"))),
    "dedup_rendered_chat": on(C, _rendered),
    "component_dedup": on(D, _component_dedup),
    "first_response": on(D, _first_response),
    "mixture_supervised": on(D, _supervised),
    "token_stats": on(D, lambda d: d.groupBy("lang").agg(F.min(token_count(F.col("text"))).alias("shortest"), F.max(token_count(F.col("text"))).alias("longest"), F.round(F.avg(token_count(F.col("text"))), 6).alias("mean"))),
    "loose_accuracy": on(D, "labels", _loose),
    "accuracy_by_instruction": on(D, "labels", _by_kind),
    "accuracy_and_reward": on(D, _accuracy_reward),
    "loop_reward": on(D, _loop_reward),
    "loop_summary": on(D, _loops),
    "short_chat_eligible": on(C, _short_chats),
    "fanout_with_minimum": on(C, _fanout),
    "image_marker_ensured": on(C, lambda t: chat.gather(t).select("conv_id", F.transform("msgs", lambda m: F.struct(m["role"].alias("role"), F.when((F.col("conv_id") % 2 == 0) & (m["role"] == "user"), F.concat(m["content"], F.lit(" <img>"))).otherwise(m["content"]).alias("content"))).alias("m")).select("conv_id", chat.render(chat.ensure_image_marker(F.col("m"))).alias("txt"))),
    "trajectory_filter": on(D, _replay_candidates),
    "neighbour_groups": on(D, _groups),
    "mix_rows": on(D, _mix_rows),
    "pool_draws": on(D, _pool),
    "batch_ranks": on(D, _ranks),
    "padded_tail": on(D, _pad_tail),
    "shuffled_union": on(D, lambda d: sampling.shuffle_in_buckets(mixing.union_of_one_schema([d.filter("lang = 'en'").select("doc_id", "lang"), d.filter("lang = 'de'").select("doc_id", "lang")]), "doc_id", "union", 8)),
}

_CJK = r"[\x{3400}-\x{9FFF}]"
SQL = {
    "token_floor": f"SELECT doc_id, n FROM (SELECT doc_id, {_N} AS n FROM documents) WHERE n BETWEEN 100 AND 1000",
    "length_gate": f"SELECT doc_id, {_N} <= 512 AS by_tokens, len(text) <= 6000 AS by_chars, len(text) <= 2048 AS as_thought FROM documents",
    "thought_gate": f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND {_N} > 450 THEN 'drop_long_thought' WHEN doc_id % 2 = 1 AND {_N} > 300 THEN 'drop_long_answer' WHEN doc_id % 2 = 1 AND {_h('gate', 'doc_id')} / 4294967296.0 < 0.5 THEN 'drop_sampled' ELSE 'keep' END AS decision FROM documents",
    "instruction_drop": "SELECT doc_id FROM documents WHERE doc_id % 5 <> 0",
    "keyword_classes": f"""WITH x AS (SELECT doc_id, source || ['', '诊断', '目前的情况', '扫码', '如图所示', '<|im_end|>', '求解', 'http://a', '�'][CAST(doc_id % 9 + 1 AS INTEGER)] AS u, text AS a FROM documents), y AS (SELECT *, u || chr(10) || a AS b, list_filter(list_transform(string_split(a, chr(10)), lambda l: {_strip('l')}), lambda l: len(l) >= 12) AS l FROM x)
SELECT doc_id, array_to_string(list_filter([CASE WHEN u = '' OR a = '' THEN 'empty' END, CASE WHEN regexp_matches(b, '<.(im|thought)_(start|end).>') THEN 'protocol_injection' END, CASE WHEN contains(b, chr(65533)) OR contains(b, chr(0)) THEN 'encoding_noise' END,
 CASE WHEN len(regexp_extract_all(b, '{_CJK}')) / greatest(len(regexp_extract_all(b, '[A-Za-z\\x{{3400}}-\\x{{9FFF}}]')), 1) < 0.65 THEN 'not_chinese_dominant' END, CASE WHEN regexp_matches(u, '{MATH}') THEN 'math_like' END, CASE WHEN regexp_matches(b, '{ZH_HIGH_RISK}') THEN 'high_risk' END, CASE WHEN regexp_matches(b, '{ZH_CURRENT}') THEN 'time_sensitive' END,
 CASE WHEN regexp_matches(b, '{ZH_NOISE}') THEN 'ad_or_boilerplate' END, CASE WHEN regexp_matches(b, '{ZH_CONTEXT}') THEN 'missing_context' END, CASE WHEN contains(b, '```') OR contains(lower(b), '<html') OR contains(b, 'http://') OR contains(b, 'https://') THEN 'code_or_link' END, CASE WHEN len(l) <> len(list_distinct(l)) THEN 'repetition' END], lambda r: r IS NOT NULL), ',') AS reasons FROM y""",
    "flag_sums": f"WITH x AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda l: {_strip('l')}), lambda l: len(l) >= 12) AS l FROM documents) SELECT lang, count(*) AS n, count(*) FILTER (contains(text, 'http')) AS links, count(*) FILTER (len(l) <> len(list_distinct(l))) AS dup_lines, count(*) FILTER (regexp_matches(text, '\\p{{Nd}}{{4}}')) AS numbers, count(*) FILTER (len(text) > 4000) AS long FROM x GROUP BY lang",
    "pictograph_clean": "SELECT doc_id, " + _strip(f"replace(regexp_replace(regexp_replace(text || '©a😀b☃c🇩🇪', '[\\x{{200B}}-\\x{{200F}}\\x{{FEFF}}]', '', 'g'), '{text.PICTOGRAPH}', '', 'g'), chr(0), '')") + " AS txt FROM documents",
    "safe_history": "SELECT doc_id, " + _strip("text") + " AS txt FROM documents",
    "template_join": "SELECT doc_id, 'Instruction:' || chr(10) || source || chr(10) || chr(10) || 'Answer:' || chr(10) || text AS txt FROM documents",
    "platform_wrap": "SELECT item_id, '<|im_start|>system' || chr(10) || 'Be brief.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '<|thought_start|>' || chr(10) || '<|thought_end|>' || chr(10) || 'ok<|im_end|>' || chr(10) AS txt FROM benchmark",
    "eval_suffix": "SELECT item_id, text || chr(10) || 'Put your final answer in LaTeX boxed form like $\\boxed{answer}$.' AS prompt FROM benchmark",
    "thought_assembly": "SELECT doc_id, source || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || 'why' ELSE '' END AS thought, CASE WHEN doc_id % 3 = 0 AND " + _strip("text") + " <> '' THEN " + _strip("text") + " ELSE '<SUMMARY> ' || source || ' </SUMMARY>' || CASE WHEN doc_id % 2 = 0 THEN '<REASONING>why</REASONING>' ELSE '' END END AS answer FROM documents",
    "safe_name": "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g') AS name FROM pages",
    "file_cap": "SELECT doc_id, file FROM (SELECT doc_id, doc_id // 64 AS file, sum(octet_length(encode(text)) + 1) OVER (PARTITION BY doc_id // 64 ORDER BY doc_id) AS e FROM documents) WHERE e <= 60000",
    "strata_fill": f"WITH s AS (SELECT doc_id, source, {_h('strata2', 'doc_id')} AS h FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS r FROM s) SELECT doc_id, source, CASE WHEN r <= 2 THEN 0 ELSE 1 END AS later FROM r ORDER BY r > 2, h, doc_id LIMIT 60",
    "holdout_split": "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= least(128, greatest(32, count(*) OVER () // 20)) THEN 'eval' ELSE 'train' END AS split FROM documents",
    "paged_rows": f"WITH p AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 20 AS page FROM documents) SELECT doc_id, page FROM p ORDER BY {_h('pages', 'page')}, page, doc_id LIMIT 130",
    "length_order": f"SELECT doc_id, row_number() OVER (ORDER BY doc_id % 3, {_N}, doc_id) - 1 AS place FROM documents",
    "buffer_shuffle": f"WITH b AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS b FROM documents) SELECT doc_id, b * 100 + row_number() OVER (PARTITION BY b ORDER BY {_h('buf', 'doc_id')}, doc_id) - 1 AS place FROM b",
    "shuffle_take": f"SELECT doc_id FROM documents ORDER BY {_h('take', 'doc_id')}, doc_id LIMIT 77",
    "dedup_xxh3": f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {CLEAN_SQL}",
    "dedup_rendered_chat": f"WITH {_MSGS}, r AS (SELECT conv_id, coalesce(string_agg(line, '' ORDER BY turn) FILTER (role <> 'system'), '') AS x FROM c GROUP BY conv_id) SELECT min(conv_id) AS conv_id FROM r GROUP BY x",
    "component_dedup": "WITH k AS (SELECT doc_id, lang, lower(regexp_replace(" + _strip("string_split(text, chr(10))[1]") + ", '[\\s\\p{Z}]+', ' ', 'g')) AS k, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END AS p FROM documents) SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p, doc_id) AS r FROM k WHERE len(k) > 3) WHERE r = 1",
    "first_response": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE source || '-1' END AS answer FROM documents",
    "mixture_supervised": f"WITH x AS (SELECT source || ':' || lang || ':' || CASE WHEN {_h('mixs', 'doc_id')} % 10 = 0 THEN 'eval' ELSE 'train' END AS key, {_N} AS n FROM documents), g AS (SELECT key, count(*) AS rows, sum(n) AS tokens, sum(greatest(n - 8, 0)) AS supervised FROM x GROUP BY key) SELECT key, rows, CAST(tokens AS BIGINT) AS tokens, CAST(supervised AS BIGINT) AS supervised, round(CASE WHEN key LIKE '%:train' THEN supervised / (SELECT sum(supervised) FROM g WHERE key LIKE '%:train') ELSE 0 END, 9) AS train_share FROM g",
    "token_stats": f"SELECT lang, min({_N}) AS shortest, max({_N}) AS longest, round(avg({_N}), 6) AS mean FROM documents GROUP BY lang",
    "loose_accuracy": "WITH x AS (SELECT (quality = 1)::INT AS a, (toxic = 0)::INT AS b, (doc_id % 2 = 0)::INT AS c, (quality = 1 OR doc_id % 5 = 0)::INT AS d FROM documents JOIN labels USING (doc_id)) SELECT round(avg(a * b * c), 9) AS strict_prompt, round(sum(a + b + c) / (3 * count(*)), 9) AS strict_instruction, round(avg(d * b), 9) AS loose_prompt, round(sum(d + b + 1) / (3 * count(*)), 9) AS loose_instruction FROM x",
    "accuracy_by_instruction": "WITH x AS (SELECT * FROM documents JOIN labels USING (doc_id)) SELECT 'quality' AS kind, round(avg((quality = 1)::INT), 9) AS accuracy, count(*) AS n FROM x UNION ALL SELECT 'clean', round(avg((toxic = 0)::INT), 9), count(*) FROM x UNION ALL SELECT 'even', round(avg((doc_id % 2 = 0)::INT), 9), count(*) FROM x",
    "accuracy_and_reward": "WITH l AS (SELECT doc_id % 5 AS k, doc_id % 4 = doc_id // 3 % 4 AS same FROM documents), r AS (SELECT k < 3 AND same AS ok, k = 0 AS boxed FROM l) SELECT round(avg(ok::INT), 9) AS accuracy, round(avg(CASE WHEN ok AND boxed THEN 1.0 WHEN ok THEN 0.2 ELSE -1.0 END), 9) AS mean_reward FROM r",
    "loop_reward": "SELECT doc_id, round(CASE WHEN doc_id % 3 = 0 THEN -0.5 WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE, 9) AS reward FROM documents",
    "loop_summary": f"WITH l AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '[。！？!?；;\\n]+'), lambda x: {_strip('x')}), lambda x: len(x) >= 6)) AS u FROM documents), c AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, u, count(*) AS n FROM l GROUP BY 1, 2) WHERE n >= 3) SELECT round(avg(doc_id % 2), 9) AS accuracy, round(avg((doc_id IN (SELECT doc_id FROM c))::INT), 9) AS loop_rate, round(avg({_N}), 6) AS mean_tokens FROM documents",
    "fanout_with_minimum": f"WITH {_MSGS}, r AS (SELECT conv_id, role, row_number() OVER w AS i, sum(k) OVER w AS s FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), x(ctx, least) AS (VALUES (200, 0), (400, 150), (800, 300)) SELECT conv_id, ctx, max(i) AS n_turns, CAST(max(s) AS BIGINT) AS n FROM r, x WHERE role = 'assistant' AND s <= ctx GROUP BY conv_id, ctx, least HAVING max(s) >= least",
    "image_marker_ensured": "WITH x AS (SELECT conv_id, turn, role, coalesce(text, '') || CASE WHEN conv_id % 2 = 0 AND role = 'user' THEN ' <img>' ELSE '' END AS t FROM conversations), y AS (SELECT *, min(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS u, bool_or(role = 'user' AND contains(t, '<img>')) OVER (PARTITION BY conv_id) AS has FROM x) SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || CASE WHEN NOT has AND turn = u THEN " + _strip("'<img>' || chr(10) || t") + " ELSE t END || '<|im_end|>' || chr(10), '' ORDER BY turn) AS txt FROM y GROUP BY conv_id",
    "trajectory_filter": f"WITH {_CANDIDATES}, {_REWARD} SELECT prompt, CAST(cand AS BIGINT) AS cand FROM r WHERE cand <= 2 AND reward >= 1.1 AND correct AND boxed AND h >= 3 AND {_N} BETWEEN 180 AND 350",
    "batch_ranks": f"""WITH RECURSIVE x AS (SELECT doc_id, doc_id // 256 AS shard, {_N} AS n, row_number() OVER (PARTITION BY doc_id // 256 ORDER BY {_N}, doc_id) AS r FROM documents),
f AS (SELECT doc_id, shard, r, 0 AS batch, 1 AS k, n AS longest FROM x WHERE r = 1
UNION ALL SELECT x.doc_id, x.shard, x.r, CASE WHEN (f.k + 1) * greatest(f.longest, x.n) > 8192 THEN f.batch + 1 ELSE f.batch END, CASE WHEN (f.k + 1) * greatest(f.longest, x.n) > 8192 THEN 1 ELSE f.k + 1 END,
  CASE WHEN (f.k + 1) * greatest(f.longest, x.n) > 8192 THEN x.n ELSE greatest(f.longest, x.n) END FROM f JOIN x ON x.shard = f.shard AND x.r = f.r + 1)
SELECT doc_id, CAST(batch % 4 AS BIGINT) AS rank FROM f""",
    "neighbour_groups": "WITH x AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS run FROM documents) SELECT lang, min(doc_id) AS first, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM x GROUP BY lang, run",
    "mix_rows": "WITH n AS (SELECT CAST(round_even(count(*) * 0.2 / 0.8, 0) AS BIGINT) AS t FROM documents WHERE lang = 'en'), m AS (SELECT CAST(round_even(t * 2 / 3.0::DOUBLE, 0) AS BIGINT) AS de, t - CAST(round_even(t * 2 / 3.0::DOUBLE, 0) AS BIGINT) AS fr FROM n), x AS (SELECT lang AS part, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE lang IN ('de', 'fr')) SELECT part, doc_id, CAST(r AS BIGINT) AS round FROM x, m, (SELECT unnest([0, 1, 2]) AS r) WHERE r * n + i < CASE part WHEN 'de' THEN de ELSE fr END",
    "pool_draws": "WITH u AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS u FROM documents), p AS (SELECT lang AS pool, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE lang IN ('de', 'fr')), w AS (SELECT u, 'de' AS pool, u // 2 * 3 + (u % 2) * 2 + k AS c FROM u, (SELECT unnest([0, 1]) AS k) WHERE k < 2 - u % 2 UNION ALL SELECT u, 'fr', u // 2 * 3 + u % 2 + k FROM u, (SELECT unnest([0, 1]) AS k) WHERE k < 1 + u % 2) SELECT u, pool, c AS cursor, doc_id FROM w JOIN p USING (pool) WHERE i = c % n",
    "padded_tail": "WITH x AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents WHERE lang = 'de') SELECT doc_id, i AS place FROM x UNION ALL SELECT doc_id, n + i FROM x WHERE i < (10 - n % 10) % 10",
    "shuffled_union": "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de')",
}
