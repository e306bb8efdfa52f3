"""Answer parsing, rewards and group statistics on deterministic candidates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weft.functions import answers, degeneration, rewards
from weft.functions.hashing import hash32
from weft.functions.text import strip
from weft.functions.tokens import token_count
from weft.operators import dedup
from weft.plans.clean import _h
from weft.plans.common import on


def candidates(d):
    """prompt, cand, truth, text: four candidate answers for each document, a few of them right."""
    x = d.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("cand"), F.col("text").alias("body"))
    h = F.pmod(hash32("cand", F.concat_ws("-", "doc_id", "cand")), F.lit(5))
    truth = (F.col("doc_id") % 7).cast("string")
    thought = F.when(h >= 3, F.concat(F.lit("<|thought_start|>\n"), "body", F.lit("\n<|thought_end|>\n"))).otherwise("")
    answer = F.when(h % 2 == 0, F.concat(F.lit("\\boxed{"), truth, F.lit("}"))).when(h == 1, F.concat(F.lit("so it is "), truth)).otherwise("1,234.5 apples")
    return x.select(F.col("doc_id").alias("prompt"), "cand", F.concat(F.lit("#### "), truth).alias("truth"), F.concat(thought, F.lit("Answer follows: "), answer).alias("text"))


_CANDIDATES = f"""x AS (SELECT doc_id, unnest([0, 1, 2, 3]) AS cand, text AS body FROM documents),
y AS (SELECT *, CAST(concat('0x', substr(md5(concat('cand:', doc_id, '-', cand)), 1, 8)) AS BIGINT) % 5 AS h, doc_id % 7 AS truth FROM x),
c AS (SELECT doc_id AS prompt, cand, h, truth, CASE WHEN h >= 3 THEN '<|thought_start|>' || chr(10) || body || chr(10) || '<|thought_end|>' || chr(10) ELSE '' END || 'Answer follows: ' ||
  CASE WHEN h % 2 = 0 THEN '\\boxed{{' || truth || '}}' WHEN h = 1 THEN 'so it is ' || truth ELSE '1,234.5 apples' END AS text,
  CASE WHEN h >= 3 THEN len(regexp_extract_all(body, '\\p{{L}}+|\\p{{N}}|[^\\s\\p{{L}}\\p{{N}}]')) ELSE 0 END AS n FROM y)"""
_CANDIDATES = _CANDIDATES.replace("{{", "{").replace("}}", "}").replace("\\\\", "\\")
_SCORE = "CASE WHEN n <= 50 THEN 0.0 WHEN n > 400 THEN -1.0 WHEN n >= 256 THEN 1.0 ELSE (n - 50) / 206.0 END"
_REWARD = f"r AS (SELECT *, h % 2 = 0 AS boxed, h % 2 = 0 OR h = 1 AS correct, CASE WHEN h % 2 = 0 THEN 1.0 + CASE WHEN h >= 3 THEN 0.3 ELSE 0 END + 0.2 * ({_SCORE}) WHEN h = 1 THEN 0.3 ELSE 0.0 END::DOUBLE AS reward FROM c)"


def scored(d):
    c = candidates(d).withColumn("p", answers.parse_prediction(F.col("text"))).withColumn("t", answers.truth_number(F.col("truth")))
    right = F.coalesce(F.abs(F.col("p.final_answer") - F.col("t")) < 1e-6, F.lit(False))
    return c.withColumn("correct", right).withColumn("reward", rewards.number_reward(F.lit(False), right, F.col("p.from_box"), F.col("p.has_cot_tags"), F.col("p.cot_tokens")))


_LETTERS = """l AS (SELECT doc_id, chr(65 + CAST(doc_id % 4 AS INTEGER)) AS want, chr(65 + CAST(doc_id // 3 % 4 AS INTEGER)) AS got, doc_id % 5 AS k FROM documents)"""


def letters(d):
    want, got = F.char(65 + F.col("doc_id") % 4), F.char(65 + F.floor(F.col("doc_id") / 3) % 4)
    k = F.col("doc_id") % 5
    said = F.when(k == 0, F.concat(F.lit("\\boxed{ "), F.lower(got), F.lit(" }"))).when(k == 1, F.concat(F.lit("Answer: "), got, F.lit(" because"))).when(k == 2, F.concat(F.lit("I choose "), got, F.lit(" ."))).when(k == 3, "A letter then more words").otherwise("\\boxed{AB}")
    return d.select("doc_id", want.alias("want"), said.alias("said")).withColumn("p", answers.parse_letter(F.col("said")))


def _letter_reward(d):
    right = F.coalesce(F.col("p.final_answer") == answers.truth_letter(F.col("want")), F.lit(False))
    n = (F.col("doc_id") * 7) % 450
    return letters(d).select("doc_id", F.round(rewards.letter_reward((F.col("doc_id") * 3) % 400, right, F.col("p.boxed").isNotNull(), F.col("doc_id") % 2 == 0, n), 9).alias("reward"))


def _group(d):
    return scored(d).select("prompt", "cand", F.round(rewards.advantage(F.col("reward"), "prompt"), 6).alias("adv"), F.round(rewards.clipped_advantage(F.col("reward"), "prompt"), 6).alias("clipped"))


def _gate(d):
    w = Window.partitionBy("prompt")
    return scored(d).select("prompt", "cand", F.round(F.max("reward").over(w) - F.min("reward").over(w), 9).alias("span"), F.bool_or(F.col("correct")).over(w).alias("any_right"))


def _temper(d):
    t = F.col("cand") * 0.25 + 0.2
    return scored(d).select("prompt", "cand", rewards.temperature_weight(F.col("correct"), t, "prompt").alias("weight"))


def _replay(d):
    good = scored(d).filter(F.col("correct") & (F.col("reward") >= 1.1))
    return dedup.priority_pick(good, "prompt", F.struct("cand", -F.col("reward"))).select("prompt", "cand")


def _marker(d):
    body = F.concat("text", F.when(F.col("doc_id") % 4 == 0, "\nTherefore, it is 4").when(F.col("doc_id") % 4 == 1, " so, it is\n\n\n4").when(F.col("doc_id") % 4 == 2, "\nThe answer is: five\nok").otherwise(""))
    return d.select("doc_id", answers.split_by_marker(body).alias("s")).select("doc_id", "s.status", "s.thought", "s.answer")


def _summary(d):
    s = scored(d)
    return s.agg(F.round(F.avg(F.col("correct").cast("int")), 9).alias("accuracy"), F.round(F.avg("reward"), 9).alias("mean_reward"), F.round(F.avg(F.col("p.from_box").cast("int")), 9).alias("box_rate"), F.round(F.avg("p.cot_tokens"), 6).alias("mean_tokens"), F.count("*").alias("n"))


def _instructions(d, l):
    """Strict accuracy by prompt, by instruction and by kind."""
    x = d.join(l, "doc_id").select("doc_id", F.array("quality", "toxic", (F.col("doc_id") % 2).cast("int")).alias("ok"))
    return x.agg(F.round(F.avg(F.forall("ok", lambda v: v == 1).cast("int")), 9).alias("by_prompt"), F.round(F.sum(F.aggregate("ok", F.lit(0), lambda a, v: a + v)) / F.sum(F.size("ok")), 9).alias("by_instruction"))


def _first_valid(d):
    """The first attempt that passes its checks is accepted."""
    tries = candidates(d).withColumn("ok", rewards.accepted(F.col("text").contains("\\boxed"), F.col("text"), token_count(F.col("text")), 40, degeneration.exact_loop(F.col("text"))))
    return tries.groupBy("prompt").agg(F.min(F.when(F.col("ok"), F.col("cand"))).alias("accepted"), F.count_if("ok").alias("n_ok"))


QUERIES = {
    "candidates": on("documents", lambda d: candidates(d)),
    "extract_number": on("documents", lambda d: candidates(d).select("prompt", "cand", answers.truth_number(F.col("truth")).alias("truth"), answers.parse_prediction(F.col("text"))["final_answer"].alias("pred"))),
    "parse_prediction": on("documents", lambda d: candidates(d).select("prompt", "cand", answers.parse_prediction(F.col("text")).alias("p")).select("prompt", "cand", "p.*")),
    "choice_letter": on("documents", lambda d: letters(d).select("doc_id", "p.boxed", "p.fallback", "p.final_answer")),
    "gsm_reward": on("documents", lambda d: scored(d).select("prompt", "cand", "correct", F.round("reward", 9).alias("reward"))),
    "arc_reward": on("documents", _letter_reward),
    "group_advantage": on("documents", _group),
    "signal_gate": on("documents", _gate),
    "temp_downweight": on("documents", _temper),
    "replay_best": on("documents", _replay),
    "marker_split": on("documents", _marker),
    "norm_math": on("documents", lambda d: d.select("doc_id", answers.norm_math(F.concat(F.lit(r"$\boxed{\frac 1} \left( x+"), "text", F.lit(r"\right) \text{ok}$"))).alias("norm"))),
    "expected_in_solution": on("documents", lambda d: d.select("doc_id", answers.contains_expected(F.col("text"), F.array(F.lit("the"), F.lit(" "), F.lit("D E R"))).alias("hit"))),
    "choice_prompt": on("benchmark", lambda b: b.select("item_id", answers.choice_prompt(F.col("text"), F.array(F.lit("B"), F.lit("A")), F.array(F.lit("two"), F.lit("one")), "Answer with a letter.").alias("prompt"))),
    "box_complete": on("documents", lambda d: d.select("doc_id", answers.box_is_complete(F.concat("text", F.lit(r" \boxed{\frac{1}{2}"), F.when(F.col("doc_id") % 2 == 0, "}").otherwise(""))).alias("complete"))),
    "length_scores": on("documents", lambda d: d.select("doc_id", F.round(rewards.thought_length_score(F.col("doc_id") % 500), 9).alias("a"), F.round(rewards.thought_bonus(F.col("doc_id") % 500), 9).alias("b"), rewards.total_length_score(F.col("doc_id") % 300).alias("c"))),
    "difficulty_weight": on("documents", lambda d: d.select("doc_id", F.round(rewards.difficulty_weight((F.col("doc_id") % 11) / 10.0), 9).alias("w"), F.round(rewards.kl_estimate((F.col("doc_id") % 9) / 10.0 - 0.4), 9).alias("kl"), F.round(rewards.objective_scale(F.lit(0.65), F.col("doc_id") % 5, F.lit(0.2)), 9).alias("scale"))),
    "accuracy_by_type": on("documents", lambda d: scored(d).groupBy((F.col("prompt") % 5).alias("kind")).agg(F.round(F.avg(F.col("correct").cast("int")), 9).alias("accuracy"), F.count("*").alias("n"))),
    "eval_summary": on("documents", _summary),
    "instruction_accuracy": on("documents", "labels", _instructions),
    "first_valid_attempt": on("documents", _first_valid),
}
_TAIL = r"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_MATH_TEXT = r"'$\boxed{{\frac 1}} \left( x+' || text || '\right) \text{{ok}}$'".replace("{{", "{").replace("}}", "}")
_NORM = r"lower(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace({x}, '\\boxed\s*\{{([^{{}}]*)\}}', '\1', 'g'), '\\(left|right)[()\[\]{{}}|]', '', 'g'), '$', ''), '\\[a-zA-Z]+(\s*\{{[^{{}}]*\}})?', '', 'g'), '[^0-9A-Za-z\x{{4E00}}-\x{{9FFF}}]+', '', 'g'))"


def _bonus(n: str) -> str:
    return f"CASE WHEN {n} <= 0 THEN -0.5 WHEN {n} <= 60 THEN -0.5 + 0.5 * ({n} / 60.0) WHEN {n} <= 250 THEN 0.5 * (({n} - 60) / 190.0) WHEN {n} <= 380 THEN 0.5 - ({n} - 250) / 130.0 ELSE -0.5 END"


SQL = {
    "candidates": f"WITH {_CANDIDATES} SELECT prompt, cand, '#### ' || truth AS truth, text FROM c",
    "extract_number": f"WITH {_CANDIDATES} SELECT prompt, cand, truth::DOUBLE AS truth, CASE WHEN h % 2 = 0 OR h = 1 THEN truth ELSE 1234.5 END::DOUBLE AS pred FROM c",
    "parse_prediction": f"""WITH {_CANDIDATES}, s AS (SELECT prompt, cand, {{STRIP_TEXT}} AS raw FROM c), p AS (SELECT *, try_cast(nullif(regexp_extract(raw, '{{BOX}}', 1), '') AS DOUBLE) AS boxed_value, try_cast(list_extract(regexp_extract_all(replace(raw, ',', ''), '-?[0-9]+\\.?[0-9]*'), -1) AS DOUBLE) AS fallback_value,
  instr(raw, '<|thought_start|>') AS a, instr(raw, '<|thought_end|>') AS b FROM s), q AS (SELECT *, CASE WHEN a > 0 AND b > a THEN {{STRIP_COT}} END AS cot_text FROM p)
SELECT prompt, cand, raw, regexp_matches(raw, '{{BOX}}') AS has_box, boxed_value, fallback_value, coalesce(boxed_value, fallback_value) AS final_answer, boxed_value IS NOT NULL AS from_box, boxed_value IS NOT NULL AS has_box_and_valid, a > 0 AND b > a AS has_cot_tags, cot_text,
  CASE WHEN cot_text IS NULL THEN 0 ELSE len(regexp_extract_all(cot_text, '\\p{{{{L}}}}+|\\p{{{{N}}}}|[^\\s\\p{{{{L}}}}\\p{{{{N}}}}]')) END AS cot_tokens FROM q""".replace("{{", "{").replace("}}", "}").replace("{STRIP_TEXT}", _TAIL.replace("{{", "{").replace("}}", "}").replace("{x}", "text")).replace("{STRIP_COT}", _TAIL.replace("{{", "{").replace("}}", "}").replace("{x}", "substr(raw, a + 17, b - a - 17)")).replace("{BOX}", r"\\boxed\s*\{\s*(-?[0-9]+(?:\.[0-9]+)?)\s*\}"),
    "choice_letter": f"WITH {_LETTERS} SELECT doc_id, CASE WHEN k = 0 THEN got END AS boxed, CASE WHEN k IN (0, 1, 2) THEN got END AS fallback, CASE WHEN k < 3 THEN got END AS final_answer FROM l",
    "gsm_reward": f"WITH {_CANDIDATES}, {_REWARD} SELECT prompt, cand, correct, round(reward, 9) AS reward FROM r",
    "arc_reward": f"WITH {_LETTERS}, s AS (SELECT *, (doc_id * 3) % 400 AS total, (doc_id * 7) % 450 AS n, k < 3 AND got = want AS ok FROM l) SELECT doc_id, round(CASE WHEN total >= 340 THEN -1.0 WHEN ok AND k = 0 THEN 1.0 + CASE WHEN doc_id % 2 = 0 THEN greatest(-0.5, least(1.0, 1.2 * ({_bonus('n')}))) ELSE 0 END WHEN ok THEN 0.2 ELSE -1.0 END::DOUBLE, 9) AS reward FROM s",
    "group_advantage": f"WITH {_CANDIDATES}, {_REWARD} SELECT prompt, cand, round(CASE WHEN s IS NULL OR s < 1e-6 THEN reward - m ELSE (reward - m) / (s + 1e-6) END, 6) AS adv, round(greatest(-5, least(5, (reward - m) / greatest(p, 1e-6))), 6) AS clipped FROM (SELECT *, avg(reward) OVER w AS m, stddev_samp(reward) OVER w AS s, stddev_pop(reward) OVER w AS p FROM r WINDOW w AS (PARTITION BY prompt))",
    "signal_gate": f"WITH {_CANDIDATES}, {_REWARD} SELECT prompt, cand, round(max(reward) OVER w - min(reward) OVER w, 9) AS span, bool_or(correct) OVER w AS any_right FROM r WINDOW w AS (PARTITION BY prompt)",
    "temp_downweight": f"WITH {_CANDIDATES}, {_REWARD} SELECT prompt, cand, CASE WHEN NOT cold OR NOT correct THEN 1.0 WHEN cand = 3 THEN 0.3 WHEN cand = 2 THEN 0.6 ELSE 1.0 END AS weight FROM (SELECT *, bool_or(correct AND cand <= 1) OVER (PARTITION BY prompt) AS cold FROM r)",
    "replay_best": f"WITH {_CANDIDATES}, {_REWARD} SELECT prompt, min(cand) AS cand FROM r WHERE correct AND reward >= 1.1 GROUP BY prompt",
    "norm_math": f"SELECT doc_id, {_NORM.format(x=_MATH_TEXT)} AS norm FROM documents",
    "expected_in_solution": f"SELECT doc_id, contains({_NORM.format(x='text')}, 'the') OR contains({_NORM.format(x='text')}, 'der') AS hit FROM documents",
    "choice_prompt": "SELECT item_id, text || chr(10) || 'A. one' || chr(10) || 'B. two' || chr(10) || 'Answer with a letter.' AS prompt FROM benchmark",
    "box_complete": "SELECT doc_id, doc_id % 2 = 0 AND len(text) - len(replace(text, '$', '')) - (len(text) - len(replace(text, '\\$', ''))) // 2 - ((len(text) - len(replace(text, '$', '')) - (len(text) - len(replace(text, '\\$', ''))) // 2) // 2) * 2 = 0 AS complete FROM documents",
    "length_scores": f"WITH d AS (SELECT doc_id, doc_id % 500 AS n, doc_id % 300 AS t FROM documents) SELECT doc_id, round(({_SCORE})::DOUBLE, 9) AS a, round(({_bonus('n')})::DOUBLE, 9) AS b, CASE WHEN t = 0 THEN 0.0 WHEN t <= 40 THEN -0.2 WHEN t <= 120 THEN 0.5 WHEN t <= 200 THEN -0.3 ELSE -1.0 END::DOUBLE AS c FROM d",
    "difficulty_weight": "SELECT doc_id, round(1 / (1 + exp(6 * ((doc_id % 11) / 10.0 - 0.5)))::DOUBLE, 9) AS w, round((exp((doc_id % 9) / 10.0::DOUBLE - 0.4) - 1 - ((doc_id % 9) / 10.0::DOUBLE - 0.4))::DOUBLE, 9) AS kl, round(greatest(0.1, least(10.0, 0.65 / greatest((doc_id % 5) * 0.2, 1e-8)))::DOUBLE, 9) AS scale FROM documents",
    "accuracy_by_type": f"WITH {_CANDIDATES}, {_REWARD} SELECT prompt % 5 AS kind, round(avg(correct::INT), 9) AS accuracy, count(*) AS n FROM r GROUP BY 1",
    "eval_summary": f"WITH {_CANDIDATES}, {_REWARD} SELECT round(avg(correct::INT), 9) AS accuracy, round(avg(reward), 9) AS mean_reward, round(avg(boxed::INT), 9) AS box_rate, round(avg(n), 6) AS mean_tokens, count(*) AS n FROM r",
    "instruction_accuracy": "SELECT round(avg((quality = 1 AND toxic = 1 AND doc_id % 2 = 1)::INT), 9) AS by_prompt, round(sum(quality + toxic + doc_id % 2) / (3 * count(*)), 9) AS by_instruction FROM documents JOIN labels USING (doc_id)",
    "first_valid_attempt": f"WITH {_CANDIDATES}, t AS (SELECT *, contains(text, '\\boxed') AND len(regexp_extract_all(text, '\\p{{L}}+|\\p{{N}}|[^\\s\\p{{L}}\\p{{N}}]')) < 40 AS ok FROM c) SELECT prompt, min(cand) FILTER (ok) AS accepted, count(*) FILTER (ok) AS n_ok FROM t GROUP BY prompt",
}
