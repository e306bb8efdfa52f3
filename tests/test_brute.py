"""Queries that SQL can't say, against plain Python versions on the smallest tables."""

import hashlib
import itertools
import json
import os
import re

import pyarrow.parquet as pq
import pytest
import regex
import xxhash

from weft.functions import degeneration as deg
from weft.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
SPACE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def rows(spark, name):
    return [r.asDict(recursive=True) for r in registry.queries()[name](spark, SF).collect()]


def chats():
    found = {}
    for r in sorted(table("conversations"), key=lambda r: (r["conv_id"], r["turn"])):
        found.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    return found


def render(msgs):
    return "".join(f"<|im_start|>{r}\n{c}<|im_end|>\n" for r, c in msgs)


def marked(msgs):
    at = next((i for i, (r, _) in enumerate(msgs) if r == "user"), None)
    return [(r, ("<img>\n" if i == at else "") + c.replace("<img>", "")) for i, (r, c) in enumerate(msgs)]


def damaged():
    out = {}
    for i, msgs in chats().items():
        x = render(marked(msgs))
        out[i] = {1: x[:-11], 2: "stray " + x, 3: x + "<|tool|>", 4: x.replace("<img>", "<image>"), 5: x.replace("<|im_start|>assistant\n", "<|im_start|>assistant "), 6: x + "�"}.get(i % 11, x)
    return out


def stream(x):
    return regex.findall(r"<\|[^<>\r\n|]+\|>|<img>|\n|\p{L}+|\p{N}|[^\s\p{L}\p{N}]", x)


def spans(toks):
    """(role, start, content, end, closed, stray), walking from mark to mark."""
    out, at = [], 0
    while at <= len(toks):
        end = next((j for j in range(at, len(toks)) if toks[j] == "<|im_end|>"), None)
        stop = len(toks) if end is None else end
        start = next((j for j in range(at, stop) if toks[j] == "<|im_start|>"), None)
        gap = toks[at : stop if start is None else start]
        stray = any(t != "\n" for t in gap) or (start is None and end is not None)
        if start is None:
            role, content = None, stop
        else:
            line = next((j for j in range(start, stop) if toks[j] == "\n"), None)
            role = "".join(toks[start + 1 : stop if line is None else line]).strip()
            content = stop if line is None else line + 1
        if end is not None or stray or start is not None:
            out.append((role, -1 if start is None else start, content, stop, end is not None, stray))
        if end is None:
            return out
        at = end + 1
    return out


def mask(toks):
    m = [0] * len(toks)
    for role, _, content, end, closed, _ in spans(toks):
        if role == "assistant" and closed:
            m[content : end + 1] = [1] * (end + 1 - content)
    return m


def test_stream_spans_and_masks(spark):
    toks = {i: stream(x) for i, x in damaged().items()}
    got = sorted((r["conv_id"], r["place"], r["role"], r["start"], r["content"], r["end"], r["closed"], r["stray"]) for r in rows(spark, "stream_role_spans"))
    assert [tuple(map(str, g)) for g in got] == [tuple(map(str, x)) for x in sorted((i, k, *s) for i, t in toks.items() for k, s in enumerate(spans(t)))]
    assert {r["conv_id"]: r["mask"] for r in rows(spark, "stream_target_mask")} == {i: "".join(map(str, mask(t))) for i, t in toks.items()}
    strict = {r["conv_id"]: (r["reason"], r["digest"]) for r in rows(spark, "strict_target_mask")}
    for i, t in toks.items():
        answers = [s for s in spans(t) if s[0] == "assistant"]
        reason = "too_long_or_empty" if not 0 < len(t) <= 1500 else "missing_assistant_end" if any(not s[4] for s in answers) else "assistant_too_short" if not answers or sum(s[3] - s[2] for s in answers) < 4 else None
        assert strict[i] == (reason, None if reason else hashlib.md5("".join(map(str, mask(t))).encode()).hexdigest())
    assert {r["conv_id"]: r["input_len"] for r in rows(spark, "pack_filter")} == {i: len(t) for i, t in toks.items() if any(mask(t)) and len(t) <= 600}


def test_audit_of_packed_rows(spark):
    source = re.compile(r"</?image>|<image[_-]?\d*>|\[image(?:[_ -]?\d+)?\]|<\/?img[_-]?\d+>|<img[_-]?\d+>|IMAGE_TOKEN|DEFAULT_IMAGE_TOKEN", re.I)
    got = {r["conv_id"]: set(filter(None, r["errors"].split(","))) for r in rows(spark, "packed_row_audit")}
    hash32 = lambda seed, key: int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    for i, x in damaged().items():
        toks, want = stream(x), set()
        good = mask(toks)
        m = [1] * len(toks) if i % 11 == 7 else good[1:] if i % 11 == 8 else good
        all_ = spans(toks)
        closed = [s for s in all_ if s[4] and s[1] >= 0]
        talk = [s[0] for s in closed if s[0] != "system"]
        answers = [s for s in closed if s[0] == "assistant"]
        said = "\n".join(" ".join(toks[s[2] : s[3]]) for s in answers)
        views = [f"{i}-{k}.jpg" for k in range(1, 5 if i % 13 == 1 else 6)]
        meta = "{broken" if i % 13 == 2 else '{"views": [1]}' if i % 13 == 3 else '{"views": [1, 2, 3, 4, 5]}'
        try:
            n_views = len(json.loads(meta)["views"])
        except ValueError:
            n_views = None
        tests = {
            "text_outside_chatml": any(s[5] for s in all_), "missing_end_mark": any(not s[4] and s[1] >= 0 for s in all_), "mask_length": len(m) != len(toks), "image_mark_count": x.count("<img>") != 1,
            "first_role": not closed or closed[0][0] != "user", "unknown_role": any(s[0] not in ("user", "assistant", "system") for s in closed), "non_alternating": any(a == b for a, b in itertools.pairwise(talk)),
            "control_tag": bool(set(re.findall(r"<\|[^<>\r\n]+\|>", x)) - {"<|im_start|>", "<|im_end|>"}), "source_image_mark": bool(source.search(x)), "replacement_character": "�" in x,
            "assistant_header": any(toks[s[1] + 2 : s[1] + 3] != ["\n"] for s in answers), "mask_on_header": any(any(m[s[1] + 1 : s[2]]) for s in answers), "mask_outside_assistant": any(v and not good[k] for k, v in enumerate(m)),
            "empty_mask": not any(m), "image_count": len(views) != 5, "missing_images": any(hash32("file", v) % 50 == 0 for v in views), "view_count": n_views not in (None, 5), "invalid_meta": n_views is None,
            "image_mark_in_answer": "<img>" in said or bool(source.search(said)),
        }
        want = {k for k, v in tests.items() if v}
        assert got[i] == want, (i, got[i] ^ want)
    assert len(set().union(*got.values())) >= 13


ROLES = {"human": "user", "user": "user", "question": "user", "instruction": "user", "gpt": "assistant", "assistant": "assistant", "answer": "assistant", "response": "assistant"}


def test_reject_reasons(spark):
    from weft.functions import text

    def clean(x):
        for p in (text.CHAT_TAG, text.IMAGE_TAG, text.HTML_TAG, text.PSEUDO_TAG):
            x = re.sub(p.replace(r"\x{4E00}-\x{9FFF}", "一-鿿"), " ", x)
        return "\n".join(y for y in (" ".join(line.split()) for line in x.replace("\0", " ").splitlines()) if y)

    got = {r["conv_id"]: (r["reason"], r["txt"]) for r in rows(spark, "normalize_reason")}
    for i, msgs in chats().items():
        reason, out = None, []
        for role, content in msgs:
            role, content = ROLES.get(role.strip().lower()), clean(content)
            if role is None or (not content and role != "user"):
                reason = "unknown_role" if role is None else "empty_assistant"
                break
            out.append((role, content or "Please answer."))
        if reason is None:
            if len(out) < 2:
                reason = "too_few_turns"
            elif out[0][0] != "user" or out[-1][0] != "assistant":
                reason = "bad_end_roles"
            elif any(a[0] == b[0] for a, b in itertools.pairwise(out)):
                reason = "non_alternating"
            elif any(re.search(r"(.{12,80})(?:\1){3,}", c, re.S) for r, c in out if r == "assistant"):
                reason = "loop"
        assert got[i] == (reason, None if reason else render([(out[0][0], "<img>\n" + out[0][1]), *out[1:]])), i


MARKERS = ("the final answer is", "the answer is", "therefore,", "in conclusion,", "conclusion,", "in summary,", "thus,", "so,")


def test_marker_split(spark):
    got = {r["doc_id"]: (r["status"], r["thought"], r["answer"]) for r in rows(spark, "marker_split")}
    for d in table("documents"):
        i = d["doc_id"]
        x = (d["text"] + {0: "\nTherefore, it is 4", 1: " so, it is\n\n\n4", 2: "\nThe answer is: five\nok", 3: ""}[i % 4]).replace("\r\n", "\n").strip(SPACE)
        low = x.lower()
        at, order, mark = max((low.rfind(m), -k, m) for k, m in enumerate(MARKERS))
        if not x:
            want = ("empty", None, None)
        elif at < 0:
            want = ("no_marker", None, x)
        else:
            tail, line = x[at + len(mark) :], x.rfind("\n", 0, at)
            thought = x[: line if line >= 0 else 0].strip(SPACE)
            if tail.count("\n") >= 2:
                want = ("marker_invalid_many_newlines", None, x)
            elif len(regex.findall(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]", tail)) > 15:
                want = ("marker_tail_too_long", None, x)
            elif not thought:
                want = ("marker_but_no_prefix", None, x)
            else:
                want = ("marker_ok", thought, x[line + 1 :].strip(SPACE))
        assert got[i] == want, i


def test_loops(spark):
    exact, spaced = ({r["doc_id"]: r["loop"] for r in rows(spark, q)} for q in ("loop_backref", "spaced_repeat"))
    flag = {r["doc_id"]: r["loop"] for r in rows(spark, "loop_flag")}
    for d in table("documents"):
        t, i = d["text"], d["doc_id"]
        # A unit of n characters three times in a row is 2n characters that equal those n on.
        run = lambda n, t: max((len(list(g)) for k, g in itertools.groupby(a == b for a, b in zip(t, t[n:], strict=False)) if k), default=0)
        assert exact[i] == any(run(n, t) >= 2 * n for n in range(16, 161)), i
        lines = [x for x in (y.strip(SPACE) for y in t.split("\n")) if len(x) >= 12]
        assert spaced[i] == (bool(re.search(r"(.{20,140}?)(?:\s*\1){2,}", re.sub(r"\s+", " ", t), re.S)) or len(lines) != len(set(lines))), i
        parts = [p for p in (q.strip(SPACE) for q in re.split("[。！？!?；;\n]+", t)) if len(p) >= 6]
        assert flag[i] == (any(parts.count(p) >= 3 for p in set(parts)) or run(12, t) >= 24), i


def test_tails_of_generated_text(spark):
    docs = {d["doc_id"]: d["text"] for d in table("documents")}
    prose, near, period, stutters = ({r["doc_id"]: list(r.values())[1] for r in rows(spark, q)} for q in ("prose_loop", "near_clauses", "token_cycle", "stutter"))
    import difflib

    for i, t in docs.items():
        found = next((len(t) - len(t[-1800:]) + m.end(1) for m in re.finditer(r"(.{16,180}?)\1{2,}", t[-1800:], re.S) if len(re.findall("[a-zA-Z一-鿿]", m[1])) >= 8 and len(set(re.findall("[a-zA-Z一-鿿]", m[1]))) >= 3), None)
        assert prose[i] == found or (prose[i] != prose[i] and found is None), i
        parts = [p.strip() for p in re.split(r"[.!?。！？；;\n]+", t) if p.strip()][-3:]
        assert near[i] == (len(parts) == 3 and all(difflib.SequenceMatcher(None, a, b).ratio() >= 0.93 for a, b in itertools.pairwise(parts)))
        toks = regex.findall(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]", t)
        letters = lambda p: re.findall("[a-zA-Z一-鿿]", "".join(toks[-p:]))  # noqa: E731,B023
        want = next((p for p in range(8, 97) if len(toks) >= 3 * p and toks[-p:] == toks[-2 * p : -p] == toks[-3 * p : -2 * p] and len(letters(p)) >= 8 and len(set(letters(p))) >= 3), 0)
        assert period[i] == want, i
        assert stutters[i] is None or stutters[i] != stutters[i] or 0 < stutters[i] <= len(t)


def test_stutter_by_hand():
    same = "".join(f"The river runs {w} today. " for w in ("slow", "wide", "slow", "deep", "slow", "wide", "slow", "deep", "slow", "wide"))
    assert deg.stutter(same) == len("The river runs slow today. The river runs wide today. The river runs slow today.")
    assert deg.stutter("A quick start. " + "Birds sing loud. Cats sleep long. Dogs run far. Cows eat grass. Fish swim deep. Mice hide well. Bees make honey. Ants carry seeds.") is None
    assert deg.stutter("<p>river water runs</p>" * 9) == len("<p>river water runs</p>" * 3) and deg.stutter("") is None


def test_symbols_are_no_cycle():
    assert deg.token_cycle(["1", "+", "2", "=", "3", ";", "4", "5"] * 3) == 0 and deg.token_cycle(list("abcdefgh") * 3) == 8 and deg.token_cycle([]) == 0


def test_bit_exact_orders(spark):
    docs = table("documents")
    assert {r["doc_id"]: r["score"] for r in rows(spark, "blake2b_order")} == {d["doc_id"]: str(int.from_bytes(hashlib.blake2b(f"7:{d['doc_id']}".encode(), digest_size=8).digest(), "big")) for d in docs}
    assert {r["doc_id"]: r["h"] for r in rows(spark, "xxh3_hash")} == {d["doc_id"]: xxhash.xxh3_64_hexdigest(d["text"].encode()) for d in docs}
    assert {r["doc_id"]: r["h"] for r in rows(spark, "xxh3_128_hash")} == {d["doc_id"]: xxhash.xxh3_128_hexdigest(f"{d['source']}//{d['doc_id']}".encode()) for d in docs}


def test_token_masks_and_tools(spark):
    answer, protocol = ({r["doc_id"]: (r["n"], r["marked"]) for r in rows(spark, q)} for q in ("answer_token_mask", "protocol_token_mask"))
    for d in table("documents"):
        toks = list(regex.finditer(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]", d["text"] + "<|thought_end|> \\boxed{ 12 } tail"))
        assert answer[d["doc_id"]] == (len(toks), 2) and protocol[d["doc_id"]] == (len(toks), 7 + 7 * (d["text"].count("<|thought_end|>") + d["text"].count("<|thought_start|>")))
    for r in rows(spark, "tool_schema"):
        tool = json.loads(r["tool"])
        assert tool == {"type": "function", "function": {"name": "f", "required": ["a"], "parameters": {"type": "object", "required": ["a"], "properties": {"a": {"type": "array" if r["doc_id"] % 2 else "string"}}}}}


def eligible(msgs):
    """turns, alternating, characters and marks of a chat, and whether any turn loops."""
    said = [c for r, c in msgs if r == "assistant"]
    loop = lambda c: any(v >= 3 for v in __import__("collections").Counter(p for p in (q.strip(SPACE) for q in re.split("[。！？!?；;\n]+", c)) if len(p) >= 6).values()) or bool(re.search(r"(.{12})\1\1", c, re.S))
    return len(said), bool(msgs) and all(a[0] != b[0] for a, b in itertools.pairwise(msgs)), len("\n".join(said)), sum(c.count("<image>") + c.count("<img>") for _, c in msgs), any(loop(c) for _, c in msgs)


def test_eligible_chats(spark):
    whole, short = set(), set()
    for i, msgs in chats().items():
        plain = [m for m in msgs if m[0] != "system"]
        users, answers = [k for k, (r, _) in enumerate(plain) if r == "user"], [k for k, (r, _) in enumerate(plain) if r == "assistant"]
        talk = plain[users[0] : answers[-1] + 1] if users and answers and answers[-1] > users[0] else []
        turns, alternating, n, marks, loop = eligible(talk)
        if 2 <= turns <= 5 and alternating and n <= 2500 and marks <= 1 and not loop:
            whole.add(i)
        head = marked(plain[users[0] : answers[-1] + 1][:2]) if users and answers and answers[-1] > users[0] else []
        turns, alternating, n, marks, loop = eligible([(r, c if r == "assistant" else c) for r, c in head])
        if len(head) == 2 and turns == 1 and alternating and n <= 400 and marks == 1 and not eligible([m for m in head if m[0] == "assistant"])[4]:
            short.add(i)
    assert {r["conv_id"] for r in rows(spark, "chat_eligible")} == whole
    assert {r["conv_id"] for r in rows(spark, "short_chat_eligible")} == short
