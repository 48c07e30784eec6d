import re
from collections import Counter

import pyarrow as pa
from conftest import ODD, documents, sentence

from quillspark.llm import quality
from quillspark.llm.quality import RULES, judge, order_rules, rate_quality
from quillspark.llm.words import text_chunks


SEEN = set()


def brute_force(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    chars, symbols = sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or ""))
    n, shouts = len(words), sum(w.endswith("!!") for w in words)
    failed = n < 10 or 100 * len(repeated) > 20 * n
    count = lambda pattern: len(re.findall(pattern, text or ""))
    rejected = {
        "symbols": 10 * symbols > 3 * n,
        "long_words": chars > 20 * n,
        "short_words": 2 * chars < 3 * n,
        "same_lines": 2 * (len(lines) - len(set(lines))) > len(lines),
        "digits": 2 * count("[0-9]") > chars,
        "capitals": 2 * count("[A-Z]") > chars,
        "braces": 5 * count("[{}]") > n,
        "shouting": 10 * shouts > 3 * n,
        "unlettered": 2 * sum(not re.search("[A-Za-z]|[^\x00-\x7f]", w) for w in words) > n,
        "ellipses": 10 * sum(x.endswith("...") for x in lines) > 3 * len(lines),
        "bullets": 10 * sum(x.startswith(("- ", "* ")) for x in lines) > 9 * len(lines),
        "long_runs": 2 * sum(len(w) for w in words if len(w) > 100) > chars,
        "few_distinct": len(set(words)) < 6,
    }
    assert rejected.keys() == RULES.keys()
    SEEN.update(k for k, v in rejected.items() if v and not failed)
    kept = not failed and not any(rejected.values())
    return n, chars, symbols, len(lines) - len(set(lines)), len(repeated), failed, kept


def texts(rng):
    out = [t for _, t in ODD]
    for _ in range(300):
        lines = [sentence(rng, rng.randint(0, 12)) for _ in range(rng.randint(1, 8))]
        lines += rng.choices(lines, k=rng.randint(0, 3))
        text = rng.choice(["\n", "\n\n", " \n", "\r\n"]).join(lines)
        out.append(rng.choice([text, text.replace(" ", "!! "), text.replace(" ", "%% "), text.replace("a", "é"), text + "\n"]))
    plain = lambda: sentence(rng, 20)
    for _ in range(5):
        out += ["\n".join(f"{mark}{plain()}{dots}" for _ in range(4)) for mark in ("", "- ", "* ") for dots in ("", "...")]
        out += [plain().upper(), " ".join(f"{{{k}}}" for k in range(9)) + plain(), " ".join(str(rng.randrange(10**9)) for _ in range(30)), " ".join(f"--{rng.choice('.,;:')}{k}" for k in range(30)), " ".join(f"{rng.choice('abc')}" for _ in range(10))]
        out += [plain() + " " + "y" * 900, " ".join(rng.choice("abcdefghijk") for _ in range(25)), "\n".join(["hm"] * 4 + [plain()]), " ".join(w * 12 for w in plain().split()), "a b c d e a c b d a e c"]
    return out


def test_counts_and_verdicts(spark, rng):
    rows = list(enumerate(texts(rng)))
    result = rate_quality(documents(spark, rows, "kept n_words words"))
    found = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in result.collect()}
    assert found == {i: brute_force(t) for i, t in rows}
    assert {x[-1] for x in found.values()} == {True, False} and SEEN == RULES.keys()
    assert rate_quality(documents(spark, [])).collect() == []


def test_chunks_and_order_change_nothing(rng, monkeypatch):
    all_texts = texts(rng)
    verdicts = set()
    for order in (list(RULES), list(reversed(RULES))):
        for limit in (1, 500, 1 << 20):
            kept = []
            for chunk in text_chunks(pa.array(all_texts), limit):
                page = quality.Page.of(chunk)
                kept += judge(page, order, page.n_words > 0).tolist()
            verdicts.add(tuple(kept))
    assert len(verdicts) == 1


def test_rules_that_reject_more_come_first(spark):
    texts = spark.createDataFrame([(" ".join(f"shout{k}!!" for k in range(40)),)] * 50 + [(None,), ("",)], "text string")
    assert order_rules(texts.limit(0)) == sorted(RULES)
    order = order_rules(texts.repartition(5))
    assert order[0] == "shouting" and sorted(order) == sorted(RULES)
