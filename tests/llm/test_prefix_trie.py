import hashlib
import random
import zlib

import pytest

from quillspark.llm import prefix_trie as trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def turn_key(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute_force(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own.setdefault(conv, []).append(((turn is not None, turn or 0), turn_key(role, text), role, text))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    full = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = tuple(own.get(c - c % 5, [])[:h] + x[h:])
    members = {}
    for c, x in full.items():
        for d in range(len(x) + 1):
            members.setdefault(x[:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out = set()
    totals = {}
    for p in sorted(members, key=len, reverse=True):
        below = [totals[q] for q in children.get(p, [])]
        own_saved = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        totals[p] = (sum(x[0] for x in below) or 1, sum(x[1] for x in below) + own_saved)
        ends = ",".join(map(str, sorted(c for c in members[p] if len(full[c]) == len(p))))
        out.add((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children.get(p, [])), *totals[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def found(spark, rows, extra=""):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in extra.split():
        df = df.selectExpr("*", f"conv_id AS `{name}`")
    result = trie.prefix_trie(df)
    assert tuple(result.columns) == COLUMNS and all(k == ("string" if c == "ends_sha256" else "bigint") for c, k in result.dtypes)
    rows = [tuple(r) for r in result.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def conversations(rng, n, texts, longest):
    rows, first = [], 0
    while len({r[0] for r in rows}) < n:
        c = first
        first += rng.choice([1, 1, 1, 3])
        for k in range(rng.randint(1, longest)):
            rows.append((c, k, rng.choice(["user", "assistant"]) if rng.random() < 0.1 else "user", rng.choice(texts)))
    return rows


def test_small_cases(spark):
    assert found(spark, []) == set()
    assert found(spark, [(None, 1, "user", "x")]) == set()
    cases = [
        [(1, 0, "user", "a")],
        [(0, None, None, None), (0, 1, "", ""), (0, 0, "user", "ü")],
        [(5, 1, "u", "a"), (5, 1, "u", "a"), (5, None, "u", "b"), (None, 3, "u", "c"), (6, 0, "u", "b"), (-4, 0, "u", "b")],
        [(c, 0, "u", "same") for c in range(20)] + [(c, 1, "u", "x" * 100_000) for c in range(0, 20, 3)],
    ]
    for rows in cases:
        assert found(spark, rows, "symbol pos key n total") == brute_force(rows)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = conversations(rng, 150, [["a", "b"], ["a", "bé", "c" * 30, ""], [str(i) for i in range(50)]][seed], [30, 12, 9][seed])
    rng.shuffle(rows)
    assert found(spark, rows) == brute_force(rows)


def test_long_conversations_and_copies(spark):
    rng = random.Random(9)
    text = [str(rng.randint(0, 9)) for _ in range(700)]
    rows = []
    for c in range(0, 200, 5):
        n = rng.choice([63, 64, 65, 128, 129, 300, 640, 700])
        mine = text[:n]
        if rng.random() < 0.5:
            mine[rng.randrange(n)] = "other"
        rows += [(c, k, "u", t) for k, t in enumerate(mine)]
    rows += [(c, 0, "u", "copy") for c in range(1000, 1400)]
    rng.shuffle(rows)
    assert found(spark, rows) == brute_force(rows)


def test_blocks_agree_with_one_sweep():
    rng = random.Random(4)
    for _ in range(300):
        words = sorted({tuple(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 30))})
        rows = []
        for i, w in enumerate(words):
            lcp = 0
            while i and lcp < min(len(w), len(words[i - 1])) and w[lcp] == words[i - 1][lcp]:
                lcp += 1
            rows.append((i, len(w), len(w), rng.randint(1, 3), lcp, lcp))
        whole = [trie._node(0, 0, 0)]
        for r in rows:
            trie.arrive(whole, *r)
        cut = sorted(rng.sample(range(len(rows) + 1), min(3, len(rows) + 1)))
        parts = [rows[a:b] for a, b in zip([0, *cut], [*cut, len(rows)])]
        stack = [trie._node(0, 0, 0)]
        for part in parts:
            trie.apply(stack, trie.summary(iter(part)))
        assert stack == whole
