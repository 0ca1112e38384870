import math
import zlib
from collections import Counter, defaultdict

import pytest

from corvane.llm import lm_ctw

TEXTS = ["the cat sat on the mat", "", None, "the dog sat on the log", "Ünïcode thé é", "aaaa aaaa aaaa", "the cat", "mat the on sat cat the", "x", "the dog sat on the log", "zebra never seen before", "THE CAT"]
SCHEMA = "doc_id long, text string, tokens string, row string"


def low(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def held(i):
    return zlib.crc32(str(i).encode()) % 10 == 0


def brute(rows):
    """Naive context-tree weighting by recursion over explicit nodes."""
    D = lm_ctw.DEPTH
    n = defaultdict(lambda: [0, 0])
    kids = defaultdict(set)

    def steps(t):
        b = b"\xff" * D + low(t).encode() + b"\xff"
        for i in range(D, len(b)):
            ctx = b[i - D : i][::-1]  # nearest first
            for j in range(8):
                yield ctx, (1 << j) | (b[i] >> (8 - j)), (b[i] >> (7 - j)) & 1

    for i, t in rows:
        if not held(i):
            for ctx, p, bit in steps(t):
                for d in range(D + 1):
                    n[ctx[:d], p][bit] += 1
                    if d < D:
                        kids[ctx[:d], p].add((ctx[: d + 1], p))
    lg = math.lgamma
    kt = lambda a, b: lg(a + 0.5) + lg(b + 0.5) - math.log(math.pi) - lg(a + b + 1)
    memo = {}

    def weighted(node):
        if node not in memo:
            a, b = n[node] if node in n else (0, 0)
            k = kt(a, b)
            if len(node[0]) == D:
                memo[node] = k
            else:
                c = sum(weighted(x) for x in kids.get(node, ()))
                m = max(k, c)
                memo[node] = m + math.log(math.exp(k - m) + math.exp(c - m)) - math.log(2)
        return memo[node]

    def p_one(ctx, p, d):
        node = (ctx[:d], p)
        a, b = n[node] if node in n else (0, 0)
        own = (b + 0.5) / (a + b + 1)
        if d == D:
            return own
        w = math.exp(kt(a, b) - math.log(2) - weighted(node))
        return w * own + (1 - w) * p_one(ctx, p, d + 1)

    c = Counter()
    for i, t in rows:
        if not held(i):
            c.update([*low(t).split(), None])
    N, V = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        s = sum(math.log10(p if bit else 1 - p) for ctx, q, bit in steps(t) for p in [p_one(ctx, q, 0)])
        tok = [*low(t).split(), None]
        base = sum(math.log10((c[x] + 0.1) / (N + 0.1 * (V + 1))) for x in tok)
        out.append((i, held(i), len(tok), sum(c[x] > 0 for x in tok), N, base, s))
    return out


@pytest.mark.parametrize("bounds", [(10**6, 10**6), (3, 40)])
def test_score_matches_naive_tree(spark, monkeypatch, bounds):
    monkeypatch.setattr(lm_ctw, "TOKENS_BOUND", bounds[0])
    monkeypatch.setattr(lm_ctw, "GRAMS_BOUND", bounds[1])
    monkeypatch.setattr(lm_ctw, "CHUNK", 16)
    rows = [(i, t) for i, t in enumerate(TEXTS * 2)]
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)
    got = {r["doc_id"]: r for r in lm_ctw.score(df).collect()}
    assert any(held(i) for i, _ in rows)
    for i, h, n, known, N, base, s in brute(rows):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, n, known, N)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] == pytest.approx(s, rel=1e-5)


def test_empty_table_and_no_training_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert lm_ctw.score(empty).count() == 0
    i = next(i for i in range(100) if held(i))
    r = lm_ctw.score(spark.createDataFrame([(i, "ab", "", "")], SCHEMA)).first()
    assert r["train_tokens"] == 0 and r["n_known"] == 0
    assert r["score"] == pytest.approx(3 * 8 * math.log10(0.5))


def test_long_text_and_null_id(spark):
    df = spark.createDataFrame([(None, "word " * 50_000, "", ""), (1, "word word", "", ""), (1, "word word", "", "")], SCHEMA)
    got = lm_ctw.score(df).collect()
    assert len(got) == 3 and max(r["n_tokens"] for r in got) == 50_001
