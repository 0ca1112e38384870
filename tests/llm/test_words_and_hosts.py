"""Spelling variants, host rules and ranked search against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import hostrules, queries, ranked, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# columns whose names clash with those the operators make
SCHEMA = "doc_id long, text string, source string, word string, n string, kept string, term string, h string, m string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "a", "b", "c", "d", "e", "f") for i, t, s in rows], SCHEMA)


# ---- spelling variants ----
def slips(rows):
    counts = Counter()
    for i, t, _ in rows:
        for run in re.findall("[a-zA-ZÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(rows):
    words = slips(rows)
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        v = min(vs, key=lambda v: (-words[v], v.encode()), default=None)
        form[w] = v if v is not None and words[v] >= 10 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def spelling_rows():
    r = random.Random(5)
    stems = ["parliament", "Überfluss", "garçonière", "misspelled", "abcdefg", "ÀÉÎÕÜßÿ"]
    rows = []
    for i in range(300):
        words = []
        for _ in range(r.randint(0, 40)):
            w = r.choice(stems)
            if r.random() < 0.25:
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("aeé") + w[k:], w[:k] + r.choice("xyÿ") + w[k + 1 :]])
            words.append(w)
        rows.append((i, r.choice([" ", ", ", "\n", "1"]).join(words), "s"))
    deep = [("chained", 2), ("chainedd", 30), ("chaineddd", 400)]  # forms of forms
    rows += [(1000 + k, " ".join([w] * n), "s") for k, (w, n) in enumerate(deep)]
    return [*rows, (None, None, None), (None, "parliament Parliament", "s"), (2000, "", "s"), (2001, "longword " * 50_000, "s"), rows[3], rows[3]]


def test_spelling(spark):
    rows = spelling_rows()
    got = {tuple(r) for r in spelling.variants(frame(spark, rows)).collect()}
    want = brute_variants(rows)
    assert got == want
    assert ("chained", "chainedd", "chaineddd") in {x[:3] for x in got}


def test_spelling_without_words(spark):
    assert spelling.variants(frame(spark, [])).count() == 0
    assert spelling.variants(frame(spark, [(1, None, None), (2, "short words", "a")])).count() == 0


def test_one_edit_leaves_a_band_and_a_half(spark):
    r = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzàéîõüßÿ"
    pairs = []
    for _ in range(300):
        w = "".join(r.choice(letters) for _ in range(r.randint(7, 14)))
        k, c = r.randrange(len(w)), r.choice(letters)
        pairs.append((w, r.choice([w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :]])))
    df = spark.createDataFrame(pairs, "a string, b string")
    bands = lambda c: F.array(*[spelling.band_of(spelling.parity_mask(F.col(c)), F.lit(b)) for b in range(spelling.BANDS)])
    for x, y, la, lb in df.select(bands("a"), bands("b"), F.length("a"), F.length("b")).collect():
        assert any(p == q for p, q in list(zip(x, y))[: 3 if la == lb else 2]) and sum(bin(p ^ q).count("1") for p, q in zip(x, y)) <= (2 if la == lb else 1)
    words = {w for p in pairs for w in p if len(w) >= 6}
    table = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    got = [tuple(sorted(r[:2])) for r in spelling.near_pairs(table).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {tuple(sorted((a, b))) for a in words for b in words if a < b and one_edit(a, b)}


# ---- host rules ----
def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    hit = {k + j for k in range(len(words) - 2) if seen[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(lines)


@pytest.mark.parametrize("text", [None, "", " \n\t", "a b c a b c", "a b a b a", "x y z \x1c w\x85v", "é ß \U0001f600 é ß \U0001f600", "#a |b| <c>\n#a |b| <c>\n \n \n#a |b| <c> ", "one\rtwo\x0bthree\x0cfour", "w " * 5000])
def test_measures(text):
    assert hostrules.measures((text or "").encode()) == brute_measures(text)


def test_measures_of_random_texts():
    r = random.Random(2)
    for _ in range(300):
        text = "".join(r.choice(["a", "b", "é", "#", " ", "\n", "\t", " "]) for _ in range(r.randint(0, 80)))
        assert hostrules.measures(text.encode()) == brute_measures(text)


def host_rows():
    r = random.Random(3)
    good = lambda: " ".join(f"word{r.randrange(10**6)}" for _ in range(60))
    symbols = lambda: " ".join(f"#w{r.randrange(10**6)}" for _ in range(60))
    rows = [(k, symbols() if k % 9 == 0 else good(), f"host{k % 40}") for k in range(800)]
    rows += [(1000 + k, symbols(), "spam") for k in range(60)] + [(2000, good(), "spam")]  # a bad host takes its good document along
    rows += [(3000, symbols(), "tiny"), (3001, symbols(), None), (3002, good(), None), (3003, None, None), (3004, "", "host1"), (3005, "few words", "host2")]
    return rows + [(3006, good() + " " + "again and " * 60_000, "host3"), rows[0], rows[0]]


def test_host_rules(spark):
    rows = host_rows()
    got = {r["doc_id"]: r for r in hostrules.judge(frame(spark, rows)).collect()}
    for i, t, s in rows:
        m = brute_measures(t)
        assert tuple(got[i][c] for c in hostrules.MEASURES) == m
        failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
        assert got[i]["base_failed"] == failed
        assert got[i]["kept"] == (not failed and s != "spam")
    assert got[3000]["kept"]  # one failure in one document is not enough: the prior pulls its host towards the others
    assert hostrules.judge(frame(spark, rows)).count() == len(rows)
    kept = hostrules.keep_documents(frame(spark, rows))
    assert kept.columns == [f.split()[0] for f in SCHEMA.split(", ")]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _, _ in rows if got[i]["kept"])


def test_shrunken_rates_against_plain_sums(spark):
    rows = host_rows()
    df = hostrules.judge(frame(spark, rows))
    got = {r["host"]: r for r in hostrules.host_rates(df, "__host").collect()}
    by = defaultdict(list)
    for _, t, s in rows:
        if s is not None:
            m = brute_measures(t)
            by[s].append(100 * m[2] > 10 * m[0])
    docs, fails = sum(map(len, by.values())), sum(map(sum, by.values()))
    m = fails / docs
    apart = sum(len(x) * (sum(x) / len(x) - m) ** 2 for x in by.values())
    c = min(1, max(1e-6, (apart / (m * (1 - m)) - len(by)) / (docs - len(by))))
    for host, x in by.items():
        assert got[host]["n"] == len(x)
        assert got[host]["rate_symbols"] == pytest.approx((sum(x) + (1 / c - 1) * m) / (len(x) + 1 / c - 1))


def test_host_rules_on_empty_and_uniform_tables(spark):
    assert hostrules.judge(frame(spark, [])).count() == 0
    assert not hostrules.judge(frame(spark, [(1, "x", "a"), (2, None, "b"), (3, "", None)])).filter("kept").count()
    assert hostrules.keep_documents(frame(spark, [])).count() == 0


# ---- ranked search ----
def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_rank(rows, items, k):
    docs = [(i, Counter(terms_of(t))) for i, t, _ in rows if terms_of(t)]
    n_docs, length = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(w for _, c in docs for w in c)
    queries = defaultdict(set)
    for i, t in items:
        queries[i] |= set(terms_of(t))
    out = []
    for q, terms in queries.items():
        found = []
        for i, c in docs:
            m = 10 + 90 * sum(c.values()) * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w in terms if c[w])
            if s > 0:
                found.append((-s, i is not None, i or 0, i))
        out += [(q, rank, x[3], -x[0]) for rank, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def ranked_rows():
    r = random.Random(4)
    vocab = [f"t{k}" for k in range(60)] + ["É", "é", "don't", "x_y", "naïve"]
    zipf = [1 / (k + 1) for k in range(len(vocab))]
    rows = [(i, r.choice([" ", "-", ", "]).join(r.choices(vocab, zipf, k=r.randint(1, 60))).upper() if i % 3 else " ".join(r.choices(vocab, zipf, k=9)), "s") for i in range(900)]
    rows += [(5000 + i, "copy of the same t50 t51 t52", "s") for i in range(80)]  # ties beyond k
    return [*rows, (None, "t50 t51", "s"), (None, None, None), (6000, "", "s"), (6001, "t1 t2 " * 30_000, "s"), rows[5], rows[5]]


ITEMS = [("a", "t50 T51 t52"), ("b", "t0 t1 t2 t3 t40 É naïve"), ("c", "nowhere"), ("d", None), ("e", "..."), ("f", "don't x_y"), ("a", "t1"), (None, "t7 t9"), ("g", "t0"), ("h", " ".join(f"t{k}" for k in range(60)))]


@pytest.mark.parametrize("shard_docs,query_bytes,term_bytes", [(8192, 1 << 24, 1 << 24), (64, 1 << 24, 1 << 24), (50, 600, 0)])
def test_ranked_search(spark, monkeypatch, shard_docs, query_bytes, term_bytes):
    monkeypatch.setattr(ranked, "SHARD_DOCS", shard_docs)
    monkeypatch.setattr(ranked, "QUERY_BYTES", query_bytes)
    monkeypatch.setattr(ranked, "TERM_BYTES", term_bytes)
    rows = ranked_rows()
    items = spark.createDataFrame([(i, t, 1, 2) for i, t in ITEMS], "item_id string, text string, rank int, score int")
    got = sorted((tuple(r) for r in ranked.rank_documents(frame(spark, rows), items, 10).collect()), key=repr)
    assert got == brute_rank(rows, ITEMS, 10)


def test_ranked_search_of_nothing(spark):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert ranked.rank_documents(frame(spark, []), items).count() == 0
    assert ranked.rank_documents(frame(spark, [(1, None, None)]), items).count() == 0
    assert ranked.rank_documents(frame(spark, [(1, "t1", None)]), items.filter("false")).count() == 0


@pytest.mark.parametrize("n", [1, 7, 8, 9, 100, 333])
def test_cuts_cost_least(n, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK_COST", 50)
    rng = np.random.default_rng(n)
    x = rng.integers(1, 40, n) * rng.integers(1, 3, n) ** 4
    edges = [*range(0, n, ranked.STEP), n]
    cost = lambda at: sum(int(x[i:j].max()) * (j - i) + 50 for i, j in zip(at[:-1], at[1:]))
    best = [0] + [10**18] * (len(edges) - 1)
    for j in range(1, len(edges)):
        best[j] = min(best[i] + cost((edges[i], edges[j])) for i in range(max(0, j - ranked.REACH), j))
    got = ranked.cut(x)
    assert got[0] == 0 and got[-1] == n and cost(got) == best[-1]


def test_blocks_skip_documents_and_bounds_hold():
    rng = np.random.default_rng(1)
    n = 4000
    tf = np.where(np.arange(n) // 500 == 3, 9, 1)  # one stretch of heavy postings
    row = {"docs": list(range(n)), "lens": [50] * n, "terms": ["a", "b"], "starts": [0, n, n + n // 2], "doc": [*range(n), *range(0, n, 2)], "tf": [*tf, *rng.integers(1, 3, n // 2)]}
    shard = ranked.Shard(row, n, 50 * n)
    query = [("a", 100), ("b", 7)]
    opened = []
    scores = shard.scores
    shard.scores = lambda q, some: opened.extend(some) or scores(q, some)
    best = ranked.search_shard(shard, query, [], 10)
    every = scores(query, np.arange(n))
    assert (shard.bounds(query) >= every).all()
    assert best == ranked.best_of(every, row["docs"], 10)
    assert len(opened) < n // 4


def test_contract_columns(spark):
    sf = "/root/testdata/sf0.001"
    assert queries.op11_spelling(spark, sf).dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    assert queries.op12_host_rules(spark, sf).dtypes == [("doc_id", "bigint"), *[(m, "bigint") for m in hostrules.MEASURES[:5]], ("base_failed", "boolean"), ("kept", "boolean")]
    assert queries.op13_ranked(spark, sf).dtypes == [("item_id", dict(spark.read.parquet(f"{sf}/benchmark.parquet").dtypes)["item_id"]), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_spelling_sends_no_table_through_the_driver(spark):
    from corvane.llm import spelling
    from corvane.sources.scratch import settle

    words = settle(spark.createDataFrame([("lantern", 40), ("lanterm", 2)], "word string, n long"))
    pairs = spelling.near_pairs(words)
    for df in (pairs, spelling.forms(words, pairs)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
