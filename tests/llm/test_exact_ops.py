"""Exact duplicates, mixing, sharding and decontamination against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from corvane.llm import common, decontam, exactdup, mix, queries, shard

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, source string, len string, size string, at string, shard string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y", "z", "w") for i, t, s in rows], SCHEMA)


def sample_rows(seed=1, n=400):
    r = random.Random(seed)
    words = ["alpha", "Beta", "É", "gamma", "delta", "x1", "Ω"]
    rows = []
    for i in range(n):
        k = r.random()
        text = None if k < 0.03 else "" if k < 0.06 else "same Text" if k < 0.35 else "SAME text" if k < 0.45 else " ".join(r.choice(words) for _ in range(r.randint(1, 12)))
        rows.append((i, text, r.choice(["a", "b", None, "hot", "hot", "hot", "Z"])))
    rows += [(5000, "long " * 60_000, "hot"), (5001, "long " * 60_000, "b"), (7, rows[7][1], rows[7][2]), (None, "orphan", "b")]
    return rows


# ---- exact duplicates ----
@pytest.mark.parametrize("digest_all", [True, False])
@pytest.mark.parametrize("bound", [10**6, 0])
def test_exact_dedup(spark, monkeypatch, digest_all, bound):
    monkeypatch.setattr(exactdup, "LENGTHS_BOUND", bound)
    rows = sample_rows()
    got = exactdup.exact_dedup(frame(spark, rows), digest_all=digest_all).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[(t or "").translate(LOWER)].append(i)
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()] += 1
    if digest_all:
        assert Counter(tuple(r) for r in got) == want
    else:
        assert Counter(tuple(r)[:4] for r in got) == Counter(k[:4] for k in want.elements())
        assert all(r["text_sha256"] is None or r["group_size"] >= 1 for r in got)


def test_exact_dedup_empty(spark):
    assert exactdup.exact_dedup(frame(spark, [])).count() == 0


# ---- mixing ----
def fill(sizes, budget=1.5, cap=2.0, weights=(3.0, 1.0, 2.0)):
    """Iterative clamping and redistribution."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = budget * sum(sizes.values()), list(names), {}
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            out |= share
            break
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def test_mix_copies(spark):
    rows = [(i, t, s) for i, t, s in sample_rows(2, 900)]
    got = mix.mix_copies(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    want = fill(sizes)
    src = {i: s for i, _, s in rows}
    taken, largest = Counter(), Counter()
    for r in got:
        s = src[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert 0 <= r["copies"] <= 2
        taken[s] += r["copies"] * r["size"]
        largest[s] = max(largest[s], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    again = mix.mix_copies(frame(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_same_for_any_bucket_count(spark, monkeypatch):
    rows = sample_rows(3, 500)
    a = sorted(map(str, mix.mix_copies(frame(spark, rows)).collect()))
    monkeypatch.setattr(mix, "BUCKET_ROWS", 2)
    monkeypatch.setattr(mix, "SOURCES_BOUND", 0)
    assert sorted(map(str, mix.mix_copies(frame(spark, rows)).collect())) == a


def test_mix_rows_and_edge_cases(spark):
    df = frame(spark, sample_rows(4, 300))
    copies = {(r["doc_id"], r["size"]): r["copies"] for r in mix.mix_copies(df).collect()}
    out = mix.mix(df)
    assert out.columns == df.columns
    n = Counter(r["doc_id"] for r in out.collect())
    for i, t, _ in sample_rows(4, 300):
        if i not in (7, None):
            assert n[i] == copies[i, len((t or "").split())]
    assert mix.mix_copies(frame(spark, [])).count() == 0 and mix.mix(frame(spark, [])).count() == 0
    zero = mix.mix_copies(frame(spark, [(1, None, None), (2, "", "a")])).collect()
    assert [r["target"] for r in zero] == [0.0, 0.0]


# ---- sharding ----
def jump(key, buckets):
    b, j = -1, 0
    while j < buckets:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("rows_a_bucket", [1024, 3])
def test_shard_table(spark, monkeypatch, rows_a_bucket):
    monkeypatch.setattr(shard, "BUCKET_ROWS", rows_a_bucket)
    rows = sample_rows(5, 600)
    df = frame(spark, rows)
    keys = {r[0]: r[1] % 2**64 for r in df.select("doc_id", shard.stable_key("doc_id")).collect()}
    got = shard.shard_table(df, 24).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        assert r["shard"] == jump(keys[r["doc_id"]], 24) and r["grown_shard"] == jump(keys[r["doc_id"]], 25)
        assert r["grown_shard"] in (r["shard"], 24)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want


def test_shard_documents(spark):
    df = frame(spark, sample_rows(6, 200))
    out = shard.shard_documents(df, 8)
    assert set(out.columns) == set(df.columns) | {"slot"}
    rows = out.collect()
    assert len(rows) == df.count()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert shard.shard_documents(frame(spark, []), 8).count() == 0 and shard.shard_table(frame(spark, [])).count() == 0


# ---- decontamination ----
def toks(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def brute_hits(text, items):
    w = toks(text)
    hit, found = set(), set()
    for item, it in items:
        b = toks(it)
        if not b:
            continue
        k = min(10, len(b))
        wins = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)}
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in wins:
                hit |= set(range(i, i + k))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


ITEMS = [(3, "one two three four five six seven eight nine ten eleven twelve"), (11, "Short item here"), (12, "short ITEM, here!"), (20, None), (21, "..."), (30, "two three four five six seven eight nine ten eleven"), (31, "Été élan")]


def contaminated_rows():
    r = random.Random(9)
    base = toks(ITEMS[0][1])
    rows = [(1, None), (2, ""), (3, "short item here and short item here"), (4, "été élan ÉTÉ ÉLAN Été élan"), (5, "one two three four five six seven eight nine ten"), (5, "one two three four five six seven eight nine ten"), (5, "clean words"), (None, "x short item here")]
    for i in range(40):
        w = [r.choice(["lorem", "ipsum", "two", "short", "item"]) for _ in range(r.randint(0, 40))]
        if i % 3 == 0:
            at = r.randint(0, len(w))
            w[at:at] = base[r.randint(0, 3) :]
        rows.append((100 + i, " ".join(w).title()))
    rows.append((900, "filler " * 50_000 + ITEMS[0][1]))
    return rows


@pytest.mark.parametrize("bound", [10**6, 0])
def test_decontaminate(spark, monkeypatch, bound):
    monkeypatch.setattr(decontam, "WINDOWS_BOUND", bound)
    rows = contaminated_rows()
    df = spark.createDataFrame([(i, t, 1, "h", "w") for i, t in rows], "doc_id long, text string, at int, h string, win string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in decontam.decontaminate(df, items).collect())
    want = Counter((i, *(lambda n, h, f: (n, h, tuple(f)))(*brute_hits(t, ITEMS))) for i, t in rows)
    assert got == want
    left = decontam.remove_documents(df, items)
    assert left.columns == df.columns
    assert Counter(r["doc_id"] for r in left.collect()) == Counter(i for i, t in rows if not brute_hits(t, ITEMS)[1])
    spans = decontam.remove_spans(df, items).collect()
    assert len(spans) == len(rows)
    assert all(not brute_hits(r["text"], ITEMS[:1] + ITEMS[5:6])[1] for r in spans)


def test_decontaminate_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = decontam.decontaminate(df, none).first()
    assert (r["n_words"], r["n_hit"], r["items"]) == (2, 0, [])
    assert decontam.remove_documents(df, none).count() == 1
    assert decontam.decontaminate(df.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


# ---- shared pieces ----
def test_components(spark):
    r = random.Random(3)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2200)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {x["node"]: x["root"] for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for x in parent:
        assert got.get(x, x) == find(x)
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_held_has_no_false_negatives(spark, monkeypatch):
    from pyspark.sql import functions as F

    ids = spark.range(5000).select("id", F.xxhash64("id").alias("h"))
    keys = ids.filter("id % 3 = 0").select("h")
    kept = {r[0] for r in common.only_held(spark.range(5000), keys, F.xxhash64("id")).collect()}
    assert {i for i in range(5000) if i % 3 == 0} <= kept and len(kept) < 2500
    monkeypatch.setattr(common, "MOST_WORDS", 8)  # too small a table: the exact join
    assert {r[0] for r in common.only_held(spark.range(5000), keys, F.xxhash64("id")).collect()} == set(range(0, 5000, 3))


def test_bit_table_grows_with_its_keys():
    assert common.bit_words(0) == common.LEAST_WORDS
    for n in (10**5, 10**6, common.MOST_WORDS * common.KEYS_A_WORD):
        assert common.bit_words(n) * common.KEYS_A_WORD >= n
    assert common.bit_words(common.MOST_WORDS * common.KEYS_A_WORD + 1) is None


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot", [0, 2, 100])
def test_spread_join(spark, monkeypatch, how, hot):
    monkeypatch.setattr(common, "HOT_KEYS", hot)
    facts = [(k, i) for i, k in enumerate([1] * 500 + [2] * 40 + [3, 3, 4, 9, None])]
    f = spark.createDataFrame(facts, "k long, i long")
    d = common.settle(spark.createDataFrame([(1, "a", 500), (2, "b", 40), (3, "c", 2), (4, "d", 1), (5, "e", 7)], "k long, x string, n long"))
    x = {1: "a", 2: "b", 3: "c", 4: "d"}
    got = Counter(tuple(r) for r in common.spread_join(f, d, "k", "n", how).collect())
    assert got == Counter((k, i, x.get(k)) for k, i in facts if how == "left" or k in x)


def test_least_hashes(spark):
    from pyspark.sql import functions as F

    df = spark.range(20_000)
    pick = lambda d, n: [r[0] for r in common.least_hashes(d, F.xxhash64(F.lit(1), "id"), n).orderBy("__h").limit(n).select("id").collect()]
    got = pick(df, 30)
    assert len(set(got)) == 30 and got == pick(df.repartition(7), 30)
    assert common.least_hashes(df, F.xxhash64(F.lit(1), "id"), 30).count() == 30
    copies = spark.range(5000).select((F.col("id") % 3).alias("id"))  # copies share a hash
    assert len(pick(copies, 10)) == 10
    assert pick(df.limit(0), 5) == []


def test_settled_tables_are_deleted(spark):
    import os

    from corvane.sources import scratch

    folder = scratch.shared_dir(spark).removeprefix("file:").replace("//", "/")
    before = set(os.listdir(folder))
    out = common.settle_last(spark, lambda: common.settle(common.settle(spark.range(5)).filter("id > 1")))
    assert sorted(r[0] for r in out.collect()) == [2, 3, 4]
    assert len(set(os.listdir(folder)) - before) == 1


def test_every_operator_has_one_query():
    names = [q for q in queries.QUERIES]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 11))


@pytest.mark.parametrize("bound", [10**6, 0])
def test_drop_rows(spark, monkeypatch, bound):
    monkeypatch.setattr(common, "GONE_BOUND", bound)
    from pyspark.sql import functions as F

    rows = [(i, f"t{i % 7}", "x", 1) for i in range(200)] + [(None, "t1", "x", 1), (None, None, "x", 1), (5, None, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __held2 string, h int")
    th = F.xxhash64(F.coalesce(df["text"], F.lit("")))
    gone = common.settle(df.filter("doc_id % 3 = 0 or doc_id is null and text is not null").select(F.col("doc_id").alias("__id"), th.alias("__th")).distinct())
    got = Counter(tuple(r) for r in common.drop_rows(df, gone, "doc_id", th).collect())
    assert got == Counter(r for r in rows if not (r[0] is not None and r[0] % 3 == 0 or r[0] is None and r[1]))


def shuffled(df):
    """Columns of every exchange of a plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange[^\n]*", plan), plan


def test_exact_dedup_beyond_the_largest_table_moves_no_text(spark, monkeypatch):
    rows = sample_rows()
    want = Counter(map(tuple, exactdup.exact_dedup(frame(spark, rows), digest_all=True).collect()))
    moved = []
    keep = exactdup.settle
    monkeypatch.setattr(exactdup, "settle", lambda df: moved.append(df.columns) or keep(df))
    monkeypatch.setattr(exactdup, "bit_words", lambda n: None)
    out = exactdup.exact_dedup(frame(spark, rows), digest_all=True)
    assert Counter(map(tuple, out.collect())) == want
    assert all("text" not in cols for cols in moved)  # what later joins read
    assert not any("text" in x for x in shuffled(out)[0])


def test_decontaminate_beyond_the_largest_table_moves_windows_alone(spark, monkeypatch):
    r = random.Random(8)
    vocab = [f"w{k}" for k in range(40)]
    docs = [(i, " ".join(r.choices(vocab, k=r.randint(0, 60))), "s") for i in range(60)] + [(99, " ".join(vocab * 100), "s")]
    items = [(f"i{k}", " ".join(docs[k][1].split()[:14])) for k in range(20)] + [("short", "w1 w2")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    run = lambda: decontam.decontaminate(frame(spark, docs), bench)
    want = sorted(map(str, run().collect()))
    monkeypatch.setattr(decontam, "WINDOWS_BOUND", 0)
    assert sorted(map(str, run().collect())) == want  # the bit table
    monkeypatch.setattr(common, "MOST_WORDS", 8)
    asked = []
    held = decontam.only_held
    monkeypatch.setattr(decontam, "only_held", lambda df, keys, h: asked.append(df.columns) or held(df, keys, h))
    monkeypatch.setattr(decontam, "bit_words", lambda n: None)
    monkeypatch.setattr(common, "bit_words", lambda n: None)
    out = run()
    assert sorted(map(str, out.collect())) == want
    assert asked == [["id", "th", "at", "k", "h", "own"]]
