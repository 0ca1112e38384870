"""The thin contract queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import decontam, exactdup, hostrules, htmlmain, langid_crf, lm_ctw, mix, neardup, pii, quality_pu, ranked, shard, spelling
from corvane.llm.common import fold, table


def op1_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_ctw.score(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid_crf.predict(docs, langid_crf.train(docs))
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_pu.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    of = lambda kind: f"array_sort(filter(spans, x -> x.kind = '{kind}'))"
    shown = lambda kinds: F.transform(F.expr(f"flatten(array({', '.join(of(k) for k in kinds)}))"), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"]))
    base = shown(pii.BASE)
    terms = F.transform("terms", lambda x: F.concat_ws(":", F.lit("term"), x["start"], x["end"]))
    counts = [F.expr(f"cast(size({of(k)}) as long)").alias(f"n_{k}") for k in pii.BASE]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, shown(["secret"]), terms), ",").alias("spans"),
        F.expr(f"cast(size({of('secret')}) as long)").alias("n_secret"),
        F.size("terms").cast("long").alias("n_term"),
        (F.size("spans") + F.size("terms")).cast("long").alias("n_spans"),
    )


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(table(spark, sf_dir, "documents"), 3, 85)


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard.shard_table(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix.mix_copies(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exactdup.exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmain.extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hostrules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


QUERIES = {
    "op1_decontam": op1_decontam,
    "op2_lm_score": op2_lm_score,
    "op3_language": op3_language,
    "op4_quality": op4_quality,
    "op5_pii": op5_pii,
    "op6_near_dedup": op6_near_dedup,
    "op7_shard": op7_shard,
    "op8_mix": op8_mix,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_html_main": op10_html_main,
    "op11_spelling": op11_spelling,
    "op12_host_rules": op12_host_rules,
    "op13_ranked": op13_ranked,
}


def _crc32_entry(i: int) -> int:
    for _ in range(8):
        i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
    return i


_CRC32 = "[" + ", ".join(f"{_crc32_entry(i)}::BIGINT" for i in range(256)) + "]"

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op1_decontam": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 10) AS k FROM (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, list_slice(w, i + 1, i + k) AS win FROM (SELECT item_id, k, w, unnest(range(0, len(w) - k + 1)) AS i FROM b)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, k, i, list_slice(w, i + 1, i + k) AS win FROM (SELECT r, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT DISTINCT r, dw.k, i, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)""",
    "op6_near_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, [x FOR x IN regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS sh FROM d),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS i FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c WHERE 100 * i >= 85 * (na + nb - i)),
r AS (SELECT doc_id AS node, doc_id AS root FROM s UNION SELECT l.b, r.root FROM r JOIN l ON r.node = l.a),
m AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m ON doc_id = node""",
    "op8_mix": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rn FROM s),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((rn - 1) % 3 + 1)::INT] AS weight, size * 2.0::DOUBLE AS cap FROM r),
l AS (SELECT *, sum(size) OVER () * 1.5::DOUBLE AS total, sum(weight) OVER () AS all_w,
             coalesce(sum(cap) OVER b, 0) AS caps, coalesce(sum(weight) OVER b, 0) AS ws
      FROM w WINDOW b AS (ORDER BY cap / weight, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, (total - caps) / (all_w - ws) AS level FROM l),
f AS (SELECT arg_min(level, cap / weight) AS level FROM v WHERE level * weight <= cap),
t AS (SELECT source, size, least(cap, coalesce(f.level * weight, cap)) AS target FROM v LEFT JOIN f ON TRUE),
p AS (SELECT *, CASE WHEN size > 0 THEN floor(target / size) ELSE 0 END AS whole FROM t),
q AS (SELECT *, target - whole * size AS rest FROM p),
g AS (SELECT source, key, sum(size) AS size FROM d GROUP BY ALL),
c AS (SELECT source, key, sum(size) OVER (PARTITION BY source ORDER BY key) - size / 2 AS run FROM g)
SELECT d.doc_id, d.size, q.size::BIGINT AS source_size, q.target,
       (d.size * (q.whole::BIGINT + CASE WHEN q.rest > 0 AND c.run <= q.rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.key = c.key""",
    "op9_exact_dedup": f"""
WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)""",
    "op11_spelling": rf"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY ALL),
u AS (SELECT *, [unicode(x)::BIGINT FOR x IN string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, '')] AS points FROM c),
b AS (SELECT run, n, flatten([CASE WHEN p < 128 THEN [p] ELSE [192 + (p >> 6), 128 + (p & 63)] END FOR p IN points]) AS bytes FROM u),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda s, x: xor(s >> 8, ({_CRC32})[(xor(s, x) & 255) + 1])), 4294967295::BIGINT) AS h FROM b),
s AS (SELECT n, CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM s WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
g AS (SELECT word, n, unnest(list_prepend(word, [left(word, i) || substr(word, i + 2) FOR i IN range(length(word))])) AS part, unnest(range(length(word) + 1)) AS at FROM w),
p AS (SELECT DISTINCT x.word, y.word AS near, y.n AS m FROM g x JOIN g y ON x.part = y.part AND x.word <> y.word WHERE x.at = y.at OR x.at = 0 OR y.at = 0),
q AS (SELECT word, count(*) AS n_near, max(m) AS m, arg_min(near, (-m, near)) AS near FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 10 * w.n THEN near END AS form, CASE WHEN m >= 10 * w.n THEN m END AS form_n FROM w LEFT JOIN q USING (word)),
t AS (SELECT word, word AS root FROM f UNION ALL SELECT t.word, f.form FROM t JOIN f ON t.root = f.word WHERE f.form IS NOT NULL),
e AS (SELECT t.word, t.root FROM t JOIN f ON t.root = f.word WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN e USING (word)""",
    "op12_host_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
v AS (SELECT r, doc_id, source, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM d),
x AS (SELECT r, i, list_slice(w, i + 1, i + 3) AS win FROM (SELECT r, w, unnest(range(0, len(w) - 2)) AS i FROM v)),
y AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM x) WHERE c > 1),
z AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM y) GROUP BY r),
m AS (SELECT doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum([length(q) FOR q IN w]), 0)::BIGINT AS word_chars, n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines FROM v LEFT JOIN z USING (r)),
f AS (SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repeats, 100 * n_symbols > 10 * n_words AS symbols,
             100 * n_dup_lines > 30 * n_lines AS lines, n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 12 * n_words) AS lengths FROM m),
l AS (UNPIVOT (SELECT source, short, repeats, symbols, lines, lengths FROM f WHERE source IS NOT NULL) ON short, repeats, symbols, lines, lengths INTO NAME rule VALUE failed),
h AS (SELECT source, rule, count(*) AS n, sum(failed::INT) AS bad FROM l GROUP BY ALL),
a AS (SELECT rule, count(*) AS hosts, sum(n) AS docs, sum(bad) / sum(n) AS m, sum(bad * bad / n) - sum(bad) * sum(bad) / sum(n) AS apart FROM h GROUP BY rule),
k AS (SELECT rule, m, least(1, greatest(1e-6, CASE WHEN docs > hosts THEN (apart / (m * (1 - m)) - hosts) / (docs - hosts) ELSE 1 END)) AS c FROM a WHERE m > 0 AND m < 1),
e AS (SELECT source, n, a.m, 1 / c - 1 AS s, (bad + (1 / c - 1) * a.m) / (n + (1 / c - 1)) AS rate FROM h JOIN a USING (rule) LEFT JOIN k USING (rule)),
g AS (SELECT DISTINCT source FROM e WHERE coalesce(rate - sqrt(rate * (1 - rate) / (n + s + 1)), m) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeats AS base_failed, NOT (short OR repeats) AND g.source IS NULL AS kept
FROM f LEFT JOIN g USING (source)""",
    "op13_ranked": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT count(*)::BIGINT AS n_all, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
t AS (SELECT r, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
f AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_all) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, s GROUP BY term),
p AS (SELECT item_id, r, doc_id, sum(w.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_all) // l))))::BIGINT AS score
      FROM q JOIN f USING (term) JOIN w USING (term), s GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank, doc_id, score FROM p WHERE score > 0
QUALIFY rank <= 10""",
}
