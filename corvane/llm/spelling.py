"""Groups of spelling variants: words one edit apart, found by bands of their letter parities.

A word's mask has a bit for each letter that stands in it an odd number of times. One inserted or deleted
letter flips one bit, a replaced one at most two, so of three bands of the mask one at least is equal, and of two bands if the
lengths differ. Words meet on an equal band together with the shorter length of the pair, and with all of the word but one
of three stretches, the one that holds the edit: what stands before it, and what follows it, counted from the end. All this holds for every
pair one edit apart, so none is lost, and a bucket holds words that share two thirds of their letters, not all words of a length.
A pair is taken in the first bucket in which it meets, once its masks differ in two bits at most and `levenshtein` confirms
it, so no table of pairs is made distinct.

Occurrences are counted map-side; buckets are shuffled as hashes. All joins are merged after a shuffle: by the sizes of compressed
files and of rows before they are exploded, Spark would send whole tables of words and buckets through the driver. The form of a word is its near word of most occurrences, if it has at least `ratio` times the word's own; forms lead to the root by
pointer doubling, since counts grow tenfold at every step.

Defined cases: a null or empty text has no words; a null id counts as the empty text in a word's hash; repeated rows
count each; ties of n go to the smallest word in code-point order; an empty table gives no words; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import ascii_lower, settle

LETTERS = "a-z\\u00C0-\\u00FF"
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
SLIP = 31  # one run in so many loses a letter
BANDS, BAND_BITS = 3, 21
STRETCHES = 3


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least: int = LEAST_COUNT) -> DataFrame:
    """word, n: words of at least `least_length` letters and `least` occurrences, slips included."""
    run = f"[{LETTERS}]{{{least_length},}}+"  # runs are maximal, and a shorter one makes no word
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    runs = docs.select(key.alias("key"), F.explode(F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(run), F.lit(0))).alias("run"))
    h = F.crc32(F.concat_ws(":", "key", "run").cast("binary"))
    runs = runs.select("run", h.alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    slipped = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % SLIP == 0, slipped).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def parity_mask(word: Column) -> Column:
    """BANDS bands of BAND_BITS bits: parities of the letters, dealt over the bands by code point."""
    place = lambda p: ((p % BANDS) * BAND_BITS + F.floor(p / BANDS) % BAND_BITS).cast("int")
    spots = F.transform(F.split(word, ""), lambda c: F.ascii(c))
    return F.aggregate(spots, F.lit(0).cast("long"), lambda acc, p: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), place(p))))


def band_of(mask: Column, band: Column) -> Column:
    return F.call_function("shiftrightunsigned", mask, band * BAND_BITS).bitwiseAND(F.lit((1 << BAND_BITS) - 1))


def _cut(shorter: Column, i: int) -> Column:
    return (shorter * i / STRETCHES).cast("int")


def _around(word: Column, shorter: Column, i: int) -> tuple[Column, Column]:
    """What stands before stretch i of a word, or of one a letter longer, and what follows it."""
    return F.substring(word, F.lit(1), _cut(shorter, i)), F.right(word, shorter - _cut(shorter, i + 1))


def _buckets(words: DataFrame, longer: bool) -> DataFrame:
    """key, spot (which stretch and band), word, n, mask: a word's buckets with words of its own length, and those with longer, or shorter, ones."""
    w = words.select("word", "n", parity_mask(F.col("word")).alias("mask"), F.length("word").alias("len"))
    other = F.struct(F.lit(BANDS - 1).alias("bands"), (F.col("len") - 1 if longer else F.col("len")).alias("shorter"))
    w = w.select("word", "n", "mask", F.inline(F.array(F.struct(F.lit(BANDS).alias("bands"), F.col("len").alias("shorter")), other)))
    around = F.array(*[F.struct(F.lit(i).alias("stretch"), *[c.alias(x) for c, x in zip(_around(F.col("word"), F.col("shorter"), i), ("before", "after"))]) for i in range(STRETCHES)])
    w = w.select("*", F.inline(around)).select("*", F.explode(F.sequence(F.lit(0), F.col("bands") - 1)).alias("band"))
    key = F.xxhash64("bands", "shorter", "stretch", "before", "after", "band", band_of(F.col("mask"), F.col("band")))
    return w.select(key.alias("key"), (F.col("stretch") * BANDS + F.col("band")).alias("spot"), "word", "n", "mask")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b, n_a, n_b: words one inserted, deleted or replaced code point apart, each pair once, a no longer than b. words: word, n (settled, distinct)."""
    a, b = _buckets(words, False).alias("a"), _buckets(words, True).drop("spot").alias("b")
    x, y = F.col("a.word"), F.col("b.word")
    differ = F.col("a.mask").bitwiseXOR(F.col("b.mask"))
    once = (F.col("a.mask") < F.col("b.mask")) | (F.length(x) < F.length(y)) | ((F.col("a.mask") == F.col("b.mask")) & (x < y))
    pairs = a.hint("merge").join(b, (F.col("a.key") == F.col("b.key")) & (F.bit_count(differ) <= 2) & once)

    def alike(i: int) -> Column:
        (p, q), (r, t) = _around(x, F.length(x), i), _around(y, F.length(x), i)
        return (p == r) & (q == t)

    stretch = F.when(alike(0), 0).when(alike(1), 1).otherwise(2)
    band = F.when(band_of(differ, F.lit(0)) == 0, 0).when(band_of(differ, F.lit(1)) == 0, 1).otherwise(2)
    pairs = pairs.filter((F.col("a.spot") == stretch * BANDS + band) & (F.levenshtein(x, y, 1) == 1))
    return pairs.select(x.alias("a"), y.alias("b"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"))


def forms(words: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n: each word with its near word of largest n, if that is `ratio` times its own."""
    way = lambda word, near, m: F.struct(F.col(word).alias("word"), F.col(near).alias("near"), F.col(m).alias("m"))
    both = pairs.select(F.inline(F.array(way("a", "b", "n_b"), way("b", "a", "n_a"))))  # in one pass over the pairs
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("least"), "near")).alias("best"))
    j = words.hint("merge").join(best, "word", "left")
    led = -F.col("best.least") >= ratio * F.col("n")
    return j.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(led, F.col("best.near")).alias("form"), F.when(led, -F.col("best.least")).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """word, root of the words that have a form: the last of its forms. Every round doubles the steps taken."""
    at = settle(formed.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = settle(at.hint("merge").join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return at


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n: one row a word."""
    words = settle(word_counts(docs, id_col, text_col))
    formed = settle(forms(words, near_pairs(words)))
    return formed.hint("merge").join(roots(formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
