"""Language of code-switched text by a linear-chain conditional random field over words.

Every word has affix, character n-gram and lexicon features; their weights give an emission score
for each language, and learned transitions link neighbouring words. Forward-backward over the whole
text yields the posterior of every word's language (`label_words`); a text's language is the one with
the largest mean posterior, weighted by letters, and that mean is its score (`predict`).

A text is one chain, however long. To work in array steps it is laid out in segments of SEGMENT words:
each segment's steps are first multiplied into one small matrix, those carry the messages from segment to
segment, and all segments then run at once from their own messages. The length of a segment changes the
order of the arithmetic, not the result. Features cover every character of a word of any length.

The model is fitted on the driver from a bounded sample, the MAX_DOCS texts of each language with the
smallest seeded hashes: words carry their text's language as label, and the log-likelihood is climbed by
AdaGrad with forward-backward gradients. So that transitions learn switches as well as stays, a share
SPLICED of the training chains goes on, from a random word, with another text's words. The lexicon holds
the sample's words whose language is nearly certain. Prediction reads the text alone.

Defined cases: a text that is null or has no letter is `und` with score 0 and has no words; ties go to
the language first by name; without labelled training rows everything is `und`; ids that repeat are
predicted row by row, and equal texts get equal predictions; an empty table gives no rows; other columns
are ignored whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import fold

MAX_DOCS = 250
FOLDS, HELD = 4, 2
SEGMENT = 64  # words laid out side by side
SEGMENTS = 2048  # segments that are worked on at a time
SPLICED = 0.25
WIDTH = 24  # longer words are laid out in tables of their own
DIMS = 1 << 16
EPOCHS = 4
CHUNK_CHARS = 1_500_000
CACHE_WORDS = 400_000
WORD = re.compile(r"[^\W\d_]+")
LEXICON_MIN = 4


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _hash(kind: int, *parts: np.ndarray) -> np.ndarray:
    h = np.full(parts[0].shape, kind * 0x9E3779B97F4A7C15 % 2**64, dtype=np.uint64)
    for p in parts:
        h = (h ^ p) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return (h % np.uint64(DIMS - 1)).astype(np.int64) + 1


def word_features(words: list[str], lexicon: dict[str, int]) -> np.ndarray:
    """Feature ids of each word, padded with 0 (whose weights stay 0)."""
    width = max(3, max(map(len, words)))
    c = np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width).astype(np.uint64)
    n = (c != 0).sum(axis=1)
    rows, step = np.arange(len(words)), np.arange(width)
    cols = []
    for k in (1, 2, 3):
        cols.append(_hash(k, *[c[:, i] for i in range(k)])[:, None])  # prefix
        tail = [c[rows, np.clip(n - 1 - i, 0, width - 1)] for i in range(k)]
        cols.append(np.where(n >= k, _hash(10 + k, *tail), 0)[:, None])  # suffix
    cols.append(np.where(n[:, None] > step[1:], _hash(20, c[:, :-1], c[:, 1:]), 0))
    cols.append(np.where(n[:, None] > step[2:], _hash(21, c[:, :-2], c[:, 1:-1], c[:, 2:]), 0))
    odd = c > 127
    if odd.any():
        cols.append(np.where(odd, _hash(30, c), 0))
    cols.append(_hash(40, np.minimum(n, 12).astype(np.uint64))[:, None])
    lex = np.fromiter((lexicon.get(w, -1) + 1 for w in words), dtype=np.uint64, count=len(words))
    cols.append(np.where(lex > 0, _hash(50, lex), 0)[:, None])
    return np.hstack(cols)


def emissions(feats: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sums of the features' weights: one row of scores a word."""
    out = np.zeros((len(feats), weights.shape[1]))
    if feats.shape[1] > 8 * WIDTH:  # a few very long words
        for at in range(0, feats.shape[1], 1 << 14):
            out += weights[feats[:, at : at + (1 << 14)]].sum(axis=1)
        return out
    for j in range(feats.shape[1]):
        out += weights[feats[:, j]]
    return out


def tables(words: list[str]) -> Iterator[np.ndarray]:
    """Indexes of words, dealt into groups of like length that make tables of bounded size."""
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    order = np.argsort(size, kind="stable")
    size = size[order]
    at = 0
    while at < len(order):
        width = max(WIDTH, 1 << int(size[at] - 1).bit_length())
        to = min(int(np.searchsorted(size, width, "right")), at + max(1, 500_000 // width))
        yield order[at:to]
        at = to


def feature_lists(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all words, end to end, and where each word's begin (one entry more than words)."""
    own: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(words)
    for pick in tables(words):
        for i, row in zip(pick, word_features([words[i] for i in pick], lexicon)):
            own[i] = row[row > 0]
    return np.concatenate(own), np.concatenate([[0], np.cumsum(np.fromiter(map(len, own), dtype=np.int64, count=len(own)))])


def word_scores(words: list[str], lexicon: dict[str, int], weights: np.ndarray) -> np.ndarray:
    """Emission scores of words of any length, worked off in tables of bounded size."""
    out = np.zeros((len(words), weights.shape[1]))
    for pick in tables(words):
        out[pick] = emissions(word_features([words[i] for i in pick], lexicon), weights)
    return out


def posteriors(x: np.ndarray, mask: np.ndarray, first: np.ndarray, last: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward inside segments. x: exp emissions (segments, steps, labels), scaled to a row maximum of 1; mask: which steps exist.

    first: messages into the first steps; last: messages back into the last steps (segments, labels).
    Returns alpha and beta, each scaled, and the exp transitions.
    """
    s, t, k = x.shape
    a = np.exp(trans)
    alpha, beta = np.empty_like(x), np.empty_like(x)
    alpha[:, 0] = first * x[:, 0]
    alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, t):
        v = (alpha[:, i - 1] @ a) * x[:, i]
        alpha[:, i] = v / v.sum(axis=1, keepdims=True)
    beta[:, t - 1] = last
    for i in range(t - 2, -1, -1):
        v = (x[:, i + 1] * beta[:, i + 1]) @ a.T
        v /= v.sum(axis=1, keepdims=True)
        beta[:, i] = np.where(mask[:, i + 1, None], v, last)
    return alpha, beta, a


def messages(make_x, mask: np.ndarray, owner: np.ndarray, start: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`first` and `last` of every segment, so that the segments of an owner form one chain.

    make_x(lo, hi): exp emissions of segments lo to hi. Segments of an owner follow one another, all but its last one full.
    """
    n, k = len(owner), len(start)
    a = np.exp(trans)
    first, last = np.empty((n, k)), np.ones((n, k))
    if not n:
        return first, last
    whole = np.empty((n, k, k))  # product over a segment's steps of diag(x) @ a
    ends = np.empty((n, k))  # the same, its last `a` replaced by a sum over labels
    for lo in range(0, n, SEGMENTS):
        x, m = make_x(lo, lo + SEGMENTS), mask[lo : lo + SEGMENTS]
        q, z = np.broadcast_to(np.eye(k), (len(x), k, k)), np.ones((len(x), k))
        for i in range(x.shape[1]):
            z = np.where(m[:, i, None], np.einsum("skl,sl->sk", q, x[:, i]), z)
            step = (q * x[:, i, None, :]) @ a
            step /= step.max(axis=(1, 2), keepdims=True)
            q = np.where(m[:, i, None, None], step, q)
        whole[lo : lo + SEGMENTS], ends[lo : lo + SEGMENTS] = q, z
    begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    count = np.diff(np.append(begin, n))
    order = np.argsort(-count, kind="stable")
    begin, count = begin[order], count[order]
    first[begin] = np.exp(start)
    z = ends[begin + count - 1]
    for j in range(1, int(count[0])):
        some = int(np.searchsorted(-count, -j, "left"))  # chains of more than j segments
        to = begin[:some] + j
        v = np.einsum("sk,skl->sl", first[to - 1], whole[to - 1])
        first[to] = v / v.max(axis=1, keepdims=True)
        to = begin[:some] + count[:some] - 1 - j
        u = z[:some] @ a.T
        last[to] = u / u.max(axis=1, keepdims=True)
        z = np.einsum("skl,sl->sk", whole[to], z[:some])
        z /= z.max(axis=1, keepdims=True)
    return first, last


def segments(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ids of texts -> (segments, SEGMENT) ids, mask, text of each segment."""
    rows, owner = [], []
    for d, w in enumerate(ids):
        for at in range(0, len(w), SEGMENT):
            rows.append(w[at : at + SEGMENT])
            owner.append(d)
    out = np.zeros((len(rows), SEGMENT), dtype=np.int64)
    mask = np.zeros((len(rows), SEGMENT), dtype=bool)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
        mask[i, : len(r)] = True
    return out, mask, np.array(owner, dtype=np.int64)


def _scaled(e: np.ndarray, mask: np.ndarray) -> np.ndarray:
    x = np.exp(np.maximum(e - e.max(axis=2, keepdims=True), -30))
    x[~mask] = 1.0
    return x


def splice(segs: np.ndarray, mask: np.ndarray, truth: np.ndarray, rng: np.random.Generator) -> None:
    """A share of the chains goes on, from a random word, with the words of another chain."""
    if not len(segs):
        return
    size = mask.sum(axis=1)
    pick = np.flatnonzero((rng.random(len(segs)) < SPLICED) & (size > 1))
    other = rng.integers(0, len(segs), len(pick))
    at = rng.integers(1, size[pick])
    source, labels, sizes = segs.copy(), truth.copy(), size.copy()
    for i, j, cut in zip(pick, other, at):
        n = min(int(size[i]) - cut, int(sizes[j]))
        segs[i, cut : cut + n], truth[i, cut : cut + n] = source[j, :n], labels[j, :n]
        segs[i, cut + n :], mask[i, cut + n :] = 0, False


def fit(texts: list[str], langs: list[str]) -> dict | None:
    """The model, from texts and their languages."""
    names = sorted(set(langs))
    if not names:
        return None
    label = {x: i for i, x in enumerate(names)}
    k = len(names)
    docs = [words_of(t) for t in texts]
    count: dict[str, Counter] = {}
    for d, x in zip(docs, langs):
        for w in d:
            count.setdefault(w, Counter())[label[x]] += 1
    lexicon = {}
    for w, c in count.items():
        best, n = c.most_common(1)[0]
        if n >= LEXICON_MIN and n >= 0.9 * sum(c.values()):
            lexicon[w] = best
    types = {w: i for i, w in enumerate(count)}
    if not types:
        return None
    # half of the lexicon's words train without their lexicon feature, so that unknown words are learnt too
    hidden = {w: x for i, (w, x) in enumerate(sorted(lexicon.items())) if i % 2}
    flat, begin = feature_lists(list(types), hidden)
    segs, mask, owner = segments([np.array([types[w] for w in d], dtype=np.int64) for d in docs])
    truth = np.repeat(np.array([label[x] for x in langs])[owner][:, None], SEGMENT, axis=1)
    rng = np.random.default_rng(3)
    splice(segs, mask, truth, rng)
    weights, start, trans = np.zeros((DIMS, k)), np.zeros(k), np.zeros((k, k))
    gw, gs, gt = np.full((DIMS, k), 1e-6), np.full(k, 1e-6), np.full((k, k), 1e-6)
    step = 256
    for _ in range(EPOCHS):
        order = rng.permutation(len(segs))
        for at in range(0, len(order), step):
            pick = order[at : at + step]
            ids, inv = np.unique(segs[pick][mask[pick]], return_inverse=True)
            m = mask[pick]
            e = np.zeros((*m.shape, k))
            sizes = begin[ids + 1] - begin[ids]
            word = np.repeat(np.arange(len(ids)), sizes)
            f = flat[np.arange(len(word)) + np.repeat(begin[ids] - np.cumsum(sizes) + sizes, sizes)]
            e[m] = np.stack([np.bincount(word, weights[f, c], len(ids)) for c in range(k)], axis=1)[inv]
            x = _scaled(e, m)
            alpha, beta, a = posteriors(x, m, np.tile(np.exp(start), (len(pick), 1)), np.ones((len(pick), k)), trans)
            post = alpha * beta
            post /= post.sum(axis=2, keepdims=True)
            n = m.sum()
            own = truth[pick]
            gold = np.eye(k)[own]
            diff = (gold - post)[m]
            by_type = np.stack([np.bincount(inv, diff[:, c], len(ids)) for c in range(k)], axis=1)
            g = np.stack([np.bincount(f, by_type[word, c], DIMS) for c in range(k)], axis=1)
            g = g / n - 1e-6 * weights
            pair = alpha[:, :-1, :, None] * a * (x[:, 1:] * beta[:, 1:])[:, :, None, :]
            pair /= pair.sum(axis=(2, 3), keepdims=True)
            both = m[:, 1:]
            expect = pair[both].sum(axis=0)
            actual = np.bincount((own[:, :-1] * k + own[:, 1:])[both], minlength=k * k).reshape(k, k)
            dt = (actual - expect) / n - 1e-4 * trans
            ds = (gold[:, 0] - post[:, 0]).sum(axis=0) / n
            gw += g * g
            gs += ds * ds
            gt += dt * dt
            weights += 0.3 * g / np.sqrt(gw)
            start += 0.1 * ds / np.sqrt(gs)
            trans += 0.1 * dt / np.sqrt(gt)
            np.clip(trans, -4, 4, out=trans)
    return {"names": names, "lexicon": lexicon, "weights": weights.astype(np.float32), "start": start, "trans": trans}


class Tagger:
    """Predicts texts; keeps the emissions of words that it has met, a bounded number of them."""

    def __init__(self, model: dict) -> None:
        self.m = model
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.table = np.zeros((0, len(self.m["names"])), dtype=np.float32)

    def word_ids(self, docs: list[list[str]]) -> list[np.ndarray]:
        if len(self.ids) > CACHE_WORDS:
            self.clear()
        ids, new = self.ids, []
        for d in docs:
            for w in d:
                if w not in ids:
                    ids[w] = len(ids)
                    new.append(w)
        if new:
            self.table = np.concatenate([self.table, word_scores(new, self.m["lexicon"], self.m["weights"]).astype(np.float32)])
        return [np.fromiter(map(ids.__getitem__, d), dtype=np.int64, count=len(d)) for d in docs]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to] or "") <= CHUNK_CHARS):
                size += len(texts[to] or "")
                to += 1
            out += self._predict(texts[at:to])
            at = to
        return out

    def marginals(self, docs: list[list[str]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For runs of segments: posteriors (segments, SEGMENT, labels), mask, text of each segment. The words of a text come in order."""
        segs, mask, owner = segments(self.word_ids(docs))
        make = lambda lo, hi: _scaled(self.table[segs[lo:hi]].astype(np.float64), mask[lo:hi])
        first, last = messages(make, mask, owner, self.m["start"], self.m["trans"])
        for lo in range(0, len(segs), SEGMENTS):
            hi = lo + SEGMENTS
            alpha, beta, _ = posteriors(make(lo, hi), mask[lo:hi], first[lo:hi], last[lo:hi], self.m["trans"])
            post = alpha * beta
            post /= post.sum(axis=2, keepdims=True)
            yield post, mask[lo:hi], owner[lo:hi]

    def _predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        docs = [words_of(t) for t in texts]
        total = np.zeros((len(texts), len(self.m["names"])))
        size = np.fromiter((len(w) for d in docs for w in d), dtype=np.float64)
        at = 0
        for post, m, o in self.marginals(docs):
            n = int(m.sum())
            w = np.zeros(m.shape)
            w[m] = size[at : at + n]
            at += n
            np.add.at(total, o, (post * w[:, :, None]).sum(axis=1))
        out = []
        for t in total:
            n = t.sum()
            best = int(t.argmax())
            out.append((self.m["names"][best], float(min(1.0, t[best] / n))) if n else ("und", 0.0))
        return out

    def label(self, text: str | None) -> list[dict]:
        """Every word's language: start, end, lang, p."""
        low = text.lower() if text else ""
        if len(low) != len(text or ""):  # lower-casing changed the positions
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        found = list(WORD.finditer(low))
        post = [p[m] for p, m, _ in self.marginals([[x[0] for x in found]])]
        names = self.m["names"]
        return [{"start": x.start(), "end": x.end(), "lang": names[int(p.argmax())], "p": float(p.max())} for x, p in zip(found, np.concatenate(post) if post else [])]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict | None:
    """Learns from the MAX_DOCS texts of each language with the smallest hashes, outside the held-out fold."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("id"), FOLDS) != HELD))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    top = 2**63 - 1
    hashed = rows.withColumn("h", F.xxhash64(F.lit(5), "id").bitwiseAND(F.lit(top)))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", F.xxhash64("text")))  # a group limit: tasks send MAX_DOCS rows a language

    def pick(cuts: dict[str, int]) -> list:
        """The texts of the smallest hashes of each language, among those up to its cut."""
        cut = F.create_map(*[x for lang, c in cuts.items() for x in (F.lit(lang), F.lit(c))])[F.col("lang")]
        return hashed.filter(F.col("lang").isin(list(cuts)) & (F.col("h") <= cut)).withColumn("place", place).filter(F.col("place") <= MAX_DOCS).select("lang", "place", "text").collect()

    if not sizes:
        return None
    # four times the share wanted is enough, unless many rows repeat an id and so its hash
    sample = pick({lang: min(top, 2**63 * 4 * MAX_DOCS // n) for lang, n in sizes.items()})
    found = Counter(r["lang"] for r in sample)
    if short := [lang for lang, n in sizes.items() if found[lang] < min(n, MAX_DOCS)]:
        sample = [r for r in sample if r["lang"] not in short] + pick(dict.fromkeys(short, top))
    sample.sort(key=lambda r: (r["lang"], r["place"]))
    return fit([r["text"] for r in sample], [r["lang"] for r in sample])


def _tagging(docs: DataFrame, model: dict | None, id_col: str, text_col: str, fields: str, row) -> DataFrame:
    """One Arrow batch after another through a Tagger; `row` makes the columns of a batch from the tagger (or None) and the texts."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # DIMS weights a language: a fixed size

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(shipped.value) if shipped.value else None
        for f in frames:
            yield pd.DataFrame({"id": f["id"], **row(tagger, list(f["text"]))})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, {fields}").withColumnRenamed("id", id_col)


def predict(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score of every row."""

    def row(tagger: Tagger | None, texts: list[str | None]) -> dict:
        got = tagger.predict(texts) if tagger else [("und", 0.0)] * len(texts)
        return {"lang_pred": [x for x, _ in got], "score": [y for _, y in got]}

    return _tagging(docs, model, id_col, text_col, "lang_pred string, score double", row)


def label_words(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and words (start, end, lang, p: the posterior) of every row: the labelling of code-switched text. Without a model, no words."""

    def row(tagger: Tagger | None, texts: list[str | None]) -> dict:
        return {"words": [tagger.label(t) if tagger else [] for t in texts]}

    return _tagging(docs, model, id_col, text_col, "words array<struct<start:int,end:int,lang:string,p:double>>", row)
