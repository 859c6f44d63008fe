"""Toxicity scores from two class-conditional Kneser-Ney models.

Each class has a bigram model with interpolated, modified Kneser-Ney smoothing, learned from
labelled texts (a text counts once for what it repeats):

- a word after another (START at the beginning): the number of the class's texts with that pair,
  discounted; pairs of fewer than CUT texts are left to the next order as a whole;
- a word: its continuation count, the number of distinct words that it follows in the class;
- a word's beginning (PREFIX letters): the continuation counts of its words, and below it the
  counts of all texts of the corpus, which both classes share. They say how frequent beginnings
  are and how a beginning's mass is dealt to its words, and so smooth rare expressions: a word
  that a class has hardly seen gets the same likelihood from both classes, unless its beginning
  is telling.

Discounts for counts of one, two, and three or more are estimated in each class and order from
the numbers of things counted once to four times. What a discount takes is what the next order
deals out, so the likelihoods of all words after a word sum to 1.

A text's log P_toxic - log P_ordinary is kept apart by order (that of single words, and what the
word before adds to it), by the size of its words' differences (BANDS) and by sign, as subject
matter and small samples make many small differences and few large ones. A score is a logistic
function of these sums over the square root of the number of words. What each sum weighs is
fitted on the labelled texts, each measured by models that leave out its own quarter of them.

Bounds: at most `per_class` labelled rows of each class are learned from, so what comes to the
driver and what is broadcast is bounded by that parameter. The shared counts are a distributed
table of all words of all texts; of it the words and beginnings of the sample come, and its
total. For other words that is enough: their shared factor is the same in both classes, so that
their ratio is their beginning's is exact.

Edge cases: a null or empty text, or one without letters, scores as a difference of 0. Rows
with a null doc_id are never held out nor learnt from. Of repeated labels of one doc_id the
highest counts, of its repeated rows the one with the least text is learnt from; labels other
than 0 and 1 are ignored. Without labels of both classes all texts get the same score. Empty tables give no rows. Only doc_id and text are read, so other
columns cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightwell.llm.common import discard, fresh, materialize, read, tidy, trim

PREFIX = 4
FOLDS = 4
MODELS = FOLDS + 1  # one without each fold, and one of all
CUT = 2
RIDGE = 0.3
CHUNK = 500_000  # characters
ROWS = 200_000  # counts that a task holds before it hands them on
BANDS = np.array([1.0, 2.0, 3.0, 4.0])  # nats; sums of differences between these are weighed apart
WIDTH = 2 * (len(BANDS) + 1)  # bands by sign
START = "^"  # no word, as words are letters
WORD = re.compile(r"[^\W\d_]+")
THRESHOLD = 0.7


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def by_band(d: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """For each of n texts the sums of d by band of |d| and by sign; text: whose each d is."""
    cell = text * WIDTH + 2 * np.searchsorted(BANDS, np.abs(d)) + (d < 0)
    return np.bincount(cell, d, n * WIDTH).reshape(n, WIDTH)


def discounts(n: list[int]) -> np.ndarray:
    """What counts of 0, 1, 2, and 3 or more lose; n: how many things were counted once, twice, three and four times."""
    y = n[0] / max(n[0] + 2 * n[1], 1)
    return np.array([0.0, *(min(max(k - (k + 1) * y * n[k] / max(n[k - 1], 1), 0.05), k - 0.05) for k in (1, 2, 3))])


def times(counts: np.ndarray) -> list[int]:
    """How many of the counts are 1, 2, 3 and 4."""
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts - d[np.minimum(counts, 3).astype(int)]


def features(model: dict, texts: list[str], which: np.ndarray) -> np.ndarray:
    """For each text: 1, and by order the differences by band over the square root of the words; which: the row of the model's tables that measures it. Some characters are looked at together, or one longer text."""
    out, a, size = np.empty((len(texts), 1 + 2 * WIDTH)), 0, 0
    for i, t in enumerate(texts):
        if i > a and size + len(t) > CHUNK:
            out[a:i] = _features(model, texts[a:i], which[a:i])
            a, size = i, 0
        size += len(t)
    if len(texts) > a:
        out[a:] = _features(model, texts[a:], which[a:])
    return out


def numbered(joined: str) -> dict[str, int]:
    return {w: i for i, w in enumerate(joined.split("\n"))} if joined else {}


def _features(model: dict, texts: list[str], which: np.ndarray) -> np.ndarray:
    for c in ("word", "begin"):
        if c not in model:
            model[c] = numbered(model[f"{c}s"])
    word, begin, unseen = model["word"].get, model["begin"].get, len(model["begin"])
    start, unknown, none = model["start"], model["start"] + 1, unseen + 1
    length, at, before, head = np.zeros(len(texts), int), [], [], []
    for i, t in enumerate(texts):
        ws = words_of(t)
        length[i] = len(ws)
        if ws:
            ids = [word(w, unknown) for w in ws]
            at += ids
            before.append(start)
            before += ids[:-1]
            head += [begin(w[:PREFIX], unseen) if k == unknown else none for w, k in zip(ws, ids, strict=True)]
    text = np.repeat(np.arange(len(texts)), length)
    at, before, row = np.array(at, np.int64), np.array(before, np.int64), which[text]
    single = model["of_word"][row, at] + model["of_begin"][row, np.array(head, np.int64)]
    pairs = model["pairs"]
    key = (before << 32) | at
    found = np.minimum(np.searchsorted(pairs, key), max(len(pairs) - 1, 0))
    hit = pairs[found] == key if len(pairs) else np.zeros(len(key), bool)
    added = model["of_context"][row, before]
    added[hit] = model["of_pair"][row[hit], found[hit]]
    sums = np.column_stack([by_band(x.astype(float), text, len(texts)) for x in (single, added)])
    return np.column_stack([np.ones(len(texts)), sums / np.sqrt(np.maximum(length, 1))[:, None]])


def scores(model: dict, texts: list[str]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features(model, texts, np.zeros(len(texts), int)) @ model["coefficients"], -500, 500)))


class Model:
    """Differences of log-likelihoods by word and by beginning, and what the word before adds to them, for each of MODELS."""

    def __init__(self) -> None:
        self.word, self.begin, self.pairs = {}, {}, np.zeros(0, np.int64)
        self.of_word, self.of_context, self.of_pair = np.zeros((MODELS, 2), np.float32), np.zeros((MODELS, 2), np.float32), np.zeros((MODELS, 0), np.float32)
        self.of_begin = np.zeros((MODELS, 2), np.float32)
        self.coefficients = np.zeros(1 + 2 * WIDTH)

    def learn(self, words: pa.Array, names: np.ndarray, follows: np.ndarray, shared: np.ndarray, heads: dict[str, int], total: int, contexts: np.ndarray, sums: np.ndarray, first: np.ndarray, second: np.ndarray, counts: np.ndarray, taken: np.ndarray) -> None:
        """words and their 64-bit names (and, last, that of START), continuation counts `follows` (2, MODELS, words) and numbers of texts `shared`; heads: the sum of these by beginning, total of all words; names of contexts (words before) with sums (2, MODELS, 2, contexts) of pair counts and of what discounts leave of them; pairs by names (first, second) with counts by fold (2, FOLDS, pairs), and taken, the pairs' discounts (2, MODELS, 4)."""
        n = len(words)
        self.word = dict(zip(words.to_pylist(), range(n), strict=True))
        coded = pc.utf8_slice_codeunits(words, 0, PREFIX).dictionary_encode()
        begins, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        self.begin = dict(zip(begins, range(len(begins)), strict=True))
        of_head = np.array([heads[b] for b in begins], float)
        within, common = shared / of_head[at], of_head / total
        by_name = np.argsort(names)
        number = lambda x: by_name[np.searchsorted(names, x, sorter=by_name)]
        before, one, two = number(contexts), number(first), number(second)
        key = (one << 32) | two
        order = np.argsort(key)
        self.pairs, one, two, counts = key[order], one[order], two[order], counts[:, :, order]
        del key, order
        whole = counts.sum(1)
        self.of_word, self.of_begin = np.zeros((MODELS, n + 2), np.float32), np.zeros((MODELS, len(begins) + 2), np.float32)
        self.of_context, self.of_pair = np.zeros((MODELS, n + 2), np.float32), np.zeros((MODELS, len(one)), np.float32)
        self.p_word, self.p_kept, self.p_left = np.zeros((2, n)), np.zeros((2, len(one))), np.ones((2, n + 2))  # of the model of all
        for j in range(MODELS):
            p, log_begin, log_unseen, left, kept = [], [], [], [], []
            for k in (0, 1):
                f = follows[k, j]
                if not f.sum():
                    return  # a class without texts: no differences at all
                w = discounted(f, discounts(times(f)))
                left_w = 1 - w.sum() / f.sum()
                b = np.bincount(at, f, len(begins)).astype(int)
                of_b = discounted(b, discounts(times(b)))
                left_b = 1 - of_b.sum() / b.sum()
                p_begin = of_b / b.sum() + left_b * common
                p.append(w / f.sum() + left_w * p_begin[at] * within)
                log_begin.append(np.log(left_w * p_begin))
                log_unseen.append(np.log(left_w * left_b))
                all_, some = np.ones(n + 2), np.ones(n + 2)
                all_[before] = np.maximum(sums[k, j, 0], 1)
                some[before] = 1 - sums[k, j, 1] / all_[before]
                left.append(some)
                c = whole[k] - counts[k, j] if j < FOLDS else whole[k]
                kept.append(np.where(c >= CUT, discounted(c, taken[k, j]), 0) / all_[one])
            self.of_word[j, :n] = np.log(p[1] / p[0])
            self.of_begin[j, :-1] = np.append(log_begin[1] - log_begin[0], log_unseen[1] - log_unseen[0])
            self.of_context[j] = np.log(left[1] / left[0])
            after = [kept[k] + left[k][one] * p[k][two] for k in (0, 1)]
            self.of_pair[j] = np.log(after[1] / after[0]) - np.log(p[1] / p[0])[two]
        self.p_word, self.p_kept, self.p_left = np.array(p), np.array(kept), np.array(left)

    def after(self, toxic: int, first: str) -> np.ndarray:
        """The likelihood of each word of the sample after a word, in one class."""
        one = self.word.get(first, len(self.word) if first == START else len(self.word) + 1)
        out = self.p_left[toxic, one] * self.p_word[toxic]
        mine = (self.pairs >> 32) == one
        out[self.pairs[mine] & 0xFFFFFFFF] += self.p_kept[toxic, mine]
        return out

    def state(self, rows: slice = slice(FOLDS, MODELS)) -> dict:
        """What scores texts: the tables of some of the models, by default that of all texts."""
        tables = {c: getattr(self, c)[rows] for c in ("of_word", "of_begin", "of_context", "of_pair")}
        # words as one text, which takes less than so many texts to send; _features makes them a dict
        return tables | {"start": len(self.word), "pairs": self.pairs, "words": "\n".join(self.word), "begins": "\n".join(self.begin), "coefficients": self.coefficients}

    def calibrate(self, x: np.ndarray, y: np.ndarray, prior: float) -> None:
        """Logistic coefficients by Newton's method with a weak prior; then moved from the sample's share of toxic texts to the labels'."""
        if len(np.unique(y)) < 2:
            return
        scale = np.maximum(x.std(0), 1e-9)
        scale[0] = 1
        z, w, ridge = x / scale, np.zeros(x.shape[1]), np.full(x.shape[1], RIDGE)
        ridge[0] = 1e-6
        for _ in range(100):
            q = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
            w -= np.clip(np.linalg.solve(z.T @ (z * (q * (1 - q))[:, None]) + np.diag(ridge), z.T @ (q - y) + ridge * w), -2, 2)
        share, prior = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)), min(max(prior, 1e-6), 1 - 1e-6)
        w[0] += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
        self.coefficients = w / scale


def shared_counts(texts: DataFrame) -> DataFrame:
    """key, n: in how many texts each word occurs; a row for all there are."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally: Counter = Counter()
        for b in batches:
            for t in b.text:
                tally.update(set(words_of(t)))
                if len(tally) > ROWS:
                    yield pd.DataFrame(list(tally.items()), columns=["key", "n"])
                    tally.clear()
        yield pd.DataFrame(list(tally.items()), columns=["key", "n"])

    return texts.select("text").mapInPandas(tidy(count), "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _count_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts by class, fold and pair of neighbours."""
    tally: Counter = Counter()
    columns = ["slot", "first", "second", "n"]
    for b in batches:
        for toxic, fold, t in zip(b.toxic, b.fold, b.text, strict=True):
            said, slot = words_of(t), int(toxic) * FOLDS + int(fold)
            tally.update((slot, u, v) for u, v in set(zip([START, *said], said, strict=False)))
            if len(tally) > ROWS:
                yield pd.DataFrame([(*k, v) for k, v in tally.items()], columns=columns)
                tally.clear()
    yield pd.DataFrame([(*k, v) for k, v in tally.items()], columns=columns)


def _of(toxic: int, model: int) -> Column:
    """A pair's texts of a class in a model: all, or those outside one fold."""
    kept = [F.col(f"c{toxic * FOLDS + f}") for f in range(FOLDS) if f != model]
    return sum(kept[1:], kept[0])


EACH = [(k, j) for k in (0, 1) for j in range(MODELS)]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 6000) -> Model:
    """Learn from at most per_class labelled rows of each class that are not held out."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id")
    pick = [known.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(per_class) for k in (0, 1)]
    # 2 * per_class rows of three small columns at most
    sample = F.broadcast(pick[0].unionAll(pick[1]).withColumn("fold", F.pmod(order, F.lit(FOLDS)).cast("int")))
    # of rows that repeat a doc_id one is learnt from; the sample's texts alone move
    found = texts.join(sample, "doc_id").groupBy("doc_id", "toxic", "fold").agg(F.min("text").alias("text"))
    chosen = materialize(found.select("toxic", "fold", "text").repartition(16), "toxic-sample")
    tally = chosen.mapInPandas(tidy(_count_pairs), "slot int, first string, second string, n long").groupBy("first", "second")
    tally = materialize(tally.agg(*(F.coalesce(F.sum(F.when(F.col("slot") == s, F.col("n"))), F.lit(0)).cast("int").alias(f"c{s}") for s in range(2 * FOLDS))), "toxic-pairs")
    model = Model()
    often = tally.agg(*(F.count(F.when(_of(k, j) == i, 1)).alias(f"{k}_{j}_{i}") for k, j in EACH for i in (1, 2, 3, 4))).first()
    taken = np.array([[discounts([often[f"{k}_{j}_{i}"] for i in (1, 2, 3, 4)]) for j in range(MODELS)] for k in (0, 1)])
    shared = materialize(shared_counts(texts), "toxic-shared")
    total = shared.agg(F.sum("n")).first()[0] or 0
    words = tally.groupBy(F.col("second").alias("key")).agg(*(F.count(F.when(_of(k, j) > 0, 1)).cast("int").alias(f"{k}_{j}") for k, j in EACH))
    words = materialize(words.join(shared, "key"), "toxic-words")
    head = F.substring("key", 1, PREFIX)
    heads = shared.groupBy(head.alias("head")).agg(F.sum("n").alias("n")).join(words.select(head.alias("head")).distinct(), "head", "left_semi").toArrow()

    def left(k: int, j: int) -> Column:
        c = _of(k, j)
        out = c - F.lit(float(taken[k, j, 3]))
        for i in range(2, 0, -1):
            out = F.when(c == i, c - F.lit(float(taken[k, j, i]))).otherwise(out)
        return F.when(c >= CUT, out).otherwise(0.0)

    sums = tally.groupBy("first").agg(*(x.alias(f"{name}_{k}_{j}") for k, j in EACH for name, x in (("all", F.sum(_of(k, j))), ("kept", F.sum(left(k, j))))))
    # words go by 64-bit names, so that the driver gets each word's text once
    name = lambda c: F.xxhash64(c).alias(c)
    # a context that the discounts leave no pair adds nothing
    sums = sums.where(F.greatest(*(F.col(f"kept_{k}_{j}") for k, j in EACH)) > 0).withColumn("first", name("first")).toArrow()
    pairs = tally.where(F.greatest(_of(0, FOLDS), _of(1, FOLDS)) >= CUT).withColumns({c: name(c) for c in ("first", "second")}).toArrow()
    start = F.xxhash64(F.lit(START))
    words = words.withColumns({"name": F.xxhash64("key"), "start": start}).toArrow()
    if words.num_rows:
        column = lambda t, c: t[c].to_numpy()
        known = words["key"].combine_chunks(), np.append(column(words, "name"), words["start"][0].as_py()), np.array([[column(words, f"{k}_{j}") for j in range(MODELS)] for k in (0, 1)]), column(words, "n").astype(float)
        del words
        before = column(sums, "first"), np.array([[[column(sums, f"{what}_{k}_{j}") for what in ("all", "kept")] for j in range(MODELS)] for k in (0, 1)], np.float64)
        del sums
        counted = column(pairs, "first"), column(pairs, "second"), np.array([[column(pairs, f"c{k * FOLDS + f}") for f in range(FOLDS)] for k in (0, 1)])
        del pairs
        model.learn(*known, dict(zip(heads["head"].to_pylist(), heads["n"].to_pylist(), strict=True)), int(total), *before, *counted, taken)
        del known, before, counted
        trim()
    sent = spark.sparkContext.broadcast(model.state(slice(0, FOLDS)))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"x": list(features(sent.value, b.text.tolist(), b.fold.to_numpy(int))), "y": b.toxic.to_numpy()})

    xy = chosen.mapInPandas(tidy(measure), "x array<double>, y int").toArrow().to_pandas()
    sent.destroy()
    if len(xy):
        model.calibrate(np.stack(xy.x), xy.y.to_numpy(float), n.get(1, 0) / max(1, sum(n.values())))
    discard(chosen, tally, shared)
    del xy
    trim()
    return model


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with the toxicity score of each text added as the last column."""
    sent = docs.sparkSession.sparkContext.broadcast(model.state())

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(scores(sent.value, t.tolist()))
        trim()

    return docs.withColumn(column, of(F.coalesce(F.col("text"), F.lit(""))))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score; labels are used to learn only, and only those not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, read(spark, sf_dir, "labels")))
    return scored.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 3 == 1).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is below the threshold, with their own columns."""
    name = fresh(docs, "toxicity")
    return score(docs, fit(docs, labels), name).where(F.col(name) < threshold).select(*docs.columns)
