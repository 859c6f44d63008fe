"""Near-duplicate documents: DartMinHash signatures of weighted word shingles, joined by bands.

A text is a weighted set: its shingles of five words, weighted by how often they occur. Its
weight axis is cut into unit cells, one for each occurrence of a shingle. Each cell is a
dartboard: from a hash of shingle and cell comes a stream of darts with growing ranks (a
Poisson process of rate 1), the same for every text that has that cell. A text keeps the darts
in its region, that is, in its cells and of rank up to t / weight, where t = k ln k + 2k darts
are expected whatever the text's length; each dart falls on one of k coordinates, and the
earliest on each coordinate is the signature. A text with a coordinate without dart doubles
its rank bound. Two signatures agree in a coordinate with the probability of the texts'
weighted Jaccard similarity. Unit cells serve here in place of dyadic regions because all
weights are counts.

Bands of 6 coordinates (each coordinate in two bands) make candidates; a pair of similarity 0.8
shares none of 40 bands with a probability of about 1e-5. Four bits of each coordinate, the
sketch, tell most candidates that are not similar from those that may be (MISS is how often a
pair at the limit is lost by that); the rest are verified exactly.

Groups are never expanded into pairs. Copies are one class from the start. In a band, classes
are compared with a leader, in a few bands first and then in all. What then still shares a band
but lies in different components is compared as follows, and no link is given up for the size
of a group:

- bands of at most SMALL classes: each pair of different components, by sketch inside the join;
- classes of larger bands: by their rarest cells. Two texts of n and m cells that are similar
  share at least o = (n + m) s / (1 + s) cells, so in any order of all cells the first n - o + 1
  of one and the first m - o + 1 of the other have one in common. Cells are ordered by how often
  the classes at hand have them (a table of SLOTS counts, hence of fixed size; any order is
  right, a rare-first order is fast). Variants of one template, which have bands in common but
  each its own changes, then have no candidates unless they share changes. Groups of one cell
  and size are compared with their leader and then, where components differ, in blocks.

Classes are named by numbers; texts are matched by two 64-bit hashes.

What the driver holds does not grow with the corpus. Beyond PLANNED classes no join is broadcast
because the planner takes a table for small: it goes by the size of compressed files, and of
rows before they are joined. Texts to be read again are found by a table of bits of fixed size,
which lets through some others that the join then drops, and few links are joined to components
by the driver, more by the executors.

Edge cases: null is an empty text; all texts without words are alike only if they are copies.
Texts of fewer than five words have one shingle of all words. class_id is the least doc_id of
a component; null doc_ids come last, so a class of nulls alone has a null class_id. Repeated
rows stay. Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import contextlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from brightwell.llm.common import U64, batches_of, discard, fresh, id_and_text, materialize, mix, prefix_hash, read, span_hash, text_key, tidy

SHINGLE = 5
SIMILAR = 0.8
K = 120
ROWS = 6
FIRST_BANDS = 6
SMALL = 64
BLOCK = 4096  # members of a group of one rare cell that are compared at once
HOT = 4096  # pairs of one leader that one task verifies
MISS = 1e-6
PLANES = 4  # bits of each coordinate in a sketch
WORDS_64 = -(-K // 64)
SLOTS = 1 << 20  # 8 MB when broadcast
GROWTH = 1.05  # of a class of sizes to the next
PLANNED = 100_000  # classes up to which the planner may broadcast what it takes for small
BROADCAST_ROWS = 50_000  # of a few numbers, some 10 MB; of more keys of texts, a table of 64 * SLOTS bits is broadcast
FEW_LINKS = 20_000  # links that the driver joins itself
PARTS = 256  # rows in which a task sends its counts of SLOTS
CHUNK = 1_500_000  # bytes of text handled at once
PAIRS, TEXTS = 200, 2000  # rows that Python gets at once: a leader's text comes again with each of its pairs


def _band_rows() -> np.ndarray:
    """Which coordinates make which band: two partitions of all coordinates."""
    return np.concatenate([np.arange(K).reshape(-1, ROWS), np.random.default_rng(5).permutation(K).reshape(-1, ROWS)])


def cells(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's index, cell) of all cells, ordered by text, and how many each text has."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(blank.view(np.int8), prepend=1)
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if start.size and end.size and end[0] < start[0]:
        end = end[1:]
    doc = np.searchsorted(np.cumsum(size), start, side="right")
    word = span_hash(prefix_hash(data), start, end)
    n_words = np.bincount(doc, minlength=len(texts))
    h = np.zeros(len(word), U64)
    for j in range(SHINGLE):
        h[: len(h) - j] = h[: len(h) - j] * U64(0xC2B2AE3D27D4EB4F) + word[j:]
    full = np.zeros(len(word), bool)
    if len(word) >= SHINGLE:
        full[: len(word) - SHINGLE + 1] = doc[: len(word) - SHINGLE + 1] == doc[SHINGLE - 1 :]
    short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    first = np.cumsum(n_words) - n_words
    of_short = np.zeros(len(short), U64)
    for j in range(SHINGLE - 1):
        has = n_words[short] > j
        of_short[has] = of_short[has] * U64(0x9E3779B97F4A7C15) + word[first[short][has] + j] + U64(1)
    owner = np.concatenate([doc[full], short])
    shingle = np.concatenate([mix(h[full]), mix(of_short)])
    order = np.lexsort((shingle, owner))
    owner, shingle = owner[order], shingle[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])
    at = np.arange(len(owner))
    times = at - np.maximum.accumulate(np.where(new, at, 0))
    return owner, mix(shingle + times.astype(U64) * U64(0x165667B19E3779F9)), np.bincount(owner, minlength=len(texts))


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> U64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


def signatures(owner: np.ndarray, cell: np.ndarray, n: np.ndarray, k: int = K) -> np.ndarray:
    """One row of k dart names for each text; texts without cells get zeros."""
    out = np.zeros((len(n), k), U64)
    expected = k * np.log(k) + 2 * k
    todo, factor = n > 0, 1.0
    while todo.any():
        name = np.cumsum(todo) - 1
        mine = todo[owner] if not todo.all() else np.ones(len(owner), bool)
        row, alive = name[owner[mine]], cell[mine]
        bound = factor * expected / n[todo]
        rank = np.zeros(len(row))
        best = np.full(int(todo.sum()) * k, np.inf)
        keys, ranks, names, throw = [], [], [], 0
        while len(row):
            throw += 1
            dart = mix(alive + U64(throw * 0xD1342543DE82EF95 & (1 << 64) - 1))
            rank = rank - np.log(_uniform(dart))
            inside = rank <= bound[row]
            row, alive, rank = row[inside], alive[inside], rank[inside]
            named = mix(dart[inside] ^ U64(0x5851F42D4C957F2D))
            key = row * k + (named % U64(k)).astype(np.int64)
            np.minimum.at(best, key, rank)
            keys.append(key)
            ranks.append(rank)
            names.append(named)
        key, rank, named = np.concatenate(keys), np.concatenate(ranks), np.concatenate(names)
        wins = rank == best[key]
        flat = np.zeros(len(best), U64)
        flat[key[wins]] = named[wins]
        at = np.flatnonzero(todo)
        out[at] = flat.reshape(-1, k)
        whole = np.isfinite(best.reshape(-1, k)).all(1)
        todo = np.zeros(len(n), bool)
        todo[at[~whole]] = True
        factor *= 2
    return out


def bands_of(signature: np.ndarray) -> np.ndarray:
    rows = _band_rows()
    out = np.zeros((len(signature), len(rows)), U64)
    for j in range(ROWS):
        out = out * U64(0x2127599BF4325C37) + signature[:, rows[:, j]]
    return mix(out + np.arange(1, len(rows) + 1, dtype=U64)).view(np.int64)


def sketches(signature: np.ndarray) -> np.ndarray:
    """The low four bits of all coordinates: a number for each bit and 64 coordinates."""
    out = np.zeros((len(signature), PLANES, WORDS_64), U64)
    for plane in range(PLANES):
        bits = signature >> U64(plane) & U64(1)
        for w in range(WORDS_64):
            part = bits[:, w * 64 : w * 64 + 64]
            out[:, plane, w] = np.bitwise_or.reduce(part << np.arange(part.shape[1], dtype=U64), axis=1)
    return out.reshape(len(signature), -1).view(np.int64)


def tolerance(similar: float) -> int:
    """In how many coordinates two sketches may differ: more is rarer than MISS at that similarity."""
    p, tail, m = (1 - similar) * (1 - 0.5**PLANES), 1.0, -1
    while tail > MISS and m < K:
        m += 1
        tail -= math.comb(K, m) * p**m * (1 - p) ** (K - m)
    return m


def differing(left: Column, right: Column) -> Column:
    """In how many coordinates two sketches differ."""
    total = F.lit(0)
    for w in range(WORDS_64):
        x = left[w].bitwiseXOR(right[w])
        for plane in range(1, PLANES):
            x = x.bitwiseOR(left[plane * WORDS_64 + w].bitwiseXOR(right[plane * WORDS_64 + w]))
        total = total + F.bit_count(x)
    return total


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    a = size = 0
    for i, t in enumerate(texts):
        if i > a and size + len(t) > CHUNK:
            yield a, i
            a, size = i, 0
        size += len(t)
    if len(texts) > a:
        yield a, len(texts)


def classes(docs: DataFrame) -> DataFrame:
    """One row for each distinct text: k1, k2, first_id, cells (how many), sketch, bands (empty if it has no words). docs: doc_id, k1, k2, text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = [t.encode("utf-8", "surrogatepass") for t in b.text]
            for a, z in _chunks(raw):
                owner, cell, n = cells(raw[a:z])
                signature = signatures(owner, cell, n)
                bands = bands_of(signature)
                keys = {"k1": b.k1.to_numpy()[a:z], "k2": b.k2.to_numpy()[a:z], "doc_id": b.doc_id.iloc[a:z].astype("Int64").array}
                yield pd.DataFrame(keys | {"cells": n, "sketch": list(sketches(signature)), "bands": [x if m else [] for x, m in zip(bands, n, strict=True)]})

    made = docs.select("k1", "k2", "doc_id", "text").mapInPandas(tidy(run), "k1 long, k2 long, doc_id long, cells long, sketch array<long>, bands array<long>")
    return made.groupBy("k1", "k2").agg(F.min("doc_id").alias("first_id"), *(F.first(c).alias(c) for c in ("cells", "sketch", "bands")))


def weighted_jaccard(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Of each pair of texts, the shared share of their cells."""
    (i, x, n), (j, y, m) = cells(left), cells(right)
    owner, cell = np.concatenate([i, j]), np.concatenate([x, y])
    order = np.lexsort((cell, owner))
    owner, cell = owner[order], cell[order]
    both = np.bincount(owner[1:][(owner[1:] == owner[:-1]) & (cell[1:] == cell[:-1])], minlength=len(left))
    return both / np.maximum(n + m - both, 1)


@F.pandas_udf(DoubleType())  # an instance, as a name would need a session when this is imported
def _similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    a, b = ([t.encode("utf-8", "surrogatepass") for t in x] for x in (left, right))
    out = np.zeros(len(a))
    at = 0
    while at < len(a):
        z, size = at, 0
        while z < len(a) and (z == at or size + len(a[z]) + len(b[z]) <= CHUNK):
            size += len(a[z]) + len(b[z])
            z += 1
        out[at:z] = weighted_jaccard(a[at:z], b[at:z])
        at = z
    return pd.Series(out)


@contextlib.contextmanager
def _unplanned(spark: SparkSession) -> Iterator[None]:
    """While this lasts, only what is marked is broadcast."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(k, None) for k in keys]
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        yield
    finally:
        for k, v in zip(keys, before, strict=True):
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _few(rows: DataFrame) -> DataFrame:
    """Written rows, marked to be broadcast if they are few."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def _among(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of docs whose k1 is one of keys, and some others: k1 picks one of 64 * SLOTS bits."""
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(k1, 58) as int))")
    told = keys.groupBy(F.col("k1").bitwiseAND(SLOTS - 1).alias("slot")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(SLOTS, np.int64)
    table[told["slot"].to_numpy()] = told["bits"].to_numpy()
    known = docs.sparkSession.sparkContext.broadcast(table)

    def has(k1: pd.Series) -> pd.Series:
        k = k1.to_numpy(np.int64).view(U64)
        return pd.Series((known.value.view(U64)[(k & U64(SLOTS - 1)).astype(np.int64)] >> (k >> U64(58)) & U64(1)).astype(bool))

    return docs.where(F.pandas_udf(has, BooleanType())("k1"))


def _texts_of(cids: DataFrame, known: DataFrame, docs: DataFrame) -> DataFrame:
    """(cid, text) of the classes cids, written. docs: doc_id, k1, k2, text."""
    wanted = materialize(known.select("cid", "k1", "k2", "first_id").join(cids, "cid", "left_semi"), "near-wanted")
    side = wanted.withColumnsRenamed({"k1": "x1", "k2": "x2"})
    if wanted.count() <= BROADCAST_ROWS:  # most texts are left where they are
        side = F.broadcast(side)
    else:
        docs = _among(docs, wanted.select("k1"))
    found = docs.join(side, (F.col("k1") == F.col("x1")) & (F.col("k2") == F.col("x2")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    texts = materialize(found.groupBy("cid").agg(F.min("text").alias("text")), "near-texts")
    discard(wanted)
    return texts


def _alike(pairs: DataFrame, known: DataFrame, similar: float) -> DataFrame:
    """Of distinct (a, b) pairs of classes, those that sizes and sketches do not rule out."""
    of = {side: known.select(F.col("cid").alias(side), F.col("cells").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}")) for side in "ab"}
    both = pairs.join(of["b"], "b").join(of["a"], "a")
    return both.where(_may_be(F.col("n_a"), F.col("n_b"), F.col("sketch_a"), F.col("sketch_b"), similar)).select("a", "b")


def _may_be(n: Column, m: Column, sketch: Column, other: Column, similar: float) -> Column:
    return (F.least(n, m) >= F.greatest(n, m) * similar) & (differing(sketch, other) <= tolerance(similar))


def linked(pairs: DataFrame, known: DataFrame, docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Of distinct (a, b) pairs of classes, those whose texts are similar. A class `a` with many pairs is dealt to several tasks."""
    cids = pairs.select(F.col("a").alias("cid")).unionAll(pairs.select(F.col("b").alias("cid"))).distinct()
    texts = _texts_of(F.broadcast(cids) if pairs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else cids, known, docs)
    hot = pairs.groupBy("a").agg(F.ceil(F.count("*") / HOT).alias("slices")).where(F.col("slices") > 1)  # a row for HOT pairs at most
    dealt = pairs.join(F.broadcast(hot), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("slices", F.lit(1))).alias("slice"))
    left = dealt.select("a", "slice").distinct().join(texts.toDF("a", "left"), "a")
    both = dealt.join(texts.toDF("b", "right"), "b").join(left, ["a", "slice"])
    with batches_of(docs.sparkSession, PAIRS):
        links = materialize(both.withColumn("s", _similarity("left", "right")).where(F.col("s") >= similar).select("a", "b"), "near-links")
    discard(texts)
    return links


def _joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes of some links, and the least class of the component of each."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    least = np.arange(len(names))
    while True:
        new = least.copy()
        np.minimum.at(new, least[u], least[v])
        np.minimum.at(new, least[v], least[u])
        new = new[new]
        if (new == least).all():
            return names, names[least]
        least = new


def connected(links: DataFrame) -> DataFrame:
    """(cid, comp): the least class of the component of each class that has a link; the driver joins a few links, of more, labels spread to neighbours and jump along their pointers."""
    if links.limit(FEW_LINKS + 1).count() <= FEW_LINKS:
        few = links.select("a", "b").toArrow()
        names, least = _joined(few["a"].to_numpy(), few["b"].to_numpy())
        made = links.sparkSession.createDataFrame(pa.table({"cid": names, "comp": least}), "cid long, comp long")
        return F.broadcast(materialize(made, "near-labels"))
    edges = materialize(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "near-edges")
    labels = materialize(edges.groupBy(F.col("u").alias("cid")).agg(F.least(F.min("v"), F.first("u")).alias("comp")), "near-labels")
    while True:
        near = edges.join(labels.select(F.col("cid").alias("v"), "comp"), "v").groupBy(F.col("u").alias("cid")).agg(F.min("comp").alias("near"))
        told = labels.join(near, "cid").select("cid", "comp", F.least("comp", "near").alias("next"))
        jump = told.join(labels.select(F.col("cid").alias("next"), F.col("comp").alias("far")), "next", "left").select("cid", F.least("next", F.coalesce("far", "next")).alias("comp"), (F.col("comp") != F.least("next", F.coalesce("far", "next"))).alias("moved"))
        new = materialize(jump, "near-labels")
        moved = new.where("moved").limit(1).count()
        discard(labels)
        labels = new
        if not moved:
            discard(edges)
            return labels.select("cid", "comp")


def shared_bands(bands: DataFrame, *by: str) -> DataFrame:
    """Of (band, cid) rows those whose band has several, with n, how many. by: further columns to keep; a band with sides needs both."""
    sizes = bands.groupBy("band").agg(F.count("*").alias("n"), *([F.min("side").alias("low"), F.max("side").alias("high")] if "side" in by else []))
    several = F.col("n") > 1
    if "side" in by:
        several &= (F.col("high") == EQUAL) | (F.col("low") != F.col("high"))
    return bands.join(sizes.where(several), "band").select("band", "cid", "n", *by)


def _led(bands: DataFrame) -> DataFrame:
    """(a, b) pairs of each band's leader with its members of other components. bands: band, cid, comp, weight.

    The leader has the greatest weight: it shares most bands with most others, as the original of a group of copies shares more with each copy than the copies share."""
    tops = bands.groupBy("band").agg(F.max(F.struct("weight", "cid", "comp")).alias("top"), (F.min("comp") != F.max("comp")).alias("mixed")).where("mixed")
    tops = tops.select(F.col("band").alias("of_band"), F.col("top.cid").alias("a"), F.col("top.comp").alias("of"))
    joined = bands.join(tops, (F.col("band") == F.col("of_band")) & (F.col("comp") != F.col("of")))
    return joined.select("a", F.col("cid").alias("b")).distinct()


def _mixed(bands: DataFrame) -> DataFrame:
    """band, size, main (its largest component) of the bands whose classes lie in different components."""
    parts = bands.groupBy("band", "comp").agg(F.count("*").alias("n"))
    sized = parts.groupBy("band").agg(F.sum("n").alias("size"), F.count("*").alias("parts"), F.max(F.struct("n", "comp")).alias("top"))
    return sized.where(F.col("parts") > 1).select("band", "size", F.col("top.comp").alias("main"))


def _crossing(bands: DataFrame, mixed: DataFrame, known: DataFrame, similar: float, rare: bool = False) -> DataFrame:
    """(a, b) pairs of a band and different components that sizes and sketches do not rule out, nor, in rare bands, sides and positions. Of a pair, one is not of the main component; a band's members are dealt to blocks, each of which meets all such ones."""
    mixed = mixed.select(F.col("band").alias("of_band"), "main", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    named = ["cid", "comp", "weight", "cells", "sketch", *(["side", "at"] if rare else [])]
    members = bands.join(mixed, F.col("band") == F.col("of_band")).drop("of_band").join(known.select("cid", "cells", "sketch"), "cid")
    others = members.where(F.col("comp") != F.col("main")).select(F.col("band").alias("of_band"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("of_block"), *(F.col(c).alias(f"of_{c}") for c in named))
    members = members.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    meet = (F.col("band") == F.col("of_band")) & (F.col("block") == F.col("of_block")) & (F.col("comp") != F.col("of_comp"))
    if rare:
        needed = F.ceil((F.col("cells") + F.col("of_cells")) * (similar / (1 + similar)) - 1e-9)
        meet &= ((F.col("side") == EQUAL) | (F.col("side") != F.col("of_side"))) & (F.least(F.col("cells") - F.col("at"), F.col("of_cells") - F.col("of_at")) >= needed)
    joined = members.join(others, meet & _may_be(F.col("cells"), F.col("of_cells"), F.col("sketch"), F.col("of_sketch"), similar))
    first = (F.col("weight") > F.col("of_weight")) | ((F.col("weight") == F.col("of_weight")) & (F.col("cid") > F.col("of_cid")))
    return joined.select(F.when(first, F.col("cid")).otherwise(F.col("of_cid")).alias("a"), F.when(first, F.col("of_cid")).otherwise(F.col("cid")).alias("b")).distinct()


SMALLER, LARGER, EQUAL = 0, 1, 2  # a text's class of sizes beside the other's


def _prefixes(owner: np.ndarray, cell: np.ndarray, n: np.ndarray, often: np.ndarray, similar: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(text's index, band, side, position): its rarest cells with its class of sizes and that of a similar text, for each such class; the first cell, in this order, that similar texts share makes a band of both."""
    order = np.lexsort((cell, often[cell & U64(len(often) - 1)], owner))
    owner, cell = owner[order], cell[order]
    at = np.arange(len(owner)) - (np.cumsum(n) - n)[owner]
    step = math.log(GROWTH)
    size_class = lambda x: np.floor(np.log(np.maximum(x, 1)) / step + 1e-9).astype(np.int64)
    own, lowest, highest = size_class(n), np.ceil(n * similar - 1e-9), np.floor(n / similar + 1e-9)
    far = math.ceil(-math.log(similar) / step) + 1
    for d in range(-far, far + 1):
        other = own + d
        least = np.maximum(lowest, np.ceil(np.exp(other * step) * (1 - 1e-9) - 1e-9))
        good = (n > 0) & (other >= size_class(lowest)) & (other <= size_class(highest)) & (least <= highest)
        shared = np.ceil((n + least) * similar / (1 + similar) - 1e-9)
        keep = np.where(good, np.maximum(n - shared + 1, 0), 0)
        mine = at < keep[owner]
        pair = np.minimum(own, other) * 4096 + np.maximum(own, other)
        side = EQUAL if d == 0 else SMALLER if d > 0 else LARGER
        yield owner[mine], mix(cell[mine] + mix(pair[owner[mine]].astype(U64) + U64(1))).view(np.int64), np.full(int(mine.sum()), side), at[mine]


def _packed(n: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(n.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int64)


def rare_bands(texts: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(band, cid, side, at): every two similar texts of (cid, text) have a band in common, on different sides or of equal classes, and as many cells from their positions on as they share."""

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(SLOTS, np.int64)
        for b in batches:
            raw = [t.encode("utf-8", "surrogatepass") for t in b.text]
            for a, z in _chunks(raw):
                n += np.bincount((cells(raw[a:z])[1] & U64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        if n.any():
            yield pd.DataFrame({"part": np.arange(PARTS), "n": [_packed(x) for x in n.reshape(PARTS, -1)]})

    def summed(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": part.part[:1], "n": [_packed(sum(_unpacked(x) for x in part.n))]})

    counted = texts.select("text").mapInPandas(tidy(slots), "part int, n binary").groupBy("part").applyInPandas(summed, "part int, n binary").toArrow()
    table = np.zeros((PARTS, SLOTS // PARTS), np.int64)
    for part, n in zip(counted["part"].to_pylist(), counted["n"].to_pylist(), strict=True):
        table[part] = _unpacked(n)
    often = texts.sparkSession.sparkContext.broadcast(table.ravel())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw, cid = [t.encode("utf-8", "surrogatepass") for t in b.text], b.cid.to_numpy()
            for a, z in _chunks(raw):
                for owner, band, side, at in _prefixes(*cells(raw[a:z]), often.value, similar):
                    yield pd.DataFrame({"band": band, "cid": cid[a:z][owner], "side": side, "at": at})

    return texts.select("cid", "text").mapInPandas(tidy(run), "band long, cid long, side int, at int")


def near_classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(k1, k2, comp, class_id, first_id): the component of each distinct text, the least doc_id of each; of more than PLANNED, marked to be sorted and merged where it is joined. docs: doc_id, k1, k2, text."""
    with batches_of(docs.sparkSession, TEXTS):
        known = materialize(classes(docs).withColumn("cid", F.monotonically_increasing_id()), "near-classes")
    if known.count() <= PLANNED:
        return _grouped(known, docs, similar)
    with _unplanned(docs.sparkSession):
        made = _grouped(known, docs, similar)
    return made.hint("merge")  # the caller's join is planned after the settings are back


def _grouped(known: DataFrame, docs: DataFrame, similar: float) -> DataFrame:
    exploded = known.select("cid", F.posexplode("bands").alias("i", "band")).select("band", "cid", (F.col("i") < FIRST_BANDS).alias("early"))
    shared = materialize(shared_bands(exploded, "early"), "near-shared")
    weights = materialize(shared.where("early").groupBy("cid").agg(F.sum("n").alias("weight")), "near-weights")
    heavy_ones = _few(weights)
    links = compared = comps = None

    def placed(bands: DataFrame) -> DataFrame:
        heavy = bands.join(heavy_ones, "cid", "left").withColumn("weight", F.coalesce("weight", F.lit(0)))
        if comps is None:
            return heavy.withColumn("comp", F.col("cid"))
        return heavy.join(comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))

    def compare(pairs: DataFrame, sketched: bool = False) -> None:
        """Adds the links among the pairs, and the components they make."""
        nonlocal links, compared, comps
        pairs = pairs if sketched else _alike(pairs, known, similar)
        pairs = materialize(pairs if compared is None else pairs.join(compared, ["a", "b"], "left_anti"), "near-pairs")
        compared = pairs if compared is None else compared.unionAll(pairs)
        if not pairs.limit(1).count():
            return
        new = linked(pairs, known, docs, similar)
        if new.limit(1).count():
            links = new if links is None else links.unionAll(new)
            comps = connected(links)

    # a few bands bring most groups together; then all bands; then what still lies apart
    compare(_led(placed(shared.where("early"))))
    compare(_led(placed(shared)))
    mixed = materialize(_mixed(placed(shared)), "near-mixed")
    few, many = mixed.where(F.col("size") <= SMALL), mixed.where(F.col("size") > SMALL)
    crowded = materialize(shared.join(many.select("band"), "band", "left_semi").select("cid").distinct(), "near-crowded")
    compare(_crossing(placed(shared), few, known, similar), sketched=True)
    if crowded.limit(1).count():
        texts = _texts_of(crowded, known, docs)
        with batches_of(docs.sparkSession, TEXTS):
            rare = materialize(shared_bands(rare_bands(texts, similar), "side", "at"), "near-rare")
        discard(texts)
        compare(_led(placed(rare)))
        compare(_crossing(placed(rare), _mixed(placed(rare)), known, similar, rare=True), sketched=True)
        discard(rare)
    discard(shared, weights, mixed, crowded)
    named = known.select("cid", "k1", "k2", "first_id")
    named = named.withColumn("comp", F.col("cid")) if comps is None else named.join(comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    class_ids = named.groupBy("comp").agg(F.min("first_id").alias("class_id"))
    out = materialize(named.join(class_ids, "comp").select("k1", "k2", "comp", "class_id", "first_id"), "near-result")
    discard(known)
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    k1, k2 = text_key(F.col("text"))
    return id_and_text(docs).select("doc_id", k1.alias("k1"), k2.alias("k2"), "text")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class."""
    docs = _keyed(read(spark, sf_dir, "documents"))
    return docs.select("doc_id", "k1", "k2").join(near_classes(docs).select("k1", "k2", "class_id"), ["k1", "k2"]).select("doc_id", "class_id")


def keep_one(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One document of each class, that with the least doc_id, with its own columns; of rows that repeat it, one."""
    k1, k2, x1, x2, kept_id = (fresh(docs, name) for name in ("k1", "k2", "x1", "x2", "kept_id"))
    first = F.min(F.struct(F.col("first_id").isNull().alias("last"), "first_id", "k1", "k2")).alias("k")
    kept = near_classes(_keyed(docs), similar).groupBy("comp").agg(first).select(F.col("k.k1").alias(x1), F.col("k.k2").alias(x2), F.col("k.first_id").alias(kept_id))
    key = text_key(F.coalesce("text", F.lit("")))
    rows = docs.withColumns({k1: key[0], k2: key[1]})
    found = rows.join(kept, (F.col(k1) == F.col(x1)) & (F.col(k2) == F.col(x2)) & F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)))
    return found.dropDuplicates([k1, k2]).select(*docs.columns)


# all pairs of texts that share a cell; links from class to class until nothing changes
OP2_SQL = f"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
texts AS (SELECT text, row_number() OVER (ORDER BY text) AS t, min(doc_id) AS first_id FROM docs GROUP BY text),
words AS (SELECT t, list_filter(regexp_split_to_array(text, '[\t\n\x0b\f\r ]+'), lambda w: w <> '') AS w FROM texts),
shingles AS (SELECT t, unnest(CASE WHEN len(w) >= {SHINGLE} THEN list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i : i + {SHINGLE - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
cells AS (SELECT t, s, row_number() OVER (PARTITION BY t, s) AS k FROM shingles),
sizes AS (SELECT t, count(*) AS n FROM cells GROUP BY t),
shared AS (SELECT a.t AS a, b.t AS b, count(*) AS n FROM cells a JOIN cells b ON a.s = b.s AND a.k = b.k AND a.t < b.t GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.t = a JOIN sizes y ON y.t = b WHERE CAST(shared.n AS DOUBLE) / (x.n + y.n - shared.n) >= {SIMILAR}),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT t AS a, t AS b FROM texts UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
classes AS (SELECT reach.a AS t, min(first_id) AS class_id FROM reach JOIN texts ON texts.t = reach.b GROUP BY 1)
SELECT doc_id, class_id FROM docs JOIN texts USING (text) JOIN classes USING (t)
"""
