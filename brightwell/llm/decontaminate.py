"""Benchmark decontamination: pigeonhole pieces find candidates, Myers' bit-parallel distance verifies.

A text is contaminated by an item if some stretch of it is within `budget` edits of the item,
both in normal form (lower case, runs of white space as one blank). An item is split into
budget + 1 pieces of nearly equal length: of any stretch within the budget, one piece at least
is unharmed. One Aho-Corasick pass over a text finds all pieces of all items; around each hit
Myers' algorithm finds the least edit distance of the item to any stretch there. The budget is
`rate` of the item's length, less if pieces would be shorter than `min_piece` characters; an
item that is shorter than that must occur exactly.

Scale: items are the stated query set. They go out in blocks of at most `block_chars`, each
block with one pass over the texts; beyond one block, the matches of a block are written and its
broadcast is destroyed before the next is sent, so neither driver nor workers hold more than
one. Texts are never moved: a text yields its matches where it is read.

Edge cases: null texts and items are empty; an item without a letter or digit matches nothing.
Repeated items or documents give repeated rows. Matches are the best one of each pair of text
and item (of equal distances, the one that ends first). Spans count characters of the normal form.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightwell.llm.common import fresh, id_and_text, materialize, read, text_key, trim

RATE = 0.08
MIN_PIECE = 12
BLOCK_CHARS = 4_000_000
BROADCAST_TEXTS = 100_000  # 16 bytes each
MATCHES = "array<struct<item_id: bigint, distance: int, end: int>>"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget_of(length: int, rate: float = RATE, min_piece: int = MIN_PIECE) -> int:
    return max(0, min(int(length * rate), length // min_piece - 1))


def pieces_of(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 pieces that cover the item."""
    cut = [round(i * len(item) / (budget + 1)) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(peq: dict[str, int], m: int, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the stretch of text nearest to the pattern, if within most edits; the first of equals."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, distance, best = full, 0, m, None
    for i, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            distance += 1
        elif mh & top:
            distance -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if distance <= most and (best is None or distance < best[0]):
            best = (distance, i + 1)
            if not distance:
                break
    return best


class Matcher:
    """One block of items: [(item_id, text)], compiled once in each Python worker."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float = RATE, min_piece: int = MIN_PIECE) -> None:
        import ahocorasick

        self.items, by_piece = [], {}
        for item_id, text in items:
            n = normal(text)
            if any(c.isalnum() for c in n):
                k = budget_of(len(n), rate, min_piece)
                for offset, piece in pieces_of(n, k):
                    by_piece.setdefault(piece, []).append((len(self.items), offset))
                self.items.append((item_id, n, k, masks(n)))
        self.automaton = ahocorasick.Automaton()
        for piece, where in by_piece.items():
            self.automaton.add_word(piece, (len(piece), where))
        if by_piece:
            self.automaton.make_automaton()

    def __call__(self, text: str | None) -> list[tuple[int | None, int, int]]:
        t = normal(text)
        if not t or not self.items:
            return []
        windows: dict[int, list[list[int]]] = {}
        for last, (length, where) in self.automaton.iter(t):
            for i, offset in where:
                _, n, k, _ = self.items[i]
                start = last + 1 - length - offset
                lo, hi = max(0, start - k), min(len(t), start + len(n) + k)
                mine = windows.setdefault(i, [])
                if mine and lo <= mine[-1][1] and lo >= mine[-1][0]:
                    mine[-1][1] = max(mine[-1][1], hi)
                else:
                    mine.append([lo, hi])
        found = []
        for i, spans in windows.items():
            item_id, n, k, peq = self.items[i]
            best = None
            for lo, hi in spans:
                got = myers(peq, len(n), t[lo:hi], k if best is None else best[0] - 1)
                if got:
                    best = (got[0], lo + got[1])
                    if not got[0]:
                        break
            if best:
                found.append((item_id, *best))
        return found


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[int | None, str]]]:
    block, chars = [], 0
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).toLocalIterator():
        if block and chars + len(r["text"]) > block_chars:
            yield block
            block, chars = [], 0
        block.append((r["item_id"], r["text"]))
        chars += len(r["text"])
    if block:
        yield block


def _matches(sent: Broadcast):
    @F.pandas_udf(MATCHES)
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        match = Matcher(*sent.value)
        for t in texts:
            yield pd.Series([[{"item_id": i, "distance": d, "end": e} for i, d, e in match(x)] for x in t])
        del match
        trim()

    return of


def matches(docs: DataFrame, items: DataFrame, keep: list[str], rate: float = RATE, min_piece: int = MIN_PIECE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """keep, item_id, distance, end: a row for each text of docs and item found in it."""
    blocks, out, sent = _blocks(items, block_chars), None, None
    name = fresh(docs, "found")
    block = next(blocks, [])
    while True:
        following = next(blocks, None)
        sent = docs.sparkSession.sparkContext.broadcast((block, rate, min_piece))
        found = docs.select(*keep, _matches(sent)(F.coalesce(F.col("text"), F.lit(""))).alias(name)).where(F.size(name) > 0)
        found = found.select(*keep, F.explode(name).alias(name)).select(*keep, f"{name}.*")
        if out is None and following is None:
            return found
        found = materialize(found, "leak-matches")
        sent.destroy()
        out = found if out is None else out.unionAll(found)
        if following is None:
            return out
        block = following


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, distance, end) for each document and benchmark item that match."""
    return matches(id_and_text(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"), ["doc_id"])


def drop_contaminated(docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents in which no item is found, with their own columns.

    With one block of items a document is judged where it is read. With more, the texts found are named by 128 bits and their documents left out; few texts are expected to be, and their names are broadcast only if counted to be few."""
    blocks = _blocks(items, block_chars)
    block, more = next(blocks, []), next(blocks, None)
    if more is None:
        found = _matches(docs.sparkSession.sparkContext.broadcast((block, RATE, MIN_PIECE)))
        return docs.where(F.size(found(F.coalesce(F.col("text"), F.lit("")))) == 0)
    blocks.close()
    key = text_key(F.coalesce("text", F.lit("")))
    named = docs.select("text", key[0].alias("x1"), key[1].alias("x2"))
    bad = materialize(matches(named, items, ["x1", "x2"], block_chars=block_chars).select("x1", "x2").distinct(), "leak-texts")
    few = bad.count() <= BROADCAST_TEXTS
    return docs.join(F.broadcast(bad) if few else bad, (key[0] == F.col("x1")) & (key[1] == F.col("x2")), "left_anti")
