"""Exact repeated substrings across documents, by prefix-free parsing.

A byte goes if some string of LENGTH bytes that covers it also starts in a document with a
smaller doc_id. A rolling hash of GRAM bytes parses each text: wherever it is least among the
LENGTH - GRAM + 1 grams of some string of LENGTH bytes, it triggers a phrase boundary. Such
triggers depend on content alone and every string of LENGTH bytes holds one, so equal strings
are cut alike in all documents, and phrases are short. The dictionary has one entry for each
distinct phrase surrounding of a trigger: the bytes of all strings of LENGTH bytes that hold
the trigger. Entries are sorted by (hashes of) trigger and surrounding and by doc_id, which
brings equal strings of the corpus together in the order of first occurrence:

1. an entry whose surrounding occurs in an earlier document is a repeat as a whole;
2. an entry whose trigger, but not surrounding, occurs elsewhere lies at the edge of a repeat.
   The strings of LENGTH bytes at such edges alone are hashed and sorted one by one, and those
   of an earlier document found.

What is left out: no suffix array of dictionary, parse or corpus is built. Sorting all suffixes
moves several times LENGTH bytes for each byte of text, while these entries move about 1.5. Of
the order that suffix arrays give, what is needed here is that equal strings lie together, the
earliest document first, and hashes dealt to buckets and sorted there give that much.

Scale: rows are compressed arrays of many entries, or blocks of texts. The number of buckets
grows with the text, slower beyond FEW, and there are no more than PARTITIONS partitions.
Entries are combined before the shuffle: a task sends one entry for each distinct trigger and
surrounding, and one mark for a trigger with several surroundings, whose strings go straight
to step 2, where they are dealt by the string's own hash. So no trigger, however frequent,
weighs more in a bucket than one entry for each task. Texts move once, texts with edges twice.
Trigger hashes have 64 bits, surroundings 48 beyond those of their trigger, strings 64.

Edge cases: a null text is empty. A null doc_id is after all others, and not before another
null. Rows that repeat a doc_id are not smaller than each other. Texts of less than LENGTH
bytes keep all. Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightwell.llm.common import U64, batches_of, discard, id_and_text, materialize, mix, prefix_hash, read, span_hash, tidy

LENGTH = 50
GRAM = 20
REACH = LENGTH - GRAM  # bytes before a trigger that a string with it can start
NULLS = 1 << 62  # doc_ids from here on stand for rows without one
CHUNK = 1_000_000  # bytes of text handled at once
FLUSH = 1_500_000  # entries combined at once
BUCKET_BYTES, MOST_BYTES = 4_000_000, 64_000_000  # of text to a bucket, as long as there are no more than FEW; and at most
FEW, PARTITIONS = 4096, 20_000
PACK_BYTES, HELD_BYTES = 1_000_000, 64_000_000  # of texts that travel as one, and that a task holds
BLOCKS = 200  # rows that Python gets at once where a row is many texts
LOW48 = U64((1 << 48) - 1)
MARK = U64(1 << 48)  # in place of a surrounding: the trigger has several


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 64-bit integers as compressed byte planes; the first is sorted and kept as differences."""
    first = np.diff(arrays[0].astype(U64), prepend=U64(0))
    planes = [np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T) for x in (first, *arrays[1:])]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in planes))


def unpack(data: bytes, n: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(n, 8, -1)
    out = [np.ascontiguousarray(p.T).view(np.int64).ravel() for p in raw]
    out[0] = np.cumsum(out[0].view(U64), dtype=U64).view(np.int64)
    return out


def pack_texts(ids: list[int], texts: list[bytes]) -> bytes:
    """Documents as one compressed block: ids, lengths, bytes."""
    head = np.array([ids, [len(t) for t in texts]], np.int64)
    return zstandard.ZstdCompressor(level=3).compress(head.tobytes() + b"".join(texts))


def unpack_texts(data: bytes, n: int) -> tuple[np.ndarray, list[bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    ids, size = np.frombuffer(raw, np.int64, 2 * n).reshape(2, n)
    end = 16 * n + np.cumsum(size)
    return ids, [raw[z - m : z] for z, m in zip(end.tolist(), size.tolist(), strict=True)]


def _slide(x: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """f over x[i : i + width] at each i that has as many."""
    out, have = x, 1
    while have * 2 <= width:
        out = f(out[:-have], out[have:])
        have *= 2
    return f(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


class Parse:
    """The triggers of some texts, all of LENGTH bytes or more."""

    def __init__(self, texts: list[bytes]) -> None:
        data = np.frombuffer(b"".join(texts), np.uint8)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.end = np.cumsum(size)
        self.start = self.end - size
        self.prefix = prefix_hash(data)
        n = len(data)
        gram = span_hash(self.prefix, np.arange(n - GRAM + 1), np.arange(GRAM, n + 1)) | U64(1)
        least = _slide(gram, REACH + 1, np.minimum)  # of the string that starts at each byte
        within = np.zeros(n - LENGTH + 2, np.int8)
        np.add.at(within, self.start, 1)
        np.add.at(within, self.end - LENGTH + 1, -1)
        least[np.cumsum(within[:-1]) == 0] = 0  # strings that cross a document's end
        padded = np.concatenate([np.zeros(REACH, U64), least, np.zeros(REACH, U64)])
        self.at = np.flatnonzero(_slide(padded, REACH + 1, np.maximum)[: len(gram)] == gram)
        self.doc = np.searchsorted(self.end, self.at, side="right")
        self.key = mix(gram[self.at])
        left = np.maximum(self.at - REACH, self.start[self.doc])
        right = np.minimum(self.at + LENGTH, self.end[self.doc])
        around = span_hash(self.prefix, left, right) + (self.at - left).astype(U64) * U64(0xA0761D6478BD642F)
        self.around = mix(around) & LOW48

    def strings(self, which: np.ndarray) -> np.ndarray:
        """Starts of the strings that hold the triggers `which`."""
        n = int(self.end[-1])
        edge = np.zeros(n + 1, np.int32)
        at, doc = self.at[which], self.doc[which]
        lo, hi = np.maximum(at - REACH, self.start[doc]), np.minimum(at, self.end[doc] - LENGTH)
        good = lo <= hi
        np.add.at(edge, lo[good], 1)
        np.add.at(edge, hi[good] + 1, -1)
        return np.flatnonzero(np.cumsum(edge[:-1]) > 0)


def _rank(doc: np.ndarray) -> np.ndarray:
    return np.minimum(doc, NULLS)


def _runs(*sorted_: np.ndarray) -> np.ndarray:
    """Index of the first member of each one's group."""
    new = np.ones(len(sorted_[0]), bool)
    for k, x in enumerate(sorted_):
        d = x[1:] != x[:-1]
        new[1:] = d if k == 0 else new[1:] | d
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def combine(key: np.ndarray, around: np.ndarray, doc: np.ndarray, final: bool) -> tuple:
    """Sorts entries and decides those that can be. Returns (what to send on: key, around, doc), (doc, around) of whole repeats, (doc, around) at edges."""
    order = np.lexsort((_rank(doc), around, key))
    key, around, doc = key[order], around[order], doc[order]
    if not len(key):
        return (key, around, doc), (doc, around), (doc, around)
    first = _runs(key, around)
    mark = around == MARK
    repeat = (_rank(doc) > _rank(doc[first])) & ~mark
    lead = (first == np.arange(len(key))) | ((_rank(doc) == _rank(doc[first])) & (doc != doc[first]))
    whole = doc[repeat], around[repeat]
    k, a, d, m = key[lead], around[lead], doc[lead], mark[lead]
    head = _runs(k)
    group = np.cumsum(head == np.arange(len(k))) - 1
    n = group[-1] + 1
    r = _rank(d)
    several_docs = np.maximum.reduceat(r, np.flatnonzero(head == np.arange(len(k)))) > np.minimum.reduceat(r, np.flatnonzero(head == np.arange(len(k))))
    several_around = np.bincount(group[_runs(k, a) == np.arange(len(k))], minlength=n) > 1
    marked = np.bincount(group, m, n) > 0
    # a whole repeat has an earlier document beside the lead's
    split = (marked | several_around & several_docs)[group]
    edge = split & ~m
    at_edge = d[edge], a[edge]
    if final:
        return (k[:0], a[:0], d[:0]), whole, at_edge
    heads = np.flatnonzero((head == np.arange(len(k))) & split)
    keep = ~split
    return (np.concatenate([k[keep], k[heads]]), np.concatenate([a[keep], np.full(len(heads), MARK)]), np.concatenate([d[keep], d[heads]])), whole, at_edge


def _dealt(kind: int, bucket: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
    """(route, kind, n, data): one row for each bucket, its entries sorted by the first array."""
    if not len(bucket):
        return
    order = np.lexsort((arrays[0], bucket))
    bucket = bucket[order]
    arrays = tuple(x[order] for x in arrays)
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, z in zip(cut, [*cut[1:], len(bucket)], strict=True):
        yield int(bucket[a]), kind, len(arrays), pack(*(x[a:z] for x in arrays))


def _bucket(hashed: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashed >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def _home(doc: np.ndarray, buckets: int) -> np.ndarray:
    return _bucket(mix(doc.astype(np.int64).view(U64)), buckets)


def _chunks(texts: list[bytes]) -> Iterator[list[int]]:
    """Indexes of texts that can hold a string, some bytes at a time."""
    part, size = [], 0
    for i, t in enumerate(texts):
        if len(t) < LENGTH:
            continue
        if part and size + len(t) > CHUNK:
            yield part
            part, size = [], 0
        part.append(i)
        size += len(t)
    if part:
        yield part


ENTRY, WHOLE, EDGE, TEXT = 0, 1, 2, 9
ROWS = "route int, kind int, width int, data binary"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["route", "kind", "width", "data"])


def _raw(texts: pd.Series) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts]


def _entries(buckets: int):
    """Texts to dictionary entries by trigger, and what is decided on the way by document."""

    def flush(have: list[list[np.ndarray]]) -> pd.DataFrame:
        key, around, doc = (np.concatenate(x) for x in zip(*have, strict=True))
        have.clear()
        sent, whole, edge = combine(key, around, doc, final=False)
        rows = list(_dealt(ENTRY, _bucket(sent[0], buckets), sent[0], sent[1], sent[2]))
        for kind, (d, a) in ((WHOLE, whole), (EDGE, edge)):
            rows += _dealt(kind, _home(d, buckets), a, d)
        return _frame(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have, n = [], 0
        for b in batches:
            texts, ids = _raw(b.text), b.doc.to_numpy()
            for part in _chunks(texts):
                p = Parse([texts[i] for i in part])
                have.append([p.key, p.around, ids[part][p.doc]])
                n += len(p.at)
                if n > FLUSH:
                    yield flush(have)
                    n = 0
        if have:
            yield flush(have)

    return run


def _by_route(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """Rows of one route at a time, from rows sorted by route; a route may come in several parts only if `batches` splits it."""
    for b in batches:
        for route, part in b.groupby("route", sort=False):
            yield int(route), part


def _sorted_reduce(decide, buckets: int):
    """Gathers the entries of each route and lets `decide` see them whole; decisions pass through."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        route, have, done, n = None, [], {WHOLE: [], EDGE: []}, 0

        def close() -> int:
            if not have:
                return 0
            out = decide(*(np.concatenate(x) for x in zip(*have, strict=True)))
            have.clear()
            for kind, (d, a) in out:
                done[kind].append((d, a))
            return sum(len(d) for _, (d, _) in out)

        def flush() -> pd.DataFrame:
            rows = []
            for kind, parts in done.items():
                if parts:
                    d, a = (np.concatenate(x) for x in zip(*parts, strict=True))
                    rows += _dealt(kind, _home(d, buckets), a, d)
                    parts.clear()
            return _frame(rows)

        for at, part in _by_route(batches):
            if at != route:
                n += close()
                route = at
                if n > FLUSH:
                    yield flush()
                    n = 0
            for kind, width, data in zip(part.kind, part.width, part.data, strict=True):
                arrays = unpack(data, int(width))
                if kind == ENTRY:
                    have.append(arrays)
                else:
                    done[kind].append((arrays[1], arrays[0].view(U64)))
                    n += len(arrays[0])
        close()
        yield flush()

    return run


def _decide_entries(key: np.ndarray, around: np.ndarray, doc: np.ndarray) -> list:
    _, whole, edge = combine(key.view(U64), around.view(U64), doc, final=True)
    return [(WHOLE, whole), (EDGE, edge)]


def _first_docs(string: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((_rank(doc), string))
    string, doc = string[order], doc[order]
    return string, doc, (_rank(doc) > _rank(doc[_runs(string)])) if len(string) else np.zeros(0, bool)


def _decide_strings(string: np.ndarray, doc: np.ndarray) -> list:
    string, doc, later = _first_docs(string.view(U64), doc)
    return [(WHOLE, (doc[later], string[later]))]


class _Known:
    """Decisions of one route, by document."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> None:
        a, d = (np.concatenate(x) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(d, kind="stable")
        self.doc, self.value = d[order], a[order].view(U64)

    def of(self, doc: int) -> np.ndarray:
        a, z = np.searchsorted(self.doc, [doc, doc + 1])
        return self.value[a:z]


def _result(text: bytes, covered: np.ndarray | None) -> tuple[int, int, int, str]:
    """n_bytes, n_removed, n_spans, kept_sha256; covered: which bytes go."""
    if covered is None or not covered.any():
        return len(text), 0, 0, hashlib.sha256(text).hexdigest()
    kept = np.frombuffer(text, np.uint8)[~covered]
    return len(text), int(covered.sum()), int((np.diff(covered.view(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept.tobytes()).hexdigest()


def _cover(starts: np.ndarray, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + LENGTH, -1)
    return np.cumsum(edge[:-1]) > 0


DONE, PENDING, STRINGS = 0, 1, 2
PASS = "kind int, route int, width int, data binary, starts binary, doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
PASS_COLUMNS = [c.split()[0] for c in PASS.split(", ")]


def _passed(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=PASS_COLUMNS)
    return out.astype({c: "Int64" for c in ("route", "width", "doc", "n_bytes", "n_removed", "n_spans")})


def _apply_entries(buckets: int):
    """Texts with the decisions on their entries: a result, or at edges the strings to be looked up."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have, n = [], 0

        def flush() -> list[tuple]:
            string, doc = (np.concatenate(x) for x in zip(*have, strict=True))
            have.clear()
            string, doc, later = _first_docs(string, doc)
            # a later document of this task is decided here; the earliest is sent on
            rows = [(STRINGS, r, w, data, *[None] * 6) for r, _, w, data in _dealt(WHOLE, _home(doc[later], buckets), string[later], doc[later])]
            decided = [(*x[:2], -x[2], *x[3:]) for x in rows]  # a negative width: decided
            return decided + [(STRINGS, r, w, data, *[None] * 6) for r, _, w, data in _dealt(ENTRY, _bucket(string[~later], buckets), string[~later], doc[~later])]

        for route, known, ids, texts, _ in _with_known(batches):
            rows, touched = [], []
            for i, d in enumerate(ids):
                if len(texts[i]) >= LENGTH and (len(known[WHOLE].of(d)) or len(known[EDGE].of(d))):
                    touched.append(i)
                else:
                    rows.append((DONE, *[None] * 4, d, *_result(texts[i], None)))
            wait: list[tuple[int, bytes, np.ndarray]] = []
            for chunk in _chunks([texts[i] for i in touched]):
                part_of = [touched[i] for i in chunk]
                p = Parse([texts[i] for i in part_of])
                bounds = np.searchsorted(p.doc, np.arange(len(part_of) + 1))
                whole, edge = np.zeros(len(p.at), bool), np.zeros(len(p.at), bool)
                for j, i in enumerate(part_of):
                    mine = slice(bounds[j], bounds[j + 1])
                    whole[mine] = np.isin(p.around[mine], known[WHOLE].of(ids[i]))
                    edge[mine] = np.isin(p.around[mine], known[EDGE].of(ids[i]))
                starts = p.strings(np.flatnonzero(whole))
                open_ = np.setdiff1d(p.strings(np.flatnonzero(edge & ~whole)), starts, assume_unique=True)
                a, b = np.searchsorted(starts, p.start), np.searchsorted(starts, p.end)
                c, e = np.searchsorted(open_, p.start), np.searchsorted(open_, p.end)
                strings = span_hash(p.prefix, open_, open_ + LENGTH)
                for j, i in enumerate(part_of):
                    own = starts[a[j] : b[j]] - p.start[j]
                    if c[j] == e[j]:
                        rows.append((DONE, *[None] * 4, ids[i], *_result(texts[i], _cover(own, len(texts[i])))))
                    else:
                        wait.append((ids[i], texts[i], own))
                        s = np.unique(strings[c[j] : e[j]])
                        have.append((s, np.full(len(s), ids[i])))
                        n += len(s)
                if n > FLUSH:
                    rows += flush()
                    n = 0
            if wait:
                starts = pack(np.concatenate([np.full(len(o), k) for k, (_, _, o) in enumerate(wait)]), np.concatenate([o for _, _, o in wait])) if any(len(o) for _, _, o in wait) else None
                rows.append((PENDING, route, len(wait), pack_texts([d for d, _, _ in wait], [t for _, t, _ in wait]), starts, *[None] * 5))
            yield _passed(rows)
        if have:
            yield _passed(flush())

    return run


def _with_known(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, dict[int, _Known], np.ndarray, list[bytes], np.ndarray]]:
    """Texts of one route (route, its decisions, ids, texts, starts by text); decisions come first."""
    route, rows, known = None, {WHOLE: [], EDGE: []}, None
    for at, part in _by_route(batches):
        if at != route:
            route, rows, known = at, {WHOLE: [], EDGE: []}, None
        told = part[part.kind != TEXT]
        for kind, width, data in zip(told.kind, told.width, told.data, strict=True):
            rows[kind].append(unpack(data, int(width)))
        blocks = part[part.kind == TEXT]
        if not len(blocks):
            continue
        if known is None:
            known = {k: _Known([(a, d) for a, d in v]) for k, v in rows.items()}
        ids, texts, starts = [], [], [np.zeros((2, 0), np.int64)]
        for width, data, own in zip(blocks.width, blocks.data, blocks.starts, strict=True):
            if own is not None:
                starts.append(np.array(unpack(own, 2)) + [[len(texts)], [0]])
            more = unpack_texts(data, int(width))
            ids.append(more[0])
            texts += more[1]
        yield at, known, np.concatenate(ids), texts, np.concatenate(starts, 1)


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pending texts with the strings that occur earlier."""
    for _, known, ids, texts, starts in _with_known(batches):
        out = []
        which, place = starts
        bounds = np.searchsorted(which, np.arange(len(ids) + 1))
        for i, (doc, raw) in enumerate(zip(ids.tolist(), texts, strict=True)):
            own, later = place[bounds[i] : bounds[i + 1]], known[WHOLE].of(doc)
            if len(later):
                at = np.arange(len(raw) - LENGTH + 1)
                hashed = span_hash(prefix_hash(np.frombuffer(raw, np.uint8)), at, at + LENGTH)
                own = np.union1d(own, at[np.isin(hashed, later)])
            out.append((doc, *_result(raw, _cover(own, len(raw)))))
        yield pd.DataFrame(out, columns=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _homes(buckets: int):
    """Texts to blocks by route: those of one route together, however few a batch brings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have: dict[int, tuple[list[int], list[bytes]]] = {}
        size: Counter = Counter()

        def block(r: int) -> tuple[int, int, int, bytes]:
            ids, texts = have.pop(r)
            size.pop(r)
            return r, TEXT, len(ids), pack_texts(ids, texts)

        for b in batches:
            ids, ready = b.doc.to_numpy(np.int64), []
            for r, d, t in zip(_home(ids, buckets).tolist(), ids.tolist(), _raw(b.text), strict=True):
                mine = have.setdefault(r, ([], []))
                mine[0].append(d)
                mine[1].append(t)
                size[r] += len(t)
                if size[r] > PACK_BYTES:
                    ready.append(block(r))
            if size.total() > HELD_BYTES:
                ready += [block(r) for r in list(have)]
            if ready:
                yield _frame(ready)
        yield _frame([block(r) for r in list(have)])

    return run


def buckets_of(total: int) -> int:
    """How many buckets so many bytes of text are dealt to; beyond FEW, a bucket grows before their number does."""
    return max(16, min(total // BUCKET_BYTES, max(FEW, total // MOST_BYTES)))


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of docs (doc_id, text)."""
    nulls = F.lit(NULLS) + F.pmod(F.xxhash64("text"), F.lit(NULLS))
    docs = id_and_text(docs).select(F.coalesce("doc_id", nulls).alias("doc"), "text")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    buckets = buckets_of(int(total))
    partitions = min(buckets, PARTITIONS)  # a partition holds some buckets, one after the other
    nothing = F.lit(None).cast("binary").alias("starts")

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(partitions, "route").sortWithinPartitions("route", "kind")

    # decisions are written before texts move, so the files of the two shuffles need not exist at once
    decided = materialize(dealt(docs.mapInPandas(tidy(_entries(buckets)), ROWS)).mapInPandas(tidy(_sorted_reduce(_decide_entries, buckets)), ROWS), "suffix-decided")
    texts = docs.mapInPandas(tidy(_homes(buckets)), ROWS)
    with batches_of(docs.sparkSession, BLOCKS):
        passed = materialize(dealt(texts.unionAll(decided).select("*", nothing)).mapInPandas(tidy(_apply_entries(buckets)), PASS), "suffix-pass")
        discard(decided)
        strings = passed.where(F.col("kind") == STRINGS).select("route", F.when(F.col("width") < 0, WHOLE).otherwise(ENTRY).alias("kind"), F.abs("width").alias("width"), "data")
        later = materialize(dealt(strings).mapInPandas(tidy(_sorted_reduce(_decide_strings, buckets)), ROWS), "suffix-later")
        pending = passed.where(F.col("kind") == PENDING).select("route", F.lit(TEXT).alias("kind"), "width", "data", "starts")
        finished = dealt(pending.unionAll(later.select("*", nothing))).mapInPandas(tidy(_finish), "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
        done = passed.where(F.col("kind") == DONE).select(*finished.columns)
        result = materialize(done.unionAll(finished), "suffix-result")
        discard(passed, later)
    return result.select(F.when(F.col("doc") < NULLS, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(read(spark, sf_dir, "documents"))


OP8_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, coalesce(doc_id, {NULLS}) AS rank, hex(encode(coalesce(text, ''))) AS x FROM documents),
strings AS (SELECT k, rank, i, substr(x, 2 * i + 1, {2 * LENGTH}) AS s FROM (SELECT k, rank, x, unnest(range(0, len(x) // 2 - {LENGTH - 1})) AS i FROM docs)),
first AS (SELECT s, min(rank) AS rank FROM strings GROUP BY s HAVING min(rank) < max(rank)),
starts AS (SELECT k, i FROM strings JOIN first USING (s) WHERE first.rank < strings.rank),
bytes AS (SELECT k, p, substr(x, 2 * p + 1, 2) AS byte FROM (SELECT k, x, unnest(range(0, len(x) // 2)) AS p FROM docs WHERE k IN (SELECT k FROM starts))),
marked AS (SELECT bytes.*, max(CASE WHEN i IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY bytes.k ORDER BY p ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW) AS gone FROM bytes LEFT JOIN starts ON starts.k = bytes.k AND starts.i = bytes.p),
edges AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY k ORDER BY p), 0) = 0 AS opens FROM marked),
cut AS (SELECT k, sum(gone) AS n_removed, count(*) FILTER (opens) AS n_spans, sha256(unhex(coalesce(string_agg(byte, '' ORDER BY p) FILTER (gone = 0), ''))) AS kept FROM edges GROUP BY k)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, coalesce(kept, sha256(unhex(x))) AS kept_sha256 FROM docs LEFT JOIN cut USING (k)
"""
