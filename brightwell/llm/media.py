"""Media columns: baseline JPEG written and read in numpy, with thumbnails from DC coefficients.

`decode` parses the markers of a baseline JPEG (quantisation and Huffman tables, frame, scan,
restart interval), decodes the entropy-coded scan and keeps the DC coefficient of every
luminance block: a thumbnail of one pixel a block. AC coefficients are read past. Chroma,
subsampling and scans of single components are handled; several frames in one stream are
several images.

Decoding runs in lock step. Restart markers cut a scan into intervals that need nothing from
each other, so all intervals of a batch of images are lanes of one numpy loop that advances a
block at a time. Where the code of a DC difference, its bits and the end-of-block code fit in
16 bits, one table lookup reads a whole block; other blocks are read symbol by symbol.

`encode` is the lossless store of a payload: each byte is the DC level of one block (quantiser
8, so a block of byte b decodes to luminance b), no AC, restart every 96 blocks. A frame is 24
blocks wide; payloads of more than FRAME bytes become several frames in one stream.

Edge cases: a null text is empty and stored as one row of padding; equal texts give equal
values; a damaged or non-baseline stream raises ValueError in `decode` and gives null columns
in `thumbnails`. Only the named columns are read. Long payloads are cut at frames and batches
are bounded by payload bytes, so memory does not grow with a text beyond its own size.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightwell.llm.common import id_and_text, read

UNIT = 576  # bytes: 24 x 24 blocks
WIDE = 24  # blocks in a row
FRAME = 340 * UNIT  # 24 x 8160 blocks, within the 65535 pixels of a side
RESTART = 96  # blocks between restart markers
BATCH = 2_000_000  # payload bytes handled at once
# lengths of the codes of DC categories 0 to 11 in our streams, and one AC code for end of block
DC_LENGTHS = (3, 3, 3, 3, 3, 4, 4, 4, 5, 6, 7, 8)
# zigzag order is not needed: only coefficient 0 is kept


def _canonical(counts: list[int], symbols: list[int]) -> list[tuple[int, int, int]]:
    """(code, length, symbol) of a JPEG Huffman table."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((code, length, symbols[at]))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _lookup(codes: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Length and symbol by the next 16 bits; length 0 where no code begins so."""
    length, symbol = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for code, n, s in codes:
        a = code << 16 - n
        length[a : a + (1 << 16 - n)], symbol[a : a + (1 << 16 - n)] = n, s
    return length, symbol


def _extend(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The signed value of `size` magnitude bits."""
    return np.where((size > 0) & (bits < (1 << np.maximum(size - 1, 0))), bits - (1 << size) + 1, bits)


def _block_table(dc: tuple[np.ndarray, np.ndarray], ac: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bits used (0: too long for one lookup) and DC difference of a block without AC, by its first 16 bits."""
    w = np.arange(1 << 16)
    n, size = dc[0][w], dc[1][w]
    bits = (w >> np.maximum(16 - n - size, 0)) & ((1 << size) - 1)
    rest = (w << np.minimum(n + size, 16)) & 0xFFFF
    end, kind = ac[0][rest], ac[1][rest]
    total = n + size + end
    fits = (n > 0) & (n + size < 16) & (end > 0) & (kind == 0) & (total <= 16)
    return np.where(fits, total, 0), _extend(bits, size)


@cache
def _own_tables() -> tuple[bytes, np.ndarray, np.ndarray]:
    """Our Huffman tables, and by DC difference + 255 all bits of a block and how many they are."""
    counts = [DC_LENGTHS.count(n) for n in range(1, 17)]
    codes = {s: (c, n) for c, n, s in _canonical(counts, list(range(12)))}
    dht = bytes([0x00, *counts, *range(12)]) + bytes([0x10, 1, *[0] * 15, 0])
    word, used = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for diff in range(-255, 256):
        size = abs(diff).bit_length()
        code, length = codes[size]
        bits = diff + (1 << size) - 1 if diff < 0 else diff
        word[diff + 255], used[diff + 255] = (code << size | bits) << 1, length + size + 1  # the end of block is one 0 bit
    return dht, word, used


@cache
def _header(rows: int) -> bytes:
    segment = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
    out = b"\xff\xd8" + segment(0xDB, bytes([0]) + bytes([8] * 64))
    out += segment(0xC0, struct.pack(">BHHB", 8, rows * 8, WIDE * 8, 1) + bytes([1, 0x11, 0])) + segment(0xC4, _own_tables()[0])
    return out + segment(0xDD, struct.pack(">H", RESTART)) + segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


RST = [bytes([0xFF, 0xD0 + i]) for i in range(8)]


def encode(payloads: list[bytes]) -> list[bytes]:
    """One JPEG stream for each payload; their lengths are positive multiples of UNIT."""
    frames = [(i, p[a : a + FRAME]) for i, p in enumerate(payloads) for a in range(0, len(p), FRAME)]
    level = np.frombuffer(b"".join(f for _, f in frames), np.uint8).astype(np.int64) - 128
    lane = np.arange(len(level)) % RESTART  # UNIT is a multiple of RESTART, so lanes start afresh with each frame
    diff = np.diff(level, prepend=0)
    diff[lane == 0] = level[lane == 0]
    diff += 255
    _, words, lengths = _own_tables()
    word, used = words[diff], lengths[diff].reshape(-1, RESTART)
    total = used.sum(1)
    n_bytes = (total + 7) // 8
    start = np.cumsum(n_bytes) - n_bytes
    at = (np.cumsum(used, 1) - used + start[:, None] * 8).ravel()
    used = used.ravel()
    word <<= 24 - used - (at & 7)
    out = np.zeros(int(n_bytes.sum()) + 3, np.float64)
    for k in range(3):
        out += np.bincount((at >> 3) + k, (word >> 16 - 8 * k) & 255, len(out))
    packed = out[:-3].astype(np.uint8)
    packed[start + n_bytes - 1] |= ((1 << (n_bytes * 8 - total)) - 1).astype(np.uint8)  # ones fill the last byte
    raw, ends = packed.tobytes(), (start + n_bytes).tolist()
    made: list[list[bytes]] = [[] for _ in payloads]
    at_lane = at_byte = 0
    for i, f in frames:
        made[i].append(_header(len(f) // WIDE))
        for k in range(len(f) // RESTART):
            made[i].append(raw[at_byte : ends[at_lane]].replace(b"\xff", b"\xff\x00"))
            if (k + 1) * RESTART < len(f):
                made[i].append(RST[k % 8])
            at_byte, at_lane = ends[at_lane], at_lane + 1
        made[i].append(b"\xff\xd9")
    return [b"".join(m) for m in made]


class _Scan:
    """One frame with its scan, as parsed: what the lanes need."""

    def __init__(self) -> None:
        self.height = self.width = self.restart = 0
        self.components: list[tuple[int, int, int, int]] = []  # id, horizontal, vertical, quantiser
        self.tables: dict[int, list[tuple[int, int, int]]] = {}
        self.quantisers: dict[int, int] = {}
        self.order: list[tuple[int, int, int]] = []  # component index, DC table, AC table
        self.lanes: list[bytes] = []


def parse(data: bytes) -> list[_Scan]:
    """The frames of a stream, with the scan's restart intervals unstuffed."""
    out, at, scan = [], 0, _Scan()
    while at + 1 < len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        at += 2
        if marker in (0xD8, 0xFF, 0x01):
            scan = _Scan() if marker == 0xD8 else scan
            at -= marker == 0xFF
            continue
        if marker == 0xD9:
            continue
        if at + 2 > len(data):
            raise ValueError("a segment is cut off")
        (size,) = struct.unpack_from(">H", data, at)
        body = data[at + 2 : at + size]
        at += size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                scan.quantisers[body[0] & 15] = body[1] << 8 | body[2] if wide else body[1]
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                counts = list(body[1:17])
                scan.tables[body[0]] = _canonical(counts, list(body[17 : 17 + sum(counts)]))
                body = body[17 + sum(counts) :]
        elif marker == 0xC0:
            bits, scan.height, scan.width, n = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise ValueError("not 8 bits a sample")
            scan.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a baseline frame")
        elif marker == 0xDD:
            (scan.restart,) = struct.unpack_from(">H", body)
        elif marker == 0xDA:
            ids = [c[0] for c in scan.components]
            scan.order = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            at = _intervals(data, at, scan)
            if any(c == 0 for c, _, _ in scan.order):  # others hold no luminance
                out.append(scan)
            before, scan = scan, _Scan()
            scan.tables, scan.quantisers, scan.components = dict(before.tables), dict(before.quantisers), before.components
            scan.height, scan.width, scan.restart = before.height, before.width, before.restart
    if not out:
        raise ValueError("no scan")
    return out


def _intervals(data: bytes, at: int, scan: _Scan) -> int:
    begin = at
    while True:
        mark = data.find(b"\xff", at)
        if mark < 0 or mark + 1 >= len(data):
            raise ValueError("a scan is cut off")
        kind = data[mark + 1]
        at = mark + 2
        if kind == 0:
            continue
        if 0xD0 <= kind <= 0xD7 or kind != 0xFF:
            scan.lanes.append(data[begin:mark].replace(b"\xff\x00", b"\xff"))
            begin = at
            if not 0xD0 <= kind <= 0xD7:
                return mark


def _decode_lanes(lanes: list[bytes], blocks: np.ndarray, pattern: list[tuple[int, tuple, tuple]], keep: int) -> np.ndarray:
    """DC levels of each lane's blocks. pattern: for each block of a unit, its component, DC and AC tables; keep: components."""
    data = np.frombuffer(b"".join(x + b"\xff" * 8 for x in lanes), np.uint8)
    size = np.fromiter(map(len, lanes), np.int64, len(lanes)) + 8
    end = np.cumsum(size)
    pos, limit = (end - size) * 8, (end - 8) * 8
    w = data.astype(np.uint32)
    words = (w[:-3] << 24) | (w[1:-2] << 16) | (w[2:-1] << 8) | w[3:]
    order = np.argsort(-blocks, kind="stable")
    pos, limit, left = pos[order], limit[order], blocks[order]
    out = np.zeros((int(left[0]), len(lanes)), np.int32)
    level = np.zeros((keep, len(lanes)), np.int64)
    fast = [_block_table(dc, ac) for _, dc, ac in pattern]
    alive = len(lanes)

    def peek(p: np.ndarray) -> np.ndarray:
        return (words[np.minimum(p >> 3, len(words) - 1)] >> (16 - (p & 7)).astype(np.uint32)).astype(np.int64) & 0xFFFF

    for step in range(int(left[0])):
        while alive and left[alive - 1] <= step:
            alive -= 1
        k = step % len(pattern)
        component, dc, ac = pattern[k]
        p = pos[:alive]
        window = peek(p)
        used, diff = fast[k][0][window], fast[k][1][window]
        slow = np.flatnonzero(used == 0)
        if len(slow):
            q = p[slow]
            w16 = peek(q)
            n, s = dc[0][w16], dc[1][w16]
            if (n == 0).any():
                raise ValueError("no such code")
            q = q + n
            bits = np.where(s > 0, peek(q) >> (16 - np.maximum(s, 1)), 0)
            diff[slow] = _extend(bits, s)
            q = q + s
            at, todo = np.ones(len(slow), np.int64), np.arange(len(slow))
            while len(todo):
                w16 = peek(q[todo])
                n, rs = ac[0][w16], ac[1][w16]
                if (n == 0).any():
                    raise ValueError("no such code")
                q[todo] += n + (rs & 15)
                at[todo] += np.where(rs == 0, 64, (rs >> 4) + 1)
                todo = todo[at[todo] < 64]
            used[slow] = q - p[slow]
        pos[:alive] += used
        level[component, :alive] += diff
        out[step, :alive] = level[component, :alive]
    if (pos > limit).any():
        raise ValueError("a scan is too short")
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return out[:, back]


def decode(streams: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """For each stream its images: width, height, and the luminance thumbnail as float rows."""
    images = [(i, s) for i, data in enumerate(streams) for s in parse(data)]
    groups: dict[tuple, list[int]] = {}
    for j, (_, s) in enumerate(images):
        key = (tuple((c[1], c[2]) for c in s.components), tuple(s.order), tuple(sorted((k, tuple(v)) for k, v in s.tables.items())))
        groups.setdefault(key, []).append(j)
    thumbs: list = [None] * len(images)
    for members in groups.values():
        first = images[members[0]][1]
        pattern = []
        single = len(first.order) == 1
        for c, dc, ac in first.order:
            _, h, v, _ = first.components[c]
            pattern += [(c, _lookup(first.tables[dc]), _lookup(first.tables[0x10 | ac]))] * (1 if single else h * v)
        lanes, blocks, spans = [], [], []
        for j in members:
            s = images[j][1]
            wide, high = _units(s)
            units, each = wide * high, s.restart or wide * high
            counts = [min(each, units - a) for a in range(0, units, each)]
            if len(counts) != len(s.lanes):
                raise ValueError("restart markers do not fit the frame")
            spans.append((len(lanes), len(counts)))
            lanes += s.lanes
            blocks += [n * len(pattern) for n in counts]
        levels = _decode_lanes(lanes, np.array(blocks), pattern, len(first.components))
        for j, (a, n) in zip(members, spans, strict=True):
            thumbs[j] = _thumbnail(images[j][1], [levels[: blocks[a + i], a + i] for i in range(n)], len(pattern))
    out: list[list] = [[] for _ in streams]
    for (i, s), t in zip(images, thumbs, strict=True):
        out[i].append((s.width, s.height, t))
    return out


def _blocks(s: _Scan, component: int) -> tuple[int, int]:
    """How many blocks wide and high a component is."""
    _, h, v, _ = s.components[component]
    wide, high = max(c[1] for c in s.components), max(c[2] for c in s.components)
    return -(-(-(-s.width * h // wide)) // 8), -(-(-(-s.height * v // high)) // 8)


def _units(s: _Scan) -> tuple[int, int]:
    """How many units wide and high a scan is: blocks, if it has one component alone."""
    if len(s.order) == 1:
        return _blocks(s, s.order[0][0])
    return -(-s.width // (8 * max(c[1] for c in s.components))), -(-s.height // (8 * max(c[2] for c in s.components)))


def _thumbnail(s: _Scan, lanes: list[np.ndarray], per_unit: int) -> np.ndarray:
    wide, high = _units(s)
    flat = np.concatenate(lanes).reshape(-1, per_unit)
    _, h, v, q = s.components[0]
    if len(s.order) == 1:
        h = v = 1
    first = [c for c, _, _ in s.order].index(0)
    skip = sum(s.components[c][1] * s.components[c][2] for c, _, _ in s.order[:first])
    y = flat[:, skip : skip + h * v].reshape(high, wide, v, h).transpose(0, 2, 1, 3).reshape(high * v, wide * h)
    cols, rows = _blocks(s, 0)
    return np.clip(y[:rows, :cols] * s.quantisers[q] / 8 + 128, 0, 255)


def average_hash(thumb: np.ndarray) -> str:
    """64 bits: which cells of an 8 x 8 mean-pooled thumbnail lie above their mean."""
    for axis in (0, 1):
        if thumb.shape[axis] < 8:
            thumb = np.repeat(thumb, 8, axis)
    edges = [np.arange(9) * n // 8 for n in thumb.shape]
    cells = np.add.reduceat(np.add.reduceat(thumb, edges[0][:8], 0), edges[1][:8], 1) / np.outer(np.diff(edges[0]), np.diff(edges[1]))
    return np.packbits(cells.ravel() > cells.mean()).tobytes().hex()


def payload_of(text: str) -> tuple[int, bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def _batches(payloads: list[bytes]) -> Iterator[tuple[int, int]]:
    a = size = 0
    for i, p in enumerate(payloads):
        if i > a and size + len(p) > BATCH:
            yield a, i
            a, size = i, 0
        size += len(p)
    if len(payloads) > a:
        yield a, len(payloads)


STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(n_bytes: int, media: bytes, images: list[tuple[int, int, np.ndarray]]) -> tuple:
    """What is read back from one stored stream."""
    payload = b"".join(np.rint(t).astype(np.uint8).tobytes() for _, _, t in images)
    feature = ";".join(f"{w}x{h}:{average_hash(t)}" for w, h, t in images)
    sha = hashlib.sha256
    return n_bytes, len(payload), sha(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), sha(media).hexdigest(), feature


def stored_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as a JPEG stream."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [payload_of(t) for t in b.text]
            for a, z in _batches([p for _, p in made]):
                yield pd.DataFrame({"doc_id": b.doc_id.iloc[a:z].astype("Int64").to_numpy(), "n_bytes": [n for n, _ in made[a:z]], "media": encode([p for _, p in made[a:z]])})

    return id_and_text(docs).mapInPandas(run, "doc_id long, n_bytes long, media binary")


def read_stored(stored: DataFrame) -> DataFrame:
    """One row a stream: payload and features, from the stored bytes alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a, z in _batches(b.media.tolist()):
                media = [bytes(m) for m in b.media.iloc[a:z]]
                rows = [digest(int(n), m, d) for n, m, d in zip(b.n_bytes.iloc[a:z], media, decode(media), strict=True)]
                out = pd.DataFrame(rows, columns=["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
                out.insert(0, "doc_id", b.doc_id.iloc[a:z].astype("Int64").to_numpy())
                yield out

    return stored.mapInPandas(run, STORED)


def thumbnails(media: DataFrame, column: str = "media") -> DataFrame:
    """Dimensions and hash of the first image of each stream in a binary column, in columns width, height and thumb_hash; null where it cannot be read."""

    @F.pandas_udf("struct<width: int, height: int, thumb_hash: string>")
    def look(streams: pd.Series) -> pd.DataFrame:
        rows = []
        for s in streams:
            try:
                w, h, t = decode([bytes(s)])[0][0]
                rows.append((w, h, average_hash(t)))
            except (ValueError, IndexError, KeyError, TypeError, struct.error):
                rows.append((None, None, None))
        return pd.DataFrame(rows, columns=["width", "height", "thumb_hash"])

    return media.withColumns({k: look(F.col(column))[k] for k in ("width", "height", "thumb_hash")})


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_stored(stored_texts(read(spark, sf_dir, "documents")))
