"""Exact removal of repeated substrings by a distributed merge sort of sparse suffixes that knows common prefixes.

A string of LENGTH bytes that starts at two places is repeated; every byte of a repeated string goes.
Sorting all suffixes would multiply the text, so the suffix array is sparse. Every window of LENGTH bytes has an anchor,
the least-hashed of its GRAM-byte substrings (the leftmost of equals): equal windows have equal anchors at the same
offset, so nothing is lost by looking at suffixes that start at anchors (about one byte in 77).

1. Anchors whose gram occurs once in all texts are left out (a pre-aggregated count and a join on the gram's hash).
2. Each task sorts the rest, as keys of gram hash, the LENGTH bytes onward and the bytes before in reverse, and front-codes
   the sorted run: common prefix with the key before, then what differs. Identical keys within a run settle each
   other there and go on as one key without owners, so copies that meet in a task don't travel.
3. Runs are exchanged by ranges of the gram hash. A loser tree merges them: it keeps each loser's common prefix with
   its winner, the longer one wins unseen, and only bytes beyond a tie are compared. It yields the suffix array of the
   range with its common-prefix array.
4. For each offset of a window to its anchor, neighbours with a long enough common prefix form a block, and within a
   block windows are equal if the bytes before the anchor are: these are sorted once, and their common prefixes tell for every offset.
5. The repeated spans go back to their texts and are cut. Texts are shuffled once; both joins read that exchange.

Defined cases: null text is empty; texts shorter than LENGTH keep everything; overlapping copies within one text count;
repeated rows repeat each other, whatever their ids; texts are judged as UTF-8 bytes, so what is kept is bytes; texts of any length are read
whole; other columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.shipping import ship
from tessera.llm.common import durable, partitions_for, text_or_empty, tidy

LENGTH, GRAM = 200, 48
#: Windows' grams; the most bytes before an anchor that a window can hold.
GRAMS = LENGTH - GRAM + 1
BEFORE = GRAMS - 1
#: Bytes of a key: hash, onward, before (reversed), least and largest offset.
HEAD = 8
KEY = HEAD + LENGTH + BEFORE + 2
CHUNK_BYTES = 1 << 20
RUN_KEYS, BLOCK_KEYS, SETTLE_KEYS, PART_KEYS = 60_000, 4096, 20_000, 100_000

_gen = np.random.default_rng(977)
_TABLE = _gen.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_M = np.uint64(0x9E3779B97F4A7C15)
_M_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_POS = np.uint64(31)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


class _Scanner:
    """Anchors of concatenated texts; keeps the power tables."""

    def __init__(self) -> None:
        self.up, self.down = _powers(_M, 1), _powers(_M_INV, 1)

    def anchors(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text number, position in data, gram hash, least and largest offset) of each anchor; ends: where each text ends."""
        n = len(data)
        none = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.int64, np.int64))
        if n < LENGTH:
            return none
        if len(self.up) < n:
            self.up, self.down = _powers(_M, n), _powers(_M_INV, n)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(_TABLE[data] * self.up[:n], out=total[1:])
        h = (total[GRAM:] - total[:-GRAM]) * self.down[: n - GRAM + 1]
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(29)
        low = (h >> _POS << _POS) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= GRAMS:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < GRAMS:
            low = np.minimum(low[: len(low) - (GRAMS - width)], low[GRAMS - width :])
        at = (low & np.uint64((1 << 31) - 1)).astype(np.int64)
        starts = np.concatenate([[0], ends[:-1]])
        long = ends - starts >= LENGTH
        # the first window of each text, and the one after its last
        first, last = starts[long], ends[long] - LENGTH
        valid = np.zeros(len(at) + 1, np.int8)
        np.add.at(valid, first, 1)
        np.add.at(valid, last + 1, -1)
        p = np.flatnonzero(np.cumsum(valid[:-1]))
        if not len(p):
            return none
        a = at[p]
        new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)])
        end = np.r_[new[1:] - 1, len(p) - 1]
        anchor = a[new]
        text = np.searchsorted(ends, anchor, side="right")
        return text, anchor, h[anchor], anchor - p[end], anchor - p[new]


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column without nulls, and its n + 1 offsets."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def _chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about CHUNK_BYTES each."""
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, side="right")) - 1)
        yield lo, hi
        lo = hi


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rk, text) to (gram, rk, n): how often (2: more) each gram is an anchor of the text."""
    scan = _Scanner()
    for b in batches:
        rk = np.asarray(b.column(0))
        data, offsets = _texts(b.column(1))
        for lo, hi in _chunks(offsets):
            text, _, h, _, _ = scan.anchors(data[offsets[lo] : offsets[hi]], offsets[lo + 1 : hi + 1] - offsets[lo])
            order = np.lexsort((h, text))
            text, h = text[order], h[order]
            new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.empty(0, np.int64)
            n = np.minimum(np.diff(np.r_[new, len(h)]), 2).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(rk[lo + text[new]]), pa.array(n)], names=["gram", "rk", "n"])


def settle(keys: np.ndarray, common: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Which windows are repeated: bool (keys, offsets) for sorted keys (n, KEY), their common prefixes, and whether each stands for several."""
    n = len(keys)
    lo, hi = keys[:, -2].astype(np.int64), keys[:, -1].astype(np.int64)
    out = np.zeros((n, GRAMS), bool)
    near = common.astype(np.int64) - HEAD
    near[0] = -1
    # the bytes before the anchors, sorted: neighbours with o bytes in common are of one class at offset o
    back = keys[:, HEAD + LENGTH : -2]
    flat = back.tobytes()
    by_back = np.array(sorted(range(n), key=[flat[i : i + BEFORE] for i in range(0, len(flat), BEFORE)].__getitem__), np.int64)
    common_back = common_prefixes(back[by_back])
    kind = np.empty(n, np.int64)
    for o in range(GRAMS):
        kind[by_back] = np.cumsum(common_back < o)
        block = np.cumsum(near < LENGTH - o)
        sel = (lo <= o) & (o <= hi)
        out[:, o] = sel & many
        sel = np.flatnonzero(sel)
        if len(sel) < 2:
            continue
        b = block[sel]
        sel = sel[np.bincount(b)[b] > 1]
        if len(sel) < 2:
            continue
        x = block[sel] * (n + 1) + kind[sel]
        order = np.argsort(x, kind="stable")
        same = x[order][1:] == x[order][:-1]
        twin = np.r_[same, False] | np.r_[False, same]
        out[sel[order[twin]], o] = True
    return out


def _spans(flags: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the bytes that repeated windows cover, for the anchors' positions at."""
    padded = np.zeros((len(flags), GRAMS + 2), np.int8)
    padded[:, 1:-1] = flags
    step = np.diff(padded, axis=1)
    row, first = np.nonzero(step == 1)
    _, after = np.nonzero(step == -1)
    return row, at[row] - (after - 1), at[row] - first + LENGTH


FIELDS = "part int, run string, seq int, block binary, rk long, h long, start int, end int"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]
TYPES = [pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]


def _rows(n: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, t)).cast(t) for c, t in zip(NAMES, TYPES)], names=NAMES)


def _span_rows(rk: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    part = np.full(len(rk), -1, np.int32)
    return _rows(len(rk), part=pa.array(part), rk=pa.array(rk), h=pa.array(h), start=pa.array(start), end=pa.array(end))


def _part_of(first: np.ndarray, parts: int) -> np.ndarray:
    """The range of a gram hash, by its top 32 bits."""
    return ((first >> np.uint64(32)).astype(np.uint64) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


class Run:
    """Keys with owners that one task sorts, front-codes and sends out."""

    def __init__(self, parts: int, name: str):
        self.parts, self.name, self.count = parts, name, 0
        self.keys: list[np.ndarray] = []
        self.own: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray, own: np.ndarray) -> None:
        self.keys.append(keys)
        self.own.append(own)
        self.size += len(keys)

    def flush(self) -> Iterator[pa.RecordBatch]:
        import zstandard

        if not self.size:
            return
        keys, own = np.concatenate(self.keys), np.concatenate(self.own)
        self.keys, self.own, self.size = [], [], 0
        flat = keys.tobytes()
        order = np.array(sorted(range(len(keys)), key=[flat[i : i + KEY] for i in range(0, len(flat), KEY)].__getitem__))
        keys, own = keys[order], own[order]
        common = common_prefixes(keys)
        head = np.flatnonzero(common < KEY)
        sizes = np.diff(np.r_[head, len(keys)])
        many = sizes > 1
        twins = np.repeat(many, sizes)
        if twins.any():
            k, o = keys[twins], own[twins]
            at = o["at"].astype(np.int64)
            yield _span_rows(o["rk"], o["h"], at - k[:, -1], at - k[:, -2] + LENGTH)
        keys, own, common = keys[head], own[head], common[head]
        part = _part_of(keys[:, :8].copy().view(">u8").ravel().astype(np.uint64), self.parts)
        pack = zstandard.ZstdCompressor(level=1)
        rows: list[tuple[int, int, bytes]] = []
        for p in np.unique(part):
            lo, hi = np.searchsorted(part, p), np.searchsorted(part, p, side="right")
            for seq, i in enumerate(range(lo, hi, BLOCK_KEYS)):
                rows.append((int(p), seq, pack.compress(encode(keys[i : min(hi, i + BLOCK_KEYS)], common[i : min(hi, i + BLOCK_KEYS)], own[i : min(hi, i + BLOCK_KEYS)], many[i : min(hi, i + BLOCK_KEYS)]))))
        p, s, blocks = zip(*rows)
        yield _rows(len(rows), part=pa.array(p), run=pa.array([f"{self.name}-{self.count}"] * len(rows)), seq=pa.array(s), block=pa.array(blocks))
        self.count += 1


OWN = np.dtype([("rk", "<i8"), ("h", "<i8"), ("at", "<i4")])


def common_prefixes(keys: np.ndarray) -> np.ndarray:
    """Bytes that each key shares with the one before; 0 for the first."""
    out = np.zeros(len(keys), np.int64)
    differ = keys[1:] != keys[:-1]
    out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), keys.shape[1])
    return out


def encode(keys: np.ndarray, common: np.ndarray, own: np.ndarray, many: np.ndarray) -> bytes:
    """A front-coded block: per key the prefix it shares with the one before (0 for the block's first), then the other bytes."""
    common = common.astype("<u2")
    common[0] = 0
    tails = keys[np.arange(KEY) >= common[:, None]]
    kept = own[~many]
    return struct.pack("<I", len(keys)) + common.tobytes() + many.astype(np.uint8).tobytes() + kept.tobytes() + tails.tobytes()


def decode(block: bytes) -> Iterator[tuple[int, bytes, bytes | None]]:
    """(common prefix with the key before, key, owner or None) for each key of a block."""
    (n,) = struct.unpack_from("<I", block)
    common = np.frombuffer(block, "<u2", n, 4).tolist()
    many = np.frombuffer(block, np.uint8, n, 4 + 2 * n).tolist()
    at = 4 + 3 * n
    tail = at + OWN.itemsize * (n - sum(many))
    key = b""
    for c, m in zip(common, many):
        key = key[:c] + block[tail : tail + KEY - c]
        tail += KEY - c
        owner = None
        if not m:
            owner = block[at : at + OWN.itemsize]
            at += OWN.itemsize
        yield c, key, owner


def stream(blocks: list[bytes]) -> Iterator[tuple[int, bytes, bytes | None]]:
    """A run's keys; a block's first key is compared with the last of the block before it."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    last = b""
    for b in blocks:
        for i, (c, key, owner) in enumerate(decode(unpack.decompress(b))):
            if not i and last:
                c = _beyond(last, key, 0)
            yield c, key, owner
        last = key


def _beyond(a: bytes, b: bytes, known: int) -> int:
    """The common prefix of two keys that are known to share `known` bytes."""
    x = int.from_bytes(a[known:], "big") ^ int.from_bytes(b[known:], "big")
    return KEY - (x.bit_length() + 7) // 8


def merge(runs: list[Iterator[tuple[int, bytes, bytes | None]]]) -> Iterator[tuple[int, bytes, bytes | None]]:
    """Loser tree over sorted runs of (common prefix with the run's key before, key, owner), in order, with the common prefix to the key before in the output.

    heads[s][0] is the common prefix of run s's head with the last key put out (for losers: with the winner they lost to,
    which is the same once that winner has gone out). Of two heads the one with the longer prefix is smaller; only on a tie are
    bytes compared, from that prefix on.
    """
    k = len(runs)
    width = 1 << max(0, (k - 1).bit_length())
    heads = [next(r, None) for r in runs] + [None] * (width - k)
    known = [0] * width
    keys = [h[1] if h else None for h in heads]

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); sets the loser's known prefix."""
        ka, kb = keys[a], keys[b]
        if ka is None or kb is None:
            return (b, a) if ka is None else (a, b)
        la, lb = known[a], known[b]
        if la != lb:
            return (a, b) if la > lb else (b, a)
        c = _beyond(ka, kb, la)
        if c == KEY or ka[c] < kb[c]:
            known[b] = c
            return a, b
        known[a] = c
        return b, a

    losers = [0] * width
    won = list(range(width))
    level = width
    while level > 1:
        half = level // 2
        after = []
        for i in range(half):
            w, lost = play(won[2 * i], won[2 * i + 1])
            losers[half + i] = lost
            after.append(w)
        won, level = after, half
    top = won[0]
    while keys[top] is not None:
        _, key, owner = heads[top]
        yield known[top], key, owner
        heads[top] = h = next(runs[top], None)
        if h is None:
            keys[top] = None
        else:
            known[top], keys[top] = h[0], h[1]
        w, node = top, (top + width) // 2
        while node:
            w, losers[node] = play(w, losers[node])
            node //= 2
        top = w


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of FIELDS by part, run and seq to the spans (rk, h, start, end)."""
    part: int | None = None
    blocks: dict[str, list[bytes]] = {}

    def finish() -> Iterator[pa.RecordBatch]:
        keys, common, owners = [], [], []

        def out() -> pa.RecordBatch:
            k = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, KEY)
            has = np.array([o is not None for o in owners])
            c = np.array(common)
            flags = settle(k, c, ~has)
            # equal keys of different runs are twins as a whole
            own = np.frombuffer(b"".join(o for o in owners if o is not None), OWN)
            row, start, end = _spans(flags[has], own["at"].astype(np.int64))
            return _span_rows(own["rk"][row], own["h"][row], start, end)

        for c, key, owner in merge([stream(b) for b in blocks.values()]):
            if len(keys) >= SETTLE_KEYS and c < HEAD + GRAM:
                yield out()
                keys.clear(), common.clear(), owners.clear()
            keys.append(key)
            common.append(c)
            owners.append(owner)
        if keys:
            yield out()
        blocks.clear()

    for b in batches:
        parts = np.asarray(b.column(0))
        spans = np.flatnonzero(parts < 0)
        if len(spans):
            yield b.take(pa.array(spans))
        for i in np.flatnonzero(parts >= 0).tolist():
            if parts[i] != part:
                yield from finish()
                part = parts[i]
            blocks.setdefault(b.column(1)[i].as_py(), []).append(b.column(3)[i].as_py())
    yield from finish()


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<start, end>>, kept binary) for each row of docs(doc_id, text): what is repeated, and the bytes that stay."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select("doc_id", text_or_empty("text").alias("text")).withColumn("h", F.xxhash64("text")).withColumn("rk", F.xxhash64(F.col("doc_id").cast("string"), "h"))
    grams = texts.select("rk", "text").mapInArrow(tidy(_grams), "gram long, rk long, n int")
    often = grams.groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram")
    found = grams.join(often.hint("merge"), "gram").groupBy("rk").agg(F.collect_set("gram").alias("grams"))
    found = durable(found)
    total = found.agg(F.sum(F.size("grams"))).first()[0] or 0
    parts = max(1, partitions_for(spark), total // PART_KEYS)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        run, scan = Run(parts, str(TaskContext.get().partitionId())), _Scanner()
        for b in batches:
            rk, h = np.asarray(b.column(0)), np.asarray(b.column(1))
            data, offsets = _texts(b.column(2))
            wanted, many = np.asarray(b.column(3).flatten()).view(np.uint64), np.diff(np.asarray(b.column(3).offsets))
            of = np.repeat(np.arange(len(many)), many)
            for lo, hi in _chunks(offsets):
                ends = offsets[lo + 1 : hi + 1] - offsets[lo]
                chunk = data[offsets[lo] : offsets[hi]]
                text, at, gram, least, largest = scan.anchors(chunk, ends)
                mark = lambda g, t: (g ^ (t.astype(np.uint64) * _MIX)) * _M
                mine = (of >= lo) & (of < hi)
                good = np.flatnonzero(np.isin(mark(gram, text + lo), mark(wanted[mine], of[mine])))
                starts = np.r_[0, ends[:-1]]
                for s in range(0, len(good), RUN_KEYS):
                    g = good[s : s + RUN_KEYS]
                    t, a = text[g], at[g]
                    keys = np.zeros((len(g), KEY), np.uint8)
                    # anchors have low hashes; multiplied, they fill the range evenly
                    keys[:, :HEAD] = (gram[g] * _M).astype(">u8").view(np.uint8).reshape(-1, 8)
                    onward = a[:, None] + np.arange(LENGTH)
                    keys[:, HEAD : HEAD + LENGTH] = np.where(onward < ends[t][:, None], chunk[np.minimum(onward, len(chunk) - 1)], 0)
                    back = a[:, None] - 1 - np.arange(BEFORE)
                    keys[:, HEAD + LENGTH : -2] = np.where(back >= starts[t][:, None], chunk[np.maximum(back, 0)], 0)
                    keys[:, -2], keys[:, -1] = least[g], largest[g]
                    own = np.empty(len(g), OWN)
                    own["rk"], own["h"], own["at"] = rk[lo + t], h[lo + t], a - starts[t]
                    run.add(keys, own)
                    if run.size >= RUN_KEYS:
                        yield from run.flush()
        yield from run.flush()

    texts_by_key = texts.select("rk", "h", "doc_id", "text")
    sent = texts_by_key.join(found.hint("merge"), "rk").select("rk", "h", "text", "grams").mapInArrow(tidy(runs), FIELDS)
    dealt = sent.repartition(parts, F.when(F.col("part") < 0, F.col("rk")).otherwise(F.col("part"))).sortWithinPartitions("part", "run", "seq")
    spans = dealt.mapInArrow(tidy(_reduce), FIELDS).groupBy("rk", "h").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = _texts(b.column(1))
            n, spans_out, kept = [], [], []
            for i in range(b.num_rows):
                raw = data[offsets[i] : offsets[i + 1]]
                n.append(len(raw))
                got = b.column(2)[i]
                merged = union(got.values) if got.is_valid else []
                spans_out.append([{"start": s, "end": e} for s, e in merged])
                if not merged:
                    kept.append(raw.tobytes())
                    continue
                edges = [0, *(x for s in merged for x in s), len(raw)]
                kept.append(b"".join(raw[s:e].tobytes() for s, e in zip(edges[::2], edges[1::2])))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(spans_out, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    # h is compared too, in a form that isn't a join key: so the texts' exchange by rk serves both joins
    spans = spans.toDF("_rk", "_h", "spans").hint("merge")
    joined = texts_by_key.join(spans, (F.col("rk") == F.col("_rk")) & (F.col("h").bitwiseXOR(F.col("_h")) == 0), "left")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", "text", "spans").mapInArrow(tidy(cut), f"doc_id {kind}, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")


def union(spans: pa.StructArray) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that the spans cover."""
    start, end = np.asarray(spans.field("start")), np.asarray(spans.field("end"))
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
    return list(zip(start[new].tolist(), end[np.r_[new[1:] - 1, len(end) - 1]].tolist()))
