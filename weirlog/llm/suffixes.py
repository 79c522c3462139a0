"""Repeated substrings across documents: anchored suffixes, sorted by hash-compared mergesort, without crossing documents."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.shipping import ship
from .common import dimension, stage
from .shingles import M64, mix, powers, prefix_hash, span_hash

LENGTH = 100
#: Bytes of the strings that anchors are chosen by; any two equal strings of LENGTH bytes choose the same anchor in them.
GRAM = 32
#: Bytes hashed at a time; a longer document is taken in overlapping parts.
CHUNK = 1 << 20
#: Runs held before equal ones are dropped and the rest sent on.
HOLD = 600_000
#: An anchor with more different contexts than this is compared window by window, spread over tasks by window.
CROWD = 4_000
#: Anchors that hold as much of all runs as half a shuffle partition, and at least so many, are dealt out by context.
HOT = 64
#: Bytes of contexts sorted at a time.
SORT_BYTES = 1 << 19


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, by doubling."""
    done, m = 1, x
    while done < width:
        step = min(done, width - done)
        m = np.minimum(m[: len(m) - step], m[step:])
        done += step
    return m


def anchor_runs(data: np.ndarray, begins: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of window starts that share an anchor: (first start, last start, anchor, anchor's hash, context's hash).

    A window is `length` bytes within one document. Its anchor is the leftmost of its `gram`-byte strings with the
    least hash, which depends on the window's bytes alone. Consecutive windows with one anchor form a run; a run's
    context is all bytes of its windows. begins: where documents start in data (the last entry is len(data)).
    """
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty.astype(M64), empty.astype(M64)
    prefix = prefix_hash(data)
    _, down = powers(len(prefix))
    at = np.arange(len(data) - gram + 1)
    h = mix((prefix[gram:] - prefix[:-gram]) * down[: len(at)])
    key = (h & ~M64((1 << 24) - 1)) | at.astype(M64)
    best = _sliding_min(key, length - gram + 1)
    anchor = (best & M64((1 << 24) - 1)).astype(np.int64)
    del best, key
    valid = np.zeros(len(anchor) + 1, dtype=np.int8)
    first, last = begins[:-1], begins[1:] - length
    ok = last >= first
    np.add.at(valid, first[ok], 1)
    np.add.at(valid, last[ok] + 1, -1)
    anchor[np.cumsum(valid[:-1]) == 0] = -1
    cut = np.flatnonzero(np.diff(anchor)) + 1
    lo = np.concatenate(([0], cut))
    hi = np.concatenate((cut, [len(anchor)])) - 1
    a = anchor[lo]
    keep = a >= 0
    lo, hi, a = lo[keep], hi[keep], a[keep]
    context = mix(span_hash(prefix, lo, hi + length) ^ mix(((a - lo) * 4096 + (hi - lo)).astype(M64) + M64(1)))
    return lo, hi, a, h[a], context


RUN = [("known", pa.bool_()), ("h", pa.int64()), ("s", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("did", pa.int64()), ("tag", pa.binary()), ("lo", pa.int64()), ("left", pa.int16()), ("span", pa.int16())]
RUN_SCHEMA = pa.schema(RUN)
RUN_DDL = "known boolean, h long, s long, c1 long, c2 long, did long, tag binary, lo long, left short, span short"


def digests(raw: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(n, 2) 64-bit words: 128-bit BLAKE2b digests of raw's spans. Different bytes with one digest are not known to exist."""
    view = memoryview(raw)
    joined = b"".join([blake2b(view[b:e], digest_size=16).digest() for b, e in zip(begin.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(joined, dtype=np.int64).reshape(-1, 2)


def _order(*columns: np.ndarray) -> np.ndarray:
    """Sorting order by the columns, the first one foremost."""
    return np.lexsort(columns[::-1])


def _firsts(order: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """Marks, along order, where a new group of equal columns begins."""
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = False
        for c in columns:
            s = c[order]
            new[1:] |= s[1:] != s[:-1]
    return new


def _merged(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals joined where they touch or overlap within a document."""
    if not len(doc):
        return doc, begin, end
    o = _order(doc, begin)
    doc, begin, end = doc[o], begin[o], end[o]
    shift = np.cumsum(np.concatenate(([0], doc[1:] != doc[:-1]))) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + shift)
    new = np.concatenate(([True], begin[1:] + shift[1:] > reach[:-1]))
    at = np.flatnonzero(new)
    stop = np.concatenate((at[1:], [len(doc)])) - 1
    return doc[at], begin[at], reach[stop] - shift[stop]


def _ranked(docs: list[tuple[int, bytes]]) -> tuple[np.ndarray, list[tuple[int, bytes]]]:
    """(place of each document in the order of documents, the different documents in this order)."""
    names = sorted(set(docs))
    place = {d: k for k, d in enumerate(names)}
    return np.array([place[d] for d in docs], dtype=np.int64), names


def _split_repeats(r: dict[str, np.ndarray]) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """(rows that come first among those with their context, merged intervals of all later ones)."""
    o = _order(r["c1"], r["c2"], r["doc"], r["lo"])
    new = _firsts(o, r["c1"], r["c2"])
    lead = o[np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))] if len(o) else o
    later = (r["doc"][o] != r["doc"][lead]) | (r["lo"][o] != r["lo"][lead])
    x = o[later]
    return o[new], _merged(r["doc"][x], r["lo"][x], r["lo"][x] + r["span"][x] + LENGTH)


def _run_batches(r: dict[str, np.ndarray], names: list[tuple[int, bytes]], step: int = 100_000) -> Iterator[pa.RecordBatch]:
    did, tags = np.array([d for d, _ in names], dtype=np.int64), pa.array([t for _, t in names], pa.binary())
    for k in range(0, len(r["h"]), step):
        part = {name: v[k : k + step] for name, v in r.items()}
        part["did"] = did[part["doc"]]
        cols = [tags.take(pa.array(part["doc"])) if name == "tag" else pa.array(part[name].astype(kind.to_pandas_dtype(), copy=False), kind) for name, kind in RUN]
        yield pa.record_batch(cols, schema=RUN_SCHEMA)


def _gone_runs(gone: tuple[np.ndarray, ...]) -> dict[str, np.ndarray]:
    """Removed intervals as rows that are known: c1 holds their end, h spreads them over tasks."""
    doc, begin, end = gone
    n, zero = len(doc), np.zeros(len(doc), np.int64)
    return {"known": np.ones(n, bool), "h": mix((doc * 1_000_003 + begin).view(M64) + M64(7)).view(np.int64), "s": zero, "c1": end, "c2": zero, "doc": doc, "lo": begin, "left": zero, "span": zero}


class _Parts:
    """Documents' bytes, hashed CHUNK by CHUNK; a longer document is taken in overlapping parts."""

    def __init__(self) -> None:
        self.parts: list[tuple[int, int, bytes]] = []
        self.size = 0

    def add(self, doc: int, raw: bytes) -> Iterator[tuple[np.ndarray, ...]]:
        for base in range(0, max(len(raw) - LENGTH + 1, 0), CHUNK):
            part = raw[base : base + CHUNK + LENGTH - 1]
            self.parts.append((doc, base, part))
            self.size += len(part)
            if self.size >= CHUNK:
                yield self.runs()

    def runs(self) -> tuple[np.ndarray, ...]:
        """(bytes, document, start in it, first and last window, anchor, anchor's hash, context's hash) of what was added; then it is forgotten."""
        begins = np.concatenate(([0], np.cumsum([len(p[2]) for p in self.parts]))).astype(np.int64)
        raw = b"".join(p[2] for p in self.parts)
        lo, hi, a, h, c = anchor_runs(np.frombuffer(raw, dtype=np.uint8), begins)
        i = np.searchsorted(begins, lo, side="right") - 1
        doc, base = (np.array([p[k] for p in self.parts], dtype=np.int64)[i] for k in range(2))
        self.parts, self.size = [], 0
        return raw, doc, lo - begins[i] + base, lo, hi, a, h.view(np.int64), c


def _count_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, runs) of anchors with several contexts in a piece of a partition; a null anchor has the runs of all."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count, parts = 0, _Parts()

    def flush() -> pa.RecordBatch:
        nonlocal held, count
        h, c = (np.concatenate(x) for x in zip(*held, strict=True))
        o = _order(h, c)
        new = _firsts(o, h, c)
        anchors, n = np.unique(h[o][new], return_counts=True)
        more = n > 1
        held, count = [], 0
        return pa.record_batch([pa.array([None, *anchors[more].tolist()], pa.int64()), pa.array([int(n.sum()), *n[more].tolist()], pa.int64())], names=["h", "n"])

    for batch in batches:
        for text in batch.column(2).to_pylist():
            for _, _, _, _, _, _, h, c in parts.add(0, text.encode()):
                held.append((h, c))
                count += len(h)
        if count >= HOLD:
            yield flush()
    if parts.parts:
        held.append(parts.runs()[-2:])
    if held:
        yield flush()


def hot_anchors(source: DataFrame, partitions: int) -> np.ndarray:
    """Anchors that hold more runs than half of an even shuffle partition; there can be no more than twice as many as partitions."""
    n = stage(source.mapInArrow(_count_anchors, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "sxhot")
    total = n.where("h is null").agg(F.sum("n")).first()[0] or 0
    limit = max(HOT, total // (2 * partitions))
    return np.sort(np.array([r["h"] for r in n.where(F.col("h").isNotNull() & (F.col("n") > limit)).select("h").collect()], dtype=np.int64))


def _find_runs(batches: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Runs of a partition's documents, each context once; what repeats one within a piece of the partition is known to go."""
    held: list[dict[str, np.ndarray]] = []
    docs: list[tuple[int, bytes]] = []
    count, parts = 0, _Parts()

    def take(found: tuple[np.ndarray, ...]) -> None:
        nonlocal count
        raw, doc, start, lo, hi, a, h, _ = found
        c = digests(raw, lo, hi + LENGTH)
        held.append({"h": h, "c1": c[:, 0], "c2": c[:, 1], "doc": doc, "lo": start, "left": a - lo, "span": hi - lo})
        count += len(lo)

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held, docs, count
        if parts.parts:
            take(parts.runs())
        if held:
            r = {k: np.concatenate([x[k] for x in held]) for k in held[0]}
            place, names = _ranked(docs)
            r["doc"] = place[r["doc"]]
            first, gone = _split_repeats(r)
            r = {k: v[first] for k, v in r.items()}
            r["known"] = np.zeros(len(first), bool)
            r["s"] = np.where(np.isin(r["h"], hot), r["c1"], 0)
            yield from _run_batches(r, names)
            yield from _run_batches(_gone_runs(gone), names)
        held, docs, count = [], [], 0

    for batch in batches:
        for did, tag, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            docs.append((did, tag))
            for found in parts.add(len(docs) - 1, text.encode()):
                take(found)
        if count >= HOLD:
            yield from flush()
    yield from flush()


def _match_runs(runs: DataFrame, hot: np.ndarray, crowd: int) -> DataFrame:
    """(kind, h, did, tag, begin, end, left): 0 an interval to remove, 1 a context to compare, 2 one of a crowd.

    Later equal contexts are removed. The first ones of an anchor go on if they are two or more; a hot anchor's contexts
    lie in many tasks and all go on. Sorting and window frames may spill, so no task holds an anchor in memory.
    """
    key = ["known", "h", "s"]
    place = ["c1", "c2", "did", "tag", "lo"]
    row = W.partitionBy(*key).orderBy(*place)
    differs = lambda *names: F.coalesce(F.expr(" or ".join(f"{n} <> {n}_before" for n in names)), F.lit(True))
    r = runs.withColumns({f"{n}_before": F.lag(n).over(row) for n in place})
    r = r.withColumns({"new": differs("c1", "c2"), "moved": differs(*place)})
    r = r.withColumn("contexts", F.sum(F.col("new").cast("long")).over(W.partitionBy(*key)))
    crowded = (F.col("s") != 0) | (F.col("contexts") > crowd)
    kind = F.when(F.col("known") | ~F.col("new"), 0).when(crowded, 2).when(F.col("contexts") > 1, 1)
    end = F.when(F.col("known"), F.col("c1")).otherwise(F.col("lo") + F.col("span") + LENGTH)
    return r.where("moved").select(kind.cast("int").alias("kind"), "h", "did", "tag", F.col("lo").alias("begin"), end.alias("end"), F.col("left").cast("long").alias("left")).where("kind is not null")


def common_prefix(prefix: np.ndarray, down: np.ndarray, x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Length, up to most, of the common prefix of the suffixes at x and y: binary search on prefix hashes."""
    low, high = np.zeros(len(x), np.int64), np.full(len(x), most)
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high + 1) >> 1
        equal = (prefix[x + mid] - prefix[x]) * down[x] == (prefix[y + mid] - prefix[y]) * down[y]
        low = np.where(open_ & equal, mid, low)
        high = np.where(open_ & ~equal, mid - 1, high)


def sort_suffixes(data: np.ndarray, prefix: np.ndarray, at: np.ndarray, bucket: np.ndarray, most: int) -> np.ndarray:
    """Stable order of the suffixes `at` by their first `most` bytes within each bucket (buckets are contiguous).

    Bottom-up mergesort, all buckets at once: each element finds its rank in the neighbouring run by binary search,
    and two suffixes are compared by their common prefix and the byte after it.
    """
    _, down = powers(len(prefix))
    n = len(at)
    order = np.arange(n)
    if not n:
        return order
    start = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    size = np.diff(np.concatenate((start, [n])))
    begin, stop = np.repeat(start, size), np.repeat(start + size, size)
    width = 1
    while width < size.max():
        live = np.flatnonzero(stop - begin > width)
        place = live - begin[live]
        block = place // width
        other = block ^ 1
        s0 = np.minimum(begin[live] + other * width, stop[live])
        s1 = np.minimum(s0 + width, stop[live])
        right = block & 1 == 1
        low, high = s0.copy(), s1.copy()
        mine = at[order[live]]
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) >> 1
            x, y = mine[open_], at[order[mid]]
            c = common_prefix(prefix, down, x, y, most)
            end = c >= most
            cx, cy = data[np.where(end, 0, x + c)], data[np.where(end, 0, y + c)]
            # a right element goes after equal left ones, a left element before equal right ones
            before = np.where(end, right[open_], cy < cx)
            low[open_] = np.where(before, mid + 1, low[open_])
            high[open_] = np.where(before, high[open_], mid)
        target = begin[live] + np.minimum(block, other) * width + (place - block * width) + (low - s0)
        new = order.copy()
        new[target] = order[live]
        order = new
        width *= 2
    return order


def repeated_windows(contexts: list[bytes], group: np.ndarray, left: np.ndarray, doc: np.ndarray, begin: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the contexts, (context's index, start within it, first equal window's index or -1).

    Equal windows have one group and one distance from their anchors, so suffixes are sorted within these buckets.
    Neighbours with equal hashes are compared byte by byte; a bucket where hashes lied is grouped by its bytes.
    """
    data = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    sizes = np.array([len(c) for c in contexts])
    base = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    n = sizes - length + 1
    row = np.repeat(np.arange(len(contexts)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    shift = left[row] - offset
    start = begin[row] + offset
    o = _order(group[row], shift, doc[row], start)
    row, offset, shift, start = row[o], offset[o], shift[o], start[o]
    bucket = np.cumsum(np.concatenate(([0], (group[row][1:] != group[row][:-1]) | (shift[1:] != shift[:-1])))) if len(row) else row
    at = base[row] + offset
    prefix = prefix_hash(data)
    _, down = powers(len(prefix))
    s = sort_suffixes(data, prefix, at, bucket, length)
    row, offset, start, at, bucket = row[s], offset[s], start[s], at[s], bucket[s]
    alike = np.zeros(len(row), dtype=bool)
    pair = np.flatnonzero(bucket[1:] == bucket[:-1]) if len(row) else np.zeros(0, np.int64)
    same = pair[common_prefix(prefix, down, at[pair], at[pair + 1], length) >= length]
    for k in range(0, len(same), 20_000):
        p = same[k : k + 20_000]
        span = np.arange(length)
        if not (data[at[p][:, None] + span] == data[at[p + 1][:, None] + span]).all():
            return _by_bytes(contexts, row, offset, bucket, doc, start, length)
    alike[same + 1] = True
    first = np.maximum.accumulate(np.where(alike, 0, np.arange(len(row)))) if len(row) else row
    lead = np.where(alike, first, -1)
    return row, offset, lead


def _by_bytes(contexts, row, offset, bucket, doc, start, length) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    seen: dict = {}
    lead = np.full(len(row), -1)
    for k in _order(bucket, doc[row], start):
        key = (bucket[k], contexts[row[k]][offset[k] : offset[k] + length])
        lead[k] = seen.setdefault(key, k) if key in seen else -1
        seen.setdefault(key, k)
    return row, offset, lead


def _gone_windows(contexts: list[bytes], group, left, doc, begin) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, np.ndarray]]:
    """(merged intervals of later equal windows, (context's index, start within it) of the first ones)."""
    row, offset, lead = repeated_windows(contexts, group, left, doc, begin)
    start = begin[row] + offset
    x = np.flatnonzero(lead >= 0)
    y = lead[x]
    later = (doc[row[x]] != doc[row[y]]) | (start[x] != start[y])
    x = x[later]
    first = lead < 0
    return _merged(doc[row[x]], start[x], start[x] + LENGTH), (row[first], offset[first])


GONE = ["did", "tag", "begin", "end"]
GONE_DDL = "did long, tag binary, begin long, end long"


def _gone_columns(gone: tuple[np.ndarray, ...], names: list[tuple[int, bytes]]) -> list[pa.Array]:
    doc, begin, end = gone
    return [pa.array([names[d][0] for d in doc], pa.int64()), pa.array([names[d][1] for d in doc], pa.binary()), pa.array(begin.astype(np.int64)), pa.array(end.astype(np.int64))]


def _compared(rows: list[tuple]) -> tuple:
    """(contexts' bytes, merged intervals, first windows, start of each context, its document, names) of rows (h, did, tag, begin, left, bytes)."""
    h, did, tag, begin, left, raw = zip(*rows, strict=True)
    doc, names = _ranked(list(zip(did, tag, strict=True)))
    begin = np.array(begin, dtype=np.int64)
    gone, first = _gone_windows(list(raw), np.array(h), np.array(left, dtype=np.int64), doc, begin)
    return raw, gone, first, begin, doc, names


CUT = pa.schema([("kind", pa.int64()), ("h", pa.int64()), ("did", pa.int64()), ("tag", pa.binary()), ("begin", pa.int64()), ("left", pa.int64()), ("bytes", pa.binary())])


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the asked contexts of each document: (kind, h, did, tag, begin, left, bytes)."""
    rows: list[tuple] = []

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), CUT, strict=True)], schema=CUT)

    for batch in batches:
        for did, tag, text, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = text.encode()
            for a in asked:
                rows.append((a["kind"], a["h"], did, tag, a["begin"], a["left"], raw[a["begin"] : a["end"]]))
                if len(rows) >= 10_000:
                    yield out()
                    rows = []
    if rows:
        yield out()


def _compare_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor; whole anchors, SORT_BYTES or one anchor at most, are sorted at a time."""
    held: list[tuple] = []
    size, last = 0, None

    def out() -> pa.RecordBatch:
        _, gone, _, _, _, names = _compared(held)
        return pa.record_batch(_gone_columns(gone, names), names=GONE)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != last and size >= SORT_BYTES:
                yield out()
                held, size = [], 0
            last = row[0]
            held.append(row)
            size += len(row[5])
    if held:
        yield out()


def _crowd_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of crowds: those that repeat one of this task's are removed here (kind 0), the others go on by their digests."""
    rows: list[tuple] = []

    def out() -> pa.RecordBatch:
        raw, gone, (row, offset), begin, doc, names = _compared(rows)
        sizes = np.array([len(x) for x in raw])
        at = (np.cumsum(sizes) - sizes)[row] + offset
        w = digests(b"".join(raw), at, at + LENGTH)
        start = begin[row] + offset
        kind = np.concatenate((np.zeros(len(gone[0]), np.int64), np.ones(len(row), np.int64)))
        one, two = (np.concatenate((np.zeros(len(gone[0]), np.int64), w[:, k])) for k in range(2))
        spans = tuple(np.concatenate(p) for p in ((gone[0], doc[row]), (gone[1], start), (gone[2], start + LENGTH)))
        return pa.record_batch([pa.array(kind), pa.array(one), pa.array(two), *_gone_columns(spans, names)], names=["kind", "w1", "w2", *GONE])

    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.append(row)
            size += len(row[5])
            if size >= SORT_BYTES:
                yield out()
                rows, size = [], 0
    if rows:
        yield out()


def _match_windows(windows: DataFrame) -> DataFrame:
    """All but the first of equal windows."""
    return windows.withColumn("nth", F.row_number().over(W.partitionBy("w1", "w2").orderBy("did", "tag", "begin"))).where("nth > 1").select(*GONE)


def _apply(batches: Iterator[pa.RecordBatch], at: int, as_text: bool) -> Iterator[pa.RecordBatch]:
    """Replace the last two columns (text, intervals) by (kept, merged spans, bytes removed, bytes before)."""
    for batch in batches:
        out: list[tuple] = []
        for text, gone in zip(batch.column(at).to_pylist(), batch.column(at + 1).to_pylist(), strict=True):
            raw = (text or "").encode()
            spans: list[list[int]] = []
            for b, e in sorted((g["begin"], g["end"]) for g in gone or ()):
                if spans and b <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], e)
                else:
                    spans.append([b, e])
            kept, last = [], 0
            for b, e in spans:
                kept.append(raw[last:b])
                last = e
            kept.append(raw[last:])
            data = b"".join(kept)
            out.append((data.decode(errors="ignore") if as_text else data, [{"begin": b, "end": e} for b, e in spans], sum(e - b for b, e in spans), len(raw)))
        kinds = (pa.string() if as_text else pa.binary(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.int64(), pa.int64())
        cols = [pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:at], *cols], names=[*batch.schema.names[:at], "kept", "spans", "n_removed", "n_bytes"])


def _tags(docs: DataFrame, did: Column, text: Column) -> DataFrame:
    """docs with `tag`: empty where an id is the document's alone, else (null and repeated ids) the text's SHA-256."""
    hashed = F.unhex(F.sha2(text, 256))
    ids = docs.select(did.alias("d_id")).where("d_id is not null")
    twice = stage(ids.groupBy("d_id").count().where("count > 1").select("d_id"), "sxtwice")
    none = F.lit(b"")
    if not twice.limit(1).count():
        return docs.withColumn("tag", F.when(did.isNull(), hashed).otherwise(none))
    joined = docs.join(dimension(twice), did == F.col("d_id"), "left")
    return joined.withColumn("tag", F.when(did.isNull() | F.col("d_id").isNotNull(), hashed).otherwise(none)).drop("d_id")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False, crowd: int = CROWD) -> DataFrame:
    """Remove every byte that lies in a 100-byte string which also starts earlier, in a smaller document or before it in the same.

    1. Every window of 100 bytes has an anchor, chosen by its bytes alone; windows in a row with one anchor form a run
    whose context is all their bytes. Each partition sends every context once; what repeats it there is removed at
    once, so copies do not pile up. Anchors that hold more than half a shuffle partition are found first and dealt out
    by context. 2. Of equal contexts, by a 128-bit BLAKE2b digest of their bytes, the first stays and later ones are
    removed. 3. Only anchors with different contexts fetch their bytes: their suffixes are sorted by hash-compared
    mergesort and equal neighbours, verified byte by byte, are removed but for the first. 4. Hot anchors, and those with
    more than `crowd` contexts, do so piece by piece, and windows of different pieces meet by their digests. Which way an
    anchor goes does not change the result. 5. Each document's intervals are merged and cut out.

    Null text: empty. Null id: ordered after all others. Rows that repeat an id with the same text are one document and
    do not remove each other; with other texts they are documents of their own, ordered by the texts' SHA-256, as are
    those with null ids. Empty table: no rows. Other columns are kept. Returns (row, kept, spans, n_removed, n_bytes): row
    holds docs' columns; kept is binary, or with as_text a string without the characters that lost a part.
    """
    spark = docs.sparkSession
    ship(spark)
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    keyed = _tags(plain, F.col("id"), F.col("body"))
    keyed = keyed.select("row", F.coalesce("id", F.lit(2**63 - 1)).alias("did"), "tag", "body")
    source = keyed.where(F.octet_length("body") >= LENGTH).select("did", "tag", "body")
    hot = hot_anchors(source, int(spark.conf.get("spark.sql.shuffle.partitions")))
    runs = source.mapInArrow(lambda it: _find_runs(it, hot), RUN_DDL)
    found = stage(_match_runs(runs, hot, crowd), "sxfound")
    gone = found.where("kind = 0").select(*GONE)
    asked = found.where("kind > 0").groupBy("did", "tag").agg(F.collect_list(F.struct("kind", "h", "begin", "end", "left")).alias("asked"))
    bodies = source.dropDuplicates(["did", "tag"]) if _repeated(source) else source
    cut = bodies.join(asked, ["did", "tag"]).select("did", "tag", "body", "asked").mapInArrow(_cut_contexts, "kind long, h long, did long, tag binary, begin long, left long, bytes binary")
    cut = stage(cut, "sxcut")
    rows = ["h", "did", "tag", "begin", "left", "bytes"]
    few = cut.where("kind = 1").select(*rows).repartition("h").sortWithinPartitions("h").mapInArrow(_compare_contexts, GONE_DDL)
    parts = [gone, few]
    many = cut.where("kind = 2").select(*rows)
    if many.limit(1).count():
        windows = stage(many.mapInArrow(_crowd_windows, f"kind long, w1 long, w2 long, {GONE_DDL}"), "sxwin")
        parts += [windows.where("kind = 0").select(*GONE), _match_windows(windows.where("kind = 1"))]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    lists = stage(every.groupBy("did", "tag").agg(F.collect_list(F.struct("begin", "end")).alias("gone")), "sxgone")
    inner = keyed.join(lists, ["did", "tag"], "left").select("row", "body", "gone")
    more = T.StructType.fromDDL(f"kept {'string' if as_text else 'binary'}, spans array<struct<begin:bigint,end:bigint>>, n_removed bigint, n_bytes bigint")
    return inner.mapInArrow(lambda it: _apply(it, 1, as_text), T.StructType([inner.schema["row"], *more.fields]))


def _repeated(source: DataFrame) -> bool:
    """Whether any document comes twice; then its bytes are fetched once."""
    return source.groupBy("did", "tag").count().where("count > 1").limit(1).count() > 0


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    r = remove_repeats(docs)
    return r.select("row.doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Every window of 100 bytes as a string of hex digits, cut from pieces of 500 starts.
SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
o AS (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 99, 500)) AS base FROM d WHERE len(x) >= 200),
a AS (SELECT doc_id, base, least(500, len(x) // 2 - 99 - base) AS n, substr(x, 2 * base + 1, 1198) AS part FROM o),
w AS (SELECT doc_id, base, part, unnest(range(0, n)) AS k FROM a),
n AS (SELECT doc_id, base + k AS i, row_number() OVER (PARTITION BY substr(part, 2 * k + 1, 200) ORDER BY doc_id, base + k) AS nth FROM w),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM n WHERE nth > 1),
r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
s AS (SELECT doc_id, min(i) AS b, max(i) + 100 AS e FROM r GROUP BY doc_id, run),
k AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS last FROM s),
j AS (
  SELECT k.doc_id, sum(e - b) AS n_removed, count(*) AS n_spans, max(e) AS tail, string_agg(substr(x, 2 * last + 1, 2 * (b - last)), '' ORDER BY b) AS head
  FROM k JOIN d ON d.doc_id = k.doc_id GROUP BY k.doc_id)
SELECT d.doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN j.doc_id IS NULL THEN x ELSE head || substr(x, 2 * tail + 1) END)) AS kept_sha256
FROM d LEFT JOIN j ON j.doc_id = d.doc_id
"""
