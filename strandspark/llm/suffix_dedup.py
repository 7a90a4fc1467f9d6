"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that also starts elsewhere.

Sorting every suffix of a corpus in one place is not possible, so the suffixes
are first dealt out by content.  Every window of ``length`` bytes has an
anchor: the one of its ``ANCHOR``-byte substrings with the smallest hash, the
leftmost if several.  Equal windows have equal anchors at equal offsets, so only
windows of one anchor need to be compared.  Windows with the same anchor that
follow each other make a run, a string of ``length + n - 1`` bytes.

1. An anchor that occurs once in the corpus settles its windows: no repeats.
2. A run that occurs twice as a whole settles its windows: all repeat.
3. The other runs of repeated anchors meet in one task per anchor (anchors of
   many runs are shared out by offset).  There the suffixes at the window
   starts are sorted by a mergesort whose comparisons find the common
   extension of two suffixes by binary search over prefix polynomial hashes.
   Neighbours whose extension reaches ``length`` repeat, once their bytes
   have been compared; if those differ, the hashes have collided and the
   windows of the task are told apart by their bytes alone.

Texts are known by 128 bits of their SHA-256; very long ones are cut up for the
search of anchors, and their windows are all looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dealt_join, saved, table
from .kernels import U64, arrow_flat, powers, prefix_hashes, substring_hashes

LENGTH = 400
ANCHOR = 200
#: Position bits of the sliding minimum; a batch has fewer bytes than this allows.
_BITS = 28
#: Bytes of text that one call of a kernel takes at a time; the search of anchors holds about a hundred times as many.
CHUNK = 1 << 20
#: Runs of one anchor in a task, at most, before its offsets are shared out.
SHARE = 2000


def sliding_argmin(values: np.ndarray, w: int) -> np.ndarray:
    """For each window of w values the position of its smallest (by the high bits), the leftmost of equals."""
    n = len(values)
    key = (values >> U64(_BITS) << U64(_BITS)) | np.arange(n, dtype=U64)
    x = np.concatenate([key, np.full((-n) % w, ~U64(0))]).reshape(-1, w)
    head = np.minimum.accumulate(x, axis=1).ravel()
    tail = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - w + 1
    return (np.minimum(tail[:m], head[w - 1 : w - 1 + m]) & U64((1 << _BITS) - 1)).astype(np.int64)


def runs(buf: np.ndarray, ends: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
    """Runs of windows with one anchor: text number, start in the text, windows, anchor's offset, hashes of anchor and run."""
    n = len(buf)
    if n < length:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.astype(U64), z.astype(U64)
    prefix = prefix_hashes(buf)
    at = np.arange(n - anchor + 1)
    grams = substring_hashes(prefix, at, at + anchor)
    where = sliding_argmin(grams, length - anchor + 1)
    start = np.arange(n - length + 1)
    text = np.searchsorted(ends, start, side="right") - 1
    inside = start + length <= ends[text + 1]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (where[1:] != where[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new & inside)
    # windows that cross the end of a text come last of it, so a run ends at the next run or there
    cut = np.flatnonzero(new | ~inside)
    last = np.append(cut, len(start))[np.searchsorted(cut, first, side="right")]
    t = text[first]
    return t, first - ends[t], last - first, where[first] - first, grams[where[first]], substring_hashes(prefix, first, last + length - 1)


def _sliced(batches, text_index: int):
    """Record batches cut so that each holds about CHUNK bytes of text."""
    for batch in batches:
        lo, size = 0, 0
        sizes = np.diff(arrow_flat(batch.column(text_index))[1])
        for i, s in enumerate(sizes):
            if size and size + s > CHUNK:
                yield batch.slice(lo, i - lo)
                lo, size = i, 0
            size += s
        if lo < len(sizes):
            yield batch.slice(lo)


_RUN = "tkey binary, doc long, s int, n int, off int, anchor long, run long"


def _segments(buf: np.ndarray, ends: np.ndarray, length: int, chunk: int):
    """(first byte, bytes, bounds) of the batch; a single long text comes in pieces that have each of its windows once."""
    if len(ends) > 2 or len(buf) < chunk + length:
        yield 0, buf, ends
        return
    for lo in range(0, len(buf) - length + 1, chunk):
        part = buf[lo : lo + chunk + length - 1]
        yield lo, part, np.array([0, len(part)])


def _emit_runs(length: int, anchor: int, chunk: int):
    def kernel(batches):
        for batch in _sliced(batches, 2):
            for lo, buf, ends in _segments(*arrow_flat(batch.column(2)), length, chunk):
                t, s, n, off, a, r = runs(buf, ends, length, anchor)
                at = pa.array(t)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array((s + lo).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(off.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(r.view(np.int64))], names=["tkey", "doc", "s", "n", "off", "anchor", "run"])

    return kernel


def extension(prefix: np.ndarray, inv: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Common extension of suffixes a and b, up to limit bytes: binary search over equal prefix hashes."""
    lo = np.zeros(len(a), dtype=np.int64)
    hi = np.full(len(a), limit, dtype=np.int64)
    ia, ib, pa_, pb = inv[a], inv[b], prefix[a], prefix[b]
    for _ in range(int(limit).bit_length()):
        mid = (lo + hi + 1) >> 1
        same = (prefix[a + mid] - pa_) * ia == (prefix[b + mid] - pb) * ib
        lo = np.where(same, mid, lo)
        hi = np.where(same, hi, mid - 1)
    return lo


def suffix_mergesort(buf: np.ndarray, prefix: np.ndarray, pos: np.ndarray, seg: np.ndarray, limit: int) -> np.ndarray:
    """Sorts suffixes ``pos`` (segment by segment; ``seg`` has the segments' bounds) by their first limit bytes.

    A bottom-up mergesort over all segments at once: each suffix finds its
    place in the neighbouring run by binary search, and each comparison is
    one search for the common extension.  Every suffix has limit bytes.
    """
    _, inv = powers(len(prefix))
    order = pos.copy()
    sizes = np.diff(seg)
    widest = int(sizes.max()) if len(sizes) else 0
    base = np.repeat(seg[:-1], sizes)
    size = np.repeat(sizes, sizes)
    local = np.arange(len(pos)) - base
    width = 1
    while width < widest:
        live = np.flatnonzero(size > width)
        b, i, m = base[live], local[live], size[live]
        run = i // width
        other = (run ^ 1) * width
        lo, hi = np.minimum(other, m), np.minimum(other + width, m)
        first, me, right = lo.copy(), order[live], (run & 1).astype(bool)
        for _ in range(width.bit_length()):
            open_ = np.flatnonzero(lo < hi)
            if len(open_) == 0:
                break
            mid = (lo[open_] + hi[open_]) >> 1
            x, y = me[open_], order[b[open_] + mid]
            e = extension(prefix, inv, x, y, limit)
            tied = e >= limit
            safe = np.where(tied, 0, e)
            cx, cy = buf[x + safe].astype(np.int16), buf[y + safe].astype(np.int16)
            after = np.where(tied, right[open_], cy < cx)  # the other stands before me
            lo[open_] = np.where(after, mid + 1, lo[open_])
            hi[open_] = np.where(after, hi[open_], mid)
        left = np.minimum(run, run ^ 1) * width
        moved = order.copy()
        moved[b + left + (i - run * width) + (lo - first)] = me
        order = moved
        width *= 2
    return order


def repeated_starts(buf: np.ndarray, start: np.ndarray, group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which windows ``buf[start:start+length]`` equal another one of their group."""
    found = np.zeros(len(start), dtype=bool)
    if len(start) < 2:
        return found
    by = np.argsort(group, kind="stable")
    g = group[by]
    edge = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    sizes = np.diff(np.append(edge, len(g)))
    keep = np.repeat(sizes > 1, sizes)
    by = by[keep]
    if len(by) == 0:
        return found
    seg = np.append(0, np.cumsum(sizes[sizes > 1]))
    prefix = prefix_hashes(buf)
    # suffixes may stand at one place only once, so a place names its window
    pos = start[by]
    order = suffix_mergesort(buf, prefix, pos, seg, length)
    _, inv = powers(len(prefix))
    next_ = np.arange(len(order) - 1)
    next_ = next_[~np.isin(next_ + 1, seg[1:-1])]
    a, b = order[next_], order[next_ + 1]
    same = extension(prefix, inv, a, b, length) >= length
    a, b = a[same], b[same]
    for i in range(0, len(a), 4096):  # the bytes decide, not the hashes
        x, y = a[i : i + 4096, None] + np.arange(length), b[i : i + 4096, None] + np.arange(length)
        if not (buf[x] == buf[y]).all():
            return _by_bytes(buf, start, group, length)
    mark = np.zeros(len(buf) + 1, dtype=bool)
    mark[a] = True
    mark[b] = True
    found[by] = mark[pos]
    return found


def _by_bytes(buf: np.ndarray, start: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """The same without any hash of ours: for tasks where hashes have collided."""
    seen: dict = {}
    for i, (g, a) in enumerate(zip(group.tolist(), start.tolist(), strict=True)):
        seen.setdefault((g, buf[a : a + length].tobytes()), set()).add(a)
    return np.array([len(seen[g, buf[a : a + length].tobytes()]) > 1 for g, a in zip(group.tolist(), start.tolist(), strict=True)], dtype=bool)


def _cover(tkey: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Union of intervals by text: sorted and merged."""
    by = np.lexsort((start, tkey))
    k, s, e = tkey[by], start[by], end[by]
    out_k, out_s, out_e = [], [], []
    i = 0
    bounds = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else []
    for lo, hi in zip(bounds, np.append(bounds[1:], len(k)), strict=True) if len(k) else ():
        top = np.maximum.accumulate(e[lo:hi])
        new = np.append(True, s[lo + 1 : hi] > top[:-1])
        at = np.flatnonzero(new)
        out_k.append(np.full(len(at), k[lo]))
        out_s.append(s[lo:hi][at])
        out_e.append(top[np.append(at[1:], hi - lo) - 1])
        i += 1
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return cat(out_k), cat(out_s), cat(out_e)


def _cut_out(length: int):
    """Texts with the runs asked of them -> the bytes of each run's share of windows."""

    names = {"bucket": pa.int64(), "tkey": pa.binary(), "anchor": pa.int64(), "s": pa.int32(), "n": pa.int32(), "off": pa.int32(), "raw": pa.binary()}

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), names.values(), strict=True)], names=list(names))

    def kernel(batches):
        rows = []
        for batch in batches:
            for key, text, ask in zip(*(batch.column(i) for i in range(3)), strict=True):
                key, raw = key.as_py(), (text.as_py() or "").encode("utf-8", "surrogatepass")
                for a in ask.as_py():
                    parts = a["parts"]
                    for p in range(parts):  # windows by their offset from the anchor
                        for w in _offsets(a["off"], a["n"], p, parts, length):
                            rows.append((a["bucket"] + p, key, a["anchor"], a["s"] + w[0], w[1], a["off"] - w[0], raw[a["s"] + w[0] : a["s"] + w[0] + w[1] + length - 1]))
                    if len(rows) >= 20_000:
                        yield packed(rows)
                        rows = []
        if rows:
            yield packed(rows)

    return kernel


def _offsets(off: int, n: int, part: int, parts: int, length: int):
    """The windows w of a run (first, count) whose offset from the anchor, ``off - w``, lies in this part's range."""
    step = -(-length // parts)
    lo, hi = part * step, min(length, (part + 1) * step)  # offsets in [lo, hi)
    first, last = max(0, off - hi + 1), min(n - 1, off - lo)
    return [(first, last - first + 1)] if last >= first else []


def _settle(length: int):
    """All run shares of a bucket -> repeated intervals by text."""

    def kernel(table_: pa.Table) -> pa.Table:
        raw = table_.column("raw")
        buf, ends = arrow_flat(raw)
        n, off, s = (table_.column(c).to_numpy().astype(np.int64) for c in ("n", "off", "s"))
        text, anchor = table_.column("tkey").combine_chunks().dictionary_encode(), table_.column("anchor").to_numpy()
        text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
        tkey = text.indices.to_numpy()
        row = np.repeat(np.arange(len(n)), n)
        w = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        _, a = np.unique(anchor, return_inverse=True)
        hit = repeated_starts(buf, ends[row] + w, a[row] * (length + 1) + (off[row] - w), length)
        row, w = row[hit], w[hit]
        k, b, e = _cover(tkey[row], s[row] + w, s[row] + w + length)
        return pa.table({"tkey": text.dictionary.take(pa.array(k, pa.int64())), "b": pa.array(b.astype(np.int32)), "e": pa.array(e.astype(np.int32))})

    return kernel


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(spans, texts): spans has ``tkey, spans`` (array of byte intervals b, e, not merged) by text key for texts that
    occur once; texts has ``tkey, copies`` for texts of length bytes or more that occur again, all of whose bytes repeat."""
    anchor = length // 2
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(text_key(text).alias("tkey"), F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("doc"), text.alias("text"))
    copies = base.filter(F.octet_length("text") >= length).groupBy("tkey").agg(F.count("*").alias("copies")).filter("copies > 1")
    all_runs = saved(base.filter(F.octet_length("text") >= length).mapInArrow(_emit_runs(length, anchor, CHUNK), _RUN))
    place = F.xxhash64("tkey", "s")
    again = saved(all_runs.groupBy("anchor").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.count("*").alias("times")).filter("lo <> hi").select("anchor", "times"))
    # one row per place of a text, whatever its number of copies; doc: the copy that gives the bytes
    met = dealt_join(all_runs, again, ["anchor"], "times", all_runs.count())
    places = saved(met.groupBy("anchor", "run", "off", "n", "tkey", "s").agg(F.min("doc").alias("doc")))
    kinds = saved(places.groupBy("anchor", "run", "off", "n").agg(F.count("*").alias("c"), F.min(F.struct("tkey", "s", "doc")).alias("at")))
    twice = dealt_join(places, kinds.filter("c > 1").select("anchor", "run", "off", "n", "c"), ["anchor", "run", "off", "n"], "c", places.count())
    whole = twice.select("tkey", F.col("s").alias("b"), (F.col("s") + F.col("n") + F.lit(length - 1)).alias("e"))
    many = saved(kinds.groupBy("anchor").agg(F.count("*").alias("g")).filter("g > 1"))
    parts = F.least(F.lit(length - anchor + 1), F.ceil(F.col("g") / SHARE)).cast("int")
    total = kinds.count()
    ask = dealt_join(kinds, many, ["anchor"], "g", total).select(
        F.col("at.tkey").alias("tkey"), F.col("at.doc").alias("doc"),
        F.struct("anchor", F.col("at.s").alias("s"), "n", "off", parts.alias("parts"), F.pmod(F.xxhash64("anchor"), F.lit(max(16, total // SHARE))).alias("bucket")).alias("a"),
    ).groupBy("tkey", "doc").agg(F.collect_list("a").alias("asks"))
    cut = base.join(ask, ["tkey", "doc"])
    shares = cut.select("tkey", "text", "asks").mapInArrow(_cut_out(length), "bucket long, tkey binary, anchor long, s int, n int, off int, raw binary")
    edges = shares.groupBy("bucket").applyInArrow(_settle(length), "tkey binary, b int, e int")
    spans = saved(whole.unionByName(edges).distinct().groupBy("tkey").agg(F.collect_list(F.struct("b", "e")).alias("spans")))
    return spans, copies


def text_key(text: Column) -> Column:
    """128 bits of a text's SHA-256."""
    return F.unhex(F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 32))


def _keep(batches):
    """doc_id, text, copies, spans -> the contract's digest of what is kept."""
    for batch in _sliced(batches, 1):
        out = []
        for raw, copies, spans in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            raw = (raw or "").encode("utf-8", "surrogatepass")
            if copies:
                out.append((len(raw), len(raw), 1, hashlib.sha256(b"").hexdigest()))
                continue
            kept, at, n, removed = [], 0, 0, 0
            for b, e in merged((x["b"], x["e"]) for x in spans or ()):
                kept.append(raw[at:b])
                removed += e - b
                n += 1
                at = e
            kept.append(raw[at:])
            out.append((len(raw), removed, n, hashlib.sha256(b"".join(kept)).hexdigest()))
        cols = list(zip(*out, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def merged(spans) -> list[tuple[int, int]]:
    """Sorted intervals, those that overlap or touch joined."""
    out: list[list[int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return [tuple(x) for x in out]


def with_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``doc_id, text, copies, spans``: each document with the intervals to remove (all of it where copies is set)."""
    spans, copies = repeated_spans(docs, id_col=id_col, text_col=text_col, length=length)
    marks = spans.join(copies, "tkey", "full").select("tkey", "copies", F.when(F.col("copies").isNull(), F.col("spans")).alias("spans"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_key(text).alias("tkey"))
    return rows.join(marks, "tkey", "left").select("doc_id", "text", "copies", "spans")


def dedup(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row.

    Each byte covered by a ``length``-byte string that also starts anywhere
    else goes, overlaps and the same document included; strings are judged on
    the input.  Null texts are empty; texts shorter than length lose nothing;
    all copies of a repeated text of that length lose all; repeated rows are
    copies of each other; very long texts are read whole; null ids are kept; an
    empty table gives no rows; other columns, whatever their names, are ignored.
    """
    return with_spans(docs, **options).mapInArrow(_keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: 400-byte strings over all documents."""
    return dedup(table(spark, sf_dir, "documents"))
