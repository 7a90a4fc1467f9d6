"""Language-model scoring with a log-frequency Bloom filter.

Word and bigram counts are gathered from the training documents: every task
sends its own counts, by hash bucket, and each bucket's task adds them up.  A
bigram counted c times is put into the filter as (bigram, 1) to (bigram, q),
q = 1 + floor(log2 c); asking for level 1, 2, ... until a level is missing
gives q back, hence c to within a factor.  The filter is made of one piece per
bucket, each built where its counts are, and is broadcast in segments of at
most ``SEGMENT_BYTES``; the terms of a document's score add up over segments.
That is for small corpora, of at most ``PASSES`` buckets of text.  Larger ones are
scored by an exchange: the documents are bundled into pages of about ``PAGE`` bytes of
text, written once; every page sends its distinct words and bigrams, each with its count in
the training documents, by hash bucket; each bucket's task adds the counts up, builds
its piece of the filter, probes it for every bigram that was sent, and answers each page
with the words' counts and the bigrams' levels, in the order in which they came; the
page's documents are scored from its answers.  Hashes go as packed differences
(``pack``), answers without hashes.

Words have exact counts.  Where the filter is broadcast, so are the ``TOP_WORDS`` most
frequent words' (a bounded table); the others' come by a shuffle join.

The model: P(w | h) = (c~(h,w) + MU * P(w)) / (c^(h) + MU), where c~ is the
lower end of the bigram's level, at most c^, and c^ the exact count of h, at least
1; so the probabilities of a context add up to one at most.  P(w) is the count's
share, for words never seen that of one token.  With the filter
broadcast a bigram of two frequent words is scored in the kernel; the others leave it
with their level, and get their counts by the join.
"""

from __future__ import annotations

import secrets

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, table
from .kernels import U64, arrow_flat, mix, words

#: Words whose counts are broadcast, at most.
TOP_WORDS = 1 << 19
#: Bytes of the filter that are broadcast at once, at most.
SEGMENT_BYTES = 128 << 20
#: Buckets of text up to which the filter is broadcast.
PASSES = 4
#: Without effect since no bigrams are broadcast beside the exchange.
TOP_PAIRS = 1 << 19
BITS_PER_ENTRY = 10
PROBES = 5
MU = 300.0
#: Bytes of text counted together in a task before counts are sent.
CHUNK = 24 << 20
#: Bytes of text in a page of documents that are scored together, about.
PAGE = 12 << 20
#: Bytes of text for each hash bucket, about.
BUCKET_BYTES = 8 << 20

END = mix(np.array([0x5EED0FE0D], dtype=U64))[0]


def tokens(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words (A-Z lower-cased) and one end, and each text's bounds."""
    _, _, h, bounds = words(buf, ends)
    n = np.diff(bounds)
    out = np.full(len(h) + len(n), END, dtype=U64)
    out[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
    return out, bounds + np.arange(len(bounds))


def bigrams(tok: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each token the hash of (token before it, token), of 48 bits and 16 zeros; an end stands before the first."""
    before = np.empty_like(tok)
    before[1:] = tok[:-1]
    before[bounds[:-1]] = END
    return mix(before * U64(0x9E3779B97F4A7C15) + tok) >> U64(16) << U64(16)


def _counted(h: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, with their counts added up."""
    if n is None:
        h = np.sort(h)
        edge = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        return h[edge], np.diff(np.append(edge, len(h)))
    by = np.argsort(h, kind="stable")
    h, n = h[by], n[by]
    edge = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return h[edge], np.add.reduceat(n, edge) if len(edge) else n


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a hash: its high 32 bits, scaled (so sorted hashes have sorted buckets)."""
    return ((h >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def _count_kernel(buckets: int):
    def kernel(batches):
        held, size = [], 0

        def sent():
            tok = np.concatenate([t for t, _ in held])
            for kind, h in ((1, tok), (2, np.concatenate([b for _, b in held]))):
                h, n = _counted(h)
                edges = np.searchsorted(_bucket(h, buckets), np.arange(buckets + 1))
                n = n.astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(buckets, dtype=np.int64)), pa.array(np.full(buckets, kind, np.int32)), pa.array([h[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary()), pa.array([n[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())],
                    names=["bucket", "kind", "h", "n"],
                )

        for batch in (piece for whole in batches for piece in _pieces(whole, 0)):
            buf, ends = arrow_flat(batch.column(0))
            tok, bounds = tokens(buf, ends)
            held.append((tok, bigrams(tok, bounds)))
            size += len(buf)
            if size >= CHUNK:
                yield from sent()
                held, size = [], 0
        if held:
            yield from sent()

    return kernel


def levels(n: np.ndarray) -> np.ndarray:
    """1 + floor(log2 n)."""
    return np.frexp(n.astype(np.float64))[1].astype(np.int64)


def _entries(h: np.ndarray, level) -> tuple[np.ndarray, np.ndarray]:
    """The start and step of the probe sequence of entries (hash, level)."""
    x = mix(h + np.asarray(level).astype(U64) * U64(0xD1342543DE82EF95))
    return x, mix(x ^ U64(0xA5A5A5A5A5A5A5A5)) | U64(1)


def _bit(x: np.ndarray, step: np.ndarray, probe: int, size) -> np.ndarray:
    """The bit that a probe asks, in a piece of so many bits (below 2**32)."""
    return (((x + step * U64(probe)) >> U64(32)) * np.asarray(size).astype(U64) >> U64(32)).astype(np.int64)


def build_filter(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A log-frequency Bloom filter of these hashes and counts, as bytes."""
    q = levels(n)
    size = max(64, (int(q.sum()) * BITS_PER_ENTRY + 7) // 8 * 8)
    bits = np.zeros(size, dtype=bool)
    rep = np.repeat(np.arange(len(h)), q)
    level = np.arange(len(rep)) - np.repeat(np.cumsum(q) - q, q) + 1
    x, step = _entries(h[rep], level)
    for i in range(PROBES):
        bits[_bit(x, step, i, size)] = True
    return np.packbits(bits)


def ask_filter(data: np.ndarray, base: np.ndarray, size: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The levels of hashes: their filter piece starts at bit ``base`` of data and has ``size`` bits."""
    out = np.zeros(len(h), dtype=np.int64)
    live = np.flatnonzero(size > 0)
    level = 1
    while len(live):
        x, step = _entries(h[live], level)
        for i in range(PROBES):
            at = base[live] + _bit(x, step, i, size[live])
            ok = (data[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            live, x, step = live[ok], x[ok], step[ok]
        out[live] = level
        level += 1
    return out


def _merge_kernel(table_: pa.Table) -> pa.Table:
    """One bucket's blobs -> its words with counts, and its piece of the filter."""
    kind = table_.column("kind").to_numpy()
    hs, ns = table_.column("h").to_pylist(), table_.column("n").to_pylist()
    both = {}
    for k in (1, 2):
        h = np.frombuffer(b"".join(x for x, y in zip(hs, kind, strict=True) if y == k), dtype=U64)
        n = np.frombuffer(b"".join(x for x, y in zip(ns, kind, strict=True) if y == k), dtype=np.uint32).astype(np.int64)
        both[k] = _counted(h, n)
    h, n = both[1]
    piece = build_filter(*both[2]) if len(both[2][0]) else np.zeros(0, np.uint8)
    bucket = table_.column("bucket")[0].as_py()
    return pa.table({"bucket": pa.array([bucket]), "h": pa.array([h.tobytes()], pa.binary()), "n": pa.array([n.tobytes()], pa.binary()), "piece": pa.array([piece.tobytes()], pa.binary()), "words": pa.array([len(h)]), "tokens": pa.array([int(n.sum())])})


def _unpack(batches):
    for batch in batches:
        for h, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(h, np.int64)), pa.array(np.frombuffer(n, np.int64))], names=["h", "n"])


def _bytes(df: DataFrame, text_col: str) -> int:
    return df.agg(F.coalesce(F.sum(F.octet_length(F.coalesce(F.col(text_col), F.lit("")))), F.lit(0)).alias("b")).first()["b"]


class Model:
    """Counts of a training corpus: two tables in the shared folder and bounded values on the driver."""

    def __init__(self, train: DataFrame, text_col: str = "text"):
        size = _bytes(train, text_col)
        self.buckets = max(16, size // BUCKET_BYTES)
        sent = train.select(text_col).mapInArrow(_count_kernel(self.buckets), "bucket long, kind int, h binary, n binary")
        merged = sent.groupBy("bucket").applyInArrow(_merge_kernel, "bucket long, h binary, n binary, piece binary, words long, tokens long")
        self.table = saved(merged)
        self.words = self.table.select("h", "n").mapInArrow(_unpack, "h long, n long")
        total = self.table.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
        self.v, self.n = int(total[0]), int(total[1])
        # the smallest count of a frequent word: from the number of words by count, counts above 2**16 by halves
        step = F.when(F.col("n") < 65536, F.col("n")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("n"))).cast("long"))
        tally = sorted(self.words.groupBy(step.alias("step")).agg(F.count("*").alias("c")).collect(), reverse=True)
        self.least, held = (1 << 62), 0
        for c, k in tally:
            if held + k > TOP_WORDS:
                break
            self.least, held = c, held + k
        top = self.words.filter(F.col("n") >= self.least).toArrow()
        h, n = top.column("h").to_numpy().view(U64), top.column("n").to_numpy()
        by = np.argsort(h)
        self.top = (h[by].copy(), n[by].copy())
        self.whole = self.v == len(n)

    def segments(self):
        """Parts of the filter within the bound: the first bucket, then bit offsets and bytes of the pieces."""
        sizes = {r["bucket"]: r["s"] for r in self.table.select("bucket", F.octet_length("piece").alias("s")).collect()}
        group, size = [], 0
        for b in range(self.buckets):
            if group and size + sizes.get(b, 0) > SEGMENT_BYTES:
                yield group, sizes
                group, size = [], 0
            group.append(b)
            size += sizes.get(b, 0)
        yield group, sizes

    def segment(self, group: list[int], sizes: dict) -> tuple[int, np.ndarray, np.ndarray]:
        data = np.zeros(sum(sizes.get(b, 0) for b in group) + 1, dtype=np.uint8)
        edges = np.cumsum([0, *[sizes.get(b, 0) for b in group]]).astype(np.int64)
        for r in self.table.filter(F.col("bucket").between(group[0], group[-1])).select("bucket", "piece").toLocalIterator():
            i = r["bucket"] - group[0]
            data[edges[i] : edges[i + 1]] = np.frombuffer(r["piece"], np.uint8)
        return group[0], edges * 8, data


def _lookup(top, tok: np.ndarray) -> np.ndarray:
    """Counts of frequent words, 0 for the others."""
    h, n = top
    if len(h) == 0:
        return np.zeros(len(tok), dtype=np.int64)
    at = np.minimum(np.searchsorted(h, tok), len(h) - 1)
    return np.where(h[at] == tok, n[at], 0)


def _sums(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums within bounds (none of which is empty)."""
    return np.add.reduceat(x, bounds[:-1]) if len(bounds) > 1 else np.zeros(0)


_SLICE = 2 << 20


def _pieces(batch, index: int):
    """The batch in slices of about _SLICE bytes of text: the kernels hold many values per byte."""
    ends = arrow_flat(batch.column(index))[1]
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + _SLICE, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def _score_kernel(shared, first: bool, buckets: int, n_tokens: int, whole: bool):
    """(key, doc_id, held_out, text) -> the segment's terms, and the bigrams that wait for counts; in the first segment also what doesn't depend on it.

    whole: words that aren't among the frequent ones have never been seen.
    """

    def kernel(batches):
        top, part = shared.value
        for batch in (piece for whole in batches for piece in _pieces(whole, 3)):
            buf, ends = arrow_flat(batch.column(3))
            tok, bounds = tokens(buf, ends)
            uniq, inverse = np.unique(tok, return_inverse=True)
            cu = _lookup(top, uniq)
            c = cu[inverse]
            two = bigrams(tok, bounds)
            b0, edges, data = part
            where = _bucket(two, buckets) - b0
            mine = (where >= 0) & (where < len(edges) - 1)
            u2, inv2 = np.unique(two[mine], return_inverse=True)
            w2 = _bucket(u2, buckets) - b0
            q = ask_filter(data, edges[w2], edges[w2 + 1] - edges[w2], u2)[inv2]
            low = np.where(q > 0, np.ldexp(1.0, (q - 1).astype(np.int32)), 0.0)
            before = np.empty_like(c)
            before[1:] = c[:-1]
            end_count = _lookup(top, np.array([END], dtype=U64))[0]
            before[bounds[:-1]] = end_count
            p = np.maximum(c, 1) / (n_tokens + 1)
            term = np.zeros(len(tok))
            ctx = np.maximum(before[mine], 1)
            term[mine] = np.log10((np.minimum(low, ctx) + MU * p[mine]) / (ctx + MU))
            wait = np.zeros(len(tok), bool) if whole else mine & ((c == 0) | (before == 0))
            term[wait] = 0
            cols = [batch.column(0), batch.column(1), batch.column(2), pa.array(_sums(term, bounds)), _waiting(tok, bounds, two, wait, c, before, q[wait[mine]])]
            if first:
                base = _sums(np.where(c > 0, np.log10(c + 0.1), 0.0), bounds)
                n = np.diff(bounds)
                miss = np.flatnonzero(c == 0)
                doc = np.searchsorted(bounds, miss, side="right") - 1
                by = np.lexsort((tok[miss], doc))
                d, t = doc[by], tok[miss][by]
                edge = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (t[1:] != t[:-1]))) if len(d) else np.zeros(0, np.int64)
                times = np.diff(np.append(edge, len(d)))
                at = np.searchsorted(d[edge], np.arange(len(n) + 1)).astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(t[edge].view(np.int64)), pa.array(times.astype(np.int64))], names=["h", "k"]))
                cols += [pa.array(base), pa.array(n.astype(np.int64)), pa.array(_sums((c > 0).astype(np.int64), bounds).astype(np.int64)), rare]
            else:
                cols += [pa.nulls(batch.num_rows, t) for t in (pa.float64(), pa.int64(), pa.int64(), _RARE)]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "doc_id", "held_out", "term", "wait", "base", "n", "known", "rare"])

    return kernel


def _waiting(tok: np.ndarray, bounds: np.ndarray, two: np.ndarray, wait: np.ndarray, c: np.ndarray, before: np.ndarray, q: np.ndarray) -> pa.Array:
    """Each document's different bigrams with a word whose count isn't here: both words with the counts known (else 0), level and times.

    In place of a word whose count is known stands a number of no meaning, so that
    common words don't meet in one task of the join.
    """
    at = np.flatnonzero(wait)
    doc = np.searchsorted(bounds, at, side="right") - 1
    by = np.lexsort((two[at], doc))
    at, doc, q = at[by], doc[by], q[by]
    edge = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (two[at[1:]] != two[at[:-1]]))) if len(at) else np.zeros(0, np.int64)
    times = np.diff(np.append(edge, len(at)))
    at, doc, q = at[edge], doc[edge], q[edge]
    h = np.where(np.isin(at, bounds[:-1]), END, tok[at - 1])
    none = mix(two[at] + tok[bounds[doc]] + at.astype(U64))
    cols = {"w": np.where(c[at] == 0, tok[at], none).view(np.int64), "h": np.where(before[at] == 0, h, none).view(np.int64), "cw": c[at].astype(np.int64), "ch": before[at].astype(np.int64), "q": q.astype(np.int32), "k": times.astype(np.int32)}
    edges = np.searchsorted(doc, np.arange(len(bounds))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays([pa.array(x) for x in cols.values()], names=list(cols)))


_WAIT = "array<struct<w:long,h:long,cw:long,ch:long,q:int,k:int>>"
_RARE = pa.list_(pa.struct([("h", pa.int64()), ("k", pa.int64())]))


def pack(x: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes each as the largest needs, the lowest bytes of all first, compressed."""
    if not len(x):
        return b""
    width = max(1, (int(x.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(x).to_bytes(8, "little") + bytes([width]) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, U64)
    n, width = int.from_bytes(data[:8], "little"), data[8]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(data[9:], decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.view("<u8").ravel().astype(U64, copy=False)


def _least(bucket: int, buckets: int) -> np.uint64:
    """The smallest hash of a bucket."""
    return U64(-(-(bucket << 32) // buckets) << 32)


#: Low bits that are zero in all hashes, of words and of bigrams.
_ZEROS = (U64(0), U64(16))


def _bundle_kernel(batches):
    """(doc_id, held_out, text) -> pages: a number of their own and the rows as a compressed Arrow stream."""

    def page(held):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for piece in held:
                out.write_batch(piece)
        return pa.RecordBatch.from_arrays([pa.array([secrets.randbits(63)]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["page", "docs"])

    held, size = [], 0
    for piece in (piece for whole in batches for piece in _pieces(whole, 2)):
        held.append(piece)
        size += int(arrow_flat(piece.column(2))[1][-1])
        if size >= PAGE:
            yield page(held)
            held, size = [], 0
    if held:
        yield page(held)


def _opened(docs: bytes) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """A page's ids and marks, its tokens, their bigrams, and the documents' bounds."""
    rows = pa.ipc.open_stream(docs).read_all()
    tok, two, bounds, n = [], [], [np.zeros(1, np.int64)], 0
    for piece in (piece for batch in rows.to_batches() for piece in _pieces(batch, 2)):
        t, b = tokens(*arrow_flat(piece.column(2)))
        tok.append(t)
        two.append(bigrams(t, b))
        bounds.append(b[1:] + n)
        n += len(t)
    return rows.select([0, 1]), np.concatenate(tok), np.concatenate(two), np.concatenate(bounds)


def _send_kernel(buckets: int):
    """Pages -> for each bucket the distinct words and bigrams and their counts in the training documents."""

    def kernel(batches):
        for batch in batches:
            for page, docs in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, tok, two, bounds = _opened(docs.as_buffer())
                learn = np.repeat(~np.asarray(rows.column(1).combine_chunks().to_numpy(zero_copy_only=False), bool), np.diff(bounds))
                cols = [pa.array(np.arange(buckets)), pa.array(np.full(buckets, page))]
                for h, zeros in zip((tok, two), _ZEROS, strict=True):
                    u, (some, times) = _counted(h)[0], _counted(h[learn])
                    n = np.zeros(len(u), np.int64)
                    n[np.searchsorted(u, some)] = times
                    edges = np.searchsorted(_bucket(u, buckets), np.arange(buckets + 1))
                    parts = list(zip(edges[:-1], edges[1:], strict=True))
                    cols.append(pa.array([pack(np.diff(u[a:b] >> zeros, prepend=_least(i, buckets) >> zeros)) for i, (a, b) in enumerate(parts)], pa.binary()))
                    cols.append(pa.array([pack(n[a:b]) for a, b in parts], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=["bucket", "page", "h", "n", "h2", "n2"])

    return kernel


def _answer_kernel(buckets: int):
    """What all pages sent to a bucket -> for each of them the words' counts and, by the bucket's piece of the filter, the bigrams' levels."""

    def kernel(sent: pa.Table) -> pa.Table:
        low = _least(sent.column("bucket")[0].as_py(), buckets)

        def total(h, n, zeros):
            parts = [np.cumsum(unpack(x), dtype=U64) for x in sent.column(h).to_pylist()]
            parts = [x + (low >> zeros) << zeros for x in parts]
            u, inverse = np.unique(np.concatenate(parts), return_inverse=True)
            count = np.bincount(inverse, np.concatenate([unpack(x) for x in sent.column(n).to_pylist()]).astype(np.float64), len(u)).astype(np.int64)
            return u, count, inverse, np.cumsum([len(x) for x in parts])[:-1]

        u, count, inverse, cuts = total("h2", "n2", _ZEROS[1])
        seen = count > 0
        piece = build_filter(u[seen], count[seen]) if seen.any() else np.zeros(0, np.uint8)
        level = ask_filter(piece, np.zeros(len(u), np.int64), np.full(len(u), len(piece) * 8), u)
        q = [pack(x) for x in np.split(level[inverse], cuts)]
        u, count, inverse, cuts = total("h", "n", _ZEROS[0])
        c = [pack(x) for x in np.split(count[inverse], cuts)]
        once = np.arange(sent.num_rows) == 0
        return pa.table({"page": sent.column("page"), "bucket": sent.column("bucket"), "c": pa.array(c, pa.binary()), "q": pa.array(q, pa.binary()), "words": pa.array(once * int((count > 0).sum())), "tokens": pa.array(once * int(count.sum()))})

    return kernel


def _page_kernel(n_tokens: int, norm: float):
    """A page and its answers -> its documents' scores."""

    def kernel(docs: pa.Table, answers: pa.Table) -> pa.Table:
        rows, tok, two, bounds = _opened(docs.column("docs")[0].as_buffer())
        answers = answers.sort_by("bucket")
        count, level = (np.concatenate([unpack(x) for x in answers.column(a).to_pylist()]).astype(np.int64) for a in ("c", "q"))
        u = _counted(tok)[0]
        c = count[np.searchsorted(u, tok)]
        before = np.empty_like(c)
        before[1:] = c[:-1]
        before[bounds[:-1]] = count[np.searchsorted(u, END)]
        q = level[np.searchsorted(_counted(two)[0], two)]
        low, ctx = np.where(q > 0, np.ldexp(1.0, (q - 1).astype(np.int32)), 0.0), np.maximum(before, 1)
        term = np.log10((np.minimum(low, ctx) + MU * np.maximum(c, 1) / (n_tokens + 1)) / (ctx + MU))
        n = np.diff(bounds)
        cols = {"doc_id": rows.column(0), "held_out": rows.column(1), "n_tokens": n, "n_known": _sums((c > 0).astype(np.int64), bounds), "train_tokens": np.full(len(n), n_tokens), "base_score": _sums(np.log10(c + 0.1), bounds) - n * norm, "score": _sums(term, bounds)}
        return pa.table({k: x if isinstance(x, pa.ChunkedArray) else pa.array(x) for k, x in cols.items()})

    return kernel


def _exchanged(rows: DataFrame, size: int) -> DataFrame:
    """The result by way of pages; size: bytes of all texts."""
    buckets = max(16, size // BUCKET_BYTES)
    pages = saved(rows.select("doc_id", "held_out", "text").mapInArrow(_bundle_kernel, "page long, docs binary"))
    sent = pages.mapInArrow(_send_kernel(buckets), "bucket long, page long, h binary, n binary, h2 binary, n2 binary")
    answers = saved(sent.groupBy("bucket").applyInArrow(_answer_kernel(buckets), "page long, bucket long, c binary, q binary, words long, tokens long"))
    v, n = (int(x) for x in answers.agg(F.sum("words"), F.sum("tokens")).first())
    kernel = _page_kernel(n, float(np.log10(n + 0.1 * (v + 1))))
    return pages.groupBy("page").cogroup(answers.select("page", "bucket", "c", "q").groupBy("page")).applyInArrow(kernel, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _waited(pairs: DataFrame, model: Model) -> DataFrame:
    """``key, _t``: the terms of the bigrams that waited for counts, summed over all rows of a key."""
    counts = model.words.filter(F.col("n") < model.least)
    known = lambda c, n: F.when(F.col(c) > 0, F.col(c)).otherwise(F.greatest(F.coalesce(F.col(n), F.lit(0)), F.lit(1)))
    pairs = pairs.join(counts.select(F.col("h").alias("w"), F.col("n").alias("_n")), "w", "left").withColumn("cw", known("cw", "_n")).drop("w", "_n")
    pairs = pairs.join(counts.withColumnRenamed("n", "_n"), "h", "left").withColumn("ch", known("ch", "_n")).drop("h", "_n")
    low = F.least(F.when(F.col("q") > 0, F.pow(F.lit(2.0), F.col("q") - 1)).otherwise(0.0), F.col("ch").cast("double"))
    return pairs.groupBy("key").agg(F.sum(F.col("k") * F.log10((low + F.lit(MU) * F.col("cw") / F.lit(model.n + 1.0)) / (F.col("ch") + F.lit(MU)))).alias("_t"))


def score(docs: DataFrame, held_out, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    The model learns from the rows where ``held_out`` (a Column) is not true.
    Null texts are empty and have one token, their end; null ids are kept;
    very long texts are scored whole; repeated rows each get their (equal)
    result; an empty table gives no rows, and a table without training rows
    scores by the smoothing alone; other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.xxhash64(F.col(id_col), F.octet_length(text), text).alias("key"), F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), text.alias("text"))
    size = _bytes(rows, "text")
    if size > PASSES * BUCKET_BYTES:
        return _exchanged(rows, size)
    model = Model(rows.filter(~F.col("held_out")))
    parts = []
    for i, (group, sizes) in enumerate(model.segments()):
        shared = spark.sparkContext.broadcast((model.top, model.segment(group, sizes)))
        kernel = _score_kernel(shared, i == 0, model.buckets, model.n, model.whole)
        parts.append(rows.mapInArrow(kernel, f"key long, doc_id long, held_out boolean, term double, wait {_WAIT}, base double, n long, known long, rare array<struct<h:long,k:long>>"))
        parts[-1] = saved(parts[-1])
        shared.destroy()
    first = parts[0].groupBy("key", "doc_id", "held_out").agg(F.count("*").alias("copies"), F.min("base").alias("base"), F.min("n").alias("n"), F.min("known").alias("known"), F.min("term").alias("term"))
    for p in parts[1:]:
        first = first.join(p.groupBy("key").agg(F.min("term").alias("_t")), "key").withColumn("term", F.col("term") + F.col("_t")).drop("_t")
    rare = parts[0].select("key", F.explode("rare").alias("r")).select("key", "r.h", "r.k").groupBy("key", "h").agg(F.min("k").alias("k"))
    found = rare.join(model.words.filter(F.col("n") < model.least).withColumnRenamed("n", "c"), "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    found = found.groupBy("key").agg(F.sum(F.col("k") * F.log10(F.col("c") + F.lit(0.1))).alias("rare_base"), F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("rare_known"))
    if not model.whole:
        pairs = parts[0].select("key", F.inline("wait"))
        for p in parts[1:]:
            pairs = pairs.unionByName(p.select("key", F.inline("wait")))
        first = first.join(_waited(pairs, model), "key", "left").withColumn("term", F.col("term") + F.coalesce(F.col("_t") / F.sum("copies").over(Window.partitionBy("key")), F.lit(0.0))).drop("_t")
    norm = float(np.log10(model.n + 0.1 * (model.v + 1)))
    out = first.join(found, "key", "left").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n") * F.lit(norm)).alias("base_score"), F.col("term").alias("score"),
    )


def op3_lm_score(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents, a tenth held out by the CRC of the id."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0)
