"""N-gram Jaccard join with Bayesian candidate pruning.

Documents with equal sets of word shingles are one class, kept as one row.
Class signatures hold ``BANDS * ROWS`` MinHash values; classes that agree on all
values of a band meet in that band's bucket.  Inside a bucket, pairs are
compared some MinHash values at a time: after n values of which m agree, a
pair is dropped once the posterior probability of a similarity of at least the
threshold, under a uniform prior, is below ``TOLERANCE``.  A bucket sends on no
pairs but a spanning forest of those that stay, so that rows grow with its
members, not their pairs.  The candidates' components bring texts together once:
in a component the pairs that the pruning leaves are verified on their exact
shingle sets, and each class's links are counted where they are found.  A large
component whose members seldom share buckets, a chain say, is verified bucket by bucket instead, each
pair in the first bucket that it shares, so that work follows the candidates and
not the square of the component.  Buckets and components of many classes are cut
into blocks, and every pair of blocks is a task of its own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, dealt_join, id_key, saved, table
from .kernels import U64, arrow_flat, mix, shingles, words

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
#: Values compared between two looks at the posterior.
STEP = 16
TOLERANCE = 1e-7
#: Classes of a bucket that meet in one task.
BLOCK = 600
#: Bytes of text hashed at once.
_SLICE = 2 << 20

_A = mix(np.arange(1, BANDS * ROWS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
_B = mix(np.arange(1, BANDS * ROWS + 1, dtype=U64) * U64(0xC2B2AE3D27D4EB4F))


def posterior(m: int, n: int, t: float) -> float:
    """P(similarity >= t | m of n values agree), uniform prior: the lower tail of a binomial of n + 1 draws."""
    return math.fsum(math.comb(n + 1, i) * t**i * (1 - t) ** (n + 1 - i) for i in range(m + 1))


def least_matches(t: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(n, fewest agreeing values with which a pair stays) at each look."""
    return [(n, next(m for m in range(n + 1) if posterior(m, n, t) >= tolerance)) for n in range(STEP, BANDS * ROWS + 1, STEP)]


def signatures(sh: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash values of each text (16 bits each); texts without shingles have ones of no use."""
    n = len(bounds) - 1
    out = np.zeros((n, len(_A)), dtype=np.uint16)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full) == 0:
        return out
    starts = bounds[:-1][full]
    for j, (a, b) in enumerate(zip(_A, _B, strict=True)):
        low = np.minimum.reduceat((sh * a + b) >> U64(32), starts)
        out[full, j] = (mix(low + U64(j)) >> U64(48)).astype(np.uint16)
    return out


def _sliced(batches, i: int):
    for batch in batches:
        ends = arrow_flat(batch.column(i))[1]
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + _SLICE, side="right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def set_keys(sh: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each text's set of shingles (sums of mixed hashes, and its size)."""
    def sums(x):
        s = np.zeros(len(x) + 1, dtype=U64)
        np.cumsum(x, dtype=U64, out=s[1:])
        return s[bounds[1:]] - s[bounds[:-1]]

    size = np.diff(bounds).astype(U64)
    return mix(sums(mix(sh)) + size), mix(sums(mix(sh ^ U64(0xFEEDFACECAFEBEEF))) ^ (size * U64(0x9E3779B97F4A7C15)))


def _class_kernel(k: int):
    def kernel(batches):
        for batch in _sliced(batches, 1):
            buf, ends = arrow_flat(batch.column(1))
            _, _, h, wb = words(buf, ends)
            sh, b = shingles(h, wb, k)
            k1, k2 = set_keys(sh, b)
            sig = signatures(sh, b)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(np.diff(b).astype(np.int32)), pa.array([x.tobytes() for x in sig], pa.binary())], names=["doc_id", "text_key", "k1", "k2", "n", "sig"])

    return kernel


def _bands(batches):
    """Classes -> a row for each band."""
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, BANDS * ROWS)
        keys = np.ascontiguousarray(sig).view(np.int64).reshape(-1, BANDS)
        n = len(sig)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("cls").to_numpy(), BANDS)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), n)), pa.array(keys.ravel())], names=["cls", "band", "key"])


def _survivors(row: int, other: np.ndarray, sig: np.ndarray, size: np.ndarray, needs: list[tuple[int, int]], threshold: float) -> np.ndarray:
    """Of the members ``other`` those that Bayesian pruning leaves as partners of ``row``."""
    fit = np.minimum(size[other], size[row]) >= threshold * np.maximum(size[other], size[row])  # else no sets of such sizes reach it
    other = other[fit]
    at, hits = 0, np.zeros(len(other), dtype=np.int32)
    for n, m in needs:
        if len(other) == 0:
            break
        hits = hits + (sig[other, at:n] == sig[row, at:n]).sum(axis=1)
        keep = hits >= m
        other, hits, at = other[keep], hits[keep], n
    return other


class _Forest:
    """Components of members as they are joined."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, row: int, others: np.ndarray) -> None:
        new = np.unique(self.label[others])
        if len(new) > 1 or new[0] != self.label[row]:
            self.label[np.isin(self.label, new)] = self.label[row]

    def stars(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges from each component's smallest name to its other members: few different ones where buckets overlap."""
        by = np.lexsort((names, self.label))
        new = np.append(True, self.label[by][1:] != self.label[by][:-1])
        root = names[by[np.flatnonzero(new)[np.cumsum(new) - 1]]]
        return root[~new], names[by][~new]


def _cells(t: pa.Table, cell: str):
    """(first row, end, first row of the second block or None) of each cell of a table sorted by cell and side."""
    key, side = t.column(cell).to_numpy(), t.column("side").to_numpy()
    edges = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    for lo, hi in zip(edges, np.append(edges[1:], len(key)), strict=True) if len(key) else ():
        yield lo, hi, None if side[lo] == 2 else lo + int(np.searchsorted(side[lo:hi], 1))


def _candidate_kernel(threshold: float):
    """Members of a bucket's block pairs -> a spanning forest of the pairs that Bayesian pruning leaves.

    A pair counts in the first band that it shares.
    """
    needs = least_matches(threshold)

    def kernel(t: pa.Table) -> pa.Table:
        t = t.sort_by([("bucket", "ascending"), ("side", "ascending"), ("cls", "ascending")])
        cls, band, size = t.column("cls").to_numpy(), t.column("band").to_numpy(), t.column("n").to_numpy().astype(np.float64)
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, BANDS * ROWS)
        keys = np.ascontiguousarray(sig).view(np.int64).reshape(-1, BANDS)
        out_a, out_b = [], []
        for lo, hi, second in _cells(t, "bucket"):
            forest = _Forest(hi - lo)
            for row in range(lo, hi if second is None else second):
                other = np.arange(row + 1 if second is None else second, hi)
                other = other[forest.label[other - lo] != forest.label[row - lo]]
                if b := band[row]:
                    other = other[~(keys[other, :b] == keys[row, :b]).any(axis=1)]
                if len(other):
                    other = _survivors(row, other, sig, size, needs, threshold)
                if len(other):
                    forest.join(row - lo, other - lo)
            x, y = forest.stars(cls[lo:hi])
            out_a.append(x)
            out_b.append(y)
        return pa.table({"a": pa.array(np.concatenate([np.zeros(0, np.int64), *out_a])), "b": pa.array(np.concatenate([np.zeros(0, np.int64), *out_b]))})

    return kernel


def _sets(column, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles and bounds of all texts, hashed some at a time."""
    parts, sizes, i = [np.zeros(0, U64)], [np.zeros(1, np.int64)], 0
    ends = arrow_flat(column)[1]
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + _SLICE, side="right")) - 1)
        buf, e = arrow_flat(column.slice(i, j - i))
        _, _, h, wb = words(buf, e)
        sh, b = shingles(h, wb, k)
        parts.append(sh)
        sizes.append(np.diff(b))
        i = j
    return np.concatenate(parts), np.cumsum(np.concatenate(sizes))


def _common(sh: np.ndarray, bounds: np.ndarray, rows: range, lo: int, hi: int):
    """For each row, the number of shingles it has in common with the members lo to hi, by their inverted lists."""
    part = sh[bounds[lo] : bounds[hi]]
    owner = np.repeat(np.arange(hi - lo), np.diff(bounds[lo : hi + 1]))
    by = np.argsort(part, kind="stable")
    part, owner = part[by], owner[by]
    for row in rows:
        mine = sh[bounds[row] : bounds[row + 1]]
        first, last = np.searchsorted(part, mine), np.searchsorted(part, mine, side="right")
        n = last - first
        spots = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        yield row, np.bincount(owner[spots], minlength=hi - lo)


def _verify_kernel(k: int, threshold: float, every: bool):
    """Classes of a component's block pairs, with texts -> their verified links.

    every: one row ``a, b, jaccard`` per link.  Else, for each class with links,
    ``a`` and the copies it links to, and ``a, b`` of a spanning forest.
    """
    needs = least_matches(threshold)

    def kernel(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        sh, bounds = _sets(t.column("text").combine_chunks(), k)
        # where ids repeat another text may have come as well, and repeated rows come again
        right = set_keys(sh, bounds)[0].view(np.int64) == t.column("cls").to_numpy()
        by = np.lexsort((t.column("cls").to_numpy(), t.column("side").to_numpy(), t.column("cell").to_numpy()))
        by = by[right[by]]
        key = np.stack([t.column(c).to_numpy()[by] for c in ("cell", "side", "cls")])
        by = by[np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))] if len(by) else by
        sizes = np.diff(bounds)[by]
        sh = np.concatenate([np.zeros(0, U64), *[sh[bounds[i] : bounds[i + 1]] for i in by]])
        bounds = np.append(0, np.cumsum(sizes))
        t = t.drop_columns(["text"]).take(pa.array(by))
        cls, copies, size = t.column("cls").to_numpy(), t.column("copies").to_numpy(), sizes.astype(np.float64)
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, BANDS * ROWS)
        keys, band = np.ascontiguousarray(sig).view(np.int64).reshape(-1, BANDS), t.column("band").to_numpy()
        a, b, sim, more = [], [], [], np.zeros(len(cls), dtype=np.int64)
        for lo, hi, second in _cells(t, "cell"):
            forest = _Forest(hi - lo)
            base = lo if second is None else second
            for row, common in _common(sh, bounds, range(lo, hi if second is None else second), base, hi):
                other = np.arange(row + 1 if second is None else second, hi)
                if band[row]:  # a pair counts in the first band that it shares
                    other = other[~(keys[other, : band[row]] == keys[row, : band[row]]).any(axis=1)]
                other = _survivors(row, other, sig, size, needs, threshold)
                both = common[other - base]
                j = both / (size[other] + size[row] - both)
                ok = j >= threshold
                other, j = other[ok], j[ok]
                if len(other) == 0:
                    continue
                if every:
                    a += [cls[row]] * len(other)
                    b += cls[other].tolist()
                    sim += j.tolist()
                else:
                    more[row] += copies[other].sum()
                    more[other] += copies[row]
                    forest.join(row - lo, other - lo)
            if not every:
                x, y = forest.stars(cls[lo:hi])
                a += x.tolist()
                b += y.tolist()
        if every:
            return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "jaccard": pa.array(sim, pa.float64())})
        ends = np.flatnonzero(more)
        return pa.table({"a": pa.array(np.append(cls[ends], np.array(a, np.int64))), "b": pa.array([None] * len(ends) + b, pa.int64()), "more": pa.array(more[ends].tolist() + [None] * len(a), pa.int64())})

    return kernel


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, component``: the smallest node reachable, by rounds of neighbours' minima and pointer jumps."""
    both = saved(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))))
    label = saved(nodes.select("node", F.col("node").alias("component")))
    while True:
        near = both.join(label, both.v == label.node).groupBy("u").agg(F.min("component").alias("m"))
        step = label.join(near, label.node == near.u, "left").select("node", F.least("component", F.coalesce("m", "component")).alias("c"), F.col("component").alias("old"))
        step = saved(step)
        jump = step.select(F.col("node").alias("j"), F.col("c").alias("cc"))
        new = saved(step.join(jump, step.c == jump.j).select("node", F.col("cc").alias("component"), (F.col("cc") != F.col("old")).alias("moved")))
        moved = new.filter("moved").limit(1).count()
        label = new.select("node", "component")
        if not moved:
            return label


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """One row per document, saved: its id, a hash of its text, ``k1, k2, n`` (keys and size of its shingle set) and its signature."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    return saved(rows.mapInArrow(_class_kernel(k), "doc_id long, text_key long, k1 long, k2 long, n int, sig binary"))


def _blocked(members: DataFrame, crowd: str, name: str, key: list[str]) -> DataFrame:
    """Deals each group's members into blocks and to a cell for each pair of blocks; side 2: a block with itself."""
    cut = members.withColumn("_blocks", F.ceil(F.col(crowd) / F.lit(BLOCK)).cast("int")).withColumn("_mine", F.pmod(F.xxhash64("cls"), F.col("_blocks")).cast("int"))
    cell = F.explode(F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda o: F.struct(F.least("_mine", o).alias("i"), F.greatest("_mine", o).alias("j"), F.when(o == F.col("_mine"), 2).when(F.col("_mine") < o, 0).otherwise(1).alias("side"))))
    return cut.withColumn("_cell", cell).withColumns({name: F.xxhash64(*key, "_cell.i", "_cell.j"), "side": F.col("_cell.side")}).drop("_cell", "_blocks", "_mine", crowd)


def _cells_to_verify(rows: DataFrame, label: DataFrame) -> DataFrame:
    """``cls, cell, side, band`` of the candidates: by component, or by bucket where that makes fewer pairs."""
    label = label.withColumnRenamed("node", "cls")
    total = label.count()
    crowd = saved(label.groupBy("component").agg(F.count("*").alias("m")))
    placed = dealt_join(label, crowd, ["component"], "m", total)
    halves = lambda c: F.col(c).cast("double") * (F.col(c) - 1) / 2
    large = crowd.filter(F.col("m") > BLOCK)
    if large.isEmpty():
        return _blocked(placed, "m", "cell", ["component"]).select("cls", "cell", "side", F.lit(0).alias("band"))
    big = placed.filter(F.col("m") > BLOCK).select("cls", "component")
    spots = saved(rows.join(big, "cls"))
    spot = ["component", "band", "key"]
    per = saved(spots.groupBy(*spot).agg(F.count("*").alias("k")).filter("k > 1"))
    work = per.groupBy("component").agg(F.sum(halves("k")).alias("w"))
    sparse = saved(large.join(work, "component").filter(F.col("w") < halves("m")).select("component", "m"))
    dense = placed.join(sparse.select("component"), "component", "left_anti")
    loose = dealt_join(spots, per.join(sparse.select("component"), "component", "left_semi"), spot, "k", spots.count())
    return (
        _blocked(dense, "m", "cell", ["component"]).select("cls", "cell", "side", F.lit(0).alias("band"))
        .unionByName(_blocked(loose, "k", "cell", spot).select("cls", "cell", "side", "band"))
    )


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, threshold: float = THRESHOLD, every: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, links, marks).

    members: ``doc_id, text_key, k1, k2, n`` of each row; marks: ``k1, k2, n, rep,
    copies, cls`` of each class of equal shingle sets, named ``cls``, the
    smallest id being ``rep``; links between classes: with ``every`` one row
    ``a, b, jaccard`` each, else ``a, more`` (copies that a links to, to be
    added up) and ``a, b`` of spanning forests.
    """
    members = classes(docs, id_col=id_col, text_col=text_col, k=k)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_key"))
    marks = saved(
        members.groupBy("k1", "k2", "n").agg(first.alias("_r"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
        .select("k1", "k2", "n", F.col("_r.doc_id").alias("rep"), F.col("_r.text_key").alias("rep_text"), "copies", "sig", F.col("k1").alias("cls"))
    )
    kinds = marks.filter("n > 0")
    rows = saved(kinds.select("cls", "sig").mapInArrow(_bands, "cls long, band int, key long"))
    crowd = saved(rows.groupBy("band", "key").agg(F.count("*").alias("m")).filter("m > 1"))
    rows = saved(dealt_join(rows, crowd, ["band", "key"], "m", rows.count()))
    met = saved(_blocked(rows, "m", "bucket", ["band", "key"]).select("cls", "band", "bucket", "side"))
    tasks = max(16, int(met.count() // BLOCK))
    with_sig = met.join(kinds.select("cls", "sig", "n"), "cls").withColumn("task", F.pmod("bucket", F.lit(tasks)))
    near = saved(with_sig.groupBy("task").applyInArrow(_candidate_kernel(threshold), "a long, b long").distinct())
    label = components(near, near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct())
    cells = saved(_cells_to_verify(rows.drop("m"), label))
    tasks = max(16, int(cells.count() // BLOCK))
    # one document of each class gives its text: that of the smallest id
    asked = cells.join(kinds.select("cls", "rep", "rep_text", "copies", "sig"), "cls")
    raw = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("_key", F.xxhash64("text"))
    texts = raw.join(asked, F.col("_key").eqNullSafe(F.col("rep_text")) & F.col("_id").eqNullSafe(F.col("rep")))
    texts = texts.select("text", "cls", "cell", "side", "band", "copies", "sig").withColumn("task", F.pmod("cell", F.lit(tasks)))
    out = "a long, b long, jaccard double" if every else "a long, b long, more long"
    return members, saved(texts.groupBy("task").applyInArrow(_verify_kernel(k, threshold, every), out)), marks


def pairs(docs: DataFrame, **options) -> DataFrame:
    """Every link between classes, ``a, b, jaccard``, the classes named by the smallest ids of their rows."""
    _, links, marks = join(docs, every=True, **options)
    name = marks.select("cls", "rep")
    return links.join(name.withColumnsRenamed({"cls": "a", "rep": "_a"}), "a").join(name.withColumnsRenamed({"cls": "b", "rep": "_b"}), "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "jaccard")


def grouped(docs: DataFrame, **options) -> DataFrame:
    """``linked`` with the row's ``text_key`` and ``group``, a key of its class (ids that repeat may share a class_id, not a group)."""
    members, links, marks = join(docs, **options)
    weight = marks.select("cls", "rep", "copies")
    degree = links.filter("more is not null").groupBy("a").agg(F.sum("more").alias("more"))
    forest = links.filter("b is not null").select("a", "b").distinct()
    label = components(forest, degree.select(F.col("a").alias("node")))
    named = label.join(weight, label.node == weight.cls)
    first = named.groupBy("component").agg(F.min("rep").alias("class_id"))
    group = named.join(first, "component").select("node", "component", "class_id")
    per = (
        marks.join(degree, marks.cls == degree.a, "left").join(group, marks.cls == group.node, "left")
        .select("k1", "k2", "n", "copies", F.coalesce("component", "cls").alias("group"), F.when(F.col("component").isNull(), F.col("rep")).otherwise(F.col("class_id")).alias("class_id"), (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).cast("long").alias("n_links"), F.col("rep").alias("copy_class"))
    )
    rows = members.select("doc_id", "text_key", "k1", "k2", "n")
    return dealt_join(rows, saved(per), ["k1", "k2", "n"], "copies", rows.count()).select("doc_id", "text_key", "group", "class_id", "n_links", "copy_class")


def linked(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: ``doc_id, class_id, n_links, copy_class``.

    class_id: the smallest id of the documents reachable over links (word
    shingle sets of Jaccard similarity ``threshold`` or more); n_links: how
    many other rows it links to, copies included; copy_class: the smallest id
    of the rows with an equal shingle set.  Null ids stay null and are no class's
    smallest id unless it has no other.

    A text of fewer than k words has one shingle, of all its words.  Null and
    empty texts have none: they are copies of each other and link to nothing
    else.  Very long texts are compared whole.  Repeated rows are copies.  An
    empty table gives no rows; other columns, whatever their names, are ignored.
    """
    return grouped(docs, **options).select("doc_id", "class_id", "n_links", "copy_class")


def representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with one row of each class left, that of the smallest id (null: largest), then text hash; all columns kept."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_key"))
    key = ["_id", "_no", "_key"]  # plain equality, so that join and window are dealt out alike
    first = grouped(docs, id_col=id_col, text_col=text_col, **options).groupBy("group").agg(least.alias("_f"))
    first = first.select(*[c.alias(n) for n, c in id_key(F.col("_f.doc_id")).items()], F.col("_f.text_key").alias("_key"))
    keyed = boxed(docs, **id_key(F.col(id_col)), _key=F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    one = keyed.join(first, key).withColumn("_row", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0))))
    return one.filter("_row = 1").select("row.*")


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Query: all documents, five words, 0.8."""
    return linked(table(spark, sf_dir, "documents"))
