"""Operators against brute force: suffix dedup, Jaccard join, language model, decontamination, mixing, sharding."""

import hashlib
import math
import pathlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strandspark.llm import common, decontaminate, jaccard_join, lm_score, mixing, sharding, suffix_dedup

DOCS = "doc_id long, text string"
TABLE = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())


def shingle_set(t, k=5):
    w = words(t)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def slow_dedup(rows, n):
    seen, raws, out = Counter(), [(i, (t or "").encode()) for i, t in rows], []
    for _, r in raws:
        seen.update(r[s : s + n] for s in range(len(r) - n + 1))
    for i, r in raws:
        cov = bytearray(len(r))
        for s in range(len(r) - n + 1):
            if seen[r[s : s + n]] > 1:
                cov[s : s + n] = b"\1" * n
        kept = bytes(c for c, v in zip(r, cov, strict=True) if not v)
        out.append((i, len(r), sum(cov), sum(1 for j in range(len(r)) if cov[j] and (j == 0 or not cov[j - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("share", "chunk", "hot"), [(2000, 4 << 20, 2000), (3, 500, 2)])
def test_suffix_dedup(spark, monkeypatch, share, chunk, hot):
    monkeypatch.setattr(suffix_dedup, "SHARE", share)
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rng = random.Random(1)
    parts = ["".join(rng.choice("abé d") for _ in range(300)) for _ in range(5)]
    rows = []
    for i in range(80):
        x = "".join(rng.choice("abcé ") for _ in range(rng.randint(0, 150)))
        for _ in range(rng.randint(0, 3)):
            a = rng.randint(0, 200)
            x += rng.choice(parts)[a : a + rng.randint(10, 150)] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 3)))
        rows.append((i, x))
    rows += [(200, "ab" * 300), (201, "q" * 300), (202, None), (203, ""), (204, rows[5][1]), (204, rows[5][1]), (None, parts[0]), (None, None), (205, "z" * 39), (206, "z" * 40), (207, "q" * 41)]
    rows += [(300, "".join(rng.choice("abcdefgh") for _ in range(4000)) + rows[3][1]), (301, parts[1] * 9)]
    got = sorted(map(tuple, suffix_dedup.dedup(spark.createDataFrame(rows, DOCS).withColumns({"tkey": F.lit(1), "spans": F.lit("x"), "copies": F.lit(2), "run": F.lit(3)}), length=40).collect()), key=repr)
    assert got == slow_dedup(rows, 40)
    assert suffix_dedup.dedup(spark.createDataFrame([], DOCS)).collect() == []


def test_colliding_hashes_are_settled_by_bytes(monkeypatch):
    import numpy as np

    buf = np.frombuffer(b"abcdXabcdYabceZabcd", np.uint8)
    start, group = np.array([0, 5, 10, 15]), np.zeros(4, np.int64)
    want = [True, True, False, True]
    assert suffix_dedup.repeated_starts(buf, start, group, 4).tolist() == want
    monkeypatch.setattr(suffix_dedup, "extension", lambda prefix, inv, a, b, limit: np.full(len(a), limit))
    assert suffix_dedup.repeated_starts(buf, start, group, 4).tolist() == want


@pytest.mark.parametrize("sizes", [[2000] * 4000, [8_000_000], [500, 3_000_000, 600]])
def test_suffix_kernels_hold_little(sizes):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    raw = np.random.default_rng(1).integers(97, 123, sum(sizes), dtype=np.uint8).tobytes().decode()
    at = [sum(sizes[:i]) for i in range(len(sizes))] if len(sizes) < 10 else range(0, len(raw), sizes[0])
    texts = [raw[a : a + n] for a, n in zip(at, sizes, strict=True)]
    ids = pa.array(range(len(texts)), pa.int64())
    found = pa.RecordBatch.from_arrays([pa.array([b"%d" % i for i in range(len(texts))]), ids, pa.array(texts)], names=["tkey", "doc", "text"])
    spans = pa.array([[{"b": 0, "e": 400}]] * len(texts), pa.list_(pa.struct({"b": pa.int32(), "e": pa.int32()})))
    marked = pa.RecordBatch.from_arrays([ids, pa.array(texts), pa.nulls(len(texts), pa.int64()), spans], names=["doc_id", "text", "copies", "spans"])
    windows, kept = Counter(), []
    tracemalloc.start()
    try:
        for out in suffix_dedup._emit_runs(400, 200, suffix_dedup.CHUNK)(iter([found])):
            for doc, n in zip(out.column("doc").to_pylist(), out.column("n").to_pylist(), strict=True):
                windows[doc] += n
        found_peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        for out in suffix_dedup._keep(iter([marked])):
            kept += out.column("n_removed").to_pylist()
        kept_peak = tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()
    assert windows == {i: n - 399 for i, n in enumerate(sizes)}
    assert kept == [400] * len(sizes)
    assert found_peak < 140e6
    assert kept_peak < max(6e6, 5 * max(sizes))  # a text four times: as str, as bytes, its kept parts, these joined


def slow_links(rows):
    """(id, class, links, copy class, root) of each row."""
    n, sets, ids = len(rows), [shingle_set(t) for _, t in rows], [1 << 60 if i is None else i for i, _ in rows]
    up, deg = list(range(n)), [0] * n

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (a and b and len(a & b) / len(a | b) >= 0.8):
                deg[i] += 1
                deg[j] += 1
                up[root(i)] = root(j)
    cls, copy, named = {}, {}, lambda x: None if x == 1 << 60 else x
    for i in range(n):
        cls[root(i)] = min(cls.get(root(i), 1 << 60), ids[i])
        copy[sets[i]] = min(copy.get(sets[i], 1 << 60), ids[i])
    return [(named(ids[i]), named(cls[root(i)]), deg[i], named(copy[sets[i]]), root(i)) for i in range(n)]


@pytest.mark.parametrize(("block", "hot"), [(600, 2000), (3, 2)])
def test_jaccard_join(spark, monkeypatch, block, hot):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rng, rows = random.Random(3), []
    vocabulary = [f"w{i}" for i in range(400)]
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([8, 40, 200]))]
        for _ in range(rng.randint(1, 14)):
            x = list(base)
            for _ in range(rng.randint(0, 4)):
                x[rng.randrange(len(x))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(x)))
    # a chain: each text moves on by a little, so only neighbours are alike
    long = [f"c{i}" for i in range(400)]
    rows += [(400 + i, " ".join(long[6 * i : 6 * i + 100])) for i in range(30)]
    rows += [(900, None), (901, ""), (902, "a b"), (903, "A  b\n"), (904, "a"), (None, "a b"), (905, " "), (3, rows[9][1]), (3, rows[3][1]), (3, rows[3][1]), (-1, "minus one"), (None, "no id here"), (None, "no id here"), (None, "nor one here")]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("cls", "rep", "k1", "_key", "band", "m", "row", "_first")})
    slow = slow_links(rows)
    assert sorted(map(tuple, jaccard_join.linked(df).collect()), key=repr) == sorted((x[:4] for x in slow), key=repr)
    first = jaccard_join.representatives(df)
    assert first.columns == df.columns and first.filter("_key <> 1 or row <> 1").count() == 0
    kept = [(r["doc_id"], r["text"]) for r in first.collect()]
    roots = defaultdict(list)
    for x, row in zip(slow, rows, strict=True):
        roots[x[4]].append(row)
    assert len(kept) == len(roots)
    for group in roots.values():
        mine = [x for x in kept if x in group]
        assert len(mine) >= 1 and min((i for i, _ in group if i is not None), default=None) in {i for i, _ in mine}
    links = {frozenset((a, b)) for a, b, _ in map(tuple, jaccard_join.pairs(df.filter("doc_id >= 400 and doc_id < 900")).collect())}
    chain = rows[-44:-14]
    assert links == {frozenset((i, j)) for i, t in chain for j, u in chain if i < j and len(shingle_set(t) & shingle_set(u)) / len(shingle_set(t) | shingle_set(u)) >= 0.8}
    assert jaccard_join.linked(spark.createDataFrame([], DOCS)).collect() == []


def test_posterior_is_a_probability():
    assert jaccard_join.posterior(16, 16, 0.8) == pytest.approx(1 - 0.8**17)
    assert all(0 < m < n for n, m in jaccard_join.least_matches())


@pytest.mark.parametrize(("top", "segment"), [(1 << 19, 128 << 20), (40, 500)])
def test_lm_score(spark, monkeypatch, top, segment):
    monkeypatch.setattr(lm_score, "TOP_WORDS", top)
    monkeypatch.setattr(lm_score, "SEGMENT_BYTES", segment)
    rng = random.Random(4)
    vocabulary = [f"Word{i}" for i in range(120)]
    rows = [(i, " ".join(rng.choice(vocabulary[: rng.choice([10, 120])]) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n"), (103, "never seen Ünïcode"), (rows[0][0], rows[0][1]), (None, "word1")]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0 if i is not None else False
    count = Counter()
    for i, t in rows:
        if not held(i):
            count.update([*words(t), None])
    n, v = sum(count.values()), len(count)
    want = sorted(((i, held(i), len(words(t)) + 1, sum(count[w] > 0 for w in [*words(t), None]), n, round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words(t), None]), 6)) for i, t in rows), key=repr)
    got = lm_score.score(spark.createDataFrame(rows, DOCS), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0).collect()
    assert sorted(((*r[:5], round(r[5], 6)) for r in got), key=repr) == want
    assert all(r["score"] < 0 for r in got)
    seen = [r for r in got if not r["held_out"] and r["n_tokens"] > 20]
    assert sum(r["score"] for r in seen) > sum(r["base_score"] for r in seen)
    assert lm_score.score(spark.createDataFrame([], DOCS), F.lit(False)).collect() == []


@pytest.mark.parametrize("top", [1 << 19, 40])
def test_dealt_bigrams_give_the_scores_of_passes(spark, monkeypatch, top):
    monkeypatch.setattr(lm_score, "TOP_WORDS", top)
    monkeypatch.setattr(lm_score, "SEGMENT_BYTES", 500)
    rng = random.Random(18)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randint(0, 60)))) for i in range(150)]
    rows += [(0, rows[0][1]), (0, rows[0][1]), (200, None), (None, "w1 w2"), (202, "w1 " * 300), (203, " ".join(f"w{i % 700}" for i in range(20_000)))]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("key", "held_out", "term", "n")})
    held = F.col("doc_id") % 10 == 0

    def got():
        return sorted(((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in lm_score.score(df, held).collect()), key=repr)

    monkeypatch.setattr(lm_score, "PASSES", 1000)
    whole = got()
    for passes, pairs in ((0, 1 << 19), (0, 20), (0, 0)):
        monkeypatch.setattr(lm_score, "PASSES", passes)
        monkeypatch.setattr(lm_score, "TOP_PAIRS", pairs)
        assert [x[:4] for x in got()] == [x[:4] for x in whole]
        assert all(abs(a[4] - b[4]) < 1e-4 or pairs and b[4] <= a[4] + 1e-4 for a, b in zip(whole, got(), strict=True))


@pytest.mark.parametrize(("top", "segment"), [(1 << 19, 128 << 20), (40, 500), (0, 128 << 20)])
def test_lm_score_by_brute_force(spark, monkeypatch, top, segment):
    monkeypatch.setattr(lm_score, "TOP_WORDS", top)
    monkeypatch.setattr(lm_score, "SEGMENT_BYTES", segment)
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randint(0, 60)))) for i in range(150)]
    rows += [(0, rows[0][1]), (200, None), (201, "never seen twice never seen"), (202, "w1 " * 300)]
    held = lambda i: i % 10 == 0 or i == 201
    one, two = Counter(), Counter()
    chain = lambda t: [None, *words(t), None]
    for i, t in rows:
        if not held(i):
            one.update(chain(t)[1:])
            two.update(zip(chain(t), chain(t)[1:]))
    n = sum(one.values())

    def slow(t):
        total = 0
        for h, w in zip(chain(t), chain(t)[1:]):
            c = max(one[h], 1)
            low = min(2 ** (two[h, w].bit_length() - 1) if two[h, w] else 0, c)
            total += math.log10((low + lm_score.MU * max(one[w], 1) / (n + 1)) / (c + lm_score.MU))
        return total

    got = lm_score.score(spark.createDataFrame(rows, DOCS), (F.col("doc_id") % 10 == 0) | (F.col("doc_id") == 201)).collect()
    text = dict(rows)
    off = [r["score"] - slow(text[r["doc_id"]]) for r in got]
    # a false answer of the filter can only raise a level
    assert len(got) == len(rows) and min(off) > -1e-9
    assert sum(x < 1e-9 for x in off) > 0.5 * len(off) and max(off) < 2


def test_exchange_of_counts_and_levels_stays_below_the_text(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "PASSES", 0)
    rng = random.Random(27)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.5)) % 10**7}" for _ in range(1000))) for i in range(400)]
    since = common.written()
    got = lm_score.score(spark.createDataFrame(rows, DOCS), F.col("doc_id") % 10 == 0).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == [(i, 1001) for i in range(400)]
    moved = sum(f.stat().st_size for path in common._WRITTEN[since:] for f in pathlib.Path(path.removeprefix("file://")).iterdir())
    assert moved < 1.5 * sum(len(t) for _, t in rows)


def test_packed_numbers_come_back():
    import numpy as np

    for x in ([], [0], [5, 0, 255], [256, 1], [2**64 - 1, 0], range(1000)):
        assert lm_score.unpack(lm_score.pack(np.array(x, dtype=np.uint64))).tolist() == list(x)


def test_log_frequency_filter_gives_levels():
    import numpy as np

    h = lm_score.mix(np.arange(1, 5001, dtype=np.uint64))
    n = (np.arange(5000) % 40) + 1
    piece = lm_score.build_filter(h, n)
    size = np.full(5000, len(piece) * 8)
    got = lm_score.ask_filter(piece, np.zeros(5000, np.int64), size, h)
    assert (got >= lm_score.levels(n)).all() and (got == lm_score.levels(n)).mean() > 0.97
    other = lm_score.ask_filter(piece, np.zeros(5000, np.int64), size, lm_score.mix(np.arange(10**6, 10**6 + 5000, dtype=np.uint64)))
    assert (other > 0).mean() < 0.03


def dict_of(items, item, n):
    """The text of n shingles of an item number."""
    return next(u for i, u in items if i == item and len(shingle_set(u)) == n)


@pytest.mark.parametrize("crowd", [64, 1])
def test_decontaminate_verifies_candidates_of_sketches_alone(spark, monkeypatch, crowd):
    monkeypatch.setattr(decontaminate, "CROWD", crowd)
    rng = random.Random(15)
    stock = " ".join(f"stock{i}" for i in range(12))
    items = [(i, stock + " " + " ".join(f"i{i}x{j}" for j in range(rng.randint(0, 30)))) for i in range(12)]
    docs = [(i, " ".join([*(f"d{i}y{j}" for j in range(rng.randint(0, 200))), rng.choice(items)[1] if i % 3 else stock, *(f"e{i}z{j}" for j in range(rng.randint(0, 3000)))])) for i in range(30)]
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    want = sorted((x, i) for x, t in docs for i, u in items if len(shingle_set(t) & shingle_set(u)) >= math.ceil(0.8 * len(shingle_set(u)) - 1e-9))
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.search(d, b).collect()) == want
    # without sketches nothing is a candidate, so nothing is verified
    monkeypatch.setattr(decontaminate, "sketches", lambda x, t, f=decontaminate.sketches: f(x, t).withColumn("sketch", F.lit(False)))
    assert decontaminate.search(d, b).collect() == []


def test_decontaminate(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 40)))) for i in range(20)] + [(50, None), (51, ""), (52, "one two"), (3, "Other   item of the same number here")]
    docs = []
    for i in range(60):
        x = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        w = rng.choice(items)[1]
        if w and rng.random() < 0.7:
            w = w.split()
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = "changed"
            x += w
        docs.append((i, " ".join(x + [rng.choice(vocabulary)])))
    docs += [(100, None), (101, ""), (102, "ONE\ttwo"), (103, "x " * 3000), (1, docs[2][1]), (1, docs[2][1]), (None, items[4][1])]
    want = sorted(((d, i, len(shingle_set(t) & shingle_set(u)), len(shingle_set(u))) for d, t in set(docs) for i, u in set(items) if shingle_set(u) and len(shingle_set(t) & shingle_set(u)) >= math.ceil(0.8 * len(shingle_set(u)) - 1e-9)), key=repr)
    d, b = spark.createDataFrame(docs, DOCS + "").withColumns({c: F.lit("clash") for c in ("item_id", "_bad", "_text", "_key", "h", "row")}), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((tuple(r)[:4] for r in decontaminate.search(d, b).collect()), key=repr) == want
    bad = {(i, t) for i, t in docs for x in want if x[0] == i and len(shingle_set(t) & shingle_set(dict_of(items, x[1], x[3]))) >= x[2]}
    left = decontaminate.clean(d, b)
    assert left.columns == d.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == sorted((x for x in docs if x not in bad), key=repr)
    assert decontaminate.search(d.limit(0), b).count() == 0 and decontaminate.search(d, b.limit(0)).count() == 0
    nodes = decontaminate.search(d, b)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", nodes)


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(0, 50), "en", s, 0) for i, s in enumerate(rng.choices(["a", "b", "c", None, "d"], [50, 10, 20, 5, 15], k=300))]
    rows += [(1000, None, None, "z", None), (1001, "", None, "z", None), (rows[0][0], *rows[0][1:])]
    got = mixing.mix(spark.createDataFrame(rows, TABLE).withColumn("size", F.lit("clash")), keep=["source"]).collect()
    assert len(got) == len(rows)
    total, by = sum(r["size"] for r in got), defaultdict(list)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[r["source"]].append(r)
    assert sum(x[0]["target"] for x in by.values()) == pytest.approx(total)
    for x in by.values():
        assert abs(sum(r["taken"] for r in x) - x[0]["target"]) <= 1 and x[0]["target"] <= 3 * x[0]["source_size"]
        whole = min(r["taken"] // r["size"] for r in x if r["size"]) if any(r["size"] for r in x) else 0
        assert all(r["taken"] <= (whole + 1) * r["size"] for r in x)
    assert mixing.mix(spark.createDataFrame([], TABLE)).collect() == []
    nulls = [(None, "a b c", "en", "a", 5), (-1, "a b c", "en", "a", 5), (None, "d e", "en", "a", 3)]
    every = mixing.mixed(spark.createDataFrame(nulls, TABLE).withColumns({c: F.lit("x") for c in ("_doc", "_text", "_id", "_key", "row", "size")}), shares=(1,))
    assert every.filter("_id = 'x' and row = 'x' and size = 'x' and _key = 'x'").count() == 3
    every = every.select("doc_id", "text").collect()
    assert sorted(map(tuple, every), key=repr) == sorted([(i, t) for i, t, *_ in nulls], key=repr)
    out = mixing.mixed(spark.createDataFrame(rows, TABLE))
    assert out.columns == TABLE.replace(" long", "").replace(" string", "").split(", ") and out.count() > 0


@pytest.mark.parametrize("hot", [2000, 3])
def test_sharding(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rng = random.Random(7)
    rows = [(i, rng.choice(["same text", f"t{i}", f"pair {i // 4}", f"u{i}"]), "en", "s", 0) for i in range(700)] + [(900, None, None, None, None), (901, "", None, None, None), (902, "", None, None, None), (5, "t5", "en", "s", 0)]
    got = sharding.shard(spark.createDataFrame(rows, TABLE).withColumns({c: F.lit(1) for c in ("_hub", "shard", "slot", "_m", "n", "_one")})).collect()
    by, cut = defaultdict(list), defaultdict(set)
    for r in got:
        by[r["shard"]].append(r["slot"])
        cut[r["text_crc32"]].add(r["shard"])
    assert len(got) == len(rows) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    groups = Counter(zlib.crc32((t or "").encode()) for _, t, *_ in rows)
    small = [k for k, n in groups.items() if 1 < n <= 4]
    assert sum(len(cut[k]) == 1 for k in small) > 0.95 * len(small)
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in got} == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows}
    assert sharding.shard(spark.createDataFrame([], TABLE)).collect() == []


@pytest.mark.parametrize("texts", [[2] * 1600, [2, 3] * 640 + [1] * 160, [2] * 40 + [30] * 50 + [90] * 15 + [1] * 100, [250] * 6, [1500, 2, 2, 2, 700]])
def test_sharding_keeps_groups_whole(spark, texts):
    rows = [(i, f"text {i % 7} {i}") for i, n in enumerate(texts) for _ in range(n)]
    got = sharding.shard(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], DOCS), shards=8).collect()
    size, at = Counter(r["shard"] for r in got), defaultdict(set)
    for r in got:
        at[rows[r["doc_id"]][1]].add(r["shard"])
    quota = len(rows) // 8
    assert len(got) == len(rows) and max(size.values()) - min(size.get(s, 0) for s in range(8)) <= 1
    fit = [t for t, n in Counter(t for _, t in rows).items() if 1 < n <= quota]
    assert sum(len(at[t]) > 1 for t in fit) == 0
