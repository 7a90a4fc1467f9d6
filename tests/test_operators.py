import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandspark import model
from strandspark.functions import stats
from strandspark.functions.rng import Stream
from strandspark.operators import background, dedup, discover, enrich, post, scan, seed, seqtools, shuffle
from strandspark.sources import sequences

PPM = np.array([[0.02, 0.94, 0.02, 0.02], [0.94, 0.02, 0.02, 0.02], [0.02, 0.94, 0.02, 0.02], [0.02, 0.02, 0.94, 0.02], [0.02, 0.02, 0.02, 0.94], [0.02, 0.02, 0.94, 0.02]])


def make(spark, texts):
    return spark.createDataFrame([(i, f"s{i}", "", t) for i, t in enumerate(texts)], "seq_num long, name string, comment string, seq string")


def slow_hits(texts, m, masked=False):
    out = []
    for i, t in enumerate(texts):
        for a in range(len(t) - m.width + 1):
            w = t[a : a + m.width]
            if all(c in ("ACGTU" if masked else "ACGTUacgtu") for c in w):
                codes = ["ACGT".index(c.upper().replace("U", "T")) for c in w]
                for strand, pwm in (("+", m.pwm), ("-", m.pwm[::-1, ::-1])):
                    s = sum(int(pwm[j][c]) for j, c in enumerate(codes))
                    if s >= m.threshold:
                        out.append((f"s{i}", a + 1, a + m.width, strand, w, s))
    return sorted(out)


def test_scan_against_loop_and_chunks(spark, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ACGTacgtNU") for _ in range(rng.randint(0, 400))) for _ in range(30)] + ["", "CACGTG", "CACGT"]
    m = scan.prepare([model.Motif("e", PPM)], pvalue=5e-3)[0]
    for masked in (False, True):
        got = sorted(tuple(r) for r in scan.scan(make(spark, texts), [m], masked=masked).select("seq_name", "start", "end", "strand", "match", "score_i").collect())
        assert got == slow_hits(texts, m, masked)
    small = scan.chunked(make(spark, texts).select("name", "seq"), 5, 50)
    rows = small.select("name", "seq", "offset", F.lit(True).alias("p"), F.lit(True).alias("m"))
    cut = scan._finish(rows.mapInArrow(scan._kernel([m], False, False), scan._OUT).withColumnRenamed("key", "seq_name"))
    assert sorted(tuple(r) for r in cut.select("seq_name", "start", "end", "strand", "match", "score_i").collect()) == slow_hits(texts, m)


def slow_dedup(rows):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[3], r[4])):
        if all(r[0] != k[0] or r[1] > k[2] or r[2] < k[1] for k in kept):
            kept.append(r)
    return sorted(kept)


def test_dedup_against_loop(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), a := rng.randint(1, 300), a + rng.randint(0, 15), float(rng.randint(1, 9)), i) for i in range(200)]
    df = spark.createDataFrame(rows, "seq_name string, start long, end long, score double, arrival long")
    for n in (1, 5):
        got = sorted(tuple(r) for r in dedup.dedup(df.repartition(n), F.col("score"), keys=["seq_name"]).collect())
        assert got == slow_dedup(rows)


def test_greedy_over_many_runs(monkeypatch):
    rng = random.Random(25)
    rows = [(a := rng.randint(0, 3000), a + rng.randint(0, 6)) for _ in range(2000)]
    kept = []
    for i, (s, e) in enumerate(rows):
        if all(s > rows[j][1] or e < rows[j][0] for j in kept):
            kept.append(i)
    for run in (4, 1000):
        monkeypatch.setattr(dedup, "_RUN", run)
        assert list(dedup.greedy(rows)) == kept


def test_order_of_closing_chains(spark):
    rows = [("a", 1, 5, 0), ("b", 1, 9, 1), ("a", 4, 8, 2), ("a", 20, 25, 3), ("b", 30, 31, 4), ("a", 40, 41, 5)]
    got = dedup.by_closing(spark.createDataFrame(rows, "seq_name string, start long, end long, arrival long"), ["seq_name"]).orderBy("rank")
    # a's first chain closes at 3, b's at 4, a's second at 5; then what is open, a before b
    assert [r["arrival"] for r in got.collect()] == [0, 2, 1, 3, 5, 4]


def test_islands_do_not_depend_on_blocks(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None]), a := rng.randint(-20, 900), a + rng.choice([0, 3, 10, 150]), i) for i in range(150)]
    df = spark.createDataFrame(rows, "seq_name string, start long, end long, arrival long")
    expected = []
    for key in ("a", "b", None):
        island, top = 0, None
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[3])):
            island += top is None or r[1] > top
            top = r[2] if top is None else max(top, r[2])
            expected.append((r[3], island))
    for block in (7, 64, 1 << 20):
        got = dedup.islands(df, ["seq_name"], block=block)
        assert got.columns == [*df.columns, "island"]
        assert sorted((r["arrival"], r["island"]) for r in got.collect()) == sorted(expected)
    assert dedup.islands(df.limit(0), ["seq_name"]).count() == 0


def test_dedup_stream_decides_closed_chains(spark, tmp_path):
    from strandspark.streaming.dedup import dedup_stream

    rng = random.Random(7)
    rows = sorted((rng.choice("ab"), a := rng.randint(1, 200), a + rng.randint(0, 12), float(rng.randint(1, 9)), i) for i in range(80))
    rows = sorted(rows, key=lambda r: (r[1], r[4]))
    (tmp_path / "in").mkdir()
    ends = [("a", 10_000, 10_001, 1.0, 900), ("b", 10_000, 10_001, 1.0, 901)]  # close what was open
    for i, part in enumerate((rows[:40], rows[40:], ends)):
        spark.createDataFrame(part, "key string, start long, end long, priority double, arrival long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"p{i}"))
    stream = spark.readStream.schema("key string, start long, end long, priority double, arrival long").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in" / "p*"))
    q = dedup_stream(stream).writeStream.format("memory").queryName("kept").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("kept").filter("start < 10000").collect())
    assert got == slow_dedup(rows)


def test_statistics(spark):
    assert stats.fisher_greater(3, 1, 1, 3) == pytest.approx(17 / 70)
    df = spark.createDataFrame([("x", float(v), p) for v, p in [(1, False), (2, False), (2, True), (3, True), (4, True)]], "k string, v double, p boolean")
    r = stats.mann_whitney(df, "k", "v", F.col("p")).first()
    assert (r["u"], r["auc"]) == (5.5, pytest.approx(5.5 / 6))
    q = [r["qvalue"] for r in stats.bh(spark.createDataFrame([(0.01,), (0.02,), (0.03,), (0.5,)], "pvalue double")).orderBy("pvalue").collect()]
    assert q == pytest.approx([0.04, 0.04, 0.04, 0.5])


def test_splitmix_has_its_published_values():
    from strandspark.functions.rng import splitmix64

    state, out = 1234567, []
    for _ in range(5):
        state, x = splitmix64(state)
        out.append(x)
    assert out == [6457827717110365317, 3203168211198807973, 9817491932198370423, 4593380528125082431, 16408922859458223821]


def test_mann_whitney_p_by_normal_tail(spark):
    import math

    rng = random.Random(29)
    rows = [("k", float(rng.randint(0, 12)), i % 3 == 0) for i in range(80)]
    r = stats.mann_whitney(spark.createDataFrame(rows, "k string, v double, p boolean"), "k", "v", F.col("p")).first()
    x, y = [v for _, v, p in rows if p], [v for _, v, p in rows if not p]
    u = sum((a > b) + 0.5 * (a == b) for a in x for b in y)
    n, m = len(x), len(y)
    ties = sum(t**3 - t for t in Counter(v for _, v, _ in rows).values())
    z = (u - n * m / 2 - 0.5) / math.sqrt(n * m / 12 * (n + m + 1 - ties / ((n + m) * (n + m - 1))))
    assert (r["u"], r["z"], r["pvalue"]) == (pytest.approx(u), pytest.approx(z), pytest.approx(0.5 * math.erfc(z / math.sqrt(2))))


def test_ranges_are_bound_and_names_told_apart(spark):
    s = make(spark, ["ACGTACGT", "GG"])
    r = sequences.range_from_text(spark, "s0:2-99:-")
    assert tuple(sequences.bound(r, s).select("seq_name", "start", "end", "strand", "seq").first()) == ("s0", 2, 8, "-", "ACGTACGT")
    assert sequences.bound(r, s, clip=False).first()["end"] == 99
    for text in ("s9:0-2", "s1:2-4"):
        with pytest.raises(Exception, match="outside any sequence"):
            sequences.bound(sequences.range_from_text(spark, text), s).collect()
        assert sequences.bound(sequences.range_from_text(spark, text), s, strict=False).count() == 0
    for text in ("s0:4-4", "s0", "s0:1-2:x"):
        with pytest.raises(model.MotifError):
            sequences.range_from_text(spark, text)
    twice = s.unionByName(s).withColumn("seq_num", F.monotonically_increasing_id())
    with pytest.raises(Exception, match="more than once"):
        sequences.renamed(twice, "seq_num").collect()
    assert len({x["name"] for x in sequences.renamed(twice, "seq_num", rename=True).collect()}) == 4


def test_strands_of_units(spark):
    rows = [("a", "CACGTT", "+"), ("b", "AACGTG", "-"), ("c", "AACGTG", "+"), ("d", "AACGTG", ".")]
    m = scan.exact("CACGTT")
    got = {r["unit"]: r["n_hits"] for r in enrich.units(spark.createDataFrame(rows, "unit string, seq string, strand string"), m).collect()}
    assert got == {"a": 1, "b": 1, "c": 0, "d": 1}
    assert {r["unit"]: r["n_hits"] for r in enrich.units(spark.createDataFrame(rows, "unit string, seq string, strand string"), m, forward=True).collect()} == {"a": 1, "b": 0, "c": 0, "d": 0}


def test_refining_extends_and_can_refuse(spark):
    rng = random.Random(30)
    letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    s = make(spark, [letters(30) + "GCACGTGC" + letters(30) for _ in range(80)])
    core = model.Motif("core", PPM)
    wide = discover.refine(core, s, pvalue=1e-3, extend=True)
    assert model.consensus(wide.ppm) == "GCACGTGC"
    assert discover.refine(core, s, pvalue=1e-3, gate=True) is not None
    sharp = model.Motif("sharp", np.where(PPM > 0.5, 0.997, 0.001))
    noisy = make(spark, [letters(200) + (letters(2) + "CACGT" + letters(1)) for _ in range(80)])
    assert discover.refine(sharp, noisy, pvalue=2e-3, gate=True) is None
    assert discover.refine(core, make(spark, ["TTTT"]), pvalue=1e-3) is None


def test_comparison_with_columns_of_a_grid_by_slow_model(spark):
    import itertools
    import math

    from strandspark.operators import compare

    q, t = model.Motif("q", PPM[:3]), [model.Motif("same", PPM[:3]), model.Motif("rc", PPM[:3][::-1, ::-1]), model.Motif("other", PPM[3:][[2, 0, 1]])]
    got = {r["target_id"]: r for r in compare.compare(spark, [q], t, q=1.0, min_overlap=3, enumerate_null=True).collect()}
    cols, weight = compare.enumerated_columns((0.25,) * 4)
    assert len(cols) == 56 and weight.sum() == pytest.approx(1) and (cols.sum(axis=1) == pytest.approx(1))
    pick = rng_columns = list(range(56))
    bins = [[math.floor((compare._similar(c, cols[[j]])[0] + 1) / 2 * 50 + 0.5) for j in pick] for c in q.ppm]
    pmf = Counter()
    for i, j, k in itertools.product(rng_columns, repeat=3):
        pmf[bins[0][i] + bins[1][j] + bins[2][k]] += weight[i] * weight[j] * weight[k]
    best = got["same"]
    assert (best["offset"], best["orientation"], best["overlap"]) == (0, "+", 3) and best["score"] == pytest.approx(3)
    assert best["p_value"] == pytest.approx(2 * sum(p for b, p in pmf.items() if b >= 150), rel=1e-6)
    assert got["rc"]["orientation"] == "-" and got["rc"]["score"] == pytest.approx(3)


def test_rng_is_even():
    r = Stream(1)
    n = Counter(r.below(7) for _ in range(7000))
    assert min(n.values()) > 850 and len({Stream(1).next(), Stream(2).next()}) == 2


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_euler_keeps_kmers(spark, k):
    rng = random.Random(k)
    texts = ["".join(rng.choice("ACGTN") for _ in range(rng.randint(30, 200))) for _ in range(20)]
    one = {r["name"]: r["seq"] for r in shuffle.shuffle(make(spark, texts), k).collect()}
    again = {r["name"]: r["seq"] for r in shuffle.shuffle(make(spark, texts).repartition(3), k).collect()}
    assert one == again and len(one) == 20
    count = lambda s: Counter(s[i : i + k] for i in range(len(s) - k + 1))
    for i, t in enumerate(texts):
        assert count(one[f"s{i}"]) == count(t)
    assert any(one[f"s{i}"] != t for i, t in enumerate(texts))


def test_other_shuffles(spark):
    s = make(spark, ["ACGTACGTTTGACA", "AC"])
    lin = shuffle.shuffle(s, 3, method="linear").collect()
    assert len(lin) == 1 and Counter(lin[0]["seq"]) == Counter("ACGTACGTTTGACA") and lin[0]["seq"].endswith("CA")
    mk = shuffle.shuffle(s, 2, method="markov").filter("name = 's0'").first()["seq"]
    assert len(mk) == 14 and mk[0] == "A"
    assert shuffle.shuffle(s, 2, repeats=2).filter("name like 's0-%'").count() == 3
    assert shuffle.shuffle(s, 2, keep_short=True).count() == 2 and shuffle.shuffle(s, 2, rna=True).filter("seq like '%T%'").count() == 0
    with pytest.raises(model.MotifError):
        shuffle.shuffle(s, 10)


def test_shuffles_draw_every_order_as_often():
    import itertools

    def counted(text, k, method, n=12_000):
        return Counter(shuffle.shuffled([text] * n, shuffle.row_seeds(3, [str(i) for i in range(n)]), k, method))

    kmers = lambda s: Counter(s[i : i + 2] for i in range(len(s) - 1))
    paths = {"A" + "".join(p) for p in itertools.permutations("CACGAGTA") if kmers("A" + "".join(p)) == kmers("ACACGAGTA")}
    for got, kinds in ((counted("ACACGAGTA", 2, "euler"), paths), (counted("ABCD", 1, "euler"), {"".join(p) for p in itertools.permutations("ABCD")}), (counted("AABBCCDD", 2, "linear"), None)):
        assert kinds is None or set(got) == kinds
        assert min(got.values()) > 0.85 * 12_000 / len(got) and max(got.values()) < 1.15 * 12_000 / len(got)
    assert len(counted("ABCD", 1, "linear")) == 6  # cycles of four blocks
    # after A: A or twice B, after B: A
    drawn = counted("AABAB", 2, "markov")
    assert drawn["ABABA"] / 12_000 == pytest.approx(4 / 9, abs=0.02) and drawn["AAAAA"] / 12_000 == pytest.approx(1 / 81, abs=0.005)


@pytest.mark.parametrize("method", ["euler", "markov", "linear"])
def test_a_shuffle_does_not_depend_on_its_batch(method, monkeypatch):
    rng = random.Random(21)
    texts = ["".join(rng.choice("ACGTNé") for _ in range(rng.randint(0, 90))) for _ in range(50)]
    seeds = shuffle.row_seeds(4, [str(i) for i in range(50)])
    whole = shuffle.shuffled(texts, seeds, 3, method)
    monkeypatch.setattr(shuffle, "SLICE", 100)
    assert shuffle.shuffled(texts, seeds, 3, method) == whole
    assert all(len(a) == len(b) for a, b in zip(texts, whole, strict=True))
    for a, b in zip(texts, whole, strict=True):
        n = len(a) // 3
        if method == "linear":
            assert Counter(a[3 * i : 3 * i + 3] for i in range(n)) == Counter(b[3 * i : 3 * i + 3] for i in range(n)) and a[3 * n :] == b[3 * n :]
        if method == "euler":
            assert Counter(a[i : i + 3] for i in range(len(a) - 2)) == Counter(b[i : i + 3] for i in range(len(b) - 2))


def test_shuffles_of_ranges_leave_the_rest(spark):
    text = "AAAAACGTACGTACGTCCCCCGGTTGGTTGGTTAAAAA"
    s = make(spark, [text, "TTTT"])
    ranges = spark.createDataFrame([(0, "s0", 5, 16, ".", "."), (1, "s0", 21, 33, ".", "."), (2, "s0", 0, 2, ".", ".")], "range_id long, seq_name string, start long, end long, name string, strand string")
    got = {r["name"]: r["seq"] for r in shuffle.shuffle(s, 2, ranges=ranges).collect()}
    new = got["s0"]
    assert got["s1"] == "TTTT" and new != text and new[:5] == text[:5] and new[16:21] == text[16:21] and new[33:] == text[33:]
    for a, b in ((5, 16), (21, 33)):
        assert Counter(text[i : i + 2] for i in range(a, b - 1)) == Counter(new[i : i + 2] for i in range(a, b - 1))


def test_seed_truth_holds(spark):
    m = model.Motif("e", np.array([[0, 1, 0, 0], [1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0]], float))
    few = seed.plant(make(spark, ["T" * 80, "T" * 6]), [m], number=3, gap=1)
    assert [(r["name"], r["n_sites"] < 3) for r in seed.shortfalls(few, 3).collect()] == [("s1", True)]
    lines = [r["value"].split("\t") for r in seed.truth_bed(few).filter("value like 's0%'").collect()]
    assert len(lines) == 3 and all(x[3:5] == ["e", "."] and int(x[2]) - int(x[1]) == 4 and x[5] in "+-" for x in lines)
    p = seed.plant(make(spark, ["T" * 80] * 5), [m], number=3, gap=1).collect()
    for r in p:
        assert len(r["sites"]) == 3 and len(r["seq"]) == 80
        for x in r["sites"]:
            assert r["seq"][x["start"] : x["end"]] == ("CACG" if x["strand"] == "+" else "CGTG")


def test_seqtools(spark):
    s = make(spark, ["ACGTNacgtn", "AUGC", ""])
    assert [r["seq"] for r in seqtools.reverse_complement(seqtools.reverse_complement(make(spark, ["ACGTRYnacgt"]))).collect()] == ["ACGTRYnacgt"]
    r = scan.seq_stats(s).orderBy("seq_num").collect()
    assert [x["n_count"] for x in r] == [2, 0, 0] and r[2]["gc_pct"] == 0
    ranges = spark.createDataFrame([(0, "s0", 2, 4, ".", "+"), (1, "s0", 8, 99, "x", "-")], "range_id long, seq_name string, start long, end long, name string, strand string")
    assert {x["name"]: x["seq"] for x in seqtools.subset(s, ranges).collect()} == {"s0:2-4": "GT", "x": "na"}
    assert seqtools.mask(s, ranges).filter("name = 's0'").first()["seq"] == "ACgtNacgtn"
    assert seqtools.mask(s, ranges, hard=True).filter("name = 's0'").first()["seq"] == "ACNNNacgNN"
    assert seqtools.kmer_matrix(seqtools.kmer_counts(s, 1), 1).orderBy("name").first()["N"] == 2
    assert seqtools.reservoir(s, 2, 1).count() == 2


def test_fasta_bed_and_hits(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one two words\nACGT\nAC\n\n>x\nGG\n")
    assert [tuple(r)[1:] for r in sequences.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("seq_num").collect()] == [("one", "two words", "ACGTAC"), ("x", "", "GG")]
    (tmp_path / "a.fq").write_text("@r1 c\nACGT\n+\nIIII\n@r2\nGG\n+\nII\n")
    assert [(r["name"], r["seq"], r["qual"]) for r in sequences.read_fastq(spark, str(tmp_path / "a.fq")).collect()] == [("r1", "ACGT", "IIII"), ("r2", "GG", "II")]
    (tmp_path / "a.bed").write_text("#c\ntrack x\ns1\t2\t9\n\ns2\t0\t4\tname more\t0\t-\n")
    assert [tuple(r)[1:] for r in sequences.read_bed(spark, str(tmp_path / "a.bed")).orderBy("range_id").collect()] == [("s1", 2, 9, ".", "."), ("s2", 0, 4, "name", "-")]
    (tmp_path / "bad.bed").write_text("s1\t9\t2\n")
    with pytest.raises(Exception, match="bad BED row"):
        sequences.read_bed(spark, str(tmp_path / "bad.bed")).collect()
    assert [r["value"] for r in sequences.fasta_text(make(spark, ["ACGTACG"]), 3).collect()] == [">s0\nACG\nTAC\nG"]
    got = spark.createDataFrame([(x,) for x in (0.0078125, 1e-12, 0.5, 1.0, 0.000244140625)], "p double").select(sequences.shortest(F.col("p"))).collect()
    assert [r[0] for r in got] == [f"{x:.9g}" for x in (0.0078125, 1e-12, 0.5, 1.0, 0.000244140625)]


def test_fastq_is_numbered_over_blocks_and_files(spark, tmp_path):
    rng = random.Random(26)
    want = []
    for f in "ab":
        reads = [(f"{f}{i}", "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 60)))) for i in range(300)]
        (tmp_path / f"{f}.fq").write_text("".join(f"@{n} c\n{s}\n+\n{'I' * len(s)}\n" for n, s in reads))
        want += reads
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        got = sequences.read_fastq(spark, str(tmp_path / "*.fq")).orderBy("seq_num").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert [(r["name"], r["seq"]) for r in got] == want and [r["seq_num"] for r in got] == list(range(1, 601))
    (tmp_path / "bad.fq").write_text("@a\nACG\n+\nII\n")
    with pytest.raises(Exception, match="bad FASTQ"):
        sequences.read_fastq(spark, str(tmp_path / "bad.fq")).collect()


def test_gzip_is_read(spark, tmp_path):
    import gzip

    (tmp_path / "a.fa.gz").write_bytes(gzip.compress(b">x y\nACGT\n>z\nAC\n"))
    assert sorted(r["seq"] for r in sequences.read_fasta(spark, str(tmp_path / "a.fa.gz")).collect()) == ["AC", "ACGT"]


def test_tables_of_hits_and_ranges_to_dedup(spark, tmp_path):
    write = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    hits = sequences.read_hits(spark, write("h.txt", "##strandspark [ ]\n##MotifCount=1\n##seq_name\tstart\nc\t3\t8\t+\tm\t0.001\t5.5\t80.0\tCACGTG\n"))
    r = hits.first()
    assert (r["seq_name"], r["start"], r["end"], r["pvalue"], r["match"], r["bed_name"]) == ("c", 3, 8, 0.001, "CACGTG", None)
    wide = sequences.read_hits(spark, write("w.txt", "##bed_range\tbed_name\tseq_name\nc:1-9(.)\tr\tc\t3\t8\t+\tm\t0.001\t5.5\t80.0\tCACGTG\n")).first()
    assert (wide["bed_range"], wide["seq_name"], wide["start"]) == ("c:1-9(.)", "c", 3)
    path = write("b.bed", "track x\n#c\nc\t2\t8\tm\t7\t-\nc\t8\t9\tm\t3\t+\n\n")
    bed = sequences.read_hits(spark, path).orderBy("arrival").collect()
    assert [(x["start"], x["end"], x["score"], x["strand"], x["motif"]) for x in bed] == [(3, 8, 7.0, "-", "m"), (9, 9, 3.0, "+", "m")]
    assert [x["value"] for x in sequences.comments(spark, path).collect()] == ["track x", "#c"]
    for i, (bad, why) in enumerate([("c\t2\t8\n", "number of fields"), ("c\tx\t8\tm\t1\t+\n", "start or end"), ("c\t2\t8\tm\tx\t+\n", "score"), ("c\t9\t8\tm\t1\t+\n", "start beyond"), ("c\t2\t8\tm\t1\t*\n", "strand"), ("##seq_name\tx\nc\t3\t8\t+\tm\t0\t5.5\t80.0\tC\n", "above 0")]):
        with pytest.raises(Exception, match=why):
            sequences.read_hits(spark, write(f"bad{i}.txt", bad)).collect()
    s = make(spark, ["ACGTN", "GG"])
    text = [x["value"] for x in sequences.hit_report(hits, s, [6, 2], options="-t 1").collect()]
    assert text[:3] == ["##strandspark [ -t 1 ]", "##MotifCount=2 MotifSize=8 SeqCount=2 SeqSize=7 GC=66.67% Ns=1 MaxPossibleHits=10", "##seq_name\tstart\tend\tstrand\tmotif\tpvalue\tscore\tscore_pct\tmatch"]
    assert text[3] == "c\t3\t8\t+\tm\t0.001\t5.500\t80.0\tCACGTG"


def test_sets_and_options_are_checked(spark):
    assert seqtools.checked(make(spark, ["ACGT"])) == [] and "20.0%" in seqtools.checked(make(spark, ["ACGTN"]))[0]
    for bad in ([], ["", ""], ["NNN"]):
        with pytest.raises(model.MotifError):
            seqtools.checked(make(spark, bad))
    seqtools.check_options("mask", ["ranges", "hard"])
    seqtools.check_options("subsample", ["n", "seed"])
    for action, given in (("mask", []), ("dup", []), ("rc", ["n"]), ("subsample", ["n", "share"]), ("subsample", []), ("format", ["hard"]), ("fly", [])):
        with pytest.raises(model.MotifError):
            seqtools.check_options(action, given)


def test_masks_of_overlapping_ranges(spark):
    rng = random.Random(27)
    text = "".join(rng.choice("ACGTé") for _ in range(200))
    parts = [(a := rng.randint(0, 190), a + rng.randint(1, 30)) for _ in range(25)]
    ranges = spark.createDataFrame([(i, "s0", a, b, ".", ".") for i, (a, b) in enumerate(parts)], "range_id long, seq_name string, start long, end long, name string, strand string")
    inside = {i for a, b in parts for i in range(a, b)}
    got = {hard: seqtools.mask(make(spark, [text, "ACGT"]), ranges, hard=hard).orderBy("seq_num").collect() for hard in (False, True)}
    assert got[False][0]["seq"] == "".join(c.lower() if i in inside else c for i, c in enumerate(text)) and got[False][1]["seq"] == "ACGT"
    assert got[True][0]["seq"] == "".join("N" if i in inside else c for i, c in enumerate(text))


def test_fisher_by_the_whole_tail():
    import math

    rng = random.Random(28)
    for _ in range(300):
        a, b, c, d = (rng.randint(0, rng.choice([3, 40])) for _ in range(4))
        r1, c1, n = a + b, a + c, a + b + c + d
        slow = sum(math.comb(r1, x) * math.comb(n - r1, c1 - x) for x in range(a, min(r1, c1) + 1) if 0 <= c1 - x <= n - r1) / math.comb(n, c1) if n else 1.0
        assert stats.fisher_greater(a, b, c, d) == pytest.approx(slow, rel=1e-9, abs=1e-300)
    assert 0 < stats.fisher_greater(10**8 + 50_000, 10**8, 10**8, 10**8) < 1


def test_enrich_discover_refine_find_the_planted_motif(spark):
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    pos = [letters(40) + "CACGTG" + letters(40) for _ in range(60)]
    neg = [letters(86) for _ in range(60)]
    p, n = make(spark, pos), make(spark, neg)
    both = p.withColumn("positive", F.lit(True)).unionByName(n.withColumn("positive", F.lit(False))).withColumn("unit", F.col("name"))
    ready = scan.prepare([model.Motif("e", PPM)], pvalue=1e-3)
    for test in ("seqs", "sites", "ranksum"):
        r = enrich.enrich(both, ready, test=test).collect()
        assert len(r) == 1 and r[0]["pvalue"] < 1e-6
    found = discover.discover(p, n, widths=[6], per_width=1)
    assert found and "CACGTG" in model.consensus(found[0].motif.ppm)
    m = discover.refine(model.Motif("seed", PPM), p, pvalue=1e-3)
    assert model.consensus(m.ppm) == "CACGTG"


def test_enrichment_and_discovery_without_negatives(spark):
    rng = random.Random(19)
    letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    pos = [letters(40) + "CACGTG" + letters(40) for _ in range(60)] + ["A", ""]
    units = make(spark, pos).withColumn("unit", F.col("name"))
    null = enrich.with_null(units.withColumn("strand", F.lit("+")))
    both = {p: {r["unit"]: r for r in null.filter(F.col("positive") == p).collect()} for p in (True, False)}
    count = lambda s: Counter(s[i : i + 2] for i in range(len(s) - 1))
    assert sorted(both[True]) == sorted(both[False]) and all(count(both[True][u]["seq"]) == count(both[False][u]["seq"]) for u in both[True])
    assert {r["strand"] for r in both[False].values()} == {"."} and sum(both[True][u]["seq"] != both[False][u]["seq"] for u in both[True]) == 60
    r = enrich.enrich(units, scan.prepare([model.Motif("e", PPM)], pvalue=1e-3)).collect()
    assert len(r) == 1 and r[0]["pvalue"] < 1e-6 and (r[0]["pos_n"], r[0]["neg_n"]) == (62, 62)
    found = discover.discover(make(spark, pos), widths=[6], per_width=1)
    assert "CACGTG" in model.consensus(found[0].motif.ppm)
    row = discover.discovered_frame(spark, found).first()
    assert (row["n_pos"], row["n_neg"], row["seqs_pos"] >= 60) == (62, 62, True)


def test_kmer_presence_by_loop(spark):
    rng = random.Random(20)
    texts = ["".join(rng.choice("ACGTacgtUuNR") if rng.random() < 0.3 else rng.choice("ACGT") for _ in range(rng.randint(0, 80))) for _ in range(40)] + ["", "ACG"]
    for w in (1, 4, 31):
        want = Counter()
        for t in texts:
            t = t.upper().replace("U", "T")
            k = {t[i : i + w] for i in range(len(t) - w + 1)}
            want.update({min(x, x[::-1].translate(str.maketrans("ACGT", "TGCA"))) for x in k if set(x) <= set("ACGT")})
        assert {r["kmer"]: r["n_seqs"] for r in discover.kmer_presence(make(spark, texts).repartition(3), w).collect()} == dict(want)


def test_overlap_of_covered_places(spark):
    a, b = scan.prepare([model.Motif("e", PPM), model.Motif("f", PPM[1:])], pvalue=1e-3)
    assert discover.shared(make(spark, ["TTTCACGTGTTT"] * 3), a, a) == 1.0
    assert discover.shared(make(spark, ["TTTTTTT"]), a, b) == 0.0


def test_discovery_query_runs_the_operators_defaults(spark, monkeypatch):
    from strandspark.plans import queries

    given = []
    monkeypatch.setattr(queries.discover, "discover", lambda pos, neg, **options: given.append(options) or [])
    assert queries.discover_motifs(spark, "/root/testdata/sf0.001").count() == 0
    assert given == [{}]


def test_background(spark):
    rng = random.Random(3)
    text = lambda gc, n: "".join(rng.choice("GC" if rng.random() < gc else "AT") for _ in range(n))
    t, pool = make(spark, [text(0.5, 60) for _ in range(5)]), make(spark, [text(g / 10, 60) for g in range(1, 10) for _ in range(8)])
    assert background.from_pool(t, pool).select("target").distinct().count() == 5
    g = background.from_genome(t, make(spark, [text(0.5, 3000), text(0.4, 2000)])).collect()
    assert len(g) == 5 and all(r["end"] - r["start"] == 60 == len(r["seq"]) for r in g)


def test_background_pool_by_a_slow_model(spark, monkeypatch):
    monkeypatch.setattr(background, "_CELL", 3)
    rng = random.Random(23)
    text = lambda gc, n: "".join(rng.choice("GC") if i < gc * n else rng.choice("AT") for i in range(n))
    targets = [text(rng.choice([0.3, 0.5, 0.52, 0.9]), rng.choice([40, 60, 90])) for _ in range(30)]
    pool = [text(rng.choice([0.1, 0.3, 0.4, 0.5, 0.6]), rng.choice([38, 45, 62, 200])) for _ in range(40)]
    t, p = make(spark, targets), make(spark, pool)
    of = lambda s: min(19, int((s.count("G") + s.count("C")) / len(s) / 0.05))

    def nearest(x, free):
        fit = [i for i in free if abs(len(pool[i]) - len(x)) <= 5]
        return min(((abs(of(pool[i]) - of(x)), of(pool[i]) < of(x)) for i in fit), default=None), fit

    got = background.from_pool(t, p, tolerance=5, number=3).collect()
    by = {}
    for r in got:
        by.setdefault(r["target"], []).append(int(r["name"][1:]))
        assert pool[int(r["name"][1:])] == r["seq"]
    for i, x in enumerate(targets):
        best, fit = nearest(x, range(len(pool)))
        picks = by.get(f"s{i}", [])
        assert len(picks) == (3 if fit else 0)
        assert all(j in fit and (abs(of(pool[j]) - of(x)), of(pool[j]) < of(x)) == best for j in picks)
    # without replacement nothing is used twice, and who got nothing has no unused candidate left
    once = background.from_pool(t, p, tolerance=5, replacement=False).collect()
    used = [int(r["name"][1:]) for r in once]
    assert len(set(used)) == len(used) and len({r["target"] for r in once}) == len(once)
    left = set(range(len(pool))) - set(used)
    for i in {*range(30)} - {int(r["target"][1:]) for r in once}:
        assert not nearest(targets[i], left)[1]
    with pytest.raises(model.MotifError):
        background.from_pool(make(spark, ["ACGT" * 500]), p)
    many = background.from_pool(make(spark, [text(0.5, 60)]), make(spark, [text(0.5, 60) for _ in range(10)]), number=2000).groupBy("name").count().collect()
    assert len(many) == 10 and min(r["count"] for r in many) > 140
    assert {(r["bin"], r["gc_range"], r["n"]) for r in background.bin_counts(make(spark, ["GC", "AT", "NN", "ACGT"])).collect()} == {(19, "95-100%", 1), (0, "0-5%", 2), (10, "50-55%", 1)}


def test_background_genome_does_not_depend_on_pieces(spark, monkeypatch):
    rng = random.Random(24)
    text = lambda gc, n: "".join(rng.choice("GC" if rng.random() < gc else "AT") for _ in range(n))
    genome = [text(0.5, 900), text(0.3, 500), "N" * 300 + text(0.7, 400)]
    t, g = make(spark, [text(x / 10, 50) for x in range(2, 8)]), make(spark, genome)
    whole = sorted(map(tuple, background.from_genome(t, g, number=3, random_strand=True).collect()))
    monkeypatch.setattr(background, "_PIECE", 10)
    assert sorted(map(tuple, background.from_genome(t, g, number=3, random_strand=True).collect())) == whole
    assert len(whole) == 18
    for _, _, chrom, a, b, strand, s in whole:
        w = genome[int(chrom[1:])][a:b]
        assert s == (w if strand == "+" else w[::-1].translate(str.maketrans("ACGT", "TGCA"))) and w.count("N") <= 5


def test_background_genome_draws_valid_starts_until_the_bin_is_met(spark):
    rng = random.Random(8)
    text = lambda gc, n: "".join(rng.choice("GC" if rng.random() < gc else "AT") for _ in range(n))
    # one long chromosome and many contigs too short for the targets
    genome = make(spark, [text(0.5, 700)] + [text(0.5, 90) for _ in range(600)])
    targets = make(spark, [text(0.5, 300) for _ in range(40)] + [text(0.5, 800)])
    got = background.from_genome(targets, genome).collect()
    assert len(got) == 40 and all(r["end"] - r["start"] == 300 == len(r["seq"]) and r["end"] <= 700 for r in got)
    assert len({r["start"] for r in got}) > 20
    # a bin that about one window of 90 has, and one that none has
    at = make(spark, ["AT" * 2500 + "GC" * 40 + "AT" * 2500])
    got = background.from_genome(make(spark, ["GC" * 12] * 8), at).collect()
    assert len(got) == 8 and all(r["seq"].count("G") + r["seq"].count("C") >= 23 for r in got)
    assert len(background.from_genome(make(spark, ["GC" * 12]), make(spark, ["AT" * 50])).collect()) == 1


def test_post(spark):
    h = spark.createDataFrame([("s", 1, 6, "-", "m", 1e-4, 9.0, 90.0, "CACGTT"), ("s", 3, 8, "+", "m", 1e-3, 7.0, 70.0, "CACGTG")], model.HIT)
    assert post.flip_rc(h).orderBy("start").first()["match"] == "AACGTG"
    assert [round(r["qvalue"], 6) for r in post.add_qvalues(h, 100).orderBy("start").collect()] == [0.01, 0.05]
    assert post.to_bed(h).orderBy("chrom_start").first()["bed_score"] == 40


def _batch(texts, units=False):
    import pyarrow as pa

    n = len(texts)
    sides = [pa.array([True] * n)] * 2
    return pa.RecordBatch.from_arrays([pa.array([f"s{i}" for i in range(n)]), pa.array(texts, pa.string()), *([] if units else [pa.array([0] * n, pa.int64())]), *sides], names=["key", "seq", *([] if units else ["offset"]), "plus", "minus"])


def test_kernels_do_not_depend_on_portions(monkeypatch):
    rng = random.Random(31)
    texts = ["".join(rng.choice("ACGTacgtNU") if rng.random() < 0.2 else rng.choice("ACGT") for _ in range(rng.choice([0, 3, 5, 6, 40, 300]))) for _ in range(60)] + [None, "ACGTé" * 9]
    motifs = scan.prepare([model.Motif("e", PPM), model.Motif("f", PPM[:4])], pvalue=None)

    def all_of():
        hits = sorted(tuple(r.values()) for b in scan._kernel(motifs, False, False)([_batch(texts)]) for r in b.to_pylist())
        units = sorted(tuple(str(x) for x in r.values()) for b in scan.unit_kernel(motifs, True, False)([_batch(texts, True)]) for r in b.to_pylist())
        kinds = {}
        for w in (1, 3, 7, 31):
            for b in discover._presence_kernel(w)([_batch(texts).select(["seq"])]):
                for r in b.to_pylist():
                    kinds[w, r["code"]] = kinds.get((w, r["code"]), 0) + r["n"]
        return hits, units, kinds

    whole = all_of()
    m, want = motifs[0], []
    for i, t in enumerate(texts):
        for a in range(len(t or "") - m.width + 1):
            if set(w := t[a : a + m.width]) <= set("ACGTUacgtu"):
                codes = ["ACGT".index(c.upper().replace("U", "T")) for c in w]
                want += [(f"s{i}", a + 1, strand, w, s) for strand, pwm in (("+", m.pwm), ("-", m.pwm[::-1, ::-1])) if (s := sum(int(pwm[j][c]) for j, c in enumerate(codes))) >= m.threshold]
    assert sorted((h[0], h[1], h[3], h[8], h[6]) for h in whole[0] if h[4] == "e") == sorted(want) and want
    for size in (1, 50, 1000):
        monkeypatch.setattr(scan, "PORTION", size)
        assert all_of() == whole


def test_kernels_hold_no_more_for_larger_batches():
    import tracemalloc

    rng = np.random.default_rng(32)
    one = lambda n: "".join("ACGT"[i] for i in rng.integers(0, 4, n))
    batch, text = _batch([one(2000)] * 2000), _batch([one(4_000_000)])
    motifs = scan.prepare([model.Motif(n, PPM) for n in "abc"], pvalue=None)
    for kernel, given in ((scan._kernel(motifs, False, False), [batch, text]), (discover._presence_kernel(6), [batch.select(["seq"]), text.select(["seq"])])):
        for b in given:
            tracemalloc.start()
            assert sum(x.num_rows for x in kernel([b]))
            peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            assert peak < 100e6


def test_seeds_break_ties_of_rounded_p_values_by_kmer(spark):
    # both p values are below 1e-12, that of TTTTAA the smaller one
    pos = ["TTTTAA"] * 60 + ["ACCCCC"] * 50
    neg = make(spark, ["G" * 8] * 100)
    got = [discover.seeds(make(spark, pos), neg, 6, digits=d).collect() for d in (None, 12)]
    assert [r["kmer"] for r in got[0]] == ["TTAAAA", "ACCCCC"] and got[0][0]["pvalue"] < got[0][1]["pvalue"] < 1e-12
    assert [r["kmer"] for r in got[1]] == ["ACCCCC", "TTAAAA"]


def test_masks_need_no_whole_batches(spark):
    ranges = spark.createDataFrame([(0, "s0", 1, 3, ".", ".")], "range_id long, seq_name string, start long, end long, name string, strand string")
    got = seqtools.mask(make(spark, ["ACGTAC", ""]), ranges)
    assert "ArrowEvalPython" not in got._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in got.orderBy("seq_num").collect()] == [(0, "s0", "", "AcgTAC"), (1, "s1", "", "")]


def test_enrichment_shuffles_once(spark):
    units = make(spark, ["ACGTAACCGGTTTCAG" * 3, "ACG", ""]).select(F.col("name").alias("unit"), "seq")
    got = enrich.counts(enrich.with_null(units), scan.prepare([model.Motif("e", PPM), model.Motif("f", PPM[:4])], pvalue=1e-2))
    assert got._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") == 2
    assert sorted((r["motif"], r["pos_n"], r["neg_n"], r["pos_positions"], r["neg_positions"]) for r in got.collect()) == [("e", 3, 3, 86, 86), ("f", 3, 3, 90, 90)]


def test_islands_are_dealt_out_by_size(spark, monkeypatch):
    from strandspark.functions import tables

    rng = random.Random(33)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(300)]) if i % 9 == 0 else rng.randint(0, 300), i) for i in range(400)]
    df = spark.createDataFrame([(k, s, None if s is None else s + rng.randint(0, 9), i, float(rng.randint(0, 5))) for k, s, i in rows], "seq_name string, start long, end long, arrival long, score double")
    whole = sorted(dedup.islands(df, ["seq_name"]).select("arrival", "island").collect())
    some = df.filter("start is not null and seq_name is not null")
    kept = sorted(r["arrival"] for r in dedup.dedup(some, F.col("score"), keys=["seq_name"]).collect())
    monkeypatch.setattr(tables, "PART", 64)
    assert tables.parts(df) > 4
    got = dedup.islands(df, ["seq_name"], block=50)
    assert got.rdd.getNumPartitions() == tables.parts(df)
    assert sorted(got.select("arrival", "island").collect()) == whole
    assert sorted(r["arrival"] for r in dedup.dedup(some, F.col("score"), keys=["seq_name"]).collect()) == kept
    assert got.columns == [*df.columns, "island"]


def test_seeds_keep_the_smallest_kmers_of_each_pair_of_counts(spark, monkeypatch):
    import pyarrow as pa

    rng = random.Random(34)
    rows = [(rng.randint(0, 10**6), rng.randint(1, 3), rng.randint(0, 2)) for _ in range(500)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[i : i + 60])], names=["code", "pos_n", "neg_n"]) for i in range(0, 500, 60)]
    got = sorted((r["pos_n"], r["neg_n"], r["code"]) for b in discover._smallest(4, rows=100)(batches) for r in b.to_pylist())
    want = [(a, b, c) for a in (1, 2, 3) for b in (0, 1, 2) for c in sorted(c for c, x, y in rows if (x, y) == (a, b))[:4]]
    assert got == want
    # by a slow model, ties by k-mer; no list of all k-mers of a pair of counts is made
    sets = [["".join(rng.choice("ACGT") for _ in range(40)) for _ in range(12)] for _ in range(2)]
    word = lambda t, i: min(t[i : i + 9], t[i : i + 9][::-1].translate(str.maketrans("ACGT", "TGCA")))
    pos_n, neg_n = (Counter(k for t in x for k in {word(t, i) for i in range(32)}) for x in sets)
    slow = sorted((stats.fisher_greater(n, neg_n[k], 12 - n, 12 - neg_n[k]), k) for k, n in pos_n.items() if n > neg_n[k])[:4]
    found = discover.seeds(*(make(spark, x) for x in sets), 9)
    assert [r["kmer"] for r in found.collect()] == [k for _, k in slow]
    monkeypatch.setattr(discover, "_POOL", 5)
    whole = Counter()
    for b in discover._presence_kernel(9)([_batch(sets[0]).select(["seq"])]):
        for r in b.to_pylist():
            whole[r["code"]] += r["n"]
    assert {"".join("ACGT"[c >> 2 * (8 - j) & 3] for j in range(9)): n for c, n in whole.items()} == dict(pos_n)


def test_background_genome_is_worked_out_once(spark):
    seen, genome = spark.sparkContext.accumulator(0), make(spark, ["ACGT" * 40] * 3)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    assert background.from_genome(make(spark, ["ACGT" * 5]), genome.mapInArrow(counted, genome.schema)).count() == 1
    assert seen.value == 3
