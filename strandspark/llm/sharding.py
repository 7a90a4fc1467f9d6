"""Balanced label propagation: linked documents move to their neighbours' shards under row quotas.

A link joins a document to a hub (here the
hub of all equal texts), which stands for links between all its members
without listing their pairs.  Hubs start whole where they fit: the few large
ones by best fit, the others one after another along the free rows of the shards.  The state is the number of members of each hub
in each shard, a cell; in each round a cell's members want to move to the shard
that holds most of their neighbours, and cells are let in, in an order
fixed for the round, while that shard's row quota lasts, until a round moves none.
What is cut then, for want of free rows, changes places with whole hubs of
as many rows.  Documents without links have
no edge to cut: they fill what the linked ones leave, so that row counts differ
by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dealt_join, running_before, saved, table

#: Rows in a block of the running sums, about.
BLOCK = 250
#: Hubs of more rows than a shard's quota over this are placed one by one, at most so many a shard.
LARGE = 64
#: Whole hubs of a size, and their sizes, that can change places with cut ones; cut hubs mended so, at most.
OFFERS, OFFER_SIZE, MENDED = 40, 32, 1024


def text_hub(text: Column) -> Column:
    """A key of equal texts (null: as empty): two hashes and the length."""
    t = F.coalesce(text, F.lit(""))
    return F.concat_ws("-", F.xxhash64(t).cast("string"), F.crc32(F.encode(t, "UTF-8")).cast("string"), F.octet_length(t).cast("string"))


def shard(docs: DataFrame, *, shards: int = 16, rounds: int | None = None, id_col: str = "doc_id", text_col: str = "text", hub: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard`` (and ``keep``).

    Law ``rows``: the shards' row counts differ by at most one.  size: UTF-8
    bytes plus 1; slot: gapless from 0 within the shard.  hub: the key that
    links documents (default: the text); null hubs link nothing.  Null texts
    count as empty, very long ones are read whole; null ids are kept; repeated
    rows and ties take places in an order fixed by id and hub; an empty table
    gives no rows; other columns, whatever their names, are ignored unless
    named in ``keep``.  rounds: at most so many (default: until none moves a row).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = saved(
        docs.select(
            F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            (text_hub(F.col(text_col)) if hub is None else hub).alias("_hub"), *[F.col(c).alias(f"_keep_{c}") for c in keep or []],
        ).withColumn("_one", F.lit(1).cast("long"))
    )
    total = slim.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    members = slim.groupBy("_hub").agg(F.count("*").alias("_m"))
    tagged = saved(dealt_join(slim.filter("_hub is not null"), members.filter("_m > 1"), ["_hub"], "_m", total, "left"))
    linked = tagged.filter("_m is not null")
    order = F.pmod(F.xxhash64("_hub", "doc_id"), F.lit(1 << 40))
    place = running_before(linked, ["_hub"], F.floor(order / F.lit(float(1 << 40)) * F.ceil(F.col("_m") / BLOCK)), [order, "doc_id"], "_one", "_rank")
    linked = saved(place)
    cells = saved(_start(linked.groupBy("_hub").agg(F.count("*").alias("n")), quota))
    good, turn = _together(cells), 0
    while good[1] and (rounds is None or turn < rounds):
        new = saved(_round(cells, quota, turn))
        if (now := _together(new))[0] <= good[0]:
            break
        cells, good, turn = new, now, turn + 1
    if good[1]:
        cells = saved(_exchanged(cells, quota))
    used = dict(cells.groupBy("shard").agg(F.sum("n")).collect())  # one row per shard
    # members of a hub fill its cells in the order of their ranks
    span = Window.partitionBy("_hub").orderBy(F.desc("n"), "shard").rowsBetween(Window.unboundedPreceding, -1)
    spans = cells.withColumn("_lo", F.coalesce(F.sum("n").over(span), F.lit(0))).withColumns({"_hi": F.col("_lo") + F.col("n"), "_all": F.sum("n").over(Window.partitionBy("_hub"))})
    a = dealt_join(linked, spans.select("_hub", "shard", "_lo", "_hi", "_all"), ["_hub"], "_all", total).filter("_rank >= _lo and _rank < _hi").drop("_lo", "_hi", "_rank", "_m", "_all")
    single = tagged.filter("_m is null").drop("_m").unionByName(slim.filter("_hub is null"))
    spread = F.pmod(F.xxhash64("doc_id", "_hub"), F.lit(1 << 40))
    single = running_before(single.withColumn("_all", F.lit(0)), ["_all"], F.floor(spread / F.lit(float(1 << 40)) * F.lit(float(max(1, total // BLOCK)))), [spread, "doc_id"], "_one", "_rank")
    limits, case = 0, F.lit(shards - 1)
    ends = []
    for s in range(shards):
        limits += quota[s] - (used.get(s) or 0)
        ends.append(limits)
    for s in range(shards - 1, -1, -1):
        case = F.when(F.col("_rank") < ends[s], F.lit(s)).otherwise(case)
    b = single.withColumn("shard", case.cast("int")).drop("_all", "_rank")
    both = saved(a.unionByName(b))
    spot = F.pmod(F.xxhash64("_hub", "doc_id", "text_crc32"), F.lit(1 << 40))
    placed = running_before(both, ["shard"], F.floor(spot / F.lit(float(1 << 40)) * F.lit(float(max(1, total // shards // BLOCK)))), [spot, "doc_id"], "_one", "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), *[F.col(f"_keep_{c}").alias(c) for c in keep or []])


def _admitted(moves: DataFrame, room: Column, to: str, turn: int = 0) -> DataFrame:
    """Marks the moves that fit: cells in an order fixed for the turn, while the rows let in are within the room of their shard."""
    order = F.pmod(F.xxhash64(F.lit(turn), "_hub", "shard"), F.lit(1 << 40))
    moves = moves.withColumn("_order", order)
    r = running_before(moves, [to], F.floor(F.col("_order") / F.lit(float(1 << 40)) * 1024), ["_order", "_hub", "shard"], "n", "_in")
    r = r.withColumn("_take", F.greatest(F.lit(0).cast("long"), F.least(F.col("n"), room - F.col("_in"))))
    return r.withColumn("_ok", F.col("_take") == F.col("n")).drop("_order", "_in")


def _room(counts: DataFrame, quota: list[int], of: str) -> Column:
    """A shard's free rows, as an expression over the column ``of`` (one literal per shard)."""
    used = dict(counts.collect())  # one row per shard
    return F.element_at(F.array(*[F.lit(int(max(0, q - (used.get(s) or 0)))) for s, q in enumerate(quota)]), (F.col(of) + 1).cast("int")).cast("long")


def _start(hubs: DataFrame, quota: list[int]) -> DataFrame:
    """``_hub, shard, n``: hubs in as few shards as they fit in, within the quotas."""
    spark, room = hubs.sparkSession, list(quota)
    most = sum(quota) // (len(quota) * LARGE)
    large = []
    for r in sorted(hubs.filter(F.col("n") > most).collect(), key=lambda r: (-r["n"], r["_hub"])):  # LARGE * shards rows at most
        left = r["n"]
        while left:
            fits = [(x, s) for s, x in enumerate(room) if x >= left]
            _, s = min(fits) if fits else max((x, -s) for s, x in enumerate(room))
            s = abs(s)
            n = min(left, room[s])
            large.append((r["_hub"], s, n))
            left, room[s] = left - n, room[s] - n
    placed = spark.createDataFrame(large, "_hub string, shard int, n long")
    small = hubs.filter(F.col("n") <= most)
    rows, free = small.agg(F.sum("n")).first()[0] or 0, sum(room)
    if not rows:
        return placed
    # a hub goes where its first row is, if all are dealt evenly along the free rows
    order = F.pmod(F.xxhash64("_hub"), F.lit(1 << 40))
    small = running_before(small.withColumns({"_all": F.lit(0), "_order": order}), ["_all"], F.floor(F.col("_order") / F.lit(float(1 << 40)) * F.lit(float(max(1, rows // BLOCK)))), ["_order", "_hub"], "n", "_lo")
    case, end = F.lit(max(s for s, x in enumerate(room) if x)), free
    for s in range(len(room) - 1, -1, -1):
        case = F.when(F.col("_lo") * F.lit(free / rows) < end, F.lit(s)).otherwise(case) if room[s] else case
        end -= room[s]
    return placed.unionByName(_settled(small.select("_hub", case.cast("int").alias("shard"), "n"), room))


def _together(cells: DataFrame) -> tuple[int, int]:
    """The sum of squares of the cells, which grows as hubs come together, and the number of cut hubs."""
    r = cells.groupBy("_hub").agg(F.sum(F.col("n").cast("decimal(38,0)") * F.col("n")).alias("s"), F.count("*").alias("c")).agg(F.sum("s"), F.coalesce(F.sum((F.col("c") > 1).cast("int")), F.lit(0))).first()
    return int(r[0] or 0), int(r[1])


def _some(offers: dict, least: int, most: int) -> list | None:
    """Hubs (hub, n) among the offers {n: [hub]} of together least to most rows."""
    out, left = [], {n: list(h) for n, h in offers.items() if h}
    for n in sorted(left, reverse=True):
        while left[n] and least > 8 * OFFER_SIZE:
            out.append((left[n].pop(), n))
            least, most = least - n, most - n
    ways: dict[int, tuple] = {0: ()}
    for n in sorted(left):
        for hub in left[n]:
            for x in sorted(ways, reverse=True):
                if x < least and x + n not in ways:
                    ways[x + n] = (*ways[x], (hub, n))
    fit = [x for x in ways if max(0, least) <= x <= most]
    return out + list(ways[min(fit)]) if fit else None


def _exchanged(cells: DataFrame, quota: list[int]) -> DataFrame:
    """Cut hubs come together in one shard: whole hubs of as many rows go the other way."""
    spark = cells.sparkSession
    hubs = cells.groupBy("_hub").agg(F.count("*").alias("_c"), F.sum("n").alias("_all"))
    cut = hubs.filter((F.col("_c") > 1) & (F.col("_all") <= max(quota))).orderBy("_all", "_hub").limit(MENDED)
    parts: dict = {}
    for r in cut.join(cells, "_hub").select("_hub", "shard", "n").collect():  # MENDED hubs of a cell in each shard at most
        parts.setdefault(r["_hub"], {})[r["shard"]] = r["n"]
    whole = cells.join(hubs.filter("_c = 1").select("_hub"), "_hub").filter(F.col("n") <= OFFER_SIZE)
    offers: dict = {}
    for r in whole.groupBy("shard", "n", F.pmod(F.xxhash64("_hub"), F.lit(OFFERS))).agg(F.min("_hub").alias("h")).collect():  # OFFERS * OFFER_SIZE rows a shard at most
        offers.setdefault(r["shard"], {}).setdefault(r["n"], []).append(r["h"])
    used = dict(cells.groupBy("shard").agg(F.sum("n")).collect())
    room = [q - (used.get(s) or 0) for s, q in enumerate(quota)]
    moves = []
    for hub in sorted(parts, key=lambda h: (sum(parts[h].values()), h)):
        for to in sorted(parts[hub], key=lambda s: (-parts[hub][s], s)):
            trial, plan, gone = list(room), [], set()
            for at, n in sorted(parts[hub].items()):
                if at == to:
                    continue
                mine = {k: [h for h in v if h not in gone] for k, v in offers.get(to, {}).items()}
                back = _some(mine, max(0, n - trial[to]), n + trial[at])
                if back is None:
                    break
                size = sum(k for _, k in back)
                trial[to], trial[at] = trial[to] - n + size, trial[at] + n - size
                gone |= {h for h, _ in back}
                plan += [(hub, at, to), *((h, to, at) for h, _ in back)]
            else:
                room, moves = trial, moves + plan
                offers[to] = {k: [h for h in v if h not in gone] for k, v in offers.get(to, {}).items()}
                break
    if not moves:
        return cells
    new = F.broadcast(spark.createDataFrame(moves, "_hub string, shard int, _to int"))
    return cells.join(new, ["_hub", "shard"], "left").groupBy("_hub", F.coalesce("_to", "shard").alias("shard")).agg(F.sum("n").cast("long").alias("n"))


def _settled(cells: DataFrame, quota: list[int]) -> DataFrame:
    """Cells dealt over shards can exceed a quota by little: those that do not fit go to the shards with room."""
    # they are dealt anew over all shards by the running sum of what is left
    cells = saved(cells)
    kept = _admitted(cells, F.element_at(F.array(*[F.lit(int(q)) for q in quota]), (F.col("shard") + 1).cast("int")).cast("long"), "shard")
    kept = saved(kept)
    fits = kept.filter("_ok").select("_hub", "shard", "n")
    rest = kept.filter("not _ok").select("_hub", "shard", "n").withColumn("_all", F.lit(0))
    used = dict(fits.groupBy("shard").agg(F.sum("n")).collect())
    ends, at = [], 0
    for s, q in enumerate(quota):
        ends.append((at, at + q - (used.get(s) or 0)))
        at = ends[-1][1]
    order = F.pmod(F.xxhash64("_hub", "shard"), F.lit(1 << 40))
    rest = running_before(rest.withColumn("_order", order), ["_all"], F.floor(F.col("_order") / F.lit(float(1 << 40)) * 1024), ["_order", "_hub", "shard"], "n", "_lo")
    gaps = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi")) for s, (lo, hi) in enumerate(ends)])
    rest = rest.withColumn("_gap", F.explode(gaps)).filter("_gap.lo < _lo + n and _gap.hi > _lo")
    rest = rest.select("_hub", F.col("_gap.s").alias("shard"), (F.least(F.col("_gap.hi"), F.col("_lo") + F.col("n")) - F.greatest(F.col("_gap.lo"), F.col("_lo"))).alias("n"))
    return fits.unionByName(rest).groupBy("_hub", "shard").agg(F.sum("n").cast("long").alias("n"))


def _round(cells: DataFrame, quota: list[int], turn: int) -> DataFrame:
    """One round: cells move to the shard of most neighbours that has room for them."""
    counts = cells.groupBy("shard").agg(F.sum("n").alias("u"))
    room = _room(counts, quota, "_s")
    # the best shard of a hub: most members, room left, then a fixed order
    ranked = cells.withColumn("_s", F.col("shard")).withColumn("_room", room).drop("_s")
    best = ranked.groupBy("_hub").agg(F.max(F.when(F.col("_room") > 0, F.struct("n", F.xxhash64("_hub", "shard").alias("h"), "shard", "_room"))).alias("_best"), F.sum("n").alias("_all"))
    less = F.struct(F.col("n"), F.xxhash64("_hub", "shard").alias("h")) < F.struct(F.col("_best.n").alias("n"), F.col("_best.h").alias("h"))
    # out of a full shard even the larger part goes, if all of the hub finds room where the smaller part is
    leaves = (F.col("_room") == 0) & (F.col("_all") <= F.col("_best._room"))
    wish = ranked.join(best, "_hub", "left").withColumn("_go", (F.col("_best.shard") != F.col("shard")) & (less | leaves))
    wish = saved(wish.select("_hub", "shard", "n", F.coalesce("_go", F.lit(False)).alias("_go"), F.col("_best.shard").alias("_to")))
    moves = _admitted(wish.filter("_go"), _room(counts, quota, "_to"), "_to", turn + 1)
    # the last cell let in moves in part, so that a shard fills up and the next round looks for another one
    parts = F.array(F.struct(F.col("_to").alias("shard"), F.col("_take").alias("n")), F.struct(F.col("shard").alias("shard"), (F.col("n") - F.col("_take")).alias("n")))
    moved = moves.select("_hub", F.inline(parts)).filter("n > 0")
    return wish.filter("not _go").select("_hub", "shard", "n").unionByName(moved).groupBy("_hub", "shard").agg(F.sum("n").cast("long").alias("n"))


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents into 16 shards by the law of rows, linked by equal texts."""
    return shard(table(spark, sf_dir, "documents"))
