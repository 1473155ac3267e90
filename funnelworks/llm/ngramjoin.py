"""N-gram Jaccard join in the metric space of shingle sets.

Jaccard distance is a metric, so distances to a pivot bound distances between documents: two that
lie more than r apart as seen from a pivot are more than r apart. The join uses this exactly:

* Equal sets are one class, named by a 64-bit digest; classes, not documents, are what is joined.
* Regions: shingles are put in a fixed order, those with a rare word first. Words are counted in a sketch of bounded
  size, where a rare word stays rare at any size of the corpus, as shingles in such a sketch would not. Two sets
  with Jaccard >= t share one of the first |x| - ceil(t |x|) + 1 shingles of both, and of the smaller one even of its first
  |x| - ceil(2 t / (1 + t) |x|) + 1, its index shingles. Each first shingle is a region, and a document lies in the
  regions of its own: the windows in which a partner may be. A region in which no member has an index shingle is dropped.
* Common shingles, those of crowded regions, are put behind all others and the first shingles of the texts in such regions
  are drawn anew: texts that share a passage but little else do not meet by it. Where a text's first shingles are mostly crowded, the
  shared ones behind them count as common too. Any order that all texts keep is exact.
* A pair is measured only in the region of its first common shingle, as far as that can be told: behind it both sets have
  to hold as many shingles as a link needs in common, their parity bits must not tell that more than a link allows differ, and the last few regions ahead of it must not name a common one. A
  region whose members all lie in one earlier region is dropped.
* In every region the member of the least rank with an index shingle is the pivot, since one of any pair that counts has one
  there. Later rounds add some more from outside of the region's largest component, since pairs within a component are settled: a group of near copies with a few strangers costs
  the strangers' distances only. Members near enough to their pivots are measured against them, each pair once however many regions it
  shares; those within r link to it.
* A region is then cut into rings by the distance to its first pivot, ring k holding k r <= d < (k + 1) r. Differing parity bits are
  a distance, too, of which no text need be fetched; where sets are so large that these say little, all members are measured.
  Documents of neighbouring rings may still be partners, so each ring's members are
  replicated into the next ring; rings further apart are ruled out by the triangle inequality.
  A pair of one ring meets there alone, not again where both are copies; the same holds for the windows of sizes.
* Each ring is a region of the next round, without the pivot, whose pairs are all settled. Regions whose
  members are all in one component are settled too. Rounds go on until no region is left: the result is exact.

No round emits all pairs within a group: a region of n members costs n distances a pivot at most, and the number of pivots
a round is fixed; a group of near copies falls into one component in the first rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from funnelworks.llm import columns as C
from funnelworks.llm import wordscan
from funnelworks.llm.decontaminate import bit_table, in_table
from funnelworks.llm.tokens import in_chunks, raw
from funnelworks.sources.storage import materialise

SKETCH_BITS = 20  # 2**20 counters, 4 MiB, are what executors get of the corpus counts
# Expected pivots of a region by round; the last for all later ones. Few link most of a group of near copies, and
# then as many strangers as the last number says are settled at once.
PIVOTS = (1, 32, 512)
CROWD = 16  # classes that make a region crowded and its shingle a common one
BEFORE = 32  # earlier regions of a set that its row in a region names
KEPT = ["region", "id", "size", "rest", "index", "before", "copy"]  # of a member of a region
LEVELS = 62  # cuts into windows and rings of which a member's row says whether it is a copy there
COMMON = 1 << 20  # common shingles of a turn at most; executors get 8 bytes of each
PARITY = 16  # longs of a set's parity bits
TURNS = 1  # times that first shingles are drawn anew at most; it is only the order that they make better


def _slots(words: np.ndarray, n: int) -> np.ndarray:
    return (words & np.uint64(n - 1)).astype(np.int64)


def shingles_of(texts: list[bytes], n: int, counts: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text the sorted distinct hashes of its runs of ``n`` words, of all its words if there are fewer, and the count
    of each run's rarest word."""
    words = wordscan.scan(texts, fold=True)
    often = np.zeros(len(words.hash), np.int32) if counts is None else counts[_slots(words.hash, len(counts))]
    for a, b in zip(words.bounds, words.bounds[1:]):
        h = words.hash[a:b]
        k = min(n, len(h))
        if not k:
            yield np.zeros(0, np.uint64), np.zeros(0, np.int32)
            continue
        many = len(h) - k + 1
        run, rarest = np.full(many, np.uint64(k)), often[a:a + many]
        for j in range(k):
            run = wordscan.mix(run * np.uint64(0x9E3779B97F4A7C15) + h[j:many + j])
            if counts is not None and j:
                rarest = np.minimum(rarest, often[a + j:a + many + j])
        if counts is None:
            yield np.unique(run), rarest
        else:
            run, first = np.unique(run, return_index=True)
            yield run, rarest[first]


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    return [run for run, _ in shingles_of(texts, n)]


def class_key(shingles: np.ndarray) -> int:
    """64 bits that name a set; equal sets have equal names."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _classes(docs: DataFrame, id_column: str, text: str, n: int) -> DataFrame:
    """(id, key, n_shingles, t) per row."""
    rows = docs.select(C.name(id_column).cast("bigint").alias("id"), C.name(text).cast("string").alias("t"))

    def batches(it: Iterator) -> Iterator:
        for batch in it:
            ids, texts = batch.column("id"), raw(batch.column("t"))
            for a, b in in_chunks(texts):
                sets = shingle_sets(texts[a:b], n)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(a, b - a), pa.array([class_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                    batch.column("t").slice(a, b - a)], ["id", "key", "n_shingles", "t"])

    return rows.mapInArrow(batches, "id bigint, key bigint, n_shingles bigint, t string")


def _near(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(id: class key, t) of the rows of ``ids`` and a few more: a bit table of fixed size spares most others the shuffle."""
    return _hits(rows.select(F.col("key").alias("id"), "t"), "id", ids)


def _texts(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(id: class key, z, size): one text per class of ``ids`` and of a few others, packed by itself, since text that moves
    in rows of many kinds is packed badly. A task names a class once."""
    def batches(it: Iterator) -> Iterator:
        met: set[int] = set()  # 64 bits a document of the partition
        for batch in it:
            texts, named = raw(batch.column("t")), batch.column("id").to_pylist()
            for a, b in in_chunks(texts):
                new = [k for k in range(a, b) if not (named[k] in met or met.add(named[k]))]
                yield pa.RecordBatch.from_arrays([
                    pa.array([named[k] for k in new], pa.int64()), pa.array([pa.compress(texts[k], "zstd", asbytes=True) for k in new], pa.binary()),
                    pa.array([len(texts[k]) for k in new], pa.int32())], ["id", "z", "size"])

    return _near(rows, ids).mapInArrow(batches, "id bigint, z binary, size int").dropDuplicates(["id"])


def _unpacked(z: pa.Array, size: pa.Array, a: int, b: int) -> list[bytes]:
    return [pa.decompress(z[k].as_buffer(), size[k].as_py(), "zstd", asbytes=True) for k in range(a, b)]


def _pieces(size: pa.Array) -> Iterator[tuple[int, int]]:
    """Slices of a batch of packed texts of some 1 MB."""
    ends = np.cumsum(size.to_numpy()) >> 20
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(size)]
    return ((a, b) for a, b in zip(cuts, cuts[1:]) if a < b)


def _parity(rows: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(id: class key, p0, p1, ...) of ``ids``, a written table: whether an odd number of the set's shingles falls on each of some
    bits. As many bits as differ between two sets, so many shingles at least are not common to them."""
    names = [f"p{k}" for k in range(PARITY)]

    def batches(it: Iterator) -> Iterator:
        met: set[int] = set()  # 64 bits a document of the partition
        for batch in it:
            t, named = raw(batch.column("t")), batch.column("id").to_pylist()
            for a, b in in_chunks(t):
                new = [k for k in range(a, b) if not (named[k] in met or met.add(named[k]))]
                odd = [np.bincount(_slots(x, 64 * PARITY), minlength=64 * PARITY) & 1 for x in shingle_sets([t[k] for k in new], n)]
                bits = np.packbits(np.array(odd, np.uint8).reshape(-1, 64 * PARITY), axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array([named[k] for k in new], pa.int64()), *(pa.array(x) for x in bits.T.copy())], ["id", *names])

    told = _near(rows, ids).mapInArrow(batches, "id bigint, " + ", ".join(f"{x} bigint" for x in names))
    return told.join(ids, "id", "left_semi").dropDuplicates(["id"])


def _sketch(rows: DataFrame) -> np.ndarray:
    """Counts of the texts' words, added up per slot of a table of fixed size."""
    slots, row = 1 << SKETCH_BITS, 1 << 10

    def count(it: Iterator) -> Iterator:
        counts = np.zeros(slots, np.int64)
        for batch in it:
            t = raw(batch.column("t"))
            for a, b in in_chunks(t):
                counts += np.bincount(_slots(wordscan.scan(t[a:b], fold=True).hash, slots), minlength=slots)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(slots // row)), pa.array([c.tobytes() for c in counts.reshape(-1, row)])], ["k", "c"])

    def add(it: Iterator) -> Iterator:
        sums: dict[int, np.ndarray] = {}
        for batch in it:
            for k, c in zip(batch.column("k").to_pylist(), batch.column("c").to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(c, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int64()), pa.array([c.tobytes() for c in sums.values()], pa.binary())], ["k", "c"])

    kind = "k bigint, c binary"
    sums = rows.select("t").mapInArrow(count, kind).repartition("k").mapInArrow(add, kind).collect()
    out = np.zeros((slots // row, row), np.int64)
    for r in sums:
        out[r["k"]] = np.frombuffer(r["c"], np.int64)
    return np.minimum(out.reshape(-1), 2**31 - 1).astype(np.int32)


def prefix(shingles: np.ndarray, rarest: np.ndarray, percent: int, common: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """The first |x| - ceil(t |x|) + 1 shingles in the fixed order, by whether they are common ones (sorted), rarest word and
    hash, and how many of them, |x| - ceil(2 t / (1 + t) |x|) + 1, are index shingles."""
    size = len(shingles)
    keep = size - (-(-percent * size // 100)) + 1
    order = [shingles, rarest]
    if common is not None:
        order.append(common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)] == shingles)
    return shingles[np.lexsort(order)[:keep]], size - (-(-2 * percent * size // (100 + percent))) + 1


def _regions(rows: DataFrame, counts: np.ndarray, common: np.ndarray | None, n: int, percent: int) -> DataFrame:
    """(region, id: class key, size, rest: how many shingles the set has from the region's on, index: whether that is an index
    shingle): a row for each region a text's set lies in.

    A task names a class once, so copies are as many rows as tasks at most.
    """
    shared = rows.sparkSession.sparkContext.broadcast((counts, common))

    def batches(it: Iterator) -> Iterator:
        met: set[int] = set()  # 64 bits a document of the partition
        counts, common = shared.value
        for batch in it:
            texts, named = raw(batch.column("t")), batch.column("id").to_pylist()
            for a, b in in_chunks(texts):
                new = [k for k in range(a, b) if not (named[k] in met or met.add(named[k]))]
                first, keys, sizes, rest, index = [], [], [], [], []
                for k, (run, rarest) in zip(new, shingles_of([texts[k] for k in new], n, counts)):
                    if not len(run):
                        continue
                    some, n_index = prefix(run, rarest, percent, common)
                    first.append(some)
                    keys.append(named[k])
                    sizes.append(len(run))
                    rest.append(len(run) - np.arange(len(some), dtype=np.int32))
                    index.append(np.arange(len(some)) < n_index)
                if first:
                    many = [len(f) for f in first]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.concatenate(first).view(np.int64)), pa.array(np.repeat(keys, many)), pa.array(np.repeat(sizes, many).astype(np.int32)),
                        pa.array(np.concatenate(rest).astype(np.int32)), pa.array(np.concatenate(index))], ["region", "id", "size", "rest", "index"])

    return rows.select("id", "t").mapInArrow(batches, "region bigint, id bigint, size int, rest int, index boolean")


def _hits(rows: DataFrame, column: str, some: DataFrame, hit: bool = True) -> DataFrame:
    """``rows`` with a ``column`` that a bit table of ``some``, of a fixed size, has, or those it has not."""
    test = in_table(F.col("bits"), F.col(column))
    return rows.withColumn("bits", bit_table(some.select(F.col(column).alias("h")))).filter(test if hit else ~test).drop("bits")


def _held(rows: DataFrame, column: str, some: DataFrame) -> DataFrame:
    """``rows`` with a ``column`` in ``some``, a written table; few others are shuffled."""
    return _hits(rows, column, some).join(some, column, "left_semi")


def _crowded(rows: DataFrame) -> DataFrame:
    """(region): those with more than ``CROWD`` classes, of very many the most crowded. Only regions with as many rows
    are looked into, since a class may come from several tasks."""
    many = rows.groupBy("region").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select("region")
    classes = _held(rows, "region", materialise(many, "crowded")).select("region", "id").distinct()
    counted = classes.groupBy("region").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD)
    return counted.orderBy(F.col("n").desc(), "region").limit(COMMON).select("region")


def _often(texts: DataFrame, counts: np.ndarray, n: int) -> DataFrame:
    """(region): the shingles of more than ``CROWD`` of ``texts``, packed ones, one a class, of very many the most frequent. A shingle
    with a word that the corpus holds no more often is not counted."""
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def batches(it: Iterator) -> Iterator:
        for batch in it:
            z, size = batch.column("z"), batch.column("size")
            for a, b in _pieces(size):
                sets = [run[rarest > CROWD] for run, rarest in shingles_of(_unpacked(z, size, a, b), n, shared.value)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["region"])

    held = texts.select("z", "size").mapInArrow(batches, "region bigint").groupBy("region").agg(F.count("*").alias("n"))
    return held.filter(F.col("n") > CROWD).orderBy(F.col("n").desc(), "region").limit(COMMON).select("region")


def _drawn_regions(rows: DataFrame, counts: np.ndarray, n: int, percent: int) -> DataFrame:
    """``_regions`` of rows (key, n_shingles, t), with common shingles behind all others.

    Only the texts with a first shingle that has become a common one draw theirs anew; all others keep them, since what
    moves back in their order stood behind their first shingles already, and may draw the same ones again. Texts whose first shingles are crowded ones to a
    quarter or more tell the common shingles behind these, too: then a text's own come ahead of all of a
    shared passage, and how much is left from its first shingle on tells whether two may link.
    """
    of_class = rows.filter("n_shingles > 0")
    regions, common = materialise(_regions(of_class.select(F.col("key").alias("id"), "t"), counts, None, n, percent), "regions"), np.zeros(0, np.uint64)
    for _ in range(TURNS):
        crowded = materialise(_crowded(regions), "crowded")
        new = np.setdiff1d(crowded.toArrow()["region"].to_numpy().view(np.uint64), common)  # at most COMMON
        if not len(new):
            break
        alike = _held(regions, "region", crowded).groupBy("id").agg(F.count("*").alias("n"), F.max("size").alias("size"))
        alike = materialise(alike.filter(F.col("n") * 400 >= F.col("size") * (100 - percent)).select("id"), "alike")
        often = materialise(_often(_texts(of_class, alike), counts, n), "often").unionByName(crowded).distinct()
        common = np.union1d(common, often.toArrow()["region"].to_numpy().view(np.uint64))  # at most twice COMMON
        moved = materialise(_held(regions, "region", often).select("id").distinct(), "moved")
        again = materialise(_regions(_near(of_class, moved), counts, common, n, percent), "regions")
        regions = _hits(regions, "id", moved, False).unionByName(again)
    return regions


def _shared_regions(rows: DataFrame, percent: int) -> DataFrame:
    """The rows of regions with two classes and an index shingle, from one shuffle; a region streams through its task.

    A set of size x and rest r has partners of sizes up to (1 + t) / t r - x in a region: members whose partners would have to
    be smaller than all sets of the region are left out, and those that are larger than any member's partners may be.
    """
    of_region = Window.partitionBy("region")
    most = F.col("rest").cast("bigint") * (100 + percent) - F.col("size").cast("bigint") * percent  # percent times the largest partner
    size, rest = F.col("size").cast("bigint"), F.col("rest").cast("bigint")
    packed = F.shiftleft(size, 32).bitwiseOR(F.shiftleft(rest, 1)).bitwiseOR(F.col("index").cast("bigint"))  # one number to shuffle
    of_key = rows.select("region", "id", packed.alias("x")).repartition("region")
    rows = of_key.select("region", "id", F.shiftright("x", 32).cast("int").alias("size"), (F.shiftright("x", 1) % (1 << 31)).cast("int").alias("rest"), (F.col("x") % 2 == 1).alias("index"))
    told = rows.withColumn("most", most).withColumns({
        "lo": F.min("id").over(of_region), "hi": F.max("id").over(of_region), "some": F.max("index").over(of_region),
        "least": F.min("size").over(of_region), "top": F.max("most").over(of_region)})
    kept = told.filter(F.col("some") & (F.col("lo") < F.col("hi")) & (F.col("most") >= F.col("least").cast("bigint") * percent) & (
        F.col("size").cast("bigint") * percent <= F.col("top")))
    return kept.select("region", "id", "size", "rest", "index").distinct()


def _first_meetings(regions: DataFrame) -> DataFrame:
    """The regions with ``before``, the last few regions ahead of this one that a set lies in; regions whose members all come
    from one region are left out, as every pair of them has met there."""
    order = Window.partitionBy("id").orderBy(F.col("rest").desc())
    told = regions.withColumn("last", F.lag("region").over(order))
    of_region = Window.partitionBy("region")
    told = told.withColumns({"lo": F.min("last").over(of_region), "hi": F.max("last").over(of_region), "new": F.max(F.col("last").isNull()).over(of_region)})
    kept = told.filter("new OR lo < hi").select("region", "id", "size", "rest", "index")
    before = F.collect_list("region").over(order.rowsBetween(-BEFORE, -1))
    return kept.withColumn("before", before).withColumn("copy", F.lit(0).cast("bigint"))


def _distances(pairs: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """(a, b, common, either): sizes of intersection and union of the sets of two classes.

    Rows come sorted by ``a``, the pivot where there is one, so that its set is built once in a row. Only texts that stand in a
    pair are shuffled, and few others; ``pairs`` is a written table.
    """
    texts = _texts(rows, pairs.select(F.explode(F.array("a", "b")).alias("id")))
    left = pairs.join(texts.select(F.col("id").alias("b"), F.col("z").alias("bz"), F.col("size").alias("bsize")), "b")
    both = left.join(texts.select(F.col("id").alias("a"), F.col("z").alias("az"), F.col("size").alias("asize")), "a").sortWithinPartitions("a")

    def batches(it: Iterator) -> Iterator:
        known, of_a = None, np.zeros(0, np.uint64)
        for batch in it:
            a, (az, asize, bz, bsize) = batch.column("a").to_pylist(), (batch.column(x) for x in ("az", "asize", "bz", "bsize"))
            for s, e in _pieces(bsize):
                common, either = [], []
                for k, of_b in zip(range(s, e), shingle_sets(_unpacked(bz, bsize, s, e), n)):
                    if a[k] != known:
                        known, of_a = a[k], shingle_sets(_unpacked(az, asize, k, k + 1), n)[0]
                    same = len(np.intersect1d(of_b, of_a, assume_unique=True))
                    common.append(same)
                    either.append(len(of_a) + len(of_b) - same)
                yield pa.RecordBatch.from_arrays([
                    batch.column("a").slice(s, e - s), batch.column("b").slice(s, e - s),
                    pa.array(common, pa.int64()), pa.array(either, pa.int64())], ["a", "b", "common", "either"])

    return both.select("a", "b", "az", "asize", "bz", "bsize").mapInArrow(batches, "a bigint, b bigint, common bigint, either bigint")


def components(links: DataFrame) -> DataFrame:
    """(id, component: smallest id that links reach) for every id on a link (a, b), by alternating stars.

    Each pass points all neighbours of an id to the smallest among them; passes go on until nothing changes, each on a written table.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges, before = materialise(edges, "links"), None
    while True:
        # Large star: all larger neighbours point to the smallest neighbour.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: an id's smaller neighbours and itself point to the smallest of them.
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(floor, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        seen = Observation()
        step = small.unionByName(floor.select("a", F.col("m").alias("b"))).distinct().observe(
            seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"))
        edges = materialise(step, "links")
        if not seen.get["n"] or seen.get == before:
            break
        before = seen.get
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def _rank(id_: Column, turn: int = 0) -> Column:
    """A random number from 0 to 1 that an id always has in this turn."""
    return F.pmod(F.xxhash64(id_, F.lit(turn)), F.lit(1_000_000_007)) / 1_000_000_007


def _size_windows(regions: DataFrame, percent: int) -> DataFrame:
    """Regions cut by set size, a distance to the empty set: sets of Jaccard >= t have sizes within a factor t, so
    they lie in one window or the next. Members of a window are replicated into the next."""
    window = F.floor(F.log(F.col("size").cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("int")
    return _windows_of(regions, window, 0)


def _windows_of(regions: DataFrame, window: Column, level: int) -> DataFrame:
    """Members in their window and, as copies, in the next. Two that are copies of one level have met in the window before."""
    copy = F.col("copy").bitwiseOR(F.lit(1 << level if level < LEVELS else 0).cast("bigint"))
    near = F.array(F.struct(window.alias("w"), F.col("copy").alias("copy")), F.struct((window + 1).alias("w"), copy.alias("copy")))
    return regions.select(*KEPT, F.explode(near).alias("x")).select(F.xxhash64("region", "x.w").alias("region"), *KEPT[1:-1], "x.copy")


def _open_regions(live: DataFrame, comps: DataFrame, pivots: int, turn: int) -> DataFrame:
    """(region, id, size, rest, index, before, copy, c: component, first, top: largest size, pivot): members of the regions that may still
    hold an unknown link, with two components or more, at every level a member that is no copy, and one with an index shingle."""
    named = live.join(comps, "id", "left").select(*KEPT, F.coalesce("component", "id").alias("c"))
    parts = named.groupBy("region", "c").agg(
        F.count("*").alias("n"), F.bit_and("copy").alias("copy"), F.max("index").alias("index"), F.sum("rest").alias("rest"), F.max("size").alias("top"),
        F.sum(F.xxhash64("id", "copy", "index").cast("decimal(38,0)")).alias("who"),
        F.min(F.struct((~F.col("index")).alias("probe"), _rank(F.col("id"), turn).alias("rank"), F.col("id").alias("id"))).alias("f"))
    kept = parts.groupBy("region").agg(
        F.count("*").alias("parts"), F.sum("n").alias("m"), F.max(F.struct("n", "c")).alias("largest"), F.bit_and("copy").alias("copy"),
        F.max("index").alias("index"), F.sum("rest").alias("rest"), F.max("top").alias("top"), F.sum("who").alias("who"), F.min("f").alias("f")).filter("parts > 1 AND copy = 0 AND index")
    # Near copies share many shingles: of regions with the same members in the same roles the one of the first shingle is
    # enough, behind which every member has most shingles.
    kept = kept.groupBy("m", "who").agg(F.max(F.struct("rest", "region", "f", "largest", "top")).alias("r")).select(
        "r.region", F.col("r.f.id").alias("first"), F.col("r.largest.c").alias("main"), (F.col("m") - F.col("r.largest.n")).alias("strangers"), "r.top")
    kept = materialise(kept, "open")
    rank = _rank(F.col("id"), turn)  # drawn anew each turn, or those left over would all rank high
    chosen = F.col("id") == F.col("first")
    if pivots > 1:
        chosen = chosen | ((F.col("c") != F.col("main")) & (rank * F.col("strangers") < pivots))
    return _hits(named, "region", kept).join(kept, "region").select(*KEPT, "c", "first", "top", chosen.alias("pivot"))


def _apart(sizes: Column, percent: int) -> Column:
    """100 + percent times as many shingles as two linked sets of these sizes in all may not have in common."""
    return sizes * (100 - percent)


def _meetings(members: DataFrame, parity: DataFrame, percent: int) -> DataFrame:
    """(region, a: pivot, b: member, open: whether to be measured, lead: whether a is the first pivot, apart: differing parity bits,
    and of b with the first pivot what makes a row of the next region): pairs to be measured, and those of first pivots.

    A pair is open in one of its regions at most: of two pivots the one of the lower rank is a. Not open are a pair of one component, a pair of
    copies of one level, which meets in another window or ring, one without an index shingle, one with
    too few shingles from the region's on, which links by an earlier shingle or not at all, and one with too many parity
    bits apart; and one that has met in an earlier region is left to that one. Where parity bits make no rings, first pivots are
    measured with all members."""
    bits = [x for x in parity.columns if x != "id"]

    def side(x: str) -> list[Column]:
        return [F.col(c).alias(f"{x}{c}") for c in ("c", "index", "size", "rest", "before", "copy", *bits)]

    known = members.join(parity, "id")
    p = known.filter("pivot").select("region", "top", F.col("id").alias("a"), *side("a"), (F.col("id") == F.col("first")).alias("lead"), _told(percent).alias("told"))
    both = p.join(known.select("region", F.col("id").alias("b"), *side("b"), F.col("pivot").alias("too")), "region")
    ordered = F.struct(_rank(F.col("a")), F.col("a")) < F.struct(_rank(F.col("b")), F.col("b"))
    sizes = F.col("asize").cast("bigint") + F.col("bsize")
    enough = F.least("arest", "brest").cast("bigint") * (100 + percent) >= sizes * percent
    apart = reduce(add, [F.bit_count(F.col(f"a{x}").bitwiseXOR(F.col(f"b{x}"))) for x in bits])
    near = apart * (100 + percent) <= _apart(sizes, percent)
    once = F.col("acopy").bitwiseAND(F.col("bcopy")) == 0
    open_ = (F.col("ac") != F.col("bc")) & once & (F.col("aindex") | F.col("bindex")) & enough & near & ~F.arrays_overlap("abefore", "bbefore")
    met = both.filter((F.col("a") != F.col("b")) & (~F.col("too") | ordered) & (open_ | F.col("lead")))
    goes_on = F.col("lead") & F.col("told") & ~F.col("too")
    return met.select(
        "region", "a", "b", (open_ | ~F.col("told")).alias("open"), goes_on.alias("lead"), apart.alias("apart"),
        *(F.when(goes_on, F.col(f"b{c}")).alias(c) for c in KEPT[2:]), "top")


def _told(percent: int) -> Column:
    """Whether parity bits tell two strangers of the region's largest size from a linked pair: some half of all bits differ then."""
    return _apart(F.col("top").cast("bigint") * 2, percent) < 28 * PARITY * (100 + percent)


def _rings(met: DataFrame, percent: int, level: int) -> DataFrame:
    """Next regions: members by the ring of their distance to the region's first pivot in parity bits, and in the next ring. That
    is a metric too, and two linked sets lie no further apart in it than a linked pair of the region's largest size may."""
    ring = F.floor(F.col("apart") * (100 + percent) / _apart(F.col("top").cast("bigint") * 2, percent) + 1e-9).cast("int")
    return _windows_of(met.filter("lead").withColumn("id", F.col("b")), ring, level)


def _measured_rings(members: DataFrame, measured: DataFrame, percent: int, level: int) -> DataFrame:
    """The same by the measured distance, for regions of sets so large that parity bits say little."""
    d = measured.unionByName(measured.select(F.col("b").alias("a"), F.col("a").alias("b"), "common", "either")).withColumnsRenamed({"a": "first", "b": "id"})
    rest = members.filter(~F.col("pivot") & ~_told(percent)).join(d, ["first", "id"])
    ring = F.floor((F.col("either") - F.col("common")) * 100 / (F.col("either") * (100 - percent)) + 1e-9).cast("int")
    return _windows_of(rest, ring, level)


def _linked(measured: DataFrame, percent: int) -> DataFrame:
    return measured.filter(F.col("common") * 100 >= F.col("either") * percent).select("a", "b")


def _labels(links: DataFrame) -> DataFrame:
    """(id, component): for each linked id the lowest-ranked one two steps away. Equal labels are in one component;
    that different ones are not is left to the rounds, so that no round has to follow long chains."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    own, other = (F.struct(_rank(F.col(c)).alias("rank"), F.col(c).alias("id")) for c in ("a", "b"))
    one = both.groupBy("a").agg(F.min(other).alias("m")).select("a", F.least(own, F.col("m")).getField("id").alias("up"))
    one = materialise(one, "labels")
    return one.join(one.select(F.col("a").alias("up"), F.col("up").alias("component")), "up").select(F.col("a").alias("id"), "component")


def jaccard_join(docs: DataFrame, id_column: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id), one row per document row.

    Empty and NULL texts have no shingles and link with nothing. Equal sets link. Rows of one id are
    one document and one component. Rows with a NULL id link like others but are not counted for the smallest id.
    """
    rows = materialise(_classes(docs, id_column, text, n), "classes", "zstd")
    per_row = rows.select("id", "key", "n_shingles")
    named = per_row.filter("n_shingles > 0")
    links_of_ids = named.filter("id IS NOT NULL").select("id", "key").distinct()
    least = links_of_ids.groupBy("id").agg(F.min("key").alias("a"), F.max("key").alias("z")).filter("a < z")
    links = links_of_ids.join(least, "id").filter("key <> a").select("a", F.col("key").alias("b"))

    live = materialise(_size_windows(_first_meetings(_shared_regions(_drawn_regions(rows, _sketch(rows), n, percent), percent)), percent), "live")
    parity = measured = None
    labels = links.select(F.col("a").alias("id"), F.col("a").alias("component")).filter("false")
    for k in range(1 << 30):
        members = materialise(_open_regions(live, labels, PIVOTS[min(k, len(PIVOTS) - 1)], k), "members")
        if members.isEmpty():
            break
        if parity is None:  # members of later regions are among those of the first
            parity = materialise(_parity(rows, members.select("id").distinct(), n), "parity")
        met = materialise(_meetings(members, parity, percent), "met")
        pairs = met.filter("open").select("a", "b").distinct()
        if measured is not None:
            seen = measured.select("a", "b").unionByName(measured.select(F.col("b").alias("a"), F.col("a").alias("b")))
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        new = materialise(_distances(materialise(pairs, "pairs"), rows, n), "distances")
        measured = new if measured is None else measured.unionByName(new)
        labels = materialise(_labels(_linked(measured, percent)), "labels")
        live = materialise(_rings(met, percent, k + 1).unionByName(_measured_rings(members, measured, percent, k + 1)), "live")
    comps = components(links if measured is None else links.unionByName(_linked(measured, percent)))

    node = F.when(F.col("n_shingles") > 0, F.coalesce("component", "key"))
    whole = per_row.join(comps.withColumnRenamed("id", "key"), "key", "left").select("id", "n_shingles", node.alias("node"))
    smallest = whole.filter("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("smallest"))
    return whole.join(smallest, "node", "left").select(
        "id", "n_shingles", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("smallest")).alias("component_id"))
