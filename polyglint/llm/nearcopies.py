r"""Near copies: SimHash links first, then all that the exact similarity of word shingles still adds.

Two texts are near copies if the sets of their five-word shingles (as in simhash.shingle_hashes; 64-bit hashes) have a
Jaccard similarity of 0.8 at least. A fingerprint's distance only estimates that: what SimHash links is a candidate, and a
prefix filter, which loses none, gives the others: in any order of all shingles, two similar sets have their first common
shingle among the first n - ceil(0.8 n) + 1 of each. Its places also bound what they can have in common. Rarer shingles come
first, by counts over all texts; hashes that share their first bits are counted together, which can put a rare shingle later.
The order decides what the join costs, never what it finds.

Texts of one component need no comparison with each other, so components are merged in rounds:
1. candidates of SimHash, and each text with the least text of the prefix shingle buckets that it shares most of;
2. twice, in buckets that still hold several components, a forest of the pairs of components that may be similar;
3. of the buckets that are left, every pair of different components that may be similar.
May be similar: sizes, places and the parities of the sets by 256 remainders, compared by XOR and bit counts in blocks,
allow 0.8. Candidates are then held against parities by as many remainders as a set has elements, 1024 at least (fewer tell
nothing of a long text), and what passes against the sets themselves, in batches, so that few sets lie on disk at a time.
A bucket over MOST_TOGETHER texts is compared in pairs of blocks, so that no task holds it; no bucket is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, dropped, inputs, saved
from .components import components
from .simhash import fingerprint, link, shingle_hashes

WORDS = 5
#: The least similarity, as a fraction: 4 / 5.
SIMILAR = (4, 5)
#: Counts are taken by so many first bits of a hash, least and most; about so many characters fall to one count until then.
BITS, CHARS = (16, 24), 48
#: Rows of a table that may be broadcast: two longs each.
MOST = 100_000
#: Texts of a bucket that are compared in one task.
MOST_TOGETHER = 4096
#: Shingles that the sets of a batch of candidates have together, if a quarter of all shingles is less.
ROOM = 1 << 22


def shingles(text: str) -> np.ndarray:
    """The sorted set; texts without words share one element."""
    return _as_set(shingle_hashes(text, WORDS))


def _as_set(hashes: np.ndarray) -> np.ndarray:
    h = np.unique(hashes)
    return h if len(h) else np.zeros(1, np.uint64)


def prefix_size(n: int) -> int:
    a, b = SIMILAR
    return n - -(-a * n // b) + 1


def parities(h: np.ndarray) -> np.ndarray:
    """Of a set, for each remainder by a power of two, len(h) and 1024 at least, whether an odd number has it: longs."""
    bits = max(1024, 1 << (len(h) - 1).bit_length())
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _halved(x: Column) -> Column:
    """Parities by half as many remainders."""
    k = F.floor(F.size(x) / 2).cast("int")
    return F.zip_with(F.slice(x, F.lit(1), k), F.slice(x, k + 1, k), lambda p, q: p.bitwiseXOR(q))


def _alike(common: Column, n: Column, m: Column) -> Column:
    """Whether sets of n and m elements with so many in common are similar: common / (n + m - common) >= a / b."""
    a, b = SIMILAR
    return (a + b) * common >= a * (n + m)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST else df


def _sets(texts: DataFrame) -> DataFrame:
    """text_key, shingles (longs) of a table of text_key, text."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [shingles(t).view(np.int64) for t in batch.column(1).to_pandas()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["text_key", "shingles"])

    return texts.select("text_key", "text").mapInArrow(run, "text_key long, shingles array<long>")


def shingle_counts(texts: DataFrame) -> np.ndarray:
    """For each value of the first bits of a hash, in how many sets of all texts its shingles stand, as eighths of the binary
    logarithm: a byte each, 16 MB at most, which reach the driver. Two bytes of each shingle are shuffled."""
    chars = texts.agg(F.sum(F.char_length("text"))).first()[0] or 0
    low, high = BITS
    bits = min(max((chars // CHARS).bit_length(), low), high)
    rest = bits - 8

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sets = [shingles(t) for t in batch.column(0).to_pandas()]
            if not sets:
                continue
            cells = np.sort((np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.uint32))
            ends = np.searchsorted(cells, np.arange(257, dtype=np.int64) << rest)
            own = (cells & np.uint32((1 << rest) - 1)).astype("<u2")
            parts = np.flatnonzero(np.diff(ends))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([own[ends[k] : ends[k + 1]].tobytes() for k in parts], pa.binary())], ["part", "cells"])

    def total(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, cells in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = held.setdefault(part, np.zeros(1 << rest, np.int64))
                counts += np.bincount(np.frombuffer(cells.as_buffer(), "<u2"), minlength=1 << rest)
        steps = [np.minimum(np.round(8 * np.log2(1 + c)), 255).astype(np.uint8).tobytes() for c in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(steps, pa.binary())], ["part", "steps"])

    counted = texts.select("text").mapInArrow(run, "part int, cells binary").repartition("part").mapInArrow(total, "part int, steps binary")
    out = np.zeros((256, 1 << rest), np.uint8)
    for part, steps in counted.collect():
        out[part] = np.frombuffer(steps, np.uint8)
    return out.ravel()


def _prefixes(texts: DataFrame, counts: np.ndarray) -> DataFrame:
    """counts: of shingle_counts, or none. doc_id, text_key, node (the set's hash), fp (its SimHash), n (its size), its prefix, its parities, and those by
    256 remainders (4 longs)."""
    first = np.uint64(65 - len(counts).bit_length())

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        for batch in batches:
            node, fp, size, prefix, parity, short = [], [], [], [], [], []
            for t in batch.column(2).to_pandas():
                every = shingle_hashes(t, WORDS)
                fp.append(fingerprint(every))
                h = _as_set(every)
                node.append(xxh64_intdigest(h.tobytes()))
                size.append(len(h))
                parity.append(parities(h))
                short.append(np.bitwise_xor.reduce(parity[-1].reshape(-1, 4), axis=0))
                if len(counts):
                    h = h[np.argsort(counts[h >> first], kind="stable")]
                prefix.append(h[: prefix_size(len(h))].view(np.int64))
            columns = [batch.column(0), batch.column(1), *[pa.array(np.array(x, np.uint64).view(np.int64)) for x in (node, fp)], pa.array(size, pa.int32()), *[pa.array(x, pa.list_(pa.int64())) for x in (prefix, parity, short)]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "node", "fp", "n", "prefix", "parity", "short"])

    return texts.select("doc_id", "text_key", "text").mapInArrow(run, "doc_id long, text_key long, node long, fp long, n int, prefix array<long>, parity array<long>, short array<long>")


def _similar(spark: SparkSession, texts: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs a, b of nodes those whose sets are similar. Sets are compared in batches of pairs: as many that the sets of
    a batch have a quarter of all shingles, or ROOM, which bounds what lies on disk."""
    a, b = SIMILAR
    marks = nodes.select("node", "n", "parity")
    marked = pairs.distinct().join(marks.toDF("a", "n", "x"), "a").join(marks.toDF("b", "m", "y"), "b")
    marked = marked.filter(b * F.least("n", "m") >= a * F.greatest("n", "m"))  # so parities are of one length, or one's is twice the other's
    x, y = (F.when(F.size(p) > F.size(q), _halved(F.col(p))).otherwise(F.col(p)) for p, q in ("xy", "yx"))
    differ = F.aggregate(F.zip_with(x, y, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, k: n + k)
    total = F.col("n") + F.col("m")
    pairs = saved(spark, marked.filter((a + b) * differ <= (b - a) * total).select("a", "b", total.alias("size")), "candidates")
    dropped(spark)
    sizes, every = pairs.agg(F.sum("size")).first()[0], nodes.agg(F.sum("n")).first()[0]
    if not sizes:
        return pairs.select("a", "b")
    batches = -(-sizes // max(ROOM, every // 4))
    out = None
    for k in range(batches):
        some = pairs.filter(F.pmod(F.xxhash64("a", "b"), F.lit(batches)) == k).select("a", "b")
        wanted = some.select(F.col("a").alias("node")).union(some.select("b")).distinct()
        wanted = saved(spark, nodes.select("node", "text_key").join(wanted, "node", "left_semi"), "wanted")
        held = texts.join(_small(wanted.select("text_key").distinct()), "text_key", "left_semi").dropDuplicates(["text_key"])
        held = saved(spark, wanted.join(_sets(held), "text_key").select("node", "shingles"), "sets")
        dropped(spark)
        both = some.join(held.toDF("a", "x"), "a").join(held.toDF("b", "y"), "b")
        found = saved(spark, both.filter(_alike(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"))).select("a", "b"), "similar")
        out = found if out is None else out.union(found)
        dropped(spark, wanted, held)
    dropped(spark, pairs, shuffles=False)
    return out


def _forest(a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Of pairs of places a, b, those that join all roots that the pairs join, and no more."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
    first = np.unique(np.stack([low, high]), axis=1, return_index=True)[1]
    keep = []
    for k in first.tolist():
        x, y = top(int(low[k])), top(int(high[k]))
        if x != y:
            above[x] = y
            keep.append(k)
    return np.array(keep, np.int64)


#: Buckets up to this size are compared many at a time.
TOGETHER = 64


def _passing(n: np.ndarray, free: np.ndarray, sig: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of pairs of places those that sizes, places and parities allow."""
    a, b = SIMILAR
    total = n[x] + n[y]
    good = np.flatnonzero((a + b) * np.minimum(free[x], free[y]) >= a * total)
    x, y, total = x[good], y[good], total[good]
    differ = np.bitwise_count(sig[x] ^ sig[y]).sum(1, dtype=np.int64)
    return good[(a + b) * differ <= (b - a) * total]


def _meet(bucket: np.ndarray, root: np.ndarray, n: np.ndarray, pos: np.ndarray, sig: np.ndarray, forest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of different roots in a bucket that may be similar. Rows are ordered by bucket (0, 1, ...); sig: a
    row of four words each."""
    n, free = n.astype(np.int64), (n - pos).astype(np.int64)
    place = np.unique(root, return_inverse=True)[1]
    sizes = np.bincount(bucket)
    small = np.flatnonzero(sizes[bucket] <= TOGETHER)
    left, right = [], []

    def add(x: np.ndarray, y: np.ndarray) -> None:
        if len(x):
            good = _passing(n, free, sig, x, y)
            left.append(x[good])
            right.append(y[good])

    for d in range(1, int(sizes[bucket[small]].max()) if len(small) else 0):
        x, y = small[:-d], small[d:]
        both = np.flatnonzero((bucket[x] == bucket[y]) & (place[x] != place[y]))
        add(x[both], y[both])
    ends = np.cumsum(sizes)
    for k in np.flatnonzero(sizes > TOGETHER).tolist():
        rows = np.arange(ends[k] - sizes[k], ends[k])
        own, counts = np.unique(place[rows], return_counts=True)
        minor = rows[place[rows] != own[counts.argmax()]]  # of every pair one at least is outside the largest component
        for j in range(0, len(minor), 128):
            x, y = np.nonzero(place[minor[j : j + 128], None] != place[rows])
            add(minor[j + x], rows[y])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    if forest and len(a):
        k = _forest(a, b, place)
        a, b = a[k], b[k]
    return a, b


def _candidates(spark: SparkSession, met: DataFrame, nodes: DataFrame, forest: bool) -> DataFrame:
    """a, b (a < b). met: shingle, texts (in the bucket), node, pos, root."""
    rows = met.join(nodes.select("node", "n", *[F.col("short")[k].alias(f"s{k}") for k in range(4)]), "node")
    blocks = F.ceil(F.col("texts") / MOST_TOGETHER).cast("int")
    own = F.pmod(F.hash("node"), F.col("blocks"))
    rows = rows.withColumn("blocks", blocks).withColumn("own", own)
    rows = rows.withColumn("of", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.least(k, F.col("own")) * F.col("blocks") + F.greatest(k, F.col("own")))))
    rows = rows.select("shingle", "of", "node", "root", "n", "pos", "s0", "s1", "s2", "s3")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list[np.ndarray] | None = None

        def pairs(cols: list[np.ndarray]):
            new = (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)
            bucket = np.concatenate([np.zeros(1, np.int64), np.cumsum(new)])
            a, b = _meet(bucket, *cols[3:6], np.stack([c.view(np.uint64) for c in cols[6:]], axis=1), forest)
            a, b = cols[2][a], cols[2][b]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            if len(held[0]) >= 1 << 15:
                cut = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0))
                if len(cut):
                    k = cut[-1] + 1
                    yield pairs([h[:k] for h in held])
                    held = [h[k:] for h in held]
        if held is not None and len(held[0]):
            yield pairs(held)

    return rows.repartition("shingle", "of").sortWithinPartitions("shingle", "of").mapInArrow(run, "a long, b long").distinct()


def near_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, text_key, component (a long) for every row of docs; text_key is xxhash64 of the text, null being empty.

    Equal texts share a component, rows that repeat an id or have none included; an empty table gives no rows.
    """
    arrow_batches(spark)
    texts = inputs(docs).withColumn("text_key", F.xxhash64("text"))
    counts = shingle_counts(texts)
    dropped(spark)
    rows = saved(spark, _prefixes(texts, counts), "prefixes")
    nodes = rows.groupBy("node").agg(F.min("text_key").alias("text_key"), *[F.first(c).alias(c) for c in ("fp", "n", "prefix", "parity", "short")])
    nodes = saved(spark, nodes, "nodes")
    ids = saved(spark, rows.select("doc_id", "text_key", "node"), "ids")
    dropped(spark, rows)
    # SimHash: texts of one fingerprint, and of linked ones
    by_fp = saved(spark, nodes.groupBy("fp").agg(F.min("node").alias("least")), "fingerprints")
    hashed = nodes.select("node", "fp").join(by_fp, "fp").filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    linked = link(spark, by_fp.select("fp")).join(by_fp.toDF("a", "x"), "a").join(by_fp.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    # buckets of prefix shingles
    each = nodes.select("node", F.posexplode("prefix").alias("pos", "shingle"))
    shared = saved(spark, each.groupBy("shingle").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").select("shingle", "low"), "shared")
    dropped(spark)
    # buckets grow with the corpus: they are shuffled at every size
    met = saved(spark, each.join(shared, "shingle"), "met")
    dropped(spark, shared)
    best = met.filter("node <> low").groupBy("node", "low").count().groupBy("node").agg(F.max_by("low", "count").alias("b")).select(F.col("node").alias("a"), "b")
    edges = _similar(spark, texts, nodes, hashed.union(linked).union(best).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    tested = None
    for forest in (True, True, False):
        roots = saved(spark, components(spark, edges), "roots")
        last = met
        met = met.select("shingle", "node", "pos").join(_small(roots), "node", "left").select("shingle", "node", "pos", F.coalesce("root", "node").alias("root"))
        mixed = met.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("texts")).filter("low <> high")
        mixed = saved(spark, mixed.select("shingle", "texts"), "mixed")
        met = saved(spark, met.join(mixed, "shingle"), "met")
        dropped(spark, last, mixed)
        pairs = saved(spark, _candidates(spark, met, nodes, forest), "pairs")
        dropped(spark)
        tested, pairs = pairs if tested is None else tested.union(pairs), pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")
        edges = edges.union(_similar(spark, texts, nodes, pairs))
        dropped(spark)
    roots = saved(spark, components(spark, edges), "roots")
    dropped(spark, nodes, by_fp, met, shuffles=False)
    return ids.join(_small(roots), "node", "left").select("doc_id", "text_key", F.coalesce("root", "node").alias("component"))


def one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that stay: of each component one, that with the least doc_id, then the least hash of
    its text; one without an id only where all are. Of rows that repeat both id and text one arbitrary row stays.

    A row goes only for another row of its own component: rows that share an id, or have none, but differ in their texts
    are kept apart by the text's hash.
    """
    found = saved(spark, near_copies(spark, docs), "components")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    kept = saved(spark, found.groupBy("component").agg(first.alias("k")).select(F.col("k.doc_id").alias("kept_id"), F.col("k.text_key").alias("kept_key")), "kept")
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    out = docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]) & (key == kept["kept_key"]), "left_semi")
    if found.groupBy("doc_id", "text_key").count().filter("count > 1").isEmpty():
        return out
    return out.withColumn("_key", key).dropDuplicates(["doc_id", "_key"]).drop("_key")
