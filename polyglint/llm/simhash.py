r"""SimHash near-duplicates with bit-sliced comparison: op10.

Distinct fingerprints are put into buckets so that two within the radius share one: of four blocks of bits, one is
equal (pigeonhole). A bucket over MOST is split by four blocks of the bits it has not fixed, again exactly, until its
buckets are small; with few free bits a bucket of distinct fingerprints is small by itself. More fingerprints also mean
more fixed bits from the start. No bucket is capped and no candidate is dropped.

In a bucket, bit planes are stored vertically: a 64-bit word holds one bit of 64 fingerprints. A query is compared with
64 others at a time by XOR with its bit's plane; a carry-save adder of two counter planes and an overflow plane counts
all 64 distances, and a block is abandoned once every distance has passed the radius of 3.
A bucket gives a spanning forest, never all its pairs; components then come from alternating star steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, dropped, inputs, lookup, saved
from .components import components

RADIUS = 3
#: Fingerprints in a bucket that is compared as it is; a larger one is split.
MOST = 1024
BUCKETS = "mask long, value long, fp long"


def shingle_hashes(text: str, size: int = 3, seed: int = 42) -> np.ndarray:
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - size + 1
    return np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[size - 1 :].tolist(), strict=True)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is in over half the hashes; no hash gives zero."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[k : k + (1 << 15)].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) of every whole text."""
    arrow_batches(spark)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fp = np.array([fingerprint(shingle_hashes(t)) for t in batch.column(1).to_pandas()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return inputs(docs).mapInArrow(run, "doc_id long, fp long")


def _split(mask: int, parts: int = RADIUS + 1) -> list[int]:
    """Masks that also fix one of `parts` blocks of the free bits."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [round(k * len(free) / parts) for k in range(parts + 1)]
    return [mask | sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _near(fp: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places i < j < ends[i] (the end of i's bucket) whose fingerprints differ in RADIUS bits at most."""
    n, full = len(fp), np.uint64(0xFFFFFFFFFFFFFFFF)
    blocks = -(-n // 64)
    padded = np.zeros(blocks * 64, np.uint64)
    padded[:n] = fp
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8), bitorder="little").reshape(blocks, 64, 64)
    planes = np.packbits(bits.transpose(0, 2, 1).copy(), axis=-1, bitorder="little").view("<u8").reshape(blocks, 64)
    places = np.arange(n)
    first, last = (places + 1) // 64, (ends - 1) // 64
    count = np.where(ends > places + 1, last - first + 1, 0)
    q = np.repeat(places, count)
    b = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    low, high = np.clip(q + 1 - 64 * b, 0, 63).astype(np.uint64), np.clip(ends[q] - 64 * b, 1, 64).astype(np.uint64)
    over = ~((full << low) & (full >> (np.uint64(64) - high)))
    ones, twos = np.zeros(len(q), np.uint64), np.zeros(len(q), np.uint64)
    for bit in range(64):
        d = planes[b, bit] ^ (np.uint64(0) - ((fp[q] >> np.uint64(bit)) & np.uint64(1)))
        carry = ones & d
        ones ^= d
        over |= twos & carry
        twos ^= carry
        if bit % 8 == 7:
            alive = over != full
            q, b, ones, twos, over = q[alive], b[alive], ones[alive], twos[alive], over[alive]
    hit = np.unpackbits((~over).astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
    row, col = np.nonzero(hit)
    return q[row], 64 * b[row] + col


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least place reachable from each place."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
    while (label[label] != label).any():
        label = label[label]
    return label


def link(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """nodes: distinct fp. Edges a, b that join what lies within the radius."""
    total = nodes.count()
    masks = _split(0)
    if total >> 16 > 256:  # two of five blocks are equal as well: more buckets, each smaller
        five = _split(0, RADIUS + 2)
        masks = [x | y for k, x in enumerate(five) for y in five[k + 1 :]]
    level = nodes.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    level = level.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")
    done: DataFrame | None = None
    while True:
        large = saved(spark, level.groupBy("mask", "value").count().filter(F.col("count") > MOST).select("mask", "value"), "large")
        if large.isEmpty():
            done = level if done is None else done.union(level)
            break
        small = level.join(large, ["mask", "value"], "left_anti")
        done = small if done is None else done.union(small)
        found = [r[0] & (1 << 64) - 1 for r in large.select("mask").distinct().collect()]  # masks of one level: few, whatever the input
        if all(64 - m.bit_count() <= 10 for m in found):
            done = done.union(level.join(large, ["mask", "value"], "left_semi"))
            break
        children = F.create_map(*[x for m in found for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(c)) for c in _split(m)]))])
        level = level.join(large, ["mask", "value"], "left_semi").select("fp", F.explode(children[F.col("mask")]).alias("mask"))
        level = saved(spark, level.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp"), "split")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = [np.zeros(0, np.int64)] * 3

        def edges(mask, value, fp):
            new = np.flatnonzero((np.diff(mask) != 0) | (np.diff(value) != 0)) + 1
            bounds = np.concatenate([[0], new, [len(fp)]])
            ends = np.repeat(bounds[1:], np.diff(bounds))
            root = _forest(len(fp), *_near(fp.view(np.uint64), ends))
            own = np.flatnonzero(root != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(fp[own]), pa.array(fp[root[own]])], ["a", "b"])

        for batch in batches:
            held = [np.concatenate([h, batch.column(k).to_numpy()]) for k, h in enumerate(held)]
            if len(held[2]) >= 1 << 15:
                cut = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0))
                if len(cut):
                    k = cut[-1] + 1
                    yield edges(*[h[:k] for h in held])
                    held = [h[k:] for h in held]
        if len(held[2]):
            yield edges(*held)

    return done.repartition("mask", "value").sortWithinPartitions("mask", "value").mapInArrow(run, "a long, b long")


def near_duplicates(spark: SparkSession, docs: DataFrame, most: int = 200_000) -> DataFrame:
    """doc_id, fp, component_id for every row of docs. Null text: no words, fingerprint zero.

    Copies meet in one distinct fingerprint, counted with map-side combination before any comparison. component_id is
    the least doc_id of the component; rows without doc_id belong to one but never name it. Fingerprints of many rows and
    components of many fingerprints are broadcast, `most` at most.
    """
    fps = saved(spark, fingerprints(spark, docs), "fingerprints")
    nodes = saved(spark, fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "nodes")
    roots = saved(spark, components(spark, link(spark, nodes.select("fp"))), "roots")
    joined = saved(spark, nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root")), "rooted")
    names = saved(spark, joined.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("size")), "names")
    named = saved(spark, lookup(joined, names, "root", "size", most).select("fp", "copies", "component_id"), "named")
    dropped(spark, nodes, roots, joined, names, shuffles=False)
    return lookup(fps, named, "fp", "copies", most).select("doc_id", "fp", "component_id")


def op10(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return near_duplicates(spark, docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
