"""Token ids in Simple-8b files: op5.

A 64-bit word has a 4-bit selector on top and 60 bits of payload that hold as many equally wide ids as fit. Ids are cut
into blocks of BLOCK ids that are coded apart; a table gives each block's first word, so that all blocks can be decoded
side by side. Ids too wide for 60 bits go to an escape list behind the words; an escape word's payload is the index there.

A payload: "S8B1", u32 version, u64 ids, u64 words, u64 escapes, u64 first word of each block, the words, the escapes
(all little-endian). A file is Parquet with a row per segment of whole documents (first: ids before it in the file),
so that Spark's commit protocol covers it and no file system is assumed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_batches, inputs, shared_dir

BLOCK = 256
#: Fixed values of the code: ids per word by selector; 0 is the escape.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1])
WIDTHS = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60])
USED = range(1, 15)

FILES = "part int, segment long, first long, doc_ids array<long>, lengths array<long>, payload binary"
DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


_LOW_WIDTHS = np.maximum(np.ceil(np.log2(np.arange(1 << 16) + 1)), 1).astype(np.uint8)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id, 1 at least; 61 for all that need more than 60."""
    out = _LOW_WIDTHS[(ids & np.uint64(0xFFFF)).astype(np.uint16)]
    for k in (16, 32, 48):
        high = ids >> np.uint64(k)
        if not high.any():
            break
        out = np.where(high > 0, _LOW_WIDTHS[(high & np.uint64(0xFFFF)).astype(np.uint16)] + np.uint8(k), out)
    return np.minimum(out, np.uint8(61))


def encode(ids: np.ndarray) -> bytes:
    """ids: any unsigned integers below 2**64."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    blocks = -(-n // BLOCK)
    grid = np.zeros(blocks * BLOCK, np.uint64)
    grid[:n] = ids
    width = np.pad(_widths(grid).reshape(blocks, BLOCK), ((0, 0), (0, 60)))
    # the selector that packs most ids from each place, by window maxima of the widths; what fits in a longer window also
    # fits in a shorter one, so the number of selectors that fit tells the best
    best = np.full((blocks, BLOCK), 14, np.uint8)
    seen = width[:, : BLOCK + 59].copy()  # maximum of the `have` widths from each place
    have = 1
    for s in range(13, 0, -1):
        while have < COUNTS[s]:
            seen = np.maximum(seen[:, :-1], width[:, have : have + seen.shape[1] - 1])
            have += 1
        best -= seen[:, :BLOCK] <= WIDTHS[s]
    best[width[:, :BLOCK] > 60] = 0
    step = COUNTS[best]
    # all blocks walk from word to word together
    at, alive = np.zeros(blocks, np.int64), np.arange(blocks)
    head = np.zeros((blocks, BLOCK), bool)
    while len(alive):
        p = at[alive]
        head[alive, p] = True
        p = p + step[alive, p]
        at[alive] = p
        alive = alive[p < BLOCK]
    b, p = np.nonzero(head)
    real = b * BLOCK + p < max(n, 1)
    b, p = b[real], p[real]
    sel = best[b, p].astype(np.int64) if len(b) else np.zeros(0, np.int64)
    words = np.zeros(len(sel), np.uint64)
    wide = np.zeros((blocks, BLOCK + 60), np.uint64)  # zeros stand behind each block
    wide[:, :BLOCK] = grid.reshape(blocks, BLOCK)
    wide = wide.ravel()
    place = b * (BLOCK + 60) + p
    for s in USED:
        w = np.flatnonzero(sel == s)
        if len(w):
            at, word = place[w], np.full(len(w), s << 60, np.uint64)
            for j in range(COUNTS[s]):
                word |= wide[at + j] << np.uint64(j * WIDTHS[s])
            words[w] = word
    out = np.flatnonzero(sel == 0)
    escapes = grid[b[out] * BLOCK + p[out]]
    words[out] = np.arange(len(out), dtype=np.uint64)
    first = np.searchsorted(b, np.arange(blocks)).astype("<u8")
    head = np.array([n, len(words), len(escapes)], "<u8")
    return b"S8B1" + (1).to_bytes(4, "little") + head.tobytes() + first.tobytes() + words.astype("<u8").tobytes() + escapes.astype("<u8").tobytes()


def decode(payload: bytes, first_block: int = 0, n_blocks: int | None = None) -> np.ndarray:
    """The ids of all blocks, or of n_blocks from first_block on."""
    if payload[:4] != b"S8B1" or int.from_bytes(payload[4:8], "little") != 1:
        raise ValueError("not a Simple-8b payload of version 1")
    n, n_words, n_esc = (int(x) for x in np.frombuffer(payload, "<u8", 3, 8))
    blocks = -(-n // BLOCK)
    starts = np.frombuffer(payload, "<u8", blocks, 32).astype(np.int64)
    words = np.frombuffer(payload, "<u8", n_words, 32 + 8 * blocks)
    escapes = np.frombuffer(payload, "<u8", n_esc, 32 + 8 * (blocks + n_words))
    last = blocks if n_blocks is None else min(blocks, first_block + n_blocks)
    if first_block >= last:
        return np.zeros(0, np.uint64)
    ends = np.append(starts, n_words)
    lo, hi = ends[first_block], ends[last]
    words, starts = words[lo:hi], starts[first_block:last] - lo
    size = min(n, last * BLOCK) - first_block * BLOCK
    sel = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[sel]
    before = np.cumsum(count) - count
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(words))))
    place = before - before[starts][of]  # in the block
    out = np.zeros(len(starts) * (BLOCK + 60), np.uint64)  # what a block's last word holds beyond it falls behind it
    at = of * (BLOCK + 60) + place
    for s in USED:
        w = np.flatnonzero(sel == s)
        if len(w):
            mask, word, to = np.uint64((1 << int(WIDTHS[s])) - 1), words[w], at[w]
            for j in range(COUNTS[s]):
                out[to + j] = (word >> np.uint64(j * WIDTHS[s])) & mask
    w = np.flatnonzero(sel == 0)
    out[at[w]] = escapes[words[w].astype(np.int64)]
    return out.reshape(-1, BLOCK + 60)[:, :BLOCK].ravel()[:size]


def write(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, segment_ids: int = 1 << 18) -> None:
    """Encodes every text, appends end_id, and writes the files in ascending doc_id order.

    A null text counts as empty, a null doc_id comes first, rows with the same doc_id are ordered by their text's bytes.
    An empty table gives no segment.
    """
    arrow_batches(spark)

    def segments(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        from .tokens import encoder

        enc, part = encoder(tokenizer, False), TaskContext.get().partitionId()
        end = int(end_id).to_bytes(4, "little")
        doc_ids, lengths, chunks, held, first, k = [], [], [], 0, 0, 0
        types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        names = ["part", "segment", "first", "doc_ids", "lengths", "payload"]

        def flush():
            row = (part, k, first, doc_ids, lengths, encode(np.frombuffer(b"".join(chunks), "<u4")))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names)

        for doc_id, ids in enc.stream(batches):
            ids = ids + end
            doc_ids.append(doc_id)
            lengths.append(len(ids) // 4)
            chunks.append(ids)
            held += len(ids) // 4
            if held >= segment_ids:
                yield flush()
                first, k = first + held, k + 1
                doc_ids, lengths, chunks, held = [], [], [], 0
        if doc_ids:
            yield flush()

    ordered = inputs(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(segments, FILES).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILES).parquet(path)


def digest(spark: SparkSession, path: str) -> DataFrame:
    """From the files alone: each document's place in the whole stream, its length and its ids' checksum.

    The driver holds one sum for each file part (not for each document), as any global numbering of rows does.
    """
    base, total = {}, 0
    for r in read(spark, path).selectExpr("part", "aggregate(lengths, 0L, (a, x) -> a + x) n").groupBy("part").sum("n").orderBy("part").collect():
        base[r[0]] = total
        total += r[1]

    def docs(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa

        for batch in batches:
            for part, first, doc_ids, lengths, payload in zip(*[batch.column(c).to_pylist() for c in ("part", "first", "doc_ids", "lengths", "payload")], strict=True):
                ids = decode(payload).astype("<u4")
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts + (base[part] + first), pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read(spark, path).mapInArrow(docs, DIGEST)


def op5(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    path = shared_dir(spark, "simple8b")
    write(spark, docs, path, tokenizer)
    return digest(spark, path)
