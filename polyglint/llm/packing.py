"""Hierarchical multi-length packing: op8.

Within a task, documents stream through a buffer. A document of 2048 ids or more gives full windows and a tail; tails and
short documents are routed to the smallest of the tiers that holds them. Each tier is packed, longest first; what a window
has left is filled from shorter tiers, best fit first, and then by cutting one piece so that the window is full.
What the last buffer of a task has left over is cut into windows of smaller powers of two, so that nothing is padded.
Windows of a tier are dealt to steps of equal token counts, dearest attention (sum of squared lengths) first, in
serpentine order. Nothing is shuffled, and each task holds one buffer.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from .common import arrow_batches, give_back, inputs

TIERS = (2048, 1024, 512, 256)
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_id long"


class Shelf:
    """Pieces (document, start, length) by length; finds the longest that fits, or the shortest that is longer."""

    def __init__(self) -> None:
        self.by: dict[int, list] = {}
        self.lengths: list[int] = []

    def __bool__(self) -> bool:
        return bool(self.lengths)

    def put(self, doc: int, start: int, length: int) -> None:
        if length not in self.by:
            self.by[length] = []
            bisect.insort(self.lengths, length)
        self.by[length].append((doc, start, length))

    def _take(self, length: int) -> tuple:
        piece = self.by[length].pop()
        if not self.by[length]:
            del self.by[length]
            self.lengths.remove(length)
        return piece

    def fit(self, most: int) -> tuple | None:
        k = bisect.bisect_right(self.lengths, most)
        return self._take(self.lengths[k - 1]) if k else None

    def cut(self, length: int) -> tuple:
        """Exactly that many ids from the shortest longer piece; the rest goes back."""
        doc, start, n = self._take(self.lengths[bisect.bisect_right(self.lengths, length)])
        self.put(doc, start + length, n - length)
        return doc, start, length


def fill(shelf: Shelf, size: int, window: list, total: int) -> int:
    """Fills the window up to its size, or until the shelf is empty. Each round takes a piece or ends."""
    while total < size and shelf:
        piece = shelf.fit(size - total) or shelf.cut(size - total)
        window.append(piece)
        total += piece[2]
    return total


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS, last: bool = True) -> tuple[list[tuple[int, list]], list[tuple[int, int, int]]]:
    """Windows (tier, pieces) and, unless last, the pieces left over. Every id lies in one piece."""
    most, windows = tiers[0], []
    every = Shelf()
    for doc, n in enumerate(lengths):
        full = n // most
        windows += [(most, [(doc, k * most, most)]) for k in range(full)]
        if n % most:
            every.put(doc, full * most, n % most)
    # a tier takes its pieces off the common shelf, so that fillers cut from them are seen by all tiers
    spare: list[tuple[int, int, int]] = []
    for tier, below in zip(tiers, [*tiers[1:], 0], strict=True):
        while every and every.lengths[-1] > below:
            first = every.fit(tier)
            if first is None:
                break
            window, total = [first], first[2]
            total = fill(every, tier, window, total)
            if total == tier:
                windows.append((tier, window))
            else:
                spare += window
    spare += [p for k in every.lengths for p in every.by[k]]
    if not last:
        return windows, spare
    left = Shelf()
    for p in spare:
        left.put(*p)
    rest = sum(p[2] for p in spare)
    while rest:
        size = min(most, 1 << rest.bit_length() - 1)
        window: list = []
        fill(left, size, window, 0)
        windows.append((size, window))
        rest -= size
    return windows, []


def steps(windows: list[tuple[int, list]], step_tokens: int) -> list[int]:
    """A step for each window: windows of one tier and step_tokens in all, attention costs balanced."""
    out, begun = [0] * len(windows), 0
    tiers: dict[int, list[int]] = {}
    for k, (tier, _) in enumerate(windows):
        tiers.setdefault(tier, []).append(k)
    for tier, own in sorted(tiers.items(), reverse=True):
        n = max(1, -(-len(own) * tier // step_tokens))
        own.sort(key=lambda k: (-sum(p[2] ** 2 for p in windows[k][1]), k))
        for r, k in enumerate(own):
            lap, place = divmod(r, n)
            out[k] = begun + (place if lap % 2 == 0 else n - 1 - place)
        begun += n
    return out


def op8(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, buffer_ids: int = 1 << 20, step_tokens: int = 1 << 16, chars: int = 16_000_000) -> DataFrame:
    """A row per piece. tiers: powers of two, longest first. Texts: null counts as empty; such a document is its end id.

    sequence_id and step_id are unique over the corpus: the task's number in the upper bits, a counter in the lower.
    Repeated rows are packed as often as they occur; a null doc_id stays null. chars: that a worker encodes at a time, which
    changes no row; fewer take less memory and more time.
    """
    arrow_batches(spark)

    def run(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa
        from pyspark import TaskContext

        from .tokens import encoder

        give_back()  # what an earlier stage left in this process
        enc, end = encoder(tokenizer, True), int(end_id).to_bytes(4, "little")
        high = TaskContext.get().partitionId() << 32
        next_seq = next_step = 0
        held: list[tuple] = []  # doc_id, start, ids, tokens of the document
        schema = pa.schema([(n, pa.int32() if n == "tier" else pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_id")])

        def flush(last: bool):
            nonlocal next_seq, next_step, held
            windows, spare = pack([len(h[2]) // 4 for h in held], tiers, last)
            at, cols = steps(windows, step_tokens), [[] for _ in schema]
            for (tier, pieces), step in zip(windows, at, strict=True):
                offset = 0
                for doc, start, n in pieces:
                    doc_id, base, ids, tokens = held[doc]
                    row = (doc_id, base + start, n, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + n)]), tokens, high + next_seq, offset, tier, high + next_step + step)
                    for c, x in zip(cols, row, strict=True):
                        c.append(x)
                    offset += n
                next_seq += 1
            next_step += max(at, default=-1) + 1
            held = [(held[d][0], held[d][1] + s, held[d][2][4 * s : 4 * (s + n)], held[d][3]) for d, s, n in spare]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        size = 0
        for doc_id, ids in enc.stream(batches, chars):
            ids = ids + end
            held.append((doc_id, 0, ids, len(ids) // 4))
            size += len(ids) // 4
            if size >= buffer_ids:
                yield flush(False)
                size = sum(len(h[2]) // 4 for h in held)
        yield flush(True)
        give_back()

    return inputs(docs).mapInArrow(run, PIECES)
