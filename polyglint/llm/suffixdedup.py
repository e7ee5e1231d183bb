"""Removal of repeated byte strings across documents with suffix arrays: op2.

A byte goes if it is covered by a LENGTH-byte string that also starts earlier (smaller doc_id, or same document).

1. Every window of LENGTH bytes contains KGRAM-byte strings; the one with the least hash (leftmost of equals) is its
   minimizer, so equal windows have equal minimizers at equal offsets. Consecutive windows with the same minimizer form a
   run. Runs whose minimizer stands nowhere else in the corpus hold no repeated window and go no further: this is exact.
2. Runs with equal contents meet in their first occurrence (counted with map-side combination); in all others every
   window is repeated.
3. Different contents with a common minimizer go to a shard together. There, a suffix array by induced sorting (see
   `sais`) and permuted common prefixes give the classes of equal windows; all but the first window of a class are
   repeated. A shard holds whole groups, up to SHARD bytes at a time.
4. A minimizer with more than GROUP different contents is not collected: its windows are compared by a 128-bit digest
   each, combined before they are shuffled. No group is cut.
5. Repeated windows, as byte ranges, return to their documents.

Texts count as UTF-8, null as empty. Rows that repeat doc_id and text are one document. Rows that repeat a doc_id with
another text are ordered by a hash of the text. A null doc_id comes before all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, dropped, inputs, saved

LENGTH, KGRAM = 100, 32
GROUP = 30_000
SHARD = 1 << 21
#: Bytes of a document handled at once; longer ones are cut into pieces that overlap by LENGTH - 1.
PIECE = 1 << 20

_R = np.random.default_rng(7)
_TABLES = _R.integers(0, 1 << 64, (2, 256), np.uint64)
_BASES = _R.integers(0, 1 << 64, 2, np.uint64) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_SIZE = PIECE * 3
_CACHE: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _rolling(data: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash, and the inverse powers that make a difference independent of its place."""
    if which not in _CACHE:
        base = int(_BASES[which])
        _CACHE[which] = (_powers(base, _SIZE), _powers(pow(base, -1, 1 << 64), _SIZE))
    up, down = _CACHE[which]
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLES[which][data] * up[: len(data)], dtype=np.uint64)]), down


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _window_least(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    n, have = len(a) - w + 1, 1
    while 2 * have <= w:
        a = np.minimum(a[:-have], a[have:])
        have *= 2
    return np.minimum(a[:n], a[w - have : w - have + n]) if have < w else a[:n]


def runs(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, contents: bool = True) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: minimizer hash, content hash (if asked for), text, start in the text, windows."""
    n, bits = len(data) - LENGTH + 1, np.uint64(23)
    p, down = _rolling(data, 0)
    h = _mix((p[KGRAM:] - p[:-KGRAM]) * down[: len(data) - KGRAM + 1])
    low = np.uint64((1 << 23) - 1)
    at = (_window_least(h & ~low | np.arange(len(h), dtype=np.uint64), LENGTH - KGRAM + 1) & low).astype(np.int64)
    assert len(h) <= 1 << int(bits)
    sizes = np.maximum(ends - begins - LENGTH + 1, 0)
    text = np.repeat(np.arange(len(begins)), sizes)
    win = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begins, sizes)
    assert not len(win) or win[-1] < n
    best = at[win]
    new = np.ones(len(win), bool)
    new[1:] = (best[1:] != best[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(win)))
    start = win[first]
    c = np.zeros(len(first), np.uint64)
    if contents:
        q, down = _rolling(data, 1)
        c = _mix((q[start + count + LENGTH - 1] - q[start]) * down[start] + count.astype(np.uint64))
    return h[best[first]], c, text[first], start - begins[text[first]], count


def _pieces(batch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of a batch's texts in groups of about PIECE bytes: data, begins, ends, row and place in the row's text."""
    import pyarrow as pa

    arr = batch.column(column)
    if pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.string())
    off = np.frombuffer(arr.buffers()[1], np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(arr.buffers()[2] or b"", np.uint8)
    held: list[tuple[int, int, int, int]] = []
    size = 0

    def group():
        chunk = np.concatenate([data[a:z] for a, z, _, _ in held])
        lengths = np.array([z - a for a, z, _, _ in held])
        ends = np.cumsum(lengths)
        return chunk, ends - lengths, ends, np.array([r for _, _, r, _ in held]), np.array([s for _, _, _, s in held])

    for row, (a, z) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        for s in range(0, max(z - a - LENGTH + 1, 0), PIECE):
            held.append((a + s, min(z, a + s + PIECE + LENGTH - 1), row, s))
            size += held[-1][1] - held[-1][0]
            if size >= PIECE:
                yield group()
                held, size = [], 0
    if held:
        yield group()


def _texts(docs: DataFrame) -> DataFrame:
    """tie tells apart texts that share a doc_id; it is 0 where ids are unique, which is checked."""
    rows = inputs(docs)
    repeated = not rows.groupBy("doc_id").count().filter("count > 1").isEmpty()
    return rows.select("doc_id", (F.hash("text") if repeated else F.lit(0)).alias("tie"), "text")


def all_runs(texts: DataFrame, contents: bool) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for data, begins, ends, row, place in _pieces(batch, 2):
                h, c, text, start, n = runs(data, begins, ends, contents)
                if contents:
                    rows = pa.array(row[text])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array((start + place[text]).astype(np.int32)), pa.array(n.astype(np.int32))],
                        ["h", "c", "doc_id", "tie", "start", "n"],
                    )
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    return texts.mapInArrow(run, "h long, c long, doc_id long, tie int, start int, n int" if contents else "h long")


def repeated_windows(contents: list[bytes], order: np.ndarray) -> list[np.ndarray]:
    """Offsets in each content of the windows that are not the first of their class. order: rank of each content's first
    occurrence; within one document's run the windows of a minimizer all differ, so ranks decide."""
    sizes = np.array([len(x) + 1 for x in contents])
    t = np.zeros(sizes.sum() + 1, np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    joined = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8)
    t[:-1] = joined
    t[:-1] += 2
    t[ends - 1] = 1
    from .sais import common_prefixes, suffix_array

    sa = suffix_array(t, 258, 2 * LENGTH)
    prefix = common_prefixes(t, sa, LENGTH)
    of = np.repeat(np.arange(len(contents)), sizes)
    inside = np.zeros(len(t), bool)
    inside[:-1] = np.arange(len(of)) + LENGTH < np.repeat(ends, sizes)
    # classes: neighbours in the array that agree on LENGTH bytes
    linked = prefix[sa] >= LENGTH
    klass = np.cumsum(~linked)
    keep = inside[sa]
    place, klass = sa[keep], klass[keep]
    rank = order[of[place]]
    by = np.lexsort((rank, klass))
    place, klass = place[by], klass[by]
    later = np.zeros(len(place), bool)
    later[1:] = klass[1:] == klass[:-1]
    flagged = np.sort(place[later])
    cut = np.searchsorted(flagged, begins)
    return [flagged[a:z] - b for a, z, b in zip(cut, [*cut[1:], len(flagged)], begins, strict=True)]


def _ranges(offsets: np.ndarray) -> tuple[list[int], list[int]]:
    """Runs of consecutive offsets: first, and count."""
    if not len(offsets):
        return [], []
    cut = np.flatnonzero(np.diff(offsets) != 1) + 1
    first = offsets[np.concatenate([[0], cut])]
    return first.tolist(), np.diff(np.concatenate([[0], cut, [len(offsets)]])).tolist()


CONTENT = "h long, c long, doc_id long, tie int, start int, body binary"
FLAGS = "h long, c long, offs array<int>, lens array<int>"


def _bodies(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of each content, read from the document where it first occurs."""
    per_doc = wanted.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("h", "c", "start", "n")).alias("want"))
    joined = texts.alias("t").join(per_doc.alias("w"), F.expr("t.doc_id <=> w.doc_id AND t.tie = w.tie")).select("t.doc_id", "t.tie", "text", "want").dropDuplicates(["doc_id", "tie"])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, tie, text, want in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                rows += [(w["h"], w["c"], doc_id, tie, w["start"], data[w["start"] : w["start"] + w["n"] + LENGTH - 1]) for w in want]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], ["h", "c", "doc_id", "tie", "start", "body"])

    return joined.mapInArrow(run, CONTENT)


def _by_suffix_array(bodies: DataFrame) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list[tuple] = []
        size = 0

        def flags(rows: list[tuple]):
            by = sorted(range(len(rows)), key=lambda i: ((rows[i][2] is not None, rows[i][2] or 0), rows[i][3], rows[i][4]))
            order = np.empty(len(rows), np.int64)
            order[by] = np.arange(len(rows))
            out = [(h, c, *_ranges(x)) for (h, c, *_), x in zip(rows, repeated_windows([r[5] for r in rows], order), strict=True) if len(x)]
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], ["h", "c", "offs", "lens"])

        for batch in batches:
            for row in zip(*[batch.column(k).to_pylist() for k in range(6)], strict=True):
                if size >= SHARD and row[0] != held[-1][0]:
                    yield flags(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield flags(held)

    return bodies.repartition("h").sortWithinPartitions("h").mapInArrow(run, FLAGS)


def _by_digest(bodies: DataFrame) -> DataFrame:
    """The same flags for groups of any size, window by window."""

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        for batch in batches:
            for h, c, doc_id, tie, start, body in zip(*[batch.column(k).to_pylist() for k in range(6)], strict=True):
                n = len(body) - LENGTH + 1
                key = [hashlib.blake2b(body[i : i + LENGTH], digest_size=16).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h] * n, pa.int64()), pa.array([c] * n, pa.int64()), pa.array([doc_id] * n, pa.int64()), pa.array([tie] * n, pa.int32()), pa.array(range(start, start + n), pa.int32()), pa.array(range(n), pa.int32()), pa.array(key, pa.binary())],
                    ["h", "c", "doc_id", "tie", "pos", "off", "key"],
                )

    wins = bodies.mapInArrow(run, "h long, c long, doc_id long, tie int, pos int, off int, key binary")
    least = wins.groupBy("key").agg(F.min(F.struct("doc_id", "tie", "pos")).alias("least"))
    later = wins.join(least, "key").filter(~F.struct("doc_id", "tie", "pos").eqNullSafe(F.col("least")))
    return later.groupBy("h", "c").agg(F.collect_list("off").alias("offs")).select("h", "c", "offs", F.transform("offs", lambda x: F.lit(1)).alias("lens"))


def ranges(spark: SparkSession, texts: DataFrame, group: int = GROUP) -> DataFrame:
    """texts: see _texts. doc_id, tie, gone: byte ranges (s, e) that repeat earlier bytes, for documents that have any."""
    arrow_batches(spark)
    often = saved(spark, all_runs(texts, contents=False).groupBy("h").count().filter("count > 1").select("h"), "minimizers")
    dropped(spark)
    found = saved(spark, all_runs(texts, contents=True).join(often, "h", "left_semi"), "runs")
    dropped(spark, often)
    first = F.min(F.struct("doc_id", "tie", "start")).alias("first")
    contents = saved(spark, found.groupBy("h", "c").agg(first, F.first("n").alias("n")), "contents")
    dropped(spark)
    groups = contents.groupBy("h").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    shared = saved(spark, contents.join(groups, "h").select("h", "c", "first.*", "n", "members"), "shared")
    bodies = saved(spark, _bodies(texts, shared.filter(F.col("members") <= group)), "bodies")
    dropped(spark)
    parts = [saved(spark, _by_suffix_array(bodies), "flags")]
    dropped(spark, bodies)
    large = shared.filter(F.col("members") > group)
    if not large.isEmpty():
        bodies = saved(spark, _bodies(texts, large), "bodies")
        parts.append(saved(spark, _by_digest(bodies), "flags"))
        dropped(spark, bodies)
    dropped(spark, shared)
    flags = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    copies = found.join(contents.select("h", "c", "first"), ["h", "c"]).filter(~F.struct("doc_id", "tie", "start").eqNullSafe(F.col("first")))
    copies = copies.select("doc_id", "tie", F.struct(F.col("start").alias("s"), (F.col("start") + F.col("n") + (LENGTH - 1)).alias("e")).alias("r"))
    part = contents.join(flags, ["h", "c"]).select("first.doc_id", "first.tie", F.explode(F.arrays_zip("offs", "lens")).alias("x"), "first.start")
    part = part.select("doc_id", "tie", F.struct((F.col("start") + F.col("x.offs")).alias("s"), (F.col("start") + F.col("x.offs") + F.col("x.lens") + (LENGTH - 1)).alias("e")).alias("r"))
    out = saved(spark, copies.union(part).groupBy("doc_id", "tie").agg(F.array_sort(F.collect_set("r")).alias("gone")), "ranges")
    dropped(spark, found, contents, *parts)
    return out


def merged(gone: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of sorted ranges."""
    out: list[tuple[int, int]] = []
    for r in gone or ():
        if out and r["s"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], r["e"]))
        else:
            out.append((r["s"], r["e"]))
    return out


def op2(spark: SparkSession, docs: DataFrame, group: int = GROUP) -> DataFrame:
    texts = _texts(docs)
    gone = ranges(spark, texts, group)
    joined = texts.alias("t").join(gone.alias("g"), F.expr("t.doc_id <=> g.doc_id AND t.tie = g.tie"), "left").select("t.doc_id", "text", "gone")

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        for batch in batches:
            sizes, removed, spans, sha = [], [], [], []
            for text, ranges_ in zip(batch.column(1).to_pandas(), batch.column(2).to_pylist(), strict=True):
                data, out = text.encode("utf-8", "surrogatepass"), merged(ranges_)
                kept = hashlib.sha256()
                at = 0
                for s, e in out:
                    kept.update(data[at:s])
                    at = e
                kept.update(data[at:])
                sizes.append(len(data))
                removed.append(sum(e - s for s, e in out))
                spans.append(len(out))
                sha.append(kept.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in (sizes, removed, spans)], pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
