"""Anchors: places in a symbol sequence that its own content picks.

Every window of ``length`` symbols holds exactly one anchor, the leftmost of its k-grams with the
smallest hash. Equal windows hold the same anchor at the same offset, so it is enough to compare
stretches around anchors whose k-gram occurs more than once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import sliced, text_chunks, written

#: Window starts looked at together; a longer document is cut there, with its windows kept whole.
BLOCK = 1 << 19
_POSITION_BITS = np.uint64(20)
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of the k symbols from each place on; k is a power of two."""
    h, width, i = symbols, 1, 0
    with np.errstate(over="ignore"):
        while width < k:
            h = h[:-width] * np.uint64(_ODD[i]) + h[width:]
            width, i = 2 * width, i + 1
        h = h ^ (h >> np.uint64(32))
        h = h * np.uint64(_ODD[5])
        return h ^ (h >> np.uint64(29))


def sliding_minimum(v: np.ndarray, w: int) -> np.ndarray:
    width = 1
    n = len(v) - w + 1
    while 2 * width <= w:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    return np.minimum(v[:n], v[w - width : w - width + n])


def find_anchors(symbols: np.ndarray, bounds: np.ndarray, k: int, length: int, table: np.ndarray | None = None):
    """(document, anchor, first window start, last window start, hash of the anchor's k-gram).

    ``symbols`` are 64-bit hashes of the symbols of documents that lie side by side, or places in a
    ``table`` of such hashes, which a block at a time looks up; ``bounds`` has where each begins, and the end. Windows lie inside one document. Places count from the
    first document's start. Every anchor is given once, also where its windows lie in two blocks.
    """
    docs, ats, firsts, lasts, hashes = [], [], [], [], []
    total = len(symbols)
    step = BLOCK
    for lo in range(0, max(total - length + 1, 0), step):
        part = symbols[lo : min(lo + step + length - 1, total)]
        part = part if table is None else table[part]
        h = gram_hashes(part, k)
        v = (h >> _POSITION_BITS << _POSITION_BITS) | np.arange(len(h), dtype=np.uint64)
        at = (sliding_minimum(v, length - k + 1) & np.uint64((1 << 20) - 1)).astype(np.int64)
        start = np.arange(len(at))
        doc = np.searchsorted(bounds, start + lo, side="right") - 1
        ok = start + lo + length <= bounds[doc + 1]
        start, at, doc = start[ok], at[ok], doc[ok]
        if not len(start):
            continue
        new = np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)])
        where = np.flatnonzero(new)
        docs.append(doc[where])
        ats.append(at[where] + lo)
        firsts.append(start[where] + lo)
        lasts.append(start[np.append(where[1:], len(start)) - 1] + lo)
        hashes.append(h[at[where]])
    if not docs:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64)
    doc, at, first, last, h = map(np.concatenate, (docs, ats, firsts, lasts, hashes))
    # windows left and right of a block's border may share their anchor
    new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])))
    doc, at, first, last, h = doc[new], at[new], first[new], last[np.append(new[1:], len(last)) - 1], h[new]
    # the smallest of many hashes are small: mixed again, they spread evenly
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(_ODD[1])
        h = (h ^ (h >> np.uint64(27))) * np.uint64(_ODD[4])
    return doc, at, first, last, h ^ (h >> np.uint64(32))


#: Distinct hashes that a task counts before it sends them.
COUNTED = 300_000
FOUND_SCHEMA = "key bigint, h bigint, k1 bigint, n bigint"


def _rows(key, h, k1, n):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (key, h, k1, n)], ["key", "h", "k1", "n"])


def _counted(make_finder):
    """Kernel: (k1, k2, text) -> a row (h, h, k1, n) for each hash that a task met, n times, first in
    document k1; and where it met it more than once a row (k1, h, k1, 0) for each of the documents,
    which need not be asked about again. So a very common hash is a few rows."""

    def kernel(batches):
        find = make_finder()
        seen: dict[int, list] = {}

        def flush():
            h = list(seen)
            out = _rows(h, h, [v[0] for v in seen.values()], [v[1] for v in seen.values()])
            seen.clear()
            return out

        for batch in sliced(batches):
            k1 = batch.column(0).to_pylist()
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]
            for lo, hi in text_chunks(texts):
                doc, h = find(texts[lo:hi])
                known = set()
                for d, x in zip(doc.tolist(), h.astype(np.int64).tolist(), strict=True):
                    k = k1[lo + d]
                    entry = seen.get(x)
                    if entry is None:
                        seen[x] = [k, 1]
                    else:
                        entry[1] += 1
                        known.add((entry[0], x))
                        known.add((k, x))
                if known:
                    k, x = zip(*known, strict=True)
                    yield _rows(k, x, k, np.zeros(len(k), np.int64))
                if len(seen) >= COUNTED:
                    yield flush()
        if seen:
            yield flush()

    return kernel


def _repeated(hot: int):
    """Kernel over rows ordered by hash: (k1, h) where a hash was met again, and (null, h) for hashes met
    over ``hot`` times."""

    def kernel(batches):
        held = [np.zeros(0, np.int64)] * 3

        def judged(h, k1, n):
            new = np.append(True, h[1:] != h[:-1])
            run = np.cumsum(new) - 1
            total = np.bincount(run, weights=n).astype(np.int64)
            keep = total[run] > 1
            common = h[new][total > hot]
            k = pa.concat_arrays([pa.array(k1[keep], pa.int64()), pa.nulls(len(common), pa.int64())])
            return pa.RecordBatch.from_arrays([k, pa.array(np.concatenate([h[keep], common]), pa.int64())], ["k1", "h"])

        for batch in batches:
            h, k1, n = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("h", "k1", "n"))
            known = n == 0
            if known.any():
                yield pa.RecordBatch.from_arrays([pa.array(k1[known]), pa.array(h[known])], ["k1", "h"])
            held = [np.concatenate([x, y[~known]]) for x, y in zip(held, (h, k1, n), strict=True)]
            if len(held[0]):
                # the last hash may go on in the next batch; it has a row for each task at most
                cut = np.searchsorted(held[0], held[0][-1])
                if cut:
                    yield judged(*(x[:cut] for x in held))
                    held = [x[cut:] for x in held]
        if len(held[0]):
            yield judged(*held)

    return kernel


def repeated_anchors(keyed: DataFrame, make_finder, hot: int) -> tuple[DataFrame, np.ndarray]:
    """((k1, grams), hot): for each document key the anchor hashes that occur more than once
    anywhere, and the hashes that occur over ``hot`` times.

    ``keyed`` has (k1, k2, text); ``make_finder()`` gives a function from texts to (document, hash) of their
    anchors. There is at most one hot hash for ``hot`` anchors of the corpus, which bounds what comes to
    the driver.
    """
    counted = keyed.select("k1", "k2", "text").mapInArrow(_counted(make_finder), FOUND_SCHEMA)
    found = written(counted.repartition("key").sortWithinPartitions("h").mapInArrow(_repeated(hot), "k1 bigint, h bigint"), "anchors")
    common = np.sort(np.array([r[0] for r in found.where("k1 is null").select("h").distinct().collect()], np.int64))
    return found.where("k1 is not null").groupBy("k1").agg(F.collect_set("h").alias("grams")), common
