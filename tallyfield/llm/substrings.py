"""Suffix-array dedup: repeated byte strings by a distributed merge sort that knows common prefixes.

Only suffixes at anchors (see ``anchors``) whose k-gram occurs more than once are sorted, each cut to
the bytes that its windows can reach, with the bytes to its left, reversed, after them. Tasks sort
their suffixes, exchange the sorted runs front-coded, and merge what they receive with a loser tree
that carries common-prefix lengths and never compares a known prefix again. The merged order and its
common prefixes tell, for every window, whether the same bytes stand anywhere else.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from tallyfield.llm.anchors import find_anchors, repeated_anchors
from tallyfield.llm.common import named, sliced, text_chunks, text_key

DIGEST_SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
#: Order of strings: the anchor's hash first, so that runs part evenly without a sample.
HEAD = 8
#: Not a byte of UTF-8: stands for what is missing after a document's end.
END = b"\xff"


@dataclass(frozen=True)
class SubstringSettings:
    """length: bytes of a repeated string; gram: bytes of an anchor (a power of two);
    run_bytes: bytes of suffixes that a task sorts at once; parts: merges for each shuffle
    partition, one of which is in memory at a time; hot: strings around an anchor that occurs more often
    than this are sorted window by window, so that they spread over all parts."""

    length: int = 200
    gram: int = 32
    run_bytes: int = 8 << 20
    parts: int = 3
    hot: int = 200_000


_BYTE = np.random.default_rng(41).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _anchored(texts: list, settings: SubstringSettings):
    raw = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.cumsum([0, *map(len, texts)])
    return bounds, find_anchors(raw, bounds, settings.gram, settings.length, _BYTE)


def _finder(settings: SubstringSettings):
    def find(texts):
        _, (doc, _, _, _, h) = _anchored(texts, settings)
        return doc, h

    return lambda: find


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix; the first ``known`` bytes are the same and aren't looked at."""
    n = min(len(a), len(b))
    step = 32
    while known < n:
        x, y = a[known : known + step], b[known : known + step]
        if x != y:
            m = min(len(x), len(y))
            d = int.from_bytes(x[:m], "big") ^ int.from_bytes(y[:m], "big")
            return known + m if not d else known + m - 1 - (d.bit_length() - 1) // 8
        known += len(x)
        step = 256
    return n


def front_code(strings: list, counts: list, numbers: list) -> bytes:
    """A sorted run as bytes: for each string its common prefix with the one before, what follows
    that, its count and its number in the run."""
    prefix = np.zeros(len(strings), np.uint16)
    for i in range(1, len(strings)):
        prefix[i] = common_prefix(strings[i - 1], strings[i], 0)
    rest = [s[p:] for s, p in zip(strings, prefix.tolist(), strict=True)]
    sizes = np.array([*map(len, rest)], np.uint16)
    head = np.array([len(strings)], np.uint32)
    return b"".join([head.tobytes(), prefix.tobytes(), sizes.tobytes(), np.array(counts, np.uint32).tobytes(), np.array(numbers, np.uint32).tobytes(), *rest])


def front_decode(blob: bytes):
    """(strings, common prefixes, counts, numbers) of a run."""
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    at = 4
    prefix = np.frombuffer(blob, np.uint16, n, at)
    sizes = np.frombuffer(blob, np.uint16, n, at + 2 * n)
    counts = np.frombuffer(blob, np.uint32, n, at + 4 * n)
    numbers = np.frombuffer(blob, np.uint32, n, at + 8 * n)
    at += 12 * n
    strings, last = [], b""
    for p, size in zip(prefix.tolist(), sizes.tolist(), strict=True):
        last = last[:p] + blob[at : at + size]
        at += size
        strings.append(last)
    return strings, prefix.tolist(), counts, numbers


def merge_runs(runs: list):
    """Merge sorted runs [(strings, prefixes)] with a loser tree.

    Yields (run, index, common prefix with the string before). Every loser remembers how long its
    common prefix with the winner that beat it is, so a match compares prefixes' lengths, and bytes
    only beyond a length both share.
    """
    k = 1
    while k < len(runs):
        k *= 2
    at = [0] * len(runs)
    current: list = [r[0][0] if r[0] else None for r in runs] + [None] * (k - len(runs))
    loser, known = [0] * k, [0] * k  # of inner nodes

    def play(a, ha, b, hb):
        """(winner, its prefix, loser, its prefix with the winner)."""
        x, y = current[a], current[b]
        if y is None:
            return a, ha, b, 0
        if x is None:
            return b, hb, a, 0
        if ha > hb:
            return a, ha, b, hb
        if ha < hb:
            return b, hb, a, ha
        h = common_prefix(x, y, ha)
        if h == len(x) or h < len(y) and x[h] < y[h]:
            return a, ha, b, h
        return b, hb, a, h

    best = [0] * (2 * k)
    first = [0] * (2 * k)
    for i in range(k):
        best[k + i] = i
    for node in range(k - 1, 0, -1):
        w, hw, lo, hl = play(best[2 * node], first[2 * node], best[2 * node + 1], first[2 * node + 1])
        best[node], first[node], loser[node], known[node] = w, hw, lo, hl
    w, h = best[1] if k > 1 else 0, 0
    while current[w] is not None:
        i = at[w]
        yield w, i, h
        strings, prefixes = runs[w]
        i += 1
        at[w] = i
        if i < len(strings):
            current[w], h = strings[i], prefixes[i]
        else:
            current[w], h = None, 0
        node = (k + w) >> 1
        while node:
            w, h, loser[node], known[node] = play(w, h, loser[node], known[node])
            node >>= 1


def _runs_of(settings: SubstringSettings, parts: int, hot: np.ndarray):
    """Kernel: texts with their repeated anchors -> sorted runs, and where their strings occur."""

    def kernel(batches):
        task, made = TaskContext.get().partitionId(), 0
        strings: dict[bytes, int] = {}
        where: list[tuple] = []  # (number of the string, document, anchor)
        keys: list[tuple] = []
        held = 0

        def flush():
            nonlocal made, held
            run = task << 32 | made
            made += 1
            number = np.array([w[0] for w in where], np.int64)
            counts = np.bincount(number, minlength=len(strings)).tolist()
            ordered = sorted(strings)
            heads = np.frombuffer(b"".join([s[:4] for s in ordered]), ">u4").astype(np.uint64)
            part = (heads * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            edges = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(ordered))
            rows = []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                own = ordered[lo:hi]
                numbers = [strings[s] for s in own]
                rows.append((int(part[lo]), run, front_code(own, [counts[i] for i in numbers], numbers), None, None))
            places = np.array(where, np.int64)
            rows.append((run % parts, run, None, np.array(keys, np.int64).tobytes(), places.tobytes()))
            strings.clear()
            where.clear()
            keys.clear()
            held = 0
            dest, runs, blob, k, p = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(dest, pa.int32()), pa.array(runs, pa.int64()), pa.array(blob, pa.binary()), pa.array(k, pa.binary()), pa.array(p, pa.binary())], ["dest", "run", "strings", "docs", "places"])

        for batch in sliced(batches):
            k1, k2 = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("k1", "k2"))
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            grams = batch.column(batch.schema.get_field_index("grams"))
            for lo, hi in text_chunks(texts):
                bounds, (doc, at, first, last, h) = _anchored(texts[lo:hi], settings)
                common = np.isin(h.astype(np.int64), hot) if len(hot) else None
                keep = np.zeros(len(h), bool)
                edge = np.searchsorted(doc, np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    if edge[i] < edge[i + 1]:
                        keep[edge[i] : edge[i + 1]] = np.isin(h[edge[i] : edge[i + 1]].astype(np.int64), grams[lo + i].values.to_numpy(zero_copy_only=False))
                own = -1
                heads = h.astype(">u8").tobytes()
                for j in np.flatnonzero(keep).tolist():
                    d = int(doc[j])
                    if d != own or not keys:
                        own = d
                        keys.append((k1[lo + d], k2[lo + d]))
                    text, a, s = texts[lo + d], int(at[j] - bounds[d]), int(first[j] - bounds[d])
                    right = text[a : a + settings.length]
                    if common is not None and common[j]:
                        # windows with nothing to their left; a window's own hash leads it
                        windows = [(x, text[x : x + settings.length]) for x in range(s, int(last[j] - bounds[d]) + 1)]
                        parts_of = [(x, hashlib.blake2b(w, digest_size=HEAD).digest() + w) for x, w in windows]
                    else:
                        parts_of = [(a, heads[HEAD * j : HEAD * j + HEAD] + right + END * (settings.length - len(right)) + text[s:a][::-1])]
                    for place, string in parts_of:
                        number = strings.setdefault(string, len(strings))
                        where.append((number, len(keys) - 1, place))
                        if number == len(strings) - 1:
                            held += len(string)
                    if held >= settings.run_bytes or len(where) >= 100_000:
                        yield flush()
        if where:
            yield flush()

    return kernel


RUN_SCHEMA = "dest int, run bigint, strings binary, docs binary, places binary"


def window_verdicts(strings: list, prefixes: np.ndarray, counts: np.ndarray, settings: SubstringSettings) -> np.ndarray:
    """For each of the merged strings, which windows repeat: row i, column o says whether the window
    that begins o bytes left of string i's anchor occurs again.

    Equal strings are one class, and repeat in all windows if they occur more than once. Two windows
    are equal if their strings agree in the first length - o bytes from the anchor, which is a run of
    the merged order, and in o bytes to the left of it, a run of the order of the left sides.
    """
    length, offsets = settings.length, settings.length - settings.gram + 1
    size = np.array([*map(len, strings)])
    left = size - HEAD - length
    # bytes to the right that belong to the document
    real = np.array([len(s[HEAD : HEAD + length].rstrip(END)) for s in strings])
    same = np.append(False, (prefixes[1:] == size[1:]) & (size[1:] == size[:-1]))
    cls = np.cumsum(~same) - 1
    lead = np.flatnonzero(~same)
    total = np.bincount(cls, weights=counts).astype(np.int64)
    o = np.arange(offsets)
    valid = (o <= left[lead][:, None]) & (length - o <= real[lead][:, None])
    out = valid & (total > 1)[:, None]
    # classes with another class at the same anchor
    lcp = prefixes[lead]
    near = np.append(lcp[1:] >= HEAD + settings.gram, False) | (lcp >= HEAD + settings.gram) & (np.arange(len(lead)) > 0)
    pick = np.flatnonzero(near)
    if len(pick):
        between = lcp[pick].copy()
        between[0] = 0
        sides = [strings[lead[i]][HEAD + length :] for i in pick.tolist()]
        order = sorted(range(len(sides)), key=sides.__getitem__)
        lp = np.zeros(len(order), np.int64)
        for i in range(1, len(order)):
            lp[i] = common_prefix(sides[order[i - 1]], sides[order[i]], 0)
        order = np.array(order)
        weight = total[pick]
        ok = valid[pick]
        rank = np.empty(len(order), np.int64)
        for k in range(offsets):
            rows = np.flatnonzero(ok[:, k])
            if len(rows) < 2:
                continue
            right = np.cumsum(between < HEAD + length - k)
            rank[order] = np.cumsum(lp < k) if k else 0
            key = right[rows] * (len(order) + 1) + rank[rows]
            _, inverse = np.unique(key, return_inverse=True)
            out[pick[rows], k] |= np.bincount(inverse, weights=weight[rows])[inverse] > 1
    return out[cls]


def _merged(settings: SubstringSettings):
    """Kernel: the runs of a part, merged -> which windows of which strings repeat, by run."""
    offsets = settings.length - settings.gram + 1

    def verdicts(received):
        decoded = [front_decode(blob) for _, blob in received]
        strings, prefixes, origin = [], [], []
        for run, i, h in merge_runs([(d[0], d[1]) for d in decoded]):
            strings.append(decoded[run][0][i])
            prefixes.append(h)
            origin.append((run, i))
        origin = np.array(origin)
        counts = np.zeros(len(strings), np.int64)
        for r, d in enumerate(decoded):
            own = np.flatnonzero(origin[:, 0] == r)
            counts[own] = d[2][origin[own, 1]]
        repeat = window_verdicts(strings, np.array(prefixes), counts, settings)
        for r, (run, _) in enumerate(received):
            own = np.flatnonzero((origin[:, 0] == r) & repeat.any(axis=1))
            if len(own):
                numbers = decoded[r][3][origin[own, 1]].astype(np.uint32)
                yield run, numbers.tobytes(), np.packbits(repeat[own], axis=1).tobytes()

    def kernel(batches):
        part, received = None, []

        def close():
            rows = list(verdicts(received)) if received else []
            if rows:
                run, numbers, bits = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(run, pa.int64()), pa.array(numbers, pa.binary()), pa.array(bits, pa.binary())], ["run", "numbers", "bits"])

        for batch in sliced(batches, 16):
            dest, run, blob = (batch.column(i).to_pylist() for i in range(3))
            for d, r, b in zip(dest, run, blob, strict=True):
                if b is None:
                    continue
                if d != part:
                    yield from close()
                    part, received = d, []
                received.append((r, b))
        yield from close()

    assert offsets <= 1 << 10
    return kernel


def places_only(batches):
    """Kernel: the rows that say where a run's strings occur."""
    for batch in batches:
        keep = batch.column(batch.schema.get_field_index("places")).is_valid()
        some = batch.filter(keep)
        yield pa.RecordBatch.from_arrays([some.column(some.schema.get_field_index(c)) for c in ("run", "docs", "places")], ["run", "docs", "places"])


def runs_of_ones(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end) of every run of ones in the rows."""
    edge = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, begin = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    return row, begin, end


def located(where: np.ndarray, string: np.ndarray, lo: np.ndarray, hi: np.ndarray, keys: np.ndarray, block: int = 20_000):
    """Spans (string, lo, hi) at every place (string, document, offset), joined within a document,
    as rows of (k1, k2, lo, hi). Places are taken in blocks, which bounds the memory."""
    order = np.argsort(string, kind="stable")
    string, lo, hi = string[order], lo[order], hi[order]
    for at in range(0, len(where), block):
        part = where[at : at + block]
        begin, end = np.searchsorted(string, part[:, 0], "left"), np.searchsorted(string, part[:, 0], "right")
        times = end - begin
        if not times.sum():
            continue
        take = np.repeat(begin - np.cumsum(times) + times, times) + np.arange(times.sum())
        doc, offset = np.repeat(part[:, 1], times), np.repeat(part[:, 2], times)
        first, last = offset + lo[take], offset + hi[take]
        order = np.lexsort((first, doc))
        doc, first, last = doc[order], first[order], last[order]
        # join what overlaps or touches within a document
        reach = np.maximum.accumulate(last + doc * (1 << 40)) - doc * (1 << 40)
        new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (first[1:] > reach[:-1])))
        final = np.append(new[1:], len(doc)) - 1
        yield pa.RecordBatch.from_arrays([pa.array(keys[doc[new], 0]), pa.array(keys[doc[new], 1]), pa.array(first[new]), pa.array(reach[final])], ["k1", "k2", "lo", "hi"])


def _spans(settings: SubstringSettings):
    """Kernel: a run's verdicts and where its strings occur -> repeated spans of documents."""
    offsets = settings.length - settings.gram + 1
    width = -(-offsets // 8)

    def kernel(batches):
        for batch in sliced(batches, 1):
            docs, places, numbers, bits = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("docs", "places", "numbers", "bits"))
            for d, p, n, b in zip(docs, places, numbers, bits, strict=True):
                keys = np.frombuffer(d, np.int64).reshape(-1, 2)
                where = np.frombuffer(p, np.int64).reshape(-1, 3)
                number = np.frombuffer(b"".join(n), np.uint32).astype(np.int64)
                repeat = np.unpackbits(np.frombuffer(b"".join(b), np.uint8).reshape(-1, width), axis=1)[:, :offsets].astype(bool)
                # spans of a string around its anchor: runs of offsets, from the farthest left on
                row, lo, hi = runs_of_ones(repeat[:, ::-1])
                yield from located(where, number[row], lo - (offsets - 1), hi - 1 - (offsets - 1) + settings.length, keys)

    return kernel


def repeated_spans(base: DataFrame, settings: SubstringSettings) -> DataFrame:
    """(k1, spans): byte ranges (k2, lo, hi) of documents that a repeated string of ``length`` bytes covers.

    ``base`` has (k1, k2, text) and what else the caller needs; all its columns go through the join
    with the repeated anchors, so that the caller's own join on k1 finds the same exchange of the
    texts again. A string that occurs very often is one entry of each run, so its task's work grows
    with the number of runs.
    """
    tasks = max(1, int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = settings.parts * tasks
    grams, hot = repeated_anchors(base, _finder(settings), settings.hot)
    chosen = base.join(grams, "k1").sortWithinPartitions("k1", "k2")
    exchanged = chosen.mapInArrow(_runs_of(settings, parts, hot), RUN_SCHEMA).repartition(tasks, "dest")
    # both readers take all columns and sort out rows themselves: a pushed filter would split the exchange in two
    verdicts = exchanged.sortWithinPartitions("dest", "run").mapInArrow(_merged(settings), "run bigint, numbers binary, bits binary")
    return spans_by_document(exchanged, verdicts, _spans(settings))


def spans_by_document(exchanged: DataFrame, verdicts: DataFrame, kernel) -> DataFrame:
    """Verdicts of all runs, taken back to where the runs' strings occur."""
    by_run = verdicts.groupBy("run").agg(F.collect_list(F.struct("numbers", "bits")).alias("v")).select("run", F.col("v.numbers").alias("numbers"), F.col("v.bits").alias("bits"))
    places = exchanged.mapInArrow(places_only, "run bigint, docs binary, places binary")
    found = places.join(by_run, "run").select("docs", "places", "numbers", "bits").mapInArrow(kernel, "k1 bigint, k2 bigint, lo bigint, hi bigint")
    return found.groupBy("k1").agg(F.collect_set(F.struct("k2", "lo", "hi")).alias("spans"))


def cut_spans(symbols, spans: list) -> tuple:
    """What stays of bytes or of a list without the spans, how many symbols go, and in how many
    maximal runs."""
    kept, at, gone, runs, reach = symbols[:0], 0, 0, 0, -1
    pieces = []
    for lo, hi in sorted(spans):
        if lo > reach:
            runs += 1
            pieces.append(symbols[at:lo])
            gone += hi - lo
            at = reach = hi
        elif hi > reach:
            gone += hi - reach
            at = reach = hi
    pieces.append(symbols[at:])
    if isinstance(symbols, bytes):
        return b"".join(pieces), gone, runs
    for piece in pieces:
        kept += piece
    return kept, gone, runs


def _with_spans(docs: DataFrame, settings: SubstringSettings, extra: list[str]) -> DataFrame:
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra).select("*", *text_key())
    return base.join(repeated_spans(base, settings), "k1", "left")


def own_spans(k2: list, spans: list) -> list[list]:
    """Each row's spans, without those of another text whose first hash is the same."""
    return [[(x["lo"], x["hi"]) for x in s if x["k2"] == k] if s else [] for k, s in zip(k2, spans, strict=True)]


def deduplicated_digests(docs: DataFrame, settings: SubstringSettings = SubstringSettings()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of the bytes that stay, for every row.

    Null and empty texts have no bytes. Rows that repeat id and text remove each other's bytes, as do
    equal texts of any ids; nulls in other columns and columns beyond doc_id and text don't matter.
    An empty table gives no rows. Very long documents are looked at in blocks.
    """

    def kernel(batches):
        for batch in sliced(batches):
            cols = {c: batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text", "k2", "spans")}
            size, gone, runs, digest = [], [], [], []
            for t, s in zip(cols["text"].to_pylist(), own_spans(cols["k2"].to_pylist(), cols["spans"].to_pylist()), strict=True):
                raw = (t or "").encode("utf-8", "surrogatepass")
                kept, n, r = cut_spans(raw, s)
                size.append(len(raw))
                gone.append(n)
                runs.append(r)
                digest.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([cols["doc_id"], pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_spans(docs, settings, []).select("doc_id", "text", "k2", "spans").mapInArrow(kernel, DIGEST_SCHEMA)


def deduplicate(docs: DataFrame, settings: SubstringSettings = SubstringSettings()) -> DataFrame:
    """``docs`` with repeated bytes taken out of text; other columns and rows stay as they are.

    Where a span's border cuts a character, the character's remaining bytes go with it. Null texts
    stay null.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(*named(rest)).alias("_rest")) if rest else docs.select("doc_id", "text", F.lit(None).cast("string").alias("_rest"))
    joined = _with_spans(packed, settings, ["_rest"]).select("doc_id", "text", "k2", "spans", "_rest")
    schema = StructType().add("doc_id", LongType()).add("text", StringType()).add("_rest", joined.schema["_rest"].dataType)

    def kernel(batches):
        for batch in sliced(batches):
            cols = {c: batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text", "k2", "spans", "_rest")}
            out = []
            for t, s in zip(cols["text"].to_pylist(), own_spans(cols["k2"].to_pylist(), cols["spans"].to_pylist()), strict=True):
                out.append(t if t is None or not s else cut_spans(t.encode("utf-8", "surrogatepass"), s)[0].decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([cols["doc_id"], pa.array(out, pa.string()), cols["_rest"]], ["doc_id", "text", "_rest"])

    done = joined.mapInArrow(kernel, schema)
    return done.select(*(F.col(c) if c in ("doc_id", "text") else named([c], "_rest")[0] for c in docs.columns))
