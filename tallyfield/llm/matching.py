"""Substring dedup over words: matching statistics against a compressed FM-index per shard.

Stretches of words around anchors (see ``anchors``) whose k-gram occurs more than once go to the shard
of their anchor's hash. Every window of ``length`` words lies in exactly one stretch, and equal
windows lie in the same shard. Each shard indexes its stretches and streams them against the index by
backward search; windows found twice or more are reported as intervals of their documents.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.anchors import find_anchors, repeated_anchors
from tallyfield.llm.common import sliced, text_chunks, text_key
from tallyfield.llm.fmindex import FmIndex, repeated_windows
from tallyfield.llm.substrings import cut_spans, located, own_spans, places_only, runs_of_ones, spans_by_document

RUN_SCHEMA = "dest int, run bigint, strings binary, docs binary, places binary"
#: Words whose hash a Python worker remembers.
CACHE_ENTRIES = 400_000


@dataclass(frozen=True)
class MatchSettings:
    """length: words of a repeated window (at most gram + 62); gram: words of an anchor (a power of two);
    run_words: words of distinct stretches that a task sends together; shards: indexes for each
    shuffle partition, one of which is in memory at a time; hot: stretches around an anchor that occurs more
    often than this are cut into windows, so that they spread over all shards."""

    length: int = 35
    gram: int = 8
    run_words: int = 2_000_000
    shards: int = 4
    hot: int = 200_000


class WordHasher:
    """64-bit hashes of a text's words, unchanged."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def hashes(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        flat, counts, known = [], [], self.known
        for t in texts:
            words = t.split()
            counts.append(len(words))
            for w in words:
                h = known.get(w)
                if h is None:
                    if len(known) >= CACHE_ENTRIES:
                        known.clear()
                    h = known[w] = xxhash.xxh64_intdigest(w)
                flat.append(h)
        return np.array(flat, np.uint64), np.cumsum([0, *counts])


def _finder(settings: MatchSettings):
    def make():
        hasher = WordHasher()

        def find(texts):
            words, bounds = hasher.hashes(texts)
            doc, _, _, _, h = find_anchors(words, bounds, settings.gram, settings.length)
            return doc, h

        return find

    return make


def pack(words: np.ndarray, lengths: np.ndarray, counts: np.ndarray, numbers: np.ndarray) -> bytes:
    """Stretches of words as bytes: their distinct words once, then the places in that list."""
    known, code = np.unique(words, return_inverse=True)
    kind = np.uint16 if len(known) <= 1 << 16 else np.uint32
    head = np.array([len(lengths), len(known), len(words)], np.uint32)
    return b"".join([head.tobytes(), lengths.astype(np.uint16).tobytes(), counts.astype(np.uint32).tobytes(), numbers.astype(np.uint32).tobytes(), known.tobytes(), code.astype(kind).tobytes()])


def unpack(blob: bytes):
    n, m, total = np.frombuffer(blob, np.uint32, 3).tolist()
    at = 12
    lengths = np.frombuffer(blob, np.uint16, n, at).astype(np.int64)
    at += 2 * n
    counts = np.frombuffer(blob, np.uint32, n, at)
    numbers = np.frombuffer(blob, np.uint32, n, at + 4 * n)
    at += 8 * n
    known = np.frombuffer(blob[at : at + 8 * m], np.uint64)
    at += 8 * m
    code = np.frombuffer(blob[at:], np.uint16 if m <= 1 << 16 else np.uint32, total)
    return known[code], lengths, counts, numbers


def _runs_of(settings: MatchSettings, parts: int, hot: np.ndarray):
    """Kernel: texts with their repeated anchors -> distinct stretches by shard, and where they occur."""

    def kernel(batches):
        task, made = TaskContext.get().partitionId(), 0
        hasher = WordHasher()
        strings: dict[bytes, int] = {}
        shard: list[int] = []
        where: list[tuple] = []  # (number of the stretch, document, first word)
        keys: list[tuple] = []
        held = 0

        def flush():
            nonlocal made, held
            run = task << 32 | made
            made += 1
            places = np.array(where, np.int64)
            counts = np.bincount(places[:, 0], minlength=len(strings))
            every = list(strings)
            dest = np.array(shard)
            order = np.argsort(dest, kind="stable")
            edges = np.append(np.flatnonzero(np.append(True, dest[order][1:] != dest[order][:-1])), len(order))
            rows = []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                own = order[lo:hi]
                some = [every[i] for i in own.tolist()]
                lengths = np.array([len(s) // 8 for s in some])
                rows.append((int(dest[own[0]]), run, pack(np.frombuffer(b"".join(some), np.uint64), lengths, counts[own], own), None, None))
            rows.append((run % parts, run, None, np.array(keys, np.int64).tobytes(), places.tobytes()))
            for c in (strings, shard, where, keys):
                c.clear()
            held = 0
            d, r, s, k, p = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(d, pa.int32()), pa.array(r, pa.int64()), pa.array(s, pa.binary()), pa.array(k, pa.binary()), pa.array(p, pa.binary())], ["dest", "run", "strings", "docs", "places"])

        for batch in sliced(batches):
            k1, k2 = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("k1", "k2"))
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            grams = batch.column(batch.schema.get_field_index("grams"))
            for lo, hi in text_chunks(texts):
                words, bounds = hasher.hashes(texts[lo:hi])
                doc, _, first, last, h = find_anchors(words, bounds, settings.gram, settings.length)
                keep = np.zeros(len(h), bool)
                edge = np.searchsorted(doc, np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    if edge[i] < edge[i + 1]:
                        keep[edge[i] : edge[i + 1]] = np.isin(h[edge[i] : edge[i + 1]].astype(np.int64), grams[lo + i].values.to_numpy(zero_copy_only=False))
                dest = ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                common = np.isin(h.astype(np.int64), hot) if len(hot) else None
                raw, own = words.tobytes(), -1
                for j in np.flatnonzero(keep).tolist():
                    d = int(doc[j])
                    if d != own or not keys:
                        own = d
                        keys.append((k1[lo + d], k2[lo + d]))
                    a, b = int(first[j]), int(last[j]) + settings.length
                    if common is not None and common[j]:  # single windows, dealt by what they hold
                        pieces = [(x, raw[8 * x : 8 * (x + settings.length)]) for x in range(a, b - settings.length + 1)]
                        pieces = [(x, p, (xxhash.xxh64_intdigest(p) >> 32) * parts >> 32) for x, p in pieces]
                    else:
                        pieces = [(a, raw[8 * a : 8 * b], int(dest[j]))]
                    for place, string, to in pieces:
                        number = strings.setdefault(string, len(strings))
                        where.append((number, len(keys) - 1, place - int(bounds[d])))
                        if number == len(shard):
                            shard.append(to)
                            held += len(string) // 8
                    if held >= settings.run_words or len(where) >= 100_000:
                        yield flush()
        if where:
            yield flush()

    return kernel


def _searched(settings: MatchSettings):
    """Kernel: the stretches of a shard -> which windows of which stretches repeat, by run."""

    def verdicts(received):
        # equal stretches of different runs are one, that counts as often as they are together
        known: dict[bytes, int] = {}
        counts: list[int] = []
        origin = []
        for run, blob in received:
            words, lengths, own_counts, numbers = unpack(blob)
            raw, ends = words.tobytes(), np.cumsum(8 * lengths).tolist()
            ids, at = [], 0
            for end, c in zip(ends, own_counts.tolist(), strict=True):
                i = known.setdefault(raw[at:end], len(known))
                if i == len(counts):
                    counts.append(0)
                counts[i] += c
                ids.append(i)
                at = end
            origin.append((run, np.array(ids), numbers))
        words = np.frombuffer(b"".join(known), np.uint64)
        lengths = np.array([len(k) // 8 for k in known])
        known.clear()
        _, code = np.unique(words, return_inverse=True)
        code += 1
        index = FmIndex(code, lengths, np.array(counts))
        bits = repeated_windows(index, code, np.cumsum(lengths) - lengths, lengths, settings.length)
        for run, ids, numbers in origin:
            own = bits[ids]
            some = np.flatnonzero(own)
            if len(some):
                yield run, numbers[some].tobytes(), own[some].tobytes()

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

    return kernel


def _spans(settings: MatchSettings):
    """Kernel: a run's verdicts and where its stretches occur -> repeated intervals of documents, in words."""

    def kernel(batches):
        for batch in sliced(batches, 1):
            docs, places, numbers, bits = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("docs", "places", "numbers", "bits"))
            for d, p, n, b in zip(docs, places, numbers, bits, strict=True):
                keys = np.frombuffer(d, np.int64).reshape(-1, 2)
                where = np.frombuffer(p, np.int64).reshape(-1, 3)
                of = np.zeros(int(where[:, 0].max()) + 1, np.uint64)
                of[np.frombuffer(b"".join(n), np.uint32)] = np.frombuffer(b"".join(b), np.uint64)
                flags = np.unpackbits(of.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                string, lo, hi = runs_of_ones(flags)
                yield from located(where, string, lo, hi - 1 + settings.length, keys)

    return kernel


def repeated_word_spans(base: DataFrame, settings: MatchSettings) -> DataFrame:
    """(k1, spans): word intervals (k2, lo, hi) of documents that a repeated window covers.

    ``base`` has (k1, k2, text) and what else the caller needs; see ``substrings.repeated_spans``. A
    stretch that occurs very often is one entry of each run.
    """
    tasks = max(1, int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = settings.shards * tasks
    grams, hot = repeated_anchors(base, _finder(settings), settings.hot)
    chosen = base.join(grams, "k1").sortWithinPartitions("k1", "k2")
    exchanged = chosen.mapInArrow(_runs_of(settings, parts, hot), RUN_SCHEMA).repartition(tasks, "dest")
    # both readers take all columns and sort out rows themselves: a pushed filter would split the exchange in two
    verdicts = exchanged.sortWithinPartitions("dest", "run").mapInArrow(_searched(settings), "run bigint, numbers binary, bits binary")
    return spans_by_document(exchanged, verdicts, _spans(settings))


def deduplicate_words(docs: DataFrame, settings: MatchSettings = MatchSettings()) -> DataFrame:
    """doc_id, n_words, n_removed, kept text (words joined by one space) and its digest, for every row.

    Null and empty texts have no words. Rows that repeat id and text remove each other's words; nulls
    and columns beyond doc_id and text don't matter. An empty table gives no rows.
    """
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).select("*", *text_key())
    joined = base.join(repeated_word_spans(base, settings), "k1", "left").select("doc_id", "text", "k2", "spans")

    def kernel(batches):
        for batch in sliced(batches):
            cols = {c: batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text", "k2", "spans")}
            texts, spans = cols["text"].to_pylist(), own_spans(cols["k2"].to_pylist(), cols["spans"].to_pylist())
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
            for lo, hi in text_chunks(raw):
                total, gone, kept_texts, digest = [], [], [], []
                for t, s in zip(raw[lo:hi], spans[lo:hi], strict=True):
                    words = t.split()
                    kept, n, _ = cut_spans(words, s)
                    text = b" ".join(kept)
                    total.append(len(words))
                    gone.append(n)
                    kept_texts.append(text.decode("utf-8", "surrogatepass"))
                    digest.append(hashlib.sha256(text).hexdigest())
                yield pa.RecordBatch.from_arrays([cols["doc_id"].slice(lo, hi - lo), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept_texts, pa.string()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    return joined.mapInArrow(kernel, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string, kept_sha256 string")
