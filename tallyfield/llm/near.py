"""MinHash near-duplicates by a multi-index Hamming join.

A signature holds b bits of each of K minimum hashes. It is cut into chunks; two signatures that
differ in fewer places than twice the number of chunks agree, by the pigeonhole principle, in some
chunk with at most one error. Every chunk is therefore indexed once for each place that may be wrong,
with that place left out. Documents that meet in any index form candidate groups, and pairs inside a
group are confirmed on their full shingle sets.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import sliced, text_chunks, written
from tallyfield.llm.graph import connected_components, salted_join

SKETCH_SCHEMA = "doc_id bigint, n_shingles bigint, s1 bigint, s2 bigint, sig binary"
#: Words whose hash a Python worker remembers.
CACHE_ENTRIES = 400_000


@dataclass(frozen=True)
class NearSettings:
    """words: of a shingle; percent: least similarity of a link; chunks of chunk_size places of
    8 bits: pairs under 2 * chunks differing places are sure to meet; tile: documents of a block of a
    large candidate group; tile_shingles: their shingles, about; signature_tile: signatures of a block;
    max_differing: places that a pair worth confirming may differ in (a link differs in more with a
    probability under 1e-9; None: any number, so that every pair of a group whose sizes allow a link is confirmed)."""

    words: int = 4
    percent: int = 80
    chunks: int = 14
    chunk_size: int = 7
    tile: int = 256
    tile_shingles: int = 2_000_000
    signature_tile: int = 4096
    max_differing: int | None = 46

    @property
    def places(self) -> int:
        return self.chunks * self.chunk_size


_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX1
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX2
    return h ^ (h >> np.uint64(33))


class Shingler:
    """Sets of distinct shingle hashes of texts."""

    def __init__(self, words: int):
        self.words = words
        self.known: dict[bytes, int] = {}

    def sets(self, texts: list) -> list[np.ndarray]:
        """Sorted distinct hashes for each text; fewer words than a shingle's are one shingle."""
        flat, counts, known = [], [], self.known
        for t in texts:
            words = t.lower().split()  # bytes: A-Z alone change, ASCII white space alone separates
            for w in words:
                h = known.get(w)
                if h is None:
                    if len(known) >= CACHE_ENTRIES:
                        known.clear()
                    h = known[w] = xxhash.xxh64_intdigest(w)
                flat.append(h)
            counts.append(len(words))
        h = np.array(flat, np.uint64)
        out, at = [], 0
        with np.errstate(over="ignore"):
            n = max(0, len(h) - self.words + 1)
            rolled = np.zeros(n, np.uint64)
            for i in range(self.words):
                rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
            rolled = mixed(rolled)
            for c in counts:
                if c >= self.words:
                    out.append(np.unique(rolled[at : at + c - self.words + 1]))
                elif c:
                    whole = np.uint64(c)
                    for x in h[at : at + c]:
                        whole = whole * np.uint64(0xD6E8FEB86659FD93) + x
                    out.append(mixed(np.array([whole], np.uint64)))
                else:
                    out.append(np.zeros(0, np.uint64))
                at += c
        return out


def signatures(sets: list[np.ndarray], places: int) -> np.ndarray:
    """(sets, places) bytes; the sets must not be empty."""
    rng = np.random.default_rng(20_24)
    mul = rng.integers(0, 1 << 63, places, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, places, dtype=np.uint64)
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), places), np.uint8)
    with np.errstate(over="ignore"):
        for k in range(places):
            least = np.minimum.reduceat(flat * mul[k] + add[k], starts)
            out[:, k] = (mixed(least) >> np.uint64(56)).astype(np.uint8)
    return out


def sketches(docs: DataFrame, settings: NearSettings) -> DataFrame:
    """doc_id, n_shingles, 128-bit hash of the whole set and signature (null for an empty set)."""

    def kernel(batches):
        shingler = Shingler(settings.words)
        for batch in sliced(batches):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            for lo, hi in text_chunks(texts):
                sets = shingler.sets(texts[lo:hi])
                full = [i for i, s in enumerate(sets) if len(s)]
                s1, s2, sig = ([None] * len(sets) for _ in range(3))
                if full:
                    got = signatures([sets[i] for i in full], settings.places)
                    for row, i in enumerate(full):
                        digest = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                        s1[i], s2[i] = (int.from_bytes(digest[j : j + 8], "little", signed=True) for j in (0, 8))
                        sig[i] = got[row].tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "s1", "s2", "sig"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(kernel, SKETCH_SCHEMA)


def index_keys(reps: DataFrame, settings: NearSettings, errors: int) -> DataFrame:
    """(key, rep) for every chunk: the chunk itself, or with one error allowed, for every place of it
    the chunk without that place."""
    n, size = settings.chunks, settings.chunk_size

    def kernel(batches):
        for batch in sliced(batches, 1024):
            rep = batch.column(0).to_numpy(zero_copy_only=False)
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(rep), n, size).astype(np.uint64)
            ways = range(size) if errors else [size]
            keys = np.empty((len(rep), n, len(ways)), np.uint64)
            for gone in ways:
                packed = np.zeros((len(rep), n), np.uint64)
                for i in range(size):
                    if i != gone:
                        packed = packed << np.uint64(8) | sig[:, :, i]
                which = (np.arange(n) * (size + 1) + gone).astype(np.uint64) << np.uint64(56)
                keys[:, :, gone if errors else 0] = packed ^ which
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(rep, n * len(ways)))], ["key", "rep"])

    return reps.select("rep", "sig").mapInArrow(kernel, "key bigint, rep bigint")


def candidate_edges(keys: DataFrame) -> DataFrame:
    """(a, b) that connect all representatives of a key, as few as suffice within a task.

    Keys are laid out by range of (key, rep): a key with very many members is spread over several
    tasks, which connect their own; the first and last members of each task's first and last keys
    are then connected across tasks.
    """
    parts = max(1, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def kernel(batches):
        parent: dict[int, int] = {}

        def find(x):
            while parent.get(x, x) != x:
                parent[x] = parent.get(parent[x], parent[x])
                x = parent[x]
            return x

        last = first = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, rep = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if first is None:
                first = int(key[0]), int(rep[0])
            if last is not None:
                key, rep = np.append(last[0], key), np.append(last[1], rep)
            for i in np.flatnonzero(key[1:] == key[:-1]):
                a, b = find(int(rep[i])), find(int(rep[i + 1]))
                if a != b:
                    parent[max(a, b)] = min(a, b)
            last = int(key[-1]), int(rep[-1])
        nodes = list(parent)
        ends = [] if first is None else [first, last]
        rows = [(x, r, None) for x in nodes if (r := find(x)) != x] + [(r, None, k) for k, r in ends]
        if rows:
            a, b, k = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(k, pa.int64())], ["a", "b", "k"])

    found = written(keys.repartitionByRange(parts, "key", "rep").sortWithinPartitions("key", "rep").mapInArrow(kernel, "a bigint, b bigint, k bigint"), "candidates")
    across = found.where("k is not null").groupBy("k").agg(F.min("a").alias("a"), F.collect_set("a").alias("all")).select("a", F.explode("all").alias("b"))
    return found.where("k is null").select("a", "b").unionByName(across.where("a <> b"))


def candidate_groups(reps: DataFrame, settings: NearSettings) -> DataFrame:
    """(node, component) of representatives that meet, in chunks without and then with one error.

    Whole chunks come first; in the indexes with an error the groups they made stand for their
    members, which leaves little to connect there.
    """
    first = written(connected_components(candidate_edges(index_keys(reps, settings, 0))), "meetings")
    named = reps.join(first, reps.rep == first.node, "left")
    named = written(named.select("rep", "sig", F.coalesce("component", "rep").alias("group"), F.col("component").isNotNull().alias("met")), "named")
    keys = index_keys(named.select(F.col("group").alias("rep"), "sig"), settings, 1)
    second = connected_components(candidate_edges(keys)).select(F.col("node").alias("group"), "component")
    out = salted_join(named.drop("sig"), second, ["group"], "rep")
    # whoever is met by nobody is in no group
    return out.where("met or component is not null").select(F.col("rep").alias("node"), F.coalesce("component", "group").alias("component"))


def _confirm(rows: list[tuple], settings: NearSettings) -> list[tuple[int, int]]:
    """Links of a tile, as few as connect what is linked. rows: (node, label, side, set, signature);
    with two sides, pairs lie across. Equal labels are connected already. The most alike pairs come
    first; pairs that are connected by then need no look."""
    n = len(rows)
    sets = [r[3] for r in rows]
    size = np.array([len(s) for s in sets])
    side = np.array([r[2] for r in rows])
    sig = np.stack([r[4] for r in rows])
    differ = np.stack([(sig != s).sum(axis=1) for s in sig])
    i, j = np.triu_indices(n, 1)
    ok = differ[i, j] <= (settings.places if settings.max_differing is None else settings.max_differing)
    ok &= 100 * np.minimum(size[i], size[j]) >= settings.percent * np.maximum(size[i], size[j])
    if side.any() and not side.all():
        ok &= side[i] != side[j]
    i, j = i[ok], j[ok]
    order = np.argsort(differ[i, j], kind="stable")
    first: dict[int, int] = {}
    parent = [first.setdefault(r[1], k) for k, r in enumerate(rows)]

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
        a, b = find(x), find(y)
        if a != b:
            u, v = sets[x], sets[y]
            both = np.concatenate([u, v])
            both.sort(kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            if 100 * common >= settings.percent * (len(u) + len(v) - common):
                parent[a] = b
                out.append((rows[x][0], rows[y][0]))
    return out


SET_SCHEMA = "component bigint, blocks bigint, block bigint, node bigint, s1 bigint, set binary, sig binary"
TILE_COLUMNS = ("component", "i", "j", "node", "label", "side", "s1", "set", "sig")


def _member_sets(docs: DataFrame, groups: DataFrame, reps: DataFrame, settings: NearSettings) -> DataFrame:
    """The groups' members with block, shingle set and signature; a group has a block for each
    ``tile`` members, or ``tile_shingles`` shingles if that is more, dealt by a hash."""
    wanted = groups.join(reps.select(F.col("rep").alias("node"), "s1", "s2", "size"), "node")
    sizes = wanted.groupBy("component").agg(F.ceil(F.greatest(F.count(F.lit(1)) / settings.tile, F.sum("size") / settings.tile_shingles)).alias("blocks"))
    wanted = salted_join(wanted.drop("size"), sizes, ["component"], "node", "inner").withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")))
    # a representative's text: any row of its id with its set; the set is computed anew below
    texts = docs.select(F.col("doc_id").cast("bigint").alias("node"), F.col("text").cast("string").alias("text"))

    def kernel(batches):
        shingler = Shingler(settings.words)
        for batch in sliced(batches):
            cols = {c: batch.column(batch.schema.get_field_index(c)) for c in ("node", "component", "blocks", "block", "s1", "s2")}
            s1, s2 = cols["s1"].to_pylist(), cols["s2"].to_pylist()
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            for lo, hi in text_chunks(raw):
                at, sets = [], []
                for k, s in enumerate(shingler.sets(raw[lo:hi]), lo):
                    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    if len(s) and [int.from_bytes(digest[x : x + 8], "little", signed=True) for x in (0, 8)] == [s1[k], s2[k]]:
                        at.append(k)  # else another text under the same id
                        sets.append(s)
                if at:
                    sig = signatures(sets, settings.places)
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays([*(cols[c].take(take) for c in ("component", "blocks", "block", "node", "s1")), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary())], ["component", "blocks", "block", "node", "s1", "set", "sig"])

    return texts.join(wanted, "node").mapInArrow(kernel, SET_SCHEMA)


def _tile_links(tiles: DataFrame, settings: NearSettings) -> DataFrame:
    """(a, b) of the links that the tiles' pairs have; a task holds one tile at a time."""

    def kernel(batches):
        rows, key, last = [], None, None

        def close():
            found = _confirm(rows, settings) if len(rows) > 1 else []
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in sliced(batches):
            for c, i, j, node, label, side, s1, members, sig in zip(*(batch.column(k).to_pylist() for k in range(9)), strict=True):
                if (c, i, j) != key:
                    yield from close()
                    rows, key, last = [], (c, i, j), None
                if (node, side, s1) != last:  # rows that repeat an id and its text are one
                    rows.append((node, label, side, np.frombuffer(members, np.uint64), np.frombuffer(sig, np.uint8)))
                    last = node, side, s1
        yield from close()

    ordered = tiles.select(*TILE_COLUMNS).repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "node", "side", "s1")
    return ordered.mapInArrow(kernel, "a bigint, b bigint")


PAIR_COLUMNS = ("component", "i", "j", "node", "label", "side", "size", "block", "other", "sig")


def _worth_confirming(pairs: DataFrame, settings: NearSettings) -> DataFrame:
    """Rows (component, i, j, node, label, side) of the tiles of sets in which a pair of signatures is close enough.

    Tiles of ``signature_tile`` signatures come in; what goes out names only members that have a partner in
    their tile, so sets are copied for pairs that may be links, not for all of a group.
    """
    most = settings.places if settings.max_differing is None else settings.max_differing

    def close(rows):
        left, right = ([r for r in rows if r[2] == k] for k in (1, 0))
        if not left or not right:
            return
        node, label, size, block = (np.array([r[c] for r in right], np.int64) for c in (0, 1, 3, 4))
        sig = np.stack([np.frombuffer(r[6], np.uint8) for r in right])
        seen = set()
        for x in left:
            ok = (label != x[1]) & (100 * np.minimum(size, x[3]) >= settings.percent * np.maximum(size, x[3]))
            at = np.flatnonzero(ok)
            at = at[(sig[at] != np.frombuffer(x[6], np.uint8)).sum(axis=1) <= most]
            for j in np.unique(block[at]).tolist():
                seen.add((x[5], j, x[0], x[1], 1))
            seen.update(zip([x[5]] * len(at), block[at].tolist(), node[at].tolist(), label[at].tolist(), [0] * len(at), strict=True))
        yield from seen

    def kernel(batches):
        def batch_of(c, found):
            found = list(found)
            if found:
                i, j, node, label, side = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(found), pa.int64()), *(pa.array(v, pa.int64()) for v in (i, j, node, label)), pa.array(side, pa.int32())], ["component", "i", "j", "node", "label", "side"])

        rows, key = [], None
        for batch in sliced(batches, 1024):
            for c, i, j, *rest in zip(*(batch.column(k).to_pylist() for k in range(len(PAIR_COLUMNS))), strict=True):
                if (c, i, j) != key:
                    yield from batch_of(key and key[0], close(rows))
                    rows, key = [], (c, i, j)
                rows.append(rest)
        yield from batch_of(key and key[0], close(rows))

    ordered = pairs.select(*PAIR_COLUMNS).repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    return ordered.mapInArrow(kernel, "component bigint, i bigint, j bigint, node bigint, label bigint, side int")


def second_round(sets: DataFrame, near: DataFrame, settings: NearSettings) -> DataFrame:
    """Tiles for what the first round left: of groups of several blocks, whatever isn't in the group's
    largest component yet, against all members, by signature first."""
    large = sets.where("blocks > 1").select("component", "blocks", "block", "node", F.floor(F.length("set") / 8).cast("bigint").alias("size"), "sig")
    large = large.join(near.select("node", F.col("component").alias("c")), "node", "left").withColumn("label", F.coalesce("c", "node")).drop("c")
    # rows that repeat an id and its text count twice here and are one row of a tile of sets
    counts = large.groupBy("component", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("component").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    rest = F.col("all") - F.col("most")
    counts = counts.where("most < all").select("component", "main", *(F.ceil(n / t).alias(c) for c, n, t in (("rows", F.col("all"), settings.signature_tile), ("columns", rest, settings.signature_tile), ("others", rest, settings.tile))))
    large = salted_join(large, counts, ["component"], "node", "inner")
    part = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n))
    large = large.withColumn("other", part("others", 6))
    zero = F.lit(0).cast("bigint")
    as_member = large.withColumns({"i": F.explode(F.sequence(zero, F.col("columns") - 1)), "j": part("rows", 7), "side": F.lit(0)})
    as_other = large.where("label <> main").withColumns({"i": part("columns", 8), "j": F.explode(F.sequence(zero, F.col("rows") - 1)), "side": F.lit(1)})
    wanted = _worth_confirming(as_member.select(*PAIR_COLUMNS).unionByName(as_other.select(*PAIR_COLUMNS)), settings)
    return written(wanted, "pairs").join(sets.where("blocks > 1").select("node", "s1", "set", "sig"), "node").select(*TILE_COLUMNS)


def confirmed_components(docs: DataFrame, groups: DataFrame, reps: DataFrame, settings: NearSettings) -> DataFrame:
    """(node, component) of representatives with real links, from the pairs inside candidate groups.

    First every block of a group is a tile of its own and meets the group's first block, which is
    linear in the members and connects most of a large group of copies. What isn't in the group's largest
    component by then meets all members by signature, and by its set where the signatures are close: a group
    whose members have met by chance, like pages of one template, costs few sets. So every pair is looked
    at or known to be connected, and no task holds more than two blocks.
    """
    sets = written(_member_sets(docs, groups, reps, settings), "sets")
    zero = F.lit(0).cast("bigint")
    with_first = F.when(F.col("block") == 0, F.sequence(zero, F.col("blocks") - 1)).otherwise(F.array(zero, F.col("block")))
    # tile (i, j): block j meets block i, which is 0 or j itself
    pairs = F.when(F.col("block") == 0, F.transform(with_first, lambda j: F.struct(zero.alias("i"), j.alias("j"), F.lit(0).alias("side")))).otherwise(
        F.array(F.struct(F.col("block").alias("i"), F.col("block").alias("j"), F.lit(0).alias("side")), F.struct(zero.alias("i"), F.col("block").alias("j"), F.lit(1).alias("side")))
    )
    tiles = sets.withColumn("t", F.explode(pairs)).withColumns({"i": F.col("t.i"), "j": F.col("t.j"), "side": F.col("t.side"), "label": F.col("node")})
    near = written(connected_components(_tile_links(tiles, settings)), "near")
    more = _tile_links(second_round(sets, near, settings), settings)
    return connected_components(near.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))


def near_duplicates(docs: DataFrame, settings: NearSettings = NearSettings()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text).

    Texts with the same shingle set are one representative, the smallest id, before anything is
    joined. Null and empty texts, and rows without an id, are linked with nothing; a row without an
    id has a null component and is kept. Rows that repeat id and text get the same result. Other columns are
    ignored; an empty table gives no rows. Rows that repeat an id with different texts share the class of the id: what
    is linked with any of its texts.
    """
    table = written(sketches(docs, settings), "sketches")
    usable = table.where("doc_id is not null and s1 is not null")
    reps = written(usable.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.max("n_shingles").alias("size"), F.max("sig").alias("sig")), "representatives")
    groups = written(candidate_groups(reps, settings), "groups")
    classes = confirmed_components(docs, groups, reps, settings)
    # classes that change a document's component: several documents, or a link to a smaller id
    named = reps.select("s1", "s2", "rep", "n").join(classes, reps.rep == classes.node, "left").select("s1", "s2", F.coalesce("component", "rep").alias("component"), "rep", "n")
    named = named.where("n > 1 or component <> rep").select("s1", "s2", "component")
    joined = salted_join(table.drop("sig"), named, ["s1", "s2"], "doc_id")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
