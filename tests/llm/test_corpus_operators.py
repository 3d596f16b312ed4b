"""Deduplication, mixing and search over tables, against plain definitions."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.llm import anchors, fmindex, matching, mixing, near, substrings, topk
from tallyfield.llm.graph import connected_components
from tests.llm.conftest import odd_texts, passage

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in df.collect())


# --- repeated bytes and words


def plain_spans(sequences, length):
    """For each sequence the covered places, windows of all sequences counted together."""
    n = collections.Counter(s[i : i + length] for s in sequences for i in range(len(s) - length + 1))
    out = []
    for s in sequences:
        covered = bytearray(len(s))
        for i in range(len(s) - length + 1):
            if n[s[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        out.append(covered)
    return out


def plain_bytes(texts, length):
    raw = [(t or "").encode() for _, t in texts]
    out = collections.Counter()
    for (i, _), t, c in zip(texts, raw, plain_spans(raw, length), strict=True):
        kept = bytes(x for x, m in zip(t, c, strict=True) if not m)
        runs = sum(1 for j in range(len(c)) if c[j] and (j == 0 or not c[j - 1]))
        out[(i, len(t), sum(c), runs, hashlib.sha256(kept).hexdigest())] += 1
    return out


def plain_words(texts, length):
    seqs = [tuple(WORDS.findall(t or "")) for _, t in texts]
    out = collections.Counter()
    for (i, _), w, c in zip(texts, seqs, plain_spans(seqs, length), strict=True):
        kept = " ".join(x for x, m in zip(w, c, strict=True) if not m)
        out[(i, len(w), sum(c), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


BYTE_COLUMNS, WORD_COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), ("doc_id", "n_words", "n_removed", "kept_sha256")


def test_bytes_of_odd_texts(odd, nothing):
    assert rows(substrings.deduplicated_digests(odd), *BYTE_COLUMNS) == plain_bytes(odd_texts(), 200)
    assert substrings.deduplicated_digests(nothing).count() == 0


def test_words_of_odd_texts(odd, nothing):
    assert rows(matching.deduplicate_words(odd), *WORD_COLUMNS) == plain_words(odd_texts(), 35)
    assert matching.deduplicate_words(nothing).count() == 0


def edited(rng, base, alphabet):
    t = list(base)
    for _ in range(rng.randint(0, 6)):
        t[rng.randrange(len(t))] = rng.choice(alphabet)
    a = rng.randrange(len(t) // 2)
    return t[a : a + rng.randint(len(t) // 3, len(t))]


def test_many_edited_copies_of_bytes(spark):
    """Windows that differ on both sides of an anchor, and windows across several anchors."""
    rng = random.Random(5)
    texts = []
    for g in range(4):
        base = [rng.choice("abcd ") for _ in range(900)]
        texts += [(100 * g + k, "".join(edited(rng, base, "abcdé"))) for k in range(30)]
    texts += [(900 + k, "ab" * rng.randint(50, 400)) for k in range(3)] + [(950, "z" * 500)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(5)
    want = plain_bytes(texts, 200)
    assert rows(substrings.deduplicated_digests(df), *BYTE_COLUMNS) == want
    # common anchors window by window; and runs of few strings
    small = substrings.SubstringSettings(hot=12, run_bytes=20_000)
    assert rows(substrings.deduplicated_digests(df, small), *BYTE_COLUMNS) == want


def test_many_edited_copies_of_words(spark):
    rng = random.Random(6)
    texts = []
    for g in range(4):
        base = passage(100 + g, 250).split()
        texts += [(100 * g + k, " ".join(edited(rng, base, ["new", "other"]))) for k in range(30)]
    texts += [(900 + k, "do re mi " * rng.randint(10, 60)) for k in range(3)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(5)
    want = plain_words(texts, 35)
    assert rows(matching.deduplicate_words(df), *WORD_COLUMNS) == want
    small = matching.MatchSettings(hot=12, run_words=5_000)
    assert rows(matching.deduplicate_words(df, small), *WORD_COLUMNS) == want


def test_deduplicated_table_keeps_its_columns(odd):
    out = substrings.deduplicate(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert {r.text for r in out.where("doc_id = 1").collect()} == {None}
    assert out.where("doc_id = 8").first().text == ""
    assert out.where("doc_id = 4").first().k1 == "x"


def test_runs_front_code_and_merge():
    rng = random.Random(7)
    for _ in range(100):
        runs = []
        for _ in range(rng.randint(1, 6)):
            s = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 9))})
            back = substrings.front_decode(substrings.front_code(s, [1] * len(s), list(range(len(s)))))
            assert back[0] == s
            runs.append((s, back[1]))
        got = list(substrings.merge_runs(runs))
        merged = [runs[r][0][i] for r, i, _ in got]
        assert merged == sorted(x for s, _ in runs for x in s)
        assert [h for _, _, h in got][1:] == [substrings.common_prefix(a, b, 0) for a, b in zip(merged, merged[1:], strict=False)]


def test_anchors_cover_every_window_once(monkeypatch):
    rng = np.random.default_rng(8)
    symbols = rng.integers(0, 1 << 62, 3000, dtype=np.uint64)
    bounds = np.array([0, 10, 700, 700, 3000])
    want = [(d, s) for d in range(4) for s in range(bounds[d], bounds[d + 1] - 35 + 1)]
    for block in (1 << 19, 257):
        monkeypatch.setattr(anchors, "BLOCK", block)
        doc, at, first, last, _ = anchors.find_anchors(symbols, bounds, 8, 35)
        assert sorted((int(d), s) for d, a, b in zip(doc, first, last, strict=True) for s in range(a, b + 1)) == want
        assert all(b <= a <= f + 27 for f, a, b in zip(first, at, last, strict=True))


def test_anchors_do_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(15)
    symbols = rng.integers(0, 1 << 62, 3000, dtype=np.uint64)
    bounds = np.array([0, 10, 700, 700, 3000])
    want = anchors.find_anchors(symbols, bounds, 8, 35)
    for block in (5, 64, 257):
        monkeypatch.setattr(anchors, "BLOCK", block)
        for a, b in zip(anchors.find_anchors(symbols, bounds, 8, 35), want, strict=True):
            assert a.tolist() == b.tolist()


def test_bytes_of_a_text_longer_than_a_block(spark):
    rng = random.Random(16)
    long, shared = rng.randbytes(300_000).hex(), passage(17)
    assert len(long) > anchors.BLOCK + 200
    texts = [(1, long[:1000] + shared + long[1000:]), (2, passage(18) + shared)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    assert rows(substrings.deduplicated_digests(df), *BYTE_COLUMNS) == plain_bytes(texts, 200)


def test_index_counts_against_plain_counts():
    rng = random.Random(9)
    for _ in range(150):
        width, v = rng.randint(1, 5), rng.randint(1, 6)
        seqs = [[rng.randint(1, v) for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(1, 8))]
        times = np.array([rng.randint(1, 2) for _ in seqs])
        flat, lengths = np.array([x for s in seqs for x in s]), np.array([len(s) for s in seqs])
        begins = np.cumsum(lengths) - lengths
        got = fmindex.repeated_windows(fmindex.FmIndex(flat, lengths, times), flat, begins, lengths, width)
        n = collections.Counter()
        for s, k in zip(seqs, times.tolist(), strict=True):
            for i in range(len(s) - width + 1):
                n[tuple(s[i : i + width])] += k
        assert got.tolist() == [sum(1 << i for i in range(len(s) - width + 1) if n[tuple(s[i : i + width])] > 1) for s in seqs]


# --- near-duplicates


def shingles(text, n=4):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def plain_near(texts, n=4):
    sets = [shingles(t, n) for _, t in texts]
    parent = {i: i for i, _ in texts if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            i, j = texts[a][0], texts[b][0]
            if i is not None and j is not None and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = find(i), find(j)
                    parent[max(x, y)] = min(x, y)
    out = collections.Counter()
    for (i, _), s in zip(texts, sets, strict=True):
        c = None if i is None else find(i)
        out[(i, len(s), c, c is None or c == i)] += 1
    return out


NEAR_COLUMNS = ("doc_id", "n_shingles", "component_id", "kept")


def test_near_duplicates_of_odd_texts(odd, nothing):
    assert rows(near.near_duplicates(odd), *NEAR_COLUMNS) == plain_near(odd_texts())
    assert near.near_duplicates(nothing).count() == 0


def test_near_duplicates_of_edited_copies(spark):
    """Copies at all distances around the threshold, chains among them, in one large group."""
    rng = random.Random(10)
    texts = []
    for g in range(3):
        base = passage(200 + g, 150).split()
        for k in range(110):
            t = base.copy()
            for _ in range(rng.randint(0, 12)):
                t[rng.randrange(len(t))] = f"w{rng.randrange(10**6)}"
            texts.append((1000 * g + k, " ".join(t)))
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4)
    small = near.NearSettings(tile=16)  # many tiles
    assert rows(near.near_duplicates(df, small), *NEAR_COLUMNS) == plain_near(texts)
    assert rows(near.near_duplicates(df), *NEAR_COLUMNS) == plain_near(texts)


def test_pages_of_one_template_cost_few_sets(spark):
    """Alike by 0.38: they meet, but none is linked; what the second round copies doesn't grow with the square."""
    template = passage(77, 150)
    settings = near.NearSettings(tile=32)
    copied = []
    for n in (150, 600):
        texts = [(i, template + " " + passage(9000 + i, 120)) for i in range(n)] + [(n, template + " " + passage(9000, 120) + " more")]
        df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4)
        table = near.sketches(df, settings)
        reps = table.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.max("n_shingles").alias("size"), F.max("sig").alias("sig"))
        groups = near.candidate_groups(reps, settings)
        assert groups.groupBy("component").count().agg(F.max("count")).first()[0] > n / 2
        sets = near._member_sets(df, groups, reps, settings)
        copied.append(near.second_round(sets, spark.createDataFrame([], "node bigint, component bigint"), settings).count())
        got = {r.doc_id: r.component_id for r in near.near_duplicates(df, settings).collect()}
        assert got == {i: 0 if i == n else i for i in range(n + 1)}
    assert copied[1] < n / 2


def test_every_pair_is_confirmed_without_a_bound(spark):
    base = passage(60, 150).split()
    rng = random.Random(61)
    texts = [(i, " ".join(w if rng.random() > 0.004 * (i % 12) else f"n{rng.random()}" for w in base)) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    assert rows(near.near_duplicates(df, near.NearSettings(tile=8, max_differing=None)), *NEAR_COLUMNS) == plain_near(texts)


def test_signatures_under_the_distance_meet():
    """Any two signatures that differ in fewer than twice the chunks share an index key."""
    s = near.NearSettings()
    rng = np.random.default_rng(11)
    for _ in range(200):
        a = rng.integers(0, 256, s.places)
        b = a.copy()
        for p in rng.choice(s.places, 2 * s.chunks - 1, replace=False):
            b[p] ^= 1
        same = (a == b).reshape(s.chunks, s.chunk_size).sum(axis=1)
        assert same.max() >= s.chunk_size - 1


def test_components(spark):
    rng = random.Random(12)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


# --- mixing


def schedule_of(spark, weights, turns):
    """Slot of every quantum that any source has within ``turns`` turns, by source."""
    whole = mixing.whole_weights(weights)
    rows = spark.createDataFrame(list(whole.items()), "source string, k bigint")
    paths = mixing.source_paths(rows)
    most = F.ceil(F.col("k") * F.lit(turns + 0.0) / F.col("total")).cast("bigint") + 2
    out = paths.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), most))).select("source", "j", mixing.turn(F.col("path"), F.col("j")).alias("slot")).where(F.col("slot") < turns)
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    out = out.toPandas()
    spark.conf.unset("spark.sql.execution.arrow.pyspark.enabled")
    total = sum(whole.values())
    return out, {s: k / total for s, k in whole.items()}


SKEWED = {
    "even": {"a": 1, "b": 1}, "few": {"a": 1, "b": 2, "c": 7}, "only": {"a": 3}, "one of many": {"x": 997, "y": 1, "z": 2}, "irrational": {"a": 2**0.5, "b": 1, "c": 0.01},
    "forty": {f"s{i}": (i % 7) + 1 for i in range(40)}, "fibonacci": {f"s{i}": w for i, w in enumerate((1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144))}, "powers": {f"s{i}": 2.0**-i for i in range(30)},
    "hot and 5,000": {"hot": 0.5} | {f"s{i}": 0.0001 for i in range(5000)}, "uneven 5,000": {f"s{i}": (1 + i % 97) ** 0.5 for i in range(5000)} | {"hot": 9000.0},
}


@pytest.mark.parametrize("name", sorted(SKEWED))
def test_schedule_stays_within_a_block(spark, name):
    """Two quanta are a block; the deviation is from the given weights, over all turns."""
    turns = 1_000_000 if name in ("irrational", "hot and 5,000") else 30_000
    out, share = schedule_of(spark, SKEWED[name], turns)
    assert np.array_equal(np.sort(out.slot.to_numpy()), np.arange(turns))  # every turn is one quantum's
    w = out.source.map(share).to_numpy()
    j, slot = out.j.to_numpy(), out.slot.to_numpy()
    # a source is furthest behind just before a quantum's turn and furthest ahead just after it
    assert (slot * w - j).max() < 1.75 and ((j + 1) - (slot + 1) * w).max() < 1.75
    assert (np.floor((j - 1) / w) <= slot).all() and (slot < np.ceil((j + 2) / w)).all()


def test_weights_become_whole_numbers():
    assert mixing.whole_weights({"a": 0.3, "b": 0.7, "c": 2}) == {"a": 3, "b": 7, "c": 20}
    w = mixing.whole_weights({f"s{i}": 1000 * (i + 1) ** 0.5 for i in range(50)})
    assert max(w.values()) <= 1 << mixing.GIVEN_BITS and all(abs(w[f"s{i}"] / w["s49"] - ((i + 1) / 50) ** 0.5) < 1e-12 for i in range(50))
    for bad in ({}, {"a": 0}, {"a": -1.0}):
        with pytest.raises(ValueError):
            mixing.whole_weights(bad)
    with pytest.raises(ValueError):
        mixing.MixSettings(block=3)


def test_mix_gives_every_row_one_place(odd, nothing):
    out = mixing.with_schedule(odd, settings=mixing.MixSettings(block=2)).collect()
    assert len(out) == len(odd_texts()) and len({r.mix_position for r in out}) == len(out)
    by = collections.defaultdict(list)
    for r in out:
        assert r.mix_release <= r.mix_slot < r.mix_deadline and r.mix_block == r.mix_index // 2
        by[r.source].append(r)
    for rs in by.values():
        rs.sort(key=lambda r: r.mix_position)
        assert [r.mix_index for r in rs] == list(range(len(rs)))
    assert mixing.with_schedule(nothing).count() == 0
    assert rows(mixing.mixed_order(odd), *odd.columns) == rows(odd, *odd.columns) and mixing.mixed_order(odd).columns == odd.columns
    with pytest.raises(Exception, match="no weight for source"):
        mixing.with_schedule(odd, {"s1": 1.0, "s3": 2.0}).collect()


def test_weights_may_be_a_table_and_rows_without_ids_are_spread(spark):
    df = spark.createDataFrame([(None, f"text {i}", "a" if i % 4 else None) for i in range(400)], "doc_id bigint, text string, source string")
    table = spark.createDataFrame([("a", 1.0), (None, 2.0), ("empty", 1.0)], "source string, weight double")
    out = mixing.with_schedule(df, table).orderBy("mix_position").collect()
    assert len({r.mix_position for r in out}) == 400 and sorted(r.text for r in out) == sorted(f"text {i}" for i in range(400))
    for r in out:
        share = 0.25 if r.source == "a" else 0.5
        assert (r.mix_index // 8 - 1) / share - 1 <= r.mix_slot < (r.mix_index // 8 + 2) / share + 1
    assert [r.mix_position for r in mixing.with_schedule(df.repartition(7), {"a": 1, None: 2, "empty": 1}).orderBy("mix_position").collect()] == [r.mix_position for r in out]


def test_mixed_order_follows_the_schedule(spark):
    df = spark.createDataFrame([(i, "t", "a" if i % 4 else "b") for i in range(400)], "doc_id bigint, text string, source string")
    out = [r.source for r in mixing.mixed_order(df, {"a": 1, "b": 1}, mixing.MixSettings(block=4)).collect()]
    for n in range(8, 200, 8):
        assert abs(out[:n].count("b") - n / 2) <= 4


# --- search


def plain_search(vectors, ids, k=10):
    out = []
    good = [(i, np.floor(np.array(v, float) * 1024).astype(int)) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, x in good:
        if q in ids:
            scored = sorted((-int(x @ y), v) for v, y in good if v != q and len(y) == len(x))[:k]
            out += [(q, n + 1, v, -s) for n, (s, v) in enumerate(scored)]
    return collections.Counter(out)


def test_search_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(13)
    vectors = [(i, [float(x) for x in np.round(rng.normal(size=19), 1)]) for i in range(300)]
    vectors += [(1000 + i, vectors[i][1]) for i in range(40)] + [(2000, None), (2001, [None] * 19), (2002, [float("nan")] * 19), (2003, [float("inf")] * 19), (None, [0.0] * 19)]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").repartition(4).withColumn("score", F.lit("clash"))
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors]
    settings = topk.SearchSettings(query_block=3, vector_block=50)
    got = rows(topk.top_k_search(df, F.col("vec_id") % 100 == 0, settings), "query_id", "rank", "vec_id", "score")
    assert got == plain_search(as_float, {i for i, _ in vectors if i is not None and i % 100 == 0})
    few = topk.top_k_search(df.where("vec_id < 4"), F.col("vec_id") == 0)
    assert few.count() == 3 and topk.top_k_search(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(14)
    q, v = rng.normal(size=(20, 30)), rng.normal(size=(50, 30))
    for level in (1, 4, 16):
        (qm, qd), (vm, vd) = topk.segment_statistics(q, level), topk.segment_statistics(v, level)
        assert (qm @ vm.T + qd @ vd.T + 1e-9 >= q @ v.T).all()


def test_ties_below_zero_go_to_the_smaller_id():
    s = topk.SearchSettings(k=1)
    block = lambda i, x: topk.Block(np.array([i]), np.array([[x]]), s.levels)
    state = topk.TopK(block(1, 1000), s)
    for i in (5, 3, 4):
        state.offer(block(i, -1000))
    assert list(state.rows()) == [(1, 3, -1_000_000)]


def test_repeated_queries_are_ranked_together(spark):
    vectors = [(0, [1.0, 0.0]), (0, [1.0, 0.0])] + [(i, [float(i), 1.0]) for i in range(1, 20)]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>")
    out = topk.top_k_search(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in out] == [19, 19, 18, 18, 17, 17, 16, 16, 15, 15]


@pytest.mark.parametrize("size", [1 << 20, 300_000 << 10, 1 << 34])
def test_scores_of_any_size_are_exact(size):
    """Sums below 2**53, below 2**63, and with parts beyond."""
    rng = np.random.default_rng(20)
    x = rng.integers(-size, size, (400, 24))
    x[200:] = x[:200] + rng.integers(-1, 2, (200, 24))  # scores that differ in their last digits
    if size > 1 << 30:
        x[:, 12:] = -x[:, :12]  # products of either sign, so that the sums are small again
        x[:, 0] += rng.integers(0, 5, 400)
    s = topk.SearchSettings(k=10)
    state = topk.TopK(topk.Block(np.arange(8), x[:8], s.levels), s)
    for lo in range(0, 400, 64):
        state.offer(topk.Block(np.arange(lo, min(400, lo + 64)), x[lo : lo + 64], s.levels))
    big = [[int(v) for v in r] for r in x]
    want = [(q, v, -a) for q in range(8) for a, v in sorted((-sum(i * j for i, j in zip(big[q], big[v], strict=True)), v) for v in range(400) if v != q)[:10]]
    assert list(state.rows()) == want


def test_levels_look_at_survivors_only():
    """Vectors around a few centres: each level rules out pairs that the coarser ones left, and few are scored."""
    rng = np.random.default_rng(21)
    centres = np.repeat(rng.integers(-500, 500, (40, 16)), 4, axis=1)  # constant within a sixteenth
    x = centres[rng.integers(0, 40, 4000)] + rng.integers(-20, 20, (4000, 64))
    s = topk.SearchSettings()
    state = topk.TopK(topk.Block(np.arange(100), x[:100], s.levels), s)
    for lo in range(0, 4000, 500):
        state.offer(topk.Block(np.arange(lo, lo + 500), x[lo : lo + 500], s.levels))
    pairs = 100 * 4000 - 100
    assert sum(state.removed) + state.scored == pairs and min(state.removed) > 0.05 * pairs and state.scored < 0.1 * pairs
    score = x[:100] @ x.T
    for q, v, got in state.rows():
        assert got == score[q, v]
    best = np.sort(np.where(np.arange(100)[:, None] == np.arange(4000), -(1 << 60), score), axis=1)[:, -10:]
    assert sorted(got for _, _, got in state.rows()) == sorted(best.ravel().tolist())
