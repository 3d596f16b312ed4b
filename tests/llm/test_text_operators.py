"""Language ID, chat formatting, BPE, licenses and quality against plain definitions."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tallyfield.llm import bpe, chat, language, licenses, quality, suffixes
from tests.llm.conftest import odd_texts

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def by_row(df, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in df.collect())


# --- language ID


def test_language_on_held_out_rows(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = language.predict_language(docs, language.train_language_model(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_texts(odd, nothing, spark, data):
    model = language.train_language_model(spark.read.parquet(f"{data}/documents.parquet"), language.CnnSettings(steps=40))
    rows = language.predict_language(odd, model).collect()
    assert len(rows) == len(odd_texts())
    und = collections.Counter(r.doc_id for r in rows if r.lang_pred == "und")
    assert und == collections.Counter({1: 1, 2: 1, 3: 1, 6: 1, None: 1})
    assert language.predict_language(nothing, model).count() == 0
    assert language.train_language_model(nothing) is None
    assert {r.lang_pred for r in language.predict_language(odd, None).collect()} == {"und"}
    kept = language.keep_determined(odd, model, 0.0)
    assert kept.columns == odd.columns and kept.count() == len(rows) - 5


def test_windows_cover_every_byte():
    for n in (0, 1, 255, 256, 257, 1000):
        t = bytes(random.Random(n).randrange(1, 256) for _ in range(n))
        w = language.windows_of(t, 256)
        assert w.shape[1] == 256 and set(t) <= set(w.ravel().tolist())
        if n >= 256:
            starts = np.minimum(np.arange(len(w)) * 256, n - 256)
            assert all(w[i].tobytes() == t[s : s + 256] for i, s in enumerate(starts))


def plain_network(model, window):
    """Class probabilities of one window, a loop at a time: every filter at every place, its best, softmax."""
    s, p = model.settings, model.p
    pooled = []
    for k, width in enumerate(s.widths):
        for f in range(s.filters):
            column = k * s.filters + f
            best = -np.inf
            for at in range(len(window) - max(s.widths) + 1):
                total = 0.0
                for i in range(width):
                    for d in range(s.embedding):
                        total += float(p["emb"][window[at + i], d]) * float(p["conv"][i * s.embedding + d, column])
                best = max(best, total)
            pooled.append(max(0.0, best + float(p["bias"][column])))
    z = [sum(pooled[f] * float(p["out"][f, c]) for f in range(len(pooled))) + float(p["base"][c]) for c in range(len(model.labels))]
    e = [np.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def small_network():
    s = language.CnnSettings(window=24, filters=3, embedding=4, steps=40, batch=8)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(97, 107, (30, 24)), rng.integers(103, 113, (30, 24)), rng.integers(97, 113, (30, 24))]).astype(np.uint8)
    model = language.ByteCnn(["a", "b", "c"], s)
    model.train(x, np.repeat([0, 1, 2], 30))
    return model, x


def test_network_against_loops(spark):
    """The vectorised pass, and with it the whole prediction of a text: mean over its windows, best label."""
    model, x = small_network()
    got = model.probabilities(x[::9])
    assert np.allclose(got, [plain_network(model, w) for w in x[::9]], atol=1e-5)
    rng = random.Random(6)
    texts = [(i, "".join(rng.choice("abcdefghijklmnop ") for _ in range(rng.randint(1, 90)))) for i in range(25)] + [(90, None), (91, "12 34"), (92, ""), (90, "hij")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    out = {}
    for i, t in texts:
        if t is None or not any(c.isalpha() for c in t):
            want = ("und", 0.0)
        else:
            b = t.encode()
            n = -(-max(len(b), 1) // 24)
            starts = [min(k * 24, max(0, len(b) - 24)) for k in range(n)]
            mean = np.mean([plain_network(model, (b[a : a + 24] + bytes(24))[:24]) for a in starts], axis=0)
            want = (model.labels[int(mean.argmax())], float(mean.max()))
        out.setdefault(i, []).append((zlib.crc32(str(i).encode()) % 3 == 1, *want))
    for r in language.predict_language(df, model).collect():
        assert any(r.held_out == h and r.lang_pred == k and abs(r.score - s) < 1e-5 for h, k, s in out[r.doc_id]), r


def test_training_step_follows_the_loss():
    """The first step moves every parameter by the rate, against the sign of a numeric gradient of the batch's loss."""
    s = language.CnnSettings(window=16, filters=2, embedding=3, steps=1, batch=6, rate=1e-3)
    rng = np.random.default_rng(9)
    x = rng.integers(97, 105, (12, 16)).astype(np.uint8)
    y = np.repeat([0, 1], 6)
    model, start = language.ByteCnn(["a", "b"], s), language.ByteCnn(["a", "b"], s)
    model.train(x, y)
    draw = np.random.default_rng(s.seed + 1)
    by = [np.flatnonzero(y == k) for k in range(2)]
    pick = np.array([draw.choice(by[k]) for k in draw.integers(0, 2, s.batch)])
    for k in start.p:
        start.p[k] = start.p[k].astype(np.float64)
    loss = lambda: -np.log(start.probabilities(x[pick])[np.arange(s.batch), y[pick]]).mean()
    looked = 0
    for k, v in start.p.items():
        for at in np.ndindex(*v.shape):
            kept = v[at]
            v[at] = kept + 1e-6
            up = loss()
            v[at] = kept - 1e-6
            slope = (up - loss()) / 2e-6
            v[at] = kept
            if abs(slope) > 1e-4 and (k != "conv" or start.mask[at]):
                looked += 1
                assert model.p[k][at] - kept == pytest.approx(-1e-3 * np.sign(slope), abs=2e-5), (k, at)
    assert looked > 30


def test_network_gradient():
    """Training lowers the loss on two separable languages."""
    s = language.CnnSettings(steps=60, window=32, batch=16)
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(97, 105, (40, 32)), rng.integers(105, 113, (40, 32))]).astype(np.uint8)
    y = np.repeat([0, 1], 40)
    m = language.ByteCnn(["a", "b"], s)
    m.train(x, y)
    assert (m.probabilities(x).argmax(axis=1) == y).mean() > 0.95


# --- chat


CONV = "conv_id bigint, turn bigint, role string, text string, n_turns string"


def conversations(spark):
    own = "</s>[INST] ok [/INST]"
    rows = [
        (1, 0, "system", "be [ROLE]kind[/ROLE] \\ <s>", "x"), (1, 1, "user", own, "x"), (1, 2, "assistant", "<\\s> <\\\\s> [\\INST]", "x"), (1, 3, "assistant", "", "x"),
        (2, 1, "assistant", "second", "x"), (2, 0, "assistant", "first é\U0001f600", "x"), (2, 0, "assistant", "first é\U0001f600", "x"),
        (3, None, "user", None, "x"), (3, 0, None, "role is null", "x"), (None, 0, "user", "no id", "x"), (4, 0, "tool", "<s" + "s>" * 3, "x"), (5, 0, "assistant", "w " * 50_000, "x"),
    ]
    return rows, spark.createDataFrame(rows, CONV).repartition(3)


def expected_digests(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((-1 if r[1] is None else r[1]), r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        loss = "".join(t for _, role, t in turns if role == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_reads_back_what_it_wrote(spark):
    rows, df = conversations(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.conversation_digests(df, path, public_tokenizers.PATTERN).collect()}
    assert got == expected_digests(rows)
    full = {r.conv_id: r for r in chat.format_conversations(df, path, public_tokenizers.PATTERN).collect()}
    sizes = {r.conv_id: r.formatted_chars for r in chat.conversation_digests(df, path, public_tokenizers.PATTERN).collect()}
    make = chat.TurnAssembler(open(path, "rb").read(), public_tokenizers.PATTERN)
    for conv, r in full.items():
        assert len(r.formatted) == sizes[conv] and len(r.ids) == len(r.loss_mask)
        turns, chars = make.read(np.array(r.ids), np.array(r.loss_mask))
        assert chars == len(r.formatted) and len(turns) == got[conv][0]
    assert chat.conversation_digests(df.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_escaping_is_reversible_and_leaves_no_control():
    rng = random.Random(1)
    pieces = ["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "ROLE]", "/ROLE]", "x", "<s>", "</s>", "[INST]"]
    for _ in range(3000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROLS)


# --- BPE


def test_bpe_equals_the_library(spark, odd, nothing):
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    lib.no_truncation()
    lib.no_padding()
    own = bpe.WordBpe(open(path, "rb").read())
    rng = random.Random(2)
    texts = [t or "" for _, t in odd_texts()] + ["".join(rng.choice("abcdeinorst'sEÉ!1 .Σ") for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    got = by_row(bpe.encoding_digests(odd, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = collections.Counter()
    for i, t in odd_texts():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert got == want == by_row(bpe.encode_documents(odd, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert bpe.encoding_digests(nothing, path).count() == 0


def test_caches_keep_what_is_asked_for():
    c = bpe.Remembered(8, 5)
    for i in range(20):
        c.keep(f"k{i}", i + 1)
        assert len(c) <= 4 and len(c.older) <= 4
        assert (c.get("k0") or c.recall("k0")) == 1  # asked for at every step
    c.keep("far too long", 1)
    assert c.get("far too long") is None and c.recall("k1") is None
    c.clear()
    assert not c and c.recall("k19") is None


# --- licenses


def plain_scan(text, rules):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    joined = " " + "".join(w + " " for w in words)
    starts, base = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                starts.append(i)
                base.add(label)
    found = []
    for r in rules:
        if all(f" {k} " in joined for k in r["kw"].split()):
            for m in re.finditer(r["re"], joined):
                a = joined.count(" ", 0, m.start())
                found.append((r["label"], r["prio"], a, a + m[0].count(" ")))
    found = sorted(set(found))
    left = [d for d in found if not any(e[2] <= d[2] and e[3] >= d[3] and e[1] <= d[1] and (e[3] - e[2] > d[3] - d[2] or (e[3] - e[2] == d[3] - d[2] and e[1] < d[1])) for e in found)]
    score = max([licenses.WORTH[d[1]] for d in left] + [licenses.BASE_WORTH if base else 0.0])
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {d[0] for d in left})), score)


def spellings(parsed):
    """Texts that a rule's pattern accepts; of a class of characters the first, of repeats the fewest and one more."""
    out = [""]
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            ways = [chr(arg)]
        elif op == "IN":
            ways = [chr(arg[0][1][0] if str(arg[0][0]) == "RANGE" else arg[0][1])]
        elif op == "SUBPATTERN":
            ways = spellings(arg[3])
        elif op == "BRANCH":
            ways = [w for branch in arg[1] for w in spellings(branch)]
        elif op == "MAX_REPEAT":
            ways = [w * n for n in sorted({arg[0], min(arg[0] + 1, arg[1])}) for w in spellings(arg[2])]
        else:
            assert op == "ASSERT", op
            ways = [""]
        out = [o + w for o in out for w in ways]
    return out


def test_gates_pass_every_spelling():
    for r in licenses.signature_rules():
        texts = spellings(re._parser.parse(r["re"]))
        assert texts and all(re.fullmatch(r["re"][: -len("(?= )")], t) for t in texts)
        assert all(f" {k} " in f"{t} " for t in texts for k in r["kw"].split()), r


def test_restricted_attributions_of_any_spelling(spark):
    texts = {"Attribution-Non-Commercial 4.0": "cc-by-nc-4.0", "Attribution-Share-Alike 3.0": "cc-by-sa-3.0", "Attribution-NoDerivs 2.0": "cc-by-nd-2.0", "Attribution-No-Derivatives": "cc-by-nd", "Attribution-NonCommercial": "cc-by-nc"}
    df = spark.createDataFrame([(i, f"Creative Commons {t}") for i, t in enumerate(texts)], "doc_id bigint, text string")
    assert {r.doc_id: r.labels for r in licenses.scan_licenses(df).collect()} == dict(enumerate(texts.values()))


def test_licenses_against_a_plain_scan(spark, odd, nothing, data):
    rules = licenses.signature_rules()
    assert len(rules) > 200
    columns = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert by_row(licenses.scan_licenses(odd), *columns) == collections.Counter((i, *plain_scan(t, rules)) for i, t in odd_texts())
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert by_row(licenses.scan_licenses(docs), *columns) == collections.Counter((r.doc_id, *plain_scan(r.text, rules)) for r in docs.collect())
    assert licenses.scan_licenses(nothing).count() == 0


def test_a_fuller_notice_hides_the_bare_name(spark):
    df = spark.createDataFrame([(1, "Licensed under the Apache License, Version 2.0. It ends mit nothing.")], "doc_id bigint, text string")
    r = licenses.scan_licenses(df).first()
    assert r.labels == "apache-2.0" and r.score == 1.0


def test_identifiers_and_many_notices(spark):
    """More detections than a sweep gathers at once, ties and containment among them; a filter on them is as fast."""
    notice = "SPDX-License-Identifier: MIT\nLicensed under the Apache License, Version 2.0. Copyright (c) 2019 2020. All rights reserved. GNU General Public License v3 or GPL 2. "
    rng = random.Random(4)
    bits = ["gnu", "gpl", "general public license", "version 2", "3", "mit license", "cc by", "sa", "4 0", "licensed under the", "apache", "2 0", "license", "lesser"]
    texts = [(1, notice * 200), (2, "spdx license identifier bsd 3 clause"), *((3 + i, " ".join(rng.choice(bits) for _ in range(60))) for i in range(40))]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    rules = licenses.signature_rules()
    columns = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    out = licenses.scan_licenses(df).where("size(detections) > 0")
    assert by_row(out, *columns) == collections.Counter(want for i, t in texts if (want := (i, *plain_scan(t, rules)))[6])
    got = {r.doc_id: r for r in out.collect()}
    assert got[2].labels == "bsd-3c" and len(got[1].detections) == 200 * 6


# --- quality


def plain_quality(text, lim):
    t = text or ""
    w = WORDS.findall(t)
    n = len(w)

    def cover(k):
        c = collections.Counter(tuple(w[i : i + k]) for i in range(n - k + 1))
        return len({j for i in range(n - k + 1) if c[tuple(w[i : i + k])] > 1 for j in range(i, i + k)})

    most = 0
    while any(v > 1 for v in collections.Counter(tuple(w[i : i + most + 1]) for i in range(n - most)).values()):
        most += 1
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    repeat, covered = cover(lim.window), cover(lim.min_repeat)
    failed = n < lim.min_words or 100 * repeat > lim.max_percent * n
    verdict = 100 * covered > lim.max_covered_percent * n or (most > lim.max_longest and 100 * most > lim.max_longest_percent * n)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeat, covered, most, failed, not (failed or verdict))


def test_quality_against_plain_counts(odd, nothing):
    lim = quality.RepeatLimits()
    got = by_row(quality.repetition_quality(odd), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat", "base_failed", "kept")
    assert got == collections.Counter((i, *plain_quality(t, lim)) for i, t in odd_texts())
    assert quality.repetition_quality(nothing).count() == 0


@pytest.mark.xfail(strict=True, reason="finding F1, open: the limits of the verdict lie above the base's; the SQL reads the same limits")
def test_the_verdict_takes_texts_that_the_base_keeps():
    """A fifth of the words repeat, all of them in one long passage: as much as the base lets through."""
    words = [f"u{i}" for i in range(400)]
    words[300:340] = words[100:140]
    got = quality.measure([" ".join(words).encode()], quality.RepeatLimits())
    assert not got["base_failed"][0] and not got["kept"][0]


def test_suffix_arrays_against_sorting():
    rng = random.Random(3)
    for _ in range(150):
        docs = [[rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 20))] for _ in range(3)]
        flat = np.array([x for d in docs for x in d], np.int64)
        doc = np.array([i for i, d in enumerate(docs) for _ in d], np.int64)
        suffix = [(i, tuple(d[j:])) for i, d in enumerate(docs) for j in range(len(d))]
        order = sorted(range(len(suffix)), key=suffix.__getitem__)
        sa, lcp = suffixes.suffix_lcp(flat, doc)
        assert sa.tolist() == order
        for k in range(1, len(order)):
            (a, x), (b, y) = suffix[order[k - 1]], suffix[order[k]]
            common = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y))) if a == b else 0
            assert lcp[k] == common
