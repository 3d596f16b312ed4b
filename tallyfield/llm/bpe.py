"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a pre-token exactly one vocabulary entry can be the last token of the
prefix's encoding. Candidates are the entries that end there, found by an automaton with
suffix links over the vocabulary; a candidate stands if it is compatible with the last token
of the prefix before it. Back-pointers from the whole pre-token give the ids.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import release_memory, sliced, text_chunks

#: Pre-tokens and white-space pieces that a Python worker remembers; beyond that it starts afresh.
CACHE_ENTRIES = 300_000
DIGEST_SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
#: White space of ``str.split`` that the tokenizer's pattern does not count as white space.
ODD_SPACE = re.compile("[\x1c-\x1f]")


def bytes_to_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it can be shown, and
    the others in order from 256 up."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (c for c in range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


class Remembered(dict):
    """A cache of two generations: when the younger is full it becomes the older, and what is asked for again
    comes back from there. Long keys aren't kept, so entries bound its bytes."""

    def __init__(self, entries: int, longest: int = 64):
        super().__init__()
        self.entries, self.longest, self.older = entries, longest, {}

    def keep(self, key, value) -> None:
        if len(key) <= self.longest:
            if len(self) >= self.entries // 2:
                self.older = dict(self)
                super().clear()
            self[key] = value

    def recall(self, key):
        """What the older generation knows; ``get`` asks the younger one alone."""
        got = self.older.get(key)
        if got is not None:
            self.keep(key, got)
        return got

    def clear(self) -> None:
        super().clear()
        self.older = {}


class WordBpe:
    """A tokenizer file of BPE with word ends; lower case, white space dropped."""

    def __init__(self, file: bytes):
        spec = json.loads(file)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        self.text = {i: t for t, i in vocab.items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text |= {i: t for t, i in special.items()}
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        #: What every added token begins with, at most two characters: most texts hold none of it.
        self.marks = re.compile("|".join(sorted({re.escape(t[:2]) for t in special}))) if special else None
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        byte_of = {c: b for b, c in enumerate(bytes_to_symbols())}
        # how each token was merged, in the order of the merges
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        for order, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            key = vocab[a], vocab[b]
            token = vocab[a + b]
            self.merged[key] = order, token
            self.parts.setdefault(token, (*key, order))
        # automaton over bytes; a word's last byte carries the word end, as one symbol above 255
        step: list[dict[int, int]] = [{}]
        token_at: list[int] = [-1]
        for t, i in vocab.items():
            whole = self.end and t.endswith(self.end) and len(t) > len(self.end)
            word = [byte_of[c] for c in (t[: -len(self.end)] if whole else t)]
            if whole:
                word[-1] += 256
            state = 0
            for c in word:
                nxt = step[state].get(c)
                if nxt is None:
                    nxt = step[state][c] = len(step)
                    step.append({})
                    token_at.append(-1)
                state = nxt
            if token_at[state] < 0:
                token_at[state] = i
        link, depth = [0] * len(step), [0] * len(step)
        ends: list[tuple] = [()] * len(step)  # (token, length) from the longest, along suffix links
        queue = list(step[0].values())
        for s in queue:
            depth[s] = 1
        for s in queue:
            own = ((token_at[s], depth[s]),) if token_at[s] >= 0 else ()
            ends[s] = own + ends[link[s]]
            for c, nxt in step[s].items():
                depth[nxt] = depth[s] + 1
                back = link[s]
                while back and c not in step[back]:
                    back = link[back]
                link[nxt] = step[back].get(c, 0)
                queue.append(nxt)
        self.step, self.link, self.ends = step, link, ends
        self.moves: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}
        self.words, self.pieces = Remembered(CACHE_ENTRIES), Remembered(CACHE_ENTRIES)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the tokens stay apart when their texts stand side by side.

        The merges that built the two are undone, last one first; a merge across the border
        that precedes everything still built on either side would have come earlier.
        """
        a, b = left, right
        limit, strict = len(self.merged), True
        while True:
            across = self.merged.get((a, b))
            if across is not None and (across[0] < limit or not strict and across[0] == limit):
                return False
            built_a, built_b = self.parts.get(a), self.parts.get(b)
            if built_a is None and built_b is None:
                return True
            # the side that was merged last comes apart; on a tie the right one, as merges run from the left
            if built_b is None or built_a is not None and built_a[2] > built_b[2]:
                # a's last merge stands to the left: an equal merge across comes after it
                limit, strict, a = built_a[2], True, built_a[1]
            else:
                # b's last merge stands to the right: an equal merge across comes before it
                limit, strict, b = built_b[2], False, built_b[0]

    def move(self, state: int, symbol: int) -> int:
        """The automaton's next state, remembered for later."""
        at = state
        while at and symbol not in self.step[at]:
            at = self.link[at]
        to = self.step[at].get(symbol, 0)
        if len(self.moves) >= 2 * CACHE_ENTRIES:
            self.moves.clear()
        self.moves[state << 9 | symbol] = to
        return to

    def word_ids(self, word: bytes) -> list[int]:
        """Ids of one pre-token, by the last token of every prefix."""
        n = len(word)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        state, i, moves, pairs, ends = 0, 0, self.moves, self.pairs, self.ends
        for c in word:
            i += 1
            if i == n:
                c += 256  # the symbol that carries the word end
            to = moves.get(state << 9 | c)
            state = self.move(state, c) if to is None else to
            for token, length in ends[state]:
                j = i - length
                if j:
                    before = last[j]
                    if before < 0:
                        continue
                    fits = pairs.get(before << 20 | token)
                    if fits is None:
                        if len(pairs) >= 2 * CACHE_ENTRIES:
                            pairs.clear()
                        fits = pairs[before << 20 | token] = self.compatible(before, token)
                    if not fits:
                        continue
                last[i], back[i] = token, j
                break
        if n and last[n] < 0:
            raise ValueError("the vocabulary has no token for a symbol")
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        return out[::-1]

    def piece(self, raw: str) -> tuple[bytes, str]:
        """Ids (little-endian) and decoded text of a piece without white space."""
        if (got := self.pieces.recall(raw)) is not None:
            return got
        if raw.isascii():
            text = raw.lower()
        else:
            text = "".join(map(str.lower, unicodedata.normalize("NFC", raw)))
        words = self.words
        found = []
        for word in (text,) if text.isalpha() else self.pattern.findall(text):
            got = words.get(word) or words.recall(word)
            if got is None:
                ids = self.word_ids(word.encode("utf-8"))
                got = struct.pack(f"<{len(ids)}I", *ids), " ".join([self.text[i] for i in ids])
                words.keep(word, got)
            found.append(got)
        got = found[0] if len(found) == 1 else (b"".join([f[0] for f in found]), " ".join([f[1] for f in found]))
        self.pieces.keep(raw, got)
        return got

    def encode_parts(self, text: str) -> list[tuple[bytes, str]]:
        """Ids and decoded text of the pieces of a whole text, in order."""
        out: list[tuple[bytes, str]] = []
        special = self.special
        for part in self.cut.split(text) if self.cut and self.marks.search(text) else (text,):
            if part in special:
                out.append((struct.pack("<I", special[part]), part))
            elif ODD_SPACE.search(part):
                out += [self.piece(p) for p in regex.split(r"[^\S\x1c-\x1f]+", part) if p]
            else:
                pieces, known = part.split(), self.pieces
                out += [known.get(p) or self.piece(p) for p in pieces]
        return out

    def forget_pieces(self) -> None:
        """Give up the pieces of a task's texts; words, moves and pairs serve the next task too."""
        self.pieces.clear()
        release_memory()

    def encode(self, text: str) -> list[int]:
        packed = b"".join(p[0] for p in self.encode_parts(text))
        return list(struct.unpack(f"<{len(packed) // 4}I", packed))

    def decode(self, ids: list[int]) -> str:
        """Token texts joined by one space, word ends and special tokens included."""
        return " ".join(map(self.text.__getitem__, ids))


@lru_cache(maxsize=2)
def _loaded(file: bytes) -> WordBpe:
    return WordBpe(file)


def _tokenizer_bytes(df: DataFrame, path: str):
    with open(path, "rb") as f:  # the driver's file; a few MB of vocabulary go to the executors
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_documents(docs: DataFrame, tokenizer_path: str, keep: tuple = ()) -> DataFrame:
    """doc_id, n_tokens, ids array<int>, the ids' digest and the decoded text's digest, for every whole
    text (null: empty, no ids).

    The columns of ``keep`` follow; others are ignored, repeated rows give repeated results, an empty table no rows.
    A map over the rows, in their order; memory is bounded by a chunk and the worker's caches.
    """
    vocabulary = _tokenizer_bytes(docs, tokenizer_path)

    def kernel(batches):
        bpe = _loaded(vocabulary.value)
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in text_chunks(texts):
                packed, decoded = [], []
                for t in texts[lo:hi]:
                    parts = bpe.encode_parts(t)
                    packed.append(b"".join([p[0] for p in parts]))
                    decoded.append(" ".join([p[1] for p in parts if p[0]]).encode("utf-8"))
                ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))
                sha = lambda values: pa.array([hashlib.sha256(v).hexdigest() for v in values], pa.string())
                kept = [batch.column(2 + i).slice(lo, hi - lo) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(ends).astype(np.int64)), ids, sha(packed), sha(decoded), *kept], ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256", *keep])
        bpe.forget_pieces()

    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), *keep).mapInArrow(kernel, f"doc_id bigint, n_tokens bigint, ids array<int>, ids_sha256 string, decoded_sha256 string{more}")


def encoding_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """As ``encode_documents``, with counts and SHA-256 digests in place of ids and text."""
    vocabulary = _tokenizer_bytes(docs, tokenizer_path)

    def kernel(batches):
        bpe = _loaded(vocabulary.value)
        for batch in sliced(batches):
            counts, ids, decoded = [], [], []
            for t in batch.column(1).to_pylist():
                parts = bpe.encode_parts(t or "")
                packed = b"".join([p[0] for p in parts])
                counts.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(" ".join([p[1] for p in parts if p[0]]).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.forget_pieces()

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(kernel, DIGEST_SCHEMA)
