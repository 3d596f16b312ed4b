"""Chat formatting at the level of tokens: segments are encoded on their own, reserved ids are
spliced between them, and the loss mask is a prefix sum over the segments' borders. Control
strings that occur in a text are escaped, reversibly."""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import sliced

SCHEMA = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_tokens bigint"
FORMATTED_SCHEMA = "conv_id bigint, formatted string, ids array<int>, loss_mask array<byte>"
#: The template's control strings; their ids follow the vocabulary's in this order.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
_MARKED = re.compile(r"([<\[])(\\*)(/?s>|/?INST\]|/?ROLE\])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\]|/?ROLE\])")


def escape(text: str) -> str:
    """Put one more backslash after the first character of whatever looks like a control string."""
    return _MARKED.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def segments(role: str, text: str) -> list[tuple[str, bool, bool]]:
    """A turn as (string, is control, counts in the loss). Roles other than user and assistant
    are spelled out."""
    body = escape(text)
    if role == "user":
        return [("[INST]", True, False), (body, False, False), ("[/INST]", True, False)]
    if role == "assistant":
        return [("<s>", True, False), (body, False, True), ("</s>", True, False)]
    return [("[ROLE]", True, False), (escape(role), False, False), ("[/ROLE]", True, False), (body, False, False), ("</s>", True, False)]


@lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=table, special_tokens={}), max(table.values()) + 1


class TurnAssembler:
    """Tokens, mask and text of one conversation, turn by turn."""

    def __init__(self, ranks: bytes, pattern: str):
        self.encoding, self.first = _encoding(ranks, pattern)

    def turn(self, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
        """ids, and +1 / -1 where the loss begins and ends (as long as the ids and one more)."""
        parts, lengths, loss = [], [], []
        for string, control, counts in segments(role, text):
            ids = [self.first + CONTROLS.index(string)] if control else self.encoding.encode_ordinary(string)
            parts.append(np.asarray(ids, np.int32))
            lengths.append(len(ids))
            loss.append(counts)
        delta = np.zeros(sum(lengths) + 1, np.int8)
        at = 0
        for n, counts in zip(lengths, loss, strict=True):
            if counts:
                delta[at] += 1
                delta[at + n] -= 1
            at += n
        return np.concatenate(parts), delta

    def read(self, ids: np.ndarray, mask: np.ndarray):
        """Read a run of whole turns back: (role, text, whether under the loss mask) of each, and
        the formatted text's length."""
        out, chars = [], 0
        where = np.flatnonzero(ids >= self.first)
        segs = {}
        for a, b in zip(where[:-1], where[1:], strict=True):
            segs[int(a)] = (a + 1, b)
        text = lambda a, b: self.encoding.decode_bytes(ids[a:b].tolist()).decode("utf-8", "surrogatepass")
        k = 0
        while k < len(where):
            control = CONTROLS[int(ids[where[k]]) - self.first]
            first, role = k, None
            if control == "[ROLE]":
                raw = text(*segs[int(where[k])])
                chars += len(raw)
                role = unescape(raw)
                k += 1
            body = text(*segs[int(where[k])])
            a, b = segs[int(where[k])]
            chars += len(body)
            role = {"[INST]": "user", "<s>": "assistant"}.get(control, role)
            k += 2
            chars += sum(len(CONTROLS[int(ids[where[j]]) - self.first]) for j in range(first, k))
            under = bool(b > a and mask[a:b].all())
            out.append((role, unescape(body), under))
        return out, chars


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with a conversation's turns side by side and in order.

    Null roles and texts are empty; null conv_ids are one conversation; null turns stand first;
    ties of a turn go by role, then text. One shuffle by conversation; the sort spills, and
    readers stream over it, so a very long conversation needs no memory of its own.
    """
    return _in_order(_clean(conversations))


def _clean(conversations: DataFrame) -> DataFrame:
    return conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _in_order(turns: DataFrame) -> DataFrame:
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _streamed(batches):
    """(conversation, role, text, whether it is the first turn) over a partition's rows."""
    before = ...
    for batch in batches:
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
            yield conv, role, text, conv != before
            before = conv


def _broadcast_ranks(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def format_conversations(conversations: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """conv_id, formatted text, token ids and loss mask of every conversation.

    See ``ordered_turns`` for nulls and ties; an empty table gives no rows, other columns are
    ignored. A conversation's arrays are one row, so they are held in memory; use
    ``conversation_digests`` where only counts and digests are needed.
    """
    ranks = _broadcast_ranks(conversations, ranks_path)

    def kernel(batches):
        make = TurnAssembler(ranks.value, pattern)
        conv, ids, deltas, text = None, [], [], []

        def row():
            flat = np.concatenate(ids)
            mask, at = np.zeros(len(flat) + 1, np.int64), 0
            for d in deltas:
                mask[at : at + len(d)] += d
                at += len(d) - 1
            mask = np.cumsum(mask)[:-1].astype(np.int8)
            return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array(["".join(text)]), pa.array([flat], pa.list_(pa.int32())), pa.array([mask], pa.list_(pa.int8()))], ["conv_id", "formatted", "ids", "loss_mask"])

        for c, role, body, new in _streamed(batches):
            if new and ids:
                yield row()
                ids, deltas, text = [], [], []
            conv = c
            i, d = make.turn(role, body)
            ids.append(i)
            deltas.append(d)
            text.append("".join(s for s, _, _ in segments(role, body)))
        if ids:
            yield row()

    return ordered_turns(conversations).mapInArrow(kernel, FORMATTED_SCHEMA)


READ_SCHEMA = "conv_id bigint, turn bigint, role string, text string, under boolean, chars bigint, tokens bigint"


def read_back(conversations: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Every turn as it is read back from its assembled tokens and mask: role, text, whether it is under the loss
    mask, and the sizes of its formatted text. A map over the rows, so turns of one conversation spread over tasks."""
    ranks = _broadcast_ranks(conversations, ranks_path)

    def kernel(batches):
        make = TurnAssembler(ranks.value, pattern)
        for batch in sliced(batches):
            out = []
            for conv, turn, role, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, delta = make.turn(role, body)
                turns, chars = make.read(ids, np.cumsum(delta)[:-1])
                ((r, t, under),) = turns  # a row is a turn
                out.append((conv, turn, r, t, under, chars, len(ids)))
            if out:
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [f.split()[0] for f in READ_SCHEMA.split(", ")])

    return _clean(conversations).mapInArrow(kernel, READ_SCHEMA)


def conversation_digests(conversations: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """One row per conversation with counts and SHA-256 digests, read back from the assembled
    tokens and mask. Turns are assembled and read where they lie; a conversation's task only hashes them
    in order, in constant memory."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def kernel(batches):
        out, state, conv = [], None, None

        def close():
            out.append((conv, state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["all"], state["tokens"]))

        def batch_of():
            cols = list(zip(*out, strict=True))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        before = ...
        for batch in sliced(batches, 1024):
            for c, _, r, t, under, chars, tokens in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != before:
                    if state:
                        close()
                    if len(out) >= 4096:
                        yield batch_of()
                        out.clear()
                    state = {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "all": 0, "tokens": 0}
                conv = before = c
                state["all"] += chars
                state["tokens"] += tokens
                state["n"] += 1
                state["turns"].update(f"{r}\n{t}\n".encode("utf-8", "surrogatepass"))
                if under:
                    state["chars"] += len(t)
                    state["loss"].update(t.encode("utf-8", "surrogatepass"))
        if state:
            close()
        if out:
            yield batch_of()

    return _in_order(read_back(conversations, ranks_path, pattern)).mapInArrow(kernel, SCHEMA)
