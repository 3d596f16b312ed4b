"""Quality rules from a suffix array over each document's words.

Maximal repeated substrings are read off the longest-common-prefix array; the union of
their spans and the longest of them are limited.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import sliced, text_chunks
from tallyfield.llm.suffixes import suffix_lcp

SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, covered_words bigint, longest_repeat bigint, base_failed boolean, kept boolean"
)
#: The characters counted as symbols, and white space.
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\r\x0b\x0c"


@dataclass(frozen=True)
class RepeatLimits:
    """window: words of the counted windows; min_words, max_percent: failing words and share.

    min_repeat: words that a maximal repeat needs to count for coverage; max_covered_percent:
    largest share of words inside such repeats; max_longest: longest repeat allowed, or
    max_longest_percent of the words where that is more.
    """

    window: int = 5
    min_words: int = 10
    max_percent: int = 20
    min_repeat: int = 12
    max_covered_percent: int = 30
    max_longest: int = 60
    max_longest_percent: int = 25


def measure(texts: list, limits: RepeatLimits) -> dict[str, list]:
    """The measures of some texts (None: empty); every word of every text is used."""
    out: dict[str, list] = {k: [] for k in SCHEMA.replace(",", "").split()[2::2]}
    ids: dict[bytes, int] = {}
    flat: list[int] = []
    counts = []
    for t in texts:
        words = t.split()
        counts.append(len(words))
        for w in words:
            flat.append(ids.setdefault(w, len(ids)))
        lines = [line for line in t.split(b"\n") if line.strip(SPACE)]
        chars = len(t.translate(None, SPACE).decode("utf-8", "surrogatepass"))
        out["word_chars"].append(chars)
        out["n_symbols"].append(len(t) - len(t.translate(None, SYMBOLS)))
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
    counts = np.asarray(counts, np.int64)
    words = np.asarray(flat, np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)
    sa, lcp = suffix_lcp(words, doc)
    longest = np.zeros(len(words), np.int64)
    if len(words):
        longest[sa] = np.maximum(lcp, np.append(lcp[1:], 0))
    covered = {}
    for name, least in (("n_repeat_words", limits.window), ("covered_words", limits.min_repeat)):
        at = np.flatnonzero(longest >= least)
        if name == "n_repeat_words":
            reach = at + least
        else:  # maximal to the left: not the tail of the repeat one word before
            maximal = (at == 0) | (longest[np.maximum(at - 1, 0)] != longest[at] + 1)
            at = at[maximal]
            reach = at + longest[at]
        mark = np.zeros(len(words) + 1, np.int64)
        np.add.at(mark, at, 1)
        np.add.at(mark, reach, -1)
        covered[name] = np.bincount(doc, weights=np.cumsum(mark[:-1]) > 0, minlength=len(counts)).astype(np.int64)
    most = np.zeros(len(counts), np.int64)
    np.maximum.at(most, doc, longest)
    repeat = covered["n_repeat_words"]
    failed = (counts < limits.min_words) | (100 * repeat > limits.max_percent * counts)
    too_long = (most > limits.max_longest) & (100 * most > limits.max_longest_percent * counts)
    verdict = (100 * covered["covered_words"] > limits.max_covered_percent * counts) | too_long
    return out | {
        "n_words": counts,
        "n_repeat_words": repeat,
        "covered_words": covered["covered_words"],
        "longest_repeat": most,
        "base_failed": failed,
        "kept": ~(failed | verdict),
    }


def repetition_quality(docs: DataFrame, limits: RepeatLimits = RepeatLimits()) -> DataFrame:
    """One row per document of ``docs`` (doc_id, text; other columns are ignored).

    Null and empty texts have no words: all measures 0, base_failed true, kept false. Repeated
    rows give repeated results; null ids are kept; an empty table gives no rows. A map over the
    rows: no shuffle, memory bounded by the chunk size or one text.
    """

    def kernel(batches):
        for batch in sliced(batches):
            doc_id = batch.column(0)
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            for lo, hi in text_chunks(texts):
                got = measure(texts[lo:hi], limits)
                names = [f.split()[0] for f in SCHEMA.split(", ")][1:]
                yield pa.RecordBatch.from_arrays([doc_id.slice(lo, hi - lo), *(pa.array(got[n]) for n in names)], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(kernel, SCHEMA)
