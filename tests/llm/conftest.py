import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, k1 string, n_words string, component string, spans string, mix_slot string, _h string"


def passage(seed, words=70):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdeghinorst") for _ in range(rng.randint(2, 8))) for _ in range(words))


def odd_texts():
    """Nulls, empty and long texts, ties, repeats, odd characters."""
    shared, other = passage(1), passage(2, 60)
    near = passage(3, 120).split()
    one = near.copy()
    one[60] = "changed"
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "two words"), (6, "1234 +++"),
        (7, passage(4) + " " + shared + " " + passage(5)), (8, shared), (9, passage(6) + "\n" + shared + "\n" + passage(6)),
        (10, " ".join(near)), (11, " ".join(one)), (12, " ".join(near)), (12, " ".join(near)), (13, "A" * 1000), (14, "ab " * 400),
        (15, "é ü ß Σ İ 一二 " * 60), (16, other + " é " + other), (None, other), (None, None), (17, passage(7, 40_000)), (18, "x\x00y \x1c z\x85w q"),
        (19, "All Rights Reserved. cc by cc by 4.0, GNU General Public License v3"), (20, "Licensed under the Apache License, Version 2.0"), (21, "ALL RIGHTS RESERVED"),
        (22, passage(8) + " " + passage(8)), (23, "line\nline\n\nother line\nline"), (-5, "negative id text of some words"), (24, "ﬁ é <|endoftext|> don't 'S " + "\U0001f600" * 3),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, ("en", None, "de")[k % 3], ("s1", "s1", None, "s2")[k % 4], None, "x", "y", "z", "q", "r", "h") for k, (i, t) in enumerate(odd_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
