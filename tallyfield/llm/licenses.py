"""License scans with DataFrame functions only: ordered signature rules, gated by keywords, with
priorities and containment resolving detections that overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Label stem, keywords (whole words of every spelling) that gate the rules, how the name is written, versions.
FAMILIES = (
    ("apache", "apache", "apache(?: software)?(?: license)?", ("1 0", "1 1", "2 0")),
    ("mit", "mit license", "mit(?: x11)? license", ()),
    ("bsd", "bsd", "bsd(?: style)?(?: license)?", ("0 clause", "1 clause", "2 clause", "3 clause", "4 clause")),
    ("gpl", "gpl", "(?:gnu )?gpl", ("1", "2", "3", "2 0", "3 0")),
    ("gpl", "gnu", "gnu general public license", ("1", "2", "3", "2 0", "3 0")),
    ("lgpl", "lgpl", "(?:gnu )?lgpl", ("2", "2 1", "3", "3 0")),
    ("lgpl", "lesser", "(?:gnu )?lesser general public license", ("2 1", "3", "3 0")),
    ("agpl", "agpl", "(?:gnu )?agpl", ("1", "3", "3 0")),
    ("agpl", "affero", "(?:gnu )?affero general public license", ("1", "3", "3 0")),
    ("gfdl", "documentation", "gnu free documentation license", ("1 1", "1 2", "1 3")),
    ("mpl", "mpl", "mpl", ("1 0", "1 1", "2 0")),
    ("mpl", "mozilla", "mozilla public license", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse", "eclipse public license", ("1 0", "2 0")),
    ("cddl", "cddl", "cddl", ("1 0", "1 1")),
    ("cddl", "distribution", "common development and distribution license", ("1 0", "1 1")),
    ("cpl", "common", "common public license", ("1 0",)),
    ("eupl", "eupl", "eupl", ("1 0", "1 1", "1 2")),
    ("artistic", "artistic", "artistic license", ("1 0", "2 0")),
    ("boost", "boost", "boost software license", ("1 0",)),
    ("isc", "isc license", "isc license", ()),
    ("zlib", "zlib", "zlib(?: libpng)? license", ()),
    ("unlicense", "unlicense", "(?:the )?unlicense", ()),
    ("wtfpl", "wtfpl", "wtfpl", ("1 0", "2", "2 0")),
    ("psf", "python", "python software foundation license", ("2", "2 0")),
    ("ofl", "font", "(?:sil )?open font license", ("1 0", "1 1")),
    ("ms-pl", "microsoft", "microsoft public license", ()),
    ("ms-rl", "microsoft", "microsoft reciprocal license", ()),
    ("odbl", "database", "open(?: data commons)? database license", ("1 0",)),
    ("pddl", "public", "public domain dedication and license", ("1 0",)),
    ("cc0", "cc0", "(?:cc )?cc0", ("1 0",)),
    ("cc-by-sa", "cc", "cc by sa", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "cc", "cc by nc", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", "cc", "cc by nd", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", "cc", "cc by nc sa", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-nd", "cc", "cc by nc nd", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by", "cc", "cc by", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "attribution", "creative commons attribution share ?alike", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "attribution", "creative commons attribution non ?commercial", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", "attribution", "creative commons attribution no ?deriv(?:ative)?s", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by", "attribution", "creative commons attribution", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("public-domain", "domain", "(?:the )?public domain", ()),
)
#: Notices without a license's name: label, keyword, pattern.
NOTICES = (
    ("reserved", "reserved", "all rights(?: are)? reserved"),
    ("copyright", "copyright", "copyright(?: c)? (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})*"),
    ("copyright", "copyrighted", "copyrighted (?:material|work)"),
    ("proprietary", "proprietary", "proprietary(?: and)? confidential"),
    ("proprietary", "confidential", "confidential(?: and)? proprietary"),
    ("as-is", "warranty", "without warranty of any kind"),
    ("as-is", "warranties", "without warranties or conditions of any kind"),
    ("no-derivatives", "derivative", "no derivative works(?: allowed| permitted)?"),
    ("permission", "permission", "permission is hereby granted(?: free of charge)?"),
    ("redistribution", "redistribution", "redistribution and use in source and binary forms"),
)
#: Identifiers after "SPDX-License-Identifier:", as words, and their labels.
SPDX = (
    ("mit", "mit"), ("isc", "isc"), ("zlib", "zlib"), ("unlicense", "unlicense"), ("wtfpl", "wtfpl"), ("0bsd", "bsd-0c"), ("bsd 2 clause", "bsd-2c"), ("bsd 3 clause", "bsd-3c"),
    ("apache 1 1", "apache-1.1"), ("apache 2 0", "apache-2.0"), ("mpl 1 1", "mpl-1.1"), ("mpl 2 0", "mpl-2.0"), ("epl 1 0", "epl-1.0"), ("epl 2 0", "epl-2.0"), ("cddl 1 0", "cddl-1.0"), ("bsl 1 0", "boost-1.0"),
    ("gpl 2 0", "gpl-2.0"), ("gpl 3 0", "gpl-3.0"), ("lgpl 2 1", "lgpl-2.1"), ("lgpl 3 0", "lgpl-3.0"), ("agpl 3 0", "agpl-3.0"), ("artistic 2 0", "artistic-2.0"), ("cc0 1 0", "cc0-1.0"),
    ("cc by 4 0", "cc-by-4.0"), ("cc by sa 4 0", "cc-by-sa-4.0"), ("cc by nc 4 0", "cc-by-nc-4.0"), ("cc by nd 4 0", "cc-by-nd-4.0"), ("ofl 1 1", "ofl-1.1"),
)
#: Priorities: a notice of licensing, a name with a version, a bare name; and what each is worth.
WORTH = {1: 1.0, 2: 0.85, 3: 0.6}
BASE_WORTH = 0.7
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def signature_rules() -> list[dict]:
    """The ordered rules: for every family and version a notice ("licensed under ..."), a name with
    version and a bare name. Patterns work on lower-case words with a space before and after each."""
    out = []

    def add(label, keyword, body, priority):
        out.append({"id": len(out), "label": label, "kw": keyword, "re": f" {body}(?= )", "prio": priority})

    under = "(?:licensed|released|distributed|available|published|provided) under(?: the)?(?: terms of)?(?: the)?"
    for stem, keyword, name, versions in FAMILIES:
        for v in versions:
            written = f"(?:version |v)?{v}" if v[0].isdigit() and "clause" not in v else v
            full = f"{written} {name}" if "clause" in v else f"{name} {written}"
            label = f"{stem}-{v.replace(' clause', 'c').replace(' ', '.')}"
            add(label, keyword, f"{under} {full}", 1)
            add(label, keyword, full, 2)
        add(stem, keyword, f"{under} {name}", 1 if not versions else 2)
        add(stem, keyword, name, 3)
    for label, keyword, body in NOTICES:
        add(label, keyword, body, 2)
    for written, label in SPDX:
        add(label, "spdx", f"spdx license identifier {written}(?: only| or later)?", 1)
    return out


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" ")))


def numbered(pattern: str, space: str = "(?: [0-9]+:)") -> str:
    """A rule's pattern for words that have their numbers before them."""
    ahead = "(?= )"
    return pattern.removesuffix(ahead).replace(" ", space) + ahead


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _found(rules: list[dict]) -> Column:
    """Of the padded words ``w``: one array, in an array, of (a, before, prio, label) of all matches, sorted:
    first word, minus the word after the last, and the rule's; no array where no rule's keywords are there.

    Every pattern is a literal, compiled once; a match carries the numbers of its words, so places take no
    walk over the text. Lambdas bind the words, the keywords and the numbered words, so that a plan that
    moves this column, say below a filter, still makes each once. It is one SQL text, as thousands of calls
    would cost seconds.
    """
    keywords = ", ".join(f"IF(contains(v, ' {k} '), '{k}', NULL)" for k in dict.fromkeys(x for r in rules for x in r["kw"].split()))
    gates = {k: " AND ".join(f"array_contains(kw, '{x}')" for x in k.split()) for k in dict.fromkeys(r["kw"] for r in rules)}
    hits = lambda r: f"named_struct('prio', {r['prio']}, 'label', {_quoted(r['label'])}, 'm', regexp_extract_all(words, {_quoted(numbered(r['re']))}, 0))"
    gated = ", ".join(f"IF({gate}, array({', '.join(hits(r) for r in rules if r['kw'] == k)}), NULL)" for k, gate in gates.items())
    some = f"filter(flatten(filter(array({gated}), g -> g IS NOT NULL)), h -> size(h.m) > 0)"
    place = "named_struct('a', int(substring_index(substr(m, 2), ':', 1)), 'before', -1 - int(substring_index(substring_index(m, ' ', -1), ':', 1)), 'prio', h.prio, 'label', h.label)"
    # " 0:word 1:word ... n:"
    numbers = "concat(' ', array_join(transform(split(substr(v, 2), ' '), (x, i) -> concat(string(i), ':', x)), ' '))"
    found = f"transform(array({numbers}), words -> sort_array(flatten(transform({some}, h -> transform(h.m, m -> {place})))))"
    kept = f"IF({' OR '.join(f'({g})' for g in gates.values())}, {found}, array())"
    return F.expr(f"flatten(transform(array(w), v -> flatten(transform(array(filter(array({keywords}), k -> k IS NOT NULL)), kw -> {kept}))))")


#: Detections that a sweep gathers before it hands them on; arrays are copied when they grow.
SWEEP = 512


def _unsuppressed(found: Column) -> Column:
    """[(label, prio, a, b)] that no other detection suppresses, in order of their places, each once.

    In the order of first word, length (longest first) and priority, whatever may suppress a detection
    stands before it: it goes if a detection before it of the same or a higher priority ends no earlier.
    Those with the same words and priority share their fate. One sweep, with the furthest end of each priority.
    """
    none = F.expr("array_repeat(named_struct('label', '', 'prio', 0, 'a', 0, 'b', 0), 0)")
    zero = F.lit(0)
    start = F.struct(zero.alias("e1"), zero.alias("e2"), zero.alias("e3"), F.lit(-1).alias("a"), zero.alias("b"), zero.alias("prio"), F.lit("").alias("label"), F.lit(False).alias("kept"), none.alias("out"))

    def look(s, d):
        b, p = -d["before"], d["prio"]
        same = (s["a"] == d["a"]) & (s["b"] == b) & (s["prio"] == p)
        kept = F.when(same, s["kept"]).otherwise(b > F.when(p == 1, s["e1"]).when(p == 2, s["e2"]).otherwise(s["e3"]))
        new = kept & ~(same & (s["label"] == d["label"]))
        end = lambda n: F.when(p <= n, F.greatest(s[f"e{n}"], b)).otherwise(s[f"e{n}"]).alias(f"e{n}")
        one = F.struct(d["label"].alias("label"), p.alias("prio"), d["a"].alias("a"), b.alias("b"))
        return F.struct(end(1), end(2), end(3), d["a"].alias("a"), b.alias("b"), p.alias("prio"), d["label"].alias("label"), kept.alias("kept"), F.when(new, F.concat(s["out"], F.array(one))).otherwise(s["out"]).alias("out"))

    def sweep(s, i):
        state = [s[c].alias(c) for c in ("e1", "e2", "e3", "a", "b", "prio", "label", "kept")]
        done = F.aggregate(F.slice(found, i * SWEEP + 1, F.lit(SWEEP)), F.struct(*state, none.alias("out")), look)
        return F.struct(*(done[c].alias(c) for c in ("e1", "e2", "e3", "a", "b", "prio", "label", "kept")), F.concat(s["all"], F.array(done["out"])).alias("all"))

    first = F.struct(*(start[c].alias(c) for c in ("e1", "e2", "e3", "a", "b", "prio", "label", "kept")), F.expr("array_repeat(array(named_struct('label', '', 'prio', 0, 'a', 0, 'b', 0)), 0)").alias("all"))
    rounds = F.sequence(zero, F.floor((F.size(found) - 1) / SWEEP).cast("int"))
    return F.when(F.size(found) > 0, F.flatten(F.aggregate(rounds, first, sweep)["all"])).otherwise(none)


def scan_licenses(docs: DataFrame, rules: list[dict] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and detections.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z in lower case. Null and
    empty texts have no words and no labels: counts 0, first_word and last_word null, labels empty,
    score 0. A detection goes if another one of the same or a higher priority contains it and is
    longer, or as long and of a higher priority. Score is the worth of the best detection left. Other columns
    are ignored; repeated rows give repeated results. A map over the rows: no shuffle; texts without
    a keyword never reach a regular expression of the rules.
    """
    rules = signature_rules() if rules is None else rules
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    # every run of other characters is one space; one stands before the first word and after the last
    words = F.trim(F.regexp_replace(F.translate(text, upper, upper.lower()), WORD_GAP, " "))
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), words.alias("_t"))
    base = base.select("doc_id", F.when(F.col("_t") == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), "_t", F.lit(" "))).alias("w")).withColumn("n_words", (_spaces(F.col("w")) - 1).cast("bigint"))
    w = F.col("w")
    any_base = " (?=(?:" + "|".join(p for p, _ in BASE) + ") )"
    has = {p: w.contains(f" {p} ") for p, _ in BASE}
    some = has[BASE[0][0]] | has[BASE[1][0]] | has[BASE[2][0]]
    base = base.withColumns({
        "n_base": F.when(some, F.regexp_count(w, F.lit(any_base))).otherwise(0).cast("bigint"),
        "first_word": F.when(some, _spaces(F.split(w, any_base, 2)[0])).cast("bigint"),
        "last_word": F.when(some, _spaces(F.regexp_extract(w, f"(?s)^(.*){any_base}", 1))).cast("bigint"),
        "_base": F.filter(F.array(*(F.when(has[p], F.lit(label)) for p, label in BASE)), lambda x: x.isNotNull()),
    })
    base = base.withColumn("detections", F.flatten(F.transform(_found(rules), _unsuppressed)))
    worth = lambda p: F.when(p == 1, WORTH[1]).when(p == 2, WORTH[2]).otherwise(WORTH[3])
    best = F.array_max(F.concat(F.transform("detections", lambda d: worth(d["prio"])), F.array(F.when(F.size("_base") > 0, F.lit(BASE_WORTH)).otherwise(F.lit(0.0)))))
    named = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return base.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", named(F.col("_base")).alias("base_labels"),
        named(F.concat(F.col("_base"), F.transform("detections", lambda d: d["label"]))).alias("labels"), best.alias("score"), "detections",
    )
