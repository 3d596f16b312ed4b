"""Registered queries against their SQL, and the pipeline stage by stage."""

import collections

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyfield.llm import queries as Q
from tests.llm.test_corpus_operators import plain_near, plain_spans
from tests.test_oracles import TABLES, canonical

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, data, duck, name):
    a, b = canonical(Q.queries()[name](spark, data).toPandas()), canonical(duck.execute(Q.oracle_sql()[name]).df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for c in a.columns:
        assert (a[c].fillna("~") == b[c].fillna("~")).all(), c


def test_stages_do_their_work_and_keep_clean_rows(spark, odd, data, tmp_path):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.read.parquet(f"{data}/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text", "lang", "source", "n_chars"))
    docs = docs.withColumns({"a.b": F.lit(1), "`c": F.lit("x"), "mix_position": F.lit(0), "component_id": F.lit("y")})
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = (before.collect(), docs.collect())
    before, after = left["language_id"]
    gone = collections.Counter(r.doc_id for r in before) - collections.Counter(r.doc_id for r in after)
    assert set(gone) == {1, 2, 3, 6, None} and gone[None] == 1
    before, after = left["near_dedup"]
    want = {k[0] for k in plain_near([(r.doc_id, r.text) for r in before], 5) if k[3] and k[0] is not None}
    ids = [r.doc_id for r in after if r.doc_id is not None]
    assert sorted(ids) == sorted(want) and sum(r.doc_id is None for r in after) == 1
    before, after = left["suffix_dedup"]
    raw = [r.text.encode() for r in before]
    left_over = [(r.doc_id, bytes(b for i, b in enumerate(t) if not gone[i]).decode("utf-8", "ignore")) for r, t, gone in zip(before, raw, plain_spans(raw, 200), strict=True)]
    assert collections.Counter(left_over) == collections.Counter((r.doc_id, r.text) for r in after) and left_over != [(r.doc_id, r.text) for r in before]
    before, after = left["mixing"]
    assert collections.Counter(before) == collections.Counter(after)
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
    lib = pytest.importorskip("tokenizers").Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lib.no_truncation()
    lib.no_padding()
    want = collections.Counter((r.doc_id, tuple(lib.encode(r.text, add_special_tokens=False).ids)) for r in after)
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in tokens) == want and all(r.n_tokens == len(r.ids) for r in tokens)
    assert len({r.mix_position for r in tokens}) == len(tokens)


def test_tokens_have_their_places_in_the_mix(spark, data, tmp_path):
    """Weights are roots of sizes: 256 and 64 documents, so a third of any prefix is from b while b lasts."""
    docs = spark.createDataFrame([(i, f"text {i} " * (1 + i % 50), "b" if i % 5 == 0 else "a") for i in range(320)], "doc_id bigint, text string, source string")
    corpus_pipeline.mix(spark, docs, data).write.parquet(f"{tmp_path}/mix")
    out = corpus_pipeline.tokens(spark, spark.read.parquet(f"{tmp_path}/mix"), data)
    ids = [r.doc_id for r in out.orderBy("mix_position").select("doc_id").collect()]
    assert sorted(ids) == list(range(320))
    for n in range(16, 193, 16):
        assert abs(sum(i % 5 == 0 for i in ids[:n]) - n / 3) < 16


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
