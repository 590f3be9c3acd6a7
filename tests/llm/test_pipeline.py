"""The stages of the corpus pipeline, each against brute force on its own input, and all queries registered."""

import hashlib

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from canvass.llm import mixing, queries
from canvass.llm.vocab import read_ranks
from test_near_copies import parts, plain_links


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, sf).cache()
        out.append((name, docs, after))
        docs = after
    return out


def test_stages_in_order(stages):
    assert [name for name, _, _ in stages] == ["language_id", "near_dedup", "mixing", "bpe"]
    assert all(after.columns == docs.columns for _, docs, after in stages[:-1])


def test_language_id_keeps_clean_documents(stages):
    _, docs, after = stages[0]
    assert after.count() >= 0.98 * docs.count()


def test_near_dedup_keeps_one_of_each_group(stages):
    _, docs, after = stages[1]
    texts = {}
    for r in sorted(docs.select("doc_id", "text").collect()):
        texts.setdefault(r.text, r.doc_id)
    kept = [min(texts[t] for t in group) for group in parts(set(texts), plain_links(texts))]
    assert sorted(r.doc_id for r in after.select("doc_id").collect()) == sorted(kept)


def test_mixing_repeats_documents(stages):
    _, docs, after = stages[2]
    want = sorted(r.doc_id for r in mixing.mix(docs).collect() for _ in range(r.copies))
    assert sorted(r.doc_id for r in after.select("doc_id").collect()) == want


def test_bpe_round_trip(stages):
    _, docs, after = stages[3]
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = sorted((r.doc_id, own.encode_ordinary(r.text), hashlib.sha256(r.text.encode()).hexdigest()) for r in docs.collect())
    assert sorted((r.doc_id, list(r.ids), r.decoded_sha256) for r in after.collect()) == want


def test_queries_are_registered_by_number():
    assert [name.split("_")[0] for name in queries.QUERIES] == [f"op{n}" for n in range(1, 11)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, sf, name):
    from oracle import compare, database

    assert compare(spark, database(sf), queries.QUERIES[name], queries.ORACLE_SQL[name], sf) == ""


@pytest.mark.parametrize("name", ["op1_url_filters", "op2_language_id", "op3_token_counts", "op5_html_extraction", "op6_fingerprints", "op7_nearest", "op10_bpe"])
def test_queries_run_on_whole_tables(spark, sf, name):
    rows = queries.QUERIES[name](spark, sf).count()
    source = {"op1": "pages", "op5": "pages", "op7": "embeddings"}.get(name.split("_")[0], "documents")
    whole = spark.read.parquet(f"{sf}/{source}.parquet")
    assert rows == (5 * whole.where("vec_id % 50 = 0").count() if source == "embeddings" else whole.count())
