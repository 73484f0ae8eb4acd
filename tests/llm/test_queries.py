"""The registered opN queries on sf0.001, at their own parameters, against brute force."""

import pytest

from comboscore.llm.queries import QUERIES, table
from tests.conftest import SF001
from tests.llm import brute
from tests.llm.test_operators import same, token_ids


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in table(spark, SF001, "documents").select("doc_id", "text").collect()]


def result(spark, name):
    return QUERIES[name](spark, SF001).collect()


def test_op1(spark, docs):
    same([(r.doc_id, r.base_sha256) for r in result(spark, "op1_pii")], [(i, brute.sha(brute.pii(t))) for i, t in docs])


def test_op3(spark, docs):
    same([tuple(r) for r in result(spark, "op3_substring_dedup")],
         [(*r[:3], brute.sha(r[3])) for r in brute.word_dedup(docs, 50)])


def test_op4(spark, docs):
    items = [tuple(r) for r in table(spark, SF001, "benchmark").select("item_id", "text").collect()]
    near = dict(brute.near(docs, items, 10, 20))
    same([tuple(r) for r in result(spark, "op4_decontaminate")],
         [(i, n, hit, len(x), brute.sha(",".join(x)), hit > 0, len(near[i])) for i, n, hit, x in brute.hits(docs, items, 10)])


def test_op5(spark, docs):
    same([tuple(r) for r in result(spark, "op5_suffix_dedup")],
         [(*r[:4], brute.sha(r[4])) for r in brute.byte_dedup(docs, 400)])


def test_op6(spark, docs):
    got = result(spark, "op6_quality")
    same([tuple(r[:6]) for r in got], [(i, *brute.counts(t)) for i, t in docs])
    assert all(r.base_failed or r.distance is not None for r in got)


def test_op8(spark, docs):
    same([(r.doc_id, r.n_shingles, r.component_id) for r in result(spark, "op8_ngram_join")], brute.classes(docs))


def test_op9(spark, docs):
    brute.pieces_hold(result(spark, "op9_packing"), dict(zip((i for i, _ in docs), token_ids([t for _, t in docs]))), 2048)


def test_op2_op7_op10(spark, docs):
    pages = table(spark, SF001, "pages").select("page_id").collect()
    same([r.page_id for r in result(spark, "op2_html_extract")], [r.page_id for r in pages])
    held = [x for r in result(spark, "op7_token_output") for x in r.doc_ids]
    assert set(held) == {i for i, _ in docs}
    same([r.doc_id for r in result(spark, "op10_toxicity")], [i for i, _ in docs])
