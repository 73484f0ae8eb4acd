"""The stages on sf0.001, each judged on its own input by brute force."""

import corpus_pipeline as P
from comboscore.llm.queries import table
from tests.conftest import SF001
from tests.llm import brute


def test_stages(spark):
    docs = table(spark, SF001, "documents").withColumnRenamed("lang", "stage_lang")
    toxic = {r.doc_id for r in table(spark, SF001, "labels").where("toxic = 1").collect()}
    items = [tuple(r) for r in table(spark, SF001, "benchmark").select("item_id", "text").collect()]
    stage = dict(P.STAGES)
    clean = stage["toxicity"](spark, docs, SF001).cache()
    assert clean.columns == docs.columns
    before, after = ({r.doc_id: r.text for r in d.collect()} for d in (docs, clean))
    assert all(before[i] == t for i, t in after.items())
    gone = set(before) - set(after)
    assert len(gone - toxic) <= 0.02 * len(before)

    kept = stage["ngram_join"](spark, clean, SF001).cache()
    want = {d for d, n, c in brute.classes(list(after.items())) if not n or d == c}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want

    free = stage["decontaminate"](spark, kept, SF001).cache()
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert {r.doc_id for r in free.collect()} == {d for d, _, hit, _ in brute.hits(rows, items, 10) if not hit}

    safe = stage["pii"](spark, free, SF001).cache()
    assert safe.columns == docs.columns and safe.count() == free.count()
    assert not any(brute.pii(r.text) for r in safe.collect())
    assert all(r.n_chars == len(r.text) for r in safe.collect())
    same = {r.doc_id: r.text for r in safe.collect()}
    assert all(same[r.doc_id] == r.text for r in free.collect() if not brute.pii(r.text) and "[" not in same[r.doc_id])

    from tests.llm.test_operators import token_ids
    rows = safe.collect()
    ids = dict(zip((r.doc_id for r in rows), token_ids([r.text for r in rows])))
    brute.pieces_hold(stage["packing"](spark, safe, SF001).collect(), ids, 2048)


def test_run(spark):
    out = P.run(spark, SF001)
    assert out.columns[:4] == ["doc_id", "start", "length", "ids_crc32"] and out.count() > 0
