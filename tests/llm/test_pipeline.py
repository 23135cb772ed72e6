"""The pipeline's stages, each held against plain Python on what its predecessor kept."""

from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from shopweave.llm import budget
from shopweave.llm.common import Shared
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "mixture", "tokens"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = Shared(spark, "t").table(stage(spark, docs, SF), name)
        kept[name] = docs.collect()
        assert docs.columns == columns or name == "tokens"
    ids = {name: {r.doc_id for r in rows} for name, rows in kept.items()}
    assert len(ids["language"]) >= 0.97 * len(ids["documents"])
    before = [(r.doc_id, r.text) for r in kept["language"]]
    assert ids["exact_dedup"] == {k for _, k, _, _ in brute.exact(before)}
    before = [(r.doc_id, r.text) for r in kept["exact_dedup"]]
    assert ids["near_dedup"] == {i for i, _, c in brute.near(before, 5, 80) if i == c}
    before = [(r.doc_id, r.text, r.lang, r.source) for r in kept["near_dedup"]]
    assert Counter((i, 1) for i in ids["mixture"]) == brute.mix(before, corpus_pipeline.MIX_BUDGET, 1, budget.WEIGHTS, budget.SEED)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in kept["mixture"]}
    assert ids["tokens"] == ids["mixture"]
    for r in kept["tokens"]:
        want = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want) and r.decoded_sha256 == brute.sha(library.decode(want, skip_special_tokens=False))
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == Counter(ids["tokens"])


def test_cases(spark, docs, empty):
    for frame in (docs, empty):
        for name, stage in corpus_pipeline.STAGES:
            frame = Shared(spark, "t").table(stage(spark, frame, SF), name)
            assert name == "tokens" or frame.columns == docs.columns
