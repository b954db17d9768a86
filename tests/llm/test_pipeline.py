"""The pipeline's stages against brute force, from the stored tables to the token digests."""

import hashlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from quantloom.llm import queries
from quantloom.session import materialize

from .test_operators import components_by_force, near_copies


def test_stages_and_run(spark, documents, labels_of, tmp_path):
    good = near_copies(8, 25, 90, 4) + [f"{text}. plain" for text in near_copies(9, 20, 60, 60)]
    texts = good + ["SPAM!! NOW!! " * 50] * 12
    docs = documents(texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels_of([(i, int(i < len(good)), 0) for i in range(len(texts))]).write.parquet(f"{tmp_path}/labels.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(materialize(stage(spark, kept[-1], str(tmp_path)), name))
    for result in kept[1:-1]:
        assert result.columns == docs.columns
    assert sorted(r.doc_id for r in kept[1].collect()) == list(range(len(good)))
    leaders = sorted({root for _, _, root in components_by_force(good, 5, 80)})
    assert sorted(r.doc_id for r in kept[2].collect()) == leaders
    assert {r.doc_id for r in kept[3].collect()} <= set(leaders)
    library = Tokenizer.from_file(queries.BPE_FILE)
    for row in kept[4].collect():
        ids = library.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()
    assert sorted(corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(kept[4].collect())


def test_rows_without_id_text_or_words(spark, documents):
    docs = documents(["a b c d e f", None, "", "a b c d e f", "a b c d e f", " ", "x y z"], [1, 2, 3, 1, None, None, None])
    kept = corpus_pipeline.near_copies(spark, docs, "").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept if r.doc_id is not None) == [
        (False, 1, "a b c d e f"), (False, 2, ""), (False, 3, ""),
    ]
    assert {"x y z", " "} <= {r.text for r in kept if r.doc_id is None}
