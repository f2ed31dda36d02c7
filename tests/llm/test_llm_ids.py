"""The pipeline hands its token ids on."""

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from leakscan.llm import bpe, queries

DATA = "/root/testdata/sf0.001"


def test_the_pipeline_returns_token_ids(spark):
    rows = queries.queries()["pipeline"](spark, DATA).collect()
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(ranks)}, special_tokens={})
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    whole = 0
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        text = library.decode(ids)
        assert len(ids) == r.n_tokens and library.encode_ordinary(text) == ids
        whole += text == texts[r.doc_id]
    assert rows and whole > 0.2 * len(rows)  # the others lost windows in stage 3


def test_every_stage_of_the_pipeline_runs_in_small_batches(spark, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(name, None)

    def stage(spark, docs, sf_dir):
        seen.append(spark.conf.get(name, None))
        return docs

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", stage), ("two", stage)])
    assert corpus_pipeline.token_ids(spark, DATA).count() > 0
    assert seen == [str(8 << 20)] * 2 and spark.conf.get(name, None) == before
