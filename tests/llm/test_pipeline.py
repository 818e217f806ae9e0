"""The pipeline as a whole, and the registered queries against their SQL twins."""

from __future__ import annotations

import base64
import hashlib

import brute
import numpy as np
import oracle
import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from pricetide import llm
from pricetide.llm import bpe
from pricetide.session import cut_lineage

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_against_sql(spark, name):
    assert oracle.differences(llm.queries()[name](spark, SF), llm.oracle_sql()[name], oracle.connect(SF)) == []


def test_registration():
    names = entry.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 14))


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, SF))
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and 0 < counts[-1] < counts[0]
    left = {r.doc_id: r for r in docs.collect()}
    codec = bpe.Codec(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN)
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in out} == {d: len(codec.encode(r.text)) // 4 for d, r in left.items()}
    assert all(r.n_chars == len(r.text) for r in left.values())


def test_run_against_brute_force(spark):
    """After the quality rules (held against brute force by their own test), each stage by plain Python."""
    rows = corpus_pipeline.quality_rules(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).select("doc_id", "text").collect()
    texts = brute.left_lines({r.doc_id: r.text for r in rows})
    kept = {d for d, (_, _, stays) in brute.near_duplicates(texts, corpus_pipeline.NEAR_PERCENT).items() if stays}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    leaked = {d for d, _ in brute.overlaps({d: texts[d] for d in kept}, items)}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda data: hashlib.sha256(data).hexdigest()
    want = set()
    for d in kept - leaked:
        ids = np.array(library.encode_ordinary(texts[d] or ""), "<u4")
        want.add((d, len(ids), sha(ids.tobytes()), sha((texts[d] or "").encode())))
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == want


@pytest.mark.parametrize("stage", range(4))
def test_stages_take_awkward_rows(spark, stage):
    """Nulls in any column, repeated rows, very long texts, extra columns with clashing names, empty tables."""
    prose = " ".join(f"plain{k} words of a story number {k * 7}" for k in range(40))
    rows = [(None, None, None, None, 1, "k"), (1, "", "en", "s", 2, None), (2, prose, None, None, 3, "k"), (2, prose, None, None, 3, "k"), (3, "z" * 200_000, "en", "s", 4, "k"), (4, "\n" * 50_000, "en", "s", 5, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, kept string")
    name, run = corpus_pipeline.STAGES[stage]
    for frame in (docs, docs.limit(0)):
        out = run(spark, frame, SF)
        assert out.columns == docs.columns
        found = out.collect()
        assert {r.doc_id for r in found} <= {r.doc_id for r in frame.collect()}
    assert run(spark, docs.limit(0), SF).count() == 0
    assert stage == 0 or any(r.text == prose for r in run(spark, docs, SF).collect())  # invented words are no prose to the quality rules


def test_near_copies_at_four_fifths_go(spark):
    words = [f"w{i}" for i in range(104)]  # 100 shingles; two words changed far apart cost ten of them
    changed = [f"new{i}" if i in (30, 60) else w for i, w in enumerate(words)]  # 90 of 110 are common: 0.82
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(reversed(words)))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == [1, 3]
