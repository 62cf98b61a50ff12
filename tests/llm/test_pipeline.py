"""The pipeline's stages against brute force on the rows that each was given."""

import re

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
from cladewise.llm import decontaminate as dc  # noqa: E402
from cladewise.llm.scratch import materialize  # noqa: E402

from .test_decontaminate import edits  # noqa: E402
from .test_near_dedup import brute  # noqa: E402


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in pipeline.STAGES:
        out = materialize(stage(spark, docs, sf_dir))
        before, after = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}, {r["doc_id"] for r in out.select("doc_id").collect()}
        if name != "packing":
            assert out.columns == columns and after <= set(before)
        if name == "exact_dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", before[i] or ""), i)
            assert after == set(first.values())
        elif name == "near_dedup":
            assert after == {i for i, (_, c) in brute(list(before.items())).items() if i == c}
        elif name == "decontamination":
            items = [dc.words(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            for i in set(before) - after:
                text = dc.words(before[i])
                assert any(edits(w, text) <= int(dc.TOLERANCE * len(w)) for w in items)
            for i in after:
                text = b" ".join(dc.words(before[i]))
                assert not any(b" ".join(w) in text for w in items if len(w) >= dc.LEAST_WORDS)
        elif name == "packing":
            assert after == set(before)
        docs = out
        seen.append(name)
    assert seen == ["quality", "exact_dedup", "near_dedup", "decontamination", "packing"]
