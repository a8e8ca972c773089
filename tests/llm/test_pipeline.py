from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from chronolith.llm import packing, pii

from . import cases
from .test_corpus_operators import edited, plain_components
from .test_text_operators import plain_bayes

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def written_documents(spark, rows, folder) -> str:
    spark.createDataFrame([(i, t, "en" if k % 3 else None, "s", len(t or "")) for k, (i, t) in enumerate(rows)], DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def plain_run(rows) -> Counter:
    found = plain_bayes([(i, t, "en" if k % 3 else None) for k, (i, t) in enumerate(rows)])
    rows = [r for r, (lang, _, evidence) in zip(rows, found, strict=True) if lang != "und" and evidence > 0]
    largest: dict[str, int | None] = {}
    for i, t in rows:
        key = cases.lowered(t)
        largest[key] = max((x for x in (largest.get(key), i) if x is not None), default=None)
    rows = [(i, t) for i, t in rows if i is None or largest[cases.lowered(t)] == i]
    named = plain_components(rows)
    kept = {i for (i, _, c) in named if i == c or i is None}
    rows = [(i, t) for i, t in rows if i in kept]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    out: Counter = Counter()
    model = pii.fit([tuple(x) for x in Counter((k, code, shape) for _, t in rows for k, _, _, _, code, shape in pii.candidates(t)).items() for x in [(*x[0], x[1])]])
    for i, t in rows:
        ids = [*tokenizer.encode(pii.mask(t, model), add_special_tokens=False).ids, 1]
        out.update((i, n, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for n, s in enumerate(range(0, len(ids), 4096)))
    return out


def test_pipeline_equals_plain_steps(spark, tmp_path):
    rnd = random.Random(4)
    rows = list(cases.TEXTS)
    for k in range(30):
        base = cases.prose(300 + k % 10, 90)
        rows.append((100 + k, edited(base, rnd, 0.01) + (f" write to p{k}@example.org" if k % 4 == 0 else "")))
    got = corpus_pipeline.run(spark, written_documents(spark, rows, tmp_path))
    assert Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in got.collect()) == plain_run(rows)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, written_documents(spark, [], tmp_path)).count() == 0


def test_stages_keep_the_columns(spark, tmp_path):
    folder = written_documents(spark, cases.TEXTS, tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).schema.simpleString() == docs.schema.simpleString()
