"""The pipeline stage by stage against brute force on small documents."""

import re
from collections import Counter
from fractions import Fraction

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from revaxis.llm import pairwise_quality
from test_quality_mix_lines import brute_lines, brute_targets
from test_set_join import brute_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark):
    sf_dir, tables = "/root/testdata/sf0.01", {}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        docs = stage(spark, docs, sf_dir)
        rows = docs.collect()
        if i < 4:
            assert docs.columns == columns
            docs = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
        tables[name] = (before, rows)
    return tables


def test_quality(spark, stages):
    before, after = stages["quality classifier"]
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = pairwise_quality.learn_quality(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels.where(pairwise_quality.training_part(labels["doc_id"])))
    import numpy as np

    scores = model.scores(np.array([pairwise_quality.features(r["text"]) for r in before]))
    assert sorted(map(tuple, after)) == sorted(tuple(r) for r, s in zip(before, scores) if s >= 0.5)
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert sum(quality.get(d) == 1 for d in gone) <= 2 and len(gone) > 20


def test_lines(stages):
    before, after = stages["line dedup"]
    texts = dict(zip((r["doc_id"] for r in before), brute_lines([(r["source"], r["text"]) for r in before], 0.02, 5)))
    assert {r["doc_id"]: r["text"] for r in after} == texts
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_near_duplicates(stages):
    before, after = stages["n-gram Jaccard join"]
    found = brute_components([r["doc_id"] for r in before], [r["text"] for r in before], 5, Fraction(4, 5))
    assert sorted(r["doc_id"] for r in after) == sorted({c for _, n, c in found if n} | {d for d, n, _ in found if not n})
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_mix(stages):
    before, after = stages["mixing sources to target weights"]
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in before}
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r["source"]] += size[r["doc_id"]]
    for r in after:
        taken[r["source"]] += size[r["doc_id"]]
    for source, target in brute_targets(sizes).items():
        assert taken[source] == pytest.approx(target, rel=0.5)
    assert max(Counter(r["doc_id"] for r in after).values()) <= 3
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_encoding(stages):
    before, after = stages["BPE encoding and decoding"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert Counter(r["doc_id"] for r in before) == Counter(r["doc_id"] for r in after)
    texts = {r["doc_id"]: r["text"] for r in before}
    for r in after[:300]:
        assert r["text"] == texts[r["doc_id"]]
        assert r["n_tokens"] == len(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids)


def test_odd_documents(spark, tmp_path):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "s", 0), (2, "word " * 40_000, "en", "s", 200_000)] + [
        (i, f"the quiet river number{i} runs far, past hills{i} and slow fields.", "en", "s", 10) for i in range(3, 30)]
    for name, docs in (("some", spark.createDataFrame(rows, SCHEMA)), ("none", spark.createDataFrame([], SCHEMA))):
        folder = tmp_path / name
        docs.write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([(3, 1, 0), (2, 0, 0)] if name == "some" else [], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        assert corpus_pipeline.run(spark, str(folder)).count() >= (5 if name == "some" else 0)


def test_a_group_of_copies_keeps_one_text(spark):
    """Exact and near copies above 2 % of a source lose the source's boilerplate and nothing else."""
    def body(name, lines=24):
        return [" ".join(f"{name}w{i}x{k}" for k in range(12)) for i in range(lines)]

    def near(i):
        lines = body("near")
        lines[i % 24] = lines[i % 24].replace("x5", f"edit{i}")
        return lines

    texts = [body(f"own{i}", 4) for i in range(200)] + [body("exact")] * 30 + [near(i) for i in range(30)]
    texts = ["\n".join([*lines, "all rights reserved"]) for lines in texts]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    clean = corpus_pipeline.without_boilerplate(spark, docs, "")
    rows = sorted(clean.collect())
    assert [r["text"] for r in rows] == [t.removesuffix("\nall rights reserved") for t in texts]
    clean = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    assert [r["doc_id"] for r in sorted(corpus_pipeline.distinct_documents(spark, clean, "").collect())] == [*range(201), 230]
