"""The pipeline: order, columns, effect of each stage against brute force, and odd rows in every stage."""

import re
from fractions import Fraction

import corpus_pipeline
from kinweave.llm import line_quality, stages
from kinweave.llm.queries import held_out
from kinweave.operators.skew import cut
from tests.llm.test_pairs import brute

SF = "/root/testdata/sf0.001"


def test_stages_on_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "ngram_jaccard", "decontamination", "secret_scan", "best_fit_packing"]
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(cut(stage(spark, seen[-1], SF)))
    good, single, clean, masked, packed = seen[1:]
    assert all(d.columns == columns for d in (good, single, clean, masked))

    model = line_quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet").where(~held_out()))
    accepted = {r.doc_id for r in line_quality.score(docs, model).where("score >= 0.7").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in good.collect()} == accepted
    roots = brute([(i, texts[i]) for i in accepted], 5, Fraction("0.8"))
    kept = {i for i in accepted if roots[i] == i}
    assert {r.doc_id for r in single.collect()} == kept

    plain = lambda t: " ".join((t or "").lower().split())
    items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {i for i in kept if not any(x in plain(texts[i]) for x in items)}
    assert {r.doc_id for r in clean.collect()} == left
    secret = re.compile(r'token = "[0-9a-f]{40}')
    for r in masked.collect():
        assert not secret.search(r.text) and r.n_chars == len(r.text)
        assert r.text == secret.sub("[SECRET]", texts[r.doc_id])
    assert {r.doc_id for r in packed.collect()} == left
    again = corpus_pipeline.run(spark, SF)
    assert again.columns == packed.columns and again.count() == packed.count()


def test_odd_rows_pass_through_every_stage(spark):
    rows = [(None, "some words of a text without an id", "en", "s", None), (1, None, None, None, None), (2, "", "en", "s", 0), (3, "same text here", "en", "s", 14),
            (3, "same text here", "en", "s", 14), (4, "long " * 200_000 + "end.", "en", "s", 1_000_004)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for docs, least in ((spark.createDataFrame(rows, schema), 1), (spark.createDataFrame([], schema), 0)):
        for stage in (stages.quality, stages.near_duplicates, stages.decontaminated, stages.redacted):
            out = stage(spark, docs, SF)
            n = out.count()
            assert out.columns == docs.columns and (n <= 6 if stage is stages.quality else n == 6 * least)
        assert (stages.packed(spark, docs, SF).count() > 0) == bool(least)


def test_every_numbered_operator_has_its_query():
    from kinweave.llm.queries import QUERIES

    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 11))
