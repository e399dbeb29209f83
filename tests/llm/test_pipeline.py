"""The pipeline's stages on the smallest tables, each against what it should keep."""

from __future__ import annotations

import hashlib
import re

from conftest import SF

import corpus_pipeline
from tessera.llm import pii
from tests.llm import fixtures as X


def test_stages_keep_columns_and_their_decisions_hold(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        at = corpus_pipeline.written(stage(spark, at, SF), "test-stage")
        kept[name] = {r.doc_id: r for r in at.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert at.columns == docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = kept["quality classifier"]
    assert sum((i in good) == bool(r.quality) for i, r in labels.items()) >= 0.95 * len(labels)

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}

    sets = {i: shingles(texts[i]) for i in good}
    near = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    later = {b for _, b in near}
    distinct = set(kept["n-gram Jaccard join"])
    assert set(good) - distinct <= later
    assert not any(a in distinct and b in distinct for a, b in near)

    bench = [" ".join(re.findall(r"\w+", r.text.lower())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holding = {i for i in distinct if any(b in " ".join(re.findall(r"\w+", texts[i].lower())) for b in bench)}
    unseen = set(kept["benchmark decontamination"])
    assert not holding & unseen and distinct - unseen == holding
    for i, r in kept["PII"].items():
        assert r.text == pii.redacted(texts[i], pii.spans_of(texts[i]))
    for i, r in kept["byte-level BPE"].items():
        assert r.round_trip and r.decoded_sha256 == hashlib.sha256(kept["PII"][i].text.encode()).hexdigest()
    assert len(corpus_pipeline.run(spark, SF).collect()) == len(kept["byte-level BPE"])


def test_stages_on_awkward_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, rows without doc_id, extra columns with clashing names; and empty tables."""
    item = X.words(77, 40)
    rows = [*X.texts(), (900, X.words(5, 20) + " " + item), (None, X.words(6, 20) + " " + item), (None, "nothing of it"), (901, "mail a.b@c.de")]
    docs = X.documents(spark, rows)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)
    good = corpus_pipeline.good(spark, docs, sf)
    assert good.columns == docs.columns and good.count() == docs.count()  # without labels nothing is rejected
    one = corpus_pipeline.written(corpus_pipeline.distinct(spark, docs, sf), "one")
    ids = [r.doc_id for r in one.collect()]
    assert one.columns == docs.columns and len({i for i in ids if i is not None}) == sum(i is not None for i in ids)
    assert sum(i is None for i in ids) == sum(i is None for i, _ in rows) and {25, 26, 27} <= set(ids) and not {10, 40} & set(ids)
    kept = corpus_pipeline.unseen(spark, docs, sf)
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == docs.columns and len(texts) == len(rows) - 2 and (None, "nothing of it") in texts and (None, None) in texts and 900 not in {i for i, _ in texts}
    assert {r.text for r in corpus_pipeline.redacted(spark, docs, sf).where("doc_id = 901").collect()} == {"mail [EMAIL]"}
    assert corpus_pipeline.tokens(spark, docs, sf).where("not round_trip").count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, X.empty(spark), sf).count() == 0
