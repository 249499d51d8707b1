import test_near_dedup
import test_privacy
import test_tokens

import corpus_pipeline
from embedlab.llm.exact_dedup import drop_exact_duplicates
from embedlab.llm.language import keep_identified
from embedlab.llm.near_dedup import drop_near_duplicates
from embedlab.llm.privacy import redact_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_every_stage_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    extra = [(-1, "123 !!", "en", "s", 6), (-2, None, None, None, None), (-3, "", "en", "s", 0)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    raw = docs.collect()
    stages = dict(corpus_pipeline.STAGES)

    first = stages["language"](spark, docs, folder).select(COLUMNS).collect()
    assert {r.doc_id for r in raw} - {r.doc_id for r in first} == {-1, -2, -3}

    copies = stages["exact_dedup"](spark, spark.createDataFrame(first, docs.schema), folder).collect()
    best = {}
    for r in first:
        best[_fold(r.text)] = max(best.get(_fold(r.text), r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in copies) == sorted(best.values())

    near = stages["near_dedup"](spark, spark.createDataFrame(copies, docs.schema), folder).collect()
    classes = test_near_dedup._classes([(r.doc_id, r.text) for r in copies])
    assert sorted(r.doc_id for r in near) == sorted({c for _, c, _ in classes})
    assert len(near) < len(copies) < len(first)

    clean = stages["personal_data"](spark, spark.createDataFrame(near, docs.schema), folder).collect()
    before = {r.doc_id: r for r in near}
    assert sorted(before) == sorted(r.doc_id for r in clean)
    for r in clean:
        old = before[r.doc_id]
        assert r.n_chars == len(r.text) and (r.lang, r.source) == (old.lang, old.source)
        for start, end, kind in test_privacy._plain(old.text):
            assert f"[{kind.upper()}]" in r.text
            if kind == "email":
                assert old.text[start:end] not in r.text
    assert sum(r.text != before[r.doc_id].text for r in clean) > 0

    packed = stages["packing"](spark, spark.createDataFrame(clean, docs.schema), folder).collect()
    used, least = test_tokens._check_packing(packed, {r.doc_id: r.text for r in clean}, 2048)
    assert used <= least * 1.05 + 1


def test_run_gives_the_packing_of_what_is_left(spark, folder):
    rows = corpus_pipeline.run(spark, folder)
    assert rows.columns[:4] == ["doc_id", "piece", "start", "length"]
    assert 0 < rows.select("doc_id").distinct().count() < spark.read.parquet(f"{folder}/documents.parquet").count()


def test_stages_take_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _nth int, SCORE string"
    rows = [(None, None, None, None, None, 1, "a"), (1, "", "en", "s", 0, 2, "b"), (None, "one text", "en", "s", 8, 3, "c")]
    rows += [(5, "one text", "fr", "s", 8, 4, "d"), (5, "one text", "fr", "s", 8, 4, "d"), (6, "w " * 90_000, "en", "s", 0, 5, "e")]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for step in (keep_identified, drop_exact_duplicates, drop_near_duplicates, redact_documents):
            docs = step(docs)
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        assert sorted((r.doc_id for r in docs.collect()), key=str) == ([5, 6] if data else [])
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == (45 if data else 0)
