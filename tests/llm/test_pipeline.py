"""The pipeline's stages, each against what it must do to its own input."""

import corpus_pipeline
from rankweave.llm.common import saved

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = saved(stage(spark, docs, SF), name.replace(" ", ""))
        if k < 4:
            assert docs.columns == columns
            kept.append({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
    good, exact, near, cut = kept
    assert len(set(exact.values())) == len(exact) and set(exact.values()) == set(good.values())
    last = {}
    for i, t in good.items():
        last[t] = max(i, last.get(t, i))
    assert set(exact) == set(last.values())
    from tests.llm.test_operators import brute_links, brute_repeats

    links = brute_links([(i, (t or "").encode()) for i, t in exact.items()], 5, 80, 100)
    assert set(near) == {i for i, (_, c) in links.items() if c == i}
    ids = sorted(near)
    spans = brute_repeats([near[i].encode() for i in ids], corpus_pipeline.PASSAGE_BYTES)
    assert set(cut) == set(near)
    for i, (n, gone, _, _) in zip(ids, spans):
        assert 0 <= (n - gone) - len((cut[i] or "").encode()) <= 8
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == set(cut)


def test_stages_on_edges(spark):
    """Null and empty texts, repeated rows, columns named like the operators' own, and no rows at all."""
    long = " ".join(f"word{k}" for k in range(120))
    rows = [(1, None, "en", "x"), (2, "", "en", "x"), (2, "", "en", "x"), (3, long, None, None), (3, long, None, None), (4, long + " tail", "fr", "x"), (5, "  \n", "en", "x"), (None, "no id", "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _id string")
    for name, stage in corpus_pipeline.STAGES[1:]:
        none = stage(spark, docs.limit(0), "")
        assert none.count() == 0
        out = stage(spark, docs, "")
        got = out.collect()
        if name == "packing":
            assert {r.doc_id for r in got} == {1, 2, 3, 4, 5, None} and all(r.length > 0 for r in got)
            break
        assert out.columns == docs.columns and none.columns == docs.columns
        texts = [(r.doc_id, r.text) for r in got]
        if name == "exact dedup":
            # null and empty texts are equal, the largest id stays; so it is of the repeated row
            assert sorted(texts, key=str) == sorted([(2, ""), (3, long), (4, long + " tail"), (5, "  \n"), (None, "no id")], key=str)
        elif name == "near dedup":
            # one document of the group of near copies, the smallest id; texts without words are linked with nothing
            assert {i for i, _ in texts} == {1, 2, 3, 5, None} and (3, long) in texts
        else:
            assert len(texts) == len(rows) and {t for i, t in texts if i == 3} == {""} and (1, None) in texts
