"""The pipeline's stages on a small corpus, each held against its operator."""
import corpus_pipeline as P
from driftwatch.llm import queries
from driftwatch.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark, docs, tmp_path):
    df, kept = docs, {}
    for name, stage in P.STAGES[:-1]:
        stage(spark, df, SF).write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        assert df.columns == docs.columns
        kept[name] = {(r["doc_id"], r["text"]) for r in df.collect()}
        assert df.count() == len(kept[name]) or name == "quality rules"
    quality, near, cut, clean = (kept[name] for name, _ in P.STAGES[:-1])
    ids = {i for i, _ in quality}
    assert not ids & {400, 401, 402, 403, 404, 408, 409, 410} and set(range(25)) <= ids
    left = {i for i, _ in near}
    assert set(range(25)) <= left and not left & set(range(100, 112)) and not left & set(range(200, 210))
    texts = dict(t for t in cut if t[0] is not None)
    assert all(texts[i] == dict(near)[i] for i in range(25))  # untouched where nothing is repeated
    assert len({texts[i] for i in range(300, 306)}) == 6 and len(texts[301]) < len(dict(near)[301])
    assert clean <= cut
    packed = P.packed(spark, df, SF).collect()
    assert {r["doc_id"] for r in packed} == {i for i, _ in clean}


def test_empty(spark, empty):
    df = empty
    for _, stage in P.STAGES:
        df = stage(spark, df, SF)
    assert df.count() == 0


def test_whole_run(spark):
    assert P.run(spark, SF).count() > 0


def test_every_operator_has_a_query(spark):
    names = sorted(queries.QUERIES)
    assert [n for n in range(1, 11) if not any(x.startswith(f"op{n}_") for x in names)] == [] and "pipeline" in names
    for name in ("op2_url_ratio", "op4_quality_votes", "op5_site_quality", "op6_decontaminate", "op9_interleave"):
        source = "pages" if name.startswith("op2") else "documents"
        assert queries.QUERIES[name](spark, SF).count() == table(spark, SF, source).count()
