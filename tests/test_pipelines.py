from shelfspark import fixtures as X
from shelfspark.plans.pipelines import ingest_pipeline
from tests.conftest import SF_SMALL


def test_descriptions_hold_the_whole_text(spark):
    texts = {r["file_id"]: r["extracted_text"] for r in X.raw_files(spark, SF_SMALL).select("file_id", "extracted_text").collect()}
    assert max(map(len, texts.values())) > 120
    for chars in (None, 120):
        got = ingest_pipeline(spark, SF_SMALL, **({} if chars is None else {"description_chars": chars}))
        rows = got.select("file_id", "routed_to", "description").collect()
        assert len(rows) == len(texts)
        assert all(r["description"] == texts[r["file_id"]][:chars] + "。" + r["routed_to"] for r in rows)
