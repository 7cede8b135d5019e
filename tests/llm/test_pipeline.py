import pytest
from samples import DATA
from test_nearcopies import first_of_groups
from test_packing import check

import corpus_pipeline
from beaconlake.llm.pii import entities_of

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage keeps, written and read again as the driver does."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [("documents", docs.collect())]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(number))
        stage(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        if number + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == COLUMNS
        out.append((name, docs.collect()))
    return out


def test_order_of_stages(stages):
    assert [n for n, _ in stages[1:]] == ["language", "near_duplicates", "decontamination", "personal_data", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_language_stage_keeps_ordinary_documents(stages):
    assert len(stages[1][1]) >= 0.97 * len(stages[0][1])


def test_one_of_each_group_stays(stages):
    want = first_of_groups({r.doc_id: r.text for r in stages[1][1]})
    assert sorted(r.doc_id for r in stages[2][1]) == want


def test_contaminated_documents_go(stages, spark):
    from test_decontaminate import brute_force

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    found = brute_force([(r.doc_id, r.text) for r in stages[2][1]], items)
    assert any(r[5] for r in found)
    assert sorted(r.doc_id for r in stages[3][1]) == sorted(r[0] for r in found if not r[5])


def test_personal_data_is_replaced(stages):
    before = {r.doc_id: r for r in stages[3][1]}
    after = {r.doc_id: r for r in stages[4][1]}
    assert before.keys() == after.keys()
    for doc_id, r in after.items():
        entities = entities_of(before[doc_id].text)
        assert all(before[doc_id].text[a:b] not in r.text for _, a, b, _ in entities)
        assert r.n_chars == len(r.text) and (entities or r.text == before[doc_id].text)


def test_all_that_is_left_is_packed(stages):
    check(stages[5][1], [(r.doc_id, r.text) for r in stages[4][1]])


def test_run_gives_the_last_stage(spark, stages):
    def pieces(rows):
        return sorted((r.doc_id, r.ids_crc32, r.length) for r in rows)

    total = sum(n for _, _, n in pieces(stages[5][1]))
    assert sum(n for _, _, n in pieces(corpus_pipeline.run(spark, DATA).collect())) == total


def test_odd_rows(spark, odd_documents, no_documents):
    for docs in (odd_documents.select(*COLUMNS), no_documents.select(*COLUMNS)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, DATA)
        docs.collect()
