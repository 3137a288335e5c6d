import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbspark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(llm, small):
    docs, kept = small, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = llm.createDataFrame(stage(llm, docs, FOLDER).toPandas()) if name == "packing" else stage(llm, docs, FOLDER).cache()
        kept[name] = docs
    return kept


def ids(frame):
    return {r.doc_id for r in frame.select("doc_id").collect()}


def test_stages_follow_each_other(small, stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "pii", "packing"]
    before = ids(small)
    for name in names[:-1]:
        assert stages[name].columns == small.columns and stages[name].schema == small.schema
        assert ids(stages[name]) <= before
        before = ids(stages[name])
    assert ids(stages["packing"]) == before == ids(stages["benchmark_decontamination"])
    assert len(before) > 0.6 * small.count()


def test_pieces_hold_every_token(stages):
    for _, pieces in stages["packing"].toPandas().groupby("doc_id"):
        pieces = pieces.sort_values("start")
        assert (pieces["start"].to_numpy() == np.cumsum(pieces["length"]) - pieces["length"]).all()
        assert pieces["length"].sum() == pieces["doc_tokens"].iloc[0]


def test_run_is_the_stages_in_turn(llm, stages):
    got = corpus_pipeline.run(llm, FOLDER).drop("ids").collect()
    expected = stages["packing"].drop("ids").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, expected))


def test_clashing_columns_stay(llm, small):
    own = {c: F.lit(f"own {c}") for c in ("score", "hits", "items", "n_hit", "n_words", "pii", "start", "component_id", "fingerprint")}
    docs = small.withColumns(own)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(llm, docs, FOLDER)
        assert done.columns == docs.columns
        row = done.first()
        assert all(row[c] == f"own {c}" for c in own), name


def test_stages_take_odd_rows(llm, odd, empty):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = odd.select(columns)
    for name, stage in corpus_pipeline.STAGES:
        done = stage(llm, docs, FOLDER)
        assert done.count() >= (6 if name == "simhash_near_dedup" else 8), name
        assert stage(llm, empty.select(columns), FOLDER).count() == 0


def test_numbers_of_characters(stages):
    assert stages["pii"].where("n_chars <> length(text)").count() == 0


@pytest.mark.parametrize("name", ["op3_token_counts", "op7_url_filter"])
def test_queries_return_a_row_per_document(llm, name):
    table = "pages" if name.startswith("op7") else "documents"
    rows = llm.read.parquet(f"{FOLDER}/{table}.parquet").count()
    assert QUERIES[name](llm, FOLDER).count() == rows
