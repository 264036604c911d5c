"""The corpus pipeline's stages on their own input, and as a whole."""

from __future__ import annotations

import corpus_pipeline
import pytest
from helpers import DATA, components, shingles
from test_llm_joins import contaminated, linked
from test_llm_tokens import packed_whole

SF = str(DATA / "sf0.001")


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What each stage is given, and last what the last returns."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(docs)
        path = f"file://{tmp_path_factory.mktemp('stages')}/{k}"
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
    return [*out, docs]


def rows(df):
    return sorted(map(repr, df.select("doc_id", "text").collect()))


def test_columns_stay(kept):
    assert all(df.columns == kept[0].columns for df in kept[:-1])


def test_toxic_documents_go_and_few_others(spark, kept):
    assert set(rows(kept[1])) <= set(rows(kept[0]))
    # The smallest tables have 11 toxic labels, too few to learn from; these have about ten times as many.
    sf = str(DATA / "sf0.01")
    left = {r.doc_id for r in corpus_pipeline.toxicity(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    toxic, clean = ({d for d, y in labels.items() if y == k} for k in (1, 0))
    assert len(toxic & left) <= 0.1 * len(toxic) and len(clean & left) >= 0.97 * len(clean)


def test_lines_go_and_documents_keep_the_rest(kept):
    before = {r.doc_id: (r.text or "").split("\n") for r in kept[1].collect()}
    for r in kept[2].collect():
        lines = iter(before[r.doc_id])
        assert all(x in lines for x in (r.text or "").split("\n")) and (r.text is None or r.n_chars == len(r.text))


def test_one_near_copy_stays(kept):
    before, after = ([(r.doc_id, r.text) for r in df.collect()] for df in kept[2:4])
    sets = [shingles(t) for _, t in before]
    parts = components(sets, linked)
    smallest: dict[int, int] = {}
    for (d, _), p in zip(before, parts, strict=True):
        smallest[p] = min(d, smallest.get(p, d))
    assert sorted(d for d, _ in after) == sorted(smallest[p] if s else d for p, (d, _), s in zip(parts, before, sets, strict=True) if not s or smallest[p] == d)


def test_contaminated_documents_go(spark, kept):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [d for d, _, hits, _ in contaminated([(r.doc_id, r.text) for r in kept[3].collect()], items) if not hits]
    assert sorted(str(r.doc_id) for r in kept[4].collect()) == sorted(clean)


def test_every_document_left_is_packed(kept):
    pieces = kept[5].collect()
    packed_whole(pieces, 2048)
    assert {r.doc_id for r in pieces} == {r.doc_id for r in kept[4].collect()}


def test_run_gives_the_rows_of_the_stages(spark, kept):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(repr, corpus_pipeline.run(spark, SF).select(*columns).collect())) == sorted(map(repr, kept[5].select(*columns).collect()))
