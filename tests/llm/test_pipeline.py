"""The pipeline's stages one after the other against what they must do to a small table."""

import random

import pytest

import corpus_pipeline
from panelmark.llm import mixing, pieces, simhash
from panelmark.llm.common import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join(f"w{min(int(rng.expovariate(0.01)), 900)}" for _ in range(n))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    good = [words(rng, rng.randrange(30, 90)) for _ in range(150)]
    bad = [" ".join(w.upper() + "!!" for w in words(rng, 40).split()) for _ in range(50)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate([*good, *bad])]
    long = words(rng, 3000).split()
    near = " ".join([*long[:1500], "changed", *long[1501:]])
    more = [good[0], good[0] + "  ", good[1], " ".join(long), near, None, ""]
    rows += [(200 + i, t, None, None, 0) for i, t in enumerate(more)] + [(None, good[2], "en", "s1", 0), (5, good[5], "en", "s2", 0)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 150), 0) for i in range(200)] + [(7, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def test_stages(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "SimHash near-dedup", "mixing sources to target weights", "SentencePiece encoding"]
    kept = [docs.collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept.append(docs.collect())
    first, quality, exact, near, mixed, ids = kept
    texts = lambda rows: {r.text or "" for r in rows}
    assert not any("!!" in t for t in texts(quality)) and len(quality) >= len([r for r in first if "!!" not in (r.text or "")]) - 5
    strip = lambda t: "".join((t or "").split())
    assert sorted(strip(r.text) for r in exact) == sorted({strip(r.text) for r in quality})
    prints = [simhash.fingerprint((r.text or "").encode()) for r in near]
    assert all((a ^ b) & (2**64 - 1) and ((a ^ b) & (2**64 - 1)).bit_count() > 3 for i, a in enumerate(prints) for b in prints[i + 1 :])
    assert not {203, 204} <= {r.doc_id for r in near} and {203, 204} & {r.doc_id for r in near}
    # of clean documents nothing but copies is lost before mixing
    assert {strip(t) for t in texts(quality)} - {strip(t) for t in texts(near)} <= {strip(r.text) for r in first if r.doc_id == 204}
    size = lambda rows: sum(len((r.text or "").split()) for r in rows)
    assert abs(size(mixed) - 1.5 * size(near)) < 0.5 * size(near) and texts(mixed) <= texts(near)
    table_ = pieces.Pieces.load()
    by_id = {r.doc_id: r.text or "" for r in mixed}
    assert len(ids) == len(mixed) and all(table_.decode(list(r.ids)) == by_id[r.doc_id] and r.n_tokens == len(r.ids) for r in ids)


def test_run_is_the_stages(spark, sf_dir):
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "ids", "n_tokens"]


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_mix_repeats_rows_with_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", 1), (1, "a b c", "x", 2), (2, "d", "y", 3)], "doc_id long, text string, source string, times int")
    taken = spark.createDataFrame([(1, 3, 6), (1, 3, 0), (2, 1, 1)], "doc_id long, size long, taken long")
    out = mixing.repeated(docs, taken)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 1, 2]
