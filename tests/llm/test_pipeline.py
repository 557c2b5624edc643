"""The pipeline's contract on the smallest documents."""

import corpus_pipeline
from placewright.llm import toxicity
from placewright.llm.queries import ORACLES, QUERIES
from placewright.llm.staging import staged


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "suffix_dedup", "packing"]
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = staged(stage(spark, docs, sf_dir), name)
        assert after.columns == columns and dict(after.dtypes) == dict(docs.dtypes)
        ids = [r["doc_id"] for r in after.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= {r["doc_id"] for r in docs.select("doc_id").collect()}
        sizes.append(len(ids))
        docs = after
    assert before > sizes[0] == sizes[1] >= sizes[2] == sizes[3]
    assert docs.where("length(text) <> n_chars").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == sizes[-1]
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert model is None or toxicity.scores(docs, model).count() == sizes[-1]


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_stages_keep_columns_of_any_name(spark, sf_dir):
    """Every name that a stage gives a column of its own, nulls, repeated rows, and no rows at all."""
    names = "_gone _of _body _ranges _blocks _block ranges body keys key n at h1 h2 class_id id all wanted times".split()
    text = "one line of words that is long enough to be told from all others\nand a second line with other words in it, for good measure\n"
    rows = [(1, text, 2), (1, text, 2), (2, text + "more words than before stand here", 3), (None, text, 4), (3, None, None), (4, "", 0), (5, "x" * 500, 500), (6, "x" * 500 + " y", 502)]
    docs = spark.createDataFrame([(*r, *names) for r in rows], "doc_id long, text string, n_chars int, " + ", ".join(f"{n} string" for n in names))
    for own in (docs, docs.limit(0)):
        count = own.count()
        for name, stage in corpus_pipeline.STAGES[1:-1]:
            after = stage(spark, own, sf_dir)
            assert after.columns == docs.columns
            got = after.collect()
            assert len(got) <= count and all(r[n] == n for r in got for n in names)
            if name != "near_dedup":
                assert len(got) == count
