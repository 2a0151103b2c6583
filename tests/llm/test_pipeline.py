import corpus_pipeline as cp
import public_tokenizers as pt
from pyspark.sql import functions as F

from htmlframe.llm import packing, quality, simhash, toxicity
from tests.llm.test_pairs import plain_components, plain_removed, plain_simhash


def test_stages_keep_what_they_should(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    now = docs
    for number, (name, stage) in enumerate(cp.STAGES):
        before = {r.doc_id: r.text for r in now.select("doc_id", "text").collect()}
        stage(spark, now, sf).write.parquet(f"{tmp_path}/{number}")
        after = spark.read.parquet(f"{tmp_path}/{number}")
        if number < 4:
            assert after.columns == docs.columns
            got = {r.doc_id: r.text for r in after.select("doc_id", "text").collect()}
        if name == "quality classifier":
            model = quality.fit(docs, labels)
            want = {k: t for k, t in before.items() if model.score(t) >= 0.5}
        elif name == "toxicity":
            model = toxicity.fit(docs, labels)
            want = {k: t for k, t in before.items() if model.score(t) < toxicity.THRESHOLD}
        elif name == "line dedup":
            gone = plain_removed(list(before.items()))
            want = {k: "\n".join(x for i, x in enumerate(t.split("\n")) if (k, i) not in gone) for k, t in before.items()}
            want = {k: t for k, t in want.items() if t == before[k] or t.strip(" ")}
            assert after.where(F.char_length("text") != F.col("n_chars")).count() == 0
        elif name == "SimHash near-dedup":
            want = {k: before[k] for k, _, c in plain_components([(k, plain_simhash(t)) for k, t in before.items()]) if k == c}
        else:
            assert {r.doc_id for r in after.select("doc_id").collect()} == set(before)
            lengths = [r.length for r in packing.cut_documents(now, pt.path("word_bpe_49k.json")).collect()]
            assert sorted(lengths) == sorted(r.length for r in after.collect())
            assert after.select("sequence_id").distinct().count() <= -(-sum(lengths) // 4096) + 1
            continue
        assert got == want, name
        assert 0 < len(got) <= len(before)
        now = after


def test_run_and_odd_documents(spark, sf, tmp_path):
    a = sorted(map(tuple, cp.run(spark, sf).select("doc_id", "piece", "length").collect()))
    assert len(a) > 50
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (None, "", None, None, None), (2, "some words stand here in a line", "en", "s", 31), (2, "some words stand here in a line", "en", "s", 31)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in cp.STAGES:
        if name != "best-fit packing":
            assert set(stage(spark, docs, sf).columns) == set(docs.columns)
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert simhash.drop_near_duplicates(docs).count() == 2


def test_clashing_columns(spark, sf):
    """Columns besides those of documents may have any names, such as those that the operators use."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    more = docs.selectExpr("*", "1 as id", "2 as doc_", "3 as th_", "4 as gone_", "5 as lost_", "6 as lost_th_", "7 as line", "8 as th", "9 as fp", "10 as n_removed", "11 as score")
    for name, stage in cp.STAGES:
        got, want = (sorted(map(tuple, stage(spark, x, sf).select("doc_id", *(["piece", "length"] if name == "best-fit packing" else docs.columns[1:])).collect()), key=str) for x in (more, docs))
        assert got == want


def test_very_long_texts(spark, sf):
    """A text of 150,000 words passes every stage whole."""
    text = "\n".join(" ".join(f"wort{(i * 7919 + j * 104729) % 99991}" for j in range(60)) for i in range(2500))
    docs = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, "a short text of its own", "en", "s", 23)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in cp.STAGES[2:]:
        got = stage(spark, docs, sf)
        if name == "best-fit packing":
            assert got.where("doc_id = 1").agg(F.sum("length")).first()[0] > 150_000
        else:
            assert {r.doc_id: r.text for r in got.collect()}[1] == text
