import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortloom import storage
from cohortloom.llm import collocations, importance, set_join, token_file

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def _largest(df):
    """Bytes of the largest batch that a Python worker is handed."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["bytes"])

    return df.mapInArrow(run, "bytes long").agg(F.max("bytes")).first()[0]


def test_batches_are_bounded_and_the_setting_comes_back(spark):
    docs = spark.range(0, 6000, 1, 1).select("id", F.repeat(F.lit("word "), 400).alias("text"))
    assert _largest(docs) > 10_000_000
    with pytest.raises(ZeroDivisionError), storage.bounded_batches(spark):
        assert _largest(docs) < 1.1 * storage.BATCH_BYTES
        1 / 0
    assert spark.conf.get(KEY, None) is None
    spark.conf.set(KEY, "1m")
    try:
        with storage.bounded_batches(spark):
            assert spark.conf.get(KEY) == "1m"
        assert spark.conf.get(KEY) == "1m"
    finally:
        spark.conf.unset(KEY)


@pytest.mark.parametrize("module,step", [(collocations, "words"), (collocations, "stripes"), (set_join, "_signatures"),
                                         (set_join, "_sets"), (importance, "fit"), (token_file, "tokenise")])
def test_text_operators_bound_their_batches(spark, monkeypatch, tmp_path, module, step):
    docs = spark.createDataFrame([(i, f"some words {i} and more words of a text", "en") for i in range(6)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    found, plain = [], getattr(module, step)

    def watched(df, *args, **more):
        found.append(df.sparkSession.conf.get(KEY, None))
        return plain(df, *args, **more)

    monkeypatch.setattr(module, step, watched)
    {collocations: lambda: collocations.mine(docs, least=1), set_join: lambda: set_join.link_components(docs),
     importance: lambda: importance.classify(docs, labels, F.col("quality") == 1),
     token_file: lambda: token_file.write(docs, str(tmp_path / "file"), "byte_bpe_50k.json")}[module]()
    assert found and set(found) == {str(storage.BATCH_BYTES)}
    assert spark.conf.get(KEY, None) is None
