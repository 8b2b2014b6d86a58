"""Results that a tuning setting must not change."""

import random

import pytest

from assayer.llm import mixing, pipeline

from .test_operators import documents, language_rows, texts


@pytest.fixture
def at_setting(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")

    def run(partitions, make):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        return sorted((tuple(r) for r in make().collect()), key=repr)

    yield run
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("cut", [True, False])
def test_mix_at_any_number_of_partitions(spark, at_setting, cut):
    rng = random.Random(2)
    rows = [(i, t, "en", rng.choice(["a", "a", "a", "b", "c", None])) for i, t in enumerate(texts(300))] + [(None, None, None, "a"), (7, "", None, "b")]
    docs = documents(spark, rows)
    found = [at_setting(n, lambda: mixing.mix(docs, cut=cut)) for n in (1, 8, 40)]
    assert found[0] == found[1] == found[2]
    assert len(found[0]) == len(rows)


def test_pipeline_at_any_number_of_partitions(spark, at_setting):
    rng = random.Random(8)
    rows = [(i, t, lang, rng.choice("abc"), len(t)) for i, t, lang in language_rows(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    def run():
        out = docs
        for _, stage in pipeline.STAGES[:-1]:
            out = stage(spark, out, "unused").persist()
        return out

    assert at_setting(3, run) == at_setting(20, run)
