import pytest

from paperlake.llm.common import batches_of, stored

SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_rows_at_a_time_are_bounded_only_inside(spark):
    before = spark.conf.get(SETTING)

    def sizes(batches):
        for batch in batches:
            yield batch.slice(0, 1)

    rows = spark.range(2500).repartition(1).mapInArrow(sizes, "id long")
    assert stored(rows, "batches", 1000).count() == 3 and stored(rows, "batches").count() == 1
    with pytest.raises(RuntimeError), batches_of(spark, 10):
        raise RuntimeError
    assert spark.conf.get(SETTING) == before
