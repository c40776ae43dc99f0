import pytest
from pyspark.sql import functions as F

from gleaner.llm import exact_dedup


@pytest.fixture
def sides(monkeypatch):
    """The most digests in a bucket, of the history and of the arriving side, and the digests of the history."""
    found, build, search = {}, exact_dedup.build_index, exact_dedup.look_up

    def most(df, buckets):
        sizes = [r["count"] for r in df.groupBy(exact_dedup.bucket(F.col("digest"), buckets)).count().collect()]
        return max(sizes, default=0), sum(sizes)

    def built(history, buckets):
        found["history"] = most(history, buckets)
        return build(history, buckets)

    def searched(arriving, index, buckets):
        found["arriving"] = most(arriving, buckets)
        return search(arriving, index, buckets)

    monkeypatch.setattr(exact_dedup, "BUCKET_KEYS", 20)
    monkeypatch.setattr(exact_dedup, "build_index", built)
    monkeypatch.setattr(exact_dedup, "look_up", searched)
    return found


def texts_with(spark, ids):
    return spark.createDataFrame([(i, f"text {n // 2}") for n, i in enumerate(ids)], "doc_id long, text string")


def test_one_low_id_leaves_half_of_the_table_as_history(spark, sides):
    got = exact_dedup.decided(texts_with(spark, [-10 ** 15, *range(399)])).collect()
    assert sum(r.stays for r in got) == 200 and {r.group_size for r in got} == {2}
    assert sides["history"][1] >= 90 and sides["arriving"][1] >= 90
    assert sides["history"][0] <= 60 and sides["arriving"][0] <= 60


@pytest.mark.parametrize("ids, historical", [([None] * 400, None), (range(400), "false"), (range(400), "doc_id < 4"), (range(400), "doc_id >= 4")])
def test_buckets_stay_small_beside_a_small_side(spark, sides, ids, historical):
    got = exact_dedup.decided(texts_with(spark, ids), historical and F.expr(historical)).collect()
    assert {r.group_size for r in got} == {2} and len({r.digest for r in got}) == 200
    assert sides["history"][0] <= 60 and sides["arriving"][0] <= 60
