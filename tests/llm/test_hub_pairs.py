"""op3: pairs that round one compares."""

from revkit.llm import near_dedup


def test_a_group_meets_eight_hubs_at_most(spark):
    keyed = spark.sql("SELECT k + 1000L AS key, CAST(k AS INT) AS k, id FROM (SELECT explode(sequence(0, 63)) AS k), (SELECT id FROM range(200))")
    pairs = near_dedup.shared_keys(keyed).where("id <> hub").selectExpr("least(hub, id) a", "greatest(hub, id) b").distinct()
    assert 200 <= pairs.count() <= 8 * 200
