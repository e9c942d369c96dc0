"""What a voting round may not do on a large graph."""

from pyspark.sql import functions as F

from quillgraph.operators import aggregation, linalg, strength
from quillgraph.storage import materialize


def test_rounds_broadcast_nothing(spark):
    """Neither votes nor states go through the driver, however few of them are left."""
    rows = [(a, b, -1.0) for a in range(9) for b in range(9) if a != b] + [(a, a, 8.0) for a in range(9)]
    lap = materialize(spark.createDataFrame(rows, "i long, j long, v double"), "lap")
    tied = materialize(strength.scale(strength.weights(lap), "max"), "tied")
    states = materialize(aggregation.initial(linalg.vertices(lap)).withColumn("sum", F.lit(1.0)), "states")
    votes = materialize(aggregation.vote(tied, states, 0.5), "votes")
    for df in (aggregation.vote(tied, states, 0.5), aggregation.one_round(states, votes, 0.5, True), aggregation.one_round(states, votes, 0.5, False),
               aggregation.reject_large(states, tied, 2), aggregation.restriction(states)):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
