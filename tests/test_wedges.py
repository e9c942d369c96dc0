"""What counting triangles moves."""

from itertools import combinations

from quillgraph.operators import graph
from quillgraph.storage import materialize


def _moved(spark):
    """Rows written by shuffles so far."""
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    nothing = jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(nothing, False, False, sc._gateway.new_array(jvm.double, 0), nothing)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_triangles_move_no_pair_of_neighbours(spark):
    """of n vertices that all know each other, rows moved follow the edges, not the n (n - 1) (n - 2) / 6 wedges."""
    n = 60
    pairs = [e for a, b in combinations(range(n), 2) for e in ((a, b, 1.0), (b, a, 1.0))] + [(0, n, 1.0), (n, 0, 1.0), (5, 5, 1.0)]
    adj = materialize(spark.createDataFrame(pairs, "i long, j long, w double"), "adj")
    narrow = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    before = _moved(spark)
    found = {r["i"]: r["triangles"] for r in graph.triangles(adj).collect()}
    assert found == {a: (n - 1) * (n - 2) // 2 for a in range(n)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", narrow)
    assert _moved(spark) - before < 8 * len(pairs) < n * (n - 1) * (n - 2) // 6
