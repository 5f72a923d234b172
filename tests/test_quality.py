"""Roll-ups of model calls at sizes where sketches of quantiles are no longer exact."""

from pyspark.sql import functions as F

from lodestream.operators import quality as V


def test_quantiles_of_a_rollup_are_exact(spark):
    i = F.col("id")
    calls = spark.range(60_000).select(
        F.when(i % 2 == 0, "even").alias("component"), F.lit("ok").alias("status"), i.alias("prompt_tokens"), i.alias("completion_tokens"),
        F.when(i % 6 < 4, i * 7).alias("latency_ms")
    )
    got = {r.component: (r.calls, r.median_latency, r.p95_latency) for r in V.call_rollup(calls).collect()}
    known = {c: sorted(n * 7 for n in range(60_000) if n % 6 < 4 and (n % 2 == 0) == (c == "even")) for c in ("even", None)}
    assert got == {c: (30_000, v[len(v) // 2 - 1], v[len(v) * 95 // 100 - 1]) for c, v in known.items()}
