"""Job steps over micro-batches next to a plain fold."""
import random

from loreweave.operators import runs as R
from loreweave.streaming import streams as N


def test_job_steps_in_buckets_match_the_keyed_state(spark, tmp_path):
    r = random.Random(7)
    source, schema = str(tmp_path / "in"), "job_id int, sequence long, status string"
    kinds = ["pending", "running", "paused", "completed", "failed", "cancelled", "other", None]
    parts = [[(r.choice([1, 1, 1, 2, 3, None]), r.randrange(k * 2000, 9000 + k * 2000), r.choice(kinds[: 3 if r.random() < 0.99 else 8])) for _ in range(400)] for k in range(3)]
    status, last, want = {}, {}, []
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        N.run_batches(spark.readStream.schema(schema).parquet(source), str(tmp_path / "cp"), N.job_step(str(tmp_path / "t"))).awaitTermination()
        low, seen = {}, dict(last)
        for job, n, to in rows:
            low[job, n] = min((x for x in (to, low.get((job, n))) if x is not None), default=None)
        for (job, n), to in sorted(low.items(), key=lambda x: x[0][1]):
            if n > seen.get(job, -1):
                was = status.get(job, "pending")
                legal = was == to or (was, to) in R.EDGES
                want.append((job, n, was, to, legal))
                status[job], last[job] = to if legal else was, n
    got = N.job_tables(str(tmp_path / "t"))[0].rows(spark).select("job_id", "sequence", "from_status", "to_status", "applied").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {x.job_id: (x.status, x.last_sequence) for x in N.job_state(spark.createDataFrame(got)).collect()} == {j: (status[j], last[j]) for j in last}
