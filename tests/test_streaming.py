import random

from verbena.operators import literature
from verbena.streaming.literature import apply_changes, latest_versions

KINDS = "provider_id string, article_id string, pmid string, version_id string, source_ordinal long, is_deleted boolean"


def test_stream_of_versions_equals_each_snapshot(spark, tmp_path):
    r = random.Random(3)
    events = [("p", f"a{r.randrange(6)}", "m", f"v{i}", i, r.random() < 0.2) for i in range(40)]
    log, seen = str(tmp_path / "log"), {}
    state = {"rows": spark.createDataFrame([], KINDS).collect()}

    def put(changes, n):
        before = spark.createDataFrame(state["rows"], KINDS)
        state["rows"] = apply_changes(before, changes).collect()

    for k in range(4):
        part = events[10 * k : 10 * k + 10]
        spark.createDataFrame(r.sample(part, len(part)), KINDS).coalesce(1).write.mode("append").parquet(log)
        stream = latest_versions(spark.readStream.schema(KINDS).parquet(log)).writeStream.outputMode("update").foreachBatch(put)
        stream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        seen[k] = {tuple(x) for x in state["rows"]}
        want = literature.visible_versions(spark.createDataFrame(events[: 10 * k + 10], KINDS), 10 * k + 9)
        assert seen[k] == {tuple(x) for x in want.select("provider_id", "article_id", "pmid", "version_id", "source_ordinal", "is_deleted").collect()}
