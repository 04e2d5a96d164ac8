import json
import time

from inkwell.operators import classify
from inkwell.operators import segments as S
from inkwell.streaming import ladder


def test_stream_equals_the_batch_ladder_over_a_restart(spark, tmp_path):
    def model(user):
        """Fails for whole batches that hold a bad segment, so that a chapter with many of them goes over to single ones."""
        items = json.loads(user)
        if any("bad" in i["text"] for i in items):
            raise ValueError("no")
        return json.dumps([{"id": i["id"], "type": "narration", "speaker": "narrator", "gender": "unknown", "speaker_confidence": 0.5, "gender_confidence": 0.5, "character_confidence": len(items) / 10} for i in items])

    texts = {"a": [f"line {i}" for i in range(11)], "b": [f"{'bad' if i in (1, 4, 6) else 'fine'} {i}" for i in range(14)]}
    whole = S.extract(spark.createDataFrame([(k, "\n".join(t)) for k, t in texts.items()], "chapter_id string, text string")).select("chapter_id", "pos", "segment_id", "paragraph_id", "text", "context_before", "context_after")
    want = {(r.chapter_id, r.pos): (r.batch, r.batch_size, r.llm_status == classify.OK) for r in classify.classified(whole, model, size=3, limit=2, attempts=2).collect()}
    source, log, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "log", "checkpoint"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def start():
        stream = spark.readStream.schema(whole.schema).parquet(source)
        out = ladder.answers(stream, model, size=3, limit=2, attempts=2, pause_ms=50, quiet_ms=1500)
        return out.writeStream.foreachBatch(ladder.log_sink(log)).option("checkpointLocation", checkpoint).trigger(processingTime="200 milliseconds").start()

    def logged():
        return spark.read.parquet(log).collect() if (tmp_path / "log").exists() and any((tmp_path / "log").glob("epoch=*/*.parquet")) else []

    def wait(done, seconds=120):
        end = time.time() + seconds
        while time.time() < end and not done():
            time.sleep(1)

    try:
        whole.where("pos < 7").coalesce(1).write.mode("append").parquet(source)
        query = start()
        wait(lambda: len(logged()) >= 6)
        query.stop()
        whole.where("pos >= 7").coalesce(1).write.mode("append").parquet(source)
        query = start()
        wait(lambda: len(logged()) >= len(want))
        query.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    rows = logged()
    assert len(rows) == len(want) == len({(r.chapter_id, r.pos) for r in rows})
    got = {(r.chapter_id, r.pos): r for r in rows}
    assert {k: r.ok for k, r in got.items()} == {k: ok for k, (_, _, ok) in want.items()}
    assert all(r.attempts == (1 if r.ok else 2) for r in rows)
    bad = [r for r in rows if r.chapter_id == "b"]
    assert any(r.batch_size == 1 for r in bad) and all(r.batch_size == 1 or r.pos < 6 for r in bad)
