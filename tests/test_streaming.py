"""A stream of edits against the same edits applied at once."""

from pyspark.sql import functions as F

from spanweave.grammar import library
from spanweave.kernel.matcher import Matcher
from spanweave.streaming.edits import matched_edits

SCHEMA = "id long, seq long, start long, old_end long, replacement string"


def test_a_document_is_matched_as_after_all_its_edits(spark, tmp_path):
    batches = [
        [(1, 0, None, None, "[1, 2"), (2, 0, 0, 0, "{}")],
        [(1, 1, None, None, "]"), (1, 2, 1, 2, "\"é\""), (2, 1, 5, 6, "no")],
        [(1, 2, 0, 1, "seen before"), (2, 2, 1, 1, "\"a\": null")],
    ]
    program, told = library.program("json"), []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))

        def keep(df, _, k=k):
            told.extend((k, r.key, r.seq, bytes(r.text), r.matched, r.complete, r.n_captures, r.error) for r in df.collect())

        matched_edits(stream, program, "id").writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {(k, key): rest for k, key, *rest in told}
    texts = {(0, "1"): "[1, 2", (0, "2"): "{}", (1, "1"): '["é", 2]', (1, "2"): "{}", (2, "1"): '["é", 2]', (2, "2"): '{"a": null}'}
    assert set(got) == set(texts)
    for at, text in texts.items():
        cold = Matcher(program).match(text.encode())
        assert got[at][1:5] == [text.encode(), cold.matched, cold.complete, len(cold.captures)], at
    assert got[1, "2"][5] == "edit 1: 5..6 in 2 bytes" and got[2, "2"][5] is None
