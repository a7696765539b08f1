"""A batch that comes as one file is worked on by all cores, and gives what the batch job gives."""

from maskwright import catalogue
from maskwright.operators import tokens
from maskwright.streaming import jobs


def test_one_file_keeps_all_cores_busy(spark, tmp_path, monkeypatch):
    given = catalogue.turns(spark, "/root/testdata/sf0.001", per_turn=True)
    given.coalesce(1).write.parquet(f"{tmp_path}/in")
    pieces, run = [], jobs.pseudonymize

    def seen(msgs, *args, **options):
        pieces.append(msgs.rdd.getNumPartitions())
        return run(msgs, *args, **options)

    monkeypatch.setattr(jobs, "pseudonymize", seen)
    parts = catalogue.rules(spark), tokens.token_key_table(spark, catalogue.TOKEN_KEY), catalogue.ring(spark)
    jobs.pseudonymize_stream(spark.readStream.schema(given.schema).parquet(f"{tmp_path}/in"), *parts, f"{tmp_path}/out", f"{tmp_path}/state",
                             clock=lambda: catalogue.AS_OF, ttl_seconds=catalogue.TTL).awaitTermination()
    assert pieces and min(pieces) >= spark.sparkContext.defaultParallelism
    columns = ["request_id", "idx", "role", "text"]
    want = run(given, *parts, catalogue.AS_OF, ttl_seconds=catalogue.TTL)["text"].select(columns)
    assert sorted(spark.read.parquet(f"{tmp_path}/out/text").select(columns).collect()) == sorted(want.collect())
