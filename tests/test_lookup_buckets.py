"""Lookups in state by buckets of scopes: few calls, and the answers of single scopes."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from maskwright.operators.vault import latest, vault_get, vault_key_table, vault_put
from maskwright.streaming import mappings
from maskwright.streaming.jobs import lookup_stream

IN = Row("tenant_id", "conversation_id", "token", "ask_id", "token_version", "record", "expires")


class Counted:
    """A state of maps that counts what it is asked."""

    def __init__(self):
        self.kept, self.calls = {}, 0

    def getMapState(self, *_):
        return self

    def exists(self):
        self.calls += 1
        return bool(self.kept)

    def getValue(self, key):
        self.calls += 1
        return self.kept.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.kept[key] = value


def test_state_is_asked_once_for_a_bucket_without_mappings():
    state, job = Counted(), mappings.Mappings(60)
    job.init(state)
    puts = [IN("t", "c", f"k{i}", None, "v1", bytearray(b"r%d" % i), 5) for i in range(100)]
    asks = [IN("t", "c", f"k{i}", f"a{i}", "v1", None, None) for i in range(200)]
    got = {r.ask_id: r.record for r in job.handleInputRows((0,), iter(asks + puts), None)}
    assert got == {f"a{i}": b"r%d" % i if i < 100 else None for i in range(200)}
    assert state.calls == 1 + 100
    # a repeated batch writes nothing, and asks for each scope once
    again = {r.ask_id: r.record for r in job.handleInputRows((0,), iter(puts + asks), None)}
    assert again == got and state.calls == 101 + 1 + 200


def test_scopes_of_a_bucket_stay_apart(spark, tmp_path, monkeypatch):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    monkeypatch.setattr(mappings, "BUCKETS", 2)
    ring = vault_key_table(spark, {1: b"k" * 32})
    prov = spark.range(300).selectExpr(
        "'r' as request_id", "concat('t', id % 3) as tenant_id", "concat('c', id % 7) as conversation_id", "concat('<E:v1:', id, '>') as token", "'v1' as token_version",
        "concat('value ', id) as original", "id")

    def put(part, as_of, suffix):
        return vault_put(prov.where(part).withColumn("original", F.concat("original", F.lit(suffix))), ring, as_of, 3600, 1)

    # the second batch is later for some scopes, and earlier for others
    batches = [put("id < 200", "2024-01-01 00:10:00", ""), put("id between 100 and 149", "2024-01-01 00:20:00", " later").unionByName(put("id between 150 and 249", "2024-01-01", " earlier"))]
    asks = prov.selectExpr("tenant_id", "conversation_id", "token", "token_version", "cast(id as string) as ask_id").unionByName(
        prov.selectExpr("cast(null as string) as tenant_id", "conversation_id", "token", "token_version", "concat('null', id) as ask_id"))
    paths, seen = {n: str(tmp_path / n) for n in ("puts", "asks", "out", "state")}, None
    for n, rows in enumerate(batches):
        rows.write.mode("append").parquet(paths["puts"])
        asks.withColumn("ask_id", F.concat(F.lit(f"{n}-"), "ask_id")).write.mode("append").parquet(paths["asks"])
        lookup_stream(spark.readStream.schema(rows.schema).parquet(paths["puts"]), spark.readStream.schema(asks.schema).parquet(paths["asks"]),
                      ring, paths["out"], paths["state"], 3600, clock=lambda: "2024-01-01 00:30:00").awaitTermination()
        # rows are sealed anew whenever they are made, so what was put is read from where it was written
        seen = spark.read.parquet(paths["puts"])
        want = vault_get(asks, latest(seen), ring, "2024-01-01 00:30:00").select("ask_id", "status", "value")
        got = spark.read.parquet(paths["out"]).where(F.col("ask_id").startswith(f"{n}-")).select(F.substring("ask_id", 3, 99).alias("ask_id"), "status", "value")
        assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
        assert got.where("status = 'found'").count() == (200, 250)[n]
