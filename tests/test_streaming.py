"""Reply streams: tool calls as a whole, one budget over all batches, tables read anew."""

import json
import time

import pytest
from pyspark.sql import functions as F

from maskwright.operators.vault import vault_key_table, vault_put
from maskwright.plans import jobs
from maskwright.sources.vault_store import upsert_vault
from maskwright.streaming.jobs import lookup_stream, read_spent, restore_stream, within_budget, write_spent

TOKEN = "<CUSTOMER_TERM:v1:%s>" % ("a" * 32)
OTHER = "<CUSTOMER_TERM:v1:%s>" % ("b" * 32)
PROV = ("request_id string, tenant_id string, conversation_id string, token string, token_version string, original string, canonical string, entity_type string")


def provenance(spark, request="r"):
    return spark.createDataFrame([(request, "t", "c", TOKEN, "v1", 'Say "Hi" Co', 'say "hi" co', "CUSTOMER_TERM")], PROV)


@pytest.fixture(scope="module")
def ring(spark):
    return vault_key_table(spark, {1: b"k" * 32})


def test_arguments_are_restored_whole_or_refused(spark, ring):
    prov = provenance(spark)
    vault = vault_put(prov, ring, "2024-01-01", 60, 1)
    rows = [("r", "a", 0, "tool", json.dumps({"note": f"{TOKEN}!", "n": [1, "x"]})), ("r", "b", 1, "tool", json.dumps({"note": f"{TOKEN} and {OTHER}"})),
            ("r", "c", 2, "tool", "{broken"), ("r", "d", 3, "tool", json.dumps({"plain": 'q"'})), ("r", "e", 4, "tool", json.dumps({TOKEN: 1}))]
    calls = spark.createDataFrame(rows, "request_id string, block string, part long, kind string, text string")
    got = {r.block: (r.text, r.refusal) for r in jobs.restore_arguments(calls, prov, vault, ring, "2024-01-01", ("request_id", "block", "part"))["text"].collect()}
    assert json.loads(got["a"][0]) == {"note": 'Say "Hi" Co!', "n": [1, "x"]} and got["a"][1] is None
    assert json.loads(got["d"][0]) == {"plain": 'q"'}
    assert all(got[b] == (None, "tool_restoration_refused") for b in "bce")


def test_one_budget_over_all_batches(spark, tmp_path):
    schema = "request_id string, block string, part long, kind string, text string, refusal string"
    texts = ["x" * 40, "y" * 40, "z" * 40, "w", "v"]
    cuts = [[(0,), (1,), (2,), (3,), (4,)], [(0, 1), (2, 3, 4)], [(0, 1, 2, 3, 4)]]
    seen = set()
    for k, batches in enumerate(cuts):
        spent, out = str(tmp_path / f"s{k}"), []
        for n, parts in enumerate(batches):
            rows = spark.createDataFrame([("r", "b", p, "text", texts[p], None) for p in parts] + [("q", "b", p, "text", "small", None) for p in parts], schema)
            for again in (False, True):  # a batch that is repeated finds and leaves the same
                before = read_spent(spark, spent, n)
                done = within_budget(rows, before, 100).cache()
                got = [(r.request_id, r.part, r.text, r.refusal) for r in done.collect()]
                write_spent(done, before, spent, n, "2024-01-01")
                assert not again or got == out[-len(got):]
                out += [] if again else got
        seen.add(tuple(sorted(out, key=str)))
    assert len(seen) == 1
    got = {(r, p): (t, why) for r, p, t, why in seen.pop()}
    assert [got["r", p][1] for p in range(5)] == [None, None] + ["restoration_refused"] * 3
    assert all(got["q", p] == ("small", None) for p in range(5))


def test_what_is_carried_does_not_grow_with_the_batches(spark, tmp_path):
    path, schema = str(tmp_path / "spent"), "request_id string, bytes bigint"
    none = spark.createDataFrame([], schema)

    def batch(n, rows, minute=0, forget=None):
        write_spent(spark.createDataFrame(rows, schema) if rows else none, read_spent(spark, path, n), path, n, f"2024-01-01 00:{minute:02}:00", forget)
        return {r.request_id: r.bytes for r in read_spent(spark, path, n + 1).collect()}

    assert batch(0, [("a", 1), ("b", 5)]) == {"a": 1, "b": 5}
    # batches without rows carry on; texts of NULL have no bytes; a request may have no id
    assert batch(1, []) == {"a": 1, "b": 5} and batch(2, [("a", 2), ("c", None), (None, 4)]) == {"a": 3, "b": 5, "c": None, None: 4}
    assert spark.read.parquet(path).count() == 2 + 4  # two tables, however many batches there were
    assert batch(3, [("a", 1)], 30, 600) == {"a": 4} and batch(4, [], 59, 600) == {} == batch(5, [], 59)
    # nothing was left to write, and the table of an earlier batch isn't taken for it
    assert batch(6, [("d", 1)]) == {"d": 1} == batch(7, [])


def test_mappings_expire_a_fixed_time_after_they_were_put(spark, ring, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    paths, ttl = {n: str(tmp_path / n) for n in ("puts", "asks", "out", "state")}, 15
    rows = vault_put(provenance(spark), ring, "2024-01-01", 3600, 1)
    asks = "tenant_id string, conversation_id string, token string, token_version string, ask_id string"
    rows.limit(0).write.parquet(paths["puts"])

    def ask(n, put=None, as_of="2024-01-01 00:01:00"):
        if put is not None:
            put.write.mode("append").parquet(paths["puts"])
        spark.createDataFrame([("t", "c", TOKEN, "v1", f"{n}"), ("t", "c", OTHER, "v1", f"{n}-other"), ("u", "c", TOKEN, "v1", f"{n}-moved"),
                               (None, "c", TOKEN, "v1", f"{n}-null")], asks).write.mode("append").parquet(paths["asks"])
        lookup_stream(spark.readStream.schema(rows.schema).parquet(paths["puts"]), spark.readStream.schema(asks).parquet(paths["asks"]),
                      ring, paths["out"], paths["state"], ttl, clock=lambda: as_of).awaitTermination(120)
        got = {r.ask_id: (r.status, r.value) for r in spark.read.parquet(paths["out"]).where(F.col("ask_id").startswith(f"{n}")).collect()}
        assert got[f"{n}-other"] == got[f"{n}-moved"] == got[f"{n}-null"] == ("absent", None) and len(got) == 4
        return got[f"{n}"]

    value = ("found", 'Say "Hi" Co')
    begun = time.time()
    assert ask(1, rows) == value
    put_by = time.time()
    # a row that is no later renews nothing, neither do lookups; its own expiry is judged as well
    assert ask(2, rows, "2024-02-01") == ("expired", None)
    time.sleep(max(0, begun + 9 - time.time()))
    if time.time() < begun + ttl - 5:
        assert ask(3) == value
    time.sleep(max(0, put_by + ttl + 1 - time.time()))
    assert ask(4) == ("absent", None)
    assert ask(5, vault_put(provenance(spark), ring, "2024-01-02", 3600, 1), "2024-01-02 00:01:00") == value


def test_tables_are_read_for_every_batch(spark, ring, tmp_path, monkeypatch):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    paths = {n: str(tmp_path / n) for n in ("in", "prov", "vault", "out", "state")}
    chunk = "request_id string, block string, seq bigint, delta string, final boolean, kind string"

    def batch(request, n):
        prov = provenance(spark, request)
        prov.write.mode("append").parquet(paths["prov"])
        upsert_vault(vault_put(prov, ring, "2024-01-01", 600, 1), paths["vault"], str(n), 4)
        call = json.dumps({"note": TOKEN})
        rows = [(request, "b", 1, f"Dear {TOKEN[:20]}", False, "text"), (request, "b", 2, f"{TOKEN[20:]}, hello", True, "text"),
                (request, "t", 3, call[:9], False, "tool"), (request, "t", 4, call[9:], True, "tool"), (request, None, 5, "", True, "end")]
        spark.createDataFrame(rows, chunk).coalesce(1).write.mode("append").json(paths["in"])
        chunks = spark.readStream.schema(chunk).json(paths["in"])
        restore_stream(chunks, paths["prov"], paths["vault"], ring, paths["out"], paths["state"], clock=lambda: "2024-01-01 00:01:00", first_seq=1).awaitTermination()

    batch("r1", 1)
    batch("r2", 2)
    rows = spark.read.parquet(f"{paths['out']}/text").orderBy("request_id", "part").collect()
    assert all(r.refusal is None for r in rows)
    for request in ("r1", "r2"):
        own = [r for r in rows if r.request_id == request]
        assert "".join(r.text for r in own if r.kind == "text") == 'Dear Say "Hi" Co, hello'
        assert [json.loads(r.text) for r in own if r.kind == "tool"] == [{"note": 'Say "Hi" Co'}]

