"""The vault as files: batches, rewrites, erasure."""

import pytest
from pyspark.sql import functions as F

from maskwright.functions.text import canonicalize
from maskwright.operators.vault import vault_collisions, vault_get, vault_key_table, vault_put, wanted_rows
from maskwright.sources.vault_store import erase, read_vault, rewrite_vault, sweep, upsert_vault


def test_batches_sweep_and_erasure(spark, tmp_path):
    path, ring = str(tmp_path / "vault"), vault_key_table(spark, {1: b"k" * 32})
    prov = spark.createDataFrame(
        [("r", "t", "a", "<X:v1:1>", "v1", "one"), ("r", "t", "b", "<X:v1:2>", "v1", "two")],
        "request_id string, tenant_id string, conversation_id string, token string, token_version string, original string")
    upsert_vault(vault_put(prov, ring, "2024-01-01", 60, 1), path, "b1")
    upsert_vault(vault_put(prov, ring, "2024-01-01", 60, 1), path, "b1")
    upsert_vault(vault_put(prov.where("conversation_id = 'a'"), ring, "2024-01-02", 60, 1), path, "b2")
    assert read_vault(spark, path).count() == 2
    assert sweep(spark, path, "2024-01-01 12:00:00") == 1
    got = vault_get(prov.drop("original"), read_vault(spark, path), ring, "2024-01-02 00:00:30")
    assert {r.conversation_id: (r.status, r.value) for r in got.collect()} == {"a": ("found", "one"), "b": ("absent", None)}
    assert erase(spark, path, prov.select("tenant_id", "conversation_id")) == 1 and read_vault(spark, path).count() == 0


def made(spark, rows, ring, as_of="2024-01-01", batch="b"):
    prov = spark.createDataFrame(rows, "request_id string, tenant_id string, conversation_id string, token string, token_version string, original string")
    return vault_put(prov, ring, as_of, 60, 1)


def test_a_batch_during_a_rewrite_is_kept(spark, tmp_path):
    path, ring = str(tmp_path / "vault"), vault_key_table(spark, {1: b"k" * 32})
    upsert_vault(made(spark, [("r", "t", "a", "<X:v1:1>", "v1", "one")], ring), path, "1", buckets=4)

    def keep(vault):
        upsert_vault(made(spark, [("r", "t", "b", "<X:v1:2>", "v1", "two")], ring), path, "2")
        return vault

    assert rewrite_vault(spark, path, keep) == 0
    assert {r.conversation_id for r in read_vault(spark, path).collect()} == {"a", "b"}


def test_a_failed_rewrite_does_no_harm(spark, tmp_path):
    path, ring = str(tmp_path / "vault"), vault_key_table(spark, {1: b"k" * 32})
    upsert_vault(made(spark, [("r", "t", "a", "<X:v1:1>", "v1", "one")], ring), path, "1")
    with pytest.raises(Exception):
        rewrite_vault(spark, path, lambda v: v.withColumn("token", F.raise_error(F.lit("stop"))))
    assert read_vault(spark, path).count() == 1 and sweep(spark, path, "2024-01-02") == 1 and read_vault(spark, path).count() == 0


def test_of_two_rewrites_one_goes_through(spark, tmp_path):
    path, ring = str(tmp_path / "vault"), vault_key_table(spark, {1: b"k" * 32})
    upsert_vault(made(spark, [("r", "t", "a", "<X:v1:1>", "v1", "one")], ring), path, "1")

    def keep(vault):
        assert erase(spark, path, spark.createDataFrame([("t", "a")], "tenant_id string, conversation_id string")) == 1
        return vault

    with pytest.raises(Exception):
        rewrite_vault(spark, path, keep)
    assert read_vault(spark, path).count() == 0


def test_erased_values_are_gone_from_disk(spark, tmp_path):
    path, ring = str(tmp_path / "vault"), vault_key_table(spark, {1: b"k" * 32})
    upsert_vault(made(spark, [("r", "t", "a", "<X:v1:1>", "v1", "one"), ("r", "t", "b", "<X:v1:2>", "v1", "two")], ring), path, "1")
    erase(spark, path, spark.createDataFrame([("t", "a")], "tenant_id string, conversation_id string"))
    # every file below the vault; a partition that lost all its rows keeps one without a token
    files = [str(f) for f in (tmp_path / "vault").rglob("*.parquet")]
    left = spark.read.parquet(*files).where("token is not null or record is not null or conversation_id is not null")
    assert [r.conversation_id for r in left.collect()] == ["b"]


def test_lookups_prune_buckets(spark, tmp_path):
    path, ring = str(tmp_path / "vault"), vault_key_table(spark, {1: b"k" * 32})
    upsert_vault(made(spark, [("r", "t", f"c{i}", f"<X:v1:{i}>", "v1", str(i)) for i in range(40)], ring), path, "1", buckets=16)
    one = spark.createDataFrame([("t", "c7", "<X:v1:7>")], "tenant_id string, conversation_id string, token string")
    found = read_vault(spark, path, one)
    assert "c7" in {r.conversation_id for r in found.collect()} and found.count() < 20


def test_a_lookup_exchanges_only_what_may_be_asked_for(spark, tmp_path):
    path, ring = str(tmp_path / "vault"), vault_key_table(spark, {1: b"k" * 32})
    rows = made(spark, [("r", "t", f"c{i % 7}", f"<X:v1:{i}>", "v1", str(i)) for i in range(300)], ring)
    upsert_vault(rows, path, "1", buckets=4)
    stored = read_vault(spark, path)
    wanted = stored.where("pmod(hash(token), 10) = 0").select("tenant_id", "conversation_id", "token")
    extra = spark.createDataFrame([(None, "c1", "<X:v1:1>"), ("t", None, None), ("t", "none", "<X:v1:1>")], wanted.schema)
    asked = wanted.unionByName(extra).unionByName(wanted)
    keys = {(r.conversation_id, r.token) for r in wanted.collect()}
    assert 5 < len(keys) < 100
    # with many bits nothing else passes, with few some does, and the columns stay as they are
    for bits, most in ((1 << 24, len(keys)), (64, 300)):
        got = wanted_rows(stored, asked, bits)
        assert got.columns == stored.columns and keys <= {(r.conversation_id, r.token) for r in got.collect()} and got.count() <= most
    assert wanted_rows(stored, asked.limit(0)).count() == 0 == wanted_rows(stored.limit(0), asked).count()
    with pytest.raises(ValueError):
        wanted_rows(stored, asked, 100)
    found = read_vault(spark, path, asked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # the filter lies below the exchange that finds the latest row of a token
    assert plan.index("hashpartitioning(tenant_id") < plan.index("BroadcastHashJoin")
    assert {(r.conversation_id, r.token) for r in found.collect()} == keys


def test_rewrites_leave_other_partitions_alone(spark, tmp_path):
    path, ring = str(tmp_path / "vault"), vault_key_table(spark, {1: b"k" * 32})
    for n in range(3):
        upsert_vault(made(spark, [("r", "t", f"c{n}-{i}", f"<X:v1:{n}{i}>", "v1", "v") for i in range(30)], ring), path, str(n), buckets=4)
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "vault").rglob("*.parquet")}
    gone = spark.createDataFrame([("t", "c1-7")], "tenant_id string, conversation_id string")
    assert erase(spark, path, gone) == 1 and erase(spark, path, gone) == 0
    same = [f for f, at in files.items() if f.exists() and f.stat().st_mtime_ns == at]
    # one bucket of one batch was written anew
    assert len(files) > len(same) and all("batch_id=1" in str(f) for f in set(files) - set(same))
    assert read_vault(spark, path).count() == 89 and sweep(spark, path, "2024-02-01") == 89 and read_vault(spark, path).count() == 0
    upsert_vault(made(spark, [("r", "t", "new", "<X:v1:9>", "v1", "v")], ring), path, "9")
    assert read_vault(spark, path).count() == 1


def test_an_empty_vault(spark, tmp_path):
    path, ring = str(tmp_path / "none"), vault_key_table(spark, {1: b"k" * 32})
    assert read_vault(spark, path).count() == 0 and sweep(spark, path, "2024-01-01") == 0
    upsert_vault(made(spark, [("r", "t", "a", "<X:v1:1>", "v1", "one")], ring).limit(0), path, "0")
    one = spark.createDataFrame([("t", "a", "<X:v1:1>")], "tenant_id string, conversation_id string, token string")
    assert read_vault(spark, path, one).count() == 0


def test_a_clash_with_an_earlier_batch_is_found(spark, tmp_path):
    path, ring = str(tmp_path / "vault"), vault_key_table(spark, {1: b"k" * 32, 2: b"z" * 32})
    upsert_vault(made(spark, [("r", "t", "a", "<X:v1:1>", "v1", "One Ltd"), ("r", "t", "a", "<X:v1:2>", "v1", "two"), ("r", "u", "a", "<X:v1:3>", "v1", "three")], ring), path, "1")
    rows = [("q", "t", "a", "<X:v1:1>", "ONE LTD"), ("q", "t", "a", "<X:v1:2>", "other"), ("q", "t", "a", "<X:v1:3>", "unlike"), ("q", "t", "b", "<X:v1:1>", "else")]
    prov = spark.createDataFrame(rows, "request_id string, tenant_id string, conversation_id string, token string, canonical string").withColumns({"canonical": canonicalize(F.col("canonical")), "token_version": F.lit("v1")})
    stored = read_vault(spark, path, prov)
    assert [(r.tenant_id, r.conversation_id, r.token) for r in vault_collisions(prov, stored, ring, "2024-01-01 00:00:10").collect()] == [("t", "a", "<X:v1:2>")]
    # what has expired clashes with nothing, and neither does an empty vault
    assert vault_collisions(prov, stored, ring, "2024-03-01").count() == 0 == vault_collisions(prov, stored.limit(0), ring, "2024-01-01").count()
