import zlib
from collections import Counter

from pyspark.sql import functions as F

from assayframe.llm import virtual_slots as V
from assayframe.llm.queries import op4_sharding


def lpt(sizes, n):
    loads, out = [0] * n, {}
    for size, slot in sorted(((s, k) for k, s in sizes.items()), key=lambda x: (-x[0], x[1])):
        at = loads.index(min(loads))
        loads[at] += size
        out[slot] = at
    return out


def test_contract_on_the_small_table(spark, small):
    rows = op4_sharding(spark, small).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        b = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(b) + 8, zlib.crc32(b), "bytes", None)
    loads, slots = Counter(), {}
    for r in rows:
        loads[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    bytes_of = Counter()
    for r in rows:
        bytes_of[r["virtual_slot"]] += r["size"]
    assert {r["virtual_slot"]: r["shard"] for r in rows} == lpt(bytes_of, 24)


def test_many_rows_come_out_near_equal(spark):
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"))
    found = V.describe(rows).drop("text")
    got = V.assign(found, V.place(V.slot_bytes(found), 24)).groupBy("shard").agg(F.sum("size").alias("s"), F.max("slot").alias("m"), F.count("*").alias("n")).collect()
    assert len(got) == 24 and all(r["m"] == r["n"] - 1 for r in got)
    assert max(r["s"] for r in got) < 1.01 * min(r["s"] for r in got)


def test_rebalance_moves_little_and_keeps_versions(spark, tmp_path):
    slots = spark.range(200).select(F.col("id").cast("int").alias("virtual_slot"), F.lit(10).cast("long").alias("n_rows"), (100 + F.col("id") % 7).alias("n_bytes"))
    first = V.save_map(V.place(slots, 4), str(tmp_path / "map"))
    second = V.save_map(V.rebalance(first, slots, 5), str(tmp_path / "map"))
    a, b = ({r["virtual_slot"]: r["shard"] for r in m.collect()} for m in (first, second))
    moved = {k for k in b if a[k] != b[k]}
    assert {b[k] for k in moved} == {4} and 30 <= len(moved) <= 50
    assert second.select("map_version").distinct().collect()[0][0] == 2
    stored = spark.read.parquet(str(tmp_path / "map"))
    assert {r["virtual_slot"]: r["shard"] for r in V.load_map(stored, 1).collect()} == a
    loads = Counter()
    for r in second.collect():
        loads[r["shard"]] += r["n_bytes"]
    assert max(loads.values()) - min(loads.values()) <= 110
    fewer = {r["virtual_slot"]: r["shard"] for r in V.rebalance(second, slots, 3).collect()}
    assert set(fewer) == set(b) and set(fewer.values()) == {0, 1, 2}


def test_nulls_repeats_clashing_columns_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "a", 5), (1, "a", 5), (None, None, 6), (None, "b", 7), (2, "", 8)], "doc_id long, text string, size int")
    found = V.describe(rows)
    got = V.assign(found, V.place(V.slot_bytes(found), 2)).collect()
    assert sorted(r["size"] for r in got) == [8, 8, 9, 9, 9] and sum(r["text_crc32"] == 0 for r in got) == 2
    for s in (0, 1):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    none = V.describe(rows.limit(0))
    assert V.assign(none, V.place(V.slot_bytes(none), 2)).count() == 0
