import zlib
from collections import defaultdict

from rayloom.llm import slot_sharding as ss


def placed(df, shards=8, **options):
    return [r.asDict() for r in ss.shard(df, shards, **options).collect()]


def check(rows, found, shards, spare):
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in found if r["doc_id"] is not None) == sorted(
        (i, len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode())) for i, t, *_ in rows if i is not None
    )
    slots, load = defaultdict(list), [0] * shards
    for r in found:
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(load) - min(load) <= spare, load


def test_sizes_are_near_equal_and_reruns_agree(documents):
    rows = [(i, "x" * (1 + i * 37 % 900)) for i in range(2000)]
    found = placed(documents(rows))
    check(rows, found, 8, 2000)
    again = placed(documents(rows).repartition(5))
    assert sorted(map(repr, found)) == sorted(map(repr, again))


def slow_shards(rows, shards, slots):
    """Every row by itself: equal ones from the slot of their hash on, the heaviest slot to the lightest shard, one by one."""
    seen, held = defaultdict(int), []
    for (i, t), first in rows:
        key = (i, len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode()))
        held.append((key, (first + seen[key]) % slots))
        seen[key] += 1
    weight = defaultdict(int)
    for key, slot in held:
        weight[slot] += key[1]
    load, home = [0] * shards, {}
    for slot in sorted(weight, key=lambda s: (-weight[s], s)):
        home[slot] = min(range(shards), key=lambda s: (load[s], s))
        load[home[slot]] += weight[slot]
    out, place = [], [0] * shards
    for key, slot in sorted(held, key=lambda x: (x[1], x[0][0] is not None, x[0][0] or 0, x[0][2] is not None, x[0][2] or 0, x[0][1])):
        out.append((*key, home[slot], place[home[slot]]))
        place[home[slot]] += 1
    return sorted(out, key=repr)


def test_equals_a_row_by_row_placement(spark, documents):
    from pyspark.sql import functions as F

    rows = [(i % 300, "y" * (i % 90)) for i in range(900)] + [(7, "same")] * 40 + [(None, "none")] * 30 + [(None, None)]
    df = documents(rows)
    first = df.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary"))), F.lit(64)).alias("s"))
    asked = [((r.doc_id, r.text), r.s) for r in first.collect()]
    got = sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in placed(df, 5, slots=64)), key=repr)
    assert got == slow_shards(asked, 5, 64)


def test_equal_rows_spread_over_all_shards(spark, documents, monkeypatch):
    monkeypatch.setattr(ss, "_ALIKE", 100)
    found = placed(documents([(1, "the same")] * 5000 + [(None, "no id")] * 3000 + [(i, "x" * i) for i in range(200)]), 8)
    load = defaultdict(int)
    for r in found:
        load[r["shard"]] += r["size"]
    assert len(found) == 8200 and len(load) == 8 and max(load.values()) - min(load.values()) < 0.02 * sum(load.values())


def test_odd_rows(odd, no_documents):
    from .conftest import ODD

    found = placed(odd, 3)
    assert len(found) == len(ODD)
    assert [r["size"] for r in found if r["doc_id"] == 0] == [1]
    assert placed(no_documents) == []


def test_map_versions(spark, documents, tmp_path):
    rows = [(i, "x" * (1 + i * 37 % 900)) for i in range(1500)]
    path = str(tmp_path / "maps")
    first = placed(documents(rows), 4, slots=256, map_path=path)
    old = ss.read_map(spark, path)
    assert old.version == 1 and {r["vslot"]: r["shard"] for r in first} == old.shard_of
    sizes = ss.slot_sizes(ss.with_slots(documents(rows), 256))
    grown = ss.rebalance(old, sizes, 5)
    ss.write_map(spark, grown, path)
    latest = ss.read_map(spark, path)
    assert latest.version == 2 and latest == grown and ss.read_map(spark, path, 1).shard_of == old.shard_of
    moved = {s for s in old.shard_of if old.shard_of[s] != grown.shard_of[s]}
    assert {grown.shard_of[s] for s in moved} == {4}
    assert max(grown.loads()) <= 1.05 * sum(grown.loads()) / 5
    second = [r.asDict() for r in ss.place(ss.with_slots(documents(rows), 256), latest).collect()]
    check(rows, second, 5, 0.1 * sum(grown.loads()))
    shrunk = ss.rebalance(latest, sizes, 4)
    assert set(shrunk.shard_of.values()) <= set(range(4))
