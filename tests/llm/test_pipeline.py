import math
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rayloom.llm import quality_nbsvm, slot_sharding
from rayloom.llm.common import id_fold

from .test_simhash_dedup import slow_components, slow_fingerprint
from .test_slot_sharding import slow_shards

DATA = Path("/root/testdata/sf0.001")


def words_of(text, pattern):
    return re.findall(pattern, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow_quality(rows, score):
    """Each document by itself through the model, which ``test_quality_nbsvm`` holds against a plain one."""
    return sorted(r.doc_id for r in rows if score[r.doc_id] >= corpus_pipeline.KEEP_AT)


def slow_near_dedup(rows):
    """The smallest id of each component over all pairs of documents."""
    fps = [slow_fingerprint(r.text) for r in rows]
    words = [words_of(r.text, r"[^\x20\x09-\x0D]+") for r in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    alike = lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4 or (sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    roots = slow_components(list(range(len(rows))), alike)
    return sorted({min(rows[i].doc_id for i in roots if roots[i] == root) for root in set(roots.values())})


def slow_decontaminate(rows, items):
    """Documents without any window of ten words, or whole shorter item, of the benchmark."""
    cut = lambda text: words_of(text, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for item in items:
        w = cut(item.text)
        windows |= {tuple(w[i : i + min(10, len(w))]) for i in range(len(w) - min(10, len(w)) + 1) if w}
    sizes = {len(x) for x in windows}
    clean = lambda w: not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    return sorted(r.doc_id for r in rows if clean(cut(r.text)))


def check_mix(before, after):
    """Rounds of capped filling give the targets; each source's words come within half a document of its own."""
    size = lambda r: len(words_of(r.text, r"[^\x20\x09-\x0D]+"))
    sizes = Counter()
    for r in before:
        sizes[r.source] += size(r)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        for s in full or set(open_):
            target[s] = 3 * sizes[s] if full else level * weight[s]
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    got, copies, longest = Counter(), Counter(r.doc_id for r in after), Counter()
    for r in before:
        got[r.source] += copies[r.doc_id] * size(r)
        longest[r.source] = max(longest[r.source], size(r))
        share = target[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert copies[r.doc_id] in (math.floor(share), math.ceil(share)) and copies[r.doc_id] <= 3
    assert all(abs(got[s] - target[s]) <= longest[s] for s in names)


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_stages_equal_brute_force_over_the_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").collect()
    model = quality_nbsvm.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"), ~id_fold("doc_id", 4, 2))
    score = {r.doc_id: model.score(None if r.text is None else r.text.encode()) for r in docs.collect()}
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = at.collect()
        after = stage(spark, at, str(DATA)).collect()
        kept = sorted(r.doc_id for r in after)
        if name == "quality":
            assert kept == slow_quality(before, score)
        if name == "near_dedup":
            assert kept == slow_near_dedup(before)
        if name == "decontaminate":
            assert kept == slow_decontaminate(before, items)
        if name == "mix":
            check_mix(before, after)
        at = spark.createDataFrame(after, docs.schema)
        assert at.columns == docs.columns
    first = at.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary"))), F.lit(slot_sharding.SLOTS)).alias("s"))
    out = corpus_pipeline.STAGES[-1][1](spark, at, str(DATA)).collect()
    got = sorted(((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in out), key=repr)
    assert got == slow_shards([((r.doc_id, r.text), r.s) for r in first.collect()], 8, slot_sharding.SLOTS)


def stage_tables(spark, folder):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "no such passage")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_odd_documents_pass_every_stage(spark, odd, tmp_path):
    """One label gives no model: all score alike and stay. Repeated rows, equal texts and texts without words leave one each."""
    stage_tables(spark, tmp_path)
    stages = dict(corpus_pipeline.STAGES)
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    key = lambda rows: sorted(((r.doc_id, r.text) for r in rows), key=repr)
    judged = stages["quality"](spark, docs, str(tmp_path))
    assert judged.columns == docs.columns and key(judged.collect()) == key(docs.collect())
    single = stages["near_dedup"](spark, judged, str(tmp_path))
    left = single.collect()
    assert single.columns == docs.columns and len(left) == len(set(r.text for r in left)) == 4
    assert {r.text and r.text[:5] for r in left} - {None, "", " \n\t "} == {"word", "the s", "long "}
    clean = stages["decontaminate"](spark, single, str(tmp_path))
    assert clean.columns == docs.columns and key(clean.collect()) == key(left)
    check_mix(left, stages["mix"](spark, clean, str(tmp_path)).collect())
    placed = stages["shard"](spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id for r in placed), key=repr) == sorted((r.doc_id for r in docs.collect()), key=repr)
    assert all(0 <= r.shard < 8 and r["size"] >= 1 for r in placed)


def test_empty_documents_pass_every_stage(spark, no_documents, tmp_path):
    stage_tables(spark, tmp_path)
    docs = no_documents.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.collect() == []


def test_stages_take_columns_of_any_name(spark, odd, tmp_path):
    """Columns that operators use inside pass through all stages but the last, and change nothing."""
    stage_tables(spark, tmp_path)
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    names = ("fp", "key", "shard", "size", "copies", "score", "row", "id", "hash", "words")
    wide = plain.withColumns({n: F.lit(n) for n in names})
    for name, stage in corpus_pipeline.STAGES:
        a, b = stage(spark, plain, str(tmp_path)), stage(spark, wide, str(tmp_path))
        held = b.collect()
        # which of two rows without any difference in id and text stays is no matter
        kept = ("doc_id", "size", "text_crc32", "shard") if name == "shard" else ("doc_id", "text")
        assert sorted((tuple(r[c] for c in kept) for r in a.collect()), key=repr) == sorted((tuple(r[c] for c in kept) for r in held), key=repr), name
        if name != "shard":
            assert b.columns == wide.columns and all(r[n] == n for r in held for n in names), name


def test_the_quality_stage_uses_the_operator(spark, documents, tmp_path):
    good, bad = "some plain words in a row as they come", "LOUD!! WORDS!! ALL!! ALONG!! THE!! LINE!!"
    rows = [(i, f"{good if i % 2 else bad} {i}", "en", "s") for i in range(200)]
    spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = documents(rows).select("doc_id", "text", "lang", "source", "n_chars")
    kept = [r.doc_id for r in corpus_pipeline.quality(spark, docs, str(tmp_path)).collect()]
    assert sorted(kept) == [i for i in range(200) if i % 2]
    model = quality_nbsvm.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), ~id_fold("doc_id", 4, 2))
    assert model.slope > 0
