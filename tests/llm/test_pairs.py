"""Near-duplicates, decontamination and sharding against brute force."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import decontam, minhash, sharding


def classes(texts, words=2, percent=80):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        n = min(words, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    best = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * len(sets[a] | sets[b]):
                    best[a] = best[b] = min(best[a], best[b])
    return {i: (len(sets[i]), best[i]) for i in sets}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, docs, odd, words):
    base = [f"w{i}" for i in range(40)]
    texts = [*odd, " ".join(base), *(" ".join([*base[:k], "new", *base[k + 1 :]]) for k in range(2, 40, 5)), " ".join(base).upper(), "a b", "A  B", "c"]
    texts += [" ".join(f"w{i + 3 * k}" for i in range(40)) for k in range(6)]
    rows = list(enumerate(texts))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(docs(rows), words=words).collect()}
    assert got == classes(rows, words)


def test_blocks_split_large_groups(spark, docs, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    base = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join([*base[: i % 30], f"x{i}", f"y{i}", *base[i % 30 + 1 :]])) for i in range(40)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(docs(rows)).collect()}
    assert got == classes(rows)


def test_near_duplicate_edges(spark, docs):
    got = minhash.near_duplicates(docs([(None, "a b c"), (5, "a b c"), (5, "a b c"), (2, "a b c"), (7, None)])).collect()
    assert sorted((x.doc_id or -1, x.component_id, x.kept) for x in got) == [(-1, None, True), (2, 2, True), (5, 2, False), (5, 2, False), (7, 7, True)]
    assert minhash.near_duplicates(docs([])).count() == 0
    assert sorted(x.doc_id for x in minhash.deduplicated(docs([(3, "a b"), (1, "a b"), (2, "c")])).collect()) == [1, 2]


def hits(docs, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for i, t in docs:
        w, hit, names = cut(t), set(), set()
        for name, text in items:
            v = cut(text)
            n = min(8, len(v))
            known = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if n and tuple(w[k : k + n]) in known:
                    hit.update(range(k, k + n))
                    names.add(str(name))
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(names) >= 2))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [decontam.INDEX_BYTES, 0])
def test_contamination(spark, docs, odd, limit):
    a, b = ([f"{c}{i}" for i in range(20)] for c in "ab")
    items = [(1, " ".join(a)), (2, " ".join(a[5:] + b)), (3, "Short, one"), (4, None), (5, ""), (6, " ".join(["z"] * 12)), (None, "none"), (1, " ".join(a))]
    texts = [*odd, " ".join(a[:7]), "-- " + ", ".join(a[:8]).upper(), " ".join(a[3:14] + b[2:12]), "x short one y short", "z " * 30, " ".join(a + a), "none"]
    rows = [*enumerate(texts), (None, " ".join(a)), (0, "again")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(docs(rows), bench, index_bytes=limit).drop("starts", "ends").collect()
    assert sorted(map(tuple, got), key=str) == hits(rows, [x for x in items if x[0] is not None])
    assert decontam.contamination(docs(rows), bench.limit(0), index_bytes=limit).where("n_hit > 0").count() == 0
    assert decontam.contamination(docs([]), bench, index_bytes=limit).count() == 0


def test_decontaminated_keeps_clean(spark, docs):
    a = [f"a{i}" for i in range(20)]
    bench = spark.createDataFrame([(1, " ".join(a))], "item_id long, text string")
    kept = decontam.decontaminated(docs([(1, " ".join(a[:9])), (2, " ".join(a[:7])), (3, None)]), bench, limit=1)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and {x.doc_id for x in kept.collect()} == {2, 3}


@pytest.mark.parametrize("n", [0, 1, 50, 2003])
def test_shards(spark, docs, n):
    rows = [(i if i % 5 else None, "é" * (i % 7) if i % 3 else None) for i in range(n)]
    got = sharding.sharded(docs(rows)).collect()
    assert len(got) == n and {x.law for x in got} <= {"rows"}
    sizes = {}
    for x in got:
        sizes.setdefault(x.shard, []).append(x.slot)
    assert all(sorted(v) == list(range(len(v))) for v in sizes.values())
    counts = [len(sizes.get(s, [])) for s in range(24)]
    assert max(counts) - min(counts) <= 1
    assert sorted(x.size for x in got) == sorted(8 + len((t or "").encode()) for _, t in rows)
    assert sorted(map(tuple, sharding.sharded(docs(rows)).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_communication_matrix():
    import random

    counts, sizes = [500, 3, 0, 997], [375] * 4
    for seed in range(20):
        m = sharding.communication_matrix(counts, sizes, seed)
        assert [sum(r) for r in m] == counts and [sum(c) for c in zip(*m, strict=True)] == sizes
    rng = random.Random(1)
    draws = [sharding.hypergeometric(rng, 300, 700, 200) for _ in range(4000)]
    mean, var = sum(draws) / 4000, sum((x - 60) ** 2 for x in draws) / 4000
    assert abs(mean - 60) < 0.5 and abs(var - 200 * 0.3 * 0.7 * 800 / 999) < 3


def test_written_shards(spark, docs, tmp_path):
    frame = docs([(i, f"text {i % 9}") for i in range(100)])
    sharding.write_shards(frame, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 100 and back.groupBy("shard").count().select(F.min("count"), F.max("count")).first()[:] == (25, 25)
    assert back.select("doc_id", "text").exceptAll(frame.select("doc_id", "text")).count() == 0


def test_written_shards_keep_clashing_columns(spark, docs, tmp_path):
    clash = docs([(i % 3, "same") for i in range(40)] + [(None, None)] * 9).selectExpr("*", "'x' as shard", "1 as slot", "2 as _row", "3 as size", "4 as rank", "5 as _doc", "6 as text_crc32")
    sharding.write_shards(clash, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.columns[5:] == ["shard_", "slot_", "_row", "size", "rank", "_doc", "text_crc32", "slot", "shard"]
    assert back.count() == 49 and back.select("shard_", "_doc", "text_crc32").distinct().collect() == [("x", 5, 6)]
    assert back.groupBy("shard").agg(F.max("slot"), F.count_distinct("slot"), F.count("*")).where("`max(slot)` + 1 <> `count(1)`").count() == 0
    assert sharding.sharded(clash).count() == 49


def test_shards_are_uniform(spark, docs):
    """Equal rows are dealt like others: their numbers by shard, and by tenth of a shard, vary as in a uniform shuffle."""
    frame = docs([(None, "equal")] * 6000 + [(i, f"text {i}") for i in range(6000)])
    for seed in (1, 2):
        got = sharding.sharded(frame, 24, seed)
        equal = F.col("doc_id").isNull()
        by_shard = [x.n for x in got.where(equal).groupBy("shard").agg(F.count("*").alias("n")).collect()]
        by_tenth = [x.n for x in got.where(equal).groupBy((F.col("slot") / 50).cast("int")).agg(F.count("*").alias("n")).collect()]
        # Hypergeometric cells of 500 (1200) places: mean 250 (600), variance about half the mean.
        for cells, mean, factor in ((by_shard, 250, 0.5), (by_tenth, 600, 0.5)):
            chi = sum((x - mean) ** 2 / (mean * factor) for x in cells)
            assert len(cells) == 6000 // mean and 0.25 * len(cells) < chi < 2.2 * len(cells)


def test_filters_judge_rows(spark, docs):
    rng = np.random.default_rng(3)
    some = lambda: " ".join(f"w{k}" for k in rng.integers(0, 10**6, 40))
    item, a, b, c = some(), some(), some(), some()
    items = spark.createDataFrame([("i", item)], "item_id string, text string")
    frame = docs([(None, item), (1, item), (1, a), (2, b), (None, c)])
    for size in (decontam.INDEX_BYTES, 0):
        got = decontam.decontaminated(frame, items, 1, size).collect()
        assert sorted(((x.doc_id, x.text) for x in got), key=str) == sorted([(1, a), (2, b), (None, c)], key=str)
    rows = [(None, a), (None, a), (3, a), (1, b), (1, b), (1, c), (5, c), (None, item), (None, item)]
    got = minhash.deduplicated(docs(rows), 80, 5).collect()
    assert sorted(((x.doc_id, x.text) for x in got), key=str) == sorted([(3, a), (1, b), (1, c), (None, item)], key=str)
    assert minhash.deduplicated(docs([])).count() == 0


def test_classifier_judges_rows(spark, docs):
    from keyloom.llm import quality

    good, poor = "fine clear words of a good text", "bad awful junk of a poor text"
    frame = docs([(i, (good if i % 2 else poor) + f" {i}") for i in range(200)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    more = frame.union(docs([(None, poor), (None, good), (1, poor), (0, good)]))
    got = [(x.doc_id, x.text) for x in quality.selected(more, labels).collect()]
    assert all(t.startswith("fine") for _, t in got) and {(None, good), (0, good)} <= set(got) and len(got) == 102
