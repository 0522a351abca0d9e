"""Benchmark decontamination by winnowing.

Texts are words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. Of
every 4 consecutive 5-word grams the rightmost one with the least hash is kept.
Two texts that share 8 words in a row share 4 such grams, hence a kept one at
the same place of the span, so every span of 8 or more words is found. Test and
training fingerprints are joined and each hit is extended word by word.

The fingerprints of the test set go to the workers only while its text is under
INDEX_BYTES; a larger one is joined by shuffle, with the same results.

Defined results: null or wordless text has no words and no hits; a test item of
fewer than 8 words is one window of its length; items without id are ignored;
repeated item rows count once; repeated document rows each get their result;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HASHES, M2, bounded, filter_slices, free, map_slices, mix64, stored

WINDOW, GRAM = 8, 5
#: Test-set text, in bytes, up to which its index is sent to every worker.
INDEX_BYTES = 16_000_000

_WORD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD).split()


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n consecutive words."""
    out = np.full(max(0, len(h) - n + 1), np.uint64(n))
    for i in range(n):
        out = mix64(out * M2 + h[i : i + len(out)])
    return out


def winnowed(g: np.ndarray, window: int = WINDOW - GRAM + 1) -> np.ndarray:
    """Positions of the rightmost least hash of each window (of all, if there are fewer)."""
    n = len(g) - window + 1
    if n < 1:
        return np.empty(0, np.int64)
    low, at = g[:n].copy(), np.arange(n)
    for i in range(1, window):
        new = g[i : i + n]
        take = new <= low
        low, at = np.where(take, new, low), np.where(take, np.arange(i, i + n), at)
    return np.unique(at)


class Index:
    """The fingerprints of a test set, and its words to extend hits with."""

    def __init__(self, items: list[tuple[str, str | None]]):
        self.ids, self.words, self.starts, self.ends = [], [], [], []
        fp, self.short = [], {}
        at = 0
        for name, text in items:
            h = HASHES.of(words(text))
            if 0 < len(h) < WINDOW:
                self.short.setdefault(len(h), {}).setdefault(int(grams(h, len(h))[0]), []).append(name)
            elif len(h):
                g = grams(h, GRAM)
                fp += [(int(g[p]), len(self.ids), at + int(p)) for p in winnowed(g)]
                self.ids.append(name)
                self.words.append(h)
                self.starts.append(at)
                at += len(h)
                self.ends.append(at)
        fp.sort()
        self.words = np.concatenate(self.words) if self.words else np.empty(0, np.uint64)
        self.hash = np.array([x[0] for x in fp], np.uint64)
        self.item, self.pos = (np.array([x[k] for x in fp], np.int64) for k in (1, 2))
        self.short = {n: (np.array(sorted(x), np.uint64), x) for n, x in self.short.items()}

    def hits(self, h: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, str]]:
        """(document, first word, end, item) of the runs of 8 or more words that documents share with items.

        h holds the words of documents one after another; ends is where each ends.
        """
        out = []
        owner = lambda n: np.searchsorted(ends, np.arange(n), "right")
        if len(self.hash) and len(h) >= WINDOW:
            g = grams(h, GRAM)
            doc = owner(len(h))
            g = np.where(doc[: len(g)] == doc[GRAM - 1 :], g, ~np.uint64(0))
            picked = winnowed(g)
            picked = picked[_among(g[picked], self.hash)]
            covered: dict[tuple[int, int], int] = {}
            first, last = np.searchsorted(self.hash, g[picked], "left"), np.searchsorted(self.hash, g[picked], "right")
            for p, i, j in zip(picked.tolist(), first.tolist(), last.tolist(), strict=True):
                d = int(doc[p])
                low, high = int(ends[d - 1]) if d else 0, int(ends[d])
                for item, q in zip(self.item[i:j].tolist(), self.pos[i:j].tolist(), strict=True):
                    if covered.get((item, p - q), -1) > p:
                        continue
                    n = min(p - low, q - self.starts[item])
                    odd = np.flatnonzero(h[p - n : p] != self.words[q - n : q])
                    begin = p - n + (int(odd[-1]) + 1 if len(odd) else 0)
                    n = min(high - p, self.ends[item] - q)
                    odd = np.flatnonzero(h[p : p + n] != self.words[q : q + n])
                    end = p + (int(odd[0]) if len(odd) else n)
                    covered[item, p - q] = max(end, p + 1)
                    if end - begin >= WINDOW:
                        out.append((d, begin, end, self.ids[item]))
        for n, (known, names) in self.short.items():
            if len(h) >= n:
                g, doc = grams(h, n), owner(len(h))
                for p in np.flatnonzero(_among(g, known) & (doc[: len(g)] == doc[n - 1 :])).tolist():
                    out += [(int(doc[p]), p, p + n, x) for x in names[int(g[p])]]
        return out


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted array known; a bit table settles most of them."""
    table = np.zeros(1 << 20, bool)
    table[known >> np.uint64(44)] = True
    out = table[x >> np.uint64(44)]
    at = np.flatnonzero(out)
    near = np.minimum(np.searchsorted(known, x[at]), len(known) - 1)
    out[at] = known[near] == x[at]
    return out


def digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(set(names))).encode()).hexdigest()


def contamination(docs: DataFrame, benchmark: DataFrame, limit: int = 2, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and hits (start and end words), for every row of docs."""
    items = _items(benchmark)
    found = _by_index(docs, items) if _bytes(items) <= index_bytes else _by_shuffle(docs, items).drop("t1", "t2")
    return found.withColumn("contaminated", F.col("n_items") >= limit)


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("item_text"))


def _bytes(items: DataFrame) -> int:
    return items.agg(F.sum(F.octet_length("item_text") + 64)).first()[0] or 0


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, starts array<long>, ends array<long>"


def _by_index(docs: DataFrame, items: DataFrame) -> DataFrame:
    index = docs.sparkSession.sparkContext.broadcast(Index([tuple(x) for x in items.distinct().collect()]))

    def step(rows: dict) -> dict:
        found = [words(x) for x in rows["text"]]
        ends = np.cumsum([len(x) for x in found])
        h = HASHES.of([w for x in found for w in x])
        runs: dict[int, list] = {}
        for d, begin, end, item in index.value.hits(h, ends):
            runs.setdefault(d, []).append((begin, end, item))
        out = {k: [] for k in ("n_hit", "n_items", "items_sha256", "starts", "ends")}
        none = digest([])
        for d in range(len(found)):
            base, spans = int(ends[d]) - len(found[d]), []
            for begin, end in sorted((x[0] - base, x[1] - base) for x in runs.get(d, ())):
                if spans and begin <= spans[-1][1]:
                    spans[-1][1] = max(end, spans[-1][1])
                else:
                    spans.append([begin, end])
            names = {x[2] for x in runs.get(d, ())}
            row = (sum(b - a for a, b in spans), len(names), digest(list(names)) if names else none, [x[0] for x in spans], [x[1] for x in spans])
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        return out | {"doc_id": rows["doc_id"], "n_words": [len(x) for x in found]}

    return map_slices(docs.select("doc_id", "text"), step, SCHEMA)


def _windows(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of n words: the fingerprint that winnowing keeps for it (a short window's own hash), and two hashes that name it."""
    own = grams(h, n)
    if n < WINDOW:
        return own, own, grams(mix64(h ^ M2), n)
    g, low = grams(h, GRAM), None
    for i in range(WINDOW - GRAM + 1):
        part = g[i : i + len(own)]
        low = part if low is None else np.minimum(low, part)
    return low, own, grams(mix64(h ^ M2), n)


def _by_shuffle(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The same by joins: fingerprints find documents and the windows around them, and windows are extended to runs by their names.

    A text goes along once with its document, never with a pair, and items that
    share a window are one row. Documents with the same id and text share a result.
    """
    items = items.distinct()
    by = ["doc_id", "t1", "t2"]
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("t1"), F.hash("text").alias("t2"))
    sized = map_slices(items.withColumnRenamed("item_text", "text"), lambda r: {"n": [len(words(x)) for x in r["text"]]}, "n int")
    sizes = sorted({WINDOW, *(x.n for x in sized.where(f"n between 1 and {WINDOW - 1}").distinct().collect())})
    signed = lambda x: x.view(np.int64).tolist()

    def of_items(rows: dict) -> dict:
        out = {k: [] for k in ("item", "n", "h", "w1", "w2")}
        for item, text in zip(rows["item"], rows["text"], strict=True):
            h = HASHES.of(words(text))
            n = min(WINDOW, len(h))
            if n:
                for row in set(zip(*map(signed, _windows(h, n)), strict=True)):
                    for k, v in zip(out, (item, n, *row), strict=True):
                        out[k].append(v)
        return out

    def of_docs(rows: dict) -> dict:
        out = {k: [] for k in (*by, "n", "h")}
        for i, text in enumerate(rows["text"]):
            h = HASHES.of(words(text))
            for n in sizes:
                g = grams(h, min(n, GRAM) if n == WINDOW else n)
                for x in signed(np.unique(g[winnowed(g)] if n == WINDOW else g)):
                    for k, v in zip(out, (*(rows[k][i] for k in by), n, x), strict=True):
                        out[k].append(v)
        return out

    def around(rows: dict) -> dict:
        """The windows of documents whose fingerprints are among those found."""
        out = {k: [] for k in (*by, "n", "begin", "w1", "w2")}
        for i, text in enumerate(rows["text"]):
            h, found = HASHES.of(words(text)), {}
            for x in rows["found"][i]:
                found.setdefault(x["n"], []).append(x["h"])
            for n, known in found.items():
                low, one, two = _windows(h, n)
                for p in np.flatnonzero(np.isin(low.view(np.int64), known)).tolist():
                    for k, v in zip(out, (*(rows[k][i] for k in by), n, p, int(one.view(np.int64)[p]), int(two.view(np.int64)[p])), strict=True):
                        out[k].append(v)
        return out

    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.t1") == F.col(f"{b}.t1")) & (F.col(f"{a}.t2") == F.col(f"{b}.t2"))
    test = stored(map_slices(items.select("item", F.col("item_text").alias("text")), of_items, "item string, n int, h long, w1 long, w2 long"), "test")
    named = stored(test.groupBy("n", "w1", "w2").agg(F.array_sort(F.collect_set("item")).alias("names")), "windows")
    prints = stored(test.select("n", "h").distinct(), "prints")
    once = docs.dropDuplicates(by)
    train = map_slices(once, of_docs, "doc_id long, t1 long, t2 int, n int, h long")
    found = train.join(bounded(prints), ["n", "h"], "left_semi").groupBy(*by).agg(F.collect_list(F.struct("n", "h")).alias("found"))
    near = once.alias("d").join(found.alias("f"), same("d", "f")).select("d.*", "f.found")
    windows = map_slices(near, around, "doc_id long, t1 long, t2 int, n int, begin long, w1 long, w2 long")
    runs = stored(windows.join(named, ["n", "w1", "w2"]).select(*by, "begin", (F.col("begin") + F.col("n")).alias("end"), "names"), "runs")
    spans = runs.groupBy(*by, "begin").agg(F.max("end").alias("end"))
    before = F.max("end").over(Window.partitionBy(*by).orderBy("begin").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(F.col("begin") > before, 1).when(before.isNull(), 1).otherwise(0))
    spans = spans.withColumn("span", F.sum("new").over(Window.partitionBy(*by).orderBy("begin")))
    spans = spans.groupBy(*by, "span").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    spans = spans.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"))
    names = runs.select(*by, "names").distinct().select(*by, F.explode("names").alias("item"))
    names = names.groupBy(*by).agg(F.array_sort(F.collect_set("item")).alias("names"))
    found = names.join(spans, (names.doc_id.eqNullSafe(spans.doc_id)) & (names.t1 == spans.t1) & (names.t2 == spans.t2)).select(names.doc_id.alias("f_id"), names.t1.alias("f1"), names.t2.alias("f2"), "names", "spans")
    counted = map_slices(docs, lambda r: {k: r[k] for k in by} | {"n_words": [len(words(x)) for x in r["text"]]}, "doc_id long, t1 long, t2 int, n_words long")
    joined = counted.join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("t1") == F.col("f1")) & (F.col("t2") == F.col("f2")), "left")
    names, spans = F.coalesce("names", F.array().cast("array<string>")), F.coalesce("spans", F.array().cast("array<struct<begin:long,end:long>>"))
    length = F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["begin"])
    return joined.select("doc_id", F.col("t1"), F.col("t2"), "n_words", length.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), F.transform(spans, lambda x: x["begin"]).alias("starts"), F.transform(spans, lambda x: x["end"]).alias("ends"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, limit: int = 2, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows of docs without contaminated documents; each row is judged by its own text, whatever its doc_id."""
    items = _items(benchmark)
    if _bytes(items) > index_bytes:
        t1, t2 = free(docs, "t1", "t2")
        gone = stored(_by_shuffle(docs, items).where(F.col("n_items") >= limit).select("doc_id", "t1", "t2").distinct(), "contaminated")
        keyed = docs.withColumn(t1, F.xxhash64("text")).withColumn(t2, F.hash("text")).alias("d")
        same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col(f"d.{t1}") == F.col("g.t1")) & (F.col(f"d.{t2}") == F.col("g.t2"))
        return keyed.join(bounded(gone).alias("g"), same, "left_anti").drop(t1, t2)
    index = docs.sparkSession.sparkContext.broadcast(Index([tuple(x) for x in items.distinct().collect()]))

    def keep(texts: list) -> list:
        found = [words(x) for x in texts]
        names: dict[int, set] = {}
        for d, _, _, item in index.value.hits(HASHES.of([w for x in found for w in x]), np.cumsum([len(x) for x in found])):
            names.setdefault(d, set()).add(item)
        return [len(names.get(d, ())) < limit for d in range(len(found))]

    return filter_slices(docs, keep)
