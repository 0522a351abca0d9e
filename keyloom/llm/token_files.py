"""Token ids in files, packed by a Simple-8b word-aligned code.

Each 64-bit word has a 4-bit selector and 60 bits of payload; the selector says
how many ids of which width the word holds. Ids are packed in blocks of 128,
greedily and independently; an id of over 60 bits escapes to a list behind the
words, and its word holds the place in that list. Blocks have their offsets in
the header, so that all blocks are packed, and unpacked, in parallel.

A document's payload, little-endian: u32 ids, u32 words, u32 escapes, u32 end of
each block in words, the u64 words, the u64 escapes. The files are Parquet
(shard, doc_id, local_start, n_tokens, payload), one row for each document in
ascending doc_id order, one shard for each range of ids. Reading needs only the
files; a lost task writes its shard again.

Defined results: null text is empty and has the end id alone; a null doc_id comes
first; equal doc_ids follow each other; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import fresh_path, map_slices, mix64, slices, to_arrow
from .token_counts import boundaries, default_path, packed_classes, use_classes

BLOCK = 128
#: Ids and bits of a word by selector; selector 0 is unused, 1 marks an escape.
COUNTS = np.array([0, 1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
#: Pieces of text whose ids a worker remembers (about 120 bytes each).
MEMO = 1_000_000


def pack(ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The payload of each document; ids holds the documents' ids one after another."""
    ids = ids.astype(np.uint64)
    blocks = -(-sizes // BLOCK)
    first = np.cumsum(sizes) - sizes
    own = np.repeat(np.arange(len(sizes)), blocks)
    number = np.arange(len(own)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = first[own] + number * BLOCK
    n = np.minimum(BLOCK, sizes[own] - number * BLOCK)
    square = np.zeros((len(own), BLOCK + 60), np.uint64)
    bits = np.zeros((len(own), BLOCK + 60), np.uint8)
    inside = np.arange(BLOCK) < n[:, None]
    square[:, :BLOCK][inside] = ids
    # A float's exponent gives the width; it is rounded up only beyond 2^53, which at worst makes an escape.
    bits[:, :BLOCK][inside] = np.maximum((ids.astype(np.float64).view(np.int64) >> 52) - 1022, 0)
    # widest[:, i]: the most bits among the ids from i on, of as many as a selector takes; padding fits any.
    choice = np.full((len(own), BLOCK), 1, np.uint8)
    widest, have = bits, 1
    for s in range(15, 1, -1):
        while have < COUNTS[s]:
            step = min(have, int(COUNTS[s]) - have)
            moved = widest.copy()
            np.maximum(widest[:, :-step], widest[:, step:], out=moved[:, :-step])
            widest, have = moved, have + step
        choice[widest[:, :BLOCK] <= WIDTHS[s]] = s
    at, words = np.zeros(len(own), np.int64), []
    live = np.arange(len(own))
    counts, widths = COUNTS, WIDTHS.astype(np.uint64)
    escapes: dict[int, list[int]] = {}
    owners = []
    while len(live):
        s = choice[live, at[live]]
        word = s.astype(np.uint64) << np.uint64(60)
        for k in np.unique(s).tolist():
            pick = np.flatnonzero(s == k)
            rows, here = live[pick], at[live[pick]]
            if k == 1:
                for p, r, i in zip(pick, rows.tolist(), here.tolist(), strict=True):
                    held = escapes.setdefault(r, [])
                    word[p] |= np.uint64(len(held))
                    held.append(int(square[r, i]))
                continue
            payload = np.zeros(len(pick), np.uint64)
            for j in range(int(counts[k])):
                payload |= square[rows, here + j] << (np.uint64(j) * widths[k])
            word[pick] |= payload
        words.append(word)
        owners.append(live)
        at[live] += counts[s]
        live = live[at[live] < n[live]]
    if not owners:
        return [np.zeros(3, "<u4").tobytes() for _ in sizes]
    owner, word = np.concatenate(owners), np.concatenate(words)
    order = np.argsort(owner, kind="stable")
    word = word[order].astype("<u8")
    per_block = np.bincount(owner, minlength=len(own))
    ends = np.cumsum(per_block)
    cut = np.concatenate([[0], np.cumsum(blocks)])
    block_ends = np.concatenate([[0], ends])
    out = []
    for d in range(len(sizes)):
        a, b = int(cut[d]), int(cut[d + 1])
        base = int(block_ends[a])
        extra = []
        mine = word[base : int(block_ends[b])]
        if escapes and any(r in escapes for r in range(a, b)):
            mine = mine.copy()
            for r in range(a, b):
                if r in escapes:
                    part = mine[int(block_ends[r]) - base : int(block_ends[r + 1]) - base]
                    part[part >> np.uint64(60) == 1] += np.uint64(len(extra))
                    extra += escapes[r]
        head = np.concatenate([[sizes[d], len(mine), len(extra)], ends[a:b] - base]).astype("<u4")
        out.append(head.tobytes() + mine.tobytes() + np.array(extra, "<u8").tobytes())
    return out


def unpack(payloads: list[bytes]) -> list[np.ndarray]:
    """The ids of each payload, all blocks of all payloads at once."""
    if not payloads:
        return []
    heads = [np.frombuffer(x, "<u4", 3) for x in payloads]
    sizes = np.array([int(h[0]) for h in heads], np.int64)
    blocks = -(-sizes // BLOCK)
    words, per_block, extra = [], [], []
    for x, h, k in zip(payloads, heads, blocks.tolist(), strict=True):
        ends = np.frombuffer(x, "<u4", k, 12)
        per_block.append(np.diff(ends, prepend=np.uint32(0)))
        words.append(np.frombuffer(x, "<u8", int(h[1]), 12 + 4 * k))
        extra.append(np.frombuffer(x, "<u8", int(h[2]), 12 + 4 * k + 8 * int(h[1])))
    word, per_block = np.concatenate(words), np.concatenate(per_block).astype(np.int64)
    select = (word >> np.uint64(60)).astype(np.int64)
    count = COUNTS[select]
    own = np.repeat(np.arange(len(sizes)), blocks)
    number = np.arange(len(own)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = (np.cumsum(sizes) - sizes)[own] + number * BLOCK
    end = start + np.minimum(BLOCK, sizes[own] - number * BLOCK)
    block = np.repeat(np.arange(len(own)), per_block)
    before = np.cumsum(count) - count
    first = np.cumsum(per_block) - per_block
    place = start[block] + before - before[first[block]] if len(block) else before
    # A word's ids past its block's end are padding; the last word of a block may hold some.
    out = np.zeros(int(sizes.sum()) + 60, np.uint64)
    room = np.minimum(count, end[block] - place) if len(block) else count
    for k in np.unique(select).tolist():
        pick = np.flatnonzero(select == k)
        if k == 1:
            doc = own[block[pick]]
            out[place[pick]] = [extra[d][int(i)] for d, i in zip(doc.tolist(), (word[pick] & np.uint64((1 << 60) - 1)).tolist(), strict=True)]
            continue
        mask = np.uint64((1 << int(WIDTHS[k])) - 1)
        for j in range(int(COUNTS[k])):
            rest = pick[room[pick] > j]
            out[place[rest] + j] = (word[rest] >> np.uint64(j * int(WIDTHS[k]))) & mask
    return np.split(out[: int(sizes.sum())], np.cumsum(sizes)[:-1])


class Pieces:
    """Pieces of text and their ids, found in parallel by hash and confirmed by their characters."""

    def __init__(self):
        self.bits, self.n = 20, 0
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.key = np.zeros(1 << 16, np.uint64)
        self.at = {k: np.zeros(1 << 16, np.int64) for k in ("text", "chars", "ids", "n_ids")}
        self.points, self.ids = np.zeros(1 << 18, np.uint32), np.zeros(1 << 18, np.uint32)
        self.used = [0, 0]

    def find(self, key: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        out = np.full(len(key), -1, np.int32)
        live, where = np.arange(len(key)), (key >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(live):
            entry = self.slot[where]
            same = (entry >= 0) & (self.key[entry] == key[live])
            out[live[same]] = entry[same]
            go = (entry >= 0) & ~same
            live, where = live[go], (where[go] + 1) & (len(self.slot) - 1)
        return out

    def add(self, key: np.ndarray, text: np.ndarray, chars: np.ndarray, ids: np.ndarray, n_ids: np.ndarray) -> None:
        """Adds pieces with distinct new keys; text and ids hold theirs one after another."""
        n = len(key)
        while self.n + n > len(self.key):
            self.key = np.concatenate([self.key, np.zeros_like(self.key)])
            self.at = {k: np.concatenate([x, np.zeros_like(x)]) for k, x in self.at.items()}
        for i, (name, new) in enumerate((("points", text), ("ids", ids))):
            while self.used[i] + len(new) > len(held := getattr(self, name)):
                setattr(self, name, np.concatenate([held, np.zeros_like(held)]))
            getattr(self, name)[self.used[i] : self.used[i] + len(new)] = new
        put = slice(self.n, self.n + n)
        self.key[put] = key
        for k, size, used in (("text", chars, self.used[0]), ("ids", n_ids, self.used[1])):
            self.at[k][put] = used + np.cumsum(size) - size
        self.at["chars"][put], self.at["n_ids"][put] = chars, n_ids
        self.used = [self.used[0] + len(text), self.used[1] + len(ids)]
        first, self.n = self.n, self.n + n
        if 2 * self.n > len(self.slot):
            while 2 * self.n > len(self.slot):
                self.bits += 1
                self.slot = np.full(1 << self.bits, -1, np.int32)
            first = 0
        self._place(np.arange(first, self.n))

    def _place(self, entry: np.ndarray) -> None:
        where = (self.key[entry] >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(entry):
            _, first = np.unique(where, return_index=True)
            first = first[self.slot[where[first]] < 0]
            self.slot[where[first]] = entry[first]
            rest = np.ones(len(entry), bool)
            rest[first] = False
            entry, where = entry[rest], (where[rest] + 1) & (len(self.slot) - 1)


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each run, one run after another."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


#: Odd multiplier of the pieces' polynomial hash, and its inverse modulo 2^64.
_ODD = 0xD1342543DE82EF95
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Encoder:
    """Texts to ids by the tokenizers library, which is asked once for each distinct piece."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.newline = self.library.encode("\n", add_special_tokens=False).ids
        #: Whether pieces are those of boundaries(), so that they can be encoded apart.
        self.plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and len(self.newline) == 1
        self.known, self.powers, self.inverse = Pieces(), _powers(_ODD, 1), _powers(_ODD_INVERSE, 1)

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _add(self, key: np.ndarray, pieces: list[str], ids: np.ndarray, n_ids: np.ndarray) -> None:
        text = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
        self.known.add(key, text, np.fromiter(map(len, pieces), np.int64, len(pieces)), ids, n_ids)

    def _learn(self, key: np.ndarray, pieces: list[str]) -> None:
        """Asks the library for new pieces, many to a call: behind a line end each is a pre-token of its own."""
        apart = [i for i, x in enumerate(pieces) if x.isspace()]
        for i in apart:
            ids = self._library(pieces[i])
            self._add(key[i : i + 1], [pieces[i]], ids, np.array([len(ids)]))
        rest = np.setdiff1d(np.arange(len(pieces)), apart)
        for i in range(0, len(rest), 5000):
            part = rest[i : i + 5000]
            ids = self._library("\n".join([pieces[j] for j in part]))
            ends = ids == self.newline[0]
            n_ids = np.diff(np.flatnonzero(ends), prepend=-1, append=len(ids)) - 1
            if len(n_ids) != len(part):
                raise ValueError("pieces were not encoded apart")
            self._add(key[part], [pieces[j] for j in part], ids[~ends], n_ids)

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        alone = {i for i, x in enumerate(texts) if x and (not self.plain or any(s in x for s in self.special))}
        some = [i for i, x in enumerate(texts) if x and i not in alone]
        found, n = np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        if some:
            found, n[some], odd = self._pieced([texts[i] for i in some])
            alone |= {some[i] for i in odd}
        if not alone:
            return found, n
        parts = np.split(found, np.cumsum(n)[:-1])
        for i in alone:
            parts[i] = self._library(texts[i])
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    def _pieced(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """ids and their numbers, and the texts of which a piece met another's hash."""
        text, ends = "".join(texts), np.cumsum([len(x) for x in texts])
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts = np.flatnonzero(boundaries(points, ends))
        chars = np.diff(starts, append=len(points))
        if len(self.powers) <= len(points):
            self.powers, self.inverse = _powers(_ODD, len(points) + 1), _powers(_ODD_INVERSE, len(points) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points + np.uint64(0x9E3779B97F4A7C15)) * self.powers[: len(points)])])
        key = mix64((sums[starts + chars] - sums[starts]) * self.inverse[starts] ^ chars.astype(np.uint64))
        if self.known.n > MEMO:
            self.known = Pieces()
        entry = self.known.find(key)
        if len(new := np.flatnonzero(entry < 0)):
            names, first = np.unique(key[new], return_index=True)
            at = starts[new[first]].tolist()
            self._learn(names, [text[a : a + c] for a, c in zip(at, chars[new[first]].tolist(), strict=True)])
            entry[new] = self.known.find(key[new])
        held = self.known.at
        n_ids = held["n_ids"][entry]
        cuts = np.searchsorted(starts, np.concatenate([[0], ends]))
        total = np.concatenate([[0], np.cumsum(n_ids)])
        odd = held["chars"][entry] != chars
        if not odd.any():
            differs = self.known.points[_runs(held["text"][entry], chars)] != points
            odd_at = np.flatnonzero(differs)
        else:
            odd_at = starts[odd]
        bad = np.unique(np.searchsorted(ends, odd_at, "right")).tolist()
        return self.known.ids[_runs(held["ids"][entry], n_ids)], total[cuts[1:]] - total[cuts[:-1]], bad


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str | None) -> Encoder:
    path = path or default_path()
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


FILE_SCHEMA = "shard int, doc_id long, local_start long, n_tokens long, payload binary"


def write_tokens(docs: DataFrame, to: str, path: str | None = None, end_id: int = 2, shards: int | None = None) -> None:
    """Writes the ids of docs (doc_id, text), each text followed by end_id, to the folder `to`."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    target, packed = to_arrow(FILE_SCHEMA), packed_classes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_classes(packed)
        shard, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for i, j in slices(sizes):
                part = batch.slice(i, j - i).to_pydict()
                ids, n = encoder_of(path).ids(part["text"])
                ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([shard] * len(n), part["doc_id"], starts, n, pack(ids, n)), target, strict=True)], schema=target)

    # Equal and null ids follow each other by their place in the input, so that none of them fills a task.
    order = [F.col("doc_id").asc_nulls_first(), F.col("_row")]
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row"))
    sorted_docs = numbered.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")
    sorted_docs.mapInArrow(run, FILE_SCHEMA).write.option("compression", "zstd").parquet(to)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (array of long) of every document in the files."""
    return _decoded(spark, path, lambda ids: ids.astype(np.int64), "ids array<long>")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files."""
    return _decoded(spark, path, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), "ids_crc32 long")


def _decoded(spark: SparkSession, path: str, made, column: str) -> DataFrame:
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    name = column.split()[0]

    def step(rows: dict) -> dict:
        ids = unpack(rows["payload"])
        return {k: rows[k] for k in ("shard", "doc_id", "local_start")} | {"n_tokens": [len(x) for x in ids], name: [made(x) for x in ids]}

    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    # One row for each shard: as many as there are range partitions.
    base = totals.select("shard", F.coalesce(before, F.lit(0)).alias("base"))
    decoded = map_slices(files, step, f"shard int, doc_id long, local_start long, n_tokens long, {column}", "payload")
    return decoded.join(F.broadcast(base), "shard").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", name)


def round_trip(docs: DataFrame, path: str | None = None, end_id: int = 2) -> DataFrame:
    """Writes docs to the shared folder and returns the digests read back."""
    to = fresh_path(docs.sparkSession, "tokens")
    write_tokens(docs, to, path, end_id)
    return token_digests(docs.sparkSession, to)
