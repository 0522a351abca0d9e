"""Quality rules: base counts, and divergence from a language's usual text.

The method compares two histograms of a document with the sums over all
documents of its language: classes of characters, and common words. Distances
are Jensen-Shannon distances (the root of the divergence in bits, 0 to 1). A
document of at least MIN_WORDS words is rejected if its characters alone are
far off, or if its characters and its common words both are; the allowance for
words grows for short documents, whose histograms scatter.

Words are `[^\\x20\\x09-\\x0D]+` of the whole text. Defined results: null or empty
text has no words and fails the base rule; documents of a language with fewer
than MIN_REFERENCE words in all, or without language, are compared by characters
alone, with all languages together; without any reference only the base rule
holds; repeated rows count each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import bounded, map_slices, stored, to_arrow

#: Characters that the base rule counts.
SYMBOLS = b"#*$%&|<>"
#: Common words of the supported languages (fixed values).
COMMON = (
    "the of and to in is that for it as with was on be by this are from or an at he a not his but have had they you which one we all her she there would their"
    " der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum"
    " de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son aux cette ou ses mais comme on tout nous sa été"
    " el que los se del las por con no una su para es al lo como más o pero sus le ya este sí porque esta entre cuando muy sin sobre también me hasta hay donde"
)
#: Classes of characters: lower, upper, digit, blank, other white space, sentence marks, !, symbols, other ASCII, non-ASCII.
CLASSES = 10
#: The class distance that rejects by itself; the distances that reject together, to the second of which sqrt(SCATTER / words) is added.
MAX_CLASS, PAIR_CLASS, PAIR_COMMON, SCATTER = 0.30, 0.125, 0.25, 16.0
#: The fewest words of a document that is compared, and of a language's reference.
MIN_WORDS, MIN_REFERENCE = 50, 10_000

_HISTOGRAMS = ("classes", "common", "usual_classes", "usual_common")
_SPACE = b" \t\n\r\x0b\x0c"
_TAIL = bytes(range(0x80, 0xC0))
_COMMON = {w.encode(): i for i, w in enumerate(sorted(set(COMMON.split())))}


def _class(c: int) -> int:
    if c >= 128:
        return 9
    ch = chr(c)
    if ch.islower():
        return 0
    if ch.isupper():
        return 1
    return 2 if ch.isdigit() else 3 if ch == " " else 4 if c in _SPACE else 5 if ch in ".,;:?'\"()-" else 6 if ch == "!" else 7 if c in SYMBOLS else 8


_CLASS = bytes(map(_class, range(256)))


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def repeated_words(found: list[bytes]) -> int:
    """Words within 3-word windows that occur twice or more in the text."""
    if len(found) < 4:
        return 0
    ids = _Ids()
    x = np.fromiter(map(ids.__getitem__, found), np.int64, len(found))
    if len(ids) < 1 << 21:
        keys, axis = (x[:-2] << 42) | (x[1:-1] << 21) | x[2:], None
    else:
        keys, axis = np.stack([x[:-2], x[1:-1], x[2:]], axis=1), 0
    _, which, n = np.unique(keys, return_inverse=True, return_counts=True, axis=axis)
    twice = n[which.ravel()] > 1
    if not twice.any():
        return 0
    inside = np.zeros(len(x), bool)
    for i in range(3):
        inside[i : i + len(twice)] |= twice
    return int(inside.sum())


def _measured(text: str | None) -> tuple[int, int, int, int, int, np.ndarray, np.ndarray]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    found = raw.split()
    seen, again = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            again += bool(line.split())
        else:
            seen.add(line)
    classes = np.bincount(np.frombuffer(raw.translate(_CLASS, _TAIL), np.uint8), minlength=CLASSES)
    common = np.zeros(len(_COMMON), np.int64)
    for w in raw.lower().split():
        at = _COMMON.get(w.strip(b".,;:!?#*$%&|"))
        if at is not None:
            common[at] += 1
    return len(found), len(raw.translate(None, _SPACE + _TAIL)), len(raw) - len(raw.translate(None, SYMBOLS)), again, repeated_words(found), classes, common


def features(docs: DataFrame) -> DataFrame:
    """The counts and histograms of every row of docs (doc_id, text, lang)."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "common")

    def step(rows: dict) -> dict:
        got = [_measured(x) for x in rows["text"]]
        return {"doc_id": rows["doc_id"], "lang": rows["lang"]} | {k: [x[i] for x in got] for i, k in enumerate(names)}

    return map_slices(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text"), step, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, classes array<long>, common array<long>")


def distances(own: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """The Jensen-Shannon distance of each row of counts to the row of the other; 0 where either has no counts."""
    n, m = (x.sum(axis=1, keepdims=True, dtype=np.float64) for x in (own, usual))
    p, q = own / np.maximum(n, 1), usual / np.maximum(m, 1)
    mid = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = sum(np.where(x > 0, x * np.log2(x / mid), 0.0).sum(axis=1) for x in (p, q)) / 2
    return np.where((n > 0).ravel() & (m > 0).ravel(), np.sqrt(np.maximum(parts, 0)), 0.0)


def _compared(joined: DataFrame) -> DataFrame:
    """joined with the histograms replaced by class_distance and common_distance."""
    kept = [c for c in joined.columns if c not in _HISTOGRAMS]
    schema = StructType([*(joined.schema[c] for c in kept), *(StructField(f"{k}_distance", DoubleType()) for k in ("class", "common"))])
    target = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = lambda name: batch.column(batch.schema.get_field_index(name)).flatten().to_numpy().reshape(len(batch), -1)
            far = [pa.array(distances(table(a), table(b))) for a, b in (("classes", "usual_classes"), ("common", "usual_common"))] if len(batch) else [pa.array([], pa.float64())] * 2
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *far], schema=target)

    return joined.mapInArrow(run, schema)


def judged(docs: DataFrame) -> DataFrame:
    """The base counts, both distances, base_failed and kept for every row of docs (doc_id, text, lang)."""
    found = stored(features(docs), "features")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    sums = lambda k, n: F.array(*(F.sum(F.col(k)[i]) for i in range(n))).alias(f"usual_{k}")
    both = [sums("classes", CLASSES), sums("common", len(_COMMON)), F.sum("n_words").alias("held")]
    good = found.where(~failed)
    usual = stored(good.groupBy("lang").agg(*both), "references").where((F.col("held") >= MIN_REFERENCE) & (F.col("lang") != ""))
    every = usual.agg(F.array(*(F.coalesce(F.sum(F.col("usual_classes")[i]), F.lit(0)) for i in range(CLASSES))).alias("all_classes"))
    # One row, found under a key of its own by those without a reference.
    every = every.select("all_classes", F.lit(True).alias("none"))
    out = found.join(bounded(usual, 10_000), "lang", "left").withColumn("without", F.col("usual_classes").isNull())
    out = out.join(F.broadcast(every), F.col("without") == F.col("none"), "left")
    out = out.withColumn("usual_classes", F.coalesce("usual_classes", "all_classes", F.array_repeat(F.lit(0).cast("long"), CLASSES)))
    out = out.withColumn("usual_common", F.coalesce("usual_common", F.array_repeat(F.lit(0).cast("long"), len(_COMMON))))
    out = _compared(out.select(*(c for c in found.columns), "usual_classes", "usual_common"))
    allowed = PAIR_COMMON + F.sqrt(SCATTER / F.greatest(F.col("n_words"), F.lit(1)))
    odd = (F.col("class_distance") > MAX_CLASS) | ((F.col("class_distance") > PAIR_CLASS) & (F.col("common_distance") > allowed))
    odd = (F.col("n_words") >= MIN_WORDS) & odd
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~odd).alias("kept"), "class_distance", "common_distance")
