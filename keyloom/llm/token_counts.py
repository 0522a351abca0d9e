"""Token counts by a finite-state transducer compiled from a byte-level BPE file.

A text is cut into pre-tokens by class transitions of its characters, which are
closed-form here. Within a pre-token a deterministic transducer reads bytes;
each transition carries the change in the number of tokens (joining a token
makes it negative). Its states are what the past can still decide: for every
suffix that may begin a token, the token before it and the count there. States
are finite and compiled when first reached, so that a worker's tables hold what
its texts need.

Texts are read in chunks of CHUNK bytes, all chunks of all texts of a slice in
parallel. What a chunk does is a map from the state it is entered in to the state
it is left in and the tokens counted: up to its first pre-token this depends on the
entry and is tabulated for the entries that can occur; behind it, it does not. The
maps compose, and a parallel prefix scan (rounds that double the reach) gives the
state and the count at every chunk's end. Chunks may end anywhere, within a
pre-token or a character too.

Counts equal those of the tokenizers library for the file, with special strings
inside texts taken as special tokens. Texts of over MOST_TEXT code points are read
in parts that end where white space follows something else, where no token goes
across. Defined results: null and empty text have no tokens; repeated rows each
get their result; extra columns are ignored.
"""

from __future__ import annotations

import json
import sys
import unicodedata
import zlib

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from .common import map_slices

#: Bytes of a chunk, code points of a text read at once, and states (1 KB each) that a worker's tables may hold before they are compiled anew.
CHUNK, MOST_TEXT, MOST_STATES = 1 << 12, 1_000_000, 150_000
#: Bytes before a chunk that tell the entries to tabulate for it, and the states tried there.
BEFORE, TRIED_STATES = 48, 16
#: Tokens with a common beginning up to which a state checks whether any can still come.
TRIED = 40

_LETTER, _NUMBER, _BLANK, _SPACE, _EDGE = 1, 2, 3, 4, 5
_WHITE = [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of every code point: other, letter, number, blank, other white space."""
    global _classes
    if _classes is None:
        every = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
        table = np.zeros(sys.maxunicode + 1, np.uint8)
        table[every] = [{"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], 0) for c in every]
        # Where two Unicode versions differ, the library is asked for its own.
        other, text = np.zeros_like(table), "".join(map(chr, every))
        for kind, name in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
            for m in regex.finditer(name, text):
                other[[ord(c) for c in m[0]]] = kind
        cut = ByteLevel(add_prefix_space=False).pre_tokenize_str
        for c in np.flatnonzero(table != other).tolist():
            table[c] = _LETTER if len(cut("a" + chr(c))) == 1 else _NUMBER if len(cut("1" + chr(c))) == 1 else 0
        _classes = table
        _classes[_WHITE], _classes[32] = _SPACE, _BLANK
    return _classes


def packed_classes() -> bytes:
    """classes() for other machines, some kilobytes."""
    return zlib.compress(classes().tobytes())


def use_classes(packed: bytes) -> None:
    """Takes another machine's table, so that a worker doesn't ask for every code point again."""
    global _classes
    if _classes is None:
        _classes = np.frombuffer(zlib.decompress(packed), np.uint8)


def boundaries(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in texts laid end to end; ends is where each (non-empty) text ends."""
    kind = classes()[points]
    before, after = np.empty_like(kind), np.empty_like(kind)
    before[1:], after[:-1] = kind[:-1], kind[1:]
    before[np.concatenate([[0], ends[:-1]])], after[ends - 1] = _EDGE, _EDGE
    white, white_before = kind >= _BLANK, (before == _BLANK) | (before == _SPACE)
    start = np.where(white, ~white_before | (after < _BLANK), (before != kind) & (before != _BLANK))
    # Contractions: 's 't 'm 'd 're 've 'll, where an apostrophe starts a pre-token.
    for i in np.flatnonzero((points == 39) & start):
        rest = points[i + 1 : i + 3].tolist()
        last = int(ends[np.searchsorted(ends, i, "right")])
        n = 2 if rest and chr(rest[0]) in "stmd" else 3 if len(rest) == 2 and chr(rest[0]) + chr(rest[1]) in ("re", "ve", "ll") else 0
        if n and i + n <= last:
            start[i + 1] = False
            if i + n < last:
                start[i + n] = True
    return start


def _byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Spines(dict):
    """token -> the pieces at one end of it while it is built, each with the rank of the merge that ends it."""

    def __init__(self, parts: dict, side: int):
        self.parts, self.side = parts, side

    def __missing__(self, token: bytes) -> list[tuple[bytes, int]]:
        out, part, end = [], token, 1 << 60
        while True:
            out.append((part, end))
            if part not in self.parts:
                break
            end, part = self.parts[part][2], self.parts[part][self.side]
        self[token] = out
        return out


class _Alone(dict):
    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, token: bytes) -> bool:
        self[token] = self.encode(token) == [token]
        return self[token]


class Transducer:
    """Counts BPE tokens of pre-tokens, in parallel; compiled as it reads."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("dropout") or model.get("ignore_merges") or spec.get("normalizer"):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        names = _byte_names()
        self.special = [x["content"] for x in spec.get("added_tokens", []) if x.get("special")]
        raw = lambda s: bytes(names[c] for c in s)
        self.tokens = {raw(k) for k in model["vocab"] if k not in self.special}
        merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        self.open: dict[bytes, list[bytes]] = {}
        for t in self.tokens:
            for i in range(1, len(t)):
                self.open.setdefault(t[:i], []).append(t)
        parts = {a + b: (a, b, r) for (a, b), r in self.rank.items()}
        #: The pieces at the ends of tokens, and whether tokens encode as themselves; filled when first asked for.
        self.left, self.right, self.alone = _Spines(parts, 0), _Spines(parts, 1), _Alone(self.encode)
        self.reset()

    def reset(self) -> None:
        self.names: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.futures: dict[tuple[bytes, bytes], int | bytes] = {}
        self.like: dict[tuple, bytes] = {}
        #: For each state and byte 256 * (next state) + 128 + gain, or -1.
        self.next = np.full(1024 * 256, -1, np.int32)
        self._state(((b"", b"", 0),))

    def _state(self, key: tuple) -> int:
        n = self.names.get(key)
        if n is None:
            n = self.names[key] = len(self.states)
            self.states.append(key)
            if n * 256 >= len(self.next):
                self.next = np.concatenate([self.next, np.full(len(self.next) // 2, -1, np.int32)])
        return n

    def encode(self, raw: bytes) -> list[bytes]:
        """Plain BPE, the definition that transitions are compiled from."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best, at = min(((self.rank.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if best == 1 << 60:
                break
            pair, out, i = (parts[at], parts[at + 1]), [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def follows(self, before: bytes, token: bytes) -> bool:
        """Whether token can come after before (nothing: begin a pre-token) in an encoding.

        It can unless some piece at the end of one meets a piece at the start of
        the other and their merge comes before those that end them.
        """
        if not before:
            return self.alone[token]
        if not self.alone[token]:
            return False
        rank = self.rank.get
        return not any((r := rank((x, y))) is not None and r < x_end and r <= y_end for x, x_end in self.right[before] for y, y_end in self.left[token])

    def future(self, suffix: bytes, before: bytes) -> int | bytes:
        """What may come of a token that begins with suffix after before: 0 if nothing, else a name of the possible tokens.

        Common suffixes, of which more than TRIED tokens come, are named by before itself.
        """
        longer = self.open.get(suffix, ())
        if not longer or len(longer) > TRIED or not before:
            return before if longer else 0
        key = (suffix, before)
        known = self.futures.get(key)
        if known is None:
            left = tuple(t for t in longer if self.follows(before, t))
            known = self.futures[key] = (self.like.setdefault((suffix, left), before) if left else 0)
        return known

    def compile(self, state: int, byte: int) -> None:
        """Fills one transition: a state lists (suffix, token before it, count there less the count now)."""
        found, longer = None, []
        for suffix, before, count in self.states[state]:
            grown = suffix + bytes([byte])
            if found is None and grown in self.tokens and self.follows(before, grown):
                found = (grown, count + 1)
            if (name := self.future(grown, before)) != 0:
                longer.append((grown, name, count))
        token, gain = found
        target = self._state((*((s, b, c - gain) for s, b, c in longer), (b"", token, 0)))
        self.next[state * 256 + byte] = target * 256 + 128 + gain

    def run(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, entry: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each stretch raw[start : start + size], read from the entry state (the first one without): tokens counted, and state at its end."""
        order = np.argsort(-sizes, kind="stable")
        at, size = starts[order], sizes[order]
        state, count = np.zeros(len(at), np.int32), np.zeros(len(at), np.int32)
        if entry is not None:
            state[:] = entry[order] << 8
        live = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), "right") if len(size) else []
        for k, n in enumerate(live):
            now = state[:n] + raw[at[:n] + k]
            to = self.next[now]
            if (missing := np.flatnonzero(to < 0)).size:
                for x in set(now[missing].tolist()):
                    self.compile(x >> 8, x & 255)
                to = self.next[now]
            count[:n] += (to & 255) - 128
            state[:n] = to & ~255
        counts, states = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        counts[order], states[order] = count, state >> 8
        return counts, states

    def counts(self, texts: list[str], chunk: int = CHUNK) -> np.ndarray:
        """The number of tokens in each (non-empty) text without special strings."""
        if not texts:
            return np.zeros(0, np.int64)
        if len(self.states) > MOST_STATES:
            self.reset()
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        raw = np.frombuffer(whole.encode(), np.uint8)
        ends = np.cumsum([len(x) for x in texts])
        width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        place = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
        # Pre-tokens and chunks cut the bytes into stretches; a stretch at a chunk's begin alone is entered in a state that the chunk before leaves.
        begins, text_at = place[np.flatnonzero(boundaries(points, ends))], place[np.concatenate([[0], ends])]
        edges = np.concatenate([np.arange(a, b, chunk) for a, b in zip(text_at[:-1].tolist(), text_at[1:].tolist(), strict=True)])
        starts = np.union1d(begins, edges)
        sizes = np.diff(starts, append=len(raw))
        closed = np.isin(starts, begins, assume_unique=True)
        tokens, states = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        tokens[closed], states[closed] = self.run(raw, starts[closed], sizes[closed])
        tokens[~closed] = self._chained(raw, starts, sizes, closed, states)
        total = np.concatenate([[0], np.cumsum(tokens)])
        cuts = np.searchsorted(starts, text_at)
        return total[cuts[1:]] - total[cuts[:-1]]

    def _chained(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, closed: np.ndarray, states: np.ndarray) -> np.ndarray:
        """The tokens of the stretches that are entered within a pre-token, by the maps of their chunks."""
        open_at = np.flatnonzero(~closed)
        if not len(open_at):
            return np.empty(0, np.int64)
        first = closed[open_at - 1]
        entries, of = [states[open_at[first] - 1]], [np.flatnonzero(first)]
        if not first.all():
            # Whole chunks within a pre-token: what is read before a chunk from a few states tells the entries that can occur.
            later = np.flatnonzero(~first)
            near = np.minimum(BEFORE, sizes[open_at[later] - 1])
            tried = np.unique(np.concatenate([[0], np.unique(states[closed])[:TRIED_STATES]]))
            lane = np.repeat(later, len(tried))
            _, left = self.run(raw, starts[open_at[lane]] - np.repeat(near, len(tried)), np.repeat(near, len(tried)), np.tile(tried, len(later)))
            pairs = np.unique(np.stack([lane, left], axis=1), axis=0)
            entries.append(pairs[:, 1])
            of.append(pairs[:, 0])
        entries, of = np.concatenate(entries), np.concatenate(of)
        counts, exits = self.run(raw, starts[open_at[of]], sizes[open_at[of]], entries)
        maps = [ChunkMap(self, raw, int(starts[i]), int(sizes[i])) for i in open_at.tolist()]
        for i, s, to, n in zip(of.tolist(), entries.tolist(), exits.tolist(), counts.tolist(), strict=True):
            maps[i].known[s] = (to, n)
        out, heads = np.empty(len(open_at), np.int64), np.append(np.flatnonzero(first), len(open_at)).tolist()
        for a, b in zip(heads[:-1], heads[1:], strict=True):
            entry = int(states[open_at[a] - 1])
            out[a:b] = np.diff([0, *(m(entry)[1] for m in (scan(maps[a:b]) if b - a > 1 else maps[a:b]))])
        return out


class ChunkMap:
    """Entry state -> (state at the end, tokens counted) of some bytes, for the entries known; others are added when asked for."""

    def __init__(self, machine: Transducer, raw: np.ndarray, start: int, size: int):
        self.machine, self.raw, self.start, self.size = machine, raw, start, size
        self.known: dict[int, tuple[int, int]] = {}

    def __call__(self, entry: int) -> tuple[int, int]:
        if entry not in self.known:
            n, to = self.machine.run(self.raw, np.array([self.start]), np.array([self.size]), np.array([entry]))
            self.known[entry] = (int(to[0]), int(n[0]))
        return self.known[entry]


class Composed:
    """A map and the one behind it, as one map."""

    def __init__(self, one, two):
        self.one, self.two, self.known = one, two, {}
        for entry, (to, n) in one.known.items():
            if to in two.known:
                end, more = two.known[to]
                self.known[entry] = (end, n + more)

    def __call__(self, entry: int) -> tuple[int, int]:
        if entry not in self.known:
            to, n = self.one(entry)
            end, more = self.two(to)
            self.known[entry] = (end, n + more)
        return self.known[entry]


def scan(maps: list) -> list:
    """The composition of all maps up to each, by rounds that double the reach; within a round all are independent."""
    reach = 1
    while reach < len(maps):
        maps = [Composed(maps[i - reach], m) if i >= reach else m for i, m in enumerate(maps)]
        reach *= 2
    return maps


def parts(text: str, most: int = MOST_TEXT) -> list[str]:
    """A text in parts of about `most` code points that can be counted apart; the whole if it has no such places."""
    out, begin, at = [], 0, most
    while at < len(text):
        kind = classes()[np.frombuffer(text[at - 1 : at - 1 + most].encode("utf-32-le"), np.uint32)] >= _BLANK
        found = np.flatnonzero(kind[1:] & ~kind[:-1])
        if len(found):
            out.append(text[begin : at + int(found[0])])
            begin = at + int(found[0])
            at = begin
        at += most
    return [*out, text[begin:]] if text else out


def count_tokens(machine: Transducer, texts: list[str | None], chunk: int = CHUNK, most: int = MOST_TEXT) -> np.ndarray:
    pieces, of, out = [], [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        segments = [text or ""]
        for s in machine.special:
            if s in (text or ""):
                segments = [y for x in segments for y in x.split(s)]
        out[i] = len(segments) - 1
        for x in segments:
            for y in parts(x, most):
                pieces.append(y)
                of.append(i)
    of, begin, held = np.array(of, np.int64), 0, 0
    for j, x in enumerate([*pieces, None]):
        if j > begin and (x is None or held + len(x) > 2 * most):
            np.add.at(out, of[begin:j], machine.counts(pieces[begin:j], chunk))
            begin, held = j, 0
        held += len(x or "")
    return out


_machines: dict[str, Transducer] = {}


def machine_of(path: str) -> Transducer:
    if path not in _machines:
        _machines[path] = Transducer(path)
    return _machines[path]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs (doc_id, text)."""

    packed = packed_classes()

    def step(rows: dict) -> dict:
        use_classes(packed)
        return {"doc_id": rows["doc_id"], "n_bytes": rows["n_bytes"], "n_tokens": count_tokens(machine_of(path or default_path()), rows["text"])}

    size = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return map_slices(size, step, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def default_path(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public tokenizer file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)
