"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

The model's file gives pieces and scores; merging is done here, for all distinct
words of a slice in parallel. A candidate merge is a pair of neighbouring symbols
whose joint text is a piece. The best candidate (highest score, then leftmost) is
taken first, but a candidate is passed over if a keyed hash of its word, document,
position and span falls under the dropout rate; a new neighbour makes a new
candidate. So each occurrence of a word has a draw of its own, and the same seed
gives the same ids on any machine. What a worker remembers is the segmentation of
a word for each set of spans that are passed over, which settles it.

Words of over BESIDE symbols are merged one by one by a heap of candidates, so that
their cost grows as n log n.

Characters without a piece, and the piece mark itself where a text contains it,
become byte pieces. Decoding gives every text back exactly; without dropout the
ids are those of the sentencepiece library (but for texts with the piece mark).

Defined results: null and empty text have no ids and decode to the empty text;
repeated rows (same doc_id and text) get the same ids; a null doc_id counts as 0;
extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from itertools import pairwise

import numpy as np
import sentencepiece
import xxhash
from pyspark.sql import DataFrame

from .common import M1, M2, M3, map_slices, mix64
from .token_counts import default_path
from .token_files import _ODD, _ODD_INVERSE, Pieces, _powers, _runs

#: Segmentations that a worker remembers, their symbols, the symbols of the longest word remembered, and of the longest merged beside others.
MEMO, MEMO_SYMBOLS, SHORT, BESIDE = 300_000, 8_000_000, 64, 256
#: Text of one step, in UTF-8 bytes.
STEP = 500_000
_U64 = (1 << 64) - 1
_MARK, _LITERAL = 0x2581, 0x110000
_NONE = np.int32(1 << 30)


class Segmenter:
    """Encodes and decodes with one model."""

    def __init__(self, path: str, rate: float = 0.1, seed: int = 1):
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = library.get_piece_size()
        self.rate, self.seed = np.uint64(min(int(rate * 2**64), 2**64 - 1)), np.uint64(seed)
        self.salt = np.uint64(seed * int(M2) & (2**64 - 1))
        plain, self.bytes_of = {}, [b""] * size
        self.byte_id = np.zeros(256, np.int32)
        for i in range(size):
            piece = library.id_to_piece(i)
            if library.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (library.is_control(i) or library.is_unknown(i) or library.is_unused(i)):
                plain[piece] = i
                self.bytes_of[i] = piece.replace("▁", " ").encode()
        if any("▁" in x.lstrip("▁") for x in plain):
            raise ValueError(f"{path} has pieces that go across words")
        order = sorted(plain.values(), key=lambda i: (-library.get_score(i), i))
        rank = {i: r for r, i in enumerate(order)}
        self.of_rank = np.array(order, np.int32)
        pairs = {(plain[x[:k]] << 16) | plain[x[k:]]: rank[i] for x, i in plain.items() for k in range(1, len(x)) if x[:k] in plain and x[k:] in plain}
        self.pair_bits = 19
        self.pair_key = np.full(1 << self.pair_bits, -1, np.int64)
        self.pair_rank = np.full(1 << self.pair_bits, _NONE, np.int32)
        for k, r in pairs.items():
            at = self._slot(np.array([k]))[0]
            while self.pair_key[at] >= 0:
                at = (at + 1) & (len(self.pair_key) - 1)
            self.pair_key[at], self.pair_rank[at] = k, r
        made = set(pairs.values())
        self.symbol = np.full(_LITERAL + 1, -1, np.int32)
        for x, i in plain.items():
            if len(x) == 1:
                self.symbol[ord(x)] = i
        flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.byte_n = np.array([len(x) for x in self.bytes_of], np.int64)
        self.byte_at, self.byte_flat = np.cumsum(self.byte_n) - self.byte_n, flat
        self.known, self.spans, self.powers, self.inverse = Pieces(), Pieces(), _powers(_ODD, 1), _powers(_ODD_INVERSE, 1)
        spelt = [self.symbol[[ord(c) for c in x]] for x, i in plain.items() if len(x) > 1 and rank[i] in made]
        self.longest = min(SHORT, max(map(len, spelt), default=0))
        power = _powers(_ODD, max(map(len, spelt), default=0) + 1)
        self.merged = np.unique(np.array([((x.astype(np.uint64) + M1) * power[: len(x)]).sum() for x in spelt if (x >= 0).all()], np.uint64))
        self.may = np.zeros(1 << 20, bool)
        self.may[self.merged >> np.uint64(44)] = True

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * M1) >> np.uint64(64 - self.pair_bits)).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each joint piece, or _NONE; symbols under 0 join nothing."""
        key = (left.astype(np.int64) << 16) | right
        out = np.full(len(key), _NONE, np.int32)
        live = np.flatnonzero((left >= 0) & (right >= 0))
        where = self._slot(key[live])
        while len(live):
            held = self.pair_key[where]
            same = held == key[live]
            out[live[same]] = self.pair_rank[where[same]]
            go = ~same & (held >= 0)
            live, where = live[go], (where[go] + 1) & (len(self.pair_key) - 1)
        return out

    def _candidates(self, word: np.ndarray, left: np.ndarray, right: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Ranks of candidates, without those that the keyed hash passes over."""
        rank = self._ranks(left, right)
        if self.rate:
            rank[self._passed(mix64(word ^ self.salt), start.astype(np.uint64), end.astype(np.uint64))] = _NONE
        return rank

    def _passed(self, salted: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether the keyed hash passes over each span."""
        return mix64(salted + ((start << np.uint64(32)) + end)) <= self.rate

    def _possible(self, flat: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every span of each word that spells a piece made by merging, as start * 256 + end, and how many each has."""
        flat, ends = flat[_runs(starts, size)], np.cumsum(size)
        of = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(flat)) - (ends - size)[of]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((flat.astype(np.uint64) + M1) * self.powers[place])])
        at, found, codes = np.arange(len(flat)), [], []
        for n in range(2, self.longest + 1):
            at = at[at + n <= ends[of[at]]]
            h = (sums[at + n] - sums[at]) * self.inverse[place[at]]
            maybe = np.flatnonzero(self.may[h >> np.uint64(44)])
            near = np.minimum(np.searchsorted(self.merged, h[maybe]), len(self.merged) - 1)
            hit = at[maybe[self.merged[near] == h[maybe]]]
            found.append(of[hit])
            codes.append(place[hit] * 256 + place[hit] + n)
        found, codes = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (found, codes))
        return codes[np.argsort(found, kind="stable")], np.bincount(found, minlength=len(size))

    def _outcomes(self, word: np.ndarray, own: np.ndarray, flat: np.ndarray, starts: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """A key of each word with the spans passed over in it; of a long word, its own key."""
        if not self.rate:
            return word
        key = own.copy()
        short = np.flatnonzero(chars <= SHORT)
        if self.spans.n > MEMO:
            self.spans = Pieces()
        entry = self.spans.find(word[short])
        if len(new := np.flatnonzero(entry < 0)):
            fresh, once = np.unique(word[short[new]], return_index=True)
            at = short[new[once]]
            codes, n = self._possible(flat, starts[at], chars[at])
            self.spans.add(fresh, np.empty(0, np.uint32), np.zeros(len(fresh), np.int64), codes.astype(np.uint32), n)
            entry[new] = self.spans.find(word[short[new]])
        n = self.spans.at["n_ids"][entry]
        ends = np.concatenate([[0], np.cumsum(n)])
        salted, first = mix64(own[short] ^ self.salt), self.spans.at["ids"][entry]
        # Parts of the occurrences, whose spans fit a processor's cache.
        for i in range(0, len(short), 8192):
            part = slice(i, i + 8192)
            code = self.spans.ids[_runs(first[part], n[part])].astype(np.uint64)
            out = self._passed(np.repeat(salted[part], n[part]), code >> np.uint64(8), code & np.uint64(255))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(code[out] ^ M2))])
            cuts = np.concatenate([[0], np.cumsum(out)])[ends[i : i + 8193] - ends[i]]
            key[short[part]] = mix64(word[short[part]] + (sums[cuts[1:]] - sums[cuts[:-1]]))
        return key

    def merge(self, flat: np.ndarray, starts: np.ndarray, size: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words flat[start : start + size], given as symbols, and how many each has; keys name word and occurrence."""
        made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for low, high in pairwise([0, 4, 6, 8, 10, 12, *(1 << i for i in range(4, BESIDE.bit_length()))]):
            group = np.flatnonzero((size > low) & (size <= high))
            # A group's square holds at most some millions of symbols.
            step = max(1, 2_000_000 // high)
            for i in range(0, len(group), step):
                self._square(flat, starts, size, keys, group[i : i + step], made)
        for i in np.flatnonzero(size > BESIDE).tolist():
            ids = self._long(flat[starts[i] : starts[i] + size[i]], int(keys[i]))
            made.append((np.array([i]), ids, np.array([len(ids)])))
        owner, ids, n = (np.concatenate([x[k] for x in made]) for k in range(3))
        order, at = np.argsort(owner), np.cumsum(n) - n
        return ids[_runs(at[order], n[order])], n[order]

    def _square(self, flat: np.ndarray, starts: np.ndarray, size: np.ndarray, keys: np.ndarray, group: np.ndarray, made: list) -> None:
        """Merges words of like size, a step of each at once."""
        n, key = size[group], keys[group]
        wide = int(n.max(initial=0))
        sym = np.full((len(group), wide + 1), -1, np.int32)
        sym[:, :wide][np.arange(wide) < n[:, None]] = flat[_runs(starts[group], n)]
        start = np.minimum(np.arange(wide + 2), n[:, None]).astype(np.int32)
        rank = np.full((len(group), wide + 1), _NONE, np.int32)
        r, p = np.nonzero(sym[:, 1:] >= 0)
        rank[r, p] = self._candidates(key[r], sym[r, p], sym[r, p + 1], start[r, p], start[r, p + 2])
        while len(group):
            p = rank.argmin(axis=1)
            best = rank[np.arange(len(group)), p]
            done = best == _NONE
            if done.any():
                rest = sym[done]
                made.append((group[done], rest[np.arange(rest.shape[1]) < n[done][:, None]], n[done]))
                go = ~done
                if not go.any():
                    return
                group, sym, start, rank, key, n, p, best = (x[go] for x in (group, sym, start, rank, key, n, p, best))
            rows = np.arange(len(group))
            n = n - 1
            # The symbol behind p goes, and what stands behind it moves up.
            stay = np.arange(start.shape[1] - 1) <= p[:, None]
            sym, start, rank = (np.where(stay[:, : x.shape[1] - 1], x[:, :-1], x[:, 1:]) for x in (sym, start, rank))
            sym[rows, p] = self.of_rank[best]
            rank[rows, p] = self._candidates(key, sym[rows, p], sym[rows, p + 1], start[rows, p], start[rows, p + 2])
            b = np.flatnonzero(p > 0)
            q = p[b] - 1
            rank[b, q] = self._candidates(key[b], sym[b, q], sym[b, q + 1], start[b, q], start[b, q + 2])

    def _long(self, word: np.ndarray, key: int) -> np.ndarray:
        """Merges one long word by an agenda: a heap of candidates, of which those that a merge has overtaken are passed by."""
        n, sym = len(word), word.tolist()
        after, before, ends = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        places = np.arange(n - 1)
        first = self._candidates(np.full(n - 1, key, np.uint64), word[:-1], word[1:], places, places + 2)
        agenda = [(r, i, i + 1, i + 2) for i, r in enumerate(first.tolist()) if r < _NONE]
        heapq.heapify(agenda)
        salted = _mixed(key ^ int(self.salt))

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (r := self._rank(sym[i], sym[j])) < _NONE and not (self.rate and _mixed(salted + (i << 32) + ends[j]) <= int(self.rate)):
                heapq.heappush(agenda, (r, i, ends[i], ends[j]))

        while agenda:
            r, i, middle, end = heapq.heappop(agenda)
            j = after[i]
            if sym[i] == -2 or ends[i] != middle or j >= n or ends[j] != end:
                continue
            sym[i], sym[j], ends[i], after[i] = int(self.of_rank[r]), -2, end, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([x for x in sym if x != -2], np.int32)

    def _rank(self, left: int, right: int) -> int:
        """_ranks() of one pair."""
        if left < 0 or right < 0:
            return int(_NONE)
        key = left << 16 | right
        at = (key * int(M1) & _U64) >> (64 - self.pair_bits)
        while (held := int(self.pair_key[at])) >= 0:
            if held == key:
                return int(self.pair_rank[at])
            at = (at + 1) & (len(self.pair_key) - 1)
        return int(_NONE)

    def encode(self, texts: list[str | None], names: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has; names vary the draws."""
        some = [i for i, x in enumerate(texts) if x]
        n = np.zeros(len(texts), np.int64)
        if not some:
            return np.empty(0, np.uint32), n
        whole = "▁".join(["", *(texts[i] for i in some)])
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32).copy()
        doc_at = np.cumsum([0, *(len(texts[i]) + 1 for i in some)])
        mark = points == _MARK
        mark[doc_at[:-1]] = False
        points[mark] = _LITERAL
        points[points == 32] = _MARK
        sym = self.symbol[points]
        known = sym >= 0
        width = np.where(known, 1, 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + ((points >= 0x10000) & (points != _LITERAL)))
        place = np.concatenate([[0], np.cumsum(width)])
        flat = np.empty(int(place[-1]), np.int32)
        flat[place[:-1][known]] = sym[known]
        odd = np.flatnonzero(~known)
        for c in np.unique(points[odd]).tolist():
            here = place[odd[points[odd] == c]]
            for j, b in enumerate(("▁" if c == _LITERAL else chr(c)).encode()):
                flat[here + j] = self.byte_id[b]
        begins = points == _MARK
        begins[1:] &= points[:-1] != _MARK
        begins[doc_at[:-1]] = True
        word_at = np.flatnonzero(begins)
        starts = place[word_at]
        chars = np.diff(starts, append=len(flat))
        first = np.searchsorted(word_at, doc_at)
        doc = np.repeat(np.arange(len(some)), np.diff(first))
        number = np.arange(len(doc)) - first[doc]
        own = np.array([(names[i] or 0) & (2**64 - 1) for i in some], np.uint64)
        draw = mix64(mix64(own ^ self.seed)[doc] + number.astype(np.uint64))
        if len(self.powers) <= len(flat) + SHORT:
            self.powers, self.inverse = _powers(_ODD, len(flat) + SHORT + 1), _powers(_ODD_INVERSE, len(flat) + SHORT + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((flat.astype(np.uint64) + M1) * self.powers[: len(flat)])])
        word = mix64((sums[starts + chars] - sums[starts]) * self.inverse[starts] ^ chars.astype(np.uint64))
        for i in np.flatnonzero(chars > BESIDE).tolist():
            # Long words can be made so that their polynomials agree.
            word[i] = xxhash.xxh3_64_intdigest(flat[starts[i] : starts[i] + chars[i]].tobytes())
        each = mix64(word + draw)
        key = self._outcomes(word, each, flat, starts, chars)
        if self.known.n > MEMO or self.known.used[0] > MEMO_SYMBOLS:
            self.known = Pieces()
        entry, check = self.known.find(key), np.arange(len(key))
        while len(check):
            if len(new := np.flatnonzero(entry < 0)):
                fresh, once = np.unique(key[new], return_index=True)
                pick = new[once]
                ids, n_ids = self.merge(flat, starts[pick], chars[pick], each[pick])
                self.known.add(fresh, flat[_runs(starts[pick], chars[pick])].astype(np.uint32), chars[pick], ids.astype(np.uint32), n_ids)
                entry[new] = self.known.find(key[new])
            # What met another word's key gets another key.
            check = check[self._differs(entry[check], flat if len(check) == len(key) else flat[_runs(starts[check], chars[check])], chars[check])]
            key[check] = mix64(key[check] ^ M2)
            entry[check] = self.known.find(key[check])
        held = self.known.at
        n_ids = held["n_ids"][entry]
        total = np.concatenate([[0], np.cumsum(n_ids)])
        n[some] = total[first[1:]] - total[first[:-1]]
        return self.known.ids[_runs(held["ids"][entry], n_ids)], n

    def _differs(self, entry: np.ndarray, flat: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Whether the words that flat holds one after another are others than those of the entries."""
        held, out = self.known.at, self.known.at["chars"][entry] != chars
        if out.any():
            same, of = ~out, np.repeat(np.arange(len(chars)), chars)
            inside = same[of]
            differs = self.known.points[_runs(held["text"][entry[same]], chars[same])] != flat[inside]
            out[of[inside][differs]] = True
        elif (differs := self.known.points[_runs(held["text"][entry], chars)] != flat).any():
            out[np.repeat(np.arange(len(chars)), chars)[differs]] = True
        return out

    def decode(self, ids: np.ndarray, n: np.ndarray) -> list[bytes]:
        """The text of each document, as UTF-8."""
        size = self.byte_n[ids]
        raw = self.byte_flat[_runs(self.byte_at[ids], size)].tobytes()
        total = np.concatenate([[0], np.cumsum(size)])
        ends = np.cumsum(n)
        # The first byte of a text that is not empty is the mark put before it.
        return [raw[a + 1 : b] if b > a else b"" for a, b in zip(total[ends - n].tolist(), total[ends].tolist(), strict=True)]


def _mixed(x: int) -> int:
    """mix64() of one value."""
    x = (x + int(M1)) & _U64
    x = ((x ^ (x >> 30)) * int(M2)) & _U64
    x = ((x ^ (x >> 27)) * int(M3)) & _U64
    return x ^ (x >> 31)


_segmenters: dict[tuple, Segmenter] = {}


def segmenter(path: str | None, rate: float, seed: int) -> Segmenter:
    key = (path or default_path("piece_bpe_32k.model"), rate, seed)
    if key not in _segmenters:
        _segmenters[key] = Segmenter(*key)
    return _segmenters[key]


def segmented(docs: DataFrame, path: str | None = None, rate: float = 0.1, seed: int = 1) -> DataFrame:
    """doc_id, n_pieces, ids (array of int) for every row of docs (doc_id, text)."""

    def step(rows: dict) -> dict:
        ids, n = segmenter(path, rate, seed).encode(rows["text"], rows["doc_id"])
        return {"doc_id": rows["doc_id"], "n_pieces": n, "ids": np.split(ids.astype(np.int32), np.cumsum(n)[:-1])}

    return map_slices(docs.select("doc_id", "text"), step, "doc_id long, n_pieces long, ids array<int>", most=STEP)


def digests(docs: DataFrame, path: str | None = None, rate: float = 0.1, seed: int = 1) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as little-endian 32-bit integers), lossless: whether decoding gave the text back."""

    def step(rows: dict) -> dict:
        own = segmenter(path, rate, seed)
        ids, n = own.encode(rows["text"], rows["doc_id"])
        same = [x == (t or "").encode() for x, t in zip(own.decode(ids, n), rows["text"], strict=True)]
        crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in np.split(ids, np.cumsum(n)[:-1])]
        return {"doc_id": rows["doc_id"], "n_pieces": n, "ids_crc32": crc, "lossless": same}

    return map_slices(docs.select("doc_id", "text"), step, "doc_id long, n_pieces long, ids_crc32 long, lossless boolean", most=STEP)
