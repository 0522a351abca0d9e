"""Secret scans: format rules for candidates, a random forest against false positives.

Rules find candidates in whole texts: key formats with a fixed prefix, private
key blocks, values assigned to names like password or token, credentials in
URLs, and long mixed strings. A random forest then judges each candidate by its
length, character transitions, dictionary coverage, signs of a path, and the
words before and behind it. Dictionary and transitions are those of the plain words
of a public tokenizer's vocabulary file, whose path is a parameter. The forest is
fitted on labelled findings: those given, or by default a fixed set made by rule
from the formats and from look-alikes that the rules pass (digests, identifiers,
placeholders, documentation examples, paths, plain words).

Defined results: null or empty text has no findings; findings of a row are
ordered and do not overlap; repeated rows repeat their findings; extra columns
are kept by redacted() and ignored by findings().
"""

from __future__ import annotations

import json
import math
import random
import re
import string
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, replace_slices
from .token_counts import default_path

_NAME = r"(?:[Pp]assw(?:or)?d|PASSW(?:OR)?D|[Pp]wd|PWD|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Aa]pi[_-]?[Kk]ey|API[_-]?KEY|[Aa]ccess[_-]?[Kk]ey|ACCESS[_-]?KEY)"
#: A character of a value without quotes: white space and the next assignment end it, and a separator that ends the text or stands before a name.
_BARE = r"(?:(?!" + _NAME + r"[=:])[^\s\"'<>,;&|]|[,;&|](?![\s\"'<>]|$|[A-Za-z_][\w.-]{0,40}[=:])|(?<=\w)[\"'](?=\w))"
#: Header and base64 lines of a private key without an END line; of the base64 at least one of 16 or more characters.
_KEY_LINES = r"(?>(?:\s|\\[rn])++[A-Z][A-Za-z-]{2,20}: (?:[^\s\\]++(?= +(?:[A-Z][A-Za-z-]{2,20}: |[A-Za-z0-9+/]{40}))|[^\n\\]*+))*+(?:(?:\s|\\[rn])++(?=[A-Za-z+/]*+\d)[A-Za-z0-9+/]{16,}+={0,2}(?![^\s\\\"'<,;.)]))++(?:(?:\s|\\[rn])++(?=[A-Za-z/]*+[0-9+=])[A-Za-z0-9+/]*+={0,2}(?![^\s\\\"'<,;.)]))?"
#: Rules in order of preference; the group `v` is the secret.
RULES = {
    "private_key": r"(?P<v0>-----BEGIN (?P<label>[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?)-----(?:[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END (?P=label)-----|" + _KEY_LINES + r"))",
    "aws_key": r"\b(?P<v1>A[KS]IA[0-9A-Z]{16})\b",
    "github_token": r"\b(?P<v2>gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,})",
    "slack_token": r"\b(?P<v3>xox[baprs]-[A-Za-z0-9-]{10,})",
    "google_key": r"\b(?P<v4>AIza[0-9A-Za-z_-]{35})",
    "stripe_key": r"\b(?P<v5>[sr]k_(?:live|test)_[0-9a-zA-Z]{16,})",
    "jwt": r"\b(?P<v6>eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+)",
    "assigned": _NAME + r"[\"']?\s{0,3}(?:=|:|=>)\s{0,3}[\"']?(?P<v7>(?<=\")(?:[^\"\\\n]|\\.){6,}+(?=\")|(?<=')(?:[^'\\\n]|\\.){6,}+(?=')|" + _BARE + r"{6,}+)",
    "url_password": r"://[^\s:/@\"'<>]*+:(?!\d{1,5}[/?#])(?P<v8>(?:[^\s/\"<>]|/(?!/)){3,})@",
    "mixed": r"(?<![A-Za-z0-9+/_.-])(?=[A-Za-z+/_-]*+\d)(?P<v9>[A-Za-z0-9+/_-]{24,}+={0,2})(?![A-Za-z0-9+/_=-]|\.[A-Za-z0-9])",
}
#: Words that the made findings take (fixed values).
WORDS = "the and for with this that from not you are have true false null none value example sample test your here change changeme password passwd secret token key user name admin login default required optional string enter placeholder dummy none undefined file path home usr local lib src main index html http https www com org net version build commit release config data table image static assets public private"
CONTEXT = 48
_ALL = re.compile("|".join(RULES.values()))
_NAMES = list(RULES)
_PLAIN = re.compile(r"(?<![^\s(])[A-Za-z]?[a-z'’]{1,14}(?=[.,;:!?)]{0,3}(?:\s|$))")
_SECRET_NEAR = re.compile(r"pass|pwd|secret|token|key|auth|cred|bearer|login")
_HARMLESS_NEAR = re.compile(r"commit|sha|md5|hash|checksum|digest|uuid|guid|rev|etag|version|build|file|path|image|id\b|http|href|src|example|placeholder")
FEATURES = ["length", "entropy", "transition", "changes", "digits", "upper", "lower", "hex", "distinct", "covered", "letters_run", "path", "path_words", "extension", "uuid", "masked", "ordered", "secret_before", "harmless_before", "secret_behind", "harmless_behind", "plain_near", "assigned", "rule", "sentence"]


@dataclass
class Finding:
    rule: str
    start: int
    end: int
    before: str
    value: str
    behind: str = ""


def candidates(text: str | None, begin: int = 0, end: int | None = None) -> list[Finding]:
    """The candidates of a whole text, or of a part of it, in order, in code points."""
    out = []
    for m in _ALL.finditer(text or "", begin, len(text or "") if end is None else end):
        n = int(m.lastgroup[1:])
        a, b = m.span(m.lastgroup)
        out.append(Finding(_NAMES[n], a, b, text[max(0, a - CONTEXT) : a], m.group(m.lastgroup), text[b : b + CONTEXT]))
    return out


class Language:
    """Plain words of a byte-level vocabulary file (of LEAST to MOST letters, with a blank before them), and their character transitions."""

    LEAST, MOST = 4, 14

    def __init__(self, path: str | None = None):
        with open(path or default_path(), encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        plain = {x[1:].lower() for x in vocabulary if x[:1] == "\u0120" and x[1:].isascii() and x[1:].isalpha()}
        self.words = frozenset(x for x in plain if self.LEAST <= len(x) <= self.MOST)
        pairs = Counter(x[i : i + 2] for x in self.words for i in range(len(x) - 1))
        total = sum(pairs.values())
        #: Log-ratio of each pair of letters to pairs drawn at random.
        self.pairs = {a + b: math.log((pairs[a + b] + 0.5) / total * 676) for a in string.ascii_lowercase for b in string.ascii_lowercase}

    def covered(self, low: str) -> int:
        """Letters of a lower-case string in dictionary words, the longest first from the left."""
        at = out = 0
        while at + self.LEAST <= len(low):
            n = next((n for n in range(min(self.MOST, len(low) - at), self.LEAST - 1, -1) if low[at : at + n] in self.words), 0)
            out, at = out + n, at + max(n, 1)
        return out


def measures(x: Finding, language: Language) -> list[float]:
    v, low, before, behind = x.value, x.value.lower(), x.before.lower(), x.behind.lower()
    n = max(1, len(v))
    counts = Counter(v)
    runs = [len(r) for r in re.findall(r"[a-z]+", low)]
    pairs = [language.pairs[p] for i in range(n - 1) if (p := low[i : i + 2]) in language.pairs]
    kinds = "".join("d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in v)
    parts = [p for p in re.split(r"[^a-z]+", low) if len(p) > 2]
    near = re.findall(r"[a-z]{3,}", before + " " + behind)
    return [
        min(n, 200),
        -sum(k / n * math.log2(k / n) for k in counts.values()),
        sum(pairs) / max(1, len(pairs)),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        kinds.count("d") / n,
        kinds.count("u") / n,
        kinds.count("l") / n,
        float(bool(re.fullmatch(r"[0-9a-fA-F]+", v))),
        len(counts) / n,
        language.covered(low) / n,
        max(runs, default=0) / n,
        v.count("/") + v.count("\\") + v.count("."),
        sum(p in language.words for p in parts) / max(1, len(parts)),
        float(bool(re.search(r"\.[a-z]{1,4}$", low))),
        float(bool(re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", low))),
        float(bool(re.search(r"(.)\1{5}|x{4}|\*{3}|\.{3}|[{}()<>\[\]$]", low))),
        sum(ord(b) - ord(a) in (0, 1) for a, b in zip(low, low[1:], strict=False)) / n,
        float(len(_SECRET_NEAR.findall(before))),
        float(len(_HARMLESS_NEAR.findall(before))),
        float(len(_SECRET_NEAR.findall(behind))),
        float(len(_HARMLESS_NEAR.findall(behind))),
        sum(w in language.words for w in near) / max(1, len(near)),
        float(bool(re.search(r"[=:]\s{0,3}[\"']?$", x.before))),
        float(_NAMES.index(x.rule)),
        sum(map(len, _PLAIN.findall(v))) / n if " " in v else 0.0,
    ]


def labelled_findings(n: int = 4000, seed: int = 5) -> list[tuple[Finding, int]]:
    """Labelled findings made by rule: secrets in their formats, and look-alikes."""
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choices(chars, k=k))
    hexa, alnum, words = "0123456789abcdef", string.ascii_letters + string.digits, WORDS.split()
    plain = lambda: " ".join(rng.choices(words[:12] + ["of", "to", "in", "is", "on"], k=4))
    name = lambda: rng.choice(["password", "passwd", "pwd", "secret", "token", "api_key", "access_key", "apikey"])
    sign = lambda: rng.choice(["=", " = ", ": ", "='", ' = "', '="', ': "'])
    syllables = lambda: "".join(rng.choice("b c d f g h l m n p r s t v w th st ch".split()) + rng.choice("aeiou") + rng.choice(["", "", "n", "r", "s", "t"]) for _ in range(rng.randrange(1, 4)))
    sentence = lambda: " ".join(syllables() + rng.choice(["", "", "", "", ","]) for _ in range(rng.randrange(3, 25))).capitalize() + rng.choice(["", ".", "!", "?"])
    out = []
    for _ in range(n // 2):
        kind = rng.randrange(12)
        # Words that speak against a secret stand near secrets too.
        lead = f"{plain()} " + rng.choice(["", "", "see https://www.example.com/path ", "mail1.example.org of ", "the build file version ", "an image id and http "])
        if kind == 11:
            out.append((Finding("assigned", 0, 0, lead + name() + sign(), pick(hexa, rng.choice([32, 40, 40, 64]))), 1))
        elif kind <= 2:
            value = rng.choice([lambda: pick(hexa, rng.choice([16, 18, 20, 32, 40, 64])), lambda: pick(alnum, rng.randrange(10, 44)), lambda: pick(alnum + "!@^-_+", rng.randrange(9, 24)), lambda: rng.choice(words).capitalize() + pick(string.digits, 3) + pick("!@^?", 1) + pick(alnum, 4)])()
            out.append((Finding("assigned", 0, 0, lead + name() + sign(), value), 1))
        elif kind == 3:
            out.append((Finding("aws_key", 0, 0, lead, rng.choice(["AKIA", "ASIA"]) + pick(string.ascii_uppercase + string.digits, 16)), 1))
        elif kind == 4:
            rule, value = rng.choice([("github_token", "ghp_" + pick(alnum, 36)), ("slack_token", "xoxb-" + pick(string.digits, 11) + "-" + pick(alnum, 24)), ("google_key", "AIza" + pick(alnum + "_-", 35)), ("stripe_key", "sk_live_" + pick(alnum, 24))])
            out.append((Finding(rule, 0, 0, lead, value), 1))
        elif kind == 5:
            out.append((Finding("jwt", 0, 0, lead, f"eyJ{pick(alnum, 20)}.eyJ{pick(alnum, 40)}.{pick(alnum, 43)}"), 1))
        elif kind == 6:
            label = rng.choice(["RSA PRIVATE KEY", "PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY", "ENCRYPTED PRIVATE KEY", "PGP PRIVATE KEY BLOCK"])
            head = rng.choice(["", "", f"Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,{pick(hexa, 32).upper()}\n\n", "Version: GnuPG v2\n\n"])
            body = "\n".join(pick(alnum + "+/", 64) for _ in range(rng.randrange(1, 40)))
            out.append((Finding("private_key", 0, 0, lead, f"-----BEGIN {label}-----\n{head}{body}" + rng.choice(["", f"\n-----END {label}-----", f"\n-----END {label}-----"])), 1))
        elif kind == 7:
            out.append((Finding("url_password", 0, 0, lead + "postgres://app:", pick(alnum, rng.randrange(8, 20))), 1))
        elif kind == 8:
            out.append((Finding("assigned", 0, 0, lead + name() + sign(), pick(alnum, rng.randrange(4, 10)) + pick(",;#$%&*|!@", rng.randrange(1, 4)) + pick(alnum + ",;#$%&*|", rng.randrange(3, 12)) + rng.choice(["", "", " " + pick(alnum + ",;", 8), pick(alnum + "+/", rng.randrange(150, 700))])), 1))
        elif kind == 9:
            before = rng.choice(["DB_PASS=", "AUTH=", "MY_AUTH=", "Authorization: Bearer ", "CREDENTIAL=", "secret key ", "cred: ", "login "])
            out.append((Finding("mixed", 0, 0, lead + before, pick(alnum + rng.choice(["", "+/"]), rng.choice([rng.randrange(28, 90), rng.randrange(200, 800)]))), 1))
        else:
            out.append((Finding("mixed", 0, 0, lead + rng.choice(["bearer ", "auth ", "secret key ", "api key is ", "credential "]), pick(alnum, rng.randrange(28, 60))), 1))
    for _ in range(n - len(out)):
        kind = rng.randrange(18)
        lead = f"{plain()} "
        if kind == 0:
            value = rng.choice(["changeme", "your_password_here", "xxxxxxxx", "********", "placeholder", "<password>", "example", "required", "undefined", "${TOKEN}", "os.environ['TOKEN']", "getenv(TOKEN)", "{{secret}}", "none", "string"])
            out.append((Finding("assigned", 0, 0, lead + name() + sign(), value), 0))
        elif kind == 1:
            out.append((Finding("assigned", 0, 0, lead + name() + sign(), "".join(rng.choices(words, k=rng.randrange(1, 4)))), 0))
        elif kind == 2:
            out.append((Finding("mixed", 0, 0, lead + rng.choice(["commit ", "sha256 ", "md5 ", "checksum ", "digest ", "etag ", "hash "]), pick(hexa, rng.choice([32, 40, 64]))), 0))
        elif kind == 3:
            out.append((Finding("mixed", 0, 0, lead + rng.choice(["id ", "uuid ", "guid ", "", "session "]), "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12))), 0))
        elif kind == 4:
            out.append((Finding("mixed", 0, 0, lead + rng.choice(["file ", "path ", "src ", "", "image "]), "/" + "/".join(rng.choices(words, k=5)) + f"{rng.randrange(99)}" + rng.choice(["", "_v2", "-3"])), 0))
        elif kind == 5:
            out.append((Finding("mixed", 0, 0, lead, "".join(rng.choices(words, k=6)) + f"{rng.randrange(999)}"), 0))
        elif kind == 6:
            out.append((Finding("mixed", 0, 0, lead + rng.choice(["", "number ", "order "]), pick(string.digits, rng.randrange(24, 40))), 0))
        elif kind == 7:
            out.append((Finding("url_password", 0, 0, lead + "http://user:", rng.choice(["password", "pass", "secret", "xxx", "example", "8080"])), 0))
        elif kind == 8:
            value = rng.choice([" ".join(rng.choices(words, k=rng.randrange(3, 12))), sentence(), sentence() + f" {rng.randrange(99)} " + sentence(), f"{sentence()} AKIA{pick(string.ascii_uppercase + string.digits, 16)} {sentence()}", ",".join(rng.choices(words, k=3)), "********", "$" + rng.choice(words).upper(), "%" + rng.choice(words) + "%", "${" + rng.choice(words).upper() + "}"])
            out.append((Finding("assigned", 0, 0, lead + name() + sign(), value), 0))
        elif kind in (13, 15, 16, 17):
            word = lambda chars: rng.choice(["EXAMPLE", "SAMPLE"]) if chars.isupper() else rng.choice(["example", "EXAMPLE", "sample", "Example"])
            dull = lambda k, chars=alnum: rng.choice([lambda: pick(chars, k - 7) + word(chars)[:7], lambda: pick(chars, max(k - 9, 3)) + word(chars)[:6] + "KEY", lambda: "x" * k, lambda: "0" * k, lambda: (chars * 9)[rng.randrange(9) :][:k], lambda: ("EXAMPLE" if chars.isupper() else rng.choice(["example", "yourtokenhere", "placeholder", "changeme", "Example"])).join([pick(chars, 3)] * k)[:k], lambda: "".join(rng.choices([w for w in words if w.isalpha()], k=k))[:k].upper() if chars.isupper() else "".join(rng.choices(words, k=k))[:k]])()
            rule, value = rng.choice([("aws_key", "AKIA" + dull(16, string.ascii_uppercase + string.digits)), ("github_token", "ghp_" + dull(36)), ("slack_token", "xoxb-" + dull(12) + "-" + dull(24)), ("google_key", "AIza" + dull(35)), ("stripe_key", rng.choice(["sk_test_", "sk_live_"]) + dull(24)), ("jwt", f"eyJ{dull(12)}.eyJ{dull(20)}.{dull(20)}")])
            out.append((Finding(rule, 0, 0, lead + rng.choice(["", "for example ", "key = ", "such as ", "format: "]), value), 0))
        elif kind == 14:
            out.append((Finding("mixed", 0, 0, lead + rng.choice(["", "the ", "see "]), pick(hexa, rng.choice([32, 40, 64])), rng.choice([" is the md5 of it", " (sha256)", " checksum", "  release.tar.gz", " is the commit", " file version 2"])), 0))
        elif kind == 11:
            label = rng.choice(["RSA PRIVATE KEY", "PRIVATE KEY", "PGP PRIVATE KEY BLOCK"])
            out.append((Finding("private_key", 0, 0, lead, f"-----BEGIN {label}-----{rng.choice([' ', chr(10), ' ... '])}{' '.join(sentence() for _ in range(rng.randrange(1, 5)))} -----END {label}-----"), 0))
        elif kind == 9:
            out.append((Finding("mixed", 0, 0, lead + rng.choice(["id=", "uuid=", "commit=", "sha256=", "etag=", "rev="]), rng.choice([pick(hexa, 32), pick(hexa, 40), pick(hexa, 64), "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12))])), 0))
        elif kind == 10:
            out.append((Finding("mixed", 0, 0, lead + rng.choice(["src=data:image/png;base64,", "data:image/jpeg;base64,", "href=/image/", "file=/path/"]), rng.choice([pick(alnum + "+/", rng.randrange(60, 900)), "/".join(rng.choices(words, k=40)) + f"/{rng.randrange(99)}"])), 0))
        else:
            out.append((Finding("mixed", 0, 0, lead, "_".join(rng.choices(words, k=5)) + f"_{rng.randrange(99)}"), 0))
    for x, label in out:
        x.behind = x.behind or rng.choice(["", "", " " + plain(), f" {sentence()}", f", {plain()}", "\n" + (plain() if label else rng.choice([plain(), "file size 12 kB"]))])
    return out


class Forest:
    """Bagged Gini trees on a random subset of measures at each split."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 10, least: int = 3, seed: int = 3):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.trees = []
        for _ in range(trees):
            rows = rng.integers(0, len(y), len(y))
            nodes: list[tuple[int, float, int, int, float]] = []
            self._grow(x[rows], y[rows], depth, least, rng, nodes)
            self.trees.append(tuple(np.array(c) for c in zip(*nodes, strict=True)))

    def _grow(self, x, y, depth, least, rng, nodes) -> int:
        at, share = len(nodes), float(y.mean())
        nodes.append((-1, 0.0, at, at, share))
        if depth == 0 or len(y) < 2 * least or share in (0.0, 1.0):
            return at
        best = (len(y) * share * (1 - share) - 1e-9, -1, 0.0)
        for f in rng.choice(x.shape[1], max(2, x.shape[1] // 3), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(y) + 1)
            left, right = ones / n, (ones[-1] - ones) / np.maximum(len(y) - n, 1)
            loss = n * left * (1 - left) + (len(y) - n) * right * (1 - right)
            loss[(n < least) | (len(y) - n < least) | np.append(v[1:] == v[:-1], True)] = np.inf
            i = int(np.argmin(loss))
            if loss[i] < best[0]:
                best = (float(loss[i]), int(f), float((v[i] + v[i + 1]) / 2))
        if best[1] >= 0:
            go = x[:, best[1]] <= best[2]
            a = self._grow(x[go], y[go], depth - 1, least, rng, nodes)
            b = self._grow(x[~go], y[~go], depth - 1, least, rng, nodes)
            nodes[at] = (best[1], best[2], a, b, share)
        return at

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for feature, cut, low, high, share in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                f = np.maximum(feature[at], 0)
                at = np.where(inner, np.where(x[np.arange(len(x)), f] <= cut[at], low[at], high[at]), at)
            out += share[at]
        return out / len(self.trees)


class Judge:
    """A forest and the language that its measures ask."""

    def __init__(self, labelled: list[tuple[Finding, int]], language: Language):
        self.language = language
        self.forest = Forest(np.array([measures(x, language) for x, _ in labelled]), np.array([y for _, y in labelled], float))

    def scores(self, found: list[Finding]) -> np.ndarray:
        return self.forest.scores(np.array([measures(x, self.language) for x in found])) if found else np.empty(0)


def train(labelled: list[tuple[Finding, int]] | None = None, path: str | None = None) -> Judge:
    """A judge fitted on labelled findings; path is the vocabulary file."""
    return Judge(labelled_findings() if labelled is None else labelled, Language(path))


def _judged(texts: list, judge: Judge, least: float) -> tuple[list[int], list[Finding], list[float]]:
    """Candidates with their scores; one that is rejected gives way to the candidates inside it."""
    new, done = [(i, x) for i, text in enumerate(texts) for x in candidates(text)], []
    while new:
        score = judge.scores([x for _, x in new]).tolist()
        inner = []
        for (i, x), p in zip(new, score, strict=True):
            parts = [] if p >= least else [(i, y) for y in candidates(texts[i], x.start, x.end) if y.end - y.start < x.end - x.start]
            inner += parts
            if not parts:
                done.append((i, x.start, x, p))
        new = inner
    done.sort(key=lambda d: d[:2])
    return [d[0] for d in done], [d[2] for d in done], [d[3] for d in done]


def findings(docs: DataFrame, judge: Judge | None = None, least: float = 0.5) -> DataFrame:
    """doc_id, rule, start, end (code points), score, secret: a row for each candidate in docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(judge or train())

    def step(rows: dict) -> dict:
        of, found, score = _judged(rows["text"], shared.value, least)
        return {"doc_id": [rows["doc_id"][i] for i in of], "rule": [x.rule for x in found], "start": [x.start for x in found], "end": [x.end for x in found], "score": score, "secret": [p >= least for p in score]}

    return map_slices(docs.select("doc_id", "text"), step, "doc_id long, rule string, start long, end long, score double, secret boolean")


def redacted(docs: DataFrame, judge: Judge | None = None, least: float = 0.5) -> DataFrame:
    """docs with each secret in text replaced by its rule's name in brackets; n_chars, if there, follows the text."""
    shared = docs.sparkSession.sparkContext.broadcast(judge or train())

    def change(texts: list) -> list:
        of, found, score = _judged(texts, shared.value, least)
        for i, x, p in reversed(list(zip(of, found, score, strict=True))):
            if p >= least:
                texts[i] = f"{texts[i][: x.start]}[{x.rule.upper()}]{texts[i][x.end :]}"
        return texts

    out = replace_slices(docs, change)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
