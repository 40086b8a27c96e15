"""Personal data: base patterns, and a linear-chain conditional random field over word shapes that adds what they miss.

The field is trained from a small labelled table (``labelled_table``). Whatever
it says, a span is reported only if it has the digits of an address, card or
phone number, or an @ or bracketed "at" (``_valid``). Lines without any of these
can't yield one, so only the others are decoded, in padded numpy batches of a
bounded number of words, or one line alone if it is longer.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import cache
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rewrite_texts, text_map

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. An address is found from its @, which is the same as leftmost search and linear.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
ODD = re.compile(r"[0-9@+]|[\[({](?:at|dot)[\])}]", re.I)
WORD = re.compile(r"\S+")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(DIGIT.findall(s))


def _byte(part: str) -> bool:
    """Whether a run of digits, of any length, is at most 255."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _ips(text: str):
    """(start, end) of leftmost matches of four dotted numbers: by fours along each maximal dotted chain, so that a digit is read once."""
    for m in DOTTED.finditer(text):
        if m[0].count(".") >= 3:
            at, parts = m.start(), m[0].split(".")
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                size = sum(map(len, four)) + 3
                if all(map(_byte, four)):
                    yield at, at + size
                at += size + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((0, start, m.end()))
            last = m.end()
        at = text.find("@", m.end() if m else at + 1)
    if DIGIT.search(text):
        out += [(1, start, end) for start, end in _ips(text)]
        out += [(2, m.start(), m.end()) for m in CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


# --- features -------------------------------------------------------------

#: Beyond so many digits a run of them has one shape.
LONG_RUN = 20


def shape(word: str) -> str:
    """Letters as a run "a", digits as 9 each, a bracketed at/dot as itself; of the rest only what phones, cards and addresses use."""
    w = word.lower()
    if re.fullmatch(r"[\[({](at|dot)[\])}][.,;:]?", w):
        return "<" + re.sub(r"[^a-z]", "", w) + ">"
    s = re.sub(r"[^\W\d_]+", "a", w)
    s = re.sub(r"[0-9]", "9", s)
    s = re.sub(r"[^a9@+().-]", "", s).strip(".")
    return re.sub("9{%d,}" % LONG_RUN, "9" * LONG_RUN, re.sub(r"(.)\1{30,}", lambda m: m[1] * 30, s))


def features(sh: str) -> list[str]:
    n = sh.count("9")
    return [f"s={sh}", f"c={re.sub('9+', '9', sh)}", f"n={min(n, 20)}"] + [f"h={c}" for c in "@+(.-" if c in sh] + (["plain"] if sh in ("", "a") else [])


PLAIN = shape("word")


def labelled_table(rows: int = 360, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """The labelled table: (words, labels), made by rule from the ways that people write such data, among plain words and harmless numbers."""
    r = np.random.default_rng(seed)
    some = lambda n: "".join(str(x) for x in r.integers(0, 10, n))
    word = lambda: "".join(r.choice(list("abcdefghilmnoprstuw"), r.integers(2, 9)))

    def card() -> str:
        d = "4" + some(14)
        return next(d + str(k) for k in range(10) if luhn(d + str(k)))

    def entity(kind: str) -> list[str]:
        pick = int(r.integers(0, 4))
        if kind == "email":
            dot, at = (("(dot)", "(at)"), ("[dot]", "[at]"))[pick % 2]
            return [f"{word()}@{word()}.com"] if pick == 0 else [word(), at, word(), dot, "com"] if pick < 3 else [f"{word()}.{some(2)}", at, f"{word()}.{word()}.org"]
        if kind == "ip":
            p = [str(x) for x in r.integers(0, 256, 4)]
            return [".".join(p)] if pick < 3 else [".".join(p) + ","]
        if kind == "card":
            c = card()
            return [c] if pick == 0 else [c[i : i + 4] for i in range(0, 16, 4)] if pick == 1 else ["-".join(c[i : i + 4] for i in range(0, 16, 4))] if pick == 2 else [".".join(c[i : i + 4] for i in range(0, 16, 4))]
        return [["+" + some(1), f"({some(3)})", f"{some(3)}-{some(4)}"], [f"({some(3)})", f"{some(3)}-{some(4)}"], [f"{some(3)}-{some(3)}-{some(4)}"], ["+" + some(11)]][pick]

    def harmless() -> list[str]:
        n = lambda k: some(k)
        return [[[n(4)], [f"{n(1)}.{n(2)}"], [f"{n(2)}:{n(2)}"], [f"{n(1)}.{n(1)}.{n(1)}"], [f"{n(4)}-{n(2)}-{n(2)}"], [n(3) + "%"], [f"({n(1)})"], [n(6)], ["a" + n(3)], [n(16)[:15]], ["@" + word()], [n(2), n(3)], ["c++"], [f"{word()}{n(2)}{word()}{n(3)}{word()}"], [f"{n(3)}-{n(2)}"]][int(r.integers(0, 15))]][0]

    table = []
    for k in range(rows):
        words, labels = [], []
        for _ in range(int(r.integers(1, 4))):
            for _ in range(int(r.integers(0, 5))):
                words.append(word() + str(r.choice(["", "", "", ".", ","])))
                labels.append("O")
            if k % 3 == 0:
                got = harmless()
                labels += ["O"] * len(got)
            else:
                kind = KINDS[int(r.integers(0, 4))]
                got = entity(kind)
                labels += [f"B-{kind}"] + [f"I-{kind}"] * (len(got) - 1)
            words += got
        words += [word() for _ in range(int(r.integers(0, 4)))]
        labels += ["O"] * (len(words) - len(labels))
        table.append((words, labels))
    return table


# --- the field --------------------------------------------------------------


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


#: Words of a batch of lines that are decoded together, and shapes that a field remembers.
BATCH_WORDS, SHAPES = 65_536, 50_000


class Field:
    """Weights: ``emit`` {feature: (3, L)} for the word before, itself and the word after; ``trans`` (L, L); ``first`` (L)."""

    def __init__(self, emit: dict[str, np.ndarray], trans: np.ndarray, first: np.ndarray):
        self.emit, self.trans, self.first = emit, trans, first
        self.number: dict[str, int] = {}
        self.rows = np.zeros((64, 3, len(LABELS)))  # row 0 stands for no word

    def vector(self, sh: str) -> np.ndarray:
        return sum((self.emit[f] for f in features(sh) if f in self.emit), np.zeros((3, len(LABELS))))

    def numbers(self, shapes) -> np.ndarray:
        """A number for each shape, by which ``rows`` holds its weights."""
        out = np.empty(len(shapes), np.int32)
        for t, sh in enumerate(shapes):
            k = self.number.get(sh)
            if k is None:
                k = self.number[sh] = len(self.number) + 1
                if k == len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                self.rows[k] = self.vector(sh)
            out[t] = k
        return out

    def forget(self) -> None:
        """Between texts: no more shapes than the bound are kept."""
        if len(self.number) > SHAPES:
            self.number, self.rows = {}, np.zeros((64, 3, len(LABELS)))

    def emissions(self, shapes: list[str]) -> np.ndarray:
        at = self.numbers(shapes)
        v = np.concatenate([self.rows[:1], self.rows[at], self.rows[:1]])
        return v[1:-1, 1] + v[:-2, 0] + v[2:, 2]

    def plain_is_outside(self) -> bool:
        """Whether lines of plain words, of any length, decode to O alone: what a label loses on each such word is more than a return to O can win."""
        v = self.vector(PLAIN)
        for left in (0, 1):
            for right in (0, 1):
                e = v[1] + left * v[0] + right * v[2]
                worst = max(float(e[y] + max(self.trans[:, y].max(), self.first[y])) for y in range(1, len(LABELS)))
                back = float((self.trans[1:, 0] - self.trans[0, 0]).max())
                if e[0] + min(self.trans[0, 0], self.first[0]) - worst <= max(0.0, back):
                    return False
        return True

    def viterbi(self, lines: list) -> list[np.ndarray]:
        """Label numbers of each line of shapes, or of their numbers; lines of like lengths are decoded together."""
        lines = [x if isinstance(x, np.ndarray) else self.numbers(x) for x in lines]
        out: list = [None] * len(lines)
        order = sorted(range(len(lines)), key=lambda k: len(lines[k]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end + 1 - at) * len(lines[order[end]]) <= BATCH_WORDS:
                end += 1
            part, at = order[at:end], end
            for k, path in zip(part, self._decode([lines[k] for k in part])):
                out[k] = path
        return out

    def _decode(self, lines: list[np.ndarray]) -> list[np.ndarray]:
        """Best paths of lines in ascending length; what is held for a word is its number and a byte for each label."""
        n = np.array([len(x) for x in lines])
        longest, some = int(n[-1]), np.arange(len(lines))
        if not longest:
            return [np.zeros(0, np.int8) for _ in lines]
        word = np.zeros((len(lines), longest + 2), np.int32)
        for row, x in zip(word, lines):
            row[1 : len(x) + 1] = x
        back = np.zeros((longest, len(lines), len(LABELS)), np.int8)
        emit = lambda t, rows: self.rows[word[rows, t + 1], 1] + self.rows[word[rows, t], 0] + self.rows[word[rows, t + 2], 2]
        score = self.first + emit(0, some)
        for t in range(1, longest):
            live = some[np.searchsorted(n, t, side="right") :]
            move = score[live, :, None] + self.trans[None]
            best = move.argmax(1)
            back[t, live] = best
            score[live] = np.take_along_axis(move, best[:, None], 1)[:, 0] + emit(t, live)
        y = score.argmax(1)
        path = np.zeros((longest, len(lines)), np.int8)
        for t in range(longest - 1, -1, -1):
            live = some[np.searchsorted(n, t, side="right") :]
            path[t, live] = y[live]
            if t:
                y[live] = back[t, live, y[live]]
        return [path[: len(x), k] for k, x in enumerate(lines)]


def train(table: list[tuple[list[str], list[str]]], steps: int = 200, rate: float = 0.1, l2: float = 1e-3) -> Field:
    """Maximum likelihood by forward-backward and Adam over the padded table; words of one shape share their features."""
    L, S = len(LABELS), len(table)
    shapes = [[shape(w) for w in words] for words, _ in table]
    kinds = {s: k for k, s in enumerate(sorted({s for line in shapes for s in line}))}
    feats = {f: k for k, f in enumerate(sorted({f for s in kinds for f in features(s)}))}
    n = np.array([len(x) for x in shapes])
    T = int(n.max())
    hot = np.zeros((len(kinds) + 1, len(feats)))  # the last row stands for no word
    for s, k in kinds.items():
        hot[k, [feats[f] for f in features(s)]] = 1
    y, word = np.zeros((S, T), int), np.full((S, T + 2), len(kinds))
    for s, (line, (_, labels)) in enumerate(zip(shapes, table)):
        y[s, : n[s]] = [LABELS.index(x) for x in labels]
        word[s, 1 : n[s] + 1] = [kinds[x] for x in line]
    mask = np.arange(T)[None] < n[:, None]
    near = [word[:, k : k + T] for k in range(3)]  # the word before, itself, the word after
    gold = np.eye(L)[y] * mask[..., None]
    w = np.zeros(3 * len(feats) * L + L * L + L)
    m, v, cut = np.zeros_like(w), np.zeros_like(w), 3 * len(feats) * L
    pairs = np.einsum("sti,stj->ij", gold[:, :-1], gold[:, 1:])
    for step in range(1, steps + 1):
        W, trans, first = w[:cut].reshape(3, -1, L), w[cut : cut + L * L].reshape(L, L), w[cut + L * L :]
        e = sum((hot @ W[k])[near[k]] for k in range(3))
        a, b = np.zeros((S, T, L)), np.zeros((S, T, L))
        a[:, 0] = first + e[:, 0]
        for t in range(1, T):
            a[:, t] = np.where(mask[:, t, None], _lse(a[:, t - 1, :, None] + trans, 1) + e[:, t], a[:, t - 1])
        for t in range(T - 2, -1, -1):
            b[:, t] = np.where(mask[:, t + 1, None], _lse(trans[None] + (e[:, t + 1] + b[:, t + 1])[:, None], 2), 0)
        z = _lse(a[:, -1], 1)
        prob = np.exp(a + b - z[:, None, None]) * mask[..., None]
        two = np.zeros((L, L))
        for t in range(1, T):
            p = np.exp(a[:, t - 1, :, None] + trans[None] + (e[:, t] + b[:, t])[:, None] - z[:, None, None])
            two += (p * mask[:, t, None, None]).sum(0)
        off = (prob - gold).reshape(S * T, L)
        own = [hot.T @ np.stack([np.bincount(near[k].ravel(), off[:, x], len(hot)) for x in range(L)], 1) for k in range(3)]
        g = np.concatenate([np.ravel(own), (two - pairs).ravel(), (prob[:, 0] - gold[:, 0]).sum(0)]) / S + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    W = w[:cut].reshape(3, len(feats), L)
    return Field({f: W[:, k] for f, k in feats.items()}, w[cut : cut + L * L].reshape(L, L), w[cut + L * L :])


@cache
def default_field() -> Field:
    """The field of the module's own table, trained once in a process."""
    return train(labelled_table())


#: How an @ and a dot may be written.
AT, DOT = re.compile(r"@|[\[({]at[\])}]", re.I), re.compile(r"\.|[\[({]dot[\])}]", re.I)


def _valid(kind: str, s: str) -> bool:
    """What a label must look like to be reported; the field proposes, this drops what can't be such data."""
    d = _digits(s)
    if kind == "email":
        at = AT.search(s)
        return at is not None and DOT.search(s, at.end()) is not None
    if kind == "ip":
        return len(p := re.findall("[0-9]+", s)) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in p)
    if kind == "card":
        return 16 <= len(d) <= 19 and luhn(d)
    return 8 <= len(d) <= 15 and bool(re.fullmatch(r"[\s()+.0-9-]+", s))


def added_spans(texts: list[str], field: Field) -> list[list[tuple[int, int, int]]]:
    """What the field finds in each text, as (kind, start, end), in the order of the text."""
    field.forget()
    lines, where = [], []
    for k, t in enumerate(texts):
        if ODD.search(t):
            at = 0
            for line in t.split("\n"):
                if ODD.search(line):
                    ends = np.fromiter((x for m in WORD.finditer(line) for x in m.span()), np.int64).reshape(-1, 2) + at
                    lines.append(field.numbers([shape(t[x:y]) for x, y in ends.tolist()]))
                    where.append((k, ends))
                at += len(line) + 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (k, ends), path in zip(where, field.viterbi(lines)):
        begin, s = np.flatnonzero(path), texts[k]
        done = 0
        for i in begin.tolist():
            if i < done:
                continue
            kind, j = LABELS[path[i]][2:], i + 1
            while j < len(path) and LABELS[path[j]] == f"I-{kind}":
                j += 1
            start, end, done = int(ends[i, 0]), int(ends[j - 1, 1]), j
            while end > start and s[end - 1] in ".,;:!?|\"'*#%$&":
                end -= 1
            while start < end and s[start] in "\"'*#%$&|":
                start += 1
            if end > start and _valid(kind, s[start:end]):
                out[k].append((KINDS.index(kind), start, end))
    return out


def find_pii(texts: list[str], field: Field) -> list[tuple[list, list]]:
    """For each text (base spans, all spans), all by kind, then start; an added span overlaps no other."""
    out = []
    for t, more in zip(texts, added_spans(texts, field)):
        base = base_spans(t)
        taken = sorted((start, end) for _, start, end in base)
        starts, reach = [x for x, _ in taken], list(accumulate((end for _, end in taken), max))
        # The field's own spans lie apart; of those that start before its end, a base span may reach into it.
        free = [x for x in more if not (k := bisect_left(starts, x[2])) or reach[k - 1] <= x[1]]
        out.append((base, sorted(base + free)))
    return out


def scan_pii(docs: DataFrame, field: Field | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Row by row (doc_id, base, spans): arrays of (kind, start, end), ends exclusive, in code points.

    Null and empty texts have none. Repeated rows are answered alike, extra
    columns ignored; a text is worked on whole, whatever its length.
    """
    field = field or default_field()
    kind = "array<struct<kind:string,start:int,end:int>>"
    named = lambda a: [{"kind": KINDS[k], "start": s, "end": e} for k, s, e in a]

    def work(texts):
        found = find_pii(texts, field)
        return [named(x) for x, _ in found], [named(x) for _, x in found]

    return text_map(docs, {doc_id: doc_id}, text, f"base {kind}, spans {kind}", lambda: work)


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets, and ``n_chars``, if there, brought up to date.

    All rows and columns stay. A null or empty text stays as it is, repeated
    rows are answered alike, an empty table gives no rows.
    """
    field = field or default_field()

    def work(texts):
        out = []
        for t, (_, spans) in zip(texts, find_pii([t or "" for t in texts], field)):
            parts, at = [], 0
            for k, start, end in sorted(spans, key=lambda x: x[1:]):
                if start >= at:
                    parts += [t[at:start], f"[{KINDS[k].upper()}]"]
                at = max(at, end)
            out.append("".join([*parts, t[at:]]) if spans else t)
        return None, out

    out = rewrite_texts(docs, "text", lambda: work)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def op7_pii(spark, sf_dir):
    field = default_field()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    found = scan_pii(docs, field)
    say = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(say("base"), 256).alias("base_sha256"), say("spans").alias("spans"))
