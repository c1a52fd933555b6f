"""Personal data by patterns and a semi-Markov conditional random field.

The base patterns find e-mail addresses, IP addresses, card numbers and phone numbers; their spans always stay. Between
them, stretches of text around digits, at-signs and spelt-out separators are segmented by the field: features look at a
whole candidate span (digits, groups, separators, checks, neighbours), and a dynamic programme over entities of bounded length
picks boundaries and types together. A stretch reaches as far from its cues as an entity can, and is decoded whole, however
many entities it has. The field learns by maximum likelihood on segmented
stretches generated from a seed, with numpy.

Null and empty texts have no spans; whole texts are scanned, whatever their length. Repeated rows repeat their spans; tables may
be empty; other columns are ignored.
"""

from __future__ import annotations

import bisect
import random
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hourloom.llm import store

#: Fixed values of the base patterns. Possessive forms keep long runs linear; a match that starts inside a run of digits
#: would end where the run's own match ends, so starts are looked for at the run's first digit.
KINDS = ["email", "ip", "card", "phone"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CUE = re.compile(r"[0-9]+|@|[\[(]at[\])]|\bat\b", re.IGNORECASE)

#: Longest entity in tokens, tokens of context before one, tokens whose candidates are scored at a time.
LONGEST, CONTEXT, BLOCK = 24, 3, 96
FEATURES = 1 << 12
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s|.", re.DOTALL)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their at-signs: what may stand before one has none itself."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            # Without a match, a later at-sign may take what stands after this one.
            done = max(done, at + 1) if start == at else done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not re.search(r"[0-9]{2}|[0-9][.\x20-][0-9]|\+[0-9]", text):
        return out
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = re.sub("[^0-9]", "", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() and c.isascii() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


Token = tuple[str, int, int]


def tokens_of(text: str, start: int, stop: int) -> list[Token]:
    return [(m[0], m.start(), m.end()) for m in TOKEN.finditer(text, start, stop)]


def shape(token: str) -> str:
    return "d" if token[0].isdigit() else "a" if token[0].isalpha() else "s" if token.isspace() else token


CUE_WORDS = {"phone", "tel", "call", "mobile", "card", "visa", "mail", "email", "e", "ip", "host", "server", "contact", "reach"}


def span_features(tokens: list[Token], i: int, j: int) -> list[int]:
    """Features of tokens[i:j] as one span."""
    own = [t for t, _, _ in tokens[i:j]]
    text = "".join(own).lower()
    groups = [t for t in own if t[0].isdigit()]
    digits = "".join(groups)
    joins = "".join(sorted({t for t in own if not t[0].isalnum()}))
    at = text.count("@") + len(re.findall(r"[\[(]at[\])]|\sat\s", text))
    dots = text.count(".") + len(re.findall(r"[\[(]dot[\])]|\sdot\s", text))
    before = next((t.lower() for t, _, _ in reversed(tokens[max(0, i - 3) : i]) if t[0].isalpha()), "")
    names = [
        f"n{min(len(digits), 20)}",
        "g" + "-".join(str(len(g)) for g in groups[:7]),
        f"ng{min(len(groups), 7)}",
        "j" + joins,
        "first" + shape(own[0]) + "last" + shape(own[-1]),
        f"at{min(at, 2)}dots{min(dots, 4)}",
        f"letters{min(2, sum(t[0].isalpha() for t in own))}digits{bool(digits)}",
        f"luhn{14 <= len(digits) <= 19 and luhn(digits)}",
        f"ip{len(groups) == 4 and all(len(g) < 4 and int(g) < 256 for g in groups)}dots{dots}",
        "before" + (shape(tokens[i - 1][0]) if i else "^") + "after" + (shape(tokens[j][0]) if j < len(tokens) else "$"),
        "cue" + (before if before in CUE_WORDS else ""),
        f"len{len(own)}",
        "year" if re.fullmatch(r"(19|20)\d\d([-/.]\d\d?([-/.]\d\d?)?)?", text) else "noyear",
    ]
    return [zlib.crc32(x.encode()) % FEATURES for x in names]


def token_feature(token: str) -> int:
    return zlib.crc32(f"out{shape(token)}{min(len(token), 8)}".encode()) % FEATURES


@dataclass
class Lattice:
    """Candidate spans of a stretch that start in a block of it: (start, end) in tokens and their features; and each token's
    own as outside."""

    ends: list[list[tuple[int, int]]]  # by end, less the block's first token: (start, row of features)
    features: np.ndarray
    outside: np.ndarray


def lattice(tokens: list[Token], first: int = 0, stop: int | None = None) -> Lattice:
    stop = len(tokens) if stop is None else stop
    ends: list[list[tuple[int, int]]] = [[] for _ in range(min(len(tokens), stop + LONGEST) - first + 1)]
    rows = []
    for i in range(first, stop):
        t = tokens[i][0]
        if not (t[0].isalnum() or t in "+(") or (i and t[0].isalnum() and tokens[i - 1][0][0].isalnum()):
            continue
        seen = False
        for j in range(i + 1, min(len(tokens), i + LONGEST) + 1):
            last = tokens[j - 1][0]
            seen = seen or last[0].isdigit() or last == "@" or last.lower() == "at"
            if last == "\n":
                break
            cut = j < len(tokens) and last[0].isalnum() and tokens[j][0][0].isalnum()
            if seen and last[0].isalnum() and not cut and j - i > 1 - last[0].isdigit():
                ends[j - first].append((i, len(rows)))
                rows.append(span_features(tokens, i, j))
    return Lattice(ends, np.array(rows, np.int64).reshape(len(rows), len(rows[0]) if rows else 0), np.array([token_feature(t) for t, _, _ in tokens[first:stop]], np.int64))


class Field:
    """Weights by type: one row for each of KINDS, the last for tokens outside of entities."""

    def __init__(self):
        self.w = np.zeros((len(KINDS) + 1, FEATURES))

    def scores(self, x: Lattice) -> tuple[np.ndarray, np.ndarray]:
        inside = self.w[:-1][:, x.features].sum(2).T if len(x.features) else np.zeros((0, len(KINDS)))
        return inside, self.w[-1][x.outside]

    def best(self, x: Lattice) -> list[tuple[int, int, int]]:
        """(start, end, type) of the best segmentation of a stretch of one block."""
        return self.decode(len(x.outside), [x])

    def decode(self, n: int, blocks: Iterable[Lattice]) -> list[tuple[int, int, int]]:
        """(start, end, type) of the best segmentation of n tokens; blocks come in order, so that only one is held."""
        best, back = [-np.inf] * (n + 1), [(0, -1)] * (n + 1)
        best[0], first = 0.0, 0
        for x in blocks:
            inside, outside = self.scores(x)
            top, kinds = (inside.max(1).tolist(), inside.argmax(1).tolist()) if len(inside) else ([], [])
            for k, own in enumerate(x.ends[1:], 1):
                j = first + k
                # Spans of earlier blocks that end here are in best[j] already; beyond the block only spans go on.
                if k <= len(outside) and (got := best[j - 1] + outside[k - 1]) >= best[j]:
                    best[j], back[j] = got, (j - 1, -1)
                for i, row in own:
                    if (got := best[i] + top[row]) > best[j]:
                        best[j], back[j] = got, (i, kinds[row])
            first += len(outside)
        out, j = [], n
        while j > 0:
            i, kind = back[j]
            if kind >= 0:
                out.append((i, j, kind))
            j = i
        return out[::-1]

    def learn(self, x: Lattice, gold: list[tuple[int, int, int]], rate: float, pull: float) -> None:
        """One ascent step of the log likelihood: observed less expected features, by forward and backward sums."""
        inside, outside = self.scores(x)
        n = len(outside)
        ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        ahead[0] = behind[n] = 0
        total = np.logaddexp.reduce(inside, axis=1) if len(inside) else np.zeros(0)
        for j in range(1, n + 1):
            ahead[j] = np.logaddexp.reduce([ahead[j - 1] + outside[j - 1], *[ahead[i] + total[r] for i, r in x.ends[j]]])
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for j, own in enumerate(x.ends):
            for i, r in own:
                starts[i].append((j, r))
        for i in range(n - 1, -1, -1):
            behind[i] = np.logaddexp.reduce([behind[i + 1] + outside[i], *[behind[j] + total[r] for j, r in starts[i]]])
        z = ahead[n]
        grad = np.zeros_like(self.w)
        p_out = np.exp(ahead[:-1] + outside + behind[1:] - z)
        np.add.at(grad[-1], x.outside, -p_out)
        for j, own in enumerate(x.ends):
            for i, r in own:
                p = np.exp(ahead[i] + inside[r] + behind[j] - z)
                for k in range(len(KINDS)):
                    np.add.at(grad[k], x.features[r], -p[k])
        taken = np.zeros(n, bool)
        rows = {(i, j): r for j, own in enumerate(x.ends) for i, r in own}
        for i, j, k in gold:
            taken[i:j] = True
            np.add.at(grad[k], x.features[rows[i, j]], 1)
        np.add.at(grad[-1], x.outside[~taken], 1)
        self.w += rate * (grad - pull * self.w)


def word_of(rng: random.Random) -> str:
    return "".join(rng.choice("aeinorstlmdu") for _ in range(rng.randint(2, 9)))


def entity(rng: random.Random, kind: int) -> str:
    """A form of a type that the patterns miss; a look-alike that is none for -1."""
    word = lambda: word_of(rng)
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == 0:
        at, dot = rng.choice([(" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), ("@", "."), (" @ ", ".")])
        got = f"{word()}{rng.choice(['', '.' + word(), num(2)])}{at}{word()}{dot}{rng.choice(['com', 'org', 'net'])}"
    elif kind == 1:
        got = rng.choice([".", " . "]).join(str(rng.randint(0, 255)) for _ in range(4))
    elif kind == 2:
        body = "4" + num(14)
        body += next(c for c in "0123456789" if luhn(body + c))
        got = rng.choice(["", ".", "/", "_", "  "]).join(body[k : k + 4] for k in range(0, 16, 4))
    elif kind == 3:
        a, b, c = rng.choice("23456789") + num(2), num(3), num(4)
        got = rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"001 {a} {b} {c}", f"+1/{a}/{b}/{c}"])
    else:
        got = rng.choice([num(rng.randint(1, 9)), f"{rng.randint(1, 12)}/{rng.randint(1, 28)}/20{num(2)}", f"version {num(1)}.{num(1)}", f"20{num(2)}-{num(2)}-{num(2)}", num(3) + word() + num(4), "$" + num(3) + "." + num(2), num(16), f"{num(2)}:{num(2)}:{num(2)}", f"CC-BY {num(1)}.0", f"{word()} at {word()}", f"{num(1)}.{num(2)}.{num(1)}"])
    return got


def joined(parts: list[tuple[str, int]]) -> tuple[str, list[tuple[int, int, int]]]:
    text, gold = "", []
    for got, kind in parts:
        if kind >= 0:
            gold.append((len(text), len(text) + len(got), kind))
        text += got
    return text, gold


def example(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A stretch of text and its entities in characters: forms that the patterns miss, and look-alikes that are none."""
    word = lambda: word_of(rng)
    parts: list[tuple[str, int]] = [(" ".join(word() for _ in range(rng.randint(1, 4))) + " ", -1)]
    for _ in range(rng.randint(0, 2)):
        kind = rng.choice([0, 1, 2, 3, -1, -1])
        got = entity(rng, kind)
        parts += [(got, kind), (" " + " ".join(word() for _ in range(rng.randint(1, 4))) + " ", -1)]
    return joined(parts)


def long_mail(rng: random.Random) -> str:
    """A spelt-out address with parts of several words."""
    at, dot = rng.choice([(" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot ")])
    local, domain = (rng.choice(".-_").join(word_of(rng) for _ in range(rng.randint(1, n))) for n in (4, 3))
    return f"{local}{at}{domain}{dot}{rng.choice(['com', 'org', 'net'])}"


def listing(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A list of entities of one type; addresses may be long."""
    kind, comma = rng.choice([0, 1, 2, 3, 3]), rng.choice([", ", ", ", ",", "; ", " | ", " and "])
    parts: list[tuple[str, int]] = [(word_of(rng) + " ", -1)]
    for k in range(rng.randint(1, 4)):
        parts += [(comma if k else "", -1), (long_mail(rng) if not kind and rng.random() < 0.7 else entity(rng, kind), kind)]
    return joined([*parts, (" " + word_of(rng), -1)])


def train(examples: int = 500, epochs: int = 4, seed: int = 11, lists: int = 200) -> Field:
    rng, field = random.Random(seed), Field()
    data = []
    for text, gold in (example(rng) if k < examples else listing(rng) for k in range(examples + lists)):
        tokens = tokens_of(text, 0, len(text))
        x = lattice(tokens)
        starts, stops = {a: k for k, (_, a, _) in enumerate(tokens)}, {b: k + 1 for k, (_, _, b) in enumerate(tokens)}
        spans = [(starts.get(a), stops.get(b), k) for a, b, k in gold]
        known = {(i, j) for j, own in enumerate(x.ends) for i, _ in own}
        if all((i, j) in known for i, j, _ in spans):
            data.append((x, spans))
    for epoch in range(epochs):
        rng.shuffle(data)
        for x, gold in data:
            field.learn(x, gold, 0.2 / (1 + epoch), 1e-3)
    return field


def cues(text: str) -> Iterator[tuple[int, int]]:
    """Places of digits and at-signs, also spelt-out ones; a bare "at" needs a "dot" where the same entity could have it."""
    for m in CUE.finditer(text):
        if m[0].lower() != "at":
            yield m.span()
            continue
        for t in islice(TOKEN.finditer(text, m.end()), LONGEST):
            if t[0] == "\n":
                break
            if t[0].lower() == "dot":
                yield m.start(), t.end()
                break


def inside_word(text: str, k: int) -> bool:
    return 0 < k < len(text) and text[k - 1].isalnum() and text[k].isalnum()


def reach_back(text: str, at: int, least: int) -> int:
    """Start of the longest entity that may hold what begins at a place, and its context; not before least."""
    count = 0
    while at > least and (count < LONGEST + CONTEXT or inside_word(text, at)):
        at -= 1
        if text[at] == "\n":
            break
        if text[at].isalpha():
            while at > least and text[at - 1].isalpha():
                at -= 1
        elif text[at] in DIGITS:
            while at > least and text[at - 1] in DIGITS:
                at -= 1
        count += 1
    return at


def reach_on(text: str, at: int, most: int, reached: int) -> int:
    """End of the longest entity that may hold what ends at a place, and the token after it; not beyond most. Words are
    followed only beyond what an earlier cue has reached."""
    for count, m in enumerate(TOKEN.finditer(text, at, most)):
        if count > LONGEST and (at < reached or not inside_word(text, at)):
            break
        at = m.end()
        if m[0] == "\n":
            break
    return at


def stretches(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Pieces around cues, cut at base spans."""
    starts: list[int] = []
    stops: list[int] = []
    for _, a, b in base:  # by start; overlapping spans become one
        if stops and a <= stops[-1]:
            stops[-1] = max(stops[-1], b)
        else:
            starts.append(a)
            stops.append(b)
    start = stop = -1
    for begin, end in cues(text):
        k = bisect.bisect_right(starts, begin)
        if k and begin < stops[k - 1]:
            continue
        least = stops[k - 1] if k else 0
        a = reach_back(text, begin, max(least, min(stop, begin)))
        most = starts[k] if k < len(starts) else len(text)
        b = reach_on(text, min(end, most), most, stop)
        if a <= stop:
            stop = max(stop, b)
        else:
            if stop > start:
                yield start, stop
            start, stop = a, b
    if stop > start:
        yield start, stop


class Finder:
    def __init__(self, field: Field):
        self.field = field

    def added(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        if not base and not CUE.search(text):
            return []
        out = []
        for a, b in stretches(text, base):
            tokens = tokens_of(text, a, b)
            blocks = (lattice(tokens, k, min(len(tokens), k + BLOCK)) for k in range(0, len(tokens), BLOCK))
            out += [(KINDS[kind], tokens[i][1], tokens[j - 1][2]) for i, j, kind in self.field.decode(len(tokens), blocks)]
        return out


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, base, added: spans with kind, start, stop in code points."""
    store.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field or train())
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
    named = lambda spans: [{"kind": k, "start": a, "stop": b} for k, a, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value)
        for batch in batches:
            base = [base_spans(t or "") for t in store.texts(batch)]
            added = [finder.added(t or "", b) for t, b in zip(store.texts(batch), base, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(named, base), kind), pa.array(map(named, added), kind)], ["doc_id", "base", "added"])

    spans = "array<struct<kind:string,start:int,stop:int>>"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, base {spans}, added {spans}")
