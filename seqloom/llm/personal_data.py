"""PII: base patterns, and a linear-chain conditional random field over word-shape features.

The base patterns find e-mail addresses, IPv4 addresses, card numbers and phone numbers. The field labels tokens (runs of letters,
runs of digits, single signs) with O, B- and I- tags of the four kinds; its features are the token's shape (the words `at` and `dot` are
shapes of their own), its neighbours' shapes, pairs and triples of them, and whether space stands before it. It is trained by gradient ascent
on the likelihood of a small labelled table (TABLE_ROWS rows, made by a rule from templates) and decoded by Viterbi, many sequences of a batch at
once in numpy.

Sequences are the tokens within CONTEXT tokens of a digit, an at sign or a written-out one, and the whole of an address around an at sign; a span
of any kind holds one of these, so whole texts are read but only such places are decoded. A decoded span counts if the marginal probability
of its kind is at least MARGINAL at each token, its digits are as many as its kind has (see enough), and it meets no base span; an address is
extended to the ends of its runs of address characters.

Defined results: a null text is empty and has no spans; spans are in code points, ends exclusive; of best sequences with one score that with
the lower tags last is taken; repeated rows are treated alike; very long texts are taken whole; an empty table gives no rows; other columns are ignored by report() and
pass through mask().
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from bisect import bisect_left
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string as schema

from . import common

KINDS = ("email", "ip", "card", "phone")
CONTEXT, TABLE_ROWS, MARGINAL = 6, 900, 0.5

# ---- base patterns (fixed by contract)

DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# matches begin where a run of digits begins: a later start in the run fails as the first one does
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
HOST = re.compile(r"\s?[A-Za-z0-9-]++(?:\s?\.\s?[A-Za-z0-9-]++)*+")
REST = re.compile(r"[A-Za-z0-9-]*(?:\.[A-Za-z0-9-]+)*")
SPACE = re.compile(" ")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """What the e-mail pattern matches, found from its at signs: the local part is the run of its characters before one."""
    out, least, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > least and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            least = m.end()
        at = text.find("@", m.end() if m else at + 1)
    return out


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind."""
    out: list = [emails(text) if "@" in text else [], [], [], []]
    if DIGIT.search(text):
        out[1] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m[0].split("."))]
        out[2] = [m.span() for m in CARD.finditer(text) if 16 <= len(d := digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out[3] = [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    return out


# ---- tokens and features

TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\s]")
ANCHOR = re.compile(r"[0-9@]|\b[dD][oO][tT]\b|[\[(] ?[aA][tT] ?[\])]")


def shape(token: str) -> str:
    c = token[0]
    if "0" <= c <= "9":
        return f"{'0' if c == '0' and len(token) > 1 else '9'}{min(len(token), 9)}"
    if c.isalpha():
        if token.lower() in ("at", "dot"):
            return token.lower()
        return ("A" if token.isupper() else "Aa" if c.isupper() else "a") + ("1" if len(token) == 1 else "2" if len(token) <= 3 else "+")
    return c


def facts(tokens: list[str], spaced: list[bool]) -> list[list[str]]:
    """Features of each token."""
    s = ["<", "<", *map(shape, tokens), ">", ">"]
    gap = [*(" " if x else "" for x in spaced), " ", " "]
    return [
        [f"s{s[i]}", f"p{s[i - 1]}{gap[i - 2]}", f"n{gap[i - 1]}{s[i + 1]}", f"a{s[i - 1]}{gap[i - 2]}|{s[i]}", f"b{s[i]}{gap[i - 1]}|{s[i + 1]}", f"c{s[i - 2]}|{s[i - 1]}|{s[i]}", f"d{s[i]}|{s[i + 1]}|{s[i + 2]}", "bias"]
        for i in range(2, len(tokens) + 2)
    ]


N_FACTS, TAGS = 8, 1 + 2 * len(KINDS)


# ---- labelled table


def _card(rng: random.Random) -> str:
    body = "4" + "".join(str(rng.randrange(10)) for _ in range(14))
    return next(body + str(d) for d in range(10) if luhn(body + str(d)))


def labelled(rows: int = TABLE_ROWS, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The small labelled table: (text, spans (kind, start, end)), made by a rule; a third of the rows has no personal data."""
    rng = random.Random(seed)
    syllables = "an er th on re ou le de en ti or st ch ung ent ar os ion me ra".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    num = lambda n: "".join(str(rng.randrange(10)) for _ in range(n))

    def email():
        name = rng.choice([word(), f"{word()}.{num(2)}", f"{word()}_{word()}", f"{word()}.{word()}", f"{word()}{num(2)}"])
        host = rng.choice([f"{word()}.example.com", f"mail{num(1)}.example.org", f"{word()}.net", f"{word()}.example.com"])
        at = rng.choice(["@", " @ ", " @ ", " at ", " [at] ", "(at)"])
        return name.replace(".", " dot ") + at + host.replace(".", " dot ") if at == " at " else name + at + host.replace(".", rng.choice([".", ".", " . "]) if at == " @ " else ".")

    def ip():
        return rng.choice([".", ".", " . ", "[.]"]).join(str(rng.randrange(1, 256)) for _ in range(4))

    def card():
        d = _card(rng)
        return rng.choice(["", " ", "-", "."]).join([d[:4], d[4:8], d[8:12], d[12:]])

    def phone():
        some = rng.choice(["+1 ({0}) {1}-{2}", "({0}) {1}-{2}", "{0}-{1}-{2}", "+49 {0} {1}{2}", "{0}.{1}.{2}", "1-{0}-{1}-{2}", "0{4}/{1}{2}", "0{0} {1}{2}", "0{0}/{1}{2}", "0{0}-{1}{2}", "(0{0}) {1}{2}", "+{4} {0} {1} {2}", "00{4} {0} {1}{2}"])
        return some.format(num(3), num(3), num(4), num(1), num(2))

    def none():
        hexa = "".join(rng.choice("0123456789abcdef") for _ in range(18))
        plain = [num(1), num(2), num(4), num(6), num(9), f"{num(1)}.{num(2)}", f"{num(1)}.{num(1)}.{num(1)}", f"20{num(2)}-0{num(1)}-1{num(1)}", f"{num(2)}:{num(2)}", f"${num(3)}", f"{num(2)}%", f"password={hexa}", f'token = "{hexa}"', f"{word()}{num(2)}", f"@{word()}", f"{num(3)}-{num(2)}", f"{num(1)},{num(3)}", f"({num(4)})"]
        more = [f"{word()} at {word()}", f"at {num(2)}", f"dot {word()}", f"{word()} dot", f"{num(1)}/{num(1)}", f"0{num(1)}/1{num(1)}/20{num(2)}", f"20{num(2)}/{num(2)}", f"1{num(1)} {num(3)} {num(3)}", f"{num(4)}-{num(4)}", f"{num(3)} {num(3)}", f"#{num(8)}", f"20{num(2)}-0{num(1)}-1{num(1)} {num(2)}:{num(2)}:{num(2)}", f"{num(2)} + {num(2)}", f"{word()} {num(7)}", f"0.{num(6)}", f"{num(3)},{num(3)},{num(3)}", f"{word()} (at {num(2)})", f"{word()}@{word()}", f"{num(8)}", f"1{num(3)} {num(7)}"]
        return rng.choice(plain + more)

    make = {"email": email, "ip": ip, "card": card, "phone": phone}
    out = []
    for r in range(rows):
        text, spans = " ".join(word() for _ in range(rng.randint(0, 6))), []
        for _ in range(rng.randint(1, 2)):
            kind = "" if r % 3 == 0 or rng.random() < 0.25 else rng.choice(KINDS)
            text += " " * bool(text)
            part = make[kind]() if kind else none()
            if kind:
                spans.append((kind, len(text), len(text) + len(part)))
            text += part + rng.choice(["", "", ",", "."]) + " " + " ".join(word() for _ in range(rng.randint(0, 6)))
        out.append((text, spans))
    return out


# ---- the field


def _allowed() -> np.ndarray:
    """I of a kind follows only B or I of it: 0 where allowed, else a large negative number."""
    out = np.zeros((TAGS, TAGS))
    for k in range(len(KINDS)):
        out[:, 2 * k + 2] = -1e4
        out[[2 * k + 1, 2 * k + 2], 2 * k + 2] = 0
    return out


class Field:
    """Weights of facts (rows) for tags, of tag pairs and of first tags."""

    def __init__(self, table, steps: int = 60, rate: float = 0.2, l2: float = 1e-4):
        sequences, self.index = [], {}
        for text, spans in table:
            tokens = list(TOKEN.finditer(text))
            tags = [0] * len(tokens)
            for kind, a, b in spans:
                inside = [i for i, m in enumerate(tokens) if a <= m.start() and m.end() <= b]
                for i in inside:
                    tags[i] = 2 * KINDS.index(kind) + (1 if i == inside[0] else 2)
            f = facts([m[0] for m in tokens], [bool(i) and m.start() > tokens[i - 1].end() for i, m in enumerate(tokens)])
            sequences.append((f, tags))
        for f, _ in sequences:
            for row in f:
                for x in row:
                    self.index.setdefault(x, len(self.index) + 1)
        n, t = len(sequences), max(len(f) for f, _ in sequences)
        ids, tags, mask = np.zeros((n, t, N_FACTS), np.int64), np.zeros((n, t), np.int64), np.zeros((n, t), bool)
        for i, (f, y) in enumerate(sequences):
            ids[i, : len(f)], tags[i, : len(f)], mask[i, : len(f)] = [[self.index[x] for x in row] for row in f], y, True
        self.emit, self.step, self.first = np.zeros((len(self.index) + 1, TAGS)), np.zeros((TAGS, TAGS)), np.zeros(TAGS)
        self.fixed, moment = _allowed(), None
        self.fixed_first = self.fixed[0]
        for k in range(steps):
            grads = self._gradient(ids, tags, mask)
            params = [self.emit, self.step, self.first]
            grads = [g / n - l2 * p for g, p in zip(grads, params)]
            moment = moment or [(np.zeros_like(p), np.zeros_like(p)) for p in params]
            for p, g, (m, v) in zip(params, grads, moment):  # Adam
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p += rate * (m / (1 - 0.9 ** (k + 1))) / (np.sqrt(v / (1 - 0.99 ** (k + 1))) + 1e-8)
            self.emit[0] = 0

    def _sums(self, e: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward sums (t, n, tags), each token's to a scale of its own, and exponentials of the weights of tag pairs and tokens."""
        n, t = mask.shape
        a, x = np.exp(self.step + self.fixed), np.exp(np.moveaxis(e - e.max(2, keepdims=True), 1, 0))
        fwd, back = np.zeros((t, n, TAGS)), np.ones((t, n, TAGS))
        fwd[0] = np.exp(self.first + self.fixed_first) * x[0]
        for i in range(1, t):
            f = (fwd[i - 1] @ a) * x[i]
            fwd[i] = np.where(mask[:, i, None], f / f.sum(1, keepdims=True), fwd[i - 1])
        for i in range(t - 2, -1, -1):
            b = (x[i + 1] * back[i + 1]) @ a.T
            back[i] = np.where(mask[:, i + 1, None], b / b.sum(1, keepdims=True), back[i + 1])
        return fwd, back, a, x

    def _gradient(self, ids, tags, mask):
        """Of the log-likelihood: what is seen less what is expected."""
        n, t = tags.shape
        fwd, back, a, x = self._sums(self.emit[ids].sum(2), mask)
        p = np.moveaxis(fwd * back, 0, 1)
        p = p / p.sum(2, keepdims=True) * mask[:, :, None]
        seen = np.eye(TAGS)[tags] * mask[:, :, None]
        d, step = seen - p, np.zeros((TAGS, TAGS))
        flat = ids[mask].reshape(-1)
        emit = np.stack([np.bincount(flat, np.repeat(d[mask][:, y], N_FACTS), len(self.emit)) for y in range(TAGS)], 1)
        for i in range(1, t):
            # the pair (y, z) has fwd y * a yz * next z, to the scale of their sum
            after = x[i] * back[i]
            scale = mask[:, i] / ((fwd[i - 1] @ a) * after).sum(1)
            step += seen[:, i - 1].T @ seen[:, i] - a * ((fwd[i - 1] * scale[:, None]).T @ after)
        return emit, step, d[:, 0].sum(0)

    def marginals(self, sequences: list[list[list[str]]]) -> list[np.ndarray]:
        """Probability of each tag at each token of each sequence."""
        out: list = [None] * len(sequences)
        for part in by_length(sequences):
            t, length = len(sequences[part[-1]]), np.array([len(sequences[i]) for i in part])
            fwd, back, _, _ = self._sums(self.emit[self._ids([sequences[i] for i in part], t)].sum(2), np.arange(t) < length[:, None])
            p = np.moveaxis(fwd * back, 0, 1)
            p = p / p.sum(2, keepdims=True)
            for r, i in enumerate(part):
                out[i] = p[r, : length[r]]
        return out

    def _ids(self, sequences: list, t: int) -> np.ndarray:
        """Numbers of the facts of sequences, padded to t tokens."""
        ids, get = np.zeros((len(sequences), t, N_FACTS), np.int64), self.index.get
        for r, rows in enumerate(sequences):
            flat = [x for row in rows for x in row]
            ids[r, : len(rows)] = np.fromiter(map(get, flat, repeat(0)), np.int64, len(flat)).reshape(-1, N_FACTS)
        return ids

    def viterbi(self, sequences: list[list[list[str]]]) -> list[list[int]]:
        """The best tags of each sequence; sequences of about one length are decoded together."""
        out: list = [None] * len(sequences)
        a = self.step + self.fixed
        for part in by_length(sequences):
            n, t = len(part), len(sequences[part[-1]])
            ids = self._ids([sequences[i] for i in part], t)
            length = np.array([len(sequences[i]) for i in part])
            score, back = self.first + self.fixed_first + self.emit[ids[:, 0]].sum(1), np.zeros((t, n, TAGS), np.int8)
            for i in range(1, t):
                s = score[:, :, None] + a
                back[i] = s.argmax(1)
                score = np.where((i < length)[:, None], s.max(1) + self.emit[ids[:, i]].sum(1), score)
            tag, tags = score.argmax(1), np.zeros((n, t), np.int64)
            for i in range(t - 1, -1, -1):
                inside = i < length
                tags[:, i] = np.where(inside, tag, 0)
                if i:
                    tag = np.where(inside, back[i][np.arange(n), tag], tag)
            for r, i in enumerate(part):
                out[i] = tags[r, : length[r]].tolist()
        return out


def by_length(sequences: list) -> list[list[int]]:
    """Numbers of sequences in order of length, as many together as fit 200,000 tokens when padded; a longer one is alone."""
    order, out = sorted(range(len(sequences)), key=lambda i: len(sequences[i])), []
    for i in order:
        if out and (len(out[-1]) + 1) * len(sequences[i]) <= 200_000:
            out[-1].append(i)
        else:
            out.append([i])
    return out


@functools.cache
def field() -> Field:
    return Field(labelled())


def reach(text: str, m: re.Match) -> tuple[int, int]:
    """Where an address with that at sign (in brackets it may be the word) can begin and end, space beside its signs included."""
    if m[0][0] not in "@[(":
        return m.span()
    start = m.start() - (m.start() > 0 and text[m.start() - 1].isspace())
    while start and text[start - 1] in LOCAL:
        start -= 1
    host = HOST.match(text, m.end())
    return start, host.end() if host else m.end()


def windows(text: str) -> list[list[re.Match]]:
    """Sequences of tokens around digits and at signs."""
    if not ANCHOR.search(text):
        return []
    # cut the text near anchors first, so that long texts aren't tokenised whole: CONTEXT tokens lie between two spaces each at most
    out, spans = [], []
    spaces = [m.start() for m in SPACE.finditer(text)]
    for m in ANCHOR.finditer(text):
        first, last = reach(text, m)
        k = bisect_left(spaces, last) + 1
        k = max(k, bisect_left(spaces, m.end()) + CONTEXT)
        b = spaces[k] + 1 if k < len(spaces) else len(text)
        k = min(bisect_left(spaces, m.start()) - CONTEXT - 1, bisect_left(spaces, first) - 2)
        a = spaces[k] if k >= 0 else 0
        while spans and a <= spans[-1][1]:
            s, e = spans.pop()
            a, b = min(a, s), max(b, e)
        spans.append((a, b))
    for a, b in spans:
        tokens = list(TOKEN.finditer(text, a, b))
        starts = [m.start() for m in tokens]
        near = np.zeros(len(tokens) + 1, np.int64)
        for m in ANCHOR.finditer(text, a, b):
            i = bisect_left(starts, m.start())
            if i < len(starts) and starts[i] == m.start():
                first, last = reach(text, m)
                # a whole address and the tokens beside it
                near[max(0, min(i - CONTEXT, bisect_left(starts, first) - 1))] += 1
                near[min(len(tokens), max(i + CONTEXT, bisect_left(starts, last)) + 1)] -= 1
        run: list = []
        for m, n in zip(tokens, near.cumsum()):
            if n:
                run.append(m)
            elif run:
                out.append(run)
                run = []
        if run:
            out.append(run)
    return out


def enough(kind: str, text: str) -> bool:
    """The span has as many digits as its kind; a card's pass Luhn, an IP address has four numbers up to 255, an address has one at sign or one word for it."""
    d = digits(text)
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 16 <= len(d) <= 19 and luhn(d)
    return len(re.findall(r"@|\bat\b", text, re.I)) == 1 if kind == "email" else 8 <= len(d) <= 15


def find(texts: list[str | None], crf: Field) -> list[tuple[list, list]]:
    """Of each text: base spans by kind, and the spans that the field adds, (kind, start, end)."""
    texts = [t or "" for t in texts]
    own = [base(t) for t in texts]
    where = [(r, w) for r, t in enumerate(texts) for w in windows(t)]
    given = [facts([m[0] for m in w], [bool(i) and m.start() > w[i - 1].end() for i, m in enumerate(w)]) for _, w in where]
    tags = crf.viterbi(given)
    some = [i for i, y in enumerate(tags) if any(y)]
    sure = dict(zip(some, crf.marginals([given[i] for i in some])))
    added: list[list] = [[] for _ in texts]
    for n in some:
        (r, w), y, p = where[n], tags[n], sure[n]
        i = 0
        while i < len(y):
            j = i + 1
            if y[i] % 2:
                while j < len(y) and y[j] == y[i] + 1:
                    j += 1
                kind, a, b = (y[i] - 1) // 2, w[i].start(), w[j - 1].end()
                if KINDS[kind] == "email":  # to the ends of the runs of an address' characters
                    while a and texts[r][a - 1] in LOCAL:
                        a -= 1
                    b = REST.match(texts[r], b).end()
                if (p[i:j, 2 * kind + 1] + p[i:j, 2 * kind + 2] >= MARGINAL).all() and enough(KINDS[kind], texts[r][a:b]) and not any(s < b and a < e for spans in own[r] for s, e in spans):
                    added[r].append((kind, a, b))
            i = j
    return list(zip(own, added))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def report(docs: DataFrame) -> DataFrame:
    """The contract's digest columns."""
    shared = docs.sparkSession.sparkContext.broadcast(field())

    def make():
        def work(batch):
            out: dict = {c.split()[0]: [] for c in RESULT.split(", ")}
            out["doc_id"] = batch.column("doc_id")
            for own, added in find(common.texts(batch), shared.value):
                for k, name in enumerate(KINDS):
                    out[f"n_{name}"].append(len(own[k]))
                flat = [(k, a, b) for k, spans in enumerate(own) for a, b in spans]
                out["base_sha256"].append(hashlib.sha256(joined(flat).encode()).hexdigest())
                out["spans"].append(joined([*flat, *added]))
            return out

        return work

    return common.map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, schema(RESULT))


def masked(text: str, own: list, added: list) -> str:
    """The text with <KIND> for each span; spans that meet become one, named after the first."""
    spans = sorted([(a, b, k) for k, spans in enumerate(own) for a, b in spans] + [(a, b, k) for k, a, b in added])
    out, last, kind = [], 0, None
    end = -1
    for a, b, k in spans:
        if a < end:
            end = max(end, b)
            continue
        if kind is not None:
            out.append(f"<{KINDS[kind].upper()}>")
            last = end
        out.append(text[last:a])
        end, kind = b, k
    if kind is not None:
        out.append(f"<{KINDS[kind].upper()}>")
        last = end
    return "".join([*out, text[last:]])


def mask(docs: DataFrame) -> DataFrame:
    """All documents with personal data masked; n_chars follows the text, other columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(field())

    def run(batches):
        for batch in batches:
            old = common.texts(batch)
            new = [t if t is None or not (any(own) or added) else masked(t, own, added) for t, (own, added) in zip(old, find(old, shared.value))]
            cols = [batch.column(i) for i in range(batch.num_columns)]
            for i, f in enumerate(batch.schema):
                if f.name == "text":
                    cols[i] = pa.array(new, f.type)
                elif f.name == "n_chars":
                    cols[i] = pa.array([n if t is o else len(t) for n, o, t in zip(batch.column(i).to_pylist(), old, new)], f.type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


