"""Personal data: fixed patterns, and a linear-chain CRF for what no pattern states.

Patterns give the base spans (email, ip, card, phone). A conditional random
field over word shapes adds spans of the kinds in KINDS: secrets, national
ids and bank accounts, with the words around them as context. It is trained
here on a small labelled table (examples()), by gradient ascent on the
regularised log-likelihood with forward and backward sums, and decoded by
Viterbi over batches of padded sequences in numpy. A sequence is the words with
a digit that lie close together, however many, and AROUND words on either side,
so no span ends at a sequence's edge and all its cues are in it. A span is kept
only where its words hold a digit (keys and passwords of letters alone are not
found), and never replaces a base span that it touches.

Words are runs without ASCII white space. What a word offers the model are
its shape (classes of characters, runs shortened), its length class, and the
word itself without case where it is one of CUES.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
EMAIL_HEAD = re.compile(r"[A-Za-z0-9._%+-]+\Z")
EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BASE = ("email", "ip", "card", "phone")
KINDS = ("secret", "national_id", "account")
AROUND = 12  # words beside those with a digit that are decoded with them
CELLS = 65_536  # words of a batch, padding included; a longer sequence is a batch of its own
CUES = ("token", "key", "secret", "password", "apikey", "api_key", "passwd", "=", ":", "ssn", "id", "passport", "social", "security", "number", "no", "iban", "account", "acct", "bank")
STATES = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
LINKED = np.array([[not b.startswith("I-") or (a != "O" and a[2:] == b[2:]) for b in STATES] for a in STATES])
FIRST = np.array([not s.startswith("I-") for s in STATES])
FLOOR = -1e9


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) << (k & 1)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost non-overlapping matches of EMAIL, looked for around each @ only."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        tail = EMAIL_TAIL.match(text, at) if start < at else None
        if tail:
            yield start, tail.end()
            end = tail.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Pattern matches by kind, then start; a match that fails its check is dropped and not tried again."""
    out = [("email", a, b) for a, b in emails(text)]
    if not any(c in text for c in "0123456789"):
        return out
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(x.lstrip("0")[:4] or 0) <= 255 for x in m[0].split("."))]  # four digits tell
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


_SHAPES = str.maketrans({**{chr(c): "a" for c in range(97, 123)}, **{chr(c): "A" for c in range(65, 91)}, **{chr(c): "0" for c in range(48, 58)}})
_RUNS = re.compile(r"(.)\1+")
_EDGE = "\"'`.,;!?()[]{}<>*&%$#|"


@lru_cache(maxsize=200_000)
def word_features(word: str) -> tuple[str, str, str]:
    bare = word.strip(_EDGE)
    shape = _RUNS.sub(r"\1", bare.translate(_SHAPES)) if bare.isascii() else "é"
    if "0" in shape and ("a" in shape or "A" in shape) and not re.search(r"[^aA0]", shape):
        shape = "mixed"
    if len(shape) > 9:
        shape = "long"
    length = "0" if not bare else str(min(6, len(bare) // 6))
    cue = bare.lower().rstrip(":=")
    return f"s={shape}", f"n={length}" if any(c.isdigit() for c in bare) else "n=-", f"c={cue}" if cue in CUES else ("c==" if word in ("=", ":", "=>") else "c=-")


def word_keys(word: str) -> tuple[str, ...]:
    shape, length, cue = word_features(word)
    return (f"{shape}|{length}", cue)


def examples(seed: int = 5, rows: int = 150) -> list[tuple[list[str], list[str]]]:
    """The labelled table: sentences of words with a state for each word. Generated, so it holds nobody's data."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    plain = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 12))) + rng.choice(["", "", "", ",", ".", "!!", "%%%", " |"]).strip()
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    mixed = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))

    def word() -> str:
        w = plain()
        return rng.choice([w, w, w, w.capitalize(), w.upper(), digits(rng.randrange(1, 6)), "é" + w, f"{w}@{plain().strip('.,!%|')}.com", f"+1 ({digits(3)})".split()[0], f"({digits(3)})", f"{digits(3)}-{digits(4)}", digits(16), rng.choice(CUES), f"v{digits(1)}.{digits(1)}"])

    def entity() -> tuple[list[str], list[str]]:
        kind = rng.choice(KINDS)
        if kind == "secret":
            body = rng.choice([mixed("0123456789abcdef", rng.choice([32, 40, 64])), mixed(letters + letters.upper() + "0123456789", rng.randrange(20, 44)), rng.choice(["sk", "ghp", "AKIA"]) + "_" + mixed(letters + "0123456789", 24)])
            name, sign = rng.choice(["token", "key", "secret", "password", "api_key", "apikey"]), rng.choice(["=", ":", ""])
            body = rng.choice([f'"{body}"', body, f"'{body}'"])
            words = [name + sign, body] if sign and rng.random() < 0.3 else [name, *([sign] if sign else []), body]
            return words, ["O"] * (len(words) - 1) + ["B-secret"]
        if kind == "national_id":
            body = [f"{digits(3)}-{digits(2)}-{digits(4)}"]
            name = rng.choice([["ssn"], ["SSN:"], ["social", "security", "number"], ["id", "no"]])
            return name + body, ["O"] * len(name) + ["B-national_id"]
        body = [rng.choice(["DE", "FR", "ES", "GB"]) + digits(2), *(digits(4) for _ in range(rng.randrange(3, 6)))]
        if rng.random() < 0.5:
            body = ["".join(body)]
        name = rng.choice([["iban"], ["IBAN:"], ["bank", "account"]])
        return name + body, ["O"] * len(name) + ["B-account"] + ["I-account"] * (len(body) - 1)

    out = []
    for k in range(rows):
        words, states = [], []
        for _ in range(k % 3):
            more = [word() for _ in range(rng.randrange(0, 6))]
            ent, own = entity()
            words, states = words + more + ent, states + ["O"] * len(more) + own
        more = [word() for _ in range(rng.randrange(1, 12))]
        out.append((words + more, states + ["O"] * len(more)))
    return out


class Model:
    """Weights of features of a word, of the word before and after, and of state pairs."""

    def __init__(self, sentences: list[tuple[list[str], list[str]]], rounds: int = 50, rate: float = 0.2, decay: float = 0.002) -> None:
        names = sorted({key for words, _ in sentences for w in words for key in word_keys(w)})
        self.index = {n: k for k, n in enumerate(names)}
        n, s = len(names) + 1, len(STATES)  # the last feature is any that training has not seen
        self.own, self.near, self.step = np.zeros((n, s)), np.zeros((4, n, s)), np.zeros((s, s))
        rows = [(np.array([self.ids(w) for w in words]), np.array([STATES.index(x) for x in states])) for words, states in sentences]
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.own, self.near, self.step)]
        for turn in range(1, rounds + 1):
            grads = [-decay * p for p in (self.own, self.near, self.step)]
            for ids, states in rows:
                self.gradient(ids, states, grads, 1 / len(rows))
            for p, g, m in zip((self.own, self.near, self.step), grads, moments, strict=True):
                m[0] += 0.1 * (g - m[0])
                m[1] += 0.01 * (g * g - m[1])
                p += rate * (m[0] / (1 - 0.9**turn)) / (np.sqrt(m[1] / (1 - 0.99**turn)) + 1e-8)

    def ids(self, word: str) -> list[int]:
        return [self.index.get(k, len(self.index)) for k in word_keys(word)]

    NEAR = ((-1, 0), (-1, 1), (-2, 1), (1, 0))  # distance and which of a word's keys

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """State scores of each word of a sequence of key ids, by the word and its neighbours."""
        out = self.own[ids].sum(axis=1)
        for k, (far, key) in enumerate(self.NEAR):
            if far < 0:
                out[-far:] += self.near[k][ids[:far, key]]
            else:
                out[:-far] += self.near[k][ids[far:, key]]
        return out

    def gradient(self, ids: np.ndarray, states: np.ndarray, grads: list[np.ndarray], share: float) -> None:
        """Add observed less expected counts of a sequence."""
        x, step, n = self.scores(ids), np.where(LINKED, self.step, FLOOR), len(ids)
        ahead, back = np.empty_like(x), np.zeros_like(x)
        ahead[0] = np.where(FIRST, x[0], FLOOR)
        lse = lambda v, axis: (top := v.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - top).sum(axis=axis))
        for t in range(1, n):
            ahead[t] = lse(ahead[t - 1][:, None] + step, 0) + x[t]
        for t in range(n - 2, -1, -1):
            back[t] = lse(step + x[t + 1] + back[t + 1], 1)
        total = lse(ahead[-1], 0)
        left = -np.exp(ahead + back - total)
        left[np.arange(n), states] += 1
        left *= share
        for key in range(ids.shape[1]):
            np.add.at(grads[0], ids[:, key], left)
        for k, (far, key) in enumerate(self.NEAR):
            np.add.at(grads[1][k], ids[:far, key] if far < 0 else ids[far:, key], left[-far:] if far < 0 else left[:-far])
        for t in range(1, n):
            grads[2][states[t - 1], states[t]] += share
            grads[2] -= share * np.exp(ahead[t - 1][:, None] + step + x[t] + back[t] - total)


@lru_cache(maxsize=1)
def trained() -> Model:
    return Model(examples())


def viterbi(x: np.ndarray, lengths: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The best states of each padded sequence (sequences x words x states); -1 past its end."""
    n, width, _ = x.shape
    best, back = np.where(FIRST, x[:, 0], FLOOR), np.zeros((n, width, len(STATES)), np.int8)
    for t in range(1, width):
        paths = best[:, :, None] + step
        back[:, t] = paths.argmax(axis=1)
        best = np.where((t < lengths)[:, None], paths.max(axis=1) + x[:, t], best)
    out, state = np.full((n, width), -1, np.int64), best.argmax(axis=1)
    for t in range(width - 1, -1, -1):
        here = t < lengths
        out[here, t] = state[here]
        if t:
            state = np.where(here, back[np.arange(n), t, state], state)
    return out


_WORD = re.compile(r"[^ \t\n\r\x0b\x0c]+")
_DIGIT = re.compile(r"[0-9]")


def sequences(text: str) -> Iterator[list[re.Match]]:
    """The words to decode together: those within AROUND words of one with a digit, in runs."""
    if not _DIGIT.search(text):
        return
    words = list(_WORD.finditer(text))
    first, stop = 0, -1
    for k, m in enumerate(words):
        if _DIGIT.search(m[0]):
            if k - AROUND > stop:
                if stop >= 0:
                    yield words[first:stop]
                first = max(0, k - AROUND)
            stop = k + AROUND + 1
    yield words[first:stop]


def added_spans(texts: list[str], model: Model) -> list[list[tuple[str, int, int]]]:
    """CRF spans of each text, by start. Words far from any digit hold no span and are not decoded."""
    out, waiting = [[] for _ in texts], []
    step = np.where(LINKED, model.step, FLOOR)

    def decode() -> None:
        width = max(len(w) for _, w in waiting)
        ids = np.full((len(waiting), width, 2), len(model.index))
        for k, (_, words) in enumerate(waiting):
            ids[k, : len(words)] = [known(m[0]) for m in words]
        x = model.own[ids].sum(axis=2)
        lengths = np.array([len(w) for _, w in waiting])
        inside = np.arange(width) < lengths[:, None]
        for k, (far, key) in enumerate(model.NEAR):
            near = model.near[k][ids[:, :, key]] * inside[:, :, None]
            if far < 0:
                x[:, -far:] += near[:, :far]
            else:
                x[:, :-far] += near[:, far:]
        found = viterbi(x, lengths, step)
        for k in np.flatnonzero((found > 0).any(axis=1)):
            text, words = waiting[k]
            t = 0
            while t < len(words):
                state = STATES[found[k, t]]
                if state[0] != "B":
                    t += 1
                    continue
                last = t
                while last + 1 < len(words) and STATES[found[k, last + 1]] == f"I-{state[2:]}":
                    last += 1
                part = texts[text][words[t].start() : words[last].end()]
                lead = len(part) - len(part.lstrip(_EDGE))
                bare = part.strip(_EDGE)
                if _DIGIT.search(bare):
                    start = words[t].start() + lead
                    out[text].append((state[2:], start, start + len(bare)))
                t = last + 1
        waiting.clear()

    known = lru_cache(maxsize=200_000)(model.ids)
    for k, words in sorted(((k, w) for k, text in enumerate(texts) for w in sequences(text)), key=lambda x: len(x[1])):
        if waiting and (len(waiting) + 1) * len(words) > CELLS:
            decode()
        waiting.append((k, words))
    if waiting:
        decode()
    return [sorted(spans, key=lambda s: s[1]) for spans in out]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _found(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = {k: n for n, k in enumerate((*BASE, *KINDS))}
        names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, rows = batch.slice(at, 500), []
                texts = part.column(1).fill_null("").to_pylist()
                for text, more in zip(texts, added_spans(texts, model), strict=True):
                    base = base_spans(text)
                    more = [s for s in more if all(s[2] <= b[1] or b[2] <= s[1] for b in base)]
                    count = [sum(k == kind for k, _, _ in base) for kind in BASE]
                    rows.append((*count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more, key=lambda s: (order[s[0]], s[1])))))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64() if k < 4 else pa.string()) for k, c in enumerate(zip(*rows, strict=True)))], names)

    return run


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and spans (code points, end exclusive) of the personal data of each row.

    A null text is empty and has none. Rows are independent, so repeated rows
    and ids give equal values; a null id stays null, an empty table gives no
    rows, and other columns are not read. Texts of any length are read whole.
    """
    columns = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return columns.mapInArrow(_found(trained()), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
