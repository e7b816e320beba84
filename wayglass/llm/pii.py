"""Personal data: four patterns with checks, and a linear-chain conditional random field over word shapes.

The patterns give e-mail addresses, internet addresses, card numbers and international telephone numbers. The field adds
national telephone numbers, secrets (tokens, keys, passwords) and personal identity numbers; its spans that overlap a pattern's span are left out.
It is trained on the driver from a small labelled table and decoded exactly by Viterbi in numpy batches over the words of many texts at
once: words whose emission for "outside" beats every other label by more than transitions can make up for are outside on the best
path whatever their neighbours, so only the stretches between them are decoded step by step.

Defined results: null and empty texts have no spans; very long texts and words are searched whole, in time that grows with their length;
repeated rows are searched each; an empty table gives an empty result; other columns are ignored or passed through; between overlapping spans of the field and the patterns the patterns' stay.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import lean, text_of

KINDS = ("email", "ip", "card", "phone")
#: Labels of the field; the first is "outside".
LABELS = ("O", "national_phone", "secret", "identity")
CACHE = 150_000
#: Longer words aren't kept, so that the memory of words stays bounded.
CACHED_CHARS = 100
#: Words that are decoded at once.
BATCH_WORDS = 200_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Possessive: nothing follows that giving back could help, and no stack of a long run is held.
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_BLANKS = " \t\n\x0b\f\r"
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_MARKS = "\"'`.,;:!?#*$%&|<>[]{}"
_LETTER = re.compile(r"[^\W\d_]")
_REPEATED = re.compile(r"(.)\1+")
_KEYLIKE = re.compile(r"[0-9A-Za-z_-]+")
_NUMBERS = tuple((re.compile(p), name) for p, name in ((r"\([0-9]{3}\)", "area"), (r"[0-9]{3}-[0-9]{4}", "local"), (r"[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}", "national"), (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "identity")))
#: A letter of A-Z and a-z becomes a, a digit 9.
_FORM = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZbcdefghijklmnopqrstuvwxyz012345678", "a" * 51 + "9" * 9)
_PLAIN = tuple("a" * n for n in range(17))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def ip_spans(text: str) -> Iterator[tuple[int, int]]:
    """Internet addresses. A match takes four neighbours of a chain of numbers, so each chain is read once, in fours from its start."""
    for m in _CHAIN.finditer(text):
        parts = m.group().split(".")
        if len(parts) < 4:
            continue
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each of KINDS, leftmost and non-overlapping; matches that fail their check are dropped."""
    emails: list[tuple[int, int]] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            emails.append(m.span())
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    if not _DIGIT.search(text):
        return [emails, [], [], []]
    ips = list(ip_spans(text)) if "." in text else []
    cards = []
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            cards.append(m.span())
    phones = [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15] if "+" in text else []
    return [emails, ips, cards, phones]


# ---------------------------------------------------------------------------------------------------------------
# the field


def word_signs(word: str) -> list[str]:
    """Features of a word's shape."""
    core = word.strip(_MARKS)
    plain = core.translate(_FORM)
    shape = _REPEATED.sub(r"\1", _LETTER.sub("a", plain))
    digits = plain.count("9")
    signs = [f"s={shape[:12]}", f"d={min(digits, 5) if digits < 6 else 6 if digits < 9 else 9 if digits < 12 else 12}", f"l={len(core) if len(core) < 4 else 4 if len(core) < 16 else 16}"]
    if digits == 0:
        signs.append("plain" if core.isalpha() or not core else "marked")
    if len(core) >= 16 and digits >= 3 and "a" in plain and _KEYLIKE.fullmatch(core):
        signs.append("keylike")
    if digits >= 3:
        signs += [name for pattern, name in _NUMBERS if pattern.fullmatch(core)]
    low = core.lower().rstrip("=:")
    if low in CUES:
        signs.append(f"cue={CUES[low]}")
    if core in ("=", ":", "") and word:
        signs.append("joint")
    return signs


def word_form(word: str) -> str:
    """A word with the same signs, one for many words: most have letters alone, and then only their number counts."""
    core = word.strip(_MARKS)
    if not core or core.lower().rstrip("=:") in CUES:
        return core or "."
    return _PLAIN[min(len(core), 16)] if core.isalpha() else core.translate(_FORM)


#: Words that announce a kind.
CUES = {
    "phone": "phone", "tel": "phone", "call": "phone", "telephone": "phone", "mobile": "phone", "fax": "phone", "dial": "phone",
    "token": "secret", "key": "secret", "api_key": "secret", "apikey": "secret", "secret": "secret", "password": "secret", "passwd": "secret", "access_token": "secret", "bearer": "secret",
    "ssn": "identity", "social": "identity", "identity": "identity", "passport": "identity",
}

#: The labelled table: {phone}, {secret} and {identity} are filled in; each word of a filling has its label.
TABLE = (
    'token = {secret} of the', 'api_key = {secret} and so', 'secret: {secret}', 'password = {secret} is', 'the key {secret} was', 'bearer {secret}', 'access_token = {secret} in it.', 'ends here. token = {secret}',
    'token={secret}', 'call {phone} now', 'phone {phone}', 'tel. {phone} or write', 'reach us at {phone}, please', 'the {phone} line', 'fax: {phone}', 'and {phone}. Then', 'mobile {phone} of the',
    'ssn {identity} was', 'social security {identity}', 'his identity {identity}, he', 'the {identity} file',
    'in 1984 the 12 men', 'of 3.5 and 10,000 more', 'see pages 12-14 of it', 'the key to it all', 'a token of thanks', 'call me now', 'version 2.0. License', 'it was | 12 | 45 |', '10.0.0.1 is not', 'write to a.b@c.example now',
    'card 4539578763621486 was', 'at 12:30 on 2024-01-31 there', 'the word, another. And *more* words!!', 'plain words only and nothing else', '### heading $$$ of %%% junk &&&', 'chapter 7 verse 21', '+1 (372) 555-7739 is', 'a 123456 b 7777777 c',
    'no. 555 and 4444', 'phone home at once', 'my password is long', 'the social contract', 'well-known half-life x-ray', 'item #45 costs $300', '(see above) (note)', 'licence MIT-0 under Apache-2.0', 'numbers 1 2 3 4 5', 'Licensed under the Apache License, Version 2.0.',
    'Copyright 2020 The Authors', 'https://example.com/a/b?c=1 is', 'room 101-B and gate A12', 'a deliberately-very-long-compound-word here', 'Donaudampfschifffahrtsgesellschaft and so', '== title ==', 'x = 5 ; y = 7', 'isbn 978-3-16-148410-0 of',
)


def labelled_table(copies: int = 12, seed: int = 11) -> list[tuple[list[str], list[int]]]:
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def filling(kind: str) -> str:
        if kind == "phone":
            return rng.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}"])
        if kind == "identity":
            return f"{digits(3)}-{digits(2)}-{digits(4)}"
        n = rng.choice([20, 24, 30, 32, 36, 40])
        body = "".join(rng.choice(rng.choice(["0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789"])) for _ in range(n - 2)) + rng.choice("0123456789") + rng.choice("abcdef")
        return rng.choice(['"{}"', "{}", "'{}'"]).format(rng.choice([body, body.upper(), body]))

    rows = []
    for _ in range(copies):
        for line in TABLE:
            words, labels = [], []
            for part in re.split(r"(\S*\{\w+\}\S*)", line):
                m = re.search(r"\{(\w+)\}", part)
                own = (part.replace(m.group(), filling(m.group(1))) if m else part).split()
                words += own
                labels += [{"phone": 1, "secret": 2, "identity": 3}[m.group(1)] if m else 0] * len(own)
            rows.append((words, labels))
    return rows


@dataclass
class Field:
    """Weights of (feature, label) by place (own, previous, next word), and of label pairs."""

    weights: dict[str, np.ndarray]
    moves: np.ndarray

    @classmethod
    def fit(cls, rows: list[tuple[list[str], list[int]]], rounds: int = 150, l2: float = 1e-3) -> Field:
        k = len(LABELS)
        names: dict[str, int] = {}
        cells, longest = [], max(len(w) for w, _ in rows) + 2
        for words, _ in rows:
            signs = [["edge"], *[word_signs(w) for w in words], ["edge"]]
            line = []
            for i in range(len(signs)):
                own = ["0" + s for s in signs[i]]
                own += ["-" + s for s in signs[i - 1]] if i else []
                own += ["+" + s for s in signs[i + 1]] if i + 1 < len(signs) else []
                line.append([names.setdefault(f, len(names)) for f in own])
            cells.append(line)
        n = len(rows)
        lengths = np.array([len(c) for c in cells])
        gold = np.zeros((n, longest), int)
        for r, (_, labels) in enumerate(rows):
            gold[r, 1 : 1 + len(labels)] = labels
        at = [(r, i, f) for r, c in enumerate(cells) for i, fs in enumerate(c) for f in fs]
        rr, ii, ff = map(np.array, zip(*at, strict=True))
        w, t = np.zeros((len(names), k)), np.zeros((k, k))
        gw, gt = np.full_like(w, 1e-6), np.full_like(t, 1e-6)
        real = np.arange(longest)[None] < lengths[:, None]
        eye = np.eye(k)
        for _ in range(rounds):
            e = np.zeros((n, longest, k))
            np.add.at(e, (rr, ii), w[ff])
            a = np.full((n, longest, k), -np.inf)
            a[:, 0] = np.where(np.arange(k) == 0, e[:, 0], -1e9)  # texts begin and end outside
            for i in range(1, longest):
                a[:, i] = e[:, i] + np.logaddexp.reduce(a[:, i - 1, :, None] + t[None], axis=1)
            b = np.zeros((n, longest, k))
            end = lengths - 1
            b[np.arange(n), end] = np.where(np.arange(k) == 0, 0, -1e9)
            for i in range(longest - 2, -1, -1):
                step = np.logaddexp.reduce(t[None] + (e[:, i + 1] + b[:, i + 1])[:, None, :], axis=2)
                b[:, i] = np.where((i < end)[:, None], step, b[:, i])
            z = np.logaddexp.reduce(a[np.arange(n), end] + b[np.arange(n), end], axis=1)
            p = np.exp(np.clip(a + b - z[:, None, None], -700, 0)) * real[..., None]
            d = (eye[gold] * real[..., None] - p) / n
            dw = np.zeros_like(w)
            np.add.at(dw, ff, d[rr, ii])
            dt = np.zeros_like(t)
            for i in range(1, longest):
                pair = np.exp(np.clip(a[:, i - 1, :, None] + t[None] + (e[:, i] + b[:, i])[:, None, :] - z[:, None, None], -700, 0)) * real[:, i, None, None]
                dt += ((eye[gold[:, i - 1]][:, :, None] * eye[gold[:, i]][:, None, :]) * real[:, i, None, None] - pair).sum(0) / n
            dw, dt = dw - l2 * w, dt - l2 * t
            gw, gt = gw + dw * dw, gt + dt * dt
            w, t = w + 0.5 * dw / np.sqrt(gw), t + 0.5 * dt / np.sqrt(gt)
        return cls({f: w[i] for f, i in names.items()}, t)


class Memory(dict[str, int]):
    """What a function gives for words, kept for those of up to CACHED_CHARS characters; emptied when it holds CACHE of them."""

    def __init__(self, of: Callable[[str], int]):
        super().__init__()
        self.of = of

    def __missing__(self, word: str) -> int:
        got = self.of(word)
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHE:
                self.clear()
            self[word] = got
        return got


class Decoder:
    """Viterbi over the words of many texts in numpy."""

    def __init__(self, model: Field):
        k = len(LABELS)
        self.model, self.t = model, model.moves
        self.classes: dict[tuple[str, ...], int] = {}
        self.rows: list[list[np.ndarray]] = [[], [], []]
        #: Only signs that the table taught count, so that there are few classes.
        self.taught = {name[1:] for name in model.weights}
        self.forms = Memory(lambda form: self._class(tuple(s for s in word_signs(form) if s in self.taught)))
        self.words = Memory(lambda word: self.forms[word_form(word)])
        t = self.t
        #: What transitions can make up for at most when a label other than "outside" is taken at one word.
        self.gain = np.array([(t[:, y] - t[:, 0]).max() + (t[y] - t[0]).max() for y in range(1, k)])
        self.edge = self._class(("edge",))

    def _class(self, signs: tuple[str, ...]) -> int:
        got = self.classes.get(signs)
        if got is None:
            got = self.classes[signs] = len(self.classes)
            zero = np.zeros(len(LABELS))
            for rows, place in zip(self.rows, "0-+", strict=True):
                rows.append(sum((self.model.weights.get(place + s, zero) for s in signs), zero))
        return got

    def decode(self, texts: list[list[str]]) -> list[list[tuple[int, int, int]]]:
        """For each list of words: (label, first word, last word) of what isn't outside."""
        ids, starts = [self.edge], []
        for words in texts:
            starts.append(len(ids))
            ids += map(self.words.__getitem__, words)
            ids.append(self.edge)
        c = np.array(ids)
        own, prev, nxt = (np.array(r) for r in self.rows)
        # emissions by the classes of a word and its neighbours; few of these threes occur (edges are outside, the first and last too)
        k = len(own)
        three, which = np.unique((c[:-2] * k + c[1:-1]) * k + c[2:], return_inverse=True)
        emission = own[three // k % k] + prev[three // k // k] + nxt[three % k]
        sure = ((emission[:, :1] - emission[:, 1:]) > self.gain).all(1)[which] | (c[1:-1] == self.edge)
        labels = np.zeros(len(c), np.int64)
        open_ = np.flatnonzero(~sure) + 1
        if len(open_):
            first = open_[np.diff(open_, prepend=-2) > 1]
            last = open_[np.diff(open_, append=len(c) + 1) > 1]
            order = np.argsort(first - last, kind="stable")
            first, n = first[order], (last - first + 1)[order]
            score = emission[which[first - 1]] + self.t[0]
            back: list[np.ndarray] = []
            for i in range(1, int(n[0])):
                live = int(np.searchsorted(-n, -i, "left"))  # stretches of more than i words
                way = score[:live, :, None] + self.t[None]
                back.append(way.argmax(1))
                score[:live] = way.max(1) + emission[which[first[:live] + i - 1]]
            best = (score + self.t[:, 0]).argmax(1)
            for i in range(int(n[0]) - 1, -1, -1):
                live = int(np.searchsorted(-n, -i, "left"))
                labels[first[:live] + i] = best[:live]
                if i:
                    best[:live] = back[i - 1][np.arange(live), best[:live]]
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        hot = np.flatnonzero(labels)
        if len(hot):
            text = np.searchsorted(starts, hot, "right") - 1
            for at, k, x in zip(hot.tolist(), labels[hot].tolist(), text.tolist(), strict=True):
                i, own_ = at - starts[x], found[x]
                if own_ and own_[-1][0] == k and own_[-1][2] == i - 1 and k == 1:
                    own_[-1] = (k, own_[-1][1], i)
                else:
                    own_.append((k, i, i))
        return found


_TRIM = "\"'`,;:!?#*$%&|<>[]{}=."


def field_spans(text: str, labels: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """Code point spans of labelled words, without quotes and marks at their ends."""
    if not labels:
        return []
    places = [m.span() for m in _TOKEN.finditer(text)]
    out = []
    for k, a, b in labels:
        start, end = places[a][0], places[b][1]
        piece = text[start:end]
        if k == 2 and "=" in piece.rstrip(_TRIM):
            start += piece.rstrip(_TRIM).rindex("=") + 1
        while start < end and text[start] in _TRIM:
            start += 1
        while end > start and text[end - 1] in _TRIM:
            end -= 1
        if end > start:
            out.append((LABELS[k], start, end))
    return out


def find_all(texts: list[str], decoder: Decoder) -> Iterator[tuple[list[list[tuple[int, int]]], list[tuple[str, int, int]]]]:
    """(base spans by kind, spans that the field adds) of each text."""
    at = 0
    while at < len(texts):
        words, n, end = [], 0, at
        while end < len(texts) and (n < BATCH_WORDS or end == at):
            words.append(_split(texts[end]))
            n += len(words[-1])
            end += 1
        for text, labels in zip(texts[at:end], decoder.decode(words), strict=True):
            base = base_spans(text)
            taken = [s for spans in base for s in spans]
            yield base, [s for s in field_spans(text, labels) if all(s[2] <= a or b <= s[1] for a, b in taken)]
        at = end


def _split(text: str) -> list[str]:
    """Words between blanks as the patterns know them (str.split() knows more blanks)."""
    return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()] if not text.isascii() else (text.split() if not _ODD.search(text) else _TOKEN.findall(text))


_ODD = re.compile(r"[\x1c-\x1f]")


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def pii(docs: DataFrame, *, text: str = "text", redact: bool = False) -> DataFrame:
    """row (all columns of docs), found: struct(n_email, n_ip, n_card, n_phone, n_added, base_sha256, spans, redacted)."""
    model = Field.fit(labelled_table())

    def found_in(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(model)
        for texts in batches:
            rows = []
            own = texts.tolist()
            for t, (base, added) in zip(own, find_all(own, decoder), strict=True):
                plain = ",".join(f"{k}:{a}:{b}" for k, spans in zip(KINDS, base, strict=True) for a, b in spans)
                more = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(added, key=lambda s: (LABELS.index(s[0]), s[1])))
                every = [(k, a, b) for k, spans in zip(KINDS, base, strict=True) for a, b in spans] + added
                rows.append((*map(len, base), len(added), hashlib.sha256(plain.encode()).hexdigest(), ",".join(x for x in (plain, more) if x), redacted(t, every) if redact and every else None))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "n_added", "base_sha256", "spans", "redacted"])

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string, redacted string")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return lean(found_in)(batches)

    return docs.select(F.struct("*").alias("row"), search(text_of(text)).alias("found"))
