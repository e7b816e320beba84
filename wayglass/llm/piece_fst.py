"""SentencePiece encoding and decoding as shortest paths in a weighted finite-state transducer.

Three machines are compiled from a model file and composed lazily with each input:

* the normaliser: escapes blanks as U+2581 and adds the dummy prefix, as the model says (identity otherwise);
* the piece lexicon: a trie whose paths spell pieces, with an arc for each byte of a character that no piece spells (byte fallback);
* an acceptor over pairs of neighbouring pieces: weight 0 where merging the two pieces' characters gives these two pieces
  again, infinity where it doesn't.

The models here are merge-ranked, not unigram: their segmentation is not the one with the best sum of scores. The
pair acceptor is what makes the tropical shortest path right for them: a sequence of pieces is the result of the merges if and
only if each neighbouring pair is, so that one path of finite weight is left.

Defined results: null and empty texts have no ids; U+2581 in a text reads back as a space, as in the format itself;
repeated rows, ties and other columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import lean, text_of

ESCAPED = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Words that a worker remembers before it starts anew: bounds its memory, changes no result.
CACHE = 1_000_000
INFINITY = float("inf")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, data[at : at + n]
            at += n


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    dummy_prefix: bool = True

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        model = cls()
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                model.pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, bytes(4)))[0], own.get(3, NORMAL)))
            elif number == 3:
                norm = dict(_fields(value))
                if norm.get(2) or norm.get(4, 1):
                    raise ValueError("only models with the identity normaliser that keep all blanks are supported")
                model.dummy_prefix = bool(norm.get(3, 1))
        return model


class PieceTransducer:
    def __init__(self, model: PieceModel):
        self.model = model
        self.ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind == NORMAL}
        self.score = [s for _, s, _ in model.pieces]
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(model.pieces) if kind == BYTE}
        self.trie: dict = {}
        joined = set()
        for p, i in self.ids.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = i
            if len(p) > 1:
                joined.update(p)
                if ESCAPED in p.lstrip(ESCAPED):
                    raise ValueError("a piece holds a blank after a character: words can't be cut apart")
        self.line_feed_alone = "\n" not in joined
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}
        self.out = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind != NORMAL else p.replace(ESCAPED, " ").encode() for p, _, kind in model.pieces]

    def merged(self, text: str) -> list[str]:
        """What merging the best-ranked neighbours, leftmost first, makes of the characters of a short text."""
        parts = list(text)
        while len(parts) > 1:
            best, at = -float("inf"), -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and self.score[i] > best:
                    best, at = self.score[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: int, b: int) -> bool:
        """The pair acceptor: weight 0 (True) or infinity."""
        key = (a, b)
        known = self.pairs.get(key)
        if known is None:
            left, right = self.model.pieces[a][0], self.model.pieces[b][0]
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(left + right) == [left, right]
        return known

    def shortest(self, text: str) -> list[int]:
        """Ids on the shortest path through the composition with an escaped text.

        One state a place is enough: the pieces of a prefix are unique, so only one last piece can have a finite weight there.
        """
        n, trie, pairs, fits, single = len(text), self.trie, self.pairs, self.fits, self.ids
        weight: list[float] = [INFINITY] * (n + 1)
        last, before = [-1] * (n + 1), [0] * (n + 1)
        weight[0] = 0
        for i in range(n):
            cost = weight[i]
            if cost == INFINITY:
                continue
            node, j, left = trie, i, last[i]
            while j < n and (node := node.get(text[j])) is not None:
                j += 1
                piece = node.get("")
                if piece is None or weight[j] <= cost:
                    continue
                if left >= 0:
                    ok = pairs.get((left, piece))
                    if ok is None:
                        ok = fits(left, piece)
                    if not ok:
                        continue
                weight[j], last[j], before[j] = cost, piece, i
            if text[i] not in single and cost + 1 < weight[i + 1]:  # no piece spells this character alone: its bytes, at a weight
                weight[i + 1], last[i + 1], before[i + 1] = cost + 1, -1, i
        ids, at = [], n
        while at:
            i = before[at]
            if last[at] >= 0:
                ids.append(last[at])
            else:
                ids += [self.byte_ids[b] for b in reversed(text[i:at].encode("utf-8", "surrogatepass"))]
            at = i
        ids.reverse()
        return ids

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            if len(self.words) >= CACHE:
                self.words.clear()
            ids = self.words[word] = np.array(self.shortest(word), "<u4").tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers. A text is cut before each first blank of a run and around line feeds, where no piece crosses."""
        if not text:
            return b""
        text = text.replace(ESCAPED, " ")
        if self.model.dummy_prefix:
            text = " " + text
        lines = text.split("\n") if self.line_feed_alone else [text]
        feed = self._word("\n") if len(lines) > 1 else b""
        word, out = self._word, []
        for k, line in enumerate(lines):
            if k:
                out.append(feed)
            run = ""
            first, *rest = line.split(" ")
            if first:
                out.append(word(first))
            for w in rest:
                if w:
                    out.append(word(run + ESCAPED + w))
                    run = ""
                else:
                    run += ESCAPED
            if run:
                out.append(word(run))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        out = self.out
        raw = b"".join([out[i] for i in np.frombuffer(ids, "<u4").tolist()])
        if self.model.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


def piece_codes(docs: DataFrame, model_file: str, *, text: str = "text", doc_id: str = "doc_id", ids: bool = True) -> DataFrame:
    """doc_id, ids (bytes; only if asked for), n_ids, ids_crc32, decoded_sha256, round_trip."""
    import hashlib

    own = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("t"))
    with open(model_file, "rb") as f:
        model = f.read()
    kept = own.sparkSession.sparkContext.broadcast(model)  # half a megabyte, whatever the input

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fst = PieceTransducer(PieceModel.parse(kept.value))
        for b in batches:
            codes = [fst.encode(t) for t in b["t"]]
            back = [fst.decode(c) for c in codes]
            out = {"doc_id": b["doc_id"]}
            if ids:
                out["ids"] = codes
            yield pd.DataFrame(
                out
                | {
                    "n_ids": [len(c) // 4 for c in codes],
                    "ids_crc32": [zlib.crc32(c) for c in codes],
                    "decoded_sha256": [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in back],
                    "round_trip": [x == t for x, t in zip(back, b["t"], strict=True)],
                }
            )

    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInPandas(lean(run), f"doc_id {kind}, {'ids binary, ' if ids else ''}n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
