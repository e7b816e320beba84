"""Best-fit-decreasing packing of tokenised documents into windows.

Each task tokenises its documents and packs them on the spot, so no text is shuffled. A document over one window
is first cut into full windows; what is left over is packed by decreasing length into the open window with
the least capacity that still holds it, found in a segment tree indexed by remaining capacity. A task packs in blocks of a bounded number of tokens;
the windows that a block leaves less than `firm` full stay open, as pieces to be packed again with the next block, so
that only the last block of a task leaves slack.

Defined results: a null or empty text is the end token alone; repeated rows are packed as documents of their own;
an empty table gives no pieces; ties go to the earlier document; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import lean, text_of

WINDOW = 1024
#: content: "ids binary" (little-endian unsigned 32-bit ids) or "ids_crc32 long" (their unsigned CRC-32).
PIECES = "doc_id {id}, start long, length long, {content}, doc_tokens long, sequence_id long, offset long"
#: Words, and bytes of words and ids, that a tokeniser's cache holds before it starts anew: bounds a worker's memory, changes no result. Longer words aren't kept.
CACHE, CACHE_BYTES, LONGEST = 250_000, 32 << 20, 1024
BLOCK_TOKENS = 4_000_000

#: Runs of blanks whose cut depends on what follows them: all but one space, one line feed or two line feeds before a word.
_CONTEXT = re.compile(r"[^\S\n]\s|\n(?:[^\S\n]|\n(?:\s|\Z))")


class WordCache(dict):
    """ids (little-endian bytes) of a word with the space before it."""

    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.encode, self.size = encode, 0

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode(word if word[:1] == "\n" else " " + word), "<u4").tobytes()
        if len(word) > LONGEST:
            return ids
        if len(self) >= CACHE or self.size > CACHE_BYTES:
            self.clear()
            self.size = 0
        self[word] = ids
        self.size += 4 * len(word) + len(ids)
        return ids


#: Beyond these characters the rank file's pattern and the tokenizer's own aren't taken for equal, and the tokenizer decides.
_WIDE = re.compile(r"[^\x00-\u024f]")


def _ranks(path: str):
    """The same vocabulary's rank file beside the tokenizer's, if there is one, as a tiktoken.Encoding: Latin text takes it a fraction of the tokenizer's time."""
    import base64
    import os

    ranks = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks):
        return None
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def encoder(path: str) -> Callable[[str], bytes]:
    """A text's ids as bytes, equal to those of the tokenizer of `path` over the whole text; special strings in it get their own ids, as the tokenizer gives them.

    Latin texts go to the rank file whole, where there is one: in a corpus of many words that come once or twice, looking words up takes longer.
    The byte-level pre-tokeniser never joins a word with the blank after it, so other texts can be cut before each single
    space or line feed and their words looked up; texts with other runs of blanks, or with a special string, go to the tokenizer whole.
    """
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    special = re.compile("|".join(sorted(map(re.escape, (str(t) for t in tok.get_added_tokens_decoder().values())), key=len, reverse=True)) or r"(?!)")
    whole = lambda s: tok.encode(s, add_special_tokens=False).ids
    ranks = _ranks(path)
    latin = lambda s: ranks is not None and (s.isascii() or not _WIDE.search(s))
    words = WordCache(lambda s: ranks.encode_ordinary(s) if latin(s) else whole(s))
    look = words.__getitem__

    def encode(text: str) -> bytes:
        if not text:
            return b""
        if _CONTEXT.search(text) or special.search(text):
            return np.array(whole(text), "<u4").tobytes()
        if latin(text):
            return ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        first, *rest = text.replace("\n", " \n").split(" ")
        head = np.array(whole(first), "<u4").tobytes() if first else b""
        return head + b"".join(map(look, rest))

    return encode


class OpenWindows:
    """Open windows by remaining capacity, in a segment tree over the capacities 0 to size."""

    def __init__(self, size: int):
        self.leaves = 1
        while self.leaves <= size:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.stack: list[list[int]] = [[] for _ in range(self.leaves)]

    def _bump(self, at: int, by: int) -> None:
        at += self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, capacity: int, window: int) -> None:
        self.stack[capacity].append(window)
        self._bump(capacity, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Take out the window with the least capacity of `need` or more: (capacity, window)."""
        count, at = self.count, need + self.leaves
        if not count[at]:
            # climb until a right sibling holds a window, then descend to its leftmost
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at *= 2
                if not count[at]:
                    at += 1
        capacity = at - self.leaves
        self._bump(capacity, -1)
        return capacity, self.stack[capacity].pop()


def best_fit(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int], int]:
    """For pieces of at most one window each: window number and offset of each, number of windows."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    tree, n = OpenWindows(window), 0
    where, offset = [0] * len(lengths), [0] * len(lengths)
    for i in order:
        need = lengths[i]
        got = tree.tightest(need) if need < window else None
        if got is None:
            got = (window, n)
            n += 1
        room, w = got
        where[i], offset[i] = w, window - room
        if room > need:
            tree.put(room - need, w)
    return where, offset, n


def pack_task(batches: Iterator[pa.RecordBatch], encode: Callable[[str], bytes], end: int, window: int, task: int, block_tokens: int, schema: pa.Schema, digest: bool) -> Iterator[pa.RecordBatch]:
    tail = np.array([end], "<u4").tobytes()
    made = 0
    held: list[tuple] = []  # (doc_id, start, ids, doc_tokens): parts shorter than a window
    held_tokens = 0

    def rows(parts: list[tuple], seqs: list[int], offs: list[int]) -> pa.RecordBatch:
        cols = list(zip(*parts, strict=True)) if parts else [[], [], [], []]
        content = [zlib.crc32(x) for x in cols[2]] if digest else cols[2]
        arrays = [cols[0], cols[1], [len(x) // 4 for x in cols[2]], content, cols[3], [(task << 40) + s for s in seqs], offs]
        return pa.RecordBatch.from_arrays([pa.array(list(a), f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)

    def flush(last: bool) -> tuple[pa.RecordBatch, list[tuple]]:
        nonlocal made
        where, offset, n = best_fit([len(p[2]) // 4 for p in held], window)
        used = [0] * n
        for p, w in zip(held, where, strict=True):
            used[w] += len(p[2]) // 4
        done = [last or u >= window - window // 128 for u in used]
        number, k = [0] * n, 0
        for w in range(n):
            number[w] = made + k
            k += done[w]
        made += k
        out = [i for i, w in enumerate(where) if done[w]]
        return rows([held[i] for i in out], [number[where[i]] for i in out], [offset[i] for i in out]), [held[i] for i, w in enumerate(where) if not done[w]]

    for batch in batches:
        parts, seqs = [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = encode(text) + tail
            n = len(ids) // 4
            full = n // window
            for k in range(full):
                parts.append((doc, k * window, ids[4 * k * window : 4 * (k + 1) * window], n))
                seqs.append(made)
                made += 1
            if n % window:
                held.append((doc, full * window, ids[4 * full * window :], n))
                held_tokens += n % window
        if parts:
            yield rows(parts, seqs, [0] * len(parts))
        if held_tokens >= block_tokens:
            out, held = flush(False)
            held_tokens = sum(len(p[2]) // 4 for p in held)
            if held_tokens >= block_tokens // 2:  # they don't fit together any better: close them
                more, held = flush(True)
                held, held_tokens = [], 0
                yield more
            yield out
    if held:
        yield flush(True)[0]


def pack(docs: DataFrame, tokenizer: str, *, end: int = 0, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id", block_tokens: int = BLOCK_TOKENS, digest: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset. digest: ids_crc32 in place of ids."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    own = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("t"))
    ddl = PIECES.format(id=own.schema["doc_id"].dataType.simpleString(), content="ids_crc32 long" if digest else "ids binary")
    schema = to_arrow_schema(_parse_datatype_string(ddl))

    def run(batches):
        from pyspark import TaskContext

        yield from pack_task(batches, encoder(tokenizer), end, window, TaskContext.get().partitionId(), block_tokens, schema, digest)

    return own.mapInArrow(lean(run), ddl)

