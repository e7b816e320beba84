"""Suffix-array dedup over bytes by bucket-pointer refinement.

Removed is each byte that a string of `length` bytes covers which also starts anywhere else, in the same document or another.

A suffix array over everything would hold each byte of the corpus many times. Instead each string of `length` bytes points to its
anchor, the leftmost of its q-grams with the smallest hash: equal strings have equal anchors at equal offsets, so strings need comparing only
within an anchor's bucket, and there is one anchor for about 75 bytes.

1. Anchors of all texts are grouped by hash; anchors that occur once point to no repeated string and are left.
2. Of the others the context travels: the bytes of all strings that point to the anchor. Contexts that repeat
   within a task are combined there: both are finished, and the first stands for them from there on.
3. Within the buckets the strings are told apart by refinement: buckets of 8-byte grams are refined to 16, 32, 64 and 128
   bytes by sorting on the pair of bucket identifiers at an offset and at the later offset half as far on, the new identifiers being
   used for the next step, until the identifiers at offsets 0 and length - 128 tell whole strings apart. Offsets whose
   bucket holds nothing else drop out. This compares the bytes themselves: no hash decides.
4. A bucket of over `bucket` contexts (an anchor in a passage that a great part of the documents hold) is first cut across tasks:
   equal contexts are dealt by their content, so that one of them stays for all and its places are finished. What is left of a bucket that is
   still over-full is refined by a longer gram: its strings are parted by their offset from the anchor, and the bytes that all
   strings of one such part have in common name the new bucket. Buckets with nothing else in them drop out, those that have
   become small are refined as in 3, the others are cut again, down to single strings.
5. The removed ranges go back to their texts.

Texts that are equal as a whole are one text here, and lose all their bytes if they are long enough and there are several.

Defined results: a null text is empty; empty texts and those shorter than `length` keep everything; each row is a document, also when
rows repeat; an empty table gives an empty result; other columns are passed through; what is kept may be cut within a
character, so it is binary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import lean, text_of, written


@dataclass(frozen=True)
class SuffixRules:
    #: 128 to 256.
    length: int = 200
    q: int = 48
    #: Contexts that are refined together at most; fuller buckets are cut by longer grams first, into parts of so many strings.
    bucket: int = 3000
    widths: tuple[int, ...] = (26, 5, 1)
    #: String starts that are looked at together in one long text, bytes of contexts that are refined together: refining takes about 100 bytes for each.
    chunk: int = 1 << 18
    block: int = 1 << 20


class Anchors:
    """Anchors of the strings of a text."""

    def __init__(self, rules: SuffixRules):
        self.rules, self.base = rules, 0x9E3779B97F4A7C15
        self._tables(1 << 14)

    def _tables(self, n: int) -> None:
        b = np.uint64(self.base)
        inverse = np.uint64(pow(self.base, -1, 1 << 64))
        self.powers = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)], dtype=np.uint64)
        self.inverse = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, inverse, np.uint64)], dtype=np.uint64)

    def of(self, data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Chunk by chunk: anchor hashes, anchor positions, first and last start of the strings that point to each."""
        r = self.rules
        starts = len(data) - r.length + 1
        for at in range(0, max(starts, 0), r.chunk):
            part = np.frombuffer(data, np.uint8, min(r.chunk, starts - at) + r.length - 1, at)
            h, pos, lo, hi = self._chunk(part)
            yield h, pos + at, lo + at, hi + at

    def _chunk(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        r, n = self.rules, len(part)
        if n > len(self.powers):
            self._tables(1 << n.bit_length())
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * self.powers[:n], out=sums[1:])
        grams = n - r.q + 1
        h = (sums[r.q :] - sums[:-r.q]) * self.inverse[:grams]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        # smallest of each `width` neighbours, the leftmost among equals: the place is in the low bits
        width = r.length - r.q + 1
        low = np.uint64((1 << 22) - 1)
        key = (h & ~low) | np.arange(grams, dtype=np.uint64)
        rows = -(-grams // width)
        grid = np.full(rows * width, ~np.uint64(0))
        grid[:grams] = key
        grid = grid.reshape(rows, width)
        left = np.minimum.accumulate(grid, axis=1).ravel()
        right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = n - r.length + 1
        at = (np.minimum(right[:windows], left[width - 1 : width - 1 + windows]) & low).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:], windows] - 1
        return h[at[first]], at[first], first, last


def refined(data: np.ndarray, ends: np.ndarray, buckets: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of the strings of `length` bytes at `starts` occur twice or more within their bucket.

    data: contexts one after another; ends: for each byte the end of its context; buckets: of each start (anchor and offset from it).
    """
    n = len(data)
    padded = np.r_[data, np.zeros(8, np.uint8)]
    grams = np.zeros(n, np.uint64)
    for k in range(8):
        grams = (grams << np.uint64(8)) | padded[k : k + n].astype(np.uint64)
    place = np.arange(n)
    live = place + 8 <= ends
    ids = np.full(n, -1, np.int64)

    def settle(at: np.ndarray, keys: np.ndarray) -> None:
        # identifiers of the buckets that hold two or more; the others drop out
        ids[:] = -1
        if len(at):
            _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
            more = counts > 1
            ids[at] = np.where(more, np.cumsum(more) - 1, -1)[inverse]

    at = np.flatnonzero(live)
    settle(at, grams[at])
    size = 8
    while size < 128:
        at = np.flatnonzero(ids >= 0)
        at = at[at + size < n]
        later = ids[at + size]
        ok = (later >= 0) & (at + 2 * size <= ends[at])
        at, later = at[ok], later[ok]
        here = ids[at]
        top = int(later.max()) + 1 if len(later) else 1
        settle(at, here * top + later)
        size *= 2
    here, later = ids[starts], ids[starts + length - 128]
    found = np.zeros(len(starts), bool)
    ok = np.flatnonzero((here >= 0) & (later >= 0))
    if len(ok):
        pair = np.stack([buckets[ok], here[ok], later[ok]], 1)
        order = np.lexsort(pair.T)
        same = (pair[order][1:] == pair[order][:-1]).all(1)
        twice = np.r_[False, same] | np.r_[same, False]
        found[ok[order[twice]]] = True
    return found


def runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(np.diff(starts) != 1)
    return starts[np.r_[0, cut + 1]], starts[np.r_[cut, len(starts) - 1]]


#: full: of an over-full bucket; key: what rows are dealt by; g: the bucket. Rows without ctx are ranges that are finished.
CONTEXTS = "full boolean, key long, g long, rel int, ctx binary, td binary, start long, stop long"
SETTLED = "g long, rel int, ctx binary, td binary, start long, stop long"


def _spread(start: int, stop: int) -> int:
    """Deals finished rows out evenly."""
    return start * 31 + stop


def _content_key(g: int, rel: int, ctx: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(ctx, digest_size=8, salt=g.to_bytes(8, "little", signed=True) + rel.to_bytes(8, "little")).digest(), "little", signed=True)


def _anchor_rows(texts: DataFrame, rules: SuffixRules) -> DataFrame:
    """h, tid, pos."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchors, seen = Anchors(rules), set()
        for b in batches:
            out: list[tuple[np.ndarray, int, np.ndarray]] = []
            for tid, t in zip(b["tid"], b["t"], strict=True):
                if tid in seen:  # a copy of a text that this task has had
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(tid)
                out += [(h, tid, pos) for h, pos, _, _ in anchors.of(t)]
            if out:
                yield pd.DataFrame({"h": np.concatenate([h for h, _, _ in out]).view(np.int64), "tid": np.repeat([t for _, t, _ in out], [len(p) for _, _, p in out]), "pos": np.concatenate([p for _, _, p in out])})

    return texts.select("tid", "t").mapInPandas(lean(run), "h long, tid long, pos long")


def _contexts(joined: DataFrame, rules: SuffixRules) -> DataFrame:
    """Contexts of the anchors at `places` and, those of over-full buckets, at `crowded`, and ranges that a task found by itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchors, seen = Anchors(rules), set()
        known: dict[tuple[int, int, bytes], tuple[bytes, int, int] | None] = {}
        held, columns = 0, ["full", "key", "g", "rel", "ctx", "td", "start", "stop"]
        for b in batches:
            rows: list[tuple] = []
            for td, t, few, many in zip(b["td"], b["t"], b["places"], b["crowded"], strict=True):
                if td in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(td)
                order = np.argsort(places := np.r_[np.asarray(few, np.int64), np.asarray(many, np.int64)], kind="stable")
                places, crowded = places[order], order >= len(few)
                done: list[list[int]] = []
                for h, pos, lo, hi in anchors.of(t):
                    at = np.minimum(np.searchsorted(places, pos), len(places) - 1)
                    for k in np.flatnonzero(places[at] == pos).tolist():
                        first, last = int(lo[k]), int(hi[k])
                        stop = last + rules.length
                        ctx = t[first:stop]
                        key = (int(h[k].view(np.int64)), int(pos[k]) - first, ctx)
                        if key in known:
                            # the same strings once more: both are removed, the first stands for them in the shuffle
                            before = known[key]
                            if before:
                                rows.append((False, _spread(*before[1:]), 0, 0, None, *before))
                                known[key] = None
                            if done and first <= done[-1][1]:
                                done[-1][1] = stop
                            else:
                                done.append([first, stop])
                            continue
                        held += len(ctx)
                        if held > 24 << 20:
                            known.clear()
                            held = len(ctx)
                        known[key] = (td, first, stop)
                        full = bool(crowded[at[k]])
                        rows.append((full, _content_key(*key) if full else key[0], *key, td, first, stop))
                rows += [(False, _spread(a, z), 0, 0, None, td, a, z) for a, z in done]
                if len(rows) > 5_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return joined.select("td", "t", "places", "crowded").mapInPandas(lean(run), CONTEXTS)


def cut_context(rel: int, ctx: bytes, width: int, length: int) -> Iterator[tuple[int, bytes, int, int]]:
    """Cut the strings of a context by their offset from the anchor, `width` offsets a part: (part, bytes that all its strings share, first, end of its bytes)."""
    n = len(ctx) - length + 1
    for part in range((rel - n + 1) // width, rel // width + 1):
        nearest, farthest = part * width, part * width + width - 1
        first, last = max(rel - farthest, 0), min(rel - nearest, n - 1)
        yield part, ctx[rel - nearest : rel - farthest + length], first, last + length


def _cut(left: DataFrame, width: int, rules: SuffixRules) -> DataFrame:
    """Contexts of buckets that are small enough as they are (n contexts), those of the others cut, in buckets of their own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["full", "key", "g", "rel", "ctx", "td", "start", "stop"]
        for b in batches:
            rows: list[tuple] = []
            for g, rel, ctx, td, start, stop, n in b.itertuples(index=False, name=None):
                if n <= rules.bucket:
                    rows.append((False, g, g, rel, ctx, td, start, stop))
                    continue
                for part, shared, first, end in cut_context(rel, ctx, width, rules.length):
                    piece, bucket = ctx[first:end], _content_key(g, part + 512, shared)
                    rows.append((True, _content_key(bucket, rel - first + 512, piece), bucket, rel - first, piece, td, start + first, start + end))
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return left.select("g", "rel", "ctx", "td", "start", "stop", "n").mapInPandas(lean(run), CONTEXTS)


def _combined(rows: pd.DataFrame) -> pd.DataFrame:
    """One of each context, and the places of those that stand at several, which are finished. rows: all that have one of their keys."""
    rows = rows.drop_duplicates(["g", "rel", "ctx", "td", "start"])
    same = rows.groupby(["g", "rel", "ctx"], sort=False)["start"].transform("size").to_numpy() > 1
    return pd.concat([rows.drop_duplicates(["g", "rel", "ctx"]), rows[same].assign(ctx=None)])[["g", "rel", "ctx", "td", "start", "stop"]]


def _refined_ranges(rows: pd.DataFrame, rules: SuffixRules) -> pd.DataFrame:
    """td, start, stop: ranges of repeated strings within whole buckets."""
    rows = rows.drop_duplicates(["key", "td", "start"])
    key = rows["key"].to_numpy(np.int64)
    group = np.cumsum(np.r_[False, key[1:] != key[:-1]])
    sizes = np.bincount(group)
    rows, group = rows[sizes[group] > 1], group[sizes[group] > 1]
    if not len(rows):
        return pd.DataFrame({"td": [], "start": [], "stop": []})
    ctx = rows["ctx"].tolist()
    lengths = np.array([len(c) for c in ctx])
    data = np.frombuffer(b"".join(ctx), np.uint8)
    first = np.cumsum(lengths) - lengths
    ends = np.repeat(first + lengths, lengths)
    n = lengths - rules.length + 1
    of = np.repeat(np.arange(len(ctx)), n)
    offset = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    bucket = group[of] * 512 + rows["rel"].to_numpy(np.int64)[of] - offset + 256
    hit = refined(data, ends, bucket, first[of] + offset, rules.length)
    of, offset = of[hit], offset[hit]
    if not len(of):
        return pd.DataFrame({"td": [], "start": [], "stop": []})
    cut = np.flatnonzero((of[1:] != of[:-1]) | (offset[1:] != offset[:-1] + 1))
    a, b = np.r_[0, cut + 1], np.r_[cut, len(of) - 1]
    begin, td = rows["start"].to_numpy(np.int64), rows["td"].to_numpy()
    return pd.DataFrame({"td": td[of[a]], "start": begin[of[a]] + offset[a], "stop": begin[of[a]] + offset[b] + rules.length})


def _settle(contexts: DataFrame, rules: SuffixRules) -> DataFrame:
    """Finished ranges (without ctx), and of the over-full buckets one of each context."""

    def finished(ranges: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": 0, "rel": 0, "ctx": None, "td": ranges["td"], "start": ranges["start"], "stop": ranges["stop"]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: list[pd.DataFrame] = []
        held, carried = 0, None
        for b in batches:
            ready = b["ctx"].isna()
            if ready.any():
                yield finished(b[ready])
                b = b[~ready]
            full = b["full"].to_numpy(bool)
            if full.any():
                own = b[full] if carried is None else pd.concat([carried, b[full]])
                last = own["key"].to_numpy() == own["key"].iloc[-1]
                carried = own[last]
                if not last.all():
                    yield _combined(own[~last])
                b = b[~full]
            if not len(b):
                continue
            key = b["key"].to_numpy(np.int64)
            sizes = np.cumsum([len(c) for c in b["ctx"]])
            at = 0
            while at < len(b):
                # up to the end of the bucket in which the block gets full
                over = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + max(rules.block - held, 1)))
                if over >= len(b) - 1:
                    break
                others = np.flatnonzero(key[over:] != key[over])
                if not len(others):
                    break
                to = int(others[0]) + over
                parts.append(b.iloc[at:to])
                yield finished(_refined_ranges(pd.concat(parts, ignore_index=True), rules))
                parts, held, at = [], 0, to
            if at < len(b):
                parts.append(b.iloc[at:])
                held += int(sizes[-1] - (sizes[at - 1] if at else 0))
        if parts:
            yield finished(_refined_ranges(pd.concat(parts, ignore_index=True), rules))
        if carried is not None:
            yield _combined(carried)

    return contexts.repartition("key").sortWithinPartitions("full", "key").mapInPandas(lean(run), SETTLED)


def repeated_ranges(texts: DataFrame, rules: SuffixRules) -> DataFrame:
    """td, starts, stops of the ranges that repeated strings cover. texts: td (digest), tid (64-bit hash), t (bytes)."""
    long_ = texts.filter(F.length("t") >= rules.length)
    anchors = _anchor_rows(long_, rules)
    mark = F.xxhash64("tid", "pos")
    often = anchors.groupBy("h").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo < hi")
    # tables on both sides of the joins: what a hot anchor, or copies of one text, bring together can then be split
    often = written(often.select("h", (F.col("n") > rules.bucket).alias("full")), "often")
    places = anchors.join(often, "h").groupBy(F.col("tid").alias("of"))
    places = written(places.agg(*[F.collect_set(F.when(F.col("full") == flag, F.col("pos"))).alias(name) for flag, name in ((False, "places"), (True, "crowded"))]), "places")
    settled = written(_settle(_contexts(long_.join(places, F.col("tid") == F.col("of")), rules), rules), "settled")
    found = [settled]
    for width in rules.widths:
        left = settled.filter("ctx is not null")
        sizes = written(left.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
        if sizes.isEmpty():
            break
        settled = written(_settle(_cut(left.join(sizes, "g"), width, rules), rules), "settled")
        found.append(settled)
    ranges = found[0].filter("ctx is null")
    for more in found[1:]:
        ranges = ranges.unionByName(more.filter("ctx is null"))
    return ranges.groupBy("td").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))


def suffix_dedup(docs: DataFrame, rules: SuffixRules = SuffixRules(), *, text: str = "text", keep: bool = True) -> DataFrame:
    """row (all columns of docs), n_bytes, n_removed, n_spans, kept (bytes, only if asked for), kept_sha256."""
    own = docs.select(F.struct("*").alias("row"), text_of(text).alias("s"))
    own = own.select("row", F.unhex(F.substring(F.sha2("s", 256), 1, 32)).alias("td"), F.xxhash64("s").alias("tid"), F.col("s").cast("binary").alias("t"))
    ranges = repeated_ranges(own.select("td", "tid", "t"), rules)
    copies = own.filter(F.length("t") >= rules.length).groupBy("td").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    gone = written(ranges.join(copies, "td", "full_outer").select(F.col("td").alias("of"), F.when(F.col("n").isNull(), F.col("ranges")).alias("ranges"), F.col("n").isNotNull().alias("whole")), "ranges")
    both = own.join(gone, F.col("td") == F.col("of"), "left").select("row", "t", "ranges", F.coalesce("whole", F.lit(False)).alias("whole"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t, ranges_, whole in zip(b["t"], b["ranges"], b["whole"], strict=True):
                spans: list[list[int]] = []
                for r in sorted((x["start"], x["stop"]) for x in ranges_) if ranges_ is not None else ([(0, len(t))] if whole else []):
                    if spans and r[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], r[1])
                    else:
                        spans.append(list(r))
                kept, at = [], 0
                for a, z in spans:
                    kept.append(t[at:a])
                    at = z
                kept.append(t[at:])
                rest = b"".join(kept)
                rows.append((len(t), len(t) - len(rest), len(spans), rest if keep else None, hashlib.sha256(rest).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    cut_of = F.pandas_udf(_cut_udf(cut), "n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    out = both.select("row", cut_of("t", "ranges", "whole").alias("c"))
    return out.select("row", "c.*") if keep else out.select("row", "c.n_bytes", "c.n_removed", "c.n_spans", "c.kept_sha256")


def _cut_udf(cut):
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        return cut(pd.DataFrame({"t": t, "ranges": r, "whole": w}) for t, r, w in batches)

    return run
