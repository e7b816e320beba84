"""N-gram Jaccard join with signature trees.

A document's set holds the hashes of its n-word shingles. Documents with equal sets are one class; what follows works on one
representative of each class. Two sets A and B with |A & B| >= t |A | B| differ in at most
D = (1 - t) / (1 + t) * (|A| + |B|) elements. So if the universe is dealt into D + 1 parts by hash, both sets have
the same elements in one part at least (no link is lost). Each set sends a key for each part, not the set itself:

0. Frequent elements (of passages that many documents share) are dealt to no part: they are the same for all sets, so the parts of the
   others still suffice, and sets that have little but such a passage in common don't meet. Which elements count as
   frequent changes no result; they are counted in the pass that makes the table of sets, and at most `frequent_most` are sent to the tasks.
1. Keys: (size band, part, digest of the part's elements). Keys that repeat within a task are combined there; the
   shuffle by key then sees each key once a task at most, so a hot group of copies doesn't land in one task.
   Keys are by far the most rows of the join: they travel sorted, a bucket of keys to a row, in 11 bytes each.
   Equal keys give star edges to the smallest document of the key, not pairs, and each task thins its edges to a forest.
2. Components of these candidate edges are groups that hold every possible link within them.
3. Each group's sets are joined exactly by signature trees: nodes hold the OR of their documents' bitmaps and the range of their sizes; two
   trees are traversed together, and a pair of nodes is left when the largest possible overlap, from what bits one has and the other
   lacks, is too small, or when all documents below it are linked already. Groups over `block` documents, or of very many elements, are cut into
   blocks, and each pair of blocks is a task of its own.
4. Verified links give the final components.

Set elements are 64-bit hashes of shingles: two different shingles of the two sets of a pair are taken for equal with a chance under
|A| |B| / 2^64, 10^-11 for sets of 10,000.

Defined results: null, empty and blank texts have no shingles, are linked with nothing and are components of their own; a text of
fewer than n words is one shingle of all its words; rows of one doc_id are one document, whose texts' links all
count for it; rows whose doc_id is null are ignored by the join and returned with a null component; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import forget, lean, release, text_of, written

CACHE = 150_000
BAND_RATIO = 1.2


@dataclass(frozen=True)
class JaccardRules:
    """Linked when 100 * overlap >= percent * union."""

    n: int = 3
    percent: int = 90
    #: Documents of a group that one task joins at once.
    block: int = 1000
    leaf: int = 8
    #: Elements are frequent if so many sets of a task, and this share of them, hold them; so many of them at most are sent to the tasks.
    frequent_least: int = 4
    frequent_share: float = 0.001
    frequent_most: int = 100_000


class Shingler:
    def __init__(self, n: int):
        self.n, self.words = n, {}

    def _hash(self, word: bytes) -> int:
        if len(self.words) >= CACHE:
            self.words.clear()
        h = self.words[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return h

    def set_of(self, text: str) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the shingles. bytes.split() parts at exactly the blanks of the contract."""
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known, add = self.words.get, self._hash
        h = np.array([known(w) or add(w) for w in words], np.uint64)
        k = min(self.n, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
        return np.unique(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def differ_most(total: int, percent: int) -> int:
    """Most elements in which two linked sets of `total` elements together can differ."""
    return (100 - percent) * total // (100 + percent)


def bands(size: int, percent: int) -> list[tuple[int, int]]:
    """(band, parts) of a set: its own band, and the next one if a larger partner can lie there."""
    top = 100 * size // percent
    first, last = band_of(size), band_of(top)
    return [(b, differ_most(2 * band_end(b), percent) + 1) for b in range(first, last + 1)]


_ENDS: list[int] = [0]


def band_end(b: int) -> int:
    """Largest size in band b."""
    while len(_ENDS) <= b + 1:
        _ENDS.append(max(_ENDS[-1] + 1, int(_ENDS[-1] * BAND_RATIO)))
    return _ENDS[b + 1]


def band_of(size: int) -> int:
    band_end(0)
    while _ENDS[-1] < size:
        band_end(len(_ENDS) - 1)
    return int(np.searchsorted(_ENDS, size, "left")) - 1


def part_keys(s: np.ndarray, percent: int, frequent: np.ndarray | None = None) -> np.ndarray:
    """64-bit keys of the largest parts in each band: as many as the pigeonhole needs, and those of equal size.

    Two linked sets differ in fewer parts than that, so among their equal parts there is one that is large enough in both. Where parts hold
    few elements, spare parts let the smallest go: parts without elements are equal in unlike sets, and would join them all into one group.
    frequent: sorted elements that are dealt to no part.
    """
    out = []
    rare = s
    if frequent is not None and len(frequent):
        rare = s[frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] != s]
    deal, weight = mixed(rare ^ np.uint64(0x5851F42D4C957F2D)), mixed(rare)
    for band, least in bands(len(s), percent):
        parts = least + least // 4
        part = (deal % np.uint64(parts)).astype(np.int64)
        sums = np.zeros(parts, np.uint64)
        np.add.at(sums, part, weight)
        tag = np.arange(parts, dtype=np.uint64) + (np.uint64(band) << np.uint64(32))
        n = np.bincount(part, minlength=parts)
        out.append(mixed(mixed(tag) ^ sums)[n >= np.sort(n)[parts - least]])
    return np.concatenate(out)


# ------------------------------------------------------------------------------------------------ the trees


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up[b] = a
        return True


@dataclass
class Node:
    #: OR of the bitmaps below, range of the sizes, and the most elements of a document that share a bit with another of its elements.
    bits: int
    smallest: int
    largest: int
    spare: int
    docs: list[int]
    below: list[Node]


def bitmap(s: np.ndarray, width: int) -> int:
    flags = np.zeros(width, np.uint8)
    flags[(s % np.uint64(width)).astype(np.int64)] = 1
    return int.from_bytes(np.packbits(flags).tobytes(), "big")


def build(order: list[int], sizes: list[int], maps: list[int], leaf: int) -> Node:
    """A tree over documents in the order given."""
    if len(order) <= leaf:
        bits = 0
        for d in order:
            bits |= maps[d]
        own = [sizes[d] for d in order]
        return Node(bits, min(own), max(own), max(sizes[d] - maps[d].bit_count() for d in order), order, [])
    step = max(leaf, -(-len(order) // 4))
    below = [build(order[i : i + step], sizes, maps, leaf) for i in range(0, len(order), step)]
    bits = 0
    for x in below:
        bits |= x.bits
    return Node(bits, min(x.smallest for x in below), max(x.largest for x in below), max(x.spare for x in below), order, below)


class TreeJoin:
    """Links within one list of sets, or between its first `split` sets and the others. Sets of equal label count as linked already."""

    def __init__(self, sets: list[np.ndarray], rules: JaccardRules, labels: list[int] | None = None, split: int | None = None):
        self.sets, self.rules, self.split = sets, rules, split
        self.sizes = [len(s) for s in sets]
        width = 64
        while width < 2 * max(self.sizes, default=1):
            width *= 2
        self.maps = [bitmap(s, width) for s in sets]
        self.union, self.links = Union(len(sets)), []
        first: dict[int, int] = {}
        for d, label in enumerate(labels or []):
            self.union.join(first.setdefault(label, d), d)

    def run(self) -> list[tuple[int, int]]:
        """Links that, with the labels, span everything that is linked."""
        # by size, then smallest hash: near copies often share it and come to stand in one leaf
        order = sorted((d for d in range(len(self.sets)) if self.sizes[d]), key=lambda d: (self.sizes[d], int(self.sets[d][0]), d))
        parts = [order] if self.split is None else [[d for d in order if d < self.split], [d for d in order if d >= self.split]]
        if all(parts):
            roots = [build(p, self.sizes, self.maps, self.rules.leaf) for p in parts]
            self.visit(roots[0], roots[-1])
        return self.links

    def enough(self, overlap: int, a: int, b: int) -> bool:
        return 100 * overlap >= self.rules.percent * (a + b - overlap)

    def possible(self, x: Node, y: Node) -> bool:
        """Can a document below x be linked with one below y, by their sizes and by the bits that they can share?"""
        low, high = (x, y) if x.largest <= y.largest else (y, x)
        if 100 * low.largest < self.rules.percent * high.smallest:
            return False
        most = min((x.bits & y.bits).bit_count() + min(x.spare, y.spare), low.largest)
        return self.enough(most, x.smallest, y.smallest)

    def linked(self, x: Node, y: Node) -> bool:
        """Is everything below the two nodes one component already?"""
        find = self.union.find
        root = find(x.docs[0])
        return all(find(d) == root for d in x.docs) and all(find(d) == root for d in y.docs)

    def visit(self, x: Node, y: Node) -> None:
        stack = [(x, y)]
        while stack:
            x, y = stack.pop()
            if not self.possible(x, y) or self.linked(x, y):
                continue
            if not x.below and not y.below:
                self.leaves(x, y)
            elif x is y:
                # pairs of one node with itself come first: what they link spares the others
                stack += [(a, b) for i, a in enumerate(x.below) for b in x.below[i + 1 :]] + [(a, a) for a in x.below]
            elif x.below and (not y.below or len(x.docs) >= len(y.docs)):
                stack += [(a, y) for a in x.below]
            else:
                stack += [(x, b) for b in y.below]

    def leaves(self, x: Node, y: Node) -> None:
        for i, a in enumerate(x.docs):
            for b in x.docs[i + 1 :] if x is y else y.docs:
                na, nb = self.sizes[a], self.sizes[b]
                if 100 * min(na, nb) < self.rules.percent * max(na, nb) or self.union.find(a) == self.union.find(b):
                    continue
                # each bit of one that the other lacks stands for an element that is not shared
                most = min(na - (self.maps[a] & ~self.maps[b]).bit_count(), nb - (self.maps[b] & ~self.maps[a]).bit_count())
                if self.enough(most, na, nb) and self.enough(len(np.intersect1d(self.sets[a], self.sets[b], assume_unique=True)), na, nb):
                    self.union.join(a, b)
                    self.links.append((a, b))


# ------------------------------------------------------------------------------------------------ the distributed join

#: Elements that a task counts at once, keys that it combines at once, and elements of sets in one block: bounds of memory.
SET_ELEMENTS = 1_000_000
KEY_ROWS = 600_000
BLOCK_ELEMENTS = 2_000_000
#: Buckets of keys at least, elements of sets for each bucket beyond that, and bytes of a key (beside its bucket) and of a class in a bucket. Keys or
#: classes that are taken for equal make two candidates of one group; the join of the group decides.
BUCKETS, BUCKET_ELEMENTS = 4096, 300_000
KEY_BYTES, CLASS_BYTES = 6, 5


def set_table(docs: DataFrame, rules: JaccardRules, *, text: str, doc_id: str) -> DataFrame:
    """id, th (hash of the text), n_shingles, digest (of the set), cls (its first bytes); rows with `element`, `held` are counts of a task's frequent elements."""
    own = docs.select(F.col(doc_id).alias("id"), text_of(text).alias("t")).withColumn("th", F.xxhash64("t"))

    def frequent(sets: list[np.ndarray]) -> pd.DataFrame:
        values, held = np.unique(np.concatenate(sets), return_counts=True)
        often = held >= max(rules.frequent_least, rules.frequent_share * len(sets))
        return pd.DataFrame({"id": None, "th": None, "n_shingles": None, "digest": None, "cls": None, "element": values[often].view(np.int64), "held": held[often]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(rules.n)
        seen: set[bytes] = set()
        sets: list[np.ndarray] = []
        elements = 0
        for b in batches:
            n, digests, classes = [], [], []
            for t in b["t"]:
                s = shingler.set_of(t)
                d = blake2b(s.tobytes(), digest_size=16).digest()
                n.append(len(s))
                digests.append(d)
                classes.append(class_of(d))
                if len(s) and d not in seen:
                    if len(seen) >= CACHE:
                        seen.clear()
                    seen.add(d)
                    sets.append(s)
                    elements += len(s)
                    if elements >= SET_ELEMENTS:
                        yield frequent(sets)
                        sets, elements = [], 0
            yield pd.DataFrame({"id": b["id"], "th": b["th"], "n_shingles": n, "digest": digests, "cls": classes, "element": None, "held": None})
        if sets:
            yield frequent(sets)

    return own.mapInPandas(lean(run), f"id {own.schema['id'].dataType.simpleString()}, th long, n_shingles long, digest binary, cls long, element long, held long")


def frequent_elements(table: DataFrame, rules: JaccardRules) -> np.ndarray:
    """The elements that most sets hold, frequent_most at most, sorted."""
    counts = table.filter("element is not null").groupBy("element").agg(F.sum("held").alias("held"))
    rows = counts.orderBy(F.desc("held"), "element").limit(rules.frequent_most).select("element").toPandas()
    return np.sort(rows["element"].to_numpy(np.int64).view(np.uint64))


def class_of(digest: bytes) -> int:
    return int.from_bytes(digest[:CLASS_BYTES], "little")


def packed(keys: np.ndarray, classes: np.ndarray, buckets: int) -> pd.DataFrame:
    """bucket, keys: for each bucket the lower bytes of its keys with their classes. keys: sorted, unsigned."""
    rows = np.concatenate([np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :n] for x, n in ((keys, KEY_BYTES), (classes, CLASS_BYTES))], axis=1)
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    head = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    ends = np.r_[head[1:], len(keys)]
    return pd.DataFrame({"bucket": bucket[head], "keys": [rows[i:j].tobytes() for i, j in zip(head.tolist(), ends.tolist(), strict=True)]})


def unpacked(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and classes of a bucket's rows, in no order."""
    rows = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, KEY_BYTES + CLASS_BYTES)
    wide = np.zeros((2, len(rows), 8), np.uint8)
    wide[0, :, :KEY_BYTES], wide[1, :, :CLASS_BYTES] = rows[:, :KEY_BYTES], rows[:, KEY_BYTES:]
    keys, classes = wide.view("<i8")[:, :, 0]
    return keys, classes


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links as keep together what the links a-b keep together."""
    names, places = np.unique(np.r_[a, b], return_inverse=True)
    n = len(a)
    union = Union(len(names))
    kept = [k for k, (x, y) in enumerate(zip(places[:n].tolist(), places[n:].tolist(), strict=True)) if union.join(x, y)]
    return a[kept], b[kept]


def candidate_links(docs: DataFrame, rules: JaccardRules, frequent: np.ndarray | None = None, *, text: str, buckets: int = BUCKETS) -> DataFrame:
    """a, b: classes that share a key, as stars around each key's smallest class."""

    def starred(k: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each key and its smallest class; links of the other classes to it."""
        order = np.lexsort((c, k))
        k, c = k[order], c[order]
        head = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        lowest = np.repeat(c[head], np.diff(np.r_[head, len(k)]))
        link = c != lowest
        return k[head], c[head], np.stack([c[link], lowest[link]], 1)

    def combined(keys: list[np.ndarray], classes: list[tuple[int, int]]) -> Iterator[pd.DataFrame]:
        k, c, links = starred(np.concatenate(keys), np.repeat(np.array([x for x, _ in classes], np.int64), [n for _, n in classes]))
        yield packed(k, c, buckets).assign(links=None)
        if len(links):
            a, b = forest(*np.unique(links, axis=0).T)
            yield pd.DataFrame({"bucket": [int(a[0]) % buckets], "keys": None, "links": [np.stack([a, b], 1).astype("<i8").tobytes()]})

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a row has keys of one bucket, or links that were found within the task
        shingler, keys, classes, held = Shingler(rules.n), [], [], 0
        seen: set[bytes] = set()
        for batch in batches:
            for t in batch["t"]:
                s = shingler.set_of(t)
                if not len(s):
                    continue
                d = blake2b(s.tobytes(), digest_size=16).digest()
                if d in seen:  # a copy: its class has sent its keys
                    continue
                if len(seen) >= CACHE:
                    seen.clear()
                seen.add(d)
                own = part_keys(s, rules.percent, frequent)
                keys.append(own)
                classes.append((class_of(d), len(own)))
                held += len(own)
                if held >= KEY_ROWS:
                    yield from combined(keys, classes)
                    keys, classes, held = [], [], 0
        if held:
            yield from combined(keys, classes)

    def stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come sorted by bucket: one bucket's keys are looked at together
        now, blobs = None, []
        found, held = [], 0
        for batch in batches:
            found += [np.frombuffer(x, "<i8").reshape(-1, 2) for x in batch["links"] if x is not None]
            for bucket, blob in zip(batch["bucket"].tolist(), batch["keys"], strict=True):
                if bucket != now and blobs:
                    found.append(starred(*unpacked(blobs))[2])
                    held += len(found[-1])
                    blobs = []
                now = bucket
                if blob is not None:
                    blobs.append(blob)
            if held >= KEY_ROWS // 4:
                yield thinned(found)
                found, held = [], 0
        if blobs:
            found.append(starred(*unpacked(blobs))[2])
        if found:
            yield thinned(found)

    def thinned(found: list[np.ndarray]) -> pd.DataFrame:
        pairs = np.unique(np.concatenate(found), axis=0)
        a, b = forest(pairs[:, 0], pairs[:, 1])
        return pd.DataFrame({"a": a, "b": b})

    keyed = docs.select(text_of(text).alias("t")).mapInPandas(lean(emit), "bucket long, keys binary, links binary")
    return keyed.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(lean(stars), "a long, b long")


def _tree_links(rules: JaccardRules, kind: str):
    def join(group: pd.DataFrame) -> pd.DataFrame:
        shingler = Shingler(rules.n)
        group = group.drop_duplicates(["id", "th", "left"]).sort_values(["left", "id", "th"], ascending=[False, True, True], kind="stable")
        sets = [shingler.set_of(t) for t in group["t"]]
        split = None if group["same"].all() else int(group["left"].sum())
        ids = group["id"].tolist()
        labels = group["label"].tolist()
        found = TreeJoin(sets, rules, labels, split).run()
        return pd.DataFrame({"a": pd.Series([ids[i] for i, _ in found], dtype=group["id"].dtype), "b": pd.Series([ids[j] for _, j in found], dtype=group["id"].dtype)})

    return join, f"a {kind}, b {kind}"


def jaccard_components(docs: DataFrame, rules: JaccardRules = JaccardRules(), *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """id, th, n_shingles, component_id: one row for each input row."""
    kind = docs.schema[doc_id].dataType.simpleString()
    table = written(set_table(docs, rules, text=text, doc_id=doc_id), "sets")
    frequent = frequent_elements(table, rules)
    table = table.filter("element is null").drop("element", "held")
    elements = table.agg(F.sum("n_shingles")).first()[0] or 0
    groups = components(candidate_links(docs, rules, frequent, text=text, buckets=max(BUCKETS, elements // BUCKET_ELEMENTS)))
    groups = groups.select(F.col("node").alias("cls"), F.col("label").alias("group"))
    sets = table.filter((F.col("n_shingles") > 0) & F.col("id").isNotNull())
    # one document stands for all with its set
    reps = sets.groupBy("digest", "cls", "n_shingles").agg(F.min(F.struct("id", "th")).alias("first"))
    reps = written(reps.select("digest", "cls", "n_shingles", "first.id", "first.th"), "reps")
    members = written(reps.join(groups, "cls").select("id", "th", "n_shingles", "group"), "members")
    blocks = members.groupBy("group").agg(F.count(F.lit(1)).alias("m"), F.sum("n_shingles").alias("elements"), F.min(F.struct("id", "th")).alias("pivot"))
    blocks = blocks.withColumn("blocks", F.greatest(F.ceil(F.col("m") / rules.block), F.ceil(F.col("elements") / BLOCK_ELEMENTS)).cast("int")).filter("m > 1")
    # all texts are shuffled once: what follows reads those of groups alone, with their blocks
    grouped = members.join(blocks, "group")
    own = docs.select(F.col(doc_id).alias("id"), text_of(text).alias("t")).withColumn("th", F.xxhash64("t"))
    own = written(_texts(own, grouped.select("id", "th", "group", "blocks", "pivot")), "texts")
    release(docs.sparkSession)
    join, schema = _tree_links(rules, kind)
    block_of = F.pmod(F.xxhash64("id", "th"), F.col("blocks")).cast("int")
    # first pass: each document in one block, the group's pivot in all of them
    is_pivot = F.struct("id", "th") == F.col("pivot")
    rows = own.withColumn("i", F.explode(F.when(is_pivot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(block_of))))
    rows = rows.select("id", "th", "t", "group", "i", F.lit(0).alias("j"), F.lit(False).alias("left"), F.lit(True).alias("same"), F.lit(None).cast("long").alias("label"))
    links = written(rows.groupBy("group", "i", "j").applyInPandas(lambda g: join(g.assign(label=range(len(g)))), schema), "pairs")
    release(docs.sparkSession)
    labels = components(links)
    # second pass: groups of several blocks that aren't one component yet
    large = grouped.filter("blocks > 1").join(labels.withColumnRenamed("node", "id"), "id", "left")
    large = large.withColumn("label", F.coalesce("label", "id"))
    many = large.groupBy("group", "label").agg(F.count(F.lit(1)).alias("k"), F.sum("n_shingles").alias("e"))
    top = many.groupBy("group").agg(F.max(F.struct("k", "label", "e")).alias("top"), F.count(F.lit(1)).alias("parts"), F.sum("k").alias("all"), F.sum("e").alias("all_e")).filter("parts > 1")
    if not top.isEmpty():
        more = _between_blocks(large.join(top, "group"), own.select("id", "th", "t"), rules, join, schema)
        labels = components(links.unionByName(written(more, "pairs")))
    for done in (own, members, links):
        forget(done)
    release(docs.sparkSession)
    named = reps.join(labels.withColumnRenamed("node", "id"), "id", "left").select("digest", F.coalesce("label", "id").alias("component"))
    out = table.join(named, "digest", "left")
    component = F.when(F.col("id").isNull(), None).when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component"))
    return out.select("id", "th", "n_shingles", component.alias("component_id"))


def _texts(own: DataFrame, rows: DataFrame) -> DataFrame:
    # the members grow with the corpus: they are shuffled at every size, never broadcast
    return own.join(rows.hint("merge"), ["id", "th"])


def _between_blocks(large: DataFrame, own: DataFrame, rules: JaccardRules, join, schema: str) -> DataFrame:
    """Links between a group's largest component and the rest of it, and within the rest, block by block."""
    rest = F.col("label") != F.col("top.label")
    hash_of = F.xxhash64("id", "th")
    blocks_of = lambda k, e: F.greatest(F.ceil(k / rules.block), F.ceil(e / BLOCK_ELEMENTS)).cast("int")
    rest_blocks = blocks_of(F.col("all") - F.col("top.k"), F.col("all_e") - F.col("top.e"))
    top_blocks = blocks_of(F.col("top.k"), F.col("top.e"))
    mine = F.when(rest, F.pmod(hash_of, rest_blocks)).otherwise(F.pmod(hash_of, top_blocks)).cast("int")
    base = large.withColumn("rest", rest).withColumn("rb", rest_blocks).withColumn("tb", top_blocks).withColumn("mine", mine)
    keep = ["id", "th", "group", "label"]
    # tasks (i, j) with j >= 0: block i of the rest with block j of the largest; (i, -1 - j): blocks i <= j of the rest
    across = base.withColumn("k", F.explode(F.sequence(F.lit(0), F.when(F.col("rest"), F.col("tb")).otherwise(F.col("rb")) - 1)))
    across = across.select(*keep, F.when(F.col("rest"), F.col("mine")).otherwise(F.col("k")).alias("i"), F.when(F.col("rest"), F.col("k")).otherwise(F.col("mine")).alias("j"), F.col("rest").alias("left"), F.lit(False).alias("same"))
    within = base.filter("rest").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("rb") - 1)))
    within = within.select(*keep, F.least("mine", "k").alias("i"), (-1 - F.greatest("mine", "k")).alias("j"), (F.col("mine") <= F.col("k")).alias("left"), (F.col("mine") == F.col("k")).alias("same"))
    rows = across.unionByName(within)
    return _texts(own, rows).groupBy("group", "i", "j").applyInPandas(join, schema)
