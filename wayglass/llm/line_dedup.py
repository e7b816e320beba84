"""Incremental, reversible line dedup: sharded cuckoo filters backed by exact reference counts.

A line's key is the line without blanks at its ends and with A-Z lower-cased. `refs` counts for each key
the documents that hold it: a document adds one to each of its keys when it is inserted and takes it back
when it is deleted. A key that enough documents hold is frequent. Each shard of the key space has a cuckoo filter of its frequent keys,
updated by what crosses the threshold in either direction, so that deleting documents undoes their insertion.

Applying the index probes each line's hash in the filters and checks what they let through against `refs`, exactly.
The filters go to all executors only while all of them together stay under `broadcast_bytes` (checked);
beyond that every line is checked against `refs` directly, with the same result.

Defined results: a null or empty text is one empty line, which has no key and always stays; every input
row counts as one document, also when rows repeat; an empty table gives empty results; ties cannot occur; other columns of
the table are passed through by apply(), whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cuckoo import CuckooFilter
from .store import BLANKS, ascii_lower, text_of, written

REFS = "shard int, key binary, h long, n long"
FILTERS = "shard int, blob binary"


@dataclass(frozen=True)
class LineRules:
    min_docs: int = 10
    min_chars: int = 1
    #: Keys that one shard should hold at most; the number of shards follows from it.
    shard_keys: int = 1_000_000
    broadcast_bytes: int = 64 << 20


def line_keys(text: Column, rules: LineRules) -> Column:
    """SHA-256 of each line's key, null for a line without one."""

    def key(line: Column) -> Column:
        k = F.btrim(line, F.lit(BLANKS))
        return F.when(F.length(k) >= rules.min_chars, F.unhex(F.sha2(k, 256)))

    return F.transform(F.split(ascii_lower(text), "\n", -1), key)


def _hash(key: Column) -> Column:
    return F.xxhash64(key)


def _shard(h: Column, shards: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 40), F.lit(shards)).cast("int")


@dataclass(frozen=True)
class LineIndex:
    """refs: shard, key, h, n. filters: shard, blob."""

    refs: DataFrame
    filters: DataFrame
    shards: int
    rules: LineRules = LineRules()

    @classmethod
    def empty(cls, spark: SparkSession, rules: LineRules = LineRules(), shards: int = 1) -> LineIndex:
        return cls(spark.createDataFrame([], REFS), spark.createDataFrame([], FILTERS), shards, rules)

    def insert(self, docs: DataFrame, text: str = "text") -> LineIndex:
        return self._change(docs.select(line_keys(text_of(text), self.rules).alias("keys")), 1)

    def delete(self, docs: DataFrame, text: str = "text") -> LineIndex:
        """docs: documents that were inserted, with the text that they had then."""
        return self._change(docs.select(line_keys(text_of(text), self.rules).alias("keys")), -1)

    def _change(self, keyed: DataFrame, by: int) -> LineIndex:
        # a document counts once for each of its keys; hot keys are summed before the shuffle
        found = keyed.select(F.explode(F.array_distinct(F.filter("keys", lambda k: k.isNotNull()))).alias("key"))
        delta = found.groupBy("key").agg((F.count(F.lit(1)) * by).alias("d"))
        delta = delta.select(F.lit(None).cast("int").alias("shard"), "key", _hash(F.col("key")).alias("h"), F.lit(0).cast("long").alias("was"), "d")
        kept = self.refs.select(F.lit(None).cast("int").alias("shard"), "key", "h", F.col("n").alias("was"), F.lit(0).cast("long").alias("d"))
        both = kept.unionByName(delta).groupBy("key", "h").agg(F.sum("was").alias("was"), (F.sum("was") + F.sum("d")).alias("n"))
        both = written(both.filter("was > 0 or n > 0"), "lines")
        shards = max(self.shards, -(-both.count() // self.rules.shard_keys))
        both = both.withColumn("shard", _shard(F.col("h"), shards))
        refs = both.filter("n > 0").select("shard", "key", "h", "n")
        return LineIndex(refs, self._filters(both, shards), shards, self.rules)

    def _filters(self, both: DataFrame, shards: int) -> DataFrame:
        least = self.rules.min_docs
        frequent = both.filter((F.col("n") >= least) | (F.col("was") >= least)).select("shard", "h", (F.col("was") >= least).alias("was"), (F.col("n") >= least).alias("now"))
        fresh = shards != self.shards

        def update(key, old: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            # one shard: at most about shard_keys rows
            now, was = rows["now"].to_numpy(bool), rows["was"].to_numpy(bool)
            h = rows["h"].to_numpy(np.int64).view(np.uint64)
            filt = None
            if len(old) and not fresh:
                filt = CuckooFilter.from_bytes(old["blob"].iloc[0])
                filt.remove(h[was & ~now])
                if not filt.add(h[now & ~was]):
                    filt = None
            size = max(int(now.sum()), 1)
            while filt is None:
                filt = CuckooFilter.sized(size)
                if not filt.add(h[now]):
                    filt, size = None, size * 2
            return pd.DataFrame({"shard": [key[0]], "blob": [filt.to_bytes()]})

        grouped = self.filters.groupBy("shard").cogroup(frequent.groupBy("shard"))
        return written(grouped.applyInPandas(update, FILTERS), "filters")

    def _probe(self, spark: SparkSession):
        """A function of an array of hashes to the places that may be frequent, or None if the filters are too large."""
        size = self.filters.agg(F.sum(F.length("blob"))).first()[0] or 0
        if size > self.rules.broadcast_bytes:
            return None
        blobs = spark.sparkContext.broadcast({r["shard"]: r["blob"] for r in self.filters.collect()})
        shards = self.shards

        @F.arrow_udf("array<int>")
        def probe(hashes: pa.Array) -> pa.Array:
            filters = {k: CuckooFilter.from_bytes(v) for k, v in blobs.value.items()}
            ends = np.asarray(hashes.offsets)
            flat = hashes.values.slice(ends[0], ends[-1] - ends[0])
            there = np.asarray(flat.is_valid())
            h = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            shard = ((h >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)
            maybe = np.zeros(len(h), bool)
            for k, f in filters.items():
                at = np.flatnonzero(there & (shard == k)) if shards > 1 else np.flatnonzero(there)
                maybe[at] = f.has(h[at])
            hits = np.flatnonzero(maybe)
            starts = ends[:-1] - ends[0]
            row = np.searchsorted(starts, hits, "right") - 1
            # rows with empty arrays share a start with the next row; the last of those is the one that has values
            cuts = np.searchsorted(row, np.arange(len(starts) + 1))
            return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array((hits - starts[row]).astype(np.int32)))

        return probe

    def frequent_lines(self, keyed: DataFrame, by: list[str]) -> DataFrame:
        """For each row of keyed (columns `by` and `keys`) that has frequent lines: by, drop (their places in order), marks (a byte for each line up to the last of them, 1 if it goes)."""
        probe = self._probe(keyed.sparkSession)
        places = F.posexplode("keys").alias("i", "key")
        if probe is None:
            lines = keyed.select(*by, places).filter("key is not null")
        else:
            maybe = probe(F.transform("keys", _hash_or_null))
            lines = keyed.withColumn("maybe", maybe).filter(F.size("maybe") > 0)
            lines = lines.select(*by, "keys", F.explode("maybe").alias("i")).select(*by, "i", F.get("keys", F.col("i")).alias("key"))
        frequent = self.refs.filter(F.col("n") >= self.rules.min_docs).select("key")
        places = lines.join(frequent, "key").groupBy(*by).agg(F.array_sort(F.collect_set("i")).alias("drop"))
        before = F.concat(F.array(F.lit(-1)), F.slice("drop", 1, F.size("drop") - 1))
        return places.withColumn("marks", F.array_join(F.zip_with("drop", before, lambda i, p: F.concat(F.repeat(F.lit("0"), i - p - 1), F.lit("1"))), "").cast("binary"))

    def apply(self, docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", keyed: DataFrame | None = None) -> DataFrame:
        """row (all columns of docs), n_lines, n_dropped, kept (the text that stays)."""
        if keyed is None:
            keyed = written(keyed_lines(docs, self.rules, text=text, doc_id=doc_id), "keys")
        drop = self.frequent_lines(keyed, ["of_id", "of_text"])
        own = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("id"), text_of(text).alias("t")).withColumn("th", F.xxhash64("t"))
        both = own.join(drop, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("th") == F.col("of_text")), "left")
        lines = F.split("t", "\n", -1)
        # one look at a byte for each line: the time grows with the lines, not with their square
        kept = F.when(F.col("drop").isNull(), F.col("t")).otherwise(F.array_join(F.filter(lines, lambda x, i: F.substring("marks", i + 1, F.lit(1)) != F.lit(b"1")), "\n"))
        return both.select("row", F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def _hash_or_null(key: Column) -> Column:
    return F.when(key.isNotNull(), _hash(key))


def keyed_lines(docs: DataFrame, rules: LineRules, *, text: str, doc_id: str) -> DataFrame:
    """of_id, of_text (hash of the text: rows that repeat a doc_id stay apart), keys."""
    return docs.select(F.col(doc_id).alias("of_id"), F.xxhash64(text_of(text)).alias("of_text"), line_keys(text_of(text), rules).alias("keys"))


def line_dedup(docs: DataFrame, rules: LineRules = LineRules(), *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Index all of docs, then apply the index to them: row, n_lines, n_dropped, kept."""
    keyed = written(keyed_lines(docs, rules, text=text, doc_id=doc_id), "keys")
    index = LineIndex.empty(docs.sparkSession, rules)._change(keyed, 1)
    return index.apply(docs, text=text, doc_id=doc_id, keyed=keyed)
