"""Substring dedup by hashing lines, or paragraphs, and the sentences within them.

Units are normalised (blanks joined, lower case) and hashed; digests are grouped over all documents; of each
group the occurrence that ranks first, by (doc_id, start), stays and all others are removed at their original offsets.
Sentences are units besides their lines, so that a passage which was pasted into the middle of a line is found as well.
A unit of fewer than `min_words` words is too common by itself: it goes together with neighbours, on either side and across
lines, that make enough words with it, so that passages of short lines or sentences are found and lone short sentences stay.
Repetition within one document counts like repetition between documents.

Half-digests are counted first, with map-side combining; only units whose half-digest repeats are written down and compared by whole
digests. They are joined back from written tables, so that Spark can split a unit that a third of all documents hold.

Defined results: null and empty texts have no units; texts of fewer than `min_words` words stay; rows that repeat one doc_id rank
alike, so that all of them keep what ranks first; an empty table gives an empty result; other columns are passed through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import lean, text_of, written

_LINE = re.compile(r"[^\n]+")
_PARAGRAPH = re.compile(r"(?:[^\n]|\n(?!\s*\n))+")
_STOP = re.compile(r"[.!?]+[\x20\t\n]+")


@dataclass(frozen=True)
class UnitRules:
    #: "line" or "paragraph" (paragraphs are parted by blank lines).
    unit: str = "line"
    sentences: bool = True
    min_words: int = 13


def units(text: str, rules: UnitRules) -> Iterator[tuple[int, int, str]]:
    """(start, end, normalised text) of the units of enough words, and of short units with as many neighbours as make enough words."""
    pieces: list[tuple[int, int, list[str]]] = []
    wholes = set()
    for m in (_LINE if rules.unit == "line" else _PARAGRAPH).finditer(text):
        whole = m.group()
        cuts = [0, *[x.end() for x in _STOP.finditer(whole)], len(whole)] if rules.sentences else [0, len(whole)]
        spans = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
        for a, b in spans + [(0, len(whole))] * (len(spans) > 1):
            words = whole[a:b].lower().split()
            if len(words) >= rules.min_words:
                yield m.start() + a, m.start() + b, " ".join(words)
            if len(spans) > 1 and b - a == len(whole):
                wholes.add((m.start(), m.end()))
            elif words:
                pieces.append((m.start() + a, m.start() + b, words))
    for i, j in sorted(sequences([len(w) for _, _, w in pieces], rules.min_words)):
        span = pieces[i][0], pieces[j][1]
        if span not in wholes:
            yield *span, " ".join(x for _, _, w in pieces[i : j + 1] for x in w)


def sequences(n_words: list[int], least: int) -> set[tuple[int, int]]:
    """(first, last) of the shortest sequences of enough words that begin or end with a short unit."""
    out = set()
    for i, n in enumerate(n_words):
        if n < least:
            for step, stop in ((1, len(n_words) - 1), (-1, 0)):
                j, total = i, n
                while total < least and j != stop:
                    j += step
                    total += n_words[j]
                if total >= least:
                    out.add((min(i, j), max(i, j)))
    return out


def unit_table(docs: DataFrame, rules: UnitRules, *, text: str, doc_id: str) -> DataFrame:
    """of_id, of_text (hash of the text), start, length, h and rest (the two halves of the digest)."""
    own = docs.select(F.col(doc_id).alias("of_id"), text_of(text).alias("t"))
    own = own.select("of_id", F.xxhash64("t").alias("of_text"), "t")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, hashes, starts, lengths, digests = [], [], [], [], []

            def table(kind=b["of_id"].dtype, columns=(ids, hashes, starts, lengths, digests)) -> pd.DataFrame:
                ids_, hashes_, starts_, lengths_, digests_ = columns
                halves = np.frombuffer(b"".join(digests_), "<i8").reshape(-1, 2)
                return pd.DataFrame({"of_id": pd.Series(ids_, dtype=kind), "of_text": hashes_, "start": starts_, "length": lengths_, "h": halves[:, 0], "rest": halves[:, 1]})

            for i, h, t in zip(b["of_id"], b["of_text"], b["t"], strict=True):
                for start, end, norm in units(t, rules):
                    ids.append(i)
                    hashes.append(h)
                    starts.append(start)
                    lengths.append(end - start)
                    digests.append(blake2b(norm.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                if len(ids) > 100_000:
                    yield table()
                    for x in (ids, hashes, starts, lengths, digests):
                        x.clear()
            yield table()

    kind = own.schema["of_id"].dataType.simpleString()
    return own.mapInPandas(lean(run), f"of_id {kind}, of_text long, start int, length int, h long, rest long")


def unit_dedup(docs: DataFrame, rules: UnitRules = UnitRules(), *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """row (all columns of docs), n_units_removed, n_chars_removed, spans (array of start, end), kept (the text that stays)."""
    table = unit_table(docs, rules, text=text, doc_id=doc_id)
    often = written(table.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "often")
    table = written(table.join(often, "h"), "units")
    first = table.groupBy("h", "rest").agg(F.min(F.struct("of_id", "start")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    gone = table.join(written(first, "first"), ["h", "rest"]).filter(~F.struct("of_id", "start").eqNullSafe(F.col("first")))
    gone = gone.groupBy("of_id", "of_text").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("units"))
    own = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("id"), text_of(text).alias("t")).withColumn("th", F.xxhash64("t"))
    both = own.join(gone, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("th") == F.col("of_text")), "left")
    # a removed line and its removed sentences overlap: join spans, in order of start
    merged = F.aggregate(
        "units",
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, x: F.when(F.size(acc) == 0, F.array(x))
        .when(F.element_at(acc, -1)["end"] >= x["start"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(x))),
    )
    both = both.withColumn("spans", F.coalesce(merged, F.array().cast("array<struct<start:int,end:int>>")))
    # the stretches between the spans
    pieces = F.transform(
        F.sequence(F.lit(0), F.size("spans")),
        lambda k: F.substring(F.col("t"), F.coalesce(F.get("spans", k - 1)["end"], F.lit(0)) + 1, F.coalesce(F.get("spans", k)["start"], F.length("t")) - F.coalesce(F.get("spans", k - 1)["end"], F.lit(0))),
    )
    removed = F.aggregate("spans", F.lit(0), lambda n, x: n + x["end"] - x["start"])
    return both.select(
        "row",
        F.coalesce(F.size("units"), F.lit(0)).cast("long").alias("n_units_removed"),
        removed.cast("long").alias("n_chars_removed"),
        "spans",
        F.when(F.size("spans") == 0, F.col("t")).otherwise(F.array_join(pieces, "")).alias("kept"),
    )
