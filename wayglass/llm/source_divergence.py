"""How far the sources of a language use its terms differently, by equal count columns (exact integers throughout).

Terms are runs of letters: everything but the ASCII characters that are no letters ends one, and only A-Z is lower-cased. A language keeps the V
terms that stand in enough of its documents. A kept term's counts by source are its sparse vector; terms with equal vectors are one
column with a multiplicity, so each pair of sources is evaluated once for each distinct vector. Within a vector only its own sources are paired:
what a pair owes to terms that one of them, or both, never use follows from the number of such terms alone.

With p = 1 + floor(scale * (count + 1) / (N + V)) and f(p, q) = floor((p - q)^2 / q), a pair's value over all V terms is

    V f(p0, q0) + sum over s's counts of [f(p, q0) - f(p0, q0)] + sum over t's counts of [f(p0, q) - f(p0, q0)]
    + sum over vectors with both of m [f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)]

where p0 and q0 belong to count 0. Tasks count their documents' terms before anything is shuffled, so neither a frequent term nor a source or language that
holds most documents meets in one task as rows; a vector has at most as many entries as its language has sources, whose pairs are the result.

Defined results: null text, lang and source are ''; every row counts as one document, also when rows repeat; a group without terms has count 0 for
every kept term; a language without kept terms has value 0 for every pair; a language with one source has no pair; equal values are ranked by
the item's UTF-8 bytes; texts of any length are counted whole, in slices that end between terms; an empty table gives no rows; other columns are ignored, whatever their names.
Counts may reach 9 * 10^15 / 1000 in a group, beyond which the steps of the division would leave 64 bits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import lean, text_of, written


@dataclass(frozen=True)
class DivergenceRules:
    min_docs: int = 3
    top_terms: int = 200
    #: Terms and bytes of text that a task counts before it hands its sums on.
    held_terms: int = 300_000
    held_bytes: int = 64 << 20
    #: Pairs of one vector's entries that are evaluated at a time, and sums that a task holds.
    pairs_at_once: int = 1 << 20
    held_pairs: int = 1 << 20


SLICE = 1 << 20
#: Bytes of letters to themselves in lower case, all other ASCII to a space; bytes of other characters stay.
LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def slices(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time."""
    plain, start = text.translate(LETTERS), 0
    while start < len(plain):
        end = plain.find(b" ", start + SLICE)
        end = len(plain) if end < 0 else end
        yield plain[start:end].split()
        start = end


def term_counts(docs: DataFrame, rules: DivergenceRules, text: str, lang: str, source: str) -> DataFrame:
    """lang, source, term, n, docs: sums of a task's documents; a term may come more than once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        terms = size = 0

        def out() -> pa.RecordBatch:
            keys = [(k, w) for k, (n, _) in held.items() for w in n]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k, _ in keys], pa.string()), pa.array([k[1] for k, _ in keys], pa.string()), pa.array([w for _, w in keys], pa.binary()),
                    pa.array([c for n, _ in held.values() for c in n.values()], pa.int64()), pa.array([d[w] for n, d in held.values() for w in n], pa.int64()),
                ],
                ["lang", "source", "term", "n", "docs"],
            )

        for batch in batches:
            for la, so, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                n, d = held.setdefault((la, so), (Counter(), Counter()))
                before, once = len(n), set()
                body = t.as_py()
                for words in slices(body):
                    n.update(words)
                    once.update(words)
                d.update(once)
                terms, size = terms + len(n) - before, size + len(body)
                if terms > rules.held_terms or size > rules.held_bytes:
                    yield out()
                    held, terms, size = {}, 0, 0
        if held:
            yield out()

    rows = docs.select(text_of(lang).alias("lang"), text_of(source).alias("source"), text_of(text).cast("binary").alias("text"))
    return rows.mapInArrow(lean(count), "lang string, source string, term binary, n long, docs long")


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 * (count + 1) / (total + kept)), three digits at a time so that nothing leaves 64 bits."""
    over = total + kept
    whole, rest = F.lit(0).cast("long"), count + 1
    for step in (1, 1000, 1000, 1000):
        digit = (rest * step).cast("long")
        whole, rest = whole * step + F.call_function("div", digit, over), digit % over
    return F.lit(1).cast("long") + whole


def excess(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _pair_sums(rules: DivergenceRules):
    """Of vectors (lang, m, entries of sid, p, p0): lang, s, t, value, the part of terms that both sources use."""

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) * (p - q) // q

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list, list]] = {}
        size = 0

        def fold(lang: str) -> tuple[np.ndarray, np.ndarray]:
            codes, sums = (np.concatenate(x) for x in held[lang])
            unique, at = np.unique(codes, return_inverse=True)
            total = np.zeros(len(unique), np.int64)
            np.add.at(total, at, sums)
            held[lang] = ([unique], [total])
            return unique, total

        def out() -> Iterator[pa.RecordBatch]:
            for lang in list(held):
                codes, sums = fold(lang)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes >> 31), pa.array(codes & 0x7FFFFFFF), pa.array(sums)], ["lang", "s", "t", "value"])

        for batch in batches:
            langs, weights = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy()
            lists = batch.column(2)
            ends = np.asarray(lists.offsets).astype(np.int64)
            flat = lists.values
            sid, p, p0 = (flat.field(k).to_numpy() for k in range(3))
            for lang in sorted(set(langs)):
                rows = np.flatnonzero(langs == lang)
                n = ends[rows + 1] - ends[rows]
                # an entry for each source of each vector; each meets all entries of its vector
                own = np.repeat(ends[rows], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                first, width, m = np.repeat(ends[rows], n), np.repeat(n, n), np.repeat(weights[rows], n)
                done = np.concatenate([[0], np.cumsum(width)])
                i = 0
                while i < len(own):
                    j = max(i + 1, int(np.searchsorted(done, done[i] + rules.pairs_at_once, "right")) - 1)
                    w = width[i:j]
                    x = np.repeat(own[i:j], w)
                    y = np.repeat(first[i:j], w) + np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
                    mult = np.repeat(m[i:j], w)
                    apart = x != y
                    x, y, mult = x[apart], y[apart], mult[apart]
                    value = mult * (f(p[x], p[y]) - f(p[x], p0[y]) - f(p0[x], p[y]) + f(p0[x], p0[y]))
                    codes = (sid[x].astype(np.int64) << 31) | sid[y]
                    have = held.setdefault(lang, ([], []))
                    have[0].append(codes)
                    have[1].append(value)
                    size += len(codes)
                    if size > 4 * rules.pairs_at_once:
                        size = sum(len(fold(k)[0]) for k in held)
                        if size > rules.held_pairs:
                            yield from out()
                            held.clear()
                            size = 0
                    i = j
        yield from out()

    return work


def source_divergence(docs: DataFrame, rules: DivergenceRules = DivergenceRules(), *, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part ('pair' or 'term'), item (the other source, or the term), value, rank."""
    # one shuffle by language and term serves the sums by source and the vectors
    sums = term_counts(docs, rules, text, lang, source).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    vectors = sums.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vec"))
    kept = written(vectors.filter(F.col("docs") >= rules.min_docs).select("lang", F.col("term").cast("string").alias("term"), "n", "vec"), "terms")
    columns = written(kept.groupBy("lang", "vec").agg(F.count(F.lit(1)).alias("m")).select("*", F.monotonically_increasing_id().alias("column")), "columns")

    languages = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("total_lang"))
    entries = columns.select("lang", "column", "m", F.inline("vec"))
    totals = entries.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("m")).alias("total"))
    every = docs.select(text_of(lang).alias("lang"), text_of(source).alias("source")).distinct()
    groups = every.join(totals, ["lang", "source"], "left").join(languages, "lang", "left").fillna(0, ["total", "v", "total_lang"])
    groups = written(groups.withColumn("sid", F.row_number().over(Window.partitionBy("lang").orderBy("source"))), "groups")

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    # what a language's totals say comes with its groups, so terms are only dealt by language and source
    terms = kept.select("lang", F.col("term").alias("item"), F.col("n").alias("n_lang"), F.inline("vec")).join(groups, ["lang", "source"])
    terms = terms.withColumns({"p": share(F.col("n"), F.col("total"), F.col("v")), "q": share(F.col("n_lang"), F.col("total_lang"), F.col("v"))}).filter("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", excess(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= rules.top_terms)

    sides = entries.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v"))).withColumn("p0", share(F.lit(0).cast("long"), F.col("total"), F.col("v")))
    both = sides.groupBy("lang", "column", "m").agg(F.collect_list(F.struct("sid", "p", "p0")).alias("entries")).select("lang", "m", "entries")
    both = both.mapInArrow(lean(_pair_sums(rules)), "lang string, s long, t long, value long")
    zero = groups.filter("v > 0").withColumn("q0", share(F.lit(0).cast("long"), F.col("total"), F.col("v"))).select("lang", F.col("sid").alias("other"), "q0", "v")
    # of one source's counts, each once with its number of terms: what they change against every other source
    counts = sides.groupBy("lang", "sid", "p", "p0").agg(F.sum("m").alias("m")).join(zero, "lang").filter("sid <> other")
    p, p0, q0, m = (F.col(c) for c in ("p", "p0", "q0", "m"))
    turned = F.array(
        F.struct(F.col("sid").cast("long").alias("s"), F.col("other").cast("long").alias("t"), (m * (excess(p, q0) - excess(p0, q0))).alias("value")),
        F.struct(F.col("other").cast("long").alias("s"), F.col("sid").cast("long").alias("t"), (m * (excess(q0, p) - excess(q0, p0))).alias("value")),
    )
    one = counts.select("lang", F.inline(turned))
    base = zero.select("lang", F.col("other").alias("s"), F.col("q0").alias("p0"), "v").join(zero.drop("v"), "lang").filter("s <> other")
    base = base.select("lang", F.col("s").cast("long"), F.col("other").cast("long").alias("t"), (F.col("v") * excess(F.col("p0"), F.col("q0"))).alias("value"))
    value = both.unionByName(one).unionByName(base).groupBy("lang", "s", "t").agg(F.sum("value").alias("value"))
    named = groups.select("lang", "sid", "source")
    pairs = named.join(named.select("lang", F.col("sid").alias("t"), F.col("source").alias("item")), "lang").filter("sid <> t")
    pairs = pairs.join(value.withColumnRenamed("s", "sid"), ["lang", "sid", "t"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    return pairs.withColumn("rank", F.row_number().over(ranked)).unionByName(terms)
