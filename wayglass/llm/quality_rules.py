"""Host-level quality rules, native expressions only.

Every document is measured on its whole text. Failures of each rule are summed by host, each host's
rate is shrunk towards the rate of all hosts with a beta prior fitted to the hosts by moments, and the hosts' verdicts are joined
back to their documents. Small hosts are thus judged by the prior, large ones by their own documents.

Defined results: a null text has no words; a null host is a host of its own, joined with a null-safe
equality; an empty table gives an empty result; extra columns are ignored; every input row gives one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import BLANK_RE, text_of, written

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class HostRules:
    """A document fails `symbols` with over this many symbols to 100 words, and `lines` if over this many of 100 lines with
    words repeat an earlier one. A host goes if the shrunk rate of a rule is over `most`."""

    symbols: int = 100
    lines: int = 60
    most: float = 0.5
    strongest_prior: float = 1e6


RULES = ("base_failed", "symbols_failed", "lines_failed")


def measures(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of a text, each within its row."""
    # split drops nothing: a leading or trailing blank run leaves an empty string, which is filtered
    words = F.filter(F.split(text, f"{BLANK_RE}+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "words": words,
        "word_chars": F.length(F.regexp_replace(text, f"{BLANK_RE}+", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }


def measured(docs: DataFrame, *, text: str, host: str, doc_id: str, rules: HostRules) -> DataFrame:
    m = measures(F.col("t"))
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("host"), text_of(text).alias("t"))
    base = base.select("doc_id", "host", *[c.alias(k) for k, c in m.items()])
    # windows that share a hash with another one are few: only those are compared word by word
    hashes = F.transform(
        F.when(F.size("words") > 3, F.sequence(F.lit(0), F.size("words") - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)),
    )
    base = base.withColumn("hashes", hashes)
    # sorted (hash, words, place): a window repeats if it equals its neighbour on either side
    ordered = F.array_sort(
        F.transform(
            F.col("hashes"),
            lambda h, i: F.struct(h.alias("h"), F.get("words", i).alias("a"), F.get("words", i + 1).alias("b"), F.get("words", i + 2).alias("c"), i.alias("i")),
        )
    )
    base = base.withColumn("ordered", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), ordered))

    def same(x: Column, y: Column) -> Column:
        return (x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    starts = F.filter("ordered", lambda x, k: F.coalesce(same(x, F.get("ordered", k + 1)), F.lit(False)) | F.coalesce(same(x, F.get("ordered", k - 1)), F.lit(False)))
    covered = F.size(F.array_distinct(F.flatten(F.transform(starts, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    base = base.select(
        "doc_id", "host", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        F.when(F.col("ordered").isNull(), F.lit(0)).otherwise(covered).cast("long").alias("n_repeat_words"),
    )
    return base.select(
        "*",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        (100 * F.col("n_symbols") > rules.symbols * F.col("n_words")).alias("symbols_failed"),
        (100 * F.col("n_dup_lines") > rules.lines * F.col("n_lines")).alias("lines_failed"),
    )


def host_verdicts(rows: DataFrame, rules: HostRules) -> DataFrame:
    """host, n_docs, failures and shrunk rate of each rule, host_failed. rows: from measured()."""
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *[F.count_if(r).alias(f"n_{r}") for r in RULES])
    prior = hosts.agg(F.sum("n_docs").alias("n"), *[F.sum(f"n_{r}").alias(f"f_{r}") for r in RULES], *[F.sum(F.col(f"n_{r}") * F.col(f"n_{r}") / F.col("n_docs")).alias(f"q_{r}") for r in RULES]).first()
    if not prior or not prior["n"]:
        prior = None
    failed = F.lit(False)
    for r in RULES:
        mean = prior[f"f_{r}"] / prior["n"] if prior else 0.0
        spread = prior[f"q_{r}"] / prior["n"] - mean * mean if prior else 0.0
        strength = min(max(mean * (1 - mean) / spread - 1, 1.0), rules.strongest_prior) if spread > 0 else rules.strongest_prior
        hosts = hosts.withColumn(f"rate_{r}", (F.col(f"n_{r}") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength)))
        failed = failed | (F.col(f"rate_{r}") > rules.most)
    return hosts.withColumn("host_failed", failed)


def quality_rules(docs: DataFrame, *, text: str = "text", host: str = "source", doc_id: str = "doc_id", rules: HostRules = HostRules()) -> DataFrame:
    """One row for each input row: its measures, the rules it fails, its host's verdict, kept."""
    rows = written(measured(docs, text=text, host=host, doc_id=doc_id, rules=rules), "quality")
    hosts = host_verdicts(rows, rules).withColumnRenamed("host", "of_host")
    out = rows.join(hosts, F.col("host").eqNullSafe(F.col("of_host")), "left").drop("of_host")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False)))
