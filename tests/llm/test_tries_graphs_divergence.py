"""Conversation trie, embedding near-dedup and source divergence against brute force, and on nulls, ties, repeats, clashing columns and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayglass.llm.conversation_trie import TrieRules, conversation_trie
from wayglass.llm.scans import ranked, running
from wayglass.llm.source_divergence import DivergenceRules, excess, share, slices, source_divergence
from wayglass.llm.vector_graph import GraphRules, audit_recall, region_graph, search_region, split_regions, vector_graph

CLASH = "conv string, q string, place string, node string, region string, n long, digest string, k1 string, term string, rank string, id string"
CLASHING = ("c", "q", "p", "n", "r", 1, "d", "k", "t", "r", "i")


# conversations


def conversations():
    rng = random.Random(3)
    say = lambda: rng.choice(["hello", "why?", "because", "", None, "été 😀", "x" * 50])
    rows = []
    for c in list(range(0, 60)) + [103, 205, 204, -3, -7, 1000003]:
        turns = rng.choice([1, 2, 3, 6, 9, 12, 40 if c % 10 == 0 else 4])
        rows += [(c, t, rng.choice(["user", "bot"]) if c % 3 else "user", say() if c % 2 else "same") for t in range(turns)]
    rows += [(7, None, None, "before all"), (7, None, None, "before all"), (7, 1, "user", "tie"), (None, 1, "user", "nobody"), (33, 2, "bot", "tie"), (33, 2, "bot", "tie"), (33, 2, "bot", "tie")]
    # copies of one conversation, and a very long one that others continue
    rows += [(5000 + 5 * k + 4, t, "user", f"copy {t}") for k in range(40) for t in range(12)]
    rows += [(6000, t, "user", f"long {t % 7}") for t in range(700)] + [(6000 + k, t, "bot", "own") for k in range(1, 5) for t in range(10)]
    rng.shuffle(rows)
    return rows


def trie_by_hand(rows, family=5, most=9):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest(), r, x))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, v in own.items():
        base = c - (abs(c) % family if c >= 0 else -(abs(c) % family))
        h = zlib.crc32(str(c).encode()) % most
        full[c] = tuple(own.get(base, [])[:h] + v[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(full):
        for d in range(len(full[c]) + 1):
            members[full[c][:d]].append(c)
        ends[full[c]].append(c)
    children = defaultdict(list)
    for s in members:
        if s:
            children[s[:-1]].append(s)
    leaves, saved = {}, {}
    for s in sorted(members, key=len, reverse=True):
        leaves[s] = sum(leaves[k] for k in children[s]) if children[s] else 1
        saved[s] = (len(members[s]) - 1) * (len(s[-1][1].encode()) if s else 0) + sum(saved[k] for k in children[s])
    return sorted(
        (m[0], len(s), members[s[:-1]][0] if s else None, len(m), len(children[s]), leaves[s], saved[s], hashlib.sha256(",".join(map(str, ends[s])).encode()).hexdigest()) for s, m in members.items()
    )


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def test_trie_against_brute_force(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, *CLASHING) for r in rows], f"conv_id long, turn int, role string, text string, {CLASH}").repartition(5)
    # small blocks and pieces: several rounds of ranks, ends in many pieces
    got = conversation_trie(df, TrieRules(block=3, piece=40)).collect()
    assert sorted((tuple(r[c] for c in NODE) for r in got), key=lambda x: x[:2]) == trie_by_hand(rows)
    at = {(r["conv_id"], r["depth"]): r for r in got}
    order = sorted(got, key=lambda r: r["preorder"])
    assert [r["preorder"] for r in order] == list(range(len(got)))
    for r in got:  # a subtree is the run of nodes up to its end
        inside = order[r["preorder"] : r["subtree_end"] + 1]
        assert all(x["depth"] > r["depth"] for x in inside[1:]) and sum(x["n_children"] == 0 for x in inside) == r["n_leaves"]
        if r["depth"]:
            assert at[r["parent_conv_id"], r["depth"] - 1]["preorder"] < r["preorder"] <= at[r["parent_conv_id"], r["depth"] - 1]["subtree_end"]


def test_trie_of_plain_conversations_and_of_none(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "u", "b"), (2, 0, "u", "a"), (3, 0, "u", "a"), (3, 1, "u", "c")]
    got = conversation_trie(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), TrieRules(family=1)).collect()
    assert sorted((tuple(r[c] for c in NODE) for r in got), key=lambda x: x[:2]) == trie_by_hand(rows, family=1)
    empty = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert conversation_trie(empty).count() == 0


def test_scans_over_ranges_that_one_segment_fills(spark):
    rng = random.Random(1)
    rows = [(7 if k % 3 else k % 11, k, rng.randrange(-9, 9), rng.getrandbits(62), bytes([k % 5])) for k in range(4000)]
    df = spark.createDataFrame(rows, "s long, k long, v long, x long, b binary").repartition(9)
    got = {r["k"]: r for r in running(df, ["s", "k"], "s", add=("v",), xor=("x",)).collect()}
    place, total, mixed = Counter(), Counter(), Counter()
    for s, k, v, x, _ in sorted(rows):
        total[s] += v
        mixed[s] ^= x
        assert (got[k]["place"], got[k]["upto_v"], got[k]["upto_x"]) == (place[s], total[s], mixed[s])
        place[s] += 1
    assert {(r["b"], r["rank"]) for r in ranked(df, "b", ["k"], "rank").select("b", "rank").collect()} == {(bytes([i]), i) for i in range(5)}


# vectors


def vectors(seed=0, dense=120, lonely=500):
    rng = np.random.default_rng(seed)
    out = [rng.normal(size=32) for _ in range(lonely)]
    base = rng.normal(size=32)
    out += [base + 0.12 * rng.normal(size=32) for _ in range(dense)]
    for k in range(0, 60):
        out.append(out[k] + 0.15 * rng.normal(size=32))
    return [v.tolist() for v in out]


def links_by_hand(rows, cosine=0.93):
    good = lambda e, la: la is not None and e is not None and len(e) and all(x is not None and np.isfinite(x) for x in e) and any(e)
    ok = [good(e, la) for _, e, la in rows]
    unit = [np.array(e, float) / np.abs(e).max() if g else None for (_, e, _), g in zip(rows, ok)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    near = [[] for _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                near[i].append(j)
                near[j].append(i)
    comp = list(range(len(rows)))
    for start in range(len(rows)):
        if comp[start] == start:
            todo = [start]
            while todo:
                for j in near[todo.pop()]:
                    if comp[j] != start and j != start:
                        comp[j] = start
                        todo.append(j)
    least = defaultdict(lambda: None)
    for i, c in enumerate(comp):
        if rows[i][0] is not None:
            least[c] = rows[i][0] if least[c] is None else min(least[c], rows[i][0])
    return sorted(((rows[i][0], len(near[i]), least[comp[i]], rows[i][0] is not None and rows[i][0] == least[comp[i]]) for i in range(len(rows))), key=str)


VECTORS = f"vec_id long, embedding array<double>, label int, {CLASH}"


def odd_vectors():
    vs = vectors()
    rows = [(i, v, i % 2 if i < 500 else 1) for i, v in enumerate(vs)]
    rows += [(9000 + k, vs[3], 1) for k in range(30)] + [(9050, vs[3], 0), (9051, [x * 1e200 for x in vs[3]], 1), (9052, [x * 1e-200 for x in vs[3]], 1)]
    rows += [(9100, None, 1), (9101, [], 1), (9102, [0.0] * 32, 1), (9103, [float("nan")] * 32, 1), (9104, [None] + vs[3][1:], 1), (9105, vs[3], None), (9106, [float("inf")] + vs[3][1:], 1)]
    rows += [(9107, [1.0, 0.0], 1), (9108, [1.0, 0.01], 1), (None, vs[3], 1), (None, vs[5], 1), (4, vs[4], 0), (4, vs[6], 0)]
    return rows


def test_near_dedup_against_brute_force(spark):
    rows = odd_vectors()
    df = spark.createDataFrame([(*r, *CLASHING) for r in rows], VECTORS).repartition(4)
    out, found = vector_graph(df, GraphRules(shard=96))
    assert sorted((tuple(r) for r in out.collect()), key=str) == links_by_hand(rows)
    assert found.agg(F.sum("missed")).first()[0] == 0
    audit = audit_recall(df, out, block=64).first()
    assert audit["true_links"] == audit["found_links"] > 0


def test_near_dedup_over_many_regions(spark):
    """Labels that are split around centres, and a group of near copies that is dealt into blocks: each link counts once."""
    rows = [(i, v, 1) for i, v in enumerate(vectors(seed=4, dense=400, lonely=900))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    rules = GraphRules(region=150, shard=64, branch=8, sample=8)
    out, found = vector_graph(df, rules)
    got, want = {r["vec_id"]: tuple(r) for r in out.collect()}, {r[0]: r for r in links_by_hand(rows)}
    assert sum(r[1] for r in got.values()) >= 0.95 * sum(r[1] for r in want.values())
    assert all(got[k][1] <= want[k][1] for k in want)  # none twice, none below the threshold
    assert sum(got[k][2] == want[k][2] for k in want) >= 0.97 * len(want)
    audit = audit_recall(df, out, rules, block=50).first()
    assert audit["found_links"] >= 0.9 * audit["true_links"]


def test_regions_stay_small(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=8)
    rows = [("0:8", bytes([k // 256, k % 256] + [0] * 6) + int(rng.integers(1 << 40)).to_bytes(8, "little"), k, 1, (base + 1e-6 * rng.normal(size=8)).tolist(), []) for k in range(500)]
    placed = split_regions(spark.createDataFrame(rows, "region string, node binary, id long, weight long, embedding array<double>, choices array<array<int>>"), GraphRules(region=60, branch=4, sample=4), "double")
    sizes = {r["region"]: r["count"] for r in placed.groupBy("region").count().collect()}
    assert max(sizes.values()) <= 120


def test_search_finds_a_dense_group_and_doubles_its_beam():
    vs = np.array(vectors(seed=9, dense=150))
    vs /= np.linalg.norm(vs, axis=1, keepdims=True)
    true = (vs @ vs.T >= 0.93).sum(1) - 1
    for beam in (2, 48):
        found = search_region(vs, np.ones(len(vs), np.int64), np.arange(len(vs)) % 50 == 0, GraphRules(beam=beam, shard=100))
        assert found.n_links.sum() >= 0.98 * true.sum() and (found.n_links <= true).all()
    adjacency, medoids = region_graph(vs.astype(np.float32), GraphRules(shard=100))
    assert len(medoids) > 5 and set(np.unique(adjacency)) >= set(range(len(vs)))  # every vector can be reached


def test_near_dedup_of_no_vectors(spark):
    out, _ = vector_graph(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert out.count() == 0


# divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def divergence_by_hand(rows, min_docs=3, top=200):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = TERM.findall(lower(text or ""))
        groups[lang].add(source)
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = sorted(w for w, n in docs[lang].items() if n >= min_docs)
        p = {}
        for s in sources | {None}:
            c = counts[lang, s] if s is not None else sum((counts[lang, x] for x in sources), Counter())
            total = sum(c[w] for w in kept)
            p[s] = {w: 1 + 10**9 * (c[w] + 1) // (total + len(kept)) for w in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(f(p[s][w], p[t][w]) for w in kept), t) for t in sources if t != s]
            terms = [(f(p[s][w], p[None][w]), w) for w in kept if counts[lang, s][w] and p[s][w] > p[None][w]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked_ = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked_)]
    return sorted(out)


def test_divergence_against_brute_force(spark):
    rng = random.Random(8)
    words = [f"wört{chr(97 + k)}" for k in range(26)] + ["THE", "the", "日本", "a", "😀x", "İ"]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(0, 60))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None, "z"])) for _ in range(120)]
    rows += [(None, "en", "empty"), ("", "en", "empty"), ("1234 -- ++", "xx", "a"), ("once", "xx", "b"), (None, "one", "only"), ("same same", "eq", "a"), ("same same", "eq", "b"), ("same same", "eq", "c")]
    rows += [rows[0]] * 3 + [("the " * 300_000 + "tail", "en", "s1")]
    df = spark.createDataFrame([(i, *r, *CLASHING) for i, r in enumerate(rows)], f"doc_id long, text string, lang string, source string, {CLASH}").repartition(4)
    want = divergence_by_hand(rows)
    assert sorted(tuple(r) for r in source_divergence(df).collect()) == want
    # tasks that hand on their sums all the time, pairs evaluated few at a time
    small = DivergenceRules(held_terms=5, held_bytes=100, pairs_at_once=7, held_pairs=3)
    assert sorted(tuple(r) for r in source_divergence(df, small).collect()) == want
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert source_divergence(empty).count() == 0


def test_shares_are_exact(spark):
    rng = random.Random(2)
    rows = [(c := rng.randrange(0, 10**k), c + rng.randrange(0, 10**k), rng.randrange(1, 10**6)) for k in range(1, 13) for _ in range(20)]
    rows = [(c, n, v) for c, n, v in rows if c + 1 <= n + v]
    df = spark.createDataFrame(rows, "c long, n long, v long").withColumn("p", share(F.col("c"), F.col("n"), F.col("v"))).withColumn("f", excess(F.col("p"), F.lit(7).cast("long")))
    for r in df.collect():
        assert r["p"] == 1 + 10**9 * (r["c"] + 1) // (r["n"] + r["v"]) and r["f"] == (r["p"] - 7) ** 2 // 7


def test_terms_by_slices():
    text = ("Ab9ÉÀ_z " * 400_000).encode()
    got = Counter(w for part in slices(text) for w in part)
    assert got == {b"ab": 400_000, "ÉÀ".encode(): 400_000, b"z": 400_000}
    with pytest.raises(StopIteration):
        next(slices(b""))
