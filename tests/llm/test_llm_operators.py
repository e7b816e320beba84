"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import hashlib
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayglass.llm import exact_dedup as exact
from wayglass.llm.components import components
from wayglass.llm.cuckoo import CuckooFilter
from wayglass.llm.line_dedup import LineIndex, LineRules, line_dedup
from wayglass.llm.packing import OpenWindows, best_fit, encoder, pack
from wayglass.llm.piece_fst import PieceModel, PieceTransducer, piece_codes
from wayglass.llm.pii import base_spans, pii
from wayglass.llm.quality_rules import quality_rules
from wayglass.llm.queries import tokenizers_dir
from wayglass.llm.signature_join import JaccardRules, Shingler, TreeJoin, bands, jaccard_components, part_keys
from wayglass.llm.suffix_dedup import SuffixRules, suffix_dedup
from wayglass.llm import toxicity as toxicity_module
from wayglass.llm.toxicity import ToxicityRules, fit_toxicity, held_out, toxicity, training_rows
from wayglass.llm.unit_dedup import UnitRules, unit_dedup

#: Columns beyond those that are needed, with names that the operators use themselves.
CLASH = "row string, t string, digest string, h long, id long, th long, kept string, key string, td string, hashes string, n_words long, norm string, salt long"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"
BPE, PIECES = (os.path.join(tokenizers_dir(), f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def texts():
    rng = random.Random(5)
    vocab = ["stone", "river", "of", "the", "a", "Lamp,", "grün", "été.", "42", "#tag", "walks", "slowly", "north"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    line = say(14) + "."
    long_ = "\n".join(say(30) for _ in range(300))
    passage = say(60) + "."
    out = [say(80) + "\n" + line for _ in range(12)]
    out += [None, "", " \t\n", "\n\n\n", "one", "one two", long_, long_ + " end", long_, "x" * 30000, "ab " * 4000, line, line.upper() + "  ", f"  {line}", passage, say(20) + " " + passage + " " + say(20)]
    out += ["mail a.b@c.example or +1 (372) 555-7739, card 4539578763621486 at 10.20.30.40.", "\x1c odd\x85 blanks　here\x1f", "emoji 😀 and \x00 nul"]
    near = say(300).split()
    for k in range(4):
        w = list(near)
        w[k * 3] = "other"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    rows += [rows[0], rows[20], (None, "no id here"), (None, None)]
    full = [(i, t, None if k % 3 else "en", None if k % 4 == 0 else f"s{k % 2}", None if t is None else len(t), "r", "t", None, 1, 2, 3, "k", "k", None, "h", 9, "n", 4) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(rows, key="doc_id"):
    out = defaultdict(list)
    for r in rows:
        out[r[key]].append(r)
    return out


BLANK = re.compile(r"[\x20\x09-\x0D]+")


def words(t):
    return [w for w in BLANK.split(t or "") if w]


def test_exact_dedup(docs, empty):
    for options in ({}, {"digest": lambda c: (F.crc32(c.cast("binary")) % 3).cast("string")}):
        got = exact.exact_dedup(docs, **options).collect()
        own = docs.select("doc_id", "text").collect()
        groups = defaultdict(list)
        for r in own:
            groups[BLANK.sub(" ", r["text"] or "")].append(r["doc_id"])
        want = Counter()
        for t, ids in groups.items():
            low = min((i for i in ids if i is not None), default=None)
            for i in ids:
                want[(i, low, len(ids), i == low, hashlib.sha256(t.encode()).hexdigest())] += 1
        assert Counter(tuple(r) for r in got) == want
    assert exact.exact_dedup(empty).count() == 0


def test_quality_rules(docs, empty):
    got = quality_rules(docs).collect()
    own = docs.select("doc_id", "text").collect()
    want = Counter()
    for i, t in own:
        w, t = words(t), t or ""
        seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        hit = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        want[(i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w))] += 1
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter(tuple(r[c] for c in cols) for r in got) == want
    assert quality_rules(empty).count() == 0


def test_quality_rules_drops_hosts_that_fail(spark):
    rng = random.Random(31)
    say = lambda n: " ".join(f"w{rng.randrange(9999)}" for _ in range(n))
    rows = []
    for host, n, bad in (("good", 60, 3), ("short", 50, 45), ("lines", 40, 36), ("small", 2, 2), (None, 30, 1), ("half", 30, 15)):
        for k in range(n):
            text = say(80)
            if k < bad:
                text = "\n".join([say(60)] + ["the same line again and again here"] * 12) if host == "lines" else say(20)
            rows.append((len(rows), host, text))
    got = {r["doc_id"]: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    # moments and shrunk rates by hand
    fails = {}
    for i, host, t in rows:
        lines = t.split("\n")
        base = got[i]["base_failed"]
        fails.setdefault(host, []).append((base, False, 100 * (len(lines) - len(set(lines))) > 60 * len(lines)))
    gone = set()
    for rule in range(3):
        n = sum(map(len, fails.values()))
        k = {h: sum(f[rule] for f in fs) for h, fs in fails.items()}
        mean = sum(k.values()) / n
        spread = sum(k[h] ** 2 / len(fs) for h, fs in fails.items()) / n - mean**2
        strength = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e6) if spread > 0 else 1e6
        gone |= {h for h, fs in fails.items() if (k[h] + mean * strength) / (len(fs) + strength) > 0.5}
    assert {"short", "lines"} <= gone and not gone & {"good", None}
    for i, host, _ in rows:
        assert got[i]["kept"] == (not got[i]["base_failed"] and host not in gone), (i, host)
    assert any(not got[i]["base_failed"] and not got[i]["kept"] for i in got)


def kept_lines(rows, least):
    keys = Counter()
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for _, t in rows:
        keys.update({key(x) for x in (t or "").split("\n")} - {""})
    return Counter((i, "\n".join(x for x in (t or "").split("\n") if not key(x) or keys[key(x)] < least)) for i, t in rows)


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_line_dedup(docs, empty, limit):
    rules = LineRules(min_docs=4, broadcast_bytes=limit)
    got = Counter((r["id"], r["kept"]) for r in line_dedup(docs, rules).select("row.doc_id", "kept").toDF("id", "kept").collect())
    assert got == kept_lines(docs.select("doc_id", "text").collect(), 4)
    assert line_dedup(empty, rules).count() == 0


def test_line_index_is_reversible(spark, docs):
    rules = LineRules(min_docs=4, shard_keys=5)
    some, more = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    one = LineIndex.empty(spark, rules).insert(some)
    two = one.insert(more).delete(more)
    state = lambda x: sorted((bytes(r["key"]), r["n"]) for r in x.refs.collect())
    assert state(one) == state(two)
    kept = lambda x: Counter((r[0], r[1]) for r in x.apply(docs).select("row.doc_id", "kept").collect())
    assert kept(one) == kept(two)


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 4000).astype(np.uint64)
    f = CuckooFilter.sized(4000)
    assert f.add(h) and f.has(h).all()
    f = CuckooFilter.from_bytes(f.to_bytes())
    f.remove(h[:2000])
    assert f.has(h[2000:]).all() and f.has(h[:2000]).mean() < 0.01
    assert not CuckooFilter.sized(1).add(np.arange(50, dtype=np.uint64))


def plain_units(text, rules):
    """Units by a splitter of its own: characters one by one."""
    blocks, start = [], None
    for k in range(len(text) + 1):
        inside = k < len(text) and text[k] != "\n"
        if k < len(text) and not inside and rules.unit == "paragraph":
            rest = text[k + 1 :]
            inside = "\n" not in rest[: len(rest) - len(rest.lstrip())]
        if inside and start is None:
            start = k
        elif not inside and start is not None:
            blocks.append((start, k))
            start = None
    out, pieces, wholes = [], [], set()
    n_words = lambda a, b: len(text[a:b].split())
    for a, b in blocks:
        cuts, k = [a], a
        while rules.sentences and k < b:
            if text[k] in ".!?":
                while k < b and text[k] in ".!?":
                    k += 1
                if k < b and text[k] in " \t\n":
                    while k < b and text[k] in " \t\n":
                        k += 1
                    cuts.append(k)
            else:
                k += 1
        cuts = sorted({*cuts, b})
        sentences = list(zip(cuts, cuts[1:]))
        out += [(x, y) for x, y in sentences if n_words(x, y) >= rules.min_words]
        pieces += [(x, y) for x, y in sentences if n_words(x, y)]
        if len(sentences) > 1:
            wholes.add((a, b))
            if n_words(a, b) >= rules.min_words:
                out.append((a, b))
    found = set()
    for i, (a, b) in enumerate(pieces):
        if n_words(a, b) < rules.min_words:
            for ends in ([(i, j) for j in range(i, len(pieces))], [(j, i) for j in range(i, -1, -1)]):
                for x, y in ends:
                    if sum(n_words(*pieces[z]) for z in range(x, y + 1)) >= rules.min_words:
                        found.add((pieces[x][0], pieces[y][1]))
                        break
    return [(a, b, " ".join(text[a:b].lower().split())) for a, b in out + sorted(found - wholes)]


@pytest.mark.parametrize("rules", [UnitRules(min_words=5), UnitRules(), UnitRules(unit="paragraph", sentences=False, min_words=2)])
def test_unit_dedup(docs, empty, rules):
    units = plain_units
    got = unit_dedup(docs, rules).select("row.doc_id", "row.text", "n_units_removed", "n_chars_removed", "kept").collect()
    own = docs.select("doc_id", "text").collect()
    low = lambda i: (i is not None, i)
    first, count = {}, Counter()
    for i, t in own:
        for a, _, norm in units(t or "", rules):
            count[norm] += 1
            first[norm] = min(first.get(norm, (low(i), a)), (low(i), a))
    want = Counter()
    for i, t in own:
        t = t or ""
        gone = {(a, b) for a, b, norm in units(t, rules) if count[norm] > 1 and first[norm] != (low(i), a)}
        hit = {k for a, b in gone for k in range(a, b)}
        want[(i, len(gone), len(hit), "".join(c for k, c in enumerate(t) if k not in hit))] += 1
    assert Counter((r["doc_id"], r["n_units_removed"], r["n_chars_removed"], r["kept"]) for r in got) == want
    assert unit_dedup(empty, rules).count() == 0


def test_unit_dedup_finds_a_passage_inside_a_line(docs):
    got = unit_dedup(docs).select("row.doc_id", "row.text", "n_chars_removed").collect()
    assert sum(r["n_chars_removed"] > 100 for r in got) >= 2


def test_piece_transducer_equals_the_library(docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    fst = PieceTransducer(PieceModel.parse(open(PIECES, "rb").read()))
    rng = random.Random(2)
    pool = [*"  \n\tabcdethinogérü-.,1230'\"", "𝒳", "▁", "the", "ing", " the ", "    ", "\x00", "日本"]
    cases = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 50))) for _ in range(1500)] + [t for t in texts() if t]
    for s in cases:
        codes = fst.encode(s)
        assert np.frombuffer(codes, "<u4").tolist() == sp.encode(s), s
        assert fst.decode(codes) == sp.decode(sp.encode(s))
    rows = piece_codes(docs, PIECES).collect()
    assert len(rows) == docs.count() and all(r["round_trip"] for r in rows)
    assert piece_codes(empty, PIECES).count() == 0


def test_word_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    encode, rng = encoder(BPE), random.Random(3)
    pool = [*"  \n\n\tabc'.,12", "\r", "don't", " 'll", "\x1c", "!!", "<|endoftext|>", "été", "日本", "　"]
    for s in ["".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(3000)]:
        assert np.frombuffer(encode(s), "<u4").tolist() == tok.encode(s, add_special_tokens=False).ids, s


def test_latin_texts_are_encoded_whole(monkeypatch):
    from tokenizers import Tokenizer

    from wayglass.llm import packing

    tok, encode, rng = Tokenizer.from_file(BPE), encoder(BPE), random.Random(8)
    kinds = [f.format(chr(c)) for c in range(0x250) for f in ("{0}", "a{0}b", " {0}", "{0}{0}", "1{0}2", "\n{0}", "'{0}", "{0}'s", "x {0}x")]
    few = [[*map(chr, rng.sample(range(0x250), 5)), *" \n'sa1."] for _ in range(2000)]
    for s in [*kinds, *("".join(rng.choice(x) for _ in range(rng.randint(1, 30))) for x in few)]:
        assert np.frombuffer(encode(s), "<u4").tolist() == tok.encode(s, add_special_tokens=False).ids, s
    # no word of such a text is looked up, words of other texts are
    missed = []
    monkeypatch.setattr(packing.WordCache, "__missing__", lambda self, w: missed.append(w) or np.array(self.encode(" " + w), "<u4").tobytes())
    encode = encoder(BPE)
    for s in ("been there, été œuvre ŵ", "ab été 日本 cd"):
        assert np.frombuffer(encode(s), "<u4").tolist() == tok.encode(s, add_special_tokens=False).ids
    assert missed == ["été", "日本", "cd"]


def test_word_cache_is_bounded_in_bytes():
    from wayglass.llm import packing

    cache = packing.WordCache(lambda w: [1] * len(w))
    for k in range(20_000):
        cache[f"{k:01000d}"]
        assert cache.size <= packing.CACHE_BYTES + 10_000 and sum(map(len, cache.values())) <= packing.CACHE_BYTES + 10_000 if k % 997 == 0 else True
    assert len(cache["y" * 2000]) == 4 * 2001 and "y" * 2000 not in cache


def test_best_fit_against_a_scan():
    rng = random.Random(4)
    lengths = [rng.randint(1, 100) for _ in range(400)]
    where, offset, n = best_fit(lengths, 100)
    rooms, want = [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [r for r in rooms if r >= lengths[i]]
        if fits:
            rooms[rooms.index(min(fits))] -= lengths[i]
        else:
            rooms.append(100 - lengths[i])
        want[i] = len(rooms)
    assert n == len(rooms)
    used = Counter()
    for w, o, x in sorted(zip(where, offset, lengths, strict=True)):
        assert o == used[w]
        used[w] += x
    assert max(used.values()) <= 100
    tree = OpenWindows(10)
    tree.put(3, 1)
    assert tree.tightest(4) is None and tree.tightest(2) == (3, 1) and tree.tightest(1) is None


@pytest.mark.parametrize("block", [8_000_000, 2000])
def test_packing_keeps_every_token(docs, empty, block):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    rows = pack(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).coalesce(1), BPE, block_tokens=block).collect()
    own, seqs = by_id(rows), defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append(r)
    for i, t in {(r["doc_id"], r["text"]) for r in docs.filter("doc_id is not null").collect()}:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        pieces = sorted(own[i], key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in pieces) == np.array(ids, "<u4").tobytes()
        assert {r["doc_tokens"] for r in pieces} == {len(ids)}
    total = 0
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
        total += at
    assert total > 0.9 * 1024 * (len(seqs) - 1)
    assert pack(empty, BPE).count() == 0
    assert pack(docs, BPE, digest=True).count() >= docs.count()


def test_toxicity(spark, docs, empty):
    rng = random.Random(6)
    say = lambda n: " ".join(rng.choice(["stone", "river", "walks", "north", "lamp"]) for _ in range(n))
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 2
        rows.append((i, say(30) + (" you grubwort " + rng.choice(["idiot", "vexling", "moron"]) if toxic else "") + " " + say(30)))
        labels.append((i, 1, int(toxic)))
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1, 1), (5, None, None), (10**6, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity(d, y).select("row.doc_id", "score", held_out(F.col("row.doc_id")).alias("held")).collect()
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    right = [(r["score"] >= 0.5) == (r["doc_id"] % 5 == 2) for r in out if r["held"]]
    assert np.mean(right) > 0.98
    model = fit_toxicity(d, y)
    fired = {w: k for k, w in enumerate(toxicity_module.WORDS)}["idiot"] + 2
    assert model.label_model.on_toxic[fired] > 10 * model.label_model.on_clean[fired]
    assert "=grubwort" in model.added and model.weights["=grubwort"] > 0
    # of repeated rows one stands for a doc_id, of conflicting labels the toxic one holds
    twice = training_rows(d.unionByName(d), y.unionByName(y.withColumn("toxic", F.lit(0))), ToxicityRules(sample_toxic=50, sample_clean=60)).collect()
    assert Counter(r["label"] for r in twice) == {1: 50, 0: 60} and len({r["id"] for r in twice}) == 110
    long_ = model.scorer()("stone " * 200_000 + "grubwort idiot")
    assert long_ > 0.5
    assert toxicity(docs, y).count() == docs.count()
    none = toxicity(docs, y.limit(0)).select("score").distinct().collect()
    assert [r["score"] for r in none] == [0.0]
    assert toxicity(empty, y).count() == 0


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1/labels.parquet"), reason="needs the generated tables")
def test_toxicity_on_held_out_rows(spark):
    d, y = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity(d, y).select("row.doc_id", "score").filter(held_out(F.col("doc_id"))).join(y, "doc_id").filter("toxic is not null").toPandas()
    rank, toxic = out["score"].rank().to_numpy(), out["toxic"].to_numpy() == 1
    area = (rank[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / toxic.sum() / (~toxic).sum()
    hit = out["score"].to_numpy() >= 0.5
    assert area >= 0.966 and hit[toxic].mean() >= 0.907 and hit[~toxic].mean() < 0.01


def brute_pii(s):
    """By the plain patterns of the contract and a Luhn sum written apart."""

    def card(m):
        d = [int(c) for c in m if c in "0123456789"]
        odd, even = d[::-1][::2], d[::-1][1::2]
        return 16 <= len(d) <= 19 and (sum(odd) + sum(sum(divmod(2 * x, 10)) for x in even)) % 10 == 0

    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", card),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= sum(c.isdigit() for c in m) <= 15),
    }
    return {k: [m.span() for m in re.finditer(p, s) if ok(m.group())] for k, (p, ok) in kinds.items()}


def test_pii_base_against_the_plain_patterns(spark):
    rng = random.Random(18)
    pool = ["4539578763621486", "4539 5787 6362 1486", "4539-5787-6362-1487", "1.2.3.4", "1.2.3.4.5.6.7.8.9", "256.1.1.1", "0001.2.3.4", "+1 (372) 555-7739", "a.b@c.example", "@", ".", " ", "-", "7", "12345678901234567890", "x", "é", "\n"]
    cases = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 9))) for _ in range(1500)] + [None, ""]
    rows = {r["row"]["doc_id"]: r["found"] for r in pii(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()}
    seen = Counter()
    for i, s in enumerate(cases):
        base = brute_pii(s or "")
        assert base == dict(zip(("email", "ip", "card", "phone"), map(list, base_spans(s or "")), strict=True))
        plain = ",".join(f"{k}:{a}:{b}" for k in base for a, b in base[k])
        found = rows[i]
        assert [found[f"n_{k}"] for k in base] == [len(v) for v in base.values()]
        assert found["base_sha256"] == hashlib.sha256(plain.encode()).hexdigest()
        every = [x for x in found["spans"].split(",") if x]
        assert every[: plain.count(":") // 2] == [x for x in plain.split(",") if x]
        assert len(every) == plain.count(":") // 2 + found["n_added"]
        taken = [s_ for v in base.values() for s_ in v]
        for x in every[plain.count(":") // 2 :]:
            _, a, b = x.split(":")
            assert all(int(b) <= p or q <= int(a) for p, q in taken)
        seen.update({k: len(v) for k, v in base.items()})
    assert min(seen.values()) > 100


def test_pii_is_linear_in_very_long_texts():
    import time

    from wayglass.llm.pii import Decoder, Field, find_all, labelled_table

    decoder = Decoder(Field.fit(labelled_table()))
    for s in ("1" * 1_000_000 + ".", "1." * 500_000, "+" * 1_000_000, "a" * 1_000_000 + "@", "1 " * 500_000):
        began = time.perf_counter()
        assert len(list(find_all([s], decoder))) == 1
        assert time.perf_counter() - began < 4, s[:5]


def test_pii(docs, empty):
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= sum(c.isdigit() for c in m) <= 15),
    }
    rng = random.Random(8)
    for s in ["".join(rng.choice("ab.@- %é1+2()") for _ in range(rng.randint(0, 40))) for _ in range(4000)] + [t or "" for t in texts()]:
        base = dict(zip(("email", "ip", "card", "phone"), base_spans(s), strict=True))
        for k, (p, ok) in kinds.items():
            assert base[k] == [m.span() for m in re.finditer(p, s) if ok(m.group())], (k, s)
    out = pii(docs, redact=True)
    assert out.count() == docs.count() and pii(empty).count() == 0
    hit = [r for r in out.select("found.*").collect() if r["n_email"]]
    assert len(hit) == 1 and hit[0]["n_card"] == hit[0]["n_phone"] == hit[0]["n_ip"] == 1
    assert hit[0]["redacted"] == "mail [email] or [phone], card [card] at [ip]."


def test_pii_field_and_exact_pruning():
    from wayglass.llm.pii import LABELS, Decoder, Field, find_all, labelled_table, word_signs

    model = Field.fit(labelled_table())
    decoder = Decoder(model)
    test = labelled_table(3, seed=99)
    right = total = 0
    zero = np.zeros(len(LABELS))
    for words_, labels in test:
        got = [0] * len(words_)
        for k, a, b in decoder.decode([words_])[0]:
            for i in range(a, b + 1):
                got[i] = k
        # plain Viterbi over all words, without the stretches
        signs = [["edge"], *[word_signs(w) for w in words_], ["edge"]]
        e = [sum((model.weights.get(p + s, zero) for p, j in (("0", i), ("-", i - 1), ("+", i + 1)) if 0 <= j < len(signs) for s in signs[j]), zero) for i in range(len(signs))]
        best, back = np.where(np.arange(len(LABELS)) == 0, e[0], -1e9), []
        for i in range(1, len(e)):
            way = best[:, None] + model.moves
            back.append(way.argmax(0))
            best = way.max(0) + e[i]
        at, path = 0, []
        for b in reversed(back):
            path.append(at)
            at = b[at]
        assert got == path[::-1][: len(words_)]
        right += sum(a == b for a, b in zip(got, labels, strict=True))
        total += len(labels)
    assert right / total > 0.97
    found = [a for _, a in find_all(["Call 555-123-4567 now", "plain words, and no more", "ssn 123-45-6789."], decoder)]
    assert found == [[("national_phone", 5, 17)], [], [("identity", 4, 15)]]


def test_pii_new_words_cost_little():
    import cProfile
    import pstats

    from wayglass.llm.pii import Decoder, Field, labelled_table

    rng = random.Random(21)
    new = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(9, 12))) + rng.choice(["", ",", "."]) for _ in range(20_000)]
    assert len(set(new)) > 19_990
    decoder = Decoder(Field.fit(labelled_table()))
    profile = cProfile.Profile()
    assert profile.runcall(decoder.decode, [new, new[:10]]) == [[], []]
    assert pstats.Stats(profile).total_calls < 20 * len(new)  # 69 a word when each new one went through all the signs


def test_pii_one_form_for_words_with_the_same_signs():
    from wayglass.llm.pii import CUES, word_form, word_signs

    def plain(word):
        core = word.strip("\"'`.,;:!?#*$%&|<>[]{}")
        shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", "a", re.sub(r"[0-9]", "9", core)))
        digits, n = sum(c in "0123456789" for c in core), len(core)
        signs = [f"s={shape[:12]}", f"d={digits if digits < 5 else 5 if digits == 5 else 6 if digits < 9 else 9 if digits < 12 else 12}", f"l={n if n < 4 else 4 if n < 16 else 16}"]
        signs += ["plain" if core.isalpha() or not core else "marked"] * (digits == 0)
        signs += ["keylike"] * bool(n >= 16 and digits >= 3 and re.fullmatch(r"[0-9A-Za-z_-]+", core) and re.search("[A-Za-z]", core))
        signs += [k for p, k in ((r"\([0-9]{3}\)", "area"), (r"[0-9]{3}-[0-9]{4}", "local"), (r"[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}", "national"), (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "identity")) if re.fullmatch(p, core)]
        low = core.lower().rstrip("=:")
        return signs + [f"cue={CUES.get(low)}"] * (low in CUES) + ["joint"] * (core in ("=", ":", ""))

    rng = random.Random(22)
    pool = [*"abzAZ0199--_..()=:,\"'#é²٣İKßя½’中\x85\xa0\x1c", "token", "Key", "123-45-6789", "212-555-1234", "555-1234", "(212)", "API_key", "tel", "0af3" * 4]
    for _ in range(20_000):
        word = "".join(rng.choice(pool) for _ in range(rng.choice((1, 2, 3, 6, 20))))
        assert word_signs(word) == plain(word) == word_signs(word_form(word)), word


def brute_components(rows, n, percent):
    sets = []
    for _, t in rows:
        w = [x.lower() if x.isascii() else x.encode().lower().decode() for x in words(t)]
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(rows[a][0]), find(rows[b][0])
                up[max(x, y)] = min(x, y)
    return Counter((i, len(s), find(i)) for (i, _), s in zip(rows, sets, strict=True))


@pytest.mark.parametrize("rules", [JaccardRules(), JaccardRules(block=5, leaf=2), JaccardRules(n=5, percent=80), JaccardRules(block=7, frequent_least=2, frequent_share=0.1), JaccardRules(frequent_most=3)])
def test_jaccard_components(spark, docs, empty, rules):
    rng = random.Random(9)
    base = [rng.choice("abcdefghijklmnop") * 3 + str(rng.randint(0, 400)) for _ in range(220)]
    rows = [(i, t) for i, t in enumerate(texts())]
    for k in range(40):
        w = list(base)
        for j in range(k % 9):
            w[rng.randrange(len(w))] = f"new{rng.random()}"
        rows.append((100 + k, " ".join(w)))
    got = Counter((r["id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), rules).collect())
    assert got == brute_components(rows, rules.n, rules.percent)
    assert jaccard_components(docs, rules).count() == docs.count()
    assert {r["component_id"] for r in jaccard_components(docs.filter("doc_id is null"), rules).collect()} == {None}
    assert jaccard_components(empty, rules).count() == 0


def shuffled_bytes(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_"))


def test_keys_of_the_join_travel_packed(spark):
    from wayglass.llm.signature_join import BUCKETS, candidate_links, packed, unpacked

    rng = np.random.default_rng(4)
    keys, classes = np.sort(rng.integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2)), rng.integers(0, 2**40, 5000)
    rows = packed(keys, classes, BUCKETS)
    assert rows["bucket"].is_monotonic_increasing and rows["bucket"].is_unique and 0 <= rows["bucket"].min() and rows["bucket"].max() < BUCKETS
    k, c = unpacked(rows["keys"].tolist())
    assert (k.view(np.uint64) == keys & np.uint64(2**48 - 1)).all() and (c == classes).all()
    # documents without near copies: all that is shuffled are their keys, and they come to less than the 16 bytes that a key and its class take
    texts = [" ".join(map(str, rng.integers(0, 10**9, 1500))) for _ in range(500)]
    n = sum(len(part_keys(Shingler(5).set_of(t), 80)) for t in texts)
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    before = shuffled_bytes(spark)
    assert candidate_links(docs, JaccardRules(n=5, percent=80), text="text").count() == 0
    assert 0 < shuffled_bytes(spark) - before < 13 * n
    # and the files of such a shuffle go once its links are there
    spark.range(100_000).selectExpr("id", "uuid() AS u").repartition(4, "id").agg({"u": "max"}).collect()
    assert components(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")).count() == 3
    for _ in range(100):
        if shuffled_bytes(spark) < 8 * n:
            break
        time.sleep(0.2)
    assert shuffled_bytes(spark) < 8 * n


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(3)
    for size in (1, 2, 8, 9, 10, 11, 19, 20, 57, 400, 3000):
        for _ in range(30):
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            cut = rng.integers(0, len(a) // 10 + 1)
            b = np.unique(np.r_[a[cut:], rng.integers(0, 2**63, rng.integers(0, len(a) // 10 + 2)).astype(np.uint64)])
            both = len(np.intersect1d(a, b))
            if 100 * both >= 90 * (len(a) + len(b) - both):
                assert len(np.intersect1d(part_keys(a, 90), part_keys(b, 90)))
    assert bands(10, 90)


def test_tree_join_against_all_pairs():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**40, 60).astype(np.uint64))]
    for _ in range(80):
        s = sets[rng.integers(0, len(sets))].copy()
        s[rng.integers(0, len(s), rng.integers(0, 5))] = rng.integers(0, 2**40)
        sets.append(np.unique(s))
    rules = JaccardRules(leaf=3)
    links = TreeJoin(sets, rules).run()
    near = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 90 * len(np.union1d(a, b))
    assert all(near(sets[a], sets[b]) for a, b in links)

    def roots(pairs):
        up = list(range(len(sets)))

        def find(x):
            return x if up[x] == x else find(up[x])

        for a, b in pairs:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
        return [find(i) for i in range(len(sets))]

    assert roots(links) == roots([(a, b) for a in range(len(sets)) for b in range(a) if near(sets[a], sets[b])])
    assert len(Shingler(3).set_of("")) == 0 and len(Shingler(3).set_of("a b")) == 1


@pytest.mark.parametrize("rules", [SuffixRules(), SuffixRules(bucket=2, chunk=700, block=9000), SuffixRules(bucket=3, widths=(64, 1))])
def test_suffix_dedup(docs, empty, rules):
    own = [r["text"] or "" for r in docs.select("text").collect()]
    seen = Counter(t[s : s + 200] for t in (x.encode() for x in own) for s in range(len(t) - 199))
    want = Counter()
    for x in own:
        t = x.encode()
        mark = bytearray(len(t))
        for s in range(len(t) - 199):
            if seen[t[s : s + 200]] > 1:
                mark[s : s + 200] = b"\1" * 200
        kept = bytes(c for c, m in zip(t, mark, strict=True) if not m)
        want[(len(t), sum(mark), sum(1 for k, m in enumerate(mark) if m and (not k or not mark[k - 1])), kept)] += 1
    got = suffix_dedup(docs, rules).collect()
    assert Counter((r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == want
    assert suffix_dedup(empty, rules).count() == 0


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(160)] + [(k, k + 1) for k in range(1000, 1060)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up}


def test_pipeline_stages(spark, docs, empty, tmp_path):
    import corpus_pipeline as cp

    labels = [(i, 1, int(i % 7 == 0)) for i in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for start in (docs, empty):
        own = start
        for name, stage in cp.STAGES:
            out = stage(spark, own, str(tmp_path))
            if name != cp.STAGES[-1][0]:
                assert out.dtypes == own.dtypes
            else:
                break
            out.write.parquet(str(tmp_path / f"{name}{start is docs}"))
            own = spark.read.parquet(str(tmp_path / f"{name}{start is docs}"))
        assert (out.count() > 0) == (start is docs)


def test_pipeline_drops_near_copies_at_five_words(spark):
    import corpus_pipeline as cp

    base = [f"w{k}" for k in range(100)]
    two = [*base[:30], "new", *base[31:70], "other", *base[71:]]  # 0.811 on five words, 0.885 on three
    many = [("new" if k % 9 == 4 else x) for k, x in enumerate(base)]
    rows = [(i, t) for i, t in enumerate([" ".join(w) for w in (base, two, many, base, many[:97])] + [None, "", "one", "one"])]
    assert [i for i, _, c in sorted(brute_components(rows, 5, 80)) if i != c] == [1, 3, 4, 8]
    got = cp.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in got if r["text"]) == sorted((i, t) for i, t in rows if t and i in (0, 2, 7))
    assert {r["doc_id"] for r in got} == {i for i, _, c in brute_components(rows, 5, 80) if i == c}


def test_unit_dedup_finds_passages_of_short_units(spark):
    rng = random.Random(11)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    short = [say(4) + "." for _ in range(15)]
    inline, lines = " ".join(short), "\n".join(say(4) for _ in range(15))
    mixed = " ".join([say(3) + ".", say(20) + ".", say(2) + ".", say(20) + ".", say(1) + "."])
    rows = []
    for passage in (inline, lines, mixed):
        rows += [say(20) + ". " * (passage is not lines) + "\n" * (passage is lines) + passage + ("\n" if passage is lines else " ") + say(20) + "." for _ in range(2)]
    rows += [say(9) + ". See above. " + say(9) + "." for _ in range(3)] + ["See above."] * 2  # lone short sentences
    got = {r["doc_id"]: r for r in unit_dedup(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).select("row.doc_id", "kept").collect()}
    for k, passage in enumerate((inline, lines, mixed)):
        assert got[2 * k]["kept"] == rows[2 * k]
        assert not set(passage.split()) & set(got[2 * k + 1]["kept"].split())
        assert len(got[2 * k + 1]["kept"].split()) == 40
    assert all(got[i]["kept"] == rows[i] for i in range(6, len(rows)))


def test_linked_sets_share_a_key_at_80():
    rng = np.random.default_rng(13)
    for size in (1, 2, 5, 6, 9, 10, 19, 20, 57, 400, 3000):
        for _ in range(60):
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            cut = rng.integers(0, len(a) // 5 + 1)
            b = np.unique(np.r_[a[cut:], rng.integers(0, 2**63, rng.integers(0, len(a) // 5 + 2)).astype(np.uint64)])
            both = len(np.intersect1d(a, b))
            if 100 * both >= 80 * (len(a) + len(b) - both):
                assert len(np.intersect1d(part_keys(a, 80), part_keys(b, 80)))


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_key_without_their_frequent_elements(percent):
    rng = np.random.default_rng(15)
    frequent = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    for share in (0.0, 0.5, 0.9, 1.0):
        for size in (3, 20, 57, 280):
            for _ in range(40):
                n = min(int(size * share), len(frequent))
                a = np.unique(np.r_[rng.choice(frequent, n, replace=False), rng.integers(0, 2**63, size - n).astype(np.uint64)])
                gone = rng.random(len(a)) < rng.random() * (100 - percent) / 100
                b = np.unique(np.r_[a[~gone], rng.integers(0, 2**63, rng.integers(0, size // 9 + 2)).astype(np.uint64)])
                both = len(np.intersect1d(a, b))
                if len(b) and 100 * both >= percent * (len(a) + len(b) - both):
                    assert len(np.intersect1d(part_keys(a, percent, frequent), part_keys(b, percent, frequent)))


def test_sets_that_share_a_frequent_passage_only_share_no_key():
    rng = np.random.default_rng(16)
    passage = np.unique(rng.integers(0, 2**63, 80).astype(np.uint64))
    sets = [np.unique(np.r_[passage, rng.integers(0, 2**63, 320).astype(np.uint64)]) for _ in range(100)]
    most = lambda frequent: max(Counter(k for s in sets for k in set(part_keys(s, 80, frequent).tolist())).values())
    assert most(passage) == 1 < most(None)


def test_unlike_sets_share_few_keys():
    rng = np.random.default_rng(14)
    keys = Counter(k for _ in range(300) for k in set(part_keys(rng.integers(0, 2**63, 400).astype(np.uint64), 80).tolist()))
    assert max(keys.values()) == 1


def test_pipeline_run_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline as cp

    rng = random.Random(21)
    say = lambda n: " ".join(rng.choice(["stone", "river", "walks", "north", "lamp", "of", "the"]) for _ in range(n))
    toxic = set(range(2, 200, 5))
    texts_ = {i: say(30) + (" you grubwort " + rng.choice(["idiot", "vexling", "moron"]) + " " if i in toxic else " ") + say(30) for i in range(200)}
    for i in range(0, 60, 5):
        texts_[i] += "\nAll rights reserved here."
    base = [f"w{k}" for k in range(100)]
    texts_ |= {300: " ".join(base), 303: " ".join([*base[:30], "new", *base[31:70], "other", *base[71:]]), 305: "mail a.b@c.example or +1 (372) 555-7739, card 4539578763621486 at 10.20.30.40."}
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts_.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    left = dict(kept_lines([(i, t) for i, t in texts_.items() if i not in toxic], 10))
    assert "\nAll rights" not in "".join(t for _, t in left)
    gone = {i for i, _, c in brute_components(sorted(left), 5, 80) if i != c}
    assert gone == {303}
    want = {i: t for i, t in left if i not in gone}
    want[305] = "mail [email] or [phone], card [card] at [ip]."
    tok = Tokenizer.from_file(BPE)
    got = by_id(cp.run(spark, str(tmp_path)).collect())
    assert set(got) == set(want)
    for i, t in want.items():
        ids = tok.encode(t, add_special_tokens=False).ids + [0]
        assert b"".join(bytes(r["ids"]) for r in sorted(got[i], key=lambda r: r["start"])) == np.array(ids, "<u4").tobytes()
