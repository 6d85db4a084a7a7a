"""Each training-data operator against a brute-force version, on texts with nulls, blanks, ties, repeats and clashing columns."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ctxloom.llm import anchors, graph_index, lines, lm, mixing, order_minhash, packing, passages, simhash, tokens, toxicity
from ctxloom.llm.blocks import Block, squeeze
from ctxloom.llm.components import connected_components
from ctxloom.llm.shared import Scratch
from ctxloom.llm.suffixes import deep_shallow_sort

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, line string, size int, component_id long, bucket int"
WORDS = ["alpha", "beta", "the", "of", "Gamma", "étude", "x", "delta-", "epsilon", "zeta", "日本", "theta"]


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", low(t or ""))


def some_texts(seed=3, n=70):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        body = [" ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(rng.randrange(3, 40))) for _ in range(rng.randrange(1, 5))]
        out.append("\n".join(body))
    long = " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(6000))
    out += [out[0], out[0], out[1] + " tail", out[2].replace("the", "thy"), out[3][:-3] + "zzz", "", None, " \t\n", "\x00\x00" * 40, "a" * 300, "a" * 301, long, long + " more", out[5] + "\n" + out[6], "x\n\n" + out[7], "😀" * 70 + "z", "<|endoftext|> a"]
    return out


@pytest.fixture(scope="module")
def texts():
    return dict(enumerate(some_texts(), start=-3))


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or ""), 1.0, "l", 1, 5, 2) for i, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark, texts):
    """Repeated rows and null ids."""
    rows = [(i, texts[0], "en", "s", 1, None, None, None, None, None) for i in (7, 7, None, None, 9)]
    return spark.createDataFrame(rows, SCHEMA)


class Sets:
    def __init__(self, xs):
        self.of = {x: x for x in xs}

    def top(self, x):
        while self.of[x] != x:
            x = self.of[x]
        return x

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self.of[max(a, b)] = min(a, b)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 500)] + [(600, k) for k in range(601, 700)] + [(1, 1), (None, 2)]
    sets = Sets(range(800))
    for a, b in edges:
        if a is not None:
            sets.join(a, b)
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "src long, dst long"), Scratch(spark, "t")).collect()))
    linked = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert got == {x: sets.top(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "src long, dst long"), Scratch(spark, "t")).count() == 0


# ---- 1 ----


def test_nearest(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(1500, 12)).astype(np.float32)
    v *= rng.uniform(0.5, 2, size=(1500, 1)).astype(np.float32)
    v[200:500] = v[200]  # a common vector
    rows = [(k, [float(y) for y in x]) for k, x in enumerate(v)] + [(5000, None), (5001, [0.0] * 12), (5002, [float("nan")] + [1.0] * 11), (5003, [None] + [1.0] * 11), (5020, [1.0, 2.0]), (5040, [2.0, 1.0]), (5060, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("score", F.lit("x"))
    got = {}
    for r in graph_index.nearest(df, df.where("vec_id % 20 = 0"), shard_rows=900).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    exact, found = v.astype(np.float64), []
    for q in range(0, 1500, 20):
        s = exact @ exact[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(1500), -s))[:20]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 21)) and len({x for _, x, _ in mine}) == 20
        assert all(abs(sc - s[x]) < 1e-9 for _, x, sc in mine) and [(-sc, x) for _, x, sc in mine] == sorted((-sc, x) for _, x, sc in mine)
        found.append(len({x for _, x, _ in mine} & set(best.tolist())) / 20)
    assert np.mean(found) >= 0.95
    assert sorted(got[5020]) == [(1, 5040, 4.0)] and 5000 not in got and 5060 not in got
    assert graph_index.nearest(df.limit(0), df.limit(0)).count() == 0


def test_prune_against_brute_force():
    rng = np.random.default_rng(4)
    pts = graph_index.lifted(rng.normal(size=(200, 8)))
    proposed = rng.integers(-1, 200, size=(30, 40))
    got = graph_index.robust_prune(pts, np.arange(30), proposed, 6, 1.2)
    far = lambda a, b: max(0.0, 2 - 2 * float(pts[a] @ pts[b]))
    for p in range(30):
        left = sorted({int(x) for x in proposed[p] if x >= 0 and x != p}, key=lambda x: far(p, x))
        kept = []
        while left and len(kept) < 6:
            kept.append(left[0])
            left = [x for x in left[1:] if 1.2 * 1.2 * far(kept[-1], x) > far(p, x)]
        assert [x for x in got[p] if x >= 0] == kept


@pytest.mark.parametrize("kind", ["clustered", "isotropic"])
def test_graphs_find_nearest(spark, kind):
    """Three shards of 1,700 vectors each, their queries in blocks: recall against brute force."""
    rng = np.random.default_rng(5)
    n, of = 5100, 48
    v = rng.normal(size=(n, of))
    if kind == "clustered":
        v = v * 0.3 + rng.normal(size=(60, of))[rng.integers(0, 60, n)]
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in graph_index.nearest(df, df.where("vec_id % 20 = 0"), shard_rows=1700, query_block=100).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    near = v[::20] @ v.T
    near[np.arange(len(near)), np.arange(0, n, 20)] = -np.inf
    found = [len(got[20 * k] & set(np.argsort(-x)[:20].tolist())) / 20 for k, x in enumerate(near)]
    assert len(got) == 255 and {len(x) for x in got.values()} == {20} and np.mean(found) >= 0.9


def test_nearest_of_repeated_rows_and_ties(spark, monkeypatch):
    rows = [(k, [1.0, float(k % 3)]) for k in range(90)]
    df = spark.createDataFrame(rows + rows[:30], "vec_id long, embedding array<double>")
    got = {}
    for r in graph_index.nearest(df, df.where("vec_id % 20 = 0"), k=35, shard_rows=2).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for q, mine in got.items():
        want = sorted((x for x in range(90) if x != q), key=lambda x: (-(1 + (q % 3) * (x % 3)), x))[:35]
        assert [x for _, x in sorted(mine)] == want


# ---- 2 ----


def check_pack(rows, texts, capacity=2048):
    engine = Tokenizer.from_file(PATH)
    of, seq = {}, {}
    for r in rows:
        of.setdefault(r["doc_id"], []).append(r)
        seq.setdefault(r["sequence_id"], []).append(r)
    total = 0
    for i, t in texts.items():
        ids = engine.encode(t or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        at = 0
        for k, p in enumerate(sorted(of[i], key=lambda p: p["piece"])):
            assert (p["piece"], p["start"]) == (k, at) and p["length"] <= capacity and (k == 0 or p["length"] == capacity)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids) and (len(of[i]) == -(-len(ids) // capacity))
    for s in seq.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
    return len(seq), -(-total // capacity)


def test_packing(docs, texts, odd, nothing):
    used, least = check_pack(packing.pack(docs, PATH).collect(), texts)
    assert used <= least + 1
    used, least = check_pack(packing.pack(docs, PATH, capacity=256, fan_in=2).collect(), texts, 256)
    assert used <= least * 1.03 + 1
    assert packing.pack(odd, PATH).count() == 5 and packing.pack(nothing, PATH).count() == 0


def test_packing_of_bins_that_nothing_fills(spark, monkeypatch):
    """More underfull bins than one task may hold, and no small pieces: rounds end, and the few pieces that fit are placed."""
    rng = random.Random(6)
    texts = {i: " ".join(["a"] * rng.randrange(34, 50)) for i in range(900)} | {1000 + i: " ".join(["a"] * 12) for i in range(5)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    keep, names = Scratch.keep, []

    def counted(self, df, name, small=False):
        names.append(name)
        assert len(names) < 12, "rounds do not end"
        return keep(self, df, name, small)

    monkeypatch.setattr(packing, "MOST_BINS", 50)
    monkeypatch.setattr(Scratch, "keep", counted)
    used, _ = check_pack(packing.pack(df, PATH, capacity=64).collect(), texts, 64)
    assert used == 900 and any(n.startswith("thin") for n in names)


# ---- 3 ----


def test_lines(spark, docs, texts, odd, nothing):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefghij klmno") for _ in range(rng.choice([30, 90, 200, 400, 900]))) for _ in range(40)]
    more = {100 + k: "\n".join([base[k % 40], base[(k * 7) % 40][:-2] + "Zz", "short", "", "  " + base[(k * 3) % 40].upper() + " "]) for k in range(60)}
    rows = [(i, t, *[None] * 8) for i, t in (texts | more).items()]
    got = {(r["doc_id"], r["line_no"]): r for r in lines.line_classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    every = {(i, k): x.strip(" ").lower() for i, t in (texts | more).items() for k, x in enumerate((t or "").split("\n"))}
    assert set(got) == set(every)
    long = {p: x for p, x in every.items() if len(x) >= 20}
    names = sorted(set(long.values()))
    shingles = {x: {x[i : i + 8] for i in range(len(x) - 7)} for x in names}
    sets = Sets(range(len(names)))
    for a in range(len(names)):
        for b in range(a):
            s, u = shingles[names[a]], shingles[names[b]]
            if len(s & u) / len(s | u) >= 0.8:
                sets.join(a, b)
    first, place = {}, {x: k for k, x in enumerate(names)}
    for p in sorted(long):
        first.setdefault(sets.top(place[long[p]]), p)
    assert all(got[p]["kept"] == (p not in long or first[sets.top(place[long[p]])] == p) for p in every)
    assert len({got[p]["class_id"] for p in long}) == len(first)
    assert {r["kept"] for r in lines.line_classes(odd).collect() if r["doc_id"] == 7} == {True} and lines.line_classes(nothing).count() == 0
    left = {r["doc_id"]: r for r in lines.without_repeats(docs).collect()}
    assert set(left[-3].asDict()) == set(SCHEMA.replace(",", "").split()[::2]) and left[-3]["text"] == texts[-3] and 67 not in left


@pytest.mark.parametrize("small", [0, 8])
def test_lines_beyond_a_connected_line(spark, monkeypatch, small):
    """A chain lead - x - v - w: v is connected to the lead through another bucket, w is more than 2 r from it."""
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    base, other = letters(807), letters(300)
    norms = {1: base} | {k: other[:n] + base[n:] for k, n in ((2, 60), (3, 135), (4, 206))}
    sets = {k: {x[i : i + 8] for i in range(len(x) - 7)} for k, x in norms.items()}
    d = lambda a, b: 1 - len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert max(d(1, 2), d(2, 3), d(3, 4)) <= 0.2 < d(1, 3) <= 0.4 < d(1, 4) <= 0.6 and d(2, 4) > 0.2
    texts = spark.createDataFrame([*norms.items()], "line long, norm string")
    members = spark.createDataFrame([(b, k, 9 if k == 1 else 1) for b, k in ((1, 1), (1, 2), (2, 2), (2, 3), (3, 1), (3, 3), (3, 4))], "band long, line long, n long")
    monkeypatch.setattr(lines, "SMALL", small)
    got = lines._components(members, texts, 0.8, Scratch(spark, "t")).collect()
    assert {r["node"]: r["component"] for r in got} == {1: 1, 2: 1, 3: 1, 4: 1}


def test_lines_of_a_family_against_brute_force(spark, monkeypatch):
    """One bucket of drifting copies, compared by leads and then by their differences: components as of all pairs."""
    rng = random.Random(12)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    norms, k = {}, 0
    for _ in range(3):
        of = letters(260)
        for _ in range(20):
            k += 1
            at = rng.randrange(len(of) - 40)
            norms[k] = of[:at] + letters(rng.randrange(5, 40)) + of[at + rng.randrange(30) :]
            if rng.random() < 0.4:
                of = norms[k]
    sets = {k: {x[i : i + 8] for i in range(len(x) - 7)} for k, x in norms.items()}
    want = Sets(norms)
    for a in norms:
        for b in range(1, a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                want.join(a, b)
    monkeypatch.setattr(lines, "SMALL", 0)
    monkeypatch.setattr(lines, "ROUNDS", 1)
    members = spark.createDataFrame([(0, k, 1 + k % 3) for k in norms], "band long, line long, n long")
    got = {r["node"]: r["component"] for r in lines._components(members, spark.createDataFrame([*norms.items()], "line long, norm string"), 0.8, Scratch(spark, "t")).collect()}
    assert {k: got.get(k, k) for k in norms} == {k: want.top(k) for k in norms} and len(set(map(want.top, norms))) > 6


def test_lines_of_a_family_that_share_few_differences(spark, monkeypatch):
    """Lines that change parts of one lead in the same ways, but seldom the same parts: few of the pairs that share a change are compared, and components are as of all pairs."""
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    parts, other = [letters(20) for _ in range(20)], [letters(20) for _ in range(20)]
    norms = {1: "".join(parts)}
    changed = [rng.sample(range(20), 6) for _ in range(70)]
    changed += [[*x, next(i for i in range(20) if i not in x)] for x in changed[:10]]
    for k, of in enumerate(changed, start=2):
        norms[k] = "".join(other[i] if i in of else x for i, x in enumerate(parts))
    sets = {k: {x[i : i + 8] for i in range(len(x) - 7)} for k, x in norms.items()}
    want = Sets(norms)
    for a in norms:
        for b in range(1, a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                want.join(a, b)
    compared, alike = [], lines._alike
    monkeypatch.setattr(lines, "_alike", lambda pairs, *rest: compared.append(pairs.count()) or alike(pairs, *rest))
    members = spark.createDataFrame([(0, k, 9 if k == 1 else 1) for k in norms], "band long, line long, n long")
    got = {r["node"]: r["component"] for r in lines._components(members, spark.createDataFrame([*norms.items()], "line long, norm string"), 0.8, Scratch(spark, "t")).collect()}
    assert {k: got.get(k, k) for k in norms} == {k: want.top(k) for k in norms} and len(set(map(want.top, norms))) <= len(norms) - 10
    assert sum(compared) < 10 * len(norms), compared


@pytest.mark.parametrize("on_driver", [0, 50_000])
def test_lines_of_one_passage_seldom_meet(spark, monkeypatch, on_driver):
    """Lines that share a passage and are else unlike all lack the lead's own text, but pairs of them do not meet in it; components are as of all pairs, whoever joins the links."""
    rng = random.Random(21)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    passage = letters(300)
    norms = {k: letters(48) + passage + letters(rng.randrange(8, 16)) for k in range(1, 81)}
    norms |= {k: norms[k - 80][:-3] + letters(10) for k in range(81, 101)}
    sets = {k: {x[i : i + 8] for i in range(len(x) - 7)} for k, x in norms.items()}
    want = Sets(norms)
    for a in norms:
        for b in range(1, a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                want.join(a, b)
    met, meetings = [], lines._meetings
    monkeypatch.setattr(lines, "_meetings", lambda *a: met.append(meetings(*a).count()) or meetings(*a))
    monkeypatch.setattr(lines, "MOST_LINKS", on_driver)
    members = spark.createDataFrame([(0, k, 9 if k == 1 else 1) for k in norms], "band long, line long, n long")
    got = {r["node"]: r["component"] for r in lines._components(members, spark.createDataFrame([*norms.items()], "line long, norm string"), 0.8, Scratch(spark, "t")).collect()}
    assert {k: got.get(k, k) for k in norms} == {k: want.top(k) for k in norms} and len(set(map(want.top, norms))) == 80
    assert met and sum(met) < 10 * len(norms), met


def test_a_line_is_signed_in_one_row(spark):
    """However many signatures and parts a line has: tables of several rows a line were the most that line dedup kept on disk."""
    rows = [(k, " ".join(f"word{k * j}" for j in range(n))) for k, n in enumerate((5, 20, 30, 39, 50, 70, 300), start=11)]
    found = lines._signed(lines._lines(spark.createDataFrame([*rows, *rows], "doc_id long, text string"), 20)).collect()
    assert sorted((r["min_doc"], r["n"]) for r in found) == [(k, 2) for k, _ in rows]
    assert all(4 <= len(set(r["bands"])) == len(r["bands"]) <= 16 for r in found)


@pytest.mark.parametrize("few", [0, 500_000])
def test_lines_are_read_again_from_one_place_each(spark, monkeypatch, few):
    """All lines are normalised twice, not a third time for the texts of candidates: each of these is read at one place, whatever ids repeat or are null."""
    rng = random.Random(31)
    base = ["".join(rng.choice("abcdefghij klmno") for _ in range(200)).strip() for _ in range(12)]
    rows = [(k % 5 if k % 7 else None, "\n".join([f"only here {k} {rng.random()} and nowhere else", "", base[k % 12].upper() + " ", base[(k * 5) % 12][:-2] + "zz"])) for k in range(40)]
    calls, read, line_rows, texts = [], [], lines._lines, lines._texts
    monkeypatch.setattr(lines, "_lines", lambda *a: calls.append(1) or line_rows(*a))
    monkeypatch.setattr(lines, "_texts", lambda *a: read.append((a[2].collect(), texts(*a).collect())) or texts(*a))
    monkeypatch.setattr(lines, "MOST_TEXTS", few)
    got = lines.line_classes(spark.createDataFrame([*rows, *rows[:9]], "doc_id long, text string")).where("class_id is not null").collect()
    assert len(calls) == 2
    (wanted, found), = read
    of = {r["line"]: r["norm"] for r in line_rows(spark.createDataFrame(rows, "doc_id long, text string"), 20).collect()}
    assert sorted(r["line"] for r in wanted) == sorted(r["line"] for r in found) and len(found) >= 24
    assert all(r["norm"] == of[r["line"]] for r in found)
    assert len({r["class_id"] for r in got}) == len(base) + len(rows)


@pytest.mark.parametrize("words_of_line", [4, 12, 22, 26, 36, 80, 300])
def test_lines_share_a_band(spark, words_of_line):
    """Of pairs at a likeness of 0.8 to 0.85, short, middle and long, nine of ten or more share a band."""
    rng = random.Random(words_of_line)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    pairs = []
    while len(pairs) < 300:
        a = [word() for _ in range(words_of_line)]
        b = list(a)
        while True:
            x, y = " ".join(a), " ".join(b).strip(" ")
            s, u = ({t[i : i + 8] for i in range(len(t) - 7)} for t in (x, y))
            j = len(s & u) / len(s | u)
            if j < 0.85 or len(x) < 20:
                break
            k = rng.randrange(len(b))
            b[k] = rng.choice([word(), b[k][:-1], b[k] + "s"])
        if 0.8 <= j < 1 and min(len(x), len(y)) >= 20:
            pairs.append((x, y))
    rows = [(2 * k + h, p[h]) for k, p in enumerate(pairs) for h in (0, 1)]
    found = lines._signed(lines._lines(spark.createDataFrame(rows, "doc_id long, text string"), 20)).select("min_doc", F.explode("bands").alias("band")).collect()
    of = {}
    for r in found:
        of.setdefault(r["min_doc"], set()).add(r["band"])
    assert sum(bool(of[2 * k] & of[2 * k + 1]) for k in range(300)) >= 270


def test_unlike_lines_seldom_share_a_band(spark):
    """Lines of frequent words that have nothing else in common: their buckets would grow with the square of the corpus."""
    rng = random.Random(17)
    parts = ["an", "th", "he", "er", "on", "tion", "re", "ha", "es", "ing", "st", "or"]
    often = ["the", "of", "and", "to", "in", "that", "is", "was", "for", "with"]
    word = lambda: rng.choice(often) if rng.random() < 0.5 else "".join(rng.choice(parts) for _ in range(rng.randrange(2, 5)))
    rows = [(k, " ".join(word() for _ in range(rng.randrange(32, 48)))) for k in range(2000)]
    bands = lines._signed(lines._lines(spark.createDataFrame(rows, "doc_id long, text string"), 20)).select("line", F.explode("bands").alias("band")).distinct()
    pairs = bands.groupBy("band").count().agg(F.sum(F.expr("count * (count - 1) div 2"))).first()[0]
    assert pairs <= 40


# ---- 4 ----


def test_toxicity_learns_and_keeps_clean_texts(spark, nothing):
    rng = random.Random(2)
    neutral = [f"w{k}" for k in range(300)]

    def make(i):
        t = [rng.choice(neutral) for _ in range(rng.randrange(20, 300))]
        if i % 6 == 0:
            for _ in range(max(3, len(t) // 15)):
                t.insert(rng.randrange(len(t)), rng.choice(["Vile", "nasty!", "awful"]))
        return " ".join(t)

    rows = [(i, make(i)) for i in range(900)] + [(901, ""), (902, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(900)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model, passages="found").collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((got[i]["toxicity"] >= 0.5) == (i % 6 == 0) for i in held) and got[901]["toxicity"] < 0.5 and got[902]["toxicity"] == got[901]["toxicity"]
    span = got[0]["found"][0]
    assert re.search("(?i)vile|nasty|awful", rows[0][1].encode()[span["start"] : span["stop"]].decode()) and not got[1]["found"]
    assert toxicity.score(nothing.drop("score"), model).count() == 0
    blank = toxicity.train(docs, labels.limit(0))
    assert {r["toxicity"] < 0.5 for r in toxicity.score(docs, blank).collect()} == {True}
    with pytest.raises(ValueError, match="column already"):
        toxicity.score(docs.withColumn("toxicity", F.lit(1)), model)


def test_toxicity_of_repeated_rows(spark):
    """Every row twice, and rows with null ids: the same model."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice([f"w{k}" for k in range(200)] + ["vile", "awful"] * (20 if i % 5 == 0 else 0)) for _ in range(120)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[0])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    once, twice = toxicity.train(docs, labels), toxicity.train(docs.unionByName(docs), labels)
    assert once.odds and once == twice
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs, twice).collect()}
    assert all((got[i] >= 0.5) == (i % 5 == 0) for i in range(400)) and got[None] == got[0]


def test_segments_equal_brute_force():
    """All maximal scoring segments by their recursive definition: the best one, then those left and right of it."""
    rng = random.Random(4)
    for _ in range(200):
        model = toxicity.Model(odds={b"p": 2.0, b"q": 0.75, b"n": -1.5}, drift=0.25)
        w = [rng.choice([b"p", b"q", b"n", b"x"]) for _ in range(rng.randrange(30))]
        s = [model.odds.get(x, 0.0) - 0.25 for x in w]

        def best(a, b, s=s):
            found = [(sum(s[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)]
            top = max(found, default=None, key=lambda f: (round(f[0], 9), f[1], f[2]))
            if top is None or top[0] <= 1e-9:
                return []
            return [*best(a, top[3]), (top[3], top[4], round(top[0], 6)), *best(top[4], b)]

        got = [(a, b, round(x, 6)) for a, b, x in model.segments(w)]
        assert got == best(0, len(w))


# ---- 5 ----


def test_lm(docs, texts, odd, nothing):
    got = {r["doc_id"]: r for r in lm.score_corpus(docs).collect()}
    tok = {i: [*words(t), None] for i, t in texts.items()}
    count = Counter(w for i, t in tok.items() if zlib.crc32(str(i).encode()) % 10 for w in t)
    n, v = sum(count.values()), len(count)
    for i, t in tok.items():
        base = sum(np.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(t), sum(count[w] > 0 for w in t), n)
        assert got[i]["base_score"] == pytest.approx(base) and got[i]["score"] < 0
    assert lm.score_corpus(nothing).count() == 0 and lm.score_corpus(odd).count() == 5


def test_lm_bounds_shared_counts():
    """On large tables some n-grams share a count, which can then exceed the context's: no share is above 1, and weights are learned."""
    text = b"one two three four"
    tokens = lm.Tokens(Block(squeeze(np.array([1]), np.array([len(text)]), text)))
    counts = [np.ones(5, np.int64), np.array([1, 1, 3, 1, 1]), np.array([1, 2, 1, 5, 1])]
    bucket, shares = lm.estimates(tokens, counts, 1, 5)
    assert shares.max() == 1
    grid = lm._on_grid(shares)
    weights = lm.learn_weights(((bucket * lm.GRID + grid[0]) * lm.GRID + grid[1]) * lm.GRID + grid[2], np.ones(5, np.int64), 0.1)
    assert weights.sum(axis=1) == pytest.approx(1)


def test_lm_sums_to_one():
    """Over all words and the end, and one unknown word's share for each possible unknown, probabilities of a context add to one."""
    weights = lm.learn_weights(np.empty(0, np.int64), np.empty(0), 0.1)
    assert weights.sum(axis=1) == pytest.approx(1) and (weights[lm.PAIR_BUCKETS :, 0] == 0).all() and weights[-1, 1] == 0


def test_weights_follow_held_out_counts():
    cell = lambda g: np.array([((0 * lm.GRID + g[0]) * lm.GRID + g[1]) * lm.GRID + g[2]])
    w = lm.learn_weights(cell((2, 20, 20)), np.array([1000]), 1e-6)
    assert w[0, 0] > 0.95


# ---- 6 ----


def test_edit_counts(docs, texts, odd, nothing):
    n = F.char_length(F.coalesce("text", F.lit("")))
    edits = F.array(*(F.struct(F.floor(n * a).cast("long").alias("start"), (F.floor(n * a) + b).cast("long").alias("stop"), F.lit(t).alias("replacement")) for a, b, t in ((0.3, 5, ""), (0.6, 0, " new"), (2.0, 1, None))))
    got = {r["doc_id"]: r for r in tokens.count_edits(docs, PATH, edits).collect()}
    engine = Tokenizer.from_file(PATH)
    engine.encode_special_tokens = True
    for i, t in texts.items():
        t = t or ""
        m, e = len(t), t
        for a, b, new in ((0.3, 5, ""), (0.6, 0, " new"), (2.0, 1, "")):
            at = min(int(m * a), len(e))
            e = e[:at] + new + e[min(at + b, len(e)) :]
        assert got[i]["edited_text"] == e
        assert (got[i]["n_tokens"], got[i]["edited_tokens"]) == tuple(len(engine.encode(x, add_special_tokens=False).ids) for x in (t, e))
    assert tokens.count_edits(odd, PATH, edits).count() == 5 and tokens.count_edits(nothing, PATH, edits).count() == 0
    assert tokens.count_edits(odd, PATH, F.lit(None).cast("array<struct<start:long,stop:long,replacement:string>>")).first()["n_encoded"] == 0


# ---- 7 ----


def test_order_minhash(spark, docs, texts, odd, nothing):
    got = {r["doc_id"]: r for r in order_minhash.fingerprint_edits(docs).collect()}
    ids = sorted(texts, reverse=True)
    for k, i in enumerate(ids):
        t, after = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        r = len(t) // 3
        edited = t[: len(t) - r] + after[:r]
        x = got[i]
        assert (x["n_chars"], x["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert x["signature"] == got[ids[0] if texts[ids[0]] == texts[i] else i]["signature"]
        if edited == t:
            assert x["near_edited"] == 1.0
        assert 0 <= x["near_next"] <= 1
    copies = [i for i in ids if texts[i] == texts[-3]]
    assert len({tuple(got[i]["signature"]) for i in copies}) == 1
    assert order_minhash.fingerprint_edits(odd).count() == 5 and order_minhash.fingerprint_edits(nothing).count() == 0


def pieces(t):
    """Pieces by a scan of the text, with the ends' class as a set."""
    return regex.findall(order_minhash.PIECES.replace("\\p{Punct}", re.escape("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")), t)


def test_signature_follows_edits(spark):
    """Likeness falls with the edit distance, in texts with and without blanks; moved passages count as an edit."""
    rng = random.Random(13)
    alphabets = {"spaced": None, "latin": "abcdefghijklmnopqrstuvwxyz0123456789", "han": [chr(c) for c in range(0x4E00, 0x9FFF)]}
    rows, n = [], 3000
    for name, letters in alphabets.items():
        t = "".join(rng.choice(letters) for _ in range(n)) if letters else " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n // 6))
        for edits in (0, 1, 10, 60):
            e = t
            for _ in range(edits):
                at = rng.randrange(len(e))
                e = e[:at] + rng.choice("xyz") + e[at + rng.randrange(2) :]
            rows.append((f"{name} {edits}", t, e))
        parts = [t[k : k + 100] for k in range(0, len(t), 100)]
        rows += [(f"{name} swapped", t, "".join(reversed(parts))), (f"{name} front", t, "x" + t), (f"{name} other", t, "".join(rng.sample(t, len(t))))]
    df = order_minhash.with_signature(spark.createDataFrame(rows, "name string, t string, e string"), "t", "a")
    got = {r["name"]: r["near"] for r in order_minhash.with_signature(df, "e", "b").select("name", order_minhash.likeness(F.col("a"), F.col("b")).alias("near")).collect()}
    for name in alphabets:
        near = [got[f"{name} {k}"] for k in (0, 1, 10, 60)]
        assert near[0] == 1.0 and near[1] > 0.9 and near[0] >= near[1] > near[2] > near[3] > got[f"{name} other"], (name, near)
        assert got[f"{name} swapped"] < 0.6 < got[f"{name} front"] and got[f"{name} other"] < 0.1, got


def test_signature_against_python(spark, texts):
    """The signature by its definition, with Spark's hash taken from Spark."""
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in order_minhash.with_signature(df, "text", "s", bins=16).collect()}
    kmers = []
    for i, t in texts.items():
        p = pieces(t or "")
        kmers += [(i, j, *(p[j + d] if j + d < len(p) else None for d in range(3))) for j in range(max(len(p) - 2, 1) if p else 0)]
    h = {(r["i"], r["j"]): r["h"] & (2**64 - 1) for r in spark.createDataFrame(kmers, "i long, j int, a string, b string, c string").select("i", "j", F.xxhash64("a", "b", "c").alias("h")).collect()}
    bits = order_minhash.PLACE_BITS
    numbered, seen = [], Counter()
    for (i, j), x in sorted(h.items()):
        numbered.append((i, j, x >> bits, seen[i, x >> bits]))
        seen[i, x >> bits] += 1
    g = {(r["i"], r["j"]): r["g"] & (2**64 - 1) for r in spark.createDataFrame(numbered, "i long, j int, x long, n int").select("i", "j", F.xxhash64("x", "n").alias("g")).collect()}
    heads = []
    for i in texts:
        bins = {}
        for (d, j), x in g.items():
            if d == i:
                bins.setdefault(x >> 60, []).append((x >> bits, j))
        for b, of in bins.items():
            two = sorted(sorted(of)[:2], key=lambda x: x[1])  # the two least, in the order of the text
            heads.append((i, b, *(x for x, _ in two), *([None] * (2 - len(two)))))
    named = spark.createDataFrame(heads, "i long, b int, x long, y long").select("i", "b", F.when(F.col("y").isNull(), F.xxhash64("x")).otherwise(F.xxhash64("x", "y")).alias("h")).collect()
    want = {}
    for r in named:
        want.setdefault(r["i"], set()).add((r["b"] << 16) + (r["h"] & 0xFFFF))
    assert all(set(got[i]) == want.get(i, set()) and len(got[i]) == len(want.get(i, ())) for i in texts)


# ---- 8 ----


def test_mixing(spark, docs, texts, odd, nothing):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 30)), "big" if i % 3 else f"s{i % 12}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("weight", F.lit(1)).withColumn("tokens", F.lit(1))
    size = {i: len(t.split()) for i, t, _ in rows}
    of = {i: s for i, _, s in rows}
    total = Counter()
    for i, n in size.items():
        total[of[i]] += n
    draws = mixing.mix(df, entropy_share=0.97, most_repeats=50).collect()
    weights = {r["source"]: r["weight"] for r in draws}
    whole = sum(total.values())
    assert sum(weights.values()) == pytest.approx(1)
    entropy = -sum(w * np.log(w) for w in weights.values())
    assert entropy == pytest.approx(0.97 * np.log(len(weights)), abs=1e-6)
    drawn, times = Counter(), Counter()
    for r in draws:
        drawn[r["source"]] += size[r["doc_id"]]
        times[r["doc_id"], r["epoch"]] += 1
    assert max(times.values()) == 1
    for s, w in weights.items():
        assert w * whole - 60 <= drawn[s] <= w * whole + 1e-6
    limited = mixing.mix(df, entropy_share=1.0, most_repeats=2.0).collect()
    for s in total:
        assert Counter(r["doc_id"] for r in limited if r["source"] == s).most_common(1)[0][1] <= 3
    every = mixing.mixed_documents(df, most_repeats=2.0)
    assert every.columns == df.columns and every.select("doc_id").distinct().count() == 900
    assert mixing.mix(nothing).count() == 0 and {r["doc_id"] for r in mixing.mix(odd, at_least_once=True).collect()} == {7, 9, None}
    assert {r["doc_id"] for r in mixing.mixed_documents(docs).collect()} == set(texts)


# ---- 9 ----


def brute_passages(texts, window=50):
    seen, out = set(), {}
    for i in sorted(texts):
        t = (texts[i] or "").encode()
        gone, mine = bytearray(len(t)), []
        for k in range(len(t) - window + 1):
            w = t[k : k + window]
            if w in seen:
                gone[k : k + window] = b"\x01" * window
            mine.append(w)
        seen.update(mine)
        out[i] = (len(t), sum(gone), sum(gone[k] and not (k and gone[k - 1]) for k in range(len(t))), hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_passages(spark, seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("ab \x00é") for _ in range(rng.randrange(20, 160))) for _ in range(12)]
    texts = {i: "".join(rng.choice(pool)[rng.randrange(10) :] for _ in range(rng.randrange(8))) for i in range(60)} | dict(enumerate(some_texts(seed, 10), start=100))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("spans", F.lit(1)).repartition(4)
    got = {r["doc_id"]: tuple(r)[1:] for r in passages.digest(passages.repeated_passages(df)).collect()}
    assert got == brute_passages(texts)


def test_passages_edges(odd, nothing):
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_removed"] > 0) for r in passages.digest(passages.repeated_passages(odd)).collect()))
    assert got == [(False, 7, False), (False, 7, False), (False, 9, True), (True, 0, True), (True, 0, True)]
    assert passages.repeated_passages(nothing).count() == 0


def test_anchors_of_slices(monkeypatch):
    """Slices give what the whole text gives, and a block of 4 MB takes little beside its text."""
    rng = np.random.default_rng(5)
    text = rng.integers(97, 100, 4 << 20).astype(np.uint8)
    starts = np.r_[0, np.sort(rng.integers(0, 20_000, 60)), 19_990, 19_990]
    want = anchors.anchors(text[:20_000], starts, 50, 20)
    for size in (64, 997):
        monkeypatch.setattr(anchors, "SLICE", size, raising=False)
        assert all(np.array_equal(x, y) for x, y in zip(anchors.anchors(text[:20_000], starts, 50, 20), want, strict=True))
    monkeypatch.undo()
    tracemalloc.start()
    anchors.anchors(text, np.arange(0, len(text), 2000), 50, 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20, peak


def test_deep_shallow_sort():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 300):
        lengths = rng.integers(0, 41, n)
        rows = rng.integers(0, 2, (n, 40), dtype=np.uint8)
        if n > 5:
            rows[::3] = rows[0]
        rows[np.arange(40) >= lengths[:, None]] = 0
        order, lcp = deep_shallow_sort(rows, lengths)
        texts = [bytes(rows[k][: lengths[k]]) for k in range(n)]
        key = lambda t: (t + bytes(40 - len(t)), len(t))
        assert [key(texts[k]) for k in order] == sorted(key(t) for t in texts)
        for i in range(1, n):
            a, b = texts[order[i - 1]], texts[order[i]]
            assert lcp[i] == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


# ---- 10 ----


def test_simhash(docs, texts, odd, nothing):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    fp = {}
    for i, t in texts.items():
        w = words(t)
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
        fp[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    sets = Sets(texts)
    for a in fp:
        for b in fp:
            if (fp[a] ^ fp[b]).bit_count() <= 4:
                sets.join(a, b)
    assert all(got[i]["fp"] & (2**64 - 1) == fp[i] and got[i]["component_id"] == sets.top(i) for i in texts)
    assert {r["component_id"] for r in simhash.near_duplicates(odd).collect()} == {7} and simhash.near_duplicates(nothing).count() == 0


def test_links_of_near_fingerprints(spark, monkeypatch):
    """Dense clusters, with buckets cut into blocks."""
    monkeypatch.setattr(simhash, "BLOCK", 64)
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for c in centres for _ in range(150)})
    sets = Sets(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                sets.join(a, b)
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x, k) for k, x in enumerate(fps)], "fp long, rep long")
    mine = Sets(range(len(fps)))
    for r in simhash.links(df, 4, 3, Scratch(spark, "t")).collect():
        assert (fps[r["src"]] ^ fps[r["dst"]]).bit_count() <= 4
        mine.join(r["src"], r["dst"])
    assert all(mine.top(k) == sets.top(k) for k in range(len(fps)))
