"""Collocations, sharded Lloyd and packing along a curve: brute force, exact round trips, awkward rows."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators_llm import docs_of, low, odd  # noqa: F401

from faultline.llm import collocations, curve, lloyd, mixing, simhash

PHRASES = ["new york city", "hot dog", "in the", "of the new", "red red red red", "machine learning", "the end"]


def talk(seed, n, ends=". , ; : ! ? \n \t".split(" ")):
    r = random.Random(seed)
    return "".join(r.choice(PHRASES + ["a", "b", "The", "É", "x y", "\x1cq"]) + r.choice([" ", " ", "  ", *ends]) for _ in range(n))


@pytest.fixture(scope="module")
def talked(spark, odd):  # noqa: F811
    rows = [(i, talk(i, 60), "s") for i in range(40)] + odd
    df = docs_of(spark, rows, True)
    return df.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, F.lit(None).cast("string")).when(F.col("doc_id") % 3 == 1, F.lit("und")).otherwise(F.lit("fr")))


def brute(rows, least, cover, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        gone = {q for p, a in found.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= cover * count[q]}
        best = []
        for p, a in found.items():
            if p not in gone:
                score, k = min((1_000_000 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top])]
    return sorted(out)


@pytest.mark.parametrize("how", [{}, {"size": 300, "shard": 300}, {"size": 40, "shard": 7, "top": 5, "least": 3}])
def test_collocations_against_brute_force(spark, talked, how):
    rows = [(r.lang, r.text) for r in talked.select("lang", "text").collect()]
    got = collocations.collocations(talked.repartition(3), **how)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(rows, how.get("least", 10), 50, how.get("top", 2000))
    assert len(want) > 5
    assert sorted(map(tuple, got.collect())) == want


def some_phrases(seed, n=400):
    r = random.Random(seed)
    words = sorted({f"w{r.randrange(60)}".encode() for _ in range(50)})
    rows = {tuple(r.choice(words) for _ in range(r.randrange(1, 4))): r.choice([1, 1, 2, 2**40]) for _ in range(n)}
    keys = sorted((collocations.key_of(words, p), n) for p, n in rows.items())
    return rows, (words, np.array([k for k, _ in keys]), np.array([x for _, x in keys]))


def table_of(p):
    return {collocations.phrase_at(p[0], int(k)): int(n) for k, n in zip(p[1], p[2])}


@pytest.mark.parametrize("seed", range(5))
def test_automata_keep_split_and_unite(seed, monkeypatch):
    rows, p = some_phrases(seed)
    data = collocations.automaton(*p)
    assert table_of(collocations.phrases(data)) == rows
    assert len(data) < len(collocations.automaton(*some_phrases(seed, 4000)[1]))
    borders = sorted(random.Random(seed).sample(sorted(rows), 3))
    parts = [collocations.automaton(*x) for _, x in collocations.split_at(p, borders)]
    assert sum(len(collocations.phrases(x)[1]) for x in parts) == len(rows)
    for i, x in collocations.split_at(p, borders):
        assert all(sum(b <= q for b in borders) == i for q in table_of(x))
    other = some_phrases(seed + 100)
    want = Counter(rows) + Counter(other[0])
    for most in (collocations.MOST_WORDS, 20):                       # few numbers: cut in two until the words fit
        monkeypatch.setattr(collocations, "MOST_WORDS", most)
        found = list(collocations.union([collocations.phrases(x) for x in parts] + [other[1]]))
        assert {k: n for x in found for k, n in table_of(x).items()} == want


def test_equal_states_are_kept_once():
    words = [b"a", b"b", b"c", b"d"]
    same = {(a, b, c): 1 for a in (b"a", b"b") for b in (b"c", b"d") for c in (b"a", b"b", b"c", b"d")}
    differing = {p: i + 1 for i, p in enumerate(same)}
    size = lambda t: len(collocations.automaton(words, np.array([collocations.key_of(words, p) for p in sorted(t)]), np.array([t[p] for p in sorted(t)])))
    assert size(same) < size(differing)


def test_collocations_count_chunks_of_a_long_text(spark):
    text = " ".join(["u v w"] * 4000)
    got = collocations.collocations(spark.createDataFrame([(text, "en")], "text string, lang string"), shard=100)
    assert {r.phrase: r.a for r in got.collect()} == {"u v w": 4000, "v w u": 3999, "w u v": 3999}
    assert got.first().n == 12000


# Lloyd ---------------------------------------------------------------------------------------------------------------

def lloyd_brute(rows, clusters, rounds, seed, dims):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, name(r[0]), r[1]))[:clusters]]
    gap = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c))

    def assign():
        return [min((gap(v, c), k) for k, c in enumerate(centres)) for _, v in kept]
    for _ in range(rounds):
        found = assign()
        for k in range(len(centres)):
            own = [v for (_, v), (_, j) in zip(kept, found) if j == k]
            if own:
                centres[k] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    of = Counter()
    for d, k in found:
        of[k] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, k, d, of[k], sum(of.values()), sha[k]) for (i, _), (d, k) in zip(kept, found)]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("block", "shard", "ids", "cluster", "distance")})


@pytest.mark.parametrize("width", [3, 8, 64])
def test_lloyd_against_brute_force(spark, width):
    r = random.Random(width)
    rows = [(i, [r.gauss(i % 5, 0.3) for _ in range(8)]) for i in range(120)]
    rows += [(0, rows[0][1]), (5, rows[5][1]), (5, rows[6][1]), (None, [0.5] * 8), (200, None), (201, [1.0] * 7), (202, [1.0] * 9), (203, []),
             (204, [None] + [1.0] * 7), (205, [float("nan")] + [1.0] * 7), (206, [float("-inf")] + [1.0] * 7), (207, [-0.0] * 8)]
    rows += [(300 + i, [2.0] * 8) for i in range(80)]                # one vector very often
    got = lloyd.clustered(vectors(spark, rows).repartition(5), clusters=8, rounds=4, dimensions=8, width=width)
    key = lambda t: tuple((x is None, x) for x in t)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(lloyd_brute(rows, 8, 4, 3, 8), key=key)


def test_lloyd_few_vectors_ties_and_large_components(spark):
    rows = [(1, [1e6, -3.0]), (2, [1e6, -3.0]), (3, [-1e12, 2.5])]
    got = lloyd.clustered(vectors(spark, rows), dimensions=2, width=1)
    assert sorted(map(tuple, got.collect())) == sorted(lloyd_brute(rows, 8, 10, 3, 2))
    far = lloyd.clustered(vectors(spark, [(1, [1e300, 0.0]), (2, [0.0, 0.0])]), clusters=1, rounds=1, dimensions=2).collect()
    assert [r.distance for r in far] == [lloyd.TOP, lloyd.TOP] and far[0].inertia == lloyd.TOP


def test_partials_are_exact_in_every_type():
    r = np.random.default_rng(0)
    for scale in (50, 1 << 14, 1 << 25):
        x, c = r.integers(-scale, scale, (40, 7)), r.integers(-scale, scale, (3, 7))
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w)) for w in c] for v in x]
        assert lloyd.partial_distances(x, c).tolist() == want == lloyd.partial_distances(x.astype(object), c).tolist()
        assert lloyd.unpacked(*lloyd.packed(x), len(x)).tolist() == x.tolist()
        assert lloyd.unpacked(*lloyd.packed(x.astype(object)), len(x)).tolist() == x.tolist()


# packing along a curve -----------------------------------------------------------------------------------------------

@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_keys_walk_to_neighbours(dims, bits):
    cells = np.array(list(product(range(1 << bits), repeat=dims)))
    keys = curve.hilbert(cells, bits)
    assert sorted(keys.tolist()) == list(range(1 << dims * bits))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def check_packing(rows, placed, capacity):
    """Whole ids, gapless sequences, no padding; returns the texts' ids in the order of the line."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(curve.default_path())
    tok.encode_special_tokens = True
    want = Counter()
    for i, t, _ in rows:
        want[i, tuple([*tok.encode(t or "", add_special_tokens=False).ids, curve.END_ID])] += 1
    by = defaultdict(list)
    for r in placed:
        by[r.sequence_id].append(r)
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0 and zlib.crc32(r.ids) == r.ids_crc32 and 0 <= r.start and r.start + r.length <= r.doc_tokens
    line = []
    for k in sorted(by):
        at = 0
        for r in sorted(by[k], key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
            line.append(r)
        assert at == capacity or at & (at - 1) == 0 and at < capacity
    assert len([k for k in by if sum(r.length for r in by[k]) < capacity]) <= capacity.bit_length()
    got, open_ = Counter(), []
    for r in line:                                                   # pieces of a document follow each other on the line
        assert r.start == sum(map(len, open_))
        open_.append(np.frombuffer(r.ids, "<u4").tolist())
        if r.start + r.length == r.doc_tokens:
            got[r.doc_id, tuple(x for p in open_ for x in p)] += 1
            open_ = []
    assert got == want and not open_


@pytest.mark.parametrize("capacity", [64, 2048])
def test_curve_round_trip(spark, odd, capacity):  # noqa: F811
    special = [(400, "<|endoftext|> as text", "s"), (401, "日本語 😀 ́", "s"), (402, " \n\n \t x  ", "s")] + [(500 + i, "many equal texts", "s") for i in range(90)]
    rows = odd + special
    placed = curve.pack(docs_of(spark, rows, True).repartition(4), capacity=capacity, with_ids=True)
    assert placed.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    check_packing(rows, placed.collect(), capacity)
    assert curve.pack(docs_of(spark, [(1, None, "s")])).collect()[0][:7] == (1, 0, 1, zlib.crc32(b"\1\0\0\0"), 1, 0, 0)


def test_rank_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    e = curve.encoder(curve.default_path())
    tok = Tokenizer.from_file(curve.default_path())
    tok.encode_special_tokens = True
    assert e.stored == "<u2"
    r = random.Random(1)
    texts = ["", " ", "a  b", "x" * 5000, " " * 3000 + "y", "I'll we've 'S 's", "½ ٣ 12345", "<|endoftext|>", "\x00\x1c\x85 z"]
    texts += ["".join(r.choices([chr(c) for c in range(300)] + ["'s", " ", "\n", "É", "日", "😀", "the "], k=30)) for _ in range(1500)]
    for t in texts:
        assert list(e.encode(t)) == tok.encode(t, add_special_tokens=False).ids, t


def test_neighbours_on_the_curve_are_alike(spark):
    """Documents of one topic stand closer to each other than in doc_id order."""
    r = random.Random(3)
    topics = [[f"{w}{i}" for w in "alpha bravo carbon delta engine forest".split()] for i in range(8)]
    rows = [(i, " ".join(r.choices(topics[i % 8], k=80)), "s") for i in range(320)]
    seen = curve.encoded(docs_of(spark, rows)).orderBy("key").collect()
    order = [r.doc_id % 8 for r in seen]
    changes = sum(a != b for a, b in zip(order, order[1:]))
    assert changes < 200                                             # random order: about 280; doc_id order: 319


# SimHash planes and the mix's slots ----------------------------------------------------------------------------------

def test_blocks_beyond_the_radius_are_abandoned():
    r = random.Random(1)
    value = np.array([r.getrandbits(64) for _ in range(512)], np.uint64)
    value[300] = value[7] ^ np.uint64(5)
    bits = np.unpackbits(value.view(np.uint8).reshape(1, 512, 8), axis=2, bitorder="little")
    queries = np.uint64(0) - bits[:, :64, :].transpose(2, 0, 1).astype(np.uint64)
    over, read = simhash.over_radius(simhash.sliced(bits), queries, np.zeros((1, 64, 8), np.uint64))
    near = np.argwhere(np.unpackbits((~over).view(np.uint8), axis=2, bitorder="little"))
    want = [[0, a, b] for a in range(64) for b in range(512) if bin(int(value[a]) ^ int(value[b])).count("1") <= 2]
    assert near.tolist() == want and [0, 7, 300] in want
    assert read < 64 * 64 * 8 / 2                                    # words of planes, of all members and blocks


def walk(target, block):
    """The golden-ratio walk by itself: which source fills each slot."""
    goal = {i: math.floor(t) for i, t in target.items()}
    need = {i: -(-g // block) for i, g in goal.items()}
    total, before, low = sum(goal.values()), 0, {}
    for i in sorted(goal):
        if goal[i] > 0:
            low[i] = (before / total * mixing.CELLS, (before + goal[i]) / total * mixing.CELLS)
        before += goal[i]
    given, out, n = Counter(), {}, sum(need.values())
    for slot in range(n):
        point = slot % mixing.PERIOD * mixing.GOLDEN % mixing.PERIOD / mixing.PERIOD * mixing.CELLS
        for i, (a, b) in low.items():
            if a <= point < b:
                if given[i] < need[i]:
                    out[i, given[i]] = slot
                given[i] += 1
    for i in need:
        for rank in range(min(given[i], need[i]), need[i]):
            out[i, rank] = n + rank
    return out


def test_first_slots_follow_the_walk(spark, odd):  # noqa: F811
    docs = docs_of(spark, odd + [(900 + i, "w " * (3000 + i), f"s{i % 2}") for i in range(6)], True)
    rows = mixing.taken_words(docs).collect()
    sources = sorted({r.source for r in rows}, key=lambda s: (s is None, s))
    target = {sources.index(r.source): r.target for r in rows}
    slots = walk(target, mixing.BLOCK)
    for i, s in enumerate(sources):
        mine = sorted((r for r in rows if r.source == s), key=lambda r: (r.key, (r.doc_id is not None, r.doc_id or 0), r.size))
        at, size = 0, sum(r.size for r in mine)
        for r in mine:
            met = []
            for lap in (0, 1):
                a, b = at + lap * size, min(at + lap * size + r.size, math.floor(target[i]))
                met += [slots[i, k] for k in range(a // mixing.BLOCK, (b - 1) // mixing.BLOCK + 1)] if b > a else []
            assert r.first_slot == (min(met) if met else None)
            at += r.size
    assert sum(r.taken > 0 for r in rows) == sum(r.first_slot is not None for r in rows) > 10


def test_ties_do_not_depend_on_partitioning(spark):
    """Rows equal in doc_id and text (or but for case) and different elsewhere: the same row stays however they are dealt."""
    from faultline.llm import exact

    text = "one text that several rows share word by word"
    rows = [(7, text, f"s{i}") for i in range(6)] + [(7, text.upper(), "t0"), (7, text.upper(), "t1"), (3, text, "u0"), (3, text, "u1"), (None, "other words here", "v0"), (None, "other words here", "v1")]
    seen = []
    for n in (1, 3, 7):
        df = docs_of(spark, rows, True).repartition(n, "source")
        seen.append([sorted((str(r.doc_id), r.text, r.source) for r in f(df).collect()) for f in (exact.exact_dedup, simhash.near_dedup)])
    assert seen[0] == seen[1] == seen[2]
    assert [len(x) for x in seen[0]] == [2, 2] and [x[0][0] for x in seen[0]] == ["3", "7"][::-1]


@pytest.mark.parametrize("text", ["plain words that hold no secret at all " * 5_000, "Ünïcode wörds " * 9_000, "\x01\x02 mostly odd" * 9_000])
def test_layers_are_counted_alike_on_both_sides_of_the_bound(monkeypatch, text):
    import base64
    import gzip

    from faultline.llm import secret_scan

    inner = base64.b64encode(text.encode())
    coded = base64.b64encode(gzip.compress(b"log " + base64.b64encode(inner) + b" end")).decode()
    small = secret_scan.scan(coded)
    monkeypatch.setattr(secret_scan, "MOST_BYTES", 50_000)
    large = secret_scan.scan(coded)
    assert small[:3] == large[:3] and small[3] == 0 < large[3]
    assert secret_scan.is_text(text.encode()) == (secret_scan.readable(text.encode()) is not None)
