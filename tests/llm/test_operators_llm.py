"""The training-data operators against brute force, and on nulls, empty and long texts, ties, repeats and clashing names."""
import base64
import bz2
import functools
import gzip
import hashlib
import itertools
import lzma
import math
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict
from urllib.parse import quote, quote_plus

import numpy as np
import pytest
import xxhash
from compare import canon, connect
from pyspark.sql import functions as F

from faultline.llm import exact, lengths, mixing, packing, quality, secret_scan, simhash, spotsigs, tokens, toxicity, warc
from faultline.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use as names of their own.
CLASH = {c: "x" for c in ("fp", "key", "row", "k", "size", "score", "taken", "idx", "rank", "component_id", "text_sha256", "maybe", "length", "bucket", "y", "h", "sigs")}


def docs_of(spark, rows, clash=False):
    df = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], SCHEMA)
    return df.withColumns({c: F.lit(v) for c, v in CLASH.items()}) if clash else df


WORDS = "the of and to in is red green blue stone river mountain idea letter number engine window garden".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (str(r.randrange(50)) if r.random() < 0.5 else "") for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    """Rows with every awkward case."""
    base = [(i, prose(i, 40 + i), f"s{i % 3}") for i in range(30)]
    return base + [(100, None, "s1"), (101, "", "s1"), (102, "", None), (None, "no id here at all", "s2"), (None, None, None), (103, base[3][1].upper(), "s0"),
                   (104, base[3][1], None), (3, base[3][1], "s0"), (3, base[3][1], "s0"), (105, prose(7, 30_000), "s2"), (106, "É é", "s1"), (107, "é é", "s1"),
                   (108, "one", "s0"), (109, "x" * 50_000, "s0"), (5, "another text under the same id", "s2")]


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("name", list(SQL))
def test_matches_sql(spark, name):
    df = QUERIES[name](spark, SF)
    cur = connect(SF).execute(SQL[name])
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for t in ("documents", "labels", "pages", "embeddings"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).collect() == []


# ---------------------------------------------------------------- exact deduplication
def exact_brute(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[low(t)].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        left = 1
        for i in ids:
            kept = bool(i == keep and left)
            left -= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_groups(spark, odd):
    assert sorted(map(tuple, exact.exact_groups(docs_of(spark, odd, True)).collect()), key=str) == exact_brute(odd)


def test_exact_groups_with_a_full_filter(spark, odd, monkeypatch):
    monkeypatch.setattr(exact, "filter_bits", lambda rows: exact.SLICE)
    rows = odd + [(1000 + i, f"text {i // 2}", "s") for i in range(3000)]
    assert sorted(map(tuple, exact.exact_groups(docs_of(spark, rows)).collect()), key=str) == exact_brute(rows)


def test_exact_dedup_keeps_whole_rows(spark, odd):
    df = docs_of(spark, odd, True)
    out = exact.exact_dedup(df)
    want = Counter((i, sha) for i, _, _, kept, sha in exact_brute(odd) if kept)
    assert out.columns == df.columns
    assert Counter((r.doc_id, hashlib.sha256(low(r.text).encode()).hexdigest()) for r in out.collect()) == want


def test_filter_never_misses_a_repeat(spark):
    keys = spark.range(5000).select(F.xxhash64(F.col("id") % 4000).alias("key"))
    seen = Counter(r.key for r in keys.collect())
    for r in exact.possibly_repeated(keys, 5000).collect():
        assert r.maybe or seen[r.key] == 1


# ---------------------------------------------------------------- SimHash
def fp_brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    sh = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components_brute(fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            parent[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


def test_simhash_against_all_pairs(spark, odd):
    near = [(200 + i, prose(i, 400 + i) + f" end{i}", "s") for i in range(10)] + [(300 + i, prose(i, 400 + i) + f" fin{i}", "s") for i in range(10)]
    rows = [r for r in odd if r[0] != 105] + near
    fps = [fp_brute(t) for _, t, _ in rows]
    comp = components_brute(fps)
    smallest = {c: min((r[0] for r, d in zip(rows, comp) if d == c and r[0] is not None), default=None) for c in comp}
    want = sorted(((r[0], f, smallest[c]) for r, f, c in zip(rows, fps, comp)), key=str)
    got = simhash.near_groups(docs_of(spark, rows, True)).collect()
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=str) == want
    assert len(set(smallest.values())) < len(set(fps))              # something links
    left = simhash.near_dedup(docs_of(spark, rows, True)).collect()
    assert sorted((str(r.doc_id) for r in left)) == sorted(map(str, [smallest[c] for c in set(comp)]))


@pytest.mark.parametrize("bound", [3, 512])
def test_links_in_dense_neighbourhoods(spark, monkeypatch, bound):
    """Both ways of comparing inside a key connect what brute force connects."""
    monkeypatch.setattr(simhash, "GROUP", bound)
    r = random.Random(bound)
    fps = set()
    for _ in range(4):
        at = r.getrandbits(64)
        for _ in range(60):
            fps.add(at)
            at ^= (1 << r.randrange(64)) | (1 << r.randrange(64)) if r.random() < 0.7 else (7 << r.randrange(60))
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    from faultline.llm import common
    roots = {x.node % (1 << 64): x.root for x in common.components(simhash.links(df)).collect()}
    comp = components_brute(fps)
    sets = defaultdict(set)
    for f, c in zip(fps, comp):
        sets[c].add(f)
    mine = defaultdict(set)
    for f in fps:
        mine[roots.get(f, f)].add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, sets.values()))


# ---------------------------------------------------------------- mixing
def test_mixing_meets_targets(spark, odd):
    got = mixing.mixed(docs_of(spark, odd, True)).collect()
    assert len(got) == len(odd)
    source = {}
    for i, t, s in odd:
        source[s] = source.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter(r.size for r in got) == Counter(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in odd)
    weights = dict(zip(sorted(source, key=lambda s: (s is None, s)), itertools.cycle([3, 1, 2])))
    target, open_, left = {}, set(source), 1.5 * sum(source.values())
    while True:                                                      # reshare what stands above the caps
        level = left / max(1, sum(weights[s] for s in open_))
        over = {s for s in open_ if level * weights[s] >= 2 * source[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * source[s]
            left -= target[s]
        open_ -= over
    target |= {s: level * weights[s] for s in open_}
    by_size = {source[s]: s for s in source}
    taken = Counter()
    for r in got:
        s = by_size[r.source_size]
        assert r.target == pytest.approx(target[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in source)


def test_schedule_is_even_and_whole(spark):
    wanted = spark.createDataFrame([(0, 50_000.0), (1, 30_000.5), (2, 20.0), (3, 0.0)], "idx long, target double")
    slots = mixing.schedule(wanted, 16).collect()
    for idx, goal in ((0, 50_000), (1, 30_000), (2, 20)):
        ranks = sorted(s["rank"] for s in slots if s.idx == idx)
        assert ranks == list(range(-(-goal // 16)))
    assert len({s.slot for s in slots}) == len(slots)
    n = max(s.slot for s in slots)
    for part in range(1, 9):                                         # every prefix of the mix holds the sources in proportion
        head = sum(s.idx == 0 for s in slots if s.slot < n * part / 8)
        assert abs(head - n * part / 8 * 50_000 / 80_020) < 6


def test_mixture_repeats_and_cuts(spark, odd):
    df = docs_of(spark, odd, True)
    want = sum(r.taken for r in mixing.mixed(df).collect())
    out = mixing.mixture(df)
    rows = out.collect()
    assert out.columns == df.columns
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows) == want
    assert all(r.n_chars == len(r.text) for r in rows)


# ---------------------------------------------------------------- packing
@functools.cache
def plain_tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokens.default_path())


def encoded(text):
    return plain_tokenizer().encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_whole_text_encoding(table, monkeypatch):
    texts = [r.text for r in table.limit(40).collect()] + ["", " ", "a b c\x1cd", "İI ẞß Ω Σς", "H̱ é ﬁ", "it's 'S ''s", "tab\tnew\nline\r\nx", "x" * 300, "日本語 テスト"]
    r = random.Random(0)
    texts += ["".join(r.choices([chr(c) for c in range(256)] + ["'s", "'re", "a", "É", "Σ"], k=12)) for _ in range(2000)]
    for cached in (1, tokens.WORDS):
        monkeypatch.setattr(tokens, "WORDS", cached)
        enc = tokens.Encoder(tokens.default_path())
        assert enc.plain
        for t in texts:
            assert enc.encode([t])[0] == array("I", encoded(t)).tobytes(), t


def test_packing_round_trip(spark, odd):
    cut = packing.pieces(docs_of(spark, odd, True), with_ids=True)
    placed = packing.packed(cut)
    rows = placed.collect()
    docs = defaultdict(list)
    for r in rows:
        docs[r.doc_id].append((r.piece, r.start, bytes(r.ids), r.ids_crc32, r.length))
    want = defaultdict(list)
    for i, t, _ in odd:
        ids = array("I", [*encoded(t), 1]).tobytes()
        want[i] += [(p, p * 4096, ids[p * 16384:(p + 1) * 16384], zlib.crc32(ids[p * 16384:(p + 1) * 16384]), len(ids[p * 16384:(p + 1) * 16384]) // 4) for p in range(-(-len(ids) // 16384))]
    assert {k: sorted(v) for k, v in docs.items()} == {k: sorted(v) for k, v in want.items()}
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length, bytes(r.ids)))
    for parts in bins.values():
        at = 0
        for offset, n, _ in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096
    assert sorted(bins) == list(range(len(bins)))
    assert len(bins) <= math.ceil(sum(r.length for r in rows) / 4096) + 1
    for s in packing.sequences(placed).collect():
        assert bytes(s.ids) == b"".join(x for _, _, x in sorted(bins[s.sequence_id]))


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_a_packing(seed):
    r = random.Random(seed)
    cap = 60
    hist = {r.randrange(1, cap + 1): r.randrange(1, 500) for _ in range(40)} if seed else {}
    segments, made = packing.plan(hist, cap)
    bins, got = defaultdict(list), Counter()
    by = defaultdict(list)
    for s in sorted(map(tuple, segments)):
        by[s[0]].append(s)
    for length, n in hist.items():
        for rank in range(n):
            _, lo, first, per, offset = max(s for s in by[length] if s[1] <= rank)
            k = rank - lo
            bins[first + k // per].append((offset + k % per * length, length))
            got[length] += 1
    assert got == Counter(hist) and len(bins) == made
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= cap and sum(3 * x > cap for _, x in parts) <= 2
    free = Counter()                                                 # plain best fit, longest first, one piece at a time
    for x in sorted(Counter(hist).elements(), reverse=True):
        gap = min((g for g in free if g >= x and free[g]), default=cap)
        free[gap] -= gap < cap or free[cap] > 0
        free[gap - x] += 1
    assert made <= free.total() * 1.02 + 1


# ---------------------------------------------------------------- token counts
def test_length_report(spark, odd):
    sizes = sorted(len(encoded(t)) for _, t, _ in odd)
    counts = lengths.histogram(docs_of(spark, odd, True))
    for r in lengths.report(counts).collect():
        limit = r.context_limit
        assert (r.docs, r.docs_within, r.docs_longer) == (sizes.count(limit), sum(s <= limit for s in sizes), sum(s > limit for s in sizes))
        assert (r.tokens_longer, r.truncated_total, r.total_tokens) == (sum(s for s in sizes if s > limit), sum(min(s, limit) for s in sizes), sum(sizes))
    got = {r.context_limit: r.total for r in lengths.truncated_totals(counts, [1, 100, 5000]).collect()}
    assert got == {x: sum(min(s, x) for s in sizes) for x in (1, 100, 5000)}
    q = {r.share: r.length for r in lengths.quantiles(lengths.report(counts), [0.1, 0.5, 1.0]).collect()}
    assert q == {p: sizes[math.ceil(p * len(sizes) - 1e-9) - 1] for p in (0.1, 0.5, 1.0)}


# ---------------------------------------------------------------- secrets
def spans_brute(text):
    out = []
    for kind, pattern, least, group in (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2), ("access", r"AKIA[A-Z0-9]+", 20, 0), ("hex", r"[0-9a-f]+", 24, 0)):
        for m in re.finditer(pattern, text, re.A | (re.I if kind == "assign" else 0)):
            if len(m[group]) >= least:
                out.append((m.start(), ["assign", "access", "hex"].index(kind), m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


HIDDEN = 'password = "hunter2/secret"'


@pytest.mark.parametrize("wrap", [
    quote, lambda s: quote(quote(s, safe=""), safe=""), lambda s: "".join(f"\\u{ord(c):04x}" for c in s), lambda s: "".join(f"\\x{ord(c):02x}" for c in s),
    lambda s: base64.b64encode(s.encode()).decode(), lambda s: base64.urlsafe_b64encode(("é" + s).encode()).decode().rstrip("="),
    lambda s: base64.b64encode(gzip.compress(s.encode())).decode(), lambda s: base64.b64encode(zlib.compress(quote(s).encode())).decode(),
    lambda s: quote(base64.b64encode(base64.b64encode(s.encode())).decode(), safe="")])
def test_layers_map_to_the_text(wrap):
    coded = wrap(HIDDEN)
    text = f"é before {coded} after"
    base, every, layers, _ = secret_scan.scan(text)
    assert layers and secret_scan.listed(base) == spans_brute(text)
    (a, _, b), *_ = [s for s in every if s not in base]
    at = text.index(coded)
    assert at <= a < b <= at + len(coded)
    assert b - a >= 0.8 * len(coded) * 26 / 30 or wrap is None


def b64(data):
    return base64.b64encode(data).decode()


NOISE = random.Random(5).randbytes(90)


@pytest.mark.parametrize("coded", [
    b64(gzip.compress(gzip.compress(HIDDEN.encode()))), b64(gzip.compress(zlib.compress(HIDDEN.encode()))), b64(bz2.compress(lzma.compress(HIDDEN.encode()))),
    b64(gzip.compress(b"a first member, ") + gzip.compress(HIDDEN[:9].encode()) + gzip.compress(HIDDEN[9:].encode())), b64(bz2.compress(b"x") + bz2.compress(HIDDEN.encode())),
    "".join(f"%{c:02X}" for c in gzip.compress(HIDDEN.encode())), "".join(f"\\x{c:02x}" for c in zlib.compress(HIDDEN.encode())),
    quote(gzip.compress(HIDDEN.encode())), quote_plus(gzip.compress(b" " + HIDDEN.encode() * 3 + NOISE)), repr(gzip.compress(HIDDEN.encode()))[2:-1],
    *(f"/v/{'abcdefgh'[:n]}/" + b64(HIDDEN.encode()) for n in range(8)), "id-" + b64(HIDDEN.encode()), "id_ab/" + b64(gzip.compress(HIDDEN.encode())),
    base64.encodebytes(gzip.compress(NOISE + HIDDEN.encode())).decode(), base64.encodebytes(b"x" * 50 + HIDDEN.encode() + NOISE).decode().replace("\n", "\r\n  "),
    base64.encodebytes(b"x" * 50 + HIDDEN.encode()).decode().replace("\n", "\\n"), b64(NOISE + HIDDEN.encode()),
    b64(HIDDEN.encode("utf-16")), b64(HIDDEN.encode("utf-16-be")), b64(gzip.compress(HIDDEN.encode("utf-16-le"))), quote(HIDDEN.encode("utf-16-be")),
    b64(gzip.compress(base64.encodebytes(b"x" * 50 + HIDDEN.encode()))), b64(gzip.compress(quote(gzip.compress(HIDDEN.encode())).encode())),
    b64(zlib.compress("".join(f"\\u{ord(c):04x}" for c in HIDDEN).encode())), b64(b"t" * 4200 + bytes(range(8)) * 40 + HIDDEN.encode())])
def test_no_layer_is_lost(coded):
    text = f"é before: {coded} after"
    base, every, _, _ = secret_scan.scan(text)
    at = text.index(coded)
    assert any(k == 0 and at <= a < b <= at + len(coded) for a, k, b in set(every) - set(base))


@pytest.mark.parametrize("inner", [HIDDEN.encode(), b64(gzip.compress(HIDDEN.encode())).encode(), quote(quote(HIDDEN)).encode(), gzip.compress(HIDDEN.encode())])
@pytest.mark.parametrize("before", [70, 99_995])
def test_secret_behind_the_bound(monkeypatch, inner, before):
    monkeypatch.setattr(secret_scan, "MOST_BYTES", 100_000)
    coded = b64(gzip.compress(b"a line of a dump\n" * 10_000 + b"x " * before + inner + b"\nlast"))
    assert [s for s in secret_scan.scan(coded)[1] if s[1] == 0] == [(0, 0, len(coded.rstrip("=")))]


def test_long_base64_behind_the_bound(monkeypatch):
    monkeypatch.setattr(secret_scan, "MOST_BYTES", 100_000)
    monkeypatch.setattr(secret_scan, "STEP", 1009)
    body = NOISE * 3000 + HIDDEN.encode() + NOISE
    for form in (b64(body).encode(), base64.encodebytes(body), base64.encodebytes(body).replace(b"\n", b"\\r\\n")):
        coded = b64(zlib.compress(b"ab " + form))
        assert [s[1] for s in secret_scan.scan(coded)[1] if s[1] == 0] == [0]


def test_percent_spans_are_tight():
    text = "see p%61ssword%3Dabcdefg&x"
    _, every, _, _ = secret_scan.scan(text)
    assert [text[a:b] for a, k, b in every if k == 0] == ["p%61ssword%3Dabcdefg"]


def test_scan_ends_on_cycles_and_bombs():
    bomb = base64.b64encode(zlib.compress(b"a" * (secret_scan.MOST_BYTES + 100))).decode()
    assert secret_scan.scan(bomb)[3] == 1
    deep = HIDDEN
    for _ in range(12):
        deep = base64.b64encode(deep.encode()).decode()
    assert len(secret_scan.scan(deep)[1]) >= 1
    assert secret_scan.scan("%25" * 500 + "%" * 500)[1] == []


def test_secrets_of_documents(spark, odd, table):
    rows = [(r.doc_id, r.text, r.source) for r in table.collect()] + odd + [(900, "PASSWD: abcdef token=short AKIA" + "A" * 16 + " " + "0f" * 12 + " ſecret=abcdefgh toKen=abcdefgh", "s")]
    got = secret_scan.scanned(docs_of(spark, rows, True)).collect()
    want = Counter((i, hashlib.sha256(spans_brute(t or "").encode()).hexdigest()) for i, t, _ in rows)
    assert Counter((r.doc_id, r.base_sha256) for r in got) == want
    for r in got:
        base = spans_brute({i: t for i, t, _ in rows}[r.doc_id] or "") if r.doc_id not in (None, 3, 5) else None
        if base is not None:
            assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
            assert [base.count(k) for k in ("assign", "access", "hex")] == [r.n_assign, r.n_access, r.n_hex]


# ---------------------------------------------------------------- SpotSigs
def sigs_brute(text):
    words = [w for w in re.split(r"[^\w]+|_+", text.lower()) if w]
    p = [i for i, w in enumerate(words) if w not in spotsigs.ANCHORS]
    out = []
    for j in range(len(p) - 1):
        at = p[j]
        if at > 0 and (j == 0 or p[j - 1] < at - 1):
            out.append((words[at - 1], words[at], words[p[j + 1]]))
        elif j >= 8 and at - p[j - 8] == 8:
            out.append(("", words[at], words[p[j + 1]]))
    if not out:
        out = [(*words[i:i + 2], None) for i in range(len(words) - 1)] or [tuple(words)] * bool(words) or [(text,)] * bool(text)
    return set(out)


def test_spotsigs_against_brute_force(spark, odd):
    rows = [r for r in odd if r[0] not in (3, 5, None)] + [(3, odd[3][1], "s"), (500, " ".join(f"w{i}" for i in range(40)), "s"), (501, "!!! ???", "s")]
    rows += [(501, "!!! ???", "s")]                                  # a repeated row
    got = spotsigs.edited(docs_of(spark, rows, True)).collect()
    ring = sorted({(i, t or "") for i, t, _ in rows})
    want = {}
    for (i, t), (_, following) in zip(ring, ring[1:] + ring[:1]):
        q = len(t) // 4
        edit = t[:len(t) - q] + following[:q]
        like = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
        want[i] = (len(t), hashlib.sha256(edit.encode()).hexdigest(), like(sigs_brute(t), sigs_brute(edit)), like(sigs_brute(t), sigs_brute(following)))
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in rows)
    for r in got:
        n, sha, near, nxt = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert (r.near_edited, r.near_next) == (pytest.approx(near), pytest.approx(nxt)), r.doc_id
    by_text = {i: t for i, t, _ in rows}
    names = {(by_text[r.doc_id] or ""): r.fingerprint for r in got}
    assert all(names[by_text[r.doc_id] or ""] == r.fingerprint for r in got)


def test_spotsigs_null_ids_and_one_document(spark):
    one = spotsigs.edited(docs_of(spark, [(7, "alone in the world of red stones", "s")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    some = spotsigs.edited(docs_of(spark, [(None, "first of all the texts here", "s"), (1, "the second text of the two", "s")])).collect()
    assert {r.doc_id for r in some} == {None, 1}


def test_spotsigs_pairs_against_all_pairs(spark):
    base = [prose(i, 120) for i in range(8)]
    rows = [(i, t, "s") for i, t in enumerate(base)] + [(100 + i, t + " " + prose(50 + i, 3 * i), "s") for i, t in enumerate(base)] + [(200, base[0], "s"), (201, "", "s"), (202, None, "s")]
    df = docs_of(spark, rows)
    got = {(r.a, r.b): r.similarity for r in spotsigs.near_pairs(df).collect()}
    sets = {r.digest: frozenset(r.sigs) for r in spotsigs.members(df).collect()}
    want = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        s = len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
        if s >= 0.8:
            want[a, b] = s
    assert got.keys() == want.keys() and len(got) > 2
    assert all(got[k] == pytest.approx(want[k]) for k in got)


# ---------------------------------------------------------------- revisits
def test_revisits_by_hand(spark):
    schema = "record_id long, url string, captured long, kind string, etag string, last_modified string, digest string, headers map<string,string>, body string, page string, stretch int"
    rows = [
        (1, "http://www.A.com/x/?b=2&a=1&utm_source=q#f", 10, "response", '"v1"', None, "d1", {"ETag": '"v1"', "Content-Length": "9", "X": "old", "x": "again"}, "one", "p", 1),
        (2, "https://a.com/x?a=1&b=2", 100 * 86400, "response", '"v2"', "m2", "d2", {"Content-Length": "7"}, "two", "p", 1),
        (3, "a.com/x?a=1&b=2", 100 * 86400, "revisit", 'W/"v1"', None, None, {"Cache-Control": "c", "content-length": "0", "X": "new"}, None, "p", 1),
        (4, "a.com/x?a=1&b=2", 300 * 86400, "revisit", '"v9"', None, None, {"q": "r"}, None, "p", 1),
        (5, "a.com/x?a=1&b=2", 300 * 86400, "revisit", None, "m2", None, None, None, "p", 1),
        (6, "a.com/x?a=1&b=2", 5, "revisit", '"v1"', None, None, None, None, "p", 1),
        (7, None, 5, "revisit", None, None, None, None, None, "p", 1), (8, "b.com", None, "revisit", None, None, None, None, None, "p", 1),
        (9, "a.com/x?b=2&a=1", 400 * 86400, "revisit", None, None, None, None, None, "p", 1), (9, "a.com/x?b=2&a=1", 400 * 86400, "revisit", None, None, None, None, None, "p", 1)]
    got = [(r.record_id, r.outcome, r.response_id, r.body) for r in warc.resolved(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(got) == [(3, "resolved", 1, "one"), (4, "validator_mismatch", 2, None), (5, "resolved", 2, "two"), (6, "no_response", None, None), (7, "no_response", None, None),
                           (8, "no_response", None, None), (9, "unverified", 2, "two"), (9, "unverified", 2, "two")]
    merged = {r.record_id: r.headers for r in warc.resolved(spark.createDataFrame(rows, schema)).collect()}
    assert merged[3] == {"etag": '"v1"', "content-length": "9", "x": "new", "cache-control": "c"}
    assert merged[4] == {"q": "r"}


# ---------------------------------------------------------------- classifiers
def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def test_quality_on_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op6_quality"](spark, d).collect() if r.held_out and r.doc_id in labels]
    assert auc([(r.score, labels[r.doc_id]) for r in rows]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in rows)


def test_gam_learns_an_interaction():
    r = np.random.default_rng(1)
    x = r.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert auc(list(zip(model.scores(x[3000:]), y[3000:]))) > 0.95
    assert any({i, j} == {0, 1} for i, j, *_ in model.pairs)
    assert quality.fit(x[:0], y[:0]).scores(x[:0]).shape == (0,)
    assert len(set(quality.fit(x, np.ones(4000)).scores(x))) == 1


def test_classifiers_on_awkward_rows(spark, odd):
    df = docs_of(spark, odd, True)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(30)] + [(None, 1, 1), (4, None, None), (3, 1, 1), (9999, 1, 1)], "doc_id long, quality int, toxic int").withColumn("y", F.lit("x")).withColumn("text", F.lit("x"))
    for found in (quality.scored(df, labels), toxicity.scored(df, labels), toxicity.scored(df, labels.limit(0)), toxicity.scored(df, labels.where("toxic = 1"))):
        rows = found.collect()
        assert Counter(r.doc_id for r in rows) == Counter(i for i, _, _ in odd)
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    kept = quality.accepted(df, labels)
    assert kept.columns == df.columns


def test_nearest_examples_are_exact():
    r = np.random.default_rng(2)
    terms = 60
    idf = r.random(terms) + 0.5
    rows = []
    for i in range(500):
        t = np.sort(r.choice(terms, r.integers(0, 12), replace=False))
        rows.append((i, list(map(int, t)), list(map(int, r.integers(1, 5, len(t)))), int(r.random() < 0.3)))
    index = toxicity.build(rows, idf, {0: 350, 1: 150})
    dense = np.zeros((500, terms))
    place = {int(e): p for p, e in enumerate(index.ids) if e >= 0}
    for i, t, c, _ in rows:
        if t:
            dense[place[i], t] = toxicity.unit(t, c, idf).astype(np.float32)
    for i, t, c, _ in rows[:200]:
        if not t:
            continue
        q = np.zeros(terms)
        q[t] = toxicity.unit(t, c, idf)
        s = dense @ q
        places, values = index.nearest(t, q[t])
        want = np.sort(s[s > 0])[::-1][:toxicity.NEIGHBOURS]
        assert np.allclose(values, want, atol=1e-6) and np.allclose(s[places], values, atol=1e-6)


def test_toxicity_on_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op1_toxicity"](spark, d).collect() if r.held_out and r.doc_id in labels]
    assert auc([(r.score, labels[r.doc_id]) for r in rows]) > 0.8
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
