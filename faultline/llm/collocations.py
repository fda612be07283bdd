"""Phrase collocations from weighted acyclic automata.

Tasks count the 1- to 3-word phrases of bounded shards of text and build an automaton from each sorted shard: states are
frozen as soon as the sorted phrases have left them, equal states are kept once, and the weight of a path's last arc is the
phrase's count. Automata are cut into prefix ranges of about equal size; each range unites its shards' automata, adds the
weights, and keeps the phrases that are frequent enough to matter (a phrase is never more frequent than its parts). The
counts of a candidate's parts are looked up by composing automata of the asked phrases with the range that holds them; a
request carries the largest count of the longer phrases that ask, so the range also learns which phrases those cover.

Nothing is broadcast but the borders of the ranges, at most ``MOST_BORDERS`` phrases, which steer the balance only.
"""
from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from faultline.llm import common
from faultline.llm.common import LOWER, UPPER
from faultline.llm.tokens import give_back
from faultline.session import cut_lineage

LONGEST, LEAST, COVER, TOP, SCALE = 3, 10, 50, 2000, 1_000_000
SHARD, CHUNK = 1_000_000, 500_000      # words counted before automata are built; words taken from a text at a time
RANGE, SAMPLE = 1_500_000, 4_000       # phrases of a range before they are united; texts whose phrases give the borders
MOST_BORDERS = 1 << 20
BITS = 21                              # of a word's number; SHARD + CHUNK words fit in
LOW = (1 << BITS) - 1
MOST_WORDS = LOW - 1                   # of united parts; more are cut in two
STOP = b"."                            # stands for every character that ends a piece, so no word equals it
ENDS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d", STOP * 10)
UNKNOWN = "und"
Phrases = tuple[list[bytes], np.ndarray, np.ndarray]                 # sorted words, sorted keys, weights


def tokens(text: str) -> list[bytes]:
    """Words of a text with A-Z lower-cased, and STOP wherever a piece ends."""
    return text.encode().lower().translate(ENDS).replace(STOP, b" . ").split()      # bytes split at ASCII blanks only


def parted(keys: np.ndarray) -> list[np.ndarray]:
    """Numbers of the first, second and third word from 1; 0 where a phrase is shorter."""
    return [(keys >> BITS * (LONGEST - 1 - i)) & LOW for i in range(LONGEST)]


def joined(words: list[np.ndarray]) -> np.ndarray:
    return (words[0] << 2 * BITS) | (words[1] << BITS) | words[2]


# automata ------------------------------------------------------------------------------------------------------------

def frozen(starts: np.ndarray, *arcs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Register of states given as stretches of arcs: each state's number among the different ones, and those kept."""
    raw = np.ascontiguousarray(np.stack(arcs, 1).astype(np.int64)).tobytes()
    width = 8 * len(arcs)
    at = (starts * width).tolist()
    register: dict[bytes, int] = {}
    number = [register.setdefault(raw[a:z], len(register)) for a, z in zip(at, at[1:])]
    number = np.array(number, np.int64)
    _, kept = np.unique(number, return_index=True)
    return number, kept


def stretches(starts: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the arcs of the picked states one after the other, and the offsets of their stretches."""
    sizes = starts[pick + 1] - starts[pick]
    offsets = np.concatenate([[0], sizes.cumsum()]).astype(np.int64)
    return np.repeat(starts[pick] - offsets[:-1], sizes) + np.arange(offsets[-1]), offsets


def narrow(a: np.ndarray) -> bytes:
    kind = next(k for k in (1, 2, 4, 8) if not a.size or int(a.max()) < 1 << 8 * k - (k == 8))
    return bytes([kind]) + len(a).to_bytes(8, "little") + a.astype(f"<u{kind}").tobytes()


def wide(data: bytes, at: int) -> tuple[np.ndarray, int]:
    kind, n = data[at], int.from_bytes(data[at + 1:at + 9], "little")
    return np.frombuffer(data, f"<u{kind}", n, at + 9).astype(np.int64), at + 9 + kind * n


def automaton(words: list[bytes], keys: np.ndarray, weights: np.ndarray) -> bytes:
    """The automaton of sorted phrases: root arcs, states after one word, states after two; equal states once."""
    parts = parted(keys)
    used = np.unique(np.concatenate(parts))
    used = used[used > 0]
    parts = [np.searchsorted(used, p) * (p > 0) + (p > 0) for p in parts]           # numbered anew from 1
    # a third word is an arc of the state after two words
    last = parts[2] > 0
    pair = parts[0] << BITS | parts[1]
    first_of = np.flatnonzero(np.concatenate([[True], pair[last][1:] != pair[last][:-1]])) if last.any() else np.zeros(0, np.int64)
    starts3 = np.append(first_of, last.sum())
    number3, kept3 = frozen(starts3, parts[2][last], weights[last])
    arcs3, offsets3 = stretches(starts3, kept3)
    # a second word is an arc of the state after one word: (label, weight, target), with 0 for no weight and no target
    pairs = np.unique(pair[parts[1] > 0])
    weight2, target2 = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    two = (parts[1] > 0) & ~last
    weight2[np.searchsorted(pairs, pair[two])] = weights[two]
    target2[np.searchsorted(pairs, pair[last][first_of])] = number3 + 1
    head = pairs >> BITS
    first_of = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]])) if len(head) else np.zeros(0, np.int64)
    starts2 = np.append(first_of, len(head))
    number2, kept2 = frozen(starts2, pairs & LOW, weight2, target2)
    arcs2, offsets2 = stretches(starts2, kept2)
    roots = np.unique(parts[0])
    weight1, target1 = np.zeros(len(roots), np.int64), np.zeros(len(roots), np.int64)
    one = parts[1] == 0
    weight1[np.searchsorted(roots, parts[0][one])] = weights[one]
    target1[np.searchsorted(roots, head[first_of])] = number2 + 1
    arrays = [roots, weight1, target1, offsets2, (pairs & LOW)[arcs2], weight2[arcs2], target2[arcs2], offsets3, parts[2][last][arcs3], weights[last][arcs3]]
    return b"".join(map(narrow, arrays)) + b"\n".join(words[i - 1] for i in used.tolist())


def phrases(data: bytes) -> Phrases:
    """All paths with a weight, in order."""
    words, keys, weights = unsplit(data)
    return words.split(b"\n") if words else [], keys, weights


def unsplit(data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The same with the words as one string of lines."""
    arrays, at = [], 0
    for _ in range(10):
        a, at = wide(data, at)
        arrays.append(a)
    label1, weight1, target1, offsets2, label2, weight2, target2, offsets3, label3, weight3 = arrays
    on = np.flatnonzero(target1 > 0)
    arcs, ends = stretches(offsets2, target1[on] - 1)
    first = np.repeat(label1[on], np.diff(ends))
    second, w2, t2 = label2[arcs], weight2[arcs], target2[arcs]
    deep = np.flatnonzero(t2 > 0)
    arcs, ends = stretches(offsets3, t2[deep] - 1)
    above = np.repeat(deep, np.diff(ends))
    keys = np.concatenate([label1[weight1 > 0] << 2 * BITS, (first << 2 * BITS | second << BITS)[w2 > 0],
                           first[above] << 2 * BITS | second[above] << BITS | label3[arcs]])
    weights = np.concatenate([weight1[weight1 > 0], w2[w2 > 0], weight3[arcs]])
    order = np.argsort(keys)
    return data[at:], keys[order], weights[order]


def key_of(words: list[bytes], phrase: tuple[bytes, ...]) -> int:
    """Where a phrase stands among the keys over sorted ``words``: keys below the result are smaller phrases."""
    key = 0
    for i, word in enumerate(phrase):
        at = bisect_left(words, word)
        shift = BITS * (LONGEST - 1 - i)
        if at == len(words) or words[at] != word:
            return key | at + 1 << shift
        key |= at + 1 << shift
    return key


def split_at(p: Phrases, borders: list[tuple[bytes, ...]]) -> Iterator[tuple[int, Phrases]]:
    """Non-empty prefix ranges of sorted phrases: (range number, phrases); range i starts at border i - 1."""
    words, keys, weights = p
    marks = [0, *np.searchsorted(keys, np.array([key_of(words, b) for b in borders], np.int64)).tolist(), len(keys)]
    for i, (lo, hi) in enumerate(zip(marks, marks[1:])):
        if lo < hi:
            yield i, (words, keys[lo:hi], weights[lo:hi])


def phrase_at(words: list[bytes], key: int) -> tuple[bytes, ...]:
    return tuple(words[n - 1] for n in (key >> 2 * BITS, key >> BITS & LOW, key & LOW) if n)


def lines(words: list[bytes] | bytes) -> list[bytes]:
    return words.split(b"\n") if isinstance(words, bytes) else words


def union(parts: list, combine=np.add) -> Iterator[Phrases]:
    """The united phrases, weights of equal ones combined, as consecutive prefix ranges. Parts' words may be unsplit.

    One range is enough unless the words of all parts are more than a key can number; then the parts are cut in two at a
    middle phrase first.
    """
    parts = [p for p in parts if len(p[1])]
    if not parts:
        return
    words = sorted(set(chain.from_iterable(lines(p[0]) for p in parts)))
    if len(words) > MOST_WORDS:
        middle = max(parts, key=lambda p: len(p[1]))
        if len(middle[1]) > 1:
            border = phrase_at(lines(middle[0]), int(middle[1][len(middle[1]) // 2]))
        else:
            border = max(phrase_at(lines(p[0]), int(p[1][0])) for p in parts)
        halves: dict[int, list[Phrases]] = {0: [], 1: []}
        for p in parts:
            for i, (w, k, n) in split_at((lines(p[0]), *p[1:]), [border]):
                halves[i].append(renumbered(w, k, n))
        if halves[0] and halves[1]:
            yield from union(halves[0], combine)
            yield from union(halves[1], combine)
            return
        raise ValueError("a single phrase cannot hold so many words")
    number = {w: i + 1 for i, w in enumerate(words)}
    keys, weights = [], []
    for w, k, n in parts:                                            # words of one part at a time
        new = np.array([0, *map(number.__getitem__, lines(w))], np.int64)
        keys.append(joined([new[x] for x in parted(k)]))
        weights.append(n)
    k, n = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    yield words, k[first], combine.reduceat(n, first)


def renumbered(words: list[bytes], keys: np.ndarray, weights: np.ndarray) -> Phrases:
    """The same phrases over the words they use."""
    parts = parted(keys)
    used = np.unique(np.concatenate(parts))
    used = used[used > 0]
    return [words[i - 1] for i in used.tolist()], joined([np.searchsorted(used, p) * (p > 0) + (p > 0) for p in parts]), weights


def composed(asked: Phrases, counts: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """For each asked phrase: its weight in ``counts`` (0: none). Both sides walk their common words only."""
    words, keys, _ = asked
    at = {w: i + 1 for i, w in enumerate(counts[0])}
    new = np.array([0, *(at.get(w, LOW) for w in words)], np.int64)                 # LOW numbers no word of a range
    wanted = joined([new[x] for x in parted(keys)])
    place = np.minimum(np.searchsorted(counts[1], wanted), max(len(counts[1]) - 1, 0))
    found = counts[1][place] == wanted if len(counts[1]) else np.zeros(len(wanted), bool)
    return np.where(found, counts[2][place], 0) if len(counts[1]) else np.zeros(len(wanted), np.int64), found


# the job -------------------------------------------------------------------------------------------------------------

class Numbers(dict):
    """Numbers new words as they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Shard:
    """Word numbers of one language's texts; STOP is number 0. Phrases start at owned places only."""

    def __init__(self):
        self.number = Numbers({STOP: 0})
        self.ids: list[np.ndarray] = []
        self.own: list[np.ndarray] = []

    def add(self, words: list[bytes], owned: int) -> None:
        ids = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        self.ids.append(np.append(ids, 0))
        self.own.append(np.arange(len(words) + 1) < owned)

    def counted(self) -> Phrases:
        words = sorted(w for w in self.number if w != STOP)
        rank = np.zeros(len(self.number), np.int64)
        rank[[self.number[w] for w in words]] = np.arange(1, len(words) + 1)
        w = np.concatenate([*(rank[x] for x in self.ids), [0, 0]])
        own = np.concatenate([*self.own, [False, False]])
        a, b, c = w[:-2], w[1:-1], w[2:]
        one = own[:-2] & (a > 0)
        two = one & (b > 0)
        three = two & (c > 0)
        found = [np.unique(k, return_counts=True) for k in ((a << 2 * BITS)[one], (a << 2 * BITS | b << BITS)[two], (a << 2 * BITS | b << BITS | c)[three])]
        keys, n = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(keys)
        return words, keys[order], n[order].astype(np.int64)


def phrases_near(octets: int) -> int:
    """About how many different phrases the shards of so many bytes of text hold together."""
    return octets // 3


def counting(borders: dict[str, list[tuple[bytes, ...]]], shard: int):
    """A task's work: ``(lang, part, automaton)`` for each prefix range of each shard of about ``shard`` words."""
    chunk = min(CHUNK, shard)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Shard] = {}
        size = 0
        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                words = tokens(text)
                for lo in range(0, len(words), chunk):
                    part = words[lo:lo + chunk + LONGEST - 1]
                    held.setdefault(lang, Shard()).add(part, min(chunk, len(words) - lo))
                    size += len(part)
                    if size >= shard:
                        yield from written(held)
                        held, size = {}, 0
        yield from written(held)
        give_back()

    def written(held: dict[str, Shard]) -> Iterator[pd.DataFrame]:
        for lang in list(held):
            found = held.pop(lang).counted()
            for i, p in split_at(found, borders.get(lang, [])):
                yield pd.DataFrame([(lang, i, automaton(*p))], columns=["lang", "part", "automaton"])

    return count


def borders_of(texts: DataFrame, size: int, rows: int = SAMPLE) -> dict[str, list[tuple[bytes, ...]]]:
    """Sorted borders of each language's prefix ranges, so that a range has about ``size`` phrases before they are united.

    They are quantiles of the phrases of about ``rows`` texts chosen by hash and steer the balance only.
    """
    octets = F.sum(F.octet_length("text"))
    have, total = texts.agg(F.count("*"), F.coalesce(octets, F.lit(0))).first()
    large = {lang: min(MOST_BORDERS, -(-phrases_near(n) // size)) for lang, n in
             texts.groupBy("lang").agg(octets.alias("n")).where(F.col("n") > 3 * size).collect()}        # total / size rows at most
    if not large:
        return {}
    every = max(1, have // rows)
    skip = max(1, phrases_near(total // every) // (64 * sum(large.values())))

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in counting({}, SHARD)(batches):
            words, keys, _ = phrases(b["automaton"][0])
            at = keys[len(keys) % skip // 2::skip].tolist()
            yield pd.DataFrame({"lang": b["lang"][0], "phrase": [b" ".join(phrase_at(words, k)).decode() for k in at]})

    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).mapInPandas(pick, "lang string, phrase string")
    seen: dict[str, list[tuple[bytes, ...]]] = {}
    for lang, phrase in some.where(F.col("lang").isin(list(large)) if len(large) < 1000 else F.lit(True)).collect():
        seen.setdefault(lang, []).append(tuple(phrase.encode().split(b" ")))
    return {lang: sorted({x[len(x) * i // n] for i in range(1, n)}) for lang, n in large.items() if (x := sorted(seen.get(lang, [])))}


def counts(docs: DataFrame, least: int = LEAST, size: int = RANGE, shard: int = SHARD) -> tuple[DataFrame, dict[str, list[tuple[bytes, ...]]]]:
    """``(lang, part, words, automaton)`` for each prefix range: occurrences of words, and the phrases met ``least`` times.

    The second result holds the borders of the ranges.
    """
    common.small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    borders = borders_of(texts, size)
    shared = docs.sparkSession.sparkContext.broadcast(borders)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return counting(shared.value, shard)(batches)

    def unite(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        said, kept = 0, []
        for words, keys, n in union([unsplit(x) for x in group["automaton"]]):
            said += int(n[(keys & ((1 << 2 * BITS) - 1)) == 0].sum())
            on = n >= least
            kept.append(automaton(*renumbered(words, keys[on], n[on])) if on.any() else None)
        rows = [(*key, said if i == 0 else 0, x) for i, x in enumerate(kept)]
        give_back()
        return pd.DataFrame(rows, columns=["lang", "part", "words", "automaton"])

    dealt = texts.mapInPandas(deal, "lang string, part int, automaton binary")
    return cut_lineage(dealt.groupBy("lang", "part").applyInPandas(unite, "lang string, part int, words long, automaton binary")), borders


def frequent(group: pd.DataFrame) -> Phrases:
    """The phrases of one prefix range, whose automata follow each other or are one."""
    found = list(union([phrases(x) for x in group["automaton"] if x is not None]))
    if len(found) > 1:
        raise ValueError(f"frequent phrases of one range hold over {MOST_WORDS} words: choose smaller ranges")
    return found[0] if found else ([], np.zeros(0, np.int64), np.zeros(0, np.int64))


def cuts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of candidates: which have three words, and keys of the parts (first, rest) for the cut after one word."""
    a, b, c = parted(keys)
    zero = np.zeros_like(a)
    return c > 0, joined([a, zero, zero]), joined([b, c, zero])


def collocations(docs: DataFrame, least: int = LEAST, cover: int = COVER, top: int = TOP, size: int = RANGE, shard: int = SHARD) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``top`` phrases of two or three words.

    ``a``, ``l`` and ``r`` are the occurrences of the phrase and of the two parts of its lowest-scoring cut (ties: the
    earlier one), ``n`` those of all words, ``score`` = floor(SCALE * a * a / (l * r)) in exact integers. Candidates occur
    ``least`` times; those whose words lie inside a longer candidate with at least ``cover`` percent of their occurrences
    are dropped. Words are runs of characters other than space and tab inside pieces between ``. , ; : ! ?`` and line ends,
    A-Z lower-cased. Null texts count as empty, a null language as ``und``; repeated rows count again, doc_id and other
    columns are not read. Equal scores are ordered by ``a`` and then by the phrase's UTF-8 bytes. An empty table gives none.
    """
    table, borders = counts(docs, least, size, shard)
    shared = docs.sparkSession.sparkContext.broadcast(borders)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for lang, part, data in zip(b["lang"], b["part"], b["automaton"], strict=True):
                words, keys, n = phrases(data)
                on = (keys & ((1 << 2 * BITS) - 1)) > 0
                three, first, rest = cuts(keys[on])
                k, f = keys[on], n[on]
                asked = np.concatenate([first, rest, k[three] & ~LOW, (k[three] & LOW) << 2 * BITS])
                longer = np.concatenate([np.zeros(len(k), np.int64), np.where(three, f, 0), f[three], np.zeros(int(three.sum()), np.int64)])
                order = np.lexsort((-longer, asked))
                asked, longer = asked[order], longer[order]
                once = np.flatnonzero(np.concatenate([[True], asked[1:] != asked[:-1]])) if len(asked) else np.zeros(0, np.int64)
                # weights are stored from 1, as 0 marks a prefix without a phrase
                rows += [(lang, to, part, automaton(*p)) for to, p in split_at((words, asked[once], longer[once] + 1), shared.value.get(lang, []))]
            yield pd.DataFrame(rows, columns=["lang", "part", "asker", "automaton"])

    def answer(key: tuple, own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        lang, part = key
        table = frequent(own)
        rows, wanted = [], []
        for asker, data in zip(asking["asker"], asking["automaton"], strict=True):
            p = phrases(data)
            wanted.append(p)
            n, found = composed(p, table)
            rows.append((lang, int(asker), False, automaton(*renumbered(p[0], p[1][found], n[found]))))
        for p in union(wanted, np.maximum):
            n, found = composed(p, table)
            covered = [100 * (int(x) - 1) >= cover * int(f) if x > 1 else False for x, f in zip(p[2], n, strict=True)]
            on = found & np.array(covered, bool)
            if on.any():
                rows.append((lang, part, True, automaton(*renumbered(p[0], p[1][on], n[on]))))
        return pd.DataFrame(rows, columns=["lang", "part", "covered", "automaton"])

    def score(key: tuple, own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        words, keys, n = frequent(own)
        on = (keys & ((1 << 2 * BITS) - 1)) > 0
        keys, n = keys[on], n[on]
        gone = [phrases(x) for x, c in zip(told["automaton"], told["covered"], strict=True) if c]
        for p in gone:
            _, hit = composed((words, keys, n), p)
            keys, n = keys[~hit], n[~hit]
        three, first, rest = cuts(keys)
        known = [phrases(x) for x, c in zip(told["automaton"], told["covered"], strict=True) if not c]

        def look(asked: np.ndarray) -> np.ndarray:
            out = np.zeros(len(asked), np.int64)
            for p in known:
                out = np.maximum(out, composed((words, asked, asked), p)[0])
            return out.astype(object)

        a, l, r = n.astype(object), look(first), look(rest)
        best = SCALE * a * a // (l * r)
        i = np.flatnonzero(three)
        l2, r2 = look(keys[i] & ~LOW), look((keys[i] & LOW) << 2 * BITS)
        second = SCALE * a[i] * a[i] // (l2 * r2)
        lower = i[second < best[i]]
        at = np.flatnonzero(second < best[i])
        l[lower], r[lower], best[lower] = l2[at], r2[at], second[at]
        rows = [(b" ".join(phrase_at(words, int(k))), int(x), int(y), int(z), int(s)) for k, x, y, z, s in zip(keys, a, l, r, best, strict=True)]
        rows = sorted(rows, key=lambda t: (-t[4], -t[1], t[0]))[:top]               # no other of this range can be reported
        return pd.DataFrame([(key[0], t[0].decode(), *t[1:]) for t in rows], columns=["lang", "phrase", "a", "l", "r", "score"])

    some = table.where("automaton IS NOT NULL").select("lang", "part", "automaton")
    asked = some.mapInPandas(ask, "lang string, part int, asker int, automaton binary")
    by = ["lang", "part"]
    told = cut_lineage(some.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(answer, "lang string, part int, covered boolean, automaton binary"))
    scored = some.groupBy(*by).cogroup(told.groupBy(*by)).applyInPandas(score, "lang string, phrase string, a long, l long, r long, score long")
    said = table.groupBy("lang").agg(F.sum("words").alias("n"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    bucket = F.pmod(F.xxhash64("phrase"), F.lit(64))
    near = (scored.withColumn("bucket", bucket).withColumn("rank", F.row_number().over(W.partitionBy("lang", "bucket").orderBy(*order)))
            .where(F.col("rank") <= top))
    best = near.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(said, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = f"""WITH pieces AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang,
      unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
    listed AS (SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
    words AS (SELECT lang, p, unnest(range(len(w))) AS i, unnest(w) AS a FROM listed),
    places AS (SELECT lang, a, lead(a, 1) OVER (PARTITION BY p ORDER BY i) AS b, lead(a, 2) OVER (PARTITION BY p ORDER BY i) AS c FROM words),
    found AS (SELECT lang, 1 AS k, a AS phrase, count(*) AS f FROM places GROUP BY ALL
      UNION ALL SELECT lang, 2, a || ' ' || b, count(*) FROM places WHERE b IS NOT NULL GROUP BY ALL
      UNION ALL SELECT lang, 3, a || ' ' || b || ' ' || c, count(*) FROM places WHERE c IS NOT NULL GROUP BY ALL),
    candidates AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM found WHERE k > 1 AND f >= {LEAST}),
    cut AS (SELECT c.lang, c.k, c.phrase, c.f AS a, x.f AS l, y.f AS r, j, ({SCALE}::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f) AS score
      FROM candidates c JOIN range(1, {LONGEST}) AS s(j) ON j < c.k
      JOIN found x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:j], ' ') AND x.k = j
      JOIN found y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[j + 1:], ' ') AND y.k = c.k - j),
    lowest AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
    inside AS (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, f FROM candidates WHERE k = 3
      UNION ALL SELECT lang, array_to_string(w[2:3], ' '), f FROM candidates WHERE k = 3),
    covers AS (SELECT lang, phrase, max(f) AS f FROM inside GROUP BY ALL),
    kept AS (SELECT t.* FROM lowest t LEFT JOIN covers c ON t.k = 2 AND c.lang = t.lang AND c.phrase = t.phrase
      WHERE c.f IS NULL OR 100 * c.f < {COVER} * t.a),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked
    JOIN (SELECT lang, sum(f) AS n FROM found WHERE k = 1 GROUP BY lang) USING (lang) WHERE rank <= {TOP}"""
