"""The pipeline's stages, each against a plain version on its own input."""
import re
from collections import Counter, defaultdict

import pytest
from test_operators_llm import SF, components_brute, fp_brute, low

import corpus_pipeline
from faultline.llm import quality
from faultline.llm.packing import CAPACITY


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Input and output of each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, SF).write.parquet(path)
        found = spark.read.parquet(path)
        out.append((docs, found))
        docs = found
    return out


def test_stages_keep_the_columns_of_documents(stored):
    for before, after in stored[:-1]:
        assert after.columns == before.columns
        assert after.count() > 0


def test_quality_stage(spark, stored):
    before, after = stored[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    keep = {r.doc_id for r in quality.scored(before, labels).where("predicted = 1").collect()}
    assert Counter(r.doc_id for r in after.collect()) == Counter(r.doc_id for r in before.collect() if r.doc_id in keep)


def test_exact_stage(stored):
    before, after = ([(r.doc_id, r.text) for r in x.collect()] for x in stored[1])
    best = {}
    for i, t in before:
        best[low(t)] = max(i, best.get(low(t), -1))
    assert sorted(i for i, _ in after) == sorted(best.values())


def test_near_stage(stored):
    before, after = ([(r.doc_id, r.text) for r in x.collect()] for x in stored[2])
    comp = components_brute([fp_brute(t) for _, t in before])
    first = {}
    for (i, _), c in zip(before, comp):
        first[c] = min(i, first.get(c, i))
    assert sorted(i for i, _ in after) == sorted(first.values())


def test_mix_stage(stored):
    before, after = (x.collect() for x in stored[3])
    own, got = Counter(), Counter()
    for r in before:
        own[r.source] += size(r.text)
    for r in after:
        got[r.source] += size(r.text)
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(own))}
    free = [s for s in own if got[s] < 2 * own[s] - 1]
    levels = [got[s] / weights[s] for s in free]
    assert abs(sum(got.values()) - 1.5 * sum(own.values())) <= len(own)
    assert all(got[s] <= 2 * own[s] for s in own) and max(levels) - min(levels) <= 2
    twice = Counter(r.doc_id for r in after)
    assert max(twice.values()) <= 2 and max(Counter((r.doc_id, r.text) for r in after).values()) == 2


def test_pack_stage(stored):
    before, after = (x.collect() for x in stored[4])
    assert Counter(r.doc_id for r in before) == Counter(r.doc_id for r in after if r.piece == 0)
    bins = defaultdict(list)
    for r in after:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= CAPACITY
    assert len(bins) <= sum(r.length for r in after) / CAPACITY + 2


def test_run_gives_the_last_stage(spark, stored):
    rows = corpus_pipeline.run(spark, SF)
    key = lambda df: Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert key(rows) == key(stored[-1][1])
