"""Each stage of the pipeline against plain Python over what the stage before kept."""

from __future__ import annotations

import random

import pytest
import sentencepiece

import corpus_pipeline as pipeline
from inkwell.llm import pieces, quality, simhash

from . import brute
from .test_operators import SCHEMA, SF, awkward

COLUMNS = list(pipeline.COLUMNS)


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def plain_classes(rows):
    """Smallest id of each class of texts whose five-word shingles have a Jaccard similarity of 0.8 or more, all pairs compared."""
    sets = {i: frozenset(simhash.shingle_hashes(simhash.words_of(t or ""), 5).tolist()) for i, t in rows}
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, i in enumerate(ids):
        for j in ids[:a]:
            x, y = sets[i], sets[j]
            if x == y or (min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y)):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {find(i) for i in ids}


@pytest.fixture(scope="module", params=["table", "awkward"])
def docs(request, spark):
    if request.param == "table":
        return spark.read.parquet(f"{SF}/documents.parquet")
    return spark.createDataFrame(awkward(), SCHEMA)


def test_stages(spark, docs, tmp_path):
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    for k, (name, stage) in enumerate(pipeline.STAGES):
        made = stage(spark, docs, SF)
        if k < 4:
            assert made.columns == COLUMNS, name
        before = rows_of(docs)
        if name == "quality rules":
            kept = {r.doc_id for r in quality.verdicts(docs).where("kept").collect()}
            plain = {i for i, v in brute.op6(before).items() if not v[-1]}
            assert kept <= plain and sorted(rows_of(made)) == sorted((i, t) for i, t in before if i in kept)
        elif name == "line dedup":
            want = brute.op10(before)
            got = rows_of(made)
            assert {i: brute.sha(t) for i, t in got} == {i: v[2] for i, v in want.items()} and len(got) == len(before)
            assert all(r.n_chars == len(r.text) for r in made.select("text", "n_chars").collect())
        elif name == "SimHash near-dedup":
            assert {i for i, _ in rows_of(made)} == plain_classes(before)
        elif name == "mixing sources to target weights":
            assert sorted(rows_of(made)) == sorted(before)
        else:
            assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in made.collect()} == brute.op1(before, model)
        made.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")


def test_run_applies_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
    key = lambda df: sorted((r.doc_id, r.ids_sha256) for r in df.collect())
    assert key(pipeline.run(spark, SF)) == key(docs)


def test_odd_rows(spark):
    """Null ids, null and repeated rows: each stage's result is the one its docstring states."""
    good = "word one two three four five six seven eight nine ten " + " ".join(f"w{k}" for k in range(40))
    other = " ".join(f"other{k}" for k in range(60))
    odd = [(None, None, None, None, None), (None, good, None, None, 1), (None, good, "fr", None, 1), (1, None, None, None, None), (1, good, "en", None, 3), (1, good, "en", None, 3), (2, other, None, "s", 4), (2, "short", None, "s", 4)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    empty = spark.createDataFrame([], schema)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
    docs = spark.createDataFrame(odd, schema)
    key = lambda df: sorted((r.doc_id or -1, r.text or "") for r in df.collect())
    stages = dict(pipeline.STAGES)
    kept = stages["quality rules"](spark, docs, SF)
    assert key(kept) == sorted([(-1, good), (-1, good), (1, good), (1, good), (2, other)])
    lines = stages["line dedup"](spark, docs, SF)
    assert key(lines) == key(docs)  # no line is in five documents
    near = stages["SimHash near-dedup"](spark, docs, SF)
    assert key(near) == key(docs)  # rows without an id stay; rows of one id go or stay together
    near = stages["SimHash near-dedup"](spark, docs.unionByName(spark.createDataFrame([(7, good, None, None, None)], schema)).where("text IS NOT NULL"), SF)
    assert (7, good) not in key(near) and (1, good) in key(near)
    assert key(stages["mixing sources to target weights"](spark, docs, SF)) == key(docs)
    assert stages["SentencePiece encoding and decoding"](spark, docs, SF).count() == len(odd)


def test_near_duplicates_are_found(spark):
    """Recall of pairs of different texts whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    cls = {r.id: r.component for r in simhash.near_duplicate_classes(docs).collect()}
    sets = {i: set(simhash.shingle_hashes(simhash.words_of(t or ""), 5).tolist()) for i, t in rows_of(docs)}
    ids = sorted(sets)
    near = [(i, j) for a, i in enumerate(ids) for j in ids[:a] if sets[i] and min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    found = sum(cls[i] == cls[j] for i, j in near)
    assert near and found >= 0.95 * len(near)


def block_edits():
    """(id, text) of 60 texts at 10 * k, each with copies cut, appended to and replaced at the end after it, all above 0.8."""
    rng, rows = random.Random(5), []
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    for k in range(60):
        w = fresh(rng.randrange(200, 900))
        n = len(w)
        made = [w, w[: -n // 10], w[: -3 * n // 20], w + fresh(n // 10), w[: -n // 20] + fresh(n // 20), fresh(n // 11) + w[n // 11 :]]
        rows += [(10 * k + i, " ".join(x)) for i, x in enumerate(made)]
    return rows


def test_block_edits_are_found(spark):
    """Copies that are cut, appended to or replaced in one block are linked to their text."""
    rows = block_edits()
    cls = {r.id: r.component for r in simhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: set(simhash.shingle_hashes(simhash.words_of(t), 5).tolist()) for i, t in rows}
    near = [(i, i - i % 10) for i in sets if i % 10 and len(sets[i] & sets[i - i % 10]) >= 0.8 * len(sets[i] | sets[i - i % 10])]
    missed = [p for p in near if cls[p[0]] != cls[p[1]]]
    assert len(near) >= 290 and len(missed) <= 0.02 * len(near), (len(missed), len(near))


def test_links_are_exact(spark):
    """Classes are those of all pairs with an exact Jaccard similarity of 0.8 or more, with copies near it on both sides."""
    rng, rows = random.Random(6), []
    for k in range(40):
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(100, 600))]
        rows += [(100 * k + i, " ".join(w[: int(len(w) * share)])) for i, share in enumerate((1.0, 0.92, 0.86, 0.82, 0.78, 0.74, 0.7, 0.55))][:: rng.choice((1, 3, 4, 5))]
    rows += [(9000, ""), (9001, None), (9002, "a b"), (9003, "a b"), (9004, "a b c")]
    sets = {i: set(simhash.shingle_hashes(simhash.words_of(t or ""), 5).tolist()) for i, t in rows}
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if j < i and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                x, y = root[i], root[j]
                root = {n: min(x, y) if r in (x, y) else r for n, r in root.items()}
    cls = {r.id: r.component for r in simhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert cls == root


def test_near_dedup_seeks_by_chains_of_fingerprints(spark, monkeypatch):
    """Without the routing keys' groups, the ring's chains alone link texts whose fingerprints are 3 or fewer bits apart and whose sets are near."""
    rng, rows = random.Random(8), []
    for k in range(20):
        w = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
        rows += [(10 * k, " ".join(w)), (10 * k + 1, " ".join(w[:-2])), (10 * k + 2, " ".join(w[: 1000 + 20 * k]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: simhash.np.unique(simhash.shingle_hashes(simhash.words_of(t), 5)) for i, t in rows}
    fps = {i: simhash.majority_bits(simhash.remixed(x, 0)) for i, x in sets.items()}
    whole, nothing = simhash.group_links, spark.createDataFrame([], "u long, v long")
    monkeypatch.setattr(simhash, "group_links", lambda *a, **k: whole(*a, **k) if k["chain"] else nothing)
    monkeypatch.setattr(simhash, "group_linked", lambda *a, **k: nothing)
    cls = {r.id: r.component for r in simhash.near_duplicate_classes(docs).collect()}
    near = {(i, i - i % 10) for i in sets if i % 10 and (fps[i] ^ fps[i - i % 10]).bit_count() <= 3 and len(set(sets[i].tolist()) & set(sets[i - i % 10].tolist())) >= 0.8 * len(sets[i - i % 10])}
    assert len(near) >= 15 and {(i, c) for i, c in cls.items() if i != c} == near
