"""The ten operators against plain versions of themselves, on awkward rows and on the small tables."""

from __future__ import annotations

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import classifier, digest, licenses, linededup, mixing, passages, pieces, pii, quality, simhash
from inkwell.llm.queries import QUERIES

from . import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, words string, h1 long"


def awkward() -> list[tuple]:
    """Nulls, empty and very long texts, ties, copies, repeated words, and columns whose names clash with the operators' own."""
    rng = random.Random(11)
    vocab = ["alpha", "beta", "Gamma", "delta", "naïve", "Straße", "ﬁne", "ｆｕｌｌ", "東京", "\U0001f600", "mit", "license", "under", "the"]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared = "this is one common line that many of the documents share between them"
    base = line(300)
    texts = [None, "", " ", "\n", "\n\n", "one", "one two", base, base, base.upper(), base + " more words", base[:-40], line(20_000), "word " * 60, "a b c d e f g h " * 9]
    texts += [f"{line(15)}\n  {shared.upper()} \n{line(9)}\r\n{shared}\n{shared}\t" for _ in range(6)]
    texts += ["under the mit license", "Apache License, Version 2.0", "CC-BY-NC 4.0", "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0 WITH Classpath-exception-2.0\nx"]
    texts += ["mail a.b@c-d.org or x@y.z.", "at 10.0.0.1 and 999.1.1.1 and 1.2.3.4.5.6.7.8", "card 4111 1111 1111 1111, 4111 1111 1111 1112", "call +1 (555) 010-9999 or +12", "é +49 170 1234567 é"]
    texts += [line(50) + base[:600] + line(50), line(30) + base[:600] + line(20), "x" * 399, "y" * 401, "ab" * 500]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, None, -i, "k", "w", 5) for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def test_op1_equals_the_library(spark, frame, small, model):
    got = {r.id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.encode_documents(frame, pieces.default_model()).collect()}
    assert got == brute.op1(pairs(awkward()), model)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op1_sentencepiece"](spark, SF).collect()}
    assert got == brute.op1(small, model)


def test_op1_keeps_ids_and_text(frame, model):
    for r in pieces.encode_documents(frame.where("doc_id < 12"), pieces.default_model()).collect():
        assert r.decoded == model.decode(r.ids) and len(r.ids) == r.n_tokens


def canonical(text):
    out = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return re.sub(r"[\s\u0085  ]+", " ", out).strip(" ")


def check_op2(rows, got):
    edits = brute.op2_edits(rows)
    line = sorted(((i, t or "") for i, t in rows), reverse=True)
    by_form, by_print = {}, {}
    for k, (i, t) in enumerate(line):
        r, after = got[i], line[(k + 1) % len(line)][1]
        n = len(t) // 3
        edited = t[: len(t) - n] + after[:n]
        assert (r.n_chars, r.edited_sha256) == edits[i]
        assert r.near_edited == float(canonical(t) == canonical(edited)) and r.near_next == float(canonical(t) == canonical(after))
        by_form.setdefault(canonical(t), set()).add(r.fingerprint)
        by_print.setdefault(r.fingerprint, set()).add(canonical(t))
    assert all(len(x) == 1 for x in [*by_form.values(), *by_print.values()])


def test_op2_edits_and_equal_forms(spark, frame, small, tmp_path):
    got = {r.doc_id: r for r in QUERIES["op2_canonical_digest"](spark, SF).collect()}
    check_op2(small, got)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    check_op2(pairs(awkward()), {r.doc_id: r for r in QUERIES["op2_canonical_digest"](spark, str(tmp_path)).collect()})


def test_op2_next_document_over_many_ranges(spark):
    rows = [(i * 700, str(i)) for i in range(50)]
    made = {r.doc_id: r.next_text for r in digest.successor(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", ["text"]).collect()}
    assert made == {i * 700: str((i - 1) % 50) for i in range(50)}


def test_op3_fingerprints_and_components(spark, frame, small):
    got = {r.id: (f"{r.fp & (1 << 64) - 1:016x}", r.component) for r in simhash.hamming_components(frame).collect()}
    assert got == brute.op3(pairs(awkward()))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op3_simhash_neardup"](spark, SF).collect()}
    assert got == brute.op3(small)


def test_op3_hot_keys_are_split(spark, small):
    """Keys of more rows than ``hot`` meet by pairs of blocks and give the same classes."""
    base = " ".join(f"w{k}" for k in range(400)).split()
    rows = [(i, " ".join(base[: 5 * (i % 60)] + ["x" * (i % 60)] + base[5 * (i % 60) :])) for i in range(120)] + [(1000 + i, t) for i, t in small[:80]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: (f"{r.fp & (1 << 64) - 1:016x}", r.component) for r in simhash.hamming_components(df, hot=4).collect()}
    assert got == brute.op3(rows)
    wide = lambda hot: sorted((r.id, r.component) for r in simhash.near_duplicate_classes(df, hot=hot).collect())
    assert wide(4) == wide(simhash.HOT)


def test_op3_finds_every_link_of_three_bits():
    """Every pair of three differing bits at most shares a chain head and passes its chain."""
    rng = np.random.default_rng(2)
    for _ in range(3000):
        a = int(rng.integers(0, 1 << 63))
        d = sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False))
        segments = [(d >> 8 * i) & 255 for i in range(8)]
        heads = [s for s in range(8) for h in simhash.EXACT_HEADS if all(segments[(s + o) % 8] == 0 for o in h)]
        assert any(simhash._chain_ok(np.array([d], np.uint64), np.array([8 * s], np.uint64), 3)[0] for s in heads), (a, d)


@pytest.mark.parametrize("constant", [4, 5, 6, 7])
def test_op3_cuts_of_large_groups_lose_no_link(monkeypatch, constant):
    """Groups above DENSE give the classes of all compared pairs, however many segments are equal in the whole group."""
    rng = np.random.default_rng(constant)
    free = 64 - 8 * constant
    base = rng.integers(0, 1 << free, 60).tolist()
    near = [b ^ sum(1 << int(x) for x in rng.choice(free, rng.integers(1, 5), replace=False)) for b in base for _ in range(3)]
    if constant == 5:  # one bit in each of the three segments that vary
        near += [base[0] ^ (1 << 3 | 1 << 11 | 1 << 19)]
    fp = np.unique(np.array(base + near, np.uint64) << np.uint64(8 * constant) | np.uint64(0x5A))
    ids = np.arange(len(fp))

    def classes(links):
        root = ids.copy()
        for u, v in links:
            for x, y in zip(u.tolist(), v.tolist(), strict=True):
                root[root == max(root[x], root[y])] = min(root[x], root[y])
        return root.tolist()

    pairs = [(np.array([i]), np.array([j])) for i in ids for j in ids[:i] if int(fp[i] ^ fp[j]).bit_count() <= 3]
    monkeypatch.setattr(simhash, "DENSE", 8)
    links = simhash._links_of_group(ids, fp[:, None], 3)
    assert all(int(fp[x] ^ fp[y]).bit_count() <= 3 for u, v in links for x, y in zip(u, v, strict=True))
    assert classes(links) == classes(pairs)


def plain_schedule(rows, weights, block, period):
    """(source, block, release, deadline, slot) of each (id, source), slot by slot for as long as there are rows."""
    parts, order = mixing.shares(weights, period), {}
    period = sum(parts.values())
    for i, s in rows:
        order.setdefault(s or "", []).append((hashlib.md5(str(i).encode()).hexdigest(), i))
    blocks = {s: [sorted(x)[k : k + block] for k in range(0, len(x), block)] for s, x in order.items()}
    out, done, slot = {}, dict.fromkeys(parts, 0), 0
    while any(done[s] < len(b) for s, b in blocks.items()):
        due = []
        for s, k in parts.items():
            j = done[s]
            if j * period // k <= slot:
                due.append((-(-(j + 1) * period // k), s, j, j * period // k))
        deadline, s, j, release = min(due)
        for h, i in blocks.get(s, [])[j : j + 1] and blocks[s][j]:
            out[i] = (s, j, release, deadline, slot, h)
        done[s] += 1
        slot += 1
    return out


@pytest.mark.parametrize("weights", [{"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}, {"a": 3.0, "b": 1.0, "c": 1.0, "d": 0.001}])
def test_op4_equals_a_plain_schedule(spark, weights):
    rows = [(i, s) for i, s in enumerate(["a"] * 900 + ["b"] * 600 + ["c"] * 400 + ["d"] * 130)]
    made = mixing.schedule(spark.createDataFrame(rows, "doc_id long, source string"), weights, block=10).collect()
    got = {r.doc_id: (r.mix_source, r.mix_block, r.mix_release, r.mix_deadline, r.mix_slot, r.mix_order) for r in made}
    assert got == plain_schedule(rows, weights, 10, None)


def test_op4_query_equals_a_plain_schedule(spark):
    docs = [(r.doc_id, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    counts = Counter(s or "" for _, s in docs)
    want = plain_schedule(docs, {s: n**0.5 for s, n in counts.items()}, mixing.BLOCK, None)
    got = {r.doc_id: (r.source or "", r.block, r.release, r.deadline, r.slot, r.order) for r in QUERIES["op4_mixing"](spark, SF).collect()}
    assert got == want


def test_op4_deviates_less_than_a_block(spark):
    weights = {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}
    parts = mixing.shares(weights)
    period, run = sum(parts.values()), dict.fromkeys(parts, 0)
    for source, _, release, deadline, slot in mixing.period_slots(parts):
        assert release <= slot < deadline
        run[source] += 1
        assert all(abs(run[s] - (slot + 1) * k / period) < 1 for s, k in parts.items())
    rows = [(i, s) for i, s in enumerate(["a"] * 90 + ["b"] * 60 + ["c"] * 40 + ["d"] * 13)] + [(5000, "d"), (5000, "d"), (None, "d"), (None, "d"), (None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    made = mixing.schedule(df, weights, block=10).collect()
    assert len(made) == len(rows)
    slots = {}
    for r in made:
        slots.setdefault(r.mix_slot, []).append(r)
    assert all(len({x.source for x in v}) == 1 and len(v) <= 10 for v in slots.values())
    assert mixing.mixed(df.where("false"), weights).count() == 0
    with pytest.raises(ValueError):
        mixing.schedule(df, {"a": 1.0})


def test_op4_shares_follow_the_weights():
    """Hundreds of sources have their true shares, and small ones a slot at least."""
    weights = {f"s{k}": float(k + 1) for k in range(700)}
    parts = mixing.shares(weights)
    total, period = sum(weights.values()), sum(parts.values())
    assert all(abs(parts[s] / period - w / total) <= 1.01 / period for s, w in weights.items())
    assert min(mixing.shares({"a": 1e9, "b": 1.0}).values()) == 1


def test_op4_any_number_of_sources(spark, monkeypatch):
    """Sources beyond STREAMS share one stream; no row is lost and none raises."""
    monkeypatch.setattr(mixing, "STREAMS", 5)
    rows = [(i, f"s{i % 40}") for i in range(400)] + [(1000 + i, "s1") for i in range(50)]
    made = mixing.schedule(spark.createDataFrame(rows, "doc_id long, source string"), block=4).collect()
    assert sorted((r.doc_id, r.source) for r in made) == sorted(rows)
    assert {r.mix_source for r in made} == {"s0", "s1", "s10", "s11", "s12", mixing.REST}


@pytest.mark.parametrize("name", ["nth", "_lane", "_r", "_s", "_k", "row", "mix_block", "mix_slot", "_id", "_all", "_share", "_own"])
def test_op4_clashing_names(spark, name):
    rows = [(i, f"s{i % 3}", 6) for i in range(60)]
    df = spark.createDataFrame(rows, f"doc_id long, source string, {name} int")
    got = mixing.mixed(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == rows
    made = mixing.schedule(df, block=5)
    assert made.where("mix_slot IS NOT NULL").count() == 60
    if not name.startswith("mix_"):
        assert {r[name] for r in made.collect()} == {6}


def test_op4_keeps_every_row(spark, frame):
    got = mixing.mixed(frame)
    assert sorted(got.columns) == sorted(frame.columns) and got.count() == frame.count()


def test_op5_base_spans_stay(spark, small):
    def base(text):
        out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            d = [int(c) for c in m[0] if c.isdigit()]
            if 12 <= len(d) <= 19 and sum(sum(divmod(x * 2, 10)) if k % 2 else x for k, x in enumerate(d[::-1])) % 10 == 0:
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
        return sorted(out)

    for _, t in [*pairs(awkward()), *small]:
        assert pii.base_spans(t or "") == base(t or "")
    rows = QUERIES["op5_pii"](spark, SF).collect()
    texts = dict(small)
    for r in rows:
        b = base(texts[r.doc_id] or "")
        assert r.base_sha256 == brute.sha(pii.shown(b))
        assert set(pii.shown(b).split(",")) - {""} <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, k, _ in b) for x in range(4)]


def test_op5_network_adds_disguised_spans(spark):
    """Recall by kind on disguised spans of texts that the fit has not seen, and few additions to clean texts."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    net = pii.train(docs)
    drawn = {r.doc_id for r in docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(pii.FIT_ROWS).collect()}
    unseen = [r.text or "" for r in docs.select("doc_id", "text").collect() if r.doc_id not in drawn and len(r.text or "") < 8000][:3000]
    rng, met, found = random.Random(9), Counter(), Counter()
    for text in unseen:
        out, marks, at, n = [], [], 0, 0
        for s, k, e in pii.labelled_spans(text):
            if s >= at:
                value = pii.disguised(k, pii.redrawn(k, text[s:e], rng), rng)
                out += [text[at:s], value]
                n += s - at + len(value)
                marks.append((n - len(value), k, n))
                at = e
        made = "".join([*out, text[at:]])
        if marks:
            base = pii.base_spans(made)
            got = base + pii.network_spans(net, [made], [base])[0]
            for s, k, e in marks:
                met[k] += 1
                found[k] += any(x == k and a < e and s < z for a, x, z in got)
    recall = {pii.KINDS[k]: round(found[k] / met[k], 2) for k in met}
    assert len(recall) == 5 and all(r >= 0.5 for r in recall.values()) and sum(recall.values()) >= 4, recall
    clean = [t for t in unseen if not pii.labelled_spans(t)][:200]
    assert sum(map(bool, pii.network_spans(net, clean, [[] for _ in clean]))) <= 4
    assert pii.network_spans(net, ["In 1998 there were 45 of them, 3.5 percent more than 12 years before, on page 7."], [[]])[0] == []


def test_op6_figures(spark, frame, small):
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = {r.doc_id: tuple(r[c] for c in cols) for r in quality.verdicts(frame).collect()}
    assert got == brute.op6(pairs(awkward()))
    got = {r.doc_id: tuple(r[c] for c in cols) for r in QUERIES["op6_quality_rules"](spark, SF).collect()}
    assert got == brute.op6(small)


def test_op6_rejects_a_bad_host(spark):
    rows = [(h, k < bad) for h, bad in [("good", 4), ("mixed", 20), ("bad", 95)] for k in range(100)] + [("lone", True)]
    rates = {r.host: r.shrunk_rate for r in quality.host_rates(spark.createDataFrame(rows, "host string, base_failed boolean")).collect()}
    assert rates["bad"] > 0.8 and rates["good"] < 0.1 and rates["lone"] < 0.95


def test_op7_places_and_labels(spark, frame, small):
    cols = ("n_words", "n_base", "first_word", "last_word", "base_labels")
    rows = licenses.scan_documents(frame).collect()
    assert {r.id: tuple(r[c] for c in cols) for r in rows} == brute.op7(pairs(awkward()))
    assert {r.doc_id: tuple(r[c] for c in cols) for r in QUERIES["op7_license_scan"](spark, SF).collect()} == brute.op7(small)
    for r in rows:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_op7_expressions_are_evaluated():
    postfix = licenses.to_postfix("(MIT OR Apache-2.0) AND GPL-2.0 WITH Classpath-exception-2.0")
    assert licenses.labels_of(postfix) == {"mit", "apache-2", "gpl-2 with classpath-exception-2.0"}
    holds = lambda *labels: licenses.satisfied(postfix, set(labels))
    assert holds("mit", "gpl-2 with classpath-exception-2.0") and holds("apache-2", "gpl-2 with classpath-exception-2.0")
    assert not holds("mit", "apache-2") and not holds("gpl-2 with classpath-exception-2.0") and not holds("mit", "gpl-2")
    assert not licenses.satisfied(licenses.to_postfix("OR"), {"or"}) and licenses.satisfied(["mit", "x", "y", "and", "or"], {"mit"})


def test_op7_long_expressions_are_whole():
    text = licenses.TAG + " " + " AND ".join(f"(A{k} OR B{k})" for k in range(20))
    found = licenses.scan(text, licenses.automaton())
    assert len(found["labels"]) == 40
    assert licenses.satisfied(found["expressions"][0].split(), {f"a{k}" for k in range(20)})
    assert not licenses.satisfied(found["expressions"][0].split(), {f"a{k}" for k in range(19)})


def test_op8_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op8_quality_classifier"](spark, sf)
    made = {r.doc_id: r for r in rows.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(made) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in made.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in made.items())
    unseen = [(made[i].score, y) for i, y in labels.items() if made[i].held_out and y is not None]
    good, bad = [s for s, y in unseen if y == 1], [s for s, y in unseen if y == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.8, auc


def test_op8_scores_awkward_texts(frame):
    net = classifier.fit([b"good text here", b"bad bad bad"] * 20, np.array([1, 0] * 20, np.float32), epochs=2)
    rows = classifier.score_documents(frame, net).collect()
    assert len(rows) == frame.count() and all(0 <= r.score <= 1 for r in rows)


def cols9(r, sha):
    return (r.n_bytes, r.n_removed, r.n_spans, sha), r.n_passage_words


@pytest.mark.parametrize("hot", [passages.HOT, 2])
def test_op9_bytes(spark, frame, small, hot):
    rng = random.Random(4)
    passage = " ".join(f"p{rng.randrange(99)}" for _ in range(60))  # over 50 words, under 400 bytes
    rows = [*pairs(awkward()), *((500 + k, f"own {k} start {passage} own {k} end") for k in range(4)), (600, f"{passage} {passage}"[:330]), (601, "x" * 3000), (602, "xy" * 900 + "x" * 500), (603, "abc" * 700), (None, "n" * 500)]
    made = passages.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()
    got = {r.id: cols9(r, brute.sha(bytes(r.kept))) for r in made}
    plain, shared = brute.op9(rows), brute.passage_words(rows)
    assert got == {i: (plain[i], shared[i]) for i in plain}
    assert all(shared[500 + k] >= 60 and plain[500 + k][1] == 0 for k in range(4))


def test_op9_query(spark, small):
    got = {r.doc_id: cols9(r, r.kept_sha256) for r in QUERIES["op9_repeated_passages"](spark, SF).collect()}
    plain, shared = brute.op9(small), brute.passage_words(small)
    assert got == {i: (plain[i], shared[i]) for i in plain}


def test_op9_bytes_decide_where_hashes_collide():
    """Windows that share a hash but not their bytes are no repeats."""
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 900).astype(np.uint8)
    data[500:900] = data[:400]
    start = np.arange(501)
    hit = passages.equal_windows(np.zeros(501, np.uint64), start, data, 400)
    strings = [data[s : s + 400].tobytes() for s in start]
    assert hit.tolist() == [strings.count(x) > 1 for x in strings] and hit.sum() == 2


def test_op9_periodic_text_has_few_spans():
    data = np.full(100_000, 120, np.uint8)
    first, last, _, tie = passages.spans_of(data, np.array([len(data)]), passages.Hasher())
    assert len(first) < 800 and tie.all() and (last - first).max() <= 336
    assert first[0] == 0 and last[-1] == len(data) - 400 and (first[1:] == last[:-1] + 1).all()


def test_op10_lines(spark, frame, small):
    maps = linededup.keep_bitmaps(frame)
    got = {r.id: (r.n_lines, r.n_dropped, brute.sha(r.kept)) for r in linededup.apply_bitmaps(frame, maps).collect()}
    assert got == brute.op10(pairs(awkward()))
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in QUERIES["op10_line_dedup"](spark, SF).collect()}
    assert got == brute.op10(small)


def test_op10_one_line_in_all_documents(spark):
    """A line that fills many partitions is settled over their borders."""
    line = "the same long line of more than forty characters in every document"
    df = spark.createDataFrame([(i, f"{line}\nown {i}\n{line}") for i in range(400)], "doc_id long, text string")
    got = {r.id: (r.n_lines, r.n_dropped, brute.sha(r.kept)) for r in linededup.apply_bitmaps(df, linededup.keep_bitmaps(df)).collect()}
    assert got == brute.op10([(i, f"{line}\nown {i}\n{line}") for i in range(400)])


#: Queries whose rows are words and vectors; test_counts_variants_codes holds their odd rows.
OTHER_ROWS = {"op12_spelling_variants": {"word": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}, "op13_vector_codes": {"vec_id": "bigint", "error": "bigint", "label_error": "bigint"}}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(OTHER_ROWS)))
def test_empty_and_repeated_rows(spark, tmp_path, name):
    """An empty table gives no rows; repeated rows, null ids and further columns don't crash, and every row has its result."""
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for case, rows in (("empty", []), ("odd", [*awkward()[:9], *awkward()[:4], (None, "text without an id", None, None, None, 1, None, None, None), (None, None, None, None, None, None, None, None, None)])):
        path = f"{tmp_path}/{case}"
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
        labels.write.parquet(f"{path}/labels.parquet")
        assert QUERIES[name](spark, path).count() == len(rows)


def test_ids_are_integers(spark):
    for name, q in QUERIES.items():
        wanted = OTHER_ROWS.get(name, {"doc_id": "bigint"})
        assert wanted.items() <= dict(q(spark, SF).dtypes).items(), name


def test_frame_with_nulls_everywhere_is_kept(frame):
    assert frame.where(F.col("text").isNull()).count() == 1


def test_places_of_very_many_phrases_are_counted_forward():
    """As many places as the words give, in a time that grows with the text."""
    import time

    from inkwell.llm.licenses import automaton, scan

    took = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        got = scan("cc by nc " * n, automaton())
        took.append(time.perf_counter() - began)
        assert got["places"] == list(range(0, 3 * n, 3)) and got["n_words"] == 3 * n
    assert took[1] < 8 * took[0] + 0.5
    mixed = scan("x under the mit license by cc by nc " * 50, automaton())
    assert sorted(mixed["places"]) == sorted(p for k in range(50) for p in (9 * k + 1, 9 * k + 6))


def test_successors_of_ids_over_all_64_bits(spark):
    from inkwell.llm.digest import successor

    ids = [-(2**63) + 5, -3, 0, 3, 2**62, 2**63 - 1]
    df = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in successor(df, "doc_id", ["text"]).collect()}
    assert got == {i: f"t{k - 1 if k else len(ids) - 1}" for k, i in enumerate(ids)}


def test_a_far_id_leaves_the_ranges_narrow(spark):
    from inkwell.llm.digest import id_range, successor

    df = spark.createDataFrame([(k, "x") for k in [*range(20_000), 2**62, -(2**61)]], "doc_id long, text string")
    dealt = df.groupBy(id_range(df, "doc_id", ["text"]).alias("r")).agg(F.count("*").alias("n"), F.min("doc_id").alias("low"))
    assert dealt.agg(F.max("n")).first()[0] <= 1000 and successor(df, "doc_id", ["text"]).count() == 20_002
    assert [r.low for r in dealt.orderBy("r").collect()] == sorted(r.low for r in dealt.collect())


def test_long_runs_are_matched_in_their_length():
    """A megabyte of digits, or of letters with an at sign elsewhere, takes seconds, and spans are those of the plain patterns."""
    import time

    from inkwell.llm.pii import _IP, addresses, base_spans

    began = time.perf_counter()
    assert base_spans("7" * 1_000_000) == [] and base_spans("a" * 1_000_000 + " @ 1") == [] and base_spans("1." * 300_000 + "@x") != []
    assert time.perf_counter() - began < 5
    r = random.Random(16)
    plain = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    dotted = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
    for alphabet in ("ab@.-_ ", "a@.", "a@._%", "1.2 a", "1."):
        for _ in range(3000):
            t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))
            assert addresses(t) == [m.span() for m in plain.finditer(t)], t
            assert [m.span() for m in _IP.finditer(t)] == [m.span() for m in dotted.finditer(t)], t
