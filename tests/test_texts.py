"""Search, passages, quotes, timelines, vectors, fits and selections against plain versions and planted cases."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.functions.embedding import BUCKETS, hashed, pieces_of, pooled, word_pieces
from inkwell.functions.sql import register
from inkwell.operators import calibration
from inkwell.operators.evaluation import shared_run, top_overlap
from inkwell.operators.index import Term, build, ranked_matches
from inkwell.operators.quotes import timeline, voices
from inkwell.operators.selection import accounts, highlights, novel_sentence, updated, within_budget
from inkwell.queries import QUERIES

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_index_terms_prefixes_phrases_fields(spark, tmp_path):
    docs = [(1, "red fox", "the quick red fox runs"), (2, "blue", "fox the red"), (3, "red", None), (4, None, "foxes and redder things"), (5, "the red", "fox")]
    i = build(spark.createDataFrame(docs, "id long, title string, body string"), "id", ["title", "body"], f"{tmp_path}/i")
    met = lambda *terms, **o: {r.id for r in ranked_matches(i, list(terms), **o).collect()}
    assert met(Term("red")) == {1, 2, 3, 5} and met(Term("Red"), Term("fox")) == {1, 2, 5}
    assert met(Term("red"), Term("fox"), match_all=False) == {1, 2, 3, 5}
    assert met(Term("fox", prefix=True)) == {1, 2, 4, 5} and met(Term("red fox")) == {1}  # a phrase does not run from title to body
    assert met(Term("the red")) == {2, 5} and met(Term("red fo", prefix=True)) == {1}
    assert met(Term("red", field="title")) == {1, 3, 5} and met(Term("fox", field="body")) == {1, 2, 5} and met(Term("...")) == set()
    n, mean = 5, sum(len((t or "").split()) + len((b or "").split()) for _, t, b in docs) / 5
    idf = math.log(1 + (n - 4 + 0.5) / 4.5)
    got = {r.id: r.score for r in ranked_matches(i, [Term("red")]).collect()}
    assert got[1] == pytest.approx(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 7 / mean)))


def test_highlights_take_each_source_first(spark):
    h = "storm floods coastal towns"
    facts = [
        (1, 1, "a", "The storm floods three coastal towns overnight", h), (1, 2, "a", "Coastal towns lose power after storm damage", h), (1, 3, "b", "The storm floods three coastal towns overnight again", h),
        (1, 4, "b", "Rescue crews search for missing fishermen", h), (1, 5, "c", "too short", h), (1, 6, "c", "Officials open shelters across the region tonight", h),
    ]
    df = spark.createDataFrame(facts, "event long, id long, source string, statement string, headline string")
    assert rows(highlights(df, "event")) == [(1, 1), (1, 2), (1, 4), (1, 6)] and rows(highlights(df, "event", keep=3)) == [(1, 1), (1, 4), (1, 6)]


def test_budget_cuts_to_first_sentences(spark):
    long = "First sentence stands here. " + "word " * 60
    df = spark.createDataFrame([(1, 1, 9, "one two three four"), (1, 2, 8, long), (1, 3, 7, "five six seven eight"), (1, 4, 6, long)], "event long, id long, score int, text string")
    got = {r.id: r.form for r in within_budget(df, "event", 25).collect()}
    assert got == {1: "whole", 2: "lead", 3: "lead", 4: "lead"}
    assert {r.id for r in within_budget(df, "event", 12).collect()} == {1, 2}


def test_novel_sentences_skip_repeats(spark):
    df = spark.createDataFrame([(1, 1, "The bridge fell on Monday morning."), (1, 2, "The bridge fell on Monday morning. Divers found a second car."), (1, 3, "The bridge fell on Monday morning.")], "event long, at long, text string")
    got = {r.at: (r.sentence, r.distance) for r in novel_sentence(df, "event").collect()}
    assert got == {2: ("Divers found a second car.", 1.0)}


def test_accounts_and_updates(spark):
    text = lambda n: "w " * n
    df = spark.createDataFrame([(1, "a", 1, text(60)), (1, "a", 2, text(80)), (1, "b", 3, text(80)), (1, "c", 4, text(59)), (2, "a", 5, text(90)), (3, "a", 6, None)], "event long, publisher string, id long, text string")
    assert rows(accounts(df, "event")) == [(1, "a", 2, 80), (1, "b", 3, 80)]
    now = 10 * 86_400
    t = [(1, 0, "Storm hits the northern coast"), (1, now, "Storm hits northern coast hard"), (2, 0, "Storm hits coast"), (2, now, "Mayor resigns over flood money"), (3, now, "New event alone"), (4, 0, "Old event alone")]
    assert rows(updated(spark.createDataFrame(t, "event long, at long, title string"), "event", now)) == [(1, False), (2, True), (3, False), (4, False)]


def test_voices_of_quotes(spark):
    texts = [
        (1, 1, "“We will rebuild the whole bridge,” said Maria Alvarez on Monday. Alvarez added: “Nobody should have to wait for this.”"),
        (1, 2, '"We will rebuild the whole bridge", Maria Alvarez said. Juan Castro said “The money has not been found.”'),
        (1, 3, "“The money has not been found at all,” said Castro. “Short,” said Bo."), (2, 4, None),
    ]
    got = rows(voices(spark.createDataFrame(texts, "event long, id long, text string"), "event"))
    assert got == [(1, "Juan Castro", "The money has not been found at all", 1), (1, "Juan Castro", "The money has not been found.", 1), (1, "Maria Alvarez", "Nobody should have to wait for this.", 1), (1, "Maria Alvarez", "We will rebuild the whole bridge", 2)]


def test_timelines(spark):
    at = "2024-05-15 12:00:00"  # a Wednesday
    texts = [
        (1, 1, "a", at, "The dam broke on 3 May 2024. Repairs began yesterday."), (1, 2, "b", at, "The dam broke on 3 May 2024. On Monday, ministers met, and on Monday they left."), (1, 3, "b", at, "A vote is set for June 2, 2024. Talks ran 5 to 7 May 2024. Nothing else."),
        (2, 4, "a", at, "It happened on 2024-01-01."), (3, 5, "a", at, None),
    ]
    df = spark.createDataFrame(texts, "event long, id long, publisher string, published string, text string").withColumn("published", F.col("published").cast("timestamp"))
    got = {str(r.day): (r.sentence, r.publishers) for r in timeline(df, "event").collect()}
    assert got == {
        "2024-05-03": ("The dam broke on 3 May 2024.", 2), "2024-05-14": ("Repairs began yesterday.", 1), "2024-05-13": ("On Monday, ministers met, and on Monday they left.", 1),
        "2024-06-02": ("A vote is set for June 2, 2024.", 1), "2024-05-05": ("Talks ran 5 to 7 May 2024.", 1),
    }


def test_vectors_of_texts(spark):
    def plain(text):
        v = np.zeros(BUCKETS)
        for w in [x for x in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split() if len(x) >= 2]:
            h = 5381
            for byte in w.encode():
                h = (h * 33 + byte) % 2**64
            v[h % BUCKETS] += 1
        v[0] += not v.any()
        return v / np.linalg.norm(v)

    texts = [(1, "The quick brown fox, the fox"), (2, "naïve Straße extraordinarily-incomprehensibilities"), (3, "a b"), (4, None), (5, "")]
    got = {i: np.zeros(BUCKETS) for i, _ in texts}
    for r in hashed(spark.createDataFrame(texts, "id long, t string"), "id", "t").collect():
        got[r.id][r.bucket] = r.weight
    assert all(np.allclose(got[i], plain(t)) for i, t in texts)
    v = pooled(spark.createDataFrame([(1, [3.0, 0.0]), (1, [0.0, 8.0]), (2, [0.0, 0.0])], "k long, v array<double>"), "k", "v")
    assert {r.k: [round(x, 6) for x in r.vector] for r in v.collect()} == {1: [0.351123, 0.936329], 2: [0.0, 0.0]}


def test_word_pieces(spark):
    vocab = {t: i for i, t in enumerate(["[UNK]", "[CLS]", "[SEP]", "un", "##aff", "##able", "run", "##s", "a"])}
    assert pieces_of("unaffable", vocab, 0) == [3, 4, 5] and pieces_of("runs", vocab, 0) == [6, 7] and pieces_of("runx", vocab, 0) == [0] and pieces_of("a" * 101, vocab, 0) == [0]
    df = spark.createDataFrame([(1, "Unaffable runs!", "a"), (2, None, None), (3, "a " * 300, "run " * 300), (4, "a " * 10, "run " * 300)], "id long, x string, y string")
    got = {r.id: r.ids for r in word_pieces(df, "id", "x", None, vocab).collect()}
    assert got[1] == [1, 3, 4, 5, 6, 7, 2] and got[2] == [1, 2] and len(got[3]) == 128
    pair = {r.id: r.ids for r in word_pieces(df, "id", "x", "y", vocab).collect()}
    assert pair[1] == [1, 3, 4, 5, 6, 7, 2, 8, 2] and len(pair[3]) == 256 and abs(pair[3].count(8) - pair[3].count(6)) <= 1 and pair[4].count(8) == 10 and len(pair[4]) == 256


def test_fits(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2))
    y = (rng.random(300) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 0] - x[:, 1])))).astype(float)
    w = np.zeros(3)
    full = np.c_[np.ones(300), x]
    for _ in range(400):
        p = 1 / (1 + np.exp(-full @ w))
        w = w - 0.5 * (full.T @ (p - y) / 300 + np.r_[0, 0.001, 0.001] * w)
    assert np.allclose(calibration.descent(x, y), w)
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "at long, a double, b double, y double")
    assert np.allclose(calibration.calibrated(df, ["a", "b"], "y", "at"), w) and calibration.calibrated(df.limit(40), ["a", "b"], "y", "at") is None
    assert calibration.calibrated(df.where("y = 1"), ["a", "b"], "y", "at") is None
    n = calibration.newton(df, ["a", "b"], "y")
    gradient = full.T @ (1 / (1 + np.exp(-full @ n)) - y) + np.r_[0, 1, 1] * n
    assert np.abs(gradient).max() < 1e-6 and n[1] > 1 and n[2] < -0.4
    cut = df.select(calibration.shifted(0.9, np.array([0.0, 5.0, 0.0]), ["a", "b"]).alias("c")).collect()
    assert all(0.85 <= r.c <= 0.95 for r in cut)


def test_shared_runs_and_overlap(spark):
    rng = random.Random(2)
    for _ in range(60):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(14))] for _ in range(2))
        plain = max((k for k in range(len(a) + 1) for i in range(len(a) - k + 1) for j in range(len(b) - k + 1) if a[i : i + k] == b[j : j + k]), default=0)
        assert shared_run(a, b) == plain
    a, b = (spark.createDataFrame([(i, s(i)) for i in range(20)], "id long, score double") for s in (float, lambda i: float(-i if i < 15 else i)))
    assert top_overlap(a, b, 10).first().shared == 0.5


def test_functions_in_sql(spark):
    assert len(register(spark)) == 13
    known = "array(named_struct('label', 'a', 'phrase', 'red fox', 'factor', 1D), named_struct('label', 'b', 'phrase', 'owl', 'factor', 1D))"
    topics = [spark.sql(f"SELECT ink_topic({args}, {known})").first()[0] for args in ("'The Red-Fox', NULL, 'owl'", "'', 'an owl', 'owl'", "'', 'an owl', ''", "'owl red fox', '', ''", "NULL, NULL, NULL")]
    assert topics == ["a", "b", None, "a", None]
    one = spark.sql("""SELECT ink_category('Medical') AS a, ink_publisher('https://www.A.org/x', 'feed') AS b, ink_publisher('none', 'feed') AS c, ink_tracking('UTM_source') AS d, ink_tracking('id') AS e,
        ink_section('Rates rise', 'Central bank', 'Business', 'business', array()) AS f, ink_section('Rates rise', 'The central bank', 'x', 'business', array('central bank')) AS g, ink_muted_source('https://news.b.org/', array('b.org')) AS h,
        ink_input_hash('a', NULL, 'b') <> ink_input_hash('', 'a', 'b') AS i, ink_cosine(array(1D), array(1D, 2D)) AS j""").first()
    assert tuple(one) == ("health", "a.org", "feed", True, False, True, True, True, True, None)


# --- registered queries without SQL, over the smallest tables ------------------------------------

def plain_words(text):
    return [w for w in "".join(c if c.isalnum() else " " for c in text.lower()).split() if w]


def test_mmr_query(spark):
    made = defaultdict(list)
    for r in QUERIES["mmr_rerank"](spark, SF).orderBy("key", "place").collect():
        made[r.key].append((r.id, r.score))
    rel = {r.id: r.r for r in spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.round(F.pmod(F.xxhash64("vec_id"), F.lit(1000)) / 1000.0, 6).alias("r")).collect()}
    groups = defaultdict(dict)
    for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect():
        groups[r.label][r.vec_id] = np.array(r.embedding, float)
    for label, vectors in groups.items():
        left, picked = sorted(vectors), []
        while left and len(picked) < 10:
            def score(i):
                near = max((max(0.0, float(vectors[i] @ vectors[j])) * math.exp(-abs(i - j) * 60 / 86_400) for j, _ in picked), default=0.0)
                return 0.7 * min(1, max(0, rel[i])) - 0.3 * near
            best = max(left, key=lambda i: (round(score(i), 9), -i))
            picked.append((best, score(best)))
            left.remove(best)
        assert [i for i, _ in made[label]] == [i for i, _ in picked] and [s for _, s in made[label]] == pytest.approx([s for _, s in picked])


def test_lane_query(spark):
    from inkwell.operators.ranking import LANES
    from inkwell.plans.scoring import _scored

    stories = [(r.edition, r.id, r.score) for r in _scored(spark, SF).collect()]
    want = {}
    for edition in {e for e, _, _ in stories}:
        left = {i: s for e, i, s in stories if e == edition}
        ok = {"lead": lambda i, s: s >= 0.6, "in_motion": lambda i, s: i % 3 == 0, "deep_read": lambda i, s: i % 5 == 0, "your_beat": lambda i, s: i % 2 == 0, "outside": lambda i, s: i % 7 == 0}
        rank = {"in_motion": lambda s: s * 0.9, "outside": lambda s: 1 - s}
        for name, _, _, least, most in LANES:
            fits = sorted((i for i, s in left.items() if ok[name](i, s)), key=lambda i: (-rank.get(name, lambda s: s)(left[i]), i))
            if len(fits) >= least:
                for i in fits[:most]:
                    want[edition, i] = name
                    del left[i]
        want |= {(edition, i): "latest" for i in left}
    assert {(r.edition, r.id): r.lane for r in QUERIES["lane_assignment"](spark, SF).collect()} == want


def test_identity_queries(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in QUERIES["feed_keys"](spark, SF).collect():
        scheme, _, rest = pages[r.page_id].strip().partition("://")
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        tail = rest[cut:]
        assert r.key == f"{scheme}://{rest[:cut]}".lower() + (tail[:-1] if tail.endswith("/") else tail)
    for r in QUERIES["article_identity"](spark, SF).collect():
        if r.page_id % 3 == 0:
            host = pages[r.page_id].split("://")[1].split("/")[0].split("?")[0].split("#")[0].split(":")[0].lower().removeprefix("www.")
            feed = f"https://{host}/feed"
            assert r.identity == "feed-guid:" + hashlib.sha256(f"{len(feed)}:{feed}guid-{r.page_id}".encode()).hexdigest()
        else:
            assert r.identity.startswith("https://") and "utm_" not in r.identity


def test_text_queries(spark):
    turns = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    for r in QUERIES["token_estimates"](spark, SF).collect():
        t = turns[r.conv_id, r.turn]
        import unicodedata
        marks = sum(unicodedata.category(c).startswith("P") for c in t)
        foreign = sum(ord(c) > 127 for c in t)
        assert r.tokens == (math.ceil(len(t) / 2) if foreign > 0.3 * len(t) else math.ceil(round(1.3 * len(t.split()) + 0.5 * marks, 9)))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.id: r.snippet for r in QUERIES["snippets"](spark, SF).collect()}
    for i, t in docs.items():
        ws = (t or "").split()
        clean = ["".join(c for c in w.lower() if c.isalnum()) for w in ws]
        if "license" not in clean:
            assert i not in got
            continue
        at = clean.index("license")
        start = max(0, at - 7)
        assert got[i] == " ".join(f"[{w}]" if start + k == at else w for k, w in enumerate(ws[start : start + 15]))


def test_selection_queries(spark):
    clicks = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/events.parquet").where("event_type = 'click'").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at")).collect():
        clicks[r.user_id % 10].append((r.at, r.event_id))
    want = set()
    for reader, all_ in clicks.items():
        passed = []
        for at, i in sorted(all_):
            if sum(t > at - 3600 for t in passed) < 5 and sum(t > at - 1800 for t in passed) < 3:
                passed.append(at)
                want.add((reader, i))
    assert {(r.reader, r.id) for r in QUERIES["priority_overflow"](spark, SF).collect()} == want
    made = QUERIES["briefing_greedy"](spark, SF).collect()
    orders = {r.o_orderkey: r for r in spark.read.parquet(f"{SF}/orders.parquet").collect()}
    for key in range(8):
        ids = [r.id for r in sorted(made, key=lambda r: r.place) if r.key == key]
        sources, events = Counter(orders[i].o_custkey % 20 for i in ids), Counter(i % 400 for i in ids)
        assert max(sources.values()) <= 2 and max(events.values()) == 1 and len(ids) <= 10
        mine = [o for o in orders.values() if o.o_custkey % 8 == key]
        first = max(mine, key=lambda o: (o.o_orderkey % 9, o.o_custkey % 5, o.o_orderdate, -o.o_orderkey))
        assert ids[0] == first.o_orderkey


def test_profile_query(spark):
    e = spark.read.parquet(f"{SF}/events.parquet").where("event_type IN ('click', 'purchase', 'error')").select("user_id", "event_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at")).collect()
    vec = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    n, once = max(vec) + 1, {}
    for r in e:
        key = (r.user_id, r.event_id % n, {"click": "click", "purchase": "save", "error": "skip"}[r.event_type])
        once[key] = min(once.get(key, 1 << 60), r.at)
    good = {(u, i) for u, i, a in once if a != "skip"}
    by = defaultdict(list)
    for (u, i, a), at in once.items():
        if i in vec and (a != "skip" or (u, i) not in good):
            by[u].append((at, i, a))
    for r in QUERIES["embedding_profile_decay"](spark, SF).collect():
        v, last = None, None
        for at, i, a in sorted(by[r.user_id]):
            x = vec[i] / np.linalg.norm(vec[i]) * {"click": 1.0, "save": 2.0, "skip": -0.5}[a]
            v = x if v is None else v * 2 ** (-(at - last) / (7 * 86_400)) + x
            v, last = v / np.linalg.norm(v), at
        assert np.allclose(r.profile, v) and r.n == len(by[r.user_id])


def test_synthetic_reports_are_reproducible(spark):
    a, b = (rows(QUERIES["synthetic_reports"](spark, SF)) for _ in range(2))
    keys = [r.c_custkey for r in spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey").collect()]
    assert a == b and Counter(r[4] for r in a) == Counter({k: 12 * n for k, n in Counter("breaking" if c % 50 < 20 else "weekend" if c % 50 < 35 else "syndication" for c in keys).items()})
    raw = int(hashlib.sha256(b"fixture|7|3").hexdigest()[:13], 16) / 16**13
    assert {r[2] for r in a if r[0] == 7 and r[1] == 3} == {int(raw * 20)}


def test_passage_alignment_query(spark):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").where("turn < 40").collect():
        turns[r.conv_id].append((r.turn, r.role, set(plain_words(r.text))))
    want = {}
    for c, ts in turns.items():
        for turn, role, w in ts:
            others = [(round(len(w & x) / math.sqrt(len(w) * len(x)) if w and x else 0.0, 6), -t) for t, r2, x in ts if r2 != role]
            if others:
                s, t = max(others)
                want[c, turn] = (-t, s, "consensus" if s >= 0.82 else "divergence" if s < 0.4 else "partial")
    assert {(r.conv_id, r.turn): (r.other, r.similarity, r.kind) for r in QUERIES["passage_alignment"](spark, SF).collect()} == want
