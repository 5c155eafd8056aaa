"""Stems, the stored index over them, phrases, taxonomies and places against published values and plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from inkwell.functions.stemming import porter, stem_of, stems
from inkwell.operators.index import Term, index_of, matches, ranked_matches
from inkwell.operators.phrases import dictionary, leftmost_longest, phrase_hits
from inkwell.operators.places import equirectangular, first_places, mercator, named_places, nearest_regions
from inkwell.operators.taxonomy import classified, sector_impacts
from inkwell.plans.terms import gazetteer
from inkwell.queries import QUERIES
from inkwell.sources.tables import table

SF = "/root/testdata/sf0.001"

#: The examples of the published algorithm.
EXAMPLES = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan
falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic
differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit
sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop
adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog
effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll""".split()


def test_porter_examples():
    pairs = list(zip(EXAMPLES[::2], EXAMPLES[1::2]))
    assert [(w, porter(w)) for w, _ in pairs] == pairs


def test_stems_of_any_word(spark):
    assert [stem_of(w) for w in ("licensed", "license", "naïves", "日本", "is", "b2b", "a" * 70)] == ["licens", "licens", "naiv", "日本", "is", "b2b", "a" * 70]
    assert [r[0] for r in spark.createDataFrame([("licensing",), (None,)], "w string").select(stems("w")).collect()] == ["licens", None]


def indexed(spark, tmp_path, rows, name="d"):
    path = str(tmp_path / name)
    spark.createDataFrame(rows, "id long, text string, lang string").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_stemmed_terms_phrases_and_prefixes(spark, tmp_path):
    df = indexed(spark, tmp_path, [(1, "All rights reserved", "en"), (2, "the licensed right to reserve", "en"), (3, "licensing rights, reserving nothing", "fr"), (4, "reservation right", "fr"), (5, None, "fr"), (6, "Réservé: right reserve", "fr")])
    i = index_of(df, "id", ["text"])
    held = lambda *terms: ids(matches(i, list(terms)).where("_kept"))
    assert held(Term("license", stemmed=True)) == [2, 3] and held(Term("license")) == []
    assert held(Term("reserves", stemmed=True)) == [1, 2, 3, 4, 6] and held(Term("reserve")) == [2, 6]
    assert held(Term("right reserve", stemmed=True)) == [1, 3, 6] and held(Term("right reserve")) == [6]
    assert held(Term("licenses righ", stemmed=True, prefix=True)) == [2, 3]
    assert held(Term("reserv", prefix=True)) == [1, 2, 3, 4, 6]
    assert ids(ranked_matches(i, [Term("licensed", stemmed=True), Term("nothing", stemmed=True)])) == [3]
    forms = {(r.term, r.stem, r.df, r.cf) for r in i.vocabulary.where("stem = 'reserv'").collect()}
    assert forms == {("reserved", "reserv", 1, 1), ("reserve", "reserv", 2, 2), ("reserving", "reserv", 1, 1), ("reservation", "reserv", 1, 1), ("réservé", "reserv", 1, 1)}


def test_an_index_is_that_of_its_frame_and_files(spark, tmp_path):
    """A filter, a derived id and files rewritten in place have an index of their own; the same frame opens the same one."""
    df = indexed(spark, tmp_path, [(1, "alpha", "en"), (2, "alpha", "fr"), (3, "beta", "fr")], "own")
    hit = lambda frame, word="alpha", col="id": ids(matches(index_of(frame, col, ["text"]), [Term(word)]).where("_kept"))
    assert hit(df) == [1, 2] and hit(df.where("lang = 'fr'")) == [2] and hit(df.where("lang = 'de'")) == []
    assert hit(df.select((F.col("id") * 10).alias("id"), "text")) == [10, 20]
    assert index_of(df, "id", ["text"]).postings.inputFiles() == index_of(spark.read.parquet(str(tmp_path / "own")), "id", ["text"]).postings.inputFiles()
    again = indexed(spark, tmp_path, [(7, "alpha", "en")], "own")
    assert hit(again) == [7]
    assert index_of(again, "id", ["text"], version=1).postings.inputFiles() != index_of(again, "id", ["text"], version=2).postings.inputFiles()


def test_postings_are_pruned_by_stem(spark):
    """A word's postings are read by tests on the columns they are sorted by."""
    i = index_of(table(spark, SF, "documents"), "doc_id", ["text"])
    plan = matches(i, [Term("license")])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(stem,licens)" in plan and "EqualTo(term,license)" in plan


def plain_hits(texts, phrases):
    out = set()
    for i, t in texts:
        w = plain_words(t)
        for k, p in phrases:
            q = plain_words(p)
            out |= {(i, k, at, len(q)) for at in range(len(w) - len(q) + 1) if q and w[at : at + len(q)] == q}
    return out


def plain_words(t):
    return "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()


def plain_longest(hits):
    out, by = set(), {}
    for i, k, at, size in hits:
        by.setdefault(i, []).append((at, -size, k))
    for i, found in by.items():
        free = 0
        for at, size, k in sorted(found):
            if at >= free:
                out.add((i, k, at, -size))
                free = at - size
    return out


@pytest.mark.parametrize("chars", [10_000, 0])
def test_phrase_hits_equal_a_plain_search(spark, chars):
    r = random.Random(11)
    texts = [(k, "".join(r.choice(["a", "b", "ab", "ba", "ä", "1"]) + r.choice([" ", ", ", "-"]) for _ in range(r.randint(0, 40)))) for k in range(60)] + [(61, None), (62, ""), (61, "a b a b a")]
    phrases = [(k, " ".join(r.choice(["a", "b", "ab", "Ä"]) for _ in range(r.randint(1, 4)))) for k in range(25)] + [(90, "--"), (91, "A-B"), (92, None)]
    known = dictionary(spark.createDataFrame(phrases, "k long, p string"), "k", "p")
    hits = phrase_hits(spark.createDataFrame(texts, "id long, t string"), "id", ["t"], known, automaton_chars=chars)
    got = {(x.id, x.phrase_id, x["at"], x["size"]) for x in hits.collect()}
    assert got == plain_hits(texts, [(k, p or "") for k, p in phrases])
    unique = [t for t in texts if t[0] != 61]
    longest = leftmost_longest(hits.where("id <> 61"))
    assert {(x.id, x.phrase_id, x["at"], x["size"]) for x in longest.collect()} == plain_longest(plain_hits(unique, [(k, p or "") for k, p in phrases]))


def test_phrases_are_not_met_over_removed_ones(spark):
    df = spark.createDataFrame([(1, "food aid and food", "x"), (2, "food food aid", "x"), (3, None, None)], "id long, t string, field string")
    known = dictionary(spark.createDataFrame([(5, "food"), (6, "aid and"), (7, "food aid")], "k long, p string"), "k", "p")
    assert {(r.id, r.phrase_id, r["at"]) for r in phrase_hits(df, "id", ["t"], known, ["Food aid"]).collect()} == {(1, 5, 1), (2, 5, 0)}
    assert phrase_hits(df, "id", ["t"], known.limit(0)).collect() == []


TOPICS = [(0, "World", "kenya"), (0, "World", "talks"), (1, "Politics", "senate"), (1, "Politics", "election"), (2, "Health", "ebola"), (2, "Health", "new vaccine"), (3, "Food", "food")]


def test_classes_of_planted_texts(spark):
    phrases = spark.createDataFrame([(n, c, p, 0.5 if p == "kenya" else 1.0) for n, c, p in TOPICS], "class_no int, label string, phrase string, factor double")
    rows = [
        (1, "Ebola cases in Kenya", "", "", None),  # 3 against 1.5
        (2, "Talks on ebola", None, None, None),  # a tie: not the catch-all
        (3, "Election in Kenya", "", "", None),  # politics abroad
        (4, "Senate on Kenya election", "", "", None),  # a cue keeps it at home
        (5, "Food aid arrives", "food aid", "food aid", None),  # a compound only
        (6, "nothing", "", "food " * 50, None),  # half a point
        (7, "nothing", "New-Vaccine", "new vaccine", None),  # 1.5 + 0.5
        (8, "Ebola", "", "", " politics "),  # a hint decides
        (9, None, None, None, "unknown"),
    ]
    df = spark.createDataFrame(rows, "id long, a string, b string, c string, hint string")
    got = {r.id: (r.label, round(r.confidence, 6), r.score, r.evidence) for r in classified(df, "id", {"title": "a", "description": "b", "body": "c"}, phrases, ["food aid"], "World", ("Politics", "World", ["senate"]), "hint").collect()}
    assert got == {
        1: ("Health", 0.74, 3.0, ["ebola"]), 2: ("Health", 0.74, 3.0, ["ebola"]), 3: ("World", 0.74, 3.0, ["election"]), 4: ("Politics", 0.95, 6.0, ["election", "senate"]),
        7: ("Health", 0.66, 2.0, ["new vaccine"]), 8: ("Politics", 0.95, 3.0, ["politics"]),
    }


def test_sectors_of_planted_texts(spark):
    sectors = spark.createDataFrame([(0, "Energy", "oil"), (0, "Energy", "gas prices"), (1, "Banks", "bank"), (2, "Transport", "flight"), (2, "Transport", "oil")], "class_no int, label string, phrase string")
    implied = spark.createDataFrame([("costs",), ("layoffs",), ("prices",)], "phrase string")
    rows = [
        (1, "Oil costs rise. The bank plans layoffs! The bank cut costs again. Oil fell."),
        (2, "West Bank costs grow. Flight costs will rise, oil too."),  # a homonym; two cues beat one
        (3, "Gas prices and oil and a flight. We expect bank costs."),  # Energy by more cues; a forecast goes
        (4, None), (5, ""), (6, "Costs."),
    ]
    made = sector_impacts(spark.createDataFrame(rows, "id long, t string"), "id", "t", sectors, implied, ["west bank"], F.lower("sentence").contains("expect"))
    assert sorted((r.id, r.pos, r.label, r.cues) for r in made.collect()) == [(1, 0, "Energy", 1), (1, 1, "Banks", 1), (2, 1, "Transport", 2), (3, 0, "Energy", 2)]
    assert len(sector_impacts(spark.createDataFrame(rows, "id long, t string"), "id", "t", sectors, implied, most=1).where("id = 1").collect()) == 1


def test_places_longest_name_first(spark):
    gaz = spark.createDataFrame([(1, "Korea"), (2, "North Korea"), (3, "New York"), (4, "York"), (4, "Old York")], "place_id long, name string")
    rows = [(1, "From north korea to New-York, York"), (2, "york korea"), (3, "nowhere"), (4, None)]
    named = named_places(spark.createDataFrame(rows, "id long, t string"), "id", "t", gaz)
    assert sorted((r.id, r["at"], r.place_id) for r in named.collect()) == [(1, 1, 2), (1, 4, 3), (1, 6, 4), (2, 0, 4), (2, 1, 1)]
    assert sorted(map(tuple, first_places(named).collect())) == [(1, 2), (2, 4)]


def test_place_mentions_equal_a_plain_reading(spark):
    names = sorted({(r.place_id, r.name) for r in gazetteer(spark, SF).collect()})
    texts = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    held = plain_longest(plain_hits(texts, names))
    got = {r.place_id: (r.mentions, r.documents) for r in QUERIES["place_mentions"](spark, SF).collect()}
    assert got == {k: (sum(h[1] == k for h in held), len({h[0] for h in held if h[1] == k})) for k in {h[1] for h in held}}


@pytest.mark.parametrize("most", [25.0, 7.0, 100.0])
def test_nearest_regions_equal_all_pairs(spark, most):
    r = random.Random(12)
    at = lambda: (r.choice([r.uniform(-90, 90), 90.0, -90.0, 0.0]), r.choice([r.uniform(-180, 180), 180.0, -180.0, 179.5, -179.5, 170.1]))
    points, regions = [(k, *at()) for k in range(150)], [(k, *at()) for k in range(60)] + [(60, 0.0, 0.0), (61, 0.0, 0.0)]
    want = {}
    for k, lat, lon in points:
        best = None
        for i, rlat, rlon in regions:
            away = abs(rlon - lon)
            square = (rlat - lat) ** 2 + min(away, 360 - away) ** 2
            if square <= most**2 and (best is None or (square, -i) < best):
                best = (square, -i)
        if best:
            want[k] = (-best[1], round(math.sqrt(best[0]), 6))
    made = nearest_regions(spark.createDataFrame(points, "point_id long, lat double, lon double"), spark.createDataFrame(regions, "region_id long, lat double, lon double"), most)
    assert {x.point_id: (x.region_id, round(x.degrees, 6)) for x in made.collect()} == want


def test_projections(spark):
    df = spark.createDataFrame([(0.0, 0.0), (90.0, 180.0), (-120.0, -200.0)], "lat double, lon double")
    (x, y), (_, up) = equirectangular(F.col("lat"), F.col("lon"), 360.0, 180.0), mercator(F.col("lat"), F.col("lon"), 360.0, 180.0)
    got = [tuple(round(v, 3) for v in r) for r in df.select(x, y, up).collect()]
    assert got == [(180.0, 90.0, 90.0), (360.0, 0.0, 0.295), (0.0, 180.0, 179.705)]
