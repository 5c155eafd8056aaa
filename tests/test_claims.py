"""Quantities and claim checks on planted texts: each check told apart from faithful retellings."""

import pytest
from pyspark.sql import functions as F

from inkwell.operators.claims import claim_failures, closest_sentence, reported_speakers, cased_words
from inkwell.operators.quantities import quantities, stated_dates, unsupported_dates, unsupported_quantities

QUANTITIES = [
    ("$14m", [("money", "USD", 14e6)]),
    ("US$1.5 billion and €3,000", [("money", "USD", 1.5e9), ("money", "EUR", 3000.0)]),
    ("USD 20 thousand, 20 dollars", [("money", "USD", 2e4), ("money", "USD", 20.0)]),
    ("12 percent of 3 km, 12% of 2 miles", [("share", "", 12.0), ("length", "", 3000.0), ("share", "", 12.0), ("length", "", 3218.688)]),
    ("60 mph or 5 m or 5m people", [("speed", "", 96.56064), ("length", "", 5.0), ("length", "", 5.0)]),
    ("2.5 kg, 10 lbs, 3 GB", [("mass", "", 2500.0), ("mass", "", 4535.9237), ("data", "", 3e9)]),
    ("3 million people on 4 May 2023 in 2024", [("number", "", 3e6)]),
    ("USD 2000 for 2000 grams in 2000", [("money", "USD", 2000.0), ("mass", "", 2000.0)]),
    ("At least 12, then 1,234,567", [("number", "", 12.0), ("number", "", 1234567.0)]),
    ("A4 and x12y v1.2.3", []),
    ("", []),
    (None, None),
]


@pytest.mark.parametrize("text,want", QUANTITIES)
def test_quantities(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(quantities(F.col("t"))).first()[0]
    assert (got if got is None else [(q.kind, q.unit, round(q.value, 6)) for q in got]) == want


def test_dates(spark):
    rows = [("On 4 May 2023, May 5, 2023 and 2024-01-02", ["2024-01-02", "2023-05-04", "2023-05-05"]), ("in 1999 for $2000 or 2020% of 12019", ["1999"]), ("none", [])]
    df = spark.createDataFrame(rows, "t string, w array<string>")
    assert all(r[0] == r[1] for r in df.select(stated_dates(F.col("t")), "w").collect())


def test_supported_within_tolerance(spark):
    rows = [
        ("about $1.2m", "USD 1,203,000 was paid", 0), ("about $1.2m", "EUR 1,203,000", 1), ("$1.3m", "$1.2m", 1), ("12 people", "12 km", 0), ("12 km", "12 people", 1), ("12 km", "12000 metres", 0),
        ("5 kg", "11 lbs", 0), ("5%", "5 percent", 0), ("14", "140 and 1.14", 1), ("", "5", 0), ("5", "", 1),
    ]
    df = spark.createDataFrame(rows, "c string, s string, n int")
    got = df.select(F.size(unsupported_quantities(quantities(F.col("c")), quantities(F.col("s")))), "n", "c", "s").collect()
    assert [tuple(r) for r in got if r[0] != r[1]] == []
    dates = spark.createDataFrame([("in 2023", "on 4 May 2023", 0), ("on 4 May 2023", "in 2023", 1), ("2023-05-04", "May 4, 2023", 0)], "c string, s string, n int")
    assert all(r[0] == r[1] for r in dates.select(F.size(unsupported_dates(stated_dates(F.col("c")), stated_dates(F.col("s")))), "n").collect())


CASES = [
    # source, claim, failures
    ("The harbour office said the pier was not damaged in the storm on Monday.", "The harbour office said the pier was not damaged in Monday's storm.", []),
    ("The harbour office said the pier was not damaged in the storm on Monday.", "The harbour office said the pier was damaged in the storm on Monday.", ["negation"]),
    ("It didn't close.", "It did not close.", []),
    ("Police said the man allegedly robbed the bank.", "Police said the man robbed the bank.", ["hedge"]),
    ("At least 15 were hurt, the mayor said.", "The mayor said at least 51 were hurt.", ["quantity"]),
    ("It opened on 3 June 2021.", "It opened on 4 June 2021.", ["date"]),
    ("It opened on 3 June 2021.", "It opened in 2021.", []),
    ("Minister Ada Lund said the school would close. The union said that was wrong.", "The union said the school would close.", ["speaker"]),
    ("Minister Ada Lund said the school would close. The union said that was wrong.", "Ada Lund said the school would close.", []),
    ("Lund said it would close.", "Berg said it would close.", ["speaker", "attribution"]),
    ("General Cole said 40 targets were destroyed.", "The 40 targets were destroyed.", ["dropped_attribution"]),
    ("General Cole said 40 targets were destroyed.", "Cole said 40 targets were destroyed.", []),
    ("General Cole said 40 targets were destroyed.", "40 targets were destroyed, officials said.", ["speaker", "attribution", "dropped_attribution"]),
    ("Ford said \"we will appeal the ruling\".", "\"We will appeal the ruling\"", ["detached_quotation"]),
    ("Ford said \"we will appeal the ruling\".", "Ford said \"we will appeal the ruling\".", []),
    ("Ford said we will appeal.", "We will appeal.", ["detached_quotation"]),
    ("An analyst said \"the first vote in many years whose result nobody can foretell\".", "It is the first vote in many years whose result nobody can foretell.", ["quotation_as_fact"]),
    ("An analyst said \"the first vote in many years whose result nobody can foretell\".", "An official said it is the first vote in many years whose result nobody can foretell.", ["speaker", "attribution"]),
    ("The commander said \"we hold the town\".", "The mayor heard \"we hold the town, the commander said\".", ["attribution", "detached_quotation", "misquoted"]),
    ("Berg was summoned by the court.", "Berg was arrested by the court.", ["action"]),
    ("Berg was summoned by the court.", "The court summoned Berg.", []),
    (None, "", []),
    ("", "Anything here.", []),
]


def test_each_check_on_planted_claims(spark):
    df = spark.createDataFrame([(k, s, c, "x", 1) for k, (s, c, _) in enumerate(CASES)], "id long, source string, claim string, closest string, failures int")
    got = {r.id: r.failures for r in claim_failures(df, ["id"], "claim", "source").collect()}
    assert [(CASES[k][:2], got[k]) for k in sorted(got) if got[k] != CASES[k][2]] == [] and len(got) == len(CASES)


def test_closest_sentence_and_speakers(spark):
    df = spark.createDataFrame([("the red house burned", "A cat sat. The house burned. The red house burned down!", "x"), ("zzz", "", "y"), ("zzz", "one. two.", "z")], "c string, s string, k string")
    assert [r[0] for r in df.select(closest_sentence(F.col("c"), F.col("s"))).collect()] == ["The red house burned down!", "", "one."]
    said = spark.createDataFrame([("Today the Foreign Ministry said that Ann Lee agreed",), ("It was over, said Ford",), ("He said so",), ("according to the police, Ann said",)], "t string")
    assert [r[0] for r in said.select(reported_speakers(cased_words(F.col("t")))).collect()] == [["today", "foreign", "ministry"], ["ford"], [], ["police", "ann"]]
