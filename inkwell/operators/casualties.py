"""Classification of passages by cues, and the figures they report."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import words

# Cues of the counted event types, in the order that breaks ties.
CUES = {
    "armedConflict": "airstrike|airstrikes|air strike|air strikes|missile strike|missile strikes|drone strike|drone strikes|drone attack|drone attacks|shelling|shelled|artillery|bombardment|offensive|invasion|invaded|troops|front line|frontline|fighting|military operation|ceasefire|cease fire|insurgents",
    "terrorism": "terrorist|terrorists|terrorism|terror attack|suicide bomber|suicide bombing|car bomb|gunman|gunmen|mass shooting|hostage|hostages|kidnapped|abducted|explosive device",
    "civilUnrest": "protest|protests|protesters|protestors|demonstrators|riot|riots|rioting|unrest|curfew|tear gas|crackdown|coup|uprising|martial law",
    "coercion": "sanctions|embargo|blockade|ultimatum|mobilization|mobilisation|military drills|nuclear test|missile test|ballistic missile|expelled diplomats|troop buildup",
    "disaster": "earthquake|tsunami|hurricane|typhoon|cyclone|flood|floods|flooding|wildfire|wildfires|landslide|eruption|drought|heatwave|heat wave|famine|derailment",
    "healthEmergency": "outbreak|epidemic|pandemic|cholera|ebola|mpox|public health emergency",
    "cyberAttack": "cyberattack|cyberattacks|cyber attack|cyber attacks|ransomware|data breach|ddos",
}
ESCALATING = "escalate|escalated|escalates|escalating|escalation|intensified|intensifies|intensifying|stepped up|new offensive|launched an offensive|renewed fighting|renewed attacks|declared war|retaliated|retaliatory|mobilized|mobilised|deployed additional|state of emergency"
DEESCALATING = "ceasefire|cease fire|truce|armistice|peace talks|peace deal|peace agreement|de escalation|de escalate|deescalation|withdrew|withdrawal|pulled back|prisoner exchange|prisoner swap|released hostages|hostages were released|lifted the curfew|lifted sanctions|resumed talks"
NEGATIONS = "no|not|never|without|rejected|rejects|refused|refuses|denied|denies|ruled"
REVERSALS = "collapsed|collapses|failed|fails|broke|violated|ended|stalled|faltered"

# Words that stand around a figure, by what they do, and what vague quantities are taken for.
MULTIPLIERS = {"thousand": 1_000, "million": 1_000_000}
AUXILIARIES = "were was have has had are is been being now reportedly".split()
DEATHS = "killed dead died deaths fatalities".split()
HARMS = "injured wounded hurt displaced evacuated missing hospitalised hospitalized homeless".split()
PEOPLE = "people persons civilians soldiers troops children residents others migrants workers passengers fighters militants police officers protesters demonstrators villagers patients refugees students journalists members adults women men".split()
DEADLY, HARMFUL = "killing killed kills".split(), "injuring injured wounding wounded displacing displaced".split()
QUALIFIERS = [q.split() for q in ("at least", "more than", "up to", "over", "about", "around", "nearly", "almost", "some")]
REACHING = "to at of reached hit passed surpassed exceeded".split()
QUANTITIES = {"dozens": 24, "scores": 40, "hundreds": 200, "thousands": 2_000, "millions": 2_000_000}
#: Characters between "toll" and the word that leads to its figure; auxiliaries before a harm; a figure is below this.
TOLL_REACH, MOST_AUXILIARIES, TOO_MANY = 40, 3, 10**12


def has_cue(padded: Column, cues: str, reversible: bool = False) -> Column:
    """Whether a cue stands as whole words, without a negation in the three words before, nor (if reversible) a reversal in the three after.

    ``padded`` is the phrase of the text between single spaces, so one regular expression reads word positions.
    """
    unless = rf"(?<! (?:{NEGATIONS}))(?<! (?:{NEGATIONS}) \S{{1,40}})(?<! (?:{NEGATIONS}) \S{{1,40}} \S{{1,40}})"
    after = rf"(?!(?: \S+){{0,2}} (?:{REVERSALS}) )" if reversible else ""
    # The cue is looked for first: the looks behind it are slow, and run only where it stands.
    return padded.rlike(rf"(?= (?:{cues}) ){unless} (?:{cues})(?= ){after}")


class Passage:
    """A passage as words and numbers with their places; figures are read outward from each number."""

    _TOKEN = re.compile(r"\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?|[a-z]+")

    def __init__(self, text: str):
        self.text = text.lower()
        found = list(self._TOKEN.finditer(self.text))
        self.words = [m[0] for m in found]
        self.spans = [m.span() for m in found]
        # whether only white space parts a word from the next
        self.joined = [bool(gap) and gap.isspace() for gap in (self.text[a[1] : b[0]] for a, b in zip(self.spans, self.spans[1:]))] + [False]

    def whole(self, i: int) -> bool:
        """Whether no letter, digit or underscore touches the word."""
        start, end = self.spans[i]
        touching = self.text[max(0, start - 1) : start] + self.text[end : end + 1]
        return not any(c.isalnum() or c == "_" for c in touching)

    def word(self, i: int, step: int) -> str:
        """The word ``step`` places after (or before) i if white space alone joins them all; else nothing."""
        to = i + step
        low, high = min(i, to), max(i, to)
        return self.words[to] if 0 <= to < len(self.words) and all(self.joined[low:high]) and self.whole(to) else ""

    def harm_at(self, i: int, step: int) -> int:
        """The step from i to a harm named ``step`` places after it, or up to three auxiliaries further on; 0 for none."""
        for k in range(step, step + MOST_AUXILIARIES + 1):
            word = self.word(i, k)
            if word in DEATHS or word in HARMS:
                return k
            if word not in AUXILIARIES:
                break
        return 0

    def harm_past(self, i: int, step: int, words: int) -> int:
        """The same with up to ``words`` words of any kind, numbers apart, before it."""
        for skipped in range(words + 1):
            if k := self.harm_at(i, step + skipped):
                return k
            if not self.word(i, step + skipped).isalpha():
                break
        return 0

    def harm_of_people(self, i: int, step: int) -> int:
        """The step to the harm of people named after a number, with "more" or "other" and one word more before them."""
        for skipped in range(3 if self.word(i, step) in ("more", "other") else 2):
            word = self.word(i, step + skipped)
            if word in PEOPLE and (k := self.harm_at(i, step + skipped + 1)):
                return k
            if not word.isalpha():
                break
        return 0

    def led_to_by(self, i: int) -> Iterator[int]:
        """The places of the words before a number: with a qualifier in between, or without."""
        for q in ([], *QUALIFIERS):
            if all(self.word(i, k - len(q)) == w for k, w in enumerate(q)) and self.word(i, -len(q) - 1):
                yield i - len(q) - 1

    def is_toll(self, k: int) -> bool:
        """Whether the word at k leads from a toll to its figure."""
        if self.words[k] not in REACHING:
            return False
        for t in range(k - 1, -1, -1):
            between = self.text[self.spans[t][1] : self.spans[k][0]]
            if len(between) > TOLL_REACH or "." in between or ";" in between:
                return False
            if self.words[t] == "toll" and self.whole(t):
                return True
        return False

    def figures(self) -> tuple[int, int]:
        """The largest number of deaths and of people harmed otherwise; 0 for none."""
        deaths = affected = free = 0
        for i, word in enumerate(self.words):
            if not self.whole(i):
                continue
            dead = harmed = False
            if word in QUANTITIES and i >= free:
                # "hundreds of thousands were killed" is read from its first word, once
                count = QUANTITIES[word]
                steps = [(self.word(i, 1) == "of" and self.harm_past(i, 2, 2)) or self.harm_past(i, 1, 2)]
                free = i + steps[0] + 1 if steps[0] else free
            elif word[0].isdigit():
                factor = MULTIPLIERS.get(self.word(i, 1), 1)
                count, step = counted(word, factor), 1 if factor == 1 else 2
                steps = [self.harm_of_people(i, step), self.harm_at(i, step)]
                for k in self.led_to_by(i):
                    dead |= self.words[k] in DEADLY or self.is_toll(k)
                    harmed |= self.words[k] in HARMFUL
            else:
                continue
            harms = {self.words[i + k] for k in steps if k}
            if count:
                deaths = max(deaths, count * (dead or bool(harms & set(DEATHS))))
                affected = max(affected, count * (harmed or bool(harms & set(HARMS))))
        return deaths, affected


def counted(number: str, factor: int) -> int:
    """What a number counts; 0 for one that reads as a year, for less than one and for a trillion or more."""
    if factor == 1 and re.fullmatch(r"(19|20)\d\d", number):
        return 0
    value = float(number.replace(",", "")) * factor
    return int(value) if 1 <= value < TOO_MANY else 0


@F.pandas_udf(T.StructType([T.StructField("deaths", T.LongType()), T.StructField("affected", T.LongType())]))
def figures(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """struct(deaths, affected) of each passage: the largest of each kind; 0 for none, and for null."""
    for batch in texts:
        yield pd.DataFrame([Passage(t or "").figures() for t in batch], columns=["deaths", "affected"])


def classify_facts(facts: DataFrame) -> DataFrame:
    """(event, quote) → (event, type, escalation, deaths, affected, n_facts): each fact is read once, then facts are counted by event."""
    padded = F.concat(F.lit(" "), F.array_join(words(F.col("quote")), " "), F.lit(" "))
    read = facts.select("event", padded.alias("p"), figures("quote").alias("f")).select("event", "p", "f.deaths", "f.affected")
    support = [F.count_if(has_cue(F.col("p"), cues)).alias(kind) for kind, cues in CUES.items()]
    g = read.groupBy("event").agg(*support, F.bool_or(has_cue(F.col("p"), ESCALATING)).alias("up"), F.bool_or(has_cue(F.col("p"), DEESCALATING, True)).alias("down"), F.max("deaths").alias("deaths"), F.max("affected").alias("affected"), F.count("*").alias("n_facts"))
    best = F.array_max(F.array(*(F.struct(F.col(kind).alias("n"), F.lit(-i).alias("place"), F.lit(kind).alias("kind")) for i, kind in enumerate(CUES))))
    escalation = F.when(F.col("up") & F.col("down"), "mixed").when(F.col("up"), "escalating").when(F.col("down"), "deescalating").otherwise("noSignal")
    return g.select("event", F.when(best["n"] > 0, best["kind"]).alias("type"), escalation.alias("escalation"), "deaths", "affected", "n_facts")
