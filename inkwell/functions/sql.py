"""Functions that SQL can call: ``register(spark)`` makes them temporary functions of the session.

They are SQL expressions, so Catalyst inlines them into the plan: no Python worker runs, and filters on them are optimized as if
they were written out.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .urls import TRACKING

_WORDS = r"filter(split(lower({}), '[^\\p{{L}}\\p{{N}}]+'), w -> w <> '')"
_HOST = r"regexp_replace(regexp_replace(lower(regexp_extract(trim({}), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\\.$', ''), '^www\\.', '')"

#: name → (parameters, type, expression)
FUNCTIONS = {
    "ink_words": ("t STRING", "ARRAY<STRING>", _WORDS.format("t")),
    "ink_padded": ("t STRING", "STRING", "concat(' ', array_join(" + _WORDS.format("t") + ", ' '), ' ')"),
    "ink_host": ("url STRING", "STRING", "nullif(" + _HOST.format("url") + ", '')"),
    "ink_feed_key": ("url STRING", "STRING", r"CASE WHEN trim(url) RLIKE '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+' THEN concat(lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)), regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '/$', '')) ELSE trim(url) END"),
    "ink_category": ("label STRING", "STRING", "CASE WHEN lower(trim(label)) IN ('medical', 'health & wellness') THEN 'health' WHEN lower(trim(label)) IN ('tech', 'technology') THEN 'technology' ELSE nullif(lower(trim(label)), '') END"),
    "ink_publisher": ("url STRING, source STRING", "STRING", "coalesce(nullif(" + _HOST.format("url") + ", ''), source)"),
    "ink_input_hash": ("title STRING, description STRING, content STRING", "STRING", "sha2(concat_ws('', transform(array(coalesce(title, ''), coalesce(description, ''), coalesce(content, '')), x -> concat(octet_length(x), ':', x))), 256)"),
    "ink_muted_source": ("url STRING, rules ARRAY<STRING>", "BOOLEAN", "exists(rules, r -> " + _HOST.format("url") + " = r OR endswith(" + _HOST.format("url") + ", concat('.', r)))"),
    "ink_muted_topic": ("title STRING, description STRING, phrases ARRAY<STRING>", "BOOLEAN", "exists(phrases, p -> contains(concat(' ', array_join(" + _WORDS.format("concat_ws(' ', title, description)") + ", ' '), ' '), concat(' ', array_join(" + _WORDS.format("p") + ", ' '), ' ')))"),
    "ink_section": ("title STRING, description STRING, category STRING, wanted STRING, phrases ARRAY<STRING>", "BOOLEAN", "coalesce(lower(category) = lower(wanted), false) OR exists(phrases, p -> contains(concat(' ', array_join(" + _WORDS.format("concat_ws(' ', title, description)") + ", ' '), ' '), concat(' ', array_join(" + _WORDS.format("p") + ", ' '), ' ')))"),
    # The label of most points (3 in the title, 1.5 in the description, 0.5 in the body, times the phrase's factor), the first listed of equal ones; null below two points.
    "ink_topic": (
        "title STRING, description STRING, body STRING, taxonomy ARRAY<STRUCT<label: STRING, phrase: STRING, factor: DOUBLE>>", "STRING",
        "try_element_at(filter(array(array_max(transform(array_distinct(transform(taxonomy, t -> t.label)), (l, i) -> struct(aggregate(filter(taxonomy, t -> t.label = l), 0D, (s, t) -> s + t.factor * ("
        + " + ".join(f"CASE WHEN contains(concat(' ', array_join({_WORDS.format(f'coalesce({c}, {chr(39) * 2})')}, ' '), ' '), concat(' ', array_join({_WORDS.format('t.phrase')}, ' '), ' ')) THEN {w}D ELSE 0D END" for c, w in (("title", 3.0), ("description", 1.5), ("body", 0.5)))
        + ")) AS score, -i AS place, l AS label)))), b -> b.score >= 2), 1).label",
    ),
    "ink_cosine": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "CASE WHEN size(a) = size(b) AND size(a) > 0 THEN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) END"),
    "ink_tracking": ("name STRING", "BOOLEAN", "lower(name) LIKE 'utm\\\\_%' OR lower(name) IN (" + ", ".join(f"'{t}'" for t in TRACKING) + ")"),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session; returns their names. Repeating it replaces them."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
