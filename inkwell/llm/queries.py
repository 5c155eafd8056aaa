"""The training-data queries, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from .classifier import op8_quality_classifier
from .digest import op2_canonical_digest
from .licenses import op7_license_scan
from .linededup import op10_line_dedup
from .mixing import op4_mixing
from .passages import op9_repeated_passages
from .pieces import op1_sentencepiece
from .pii import op5_pii
from .quality import op6_quality_rules
from .simhash import op3_simhash_neardup
from .tokencounts import op11_token_counts
from .variants import op12_spelling_variants
from .vectorcodes import op13_vector_codes

QUERIES = {
    f.__name__: f
    for f in (
        op1_sentencepiece,
        op2_canonical_digest,
        op3_simhash_neardup,
        op4_mixing,
        op5_pii,
        op6_quality_rules,
        op7_license_scan,
        op8_quality_classifier,
        op9_repeated_passages,
        op10_line_dedup,
        op11_token_counts,
        op12_spelling_variants,
        op13_vector_codes,
    )
}

#: Empty where SQL can't express a query: those are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op10_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k
  FROM documents
), keyed AS (
  SELECT doc_id, k, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), common AS (
  SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT doc_id, k, line, top IS NOT NULL AND doc_id <> top AS dropped FROM keyed LEFT JOIN common USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE dropped))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id""",
}
