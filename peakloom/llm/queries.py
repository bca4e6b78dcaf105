"""The text operators' queries, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from peakloom.llm.codebooks import CODES_SQL, op13_vector_codes
from peakloom.llm.langid import op6_language
from peakloom.llm.media import op9_media
from peakloom.llm.mixing import op8_mixing
from peakloom.llm.negatives import NEGATIVES_SQL, op12_hard_negatives
from peakloom.llm.pieces import op5_sentencepiece
from peakloom.llm.pii import op3_pii
from peakloom.llm.quality import op1_quality
from peakloom.llm.rules import op7_rules
from peakloom.llm.simhash import op4_simhash
from peakloom.llm.substrings import op10_substrings
from peakloom.llm.tokencounts import op11_token_counts
from peakloom.llm.toxicity import op2_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_toxicity": op2_toxicity,
        "op3_pii": op3_pii,
        "op4_simhash": op4_simhash,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_language": op6_language,
        "op7_rules": op7_rules,
        "op8_mixing": op8_mixing,
        "op9_media": op9_media,
        "op10_substrings": op10_substrings,
        "op11_token_counts": op11_token_counts,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_vector_codes": op13_vector_codes,
    }


#: The mix with the default weights (square roots of the sources' sizes), 1024 slots and blocks of 16 rows: whole weights by
#: largest remainders, one period by earliest deadline first (`pick` is a source's place by name), then every row's slot.
MIXING_SQL = """
WITH RECURSIVE n AS (SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1),
i AS (SELECT s, sqrt(n) / sum(sqrt(n)) OVER () * 1024 AS ideal FROM n),
f AS (SELECT s, floor(ideal)::BIGINT AS w, row_number() OVER (ORDER BY ideal - floor(ideal) DESC, s) AS r, 1024 - sum(floor(ideal)) OVER () AS spare FROM i),
w AS (SELECT s, w + CASE WHEN r <= spare THEN 1 ELSE 0 END AS w, row_number() OVER (ORDER BY s) AS id FROM f),
l AS (SELECT list(w ORDER BY id) AS ws FROM w),
e(t, done, pick, k) AS (
  SELECT 0::BIGINT, list_transform(ws, lambda x: 0::BIGINT), 0::BIGINT, 0::BIGINT FROM l
  UNION ALL
  SELECT t + 1, list_transform(done, lambda d, j: d + CASE WHEN j = p THEN 1 ELSE 0 END), p, done[p] FROM (
    SELECT t, done, list_min(list_transform(ws, lambda x, j: CASE WHEN done[j] < x AND done[j] * 1024 // x <= t THEN ((done[j] + 1) * 1024 + x - 1) // x * 1000 + j ELSE 999999999 END)) % 1000 AS p
    FROM e, l WHERE t < 1024)
),
d AS (SELECT doc_id, source, coalesce(source, '') AS s, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS i FROM documents),
b AS (SELECT d.doc_id, d.source, d.i, d.i // 16 AS block, w.w, w.id FROM d JOIN w ON d.s = w.s),
p AS (SELECT b.*, (b.block // b.w) * 1024 + e.t - 1 AS slot FROM b JOIN e ON e.pick = b.id AND e.k = b.block % b.w)
SELECT doc_id, source, block AS mix_block, slot AS mix_slot, slot * 16 + i % 16 AS mix_position FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_mixing": MIXING_SQL, "op12_hard_negatives": NEGATIVES_SQL, "op13_vector_codes": CODES_SQL}
