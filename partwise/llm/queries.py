"""The operators over their whole tables with production parameters, as the entry module registers them."""

from __future__ import annotations

from . import quality_rules as rules
from .decontamination import decontaminate
from .html_extraction import extract
from .packing import pack
from .quality_classifier import classify_quality
from .quality_rules import quality_rules
from .secret_scan import secret_spans
from .shared import table
from .sharding import shard
from .signature_join import jaccard_components
from .suffix_dedup import remove_repeats
from .toxicity import classify_toxicity


def op3_winnow_decontamination(spark, sf_dir):
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_line_first_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"))


def op6_randomness_battery(spark, sf_dir):
    return secret_spans(table(spark, sf_dir, "documents"))


def op1_wrapper_extraction(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))


def op2_signature_tree_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"))


def op4_sampled_splitters(spark, sf_dir):
    return shard(table(spark, sf_dir, "documents"))


def op7_attention_mil(spark, sf_dir):
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_bounded_space_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


def op9_counterfactual_toxicity(spark, sf_dir):
    return classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_difference_cover_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_wrapper_extraction,
        op2_signature_tree_join,
        op3_winnow_decontamination,
        op4_sampled_splitters,
        op5_line_first_rules,
        op6_randomness_battery,
        op7_attention_mil,
        op8_bounded_space_packing,
        op9_counterfactual_toxicity,
        op10_difference_cover_dedup,
    )
}

# SQL of the operators that SQL can express; the tests hold the others against brute force.
BLANKS = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
FAILS = f"""(length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g')) * 100 > length(regexp_replace(x, '{BLANKS}', '', 'g')) * {rules.SYMBOL_PERCENT}
    OR (len(string_split(x, '!!')) - 1) * 4 > len(string_split_regex(trim(x), '{BLANKS}'))
    OR (len(string_split_regex(x, '{rules.SEPARATORS}')) - 1 >= {rules.NAV_BARS} AND len(string_split_regex(trim(x), '{BLANKS}')) <= 4 * (len(string_split_regex(x, '{rules.SEPARATORS}')) - 1))
    OR (len(string_split_regex(trim(x), '{BLANKS}')) <= {rules.TEASER} AND regexp_matches(x, '{rules.ELLIPSIS}'))
    OR regexp_matches(x, '{rules.PHRASES}'))"""

ORACLES: dict[str, str] = {
    "op2_signature_tree_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORDS}') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + least(5, len(w)) - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS k FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * m >= 80 * (a.n + b.n - m)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.least, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT x, min(y) AS least FROM reach GROUP BY x) r ON r.x = d.doc_id""",
    "op3_winnow_decontamination": rf"""
WITH b AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.n, dw.k, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id""",
    "op5_line_first_rules": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w,
  string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT *, list_filter(ls, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT r, k, count(*) OVER (PARTITION BY r, s) AS c FROM (SELECT r, k, array_to_string(w[k : k + 2], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS k FROM d WHERE len(w) > 2))),
m AS (SELECT r, count(DISTINCT pos) AS n FROM (SELECT r, unnest(range(k, k + 3)) AS pos FROM g WHERE c > 1) GROUP BY r),
e AS (SELECT l.*, coalesce(m.n, 0) AS n_repeat_words, len(regexp_extract_all(array_to_string(list_filter(lines, lambda x: NOT {FAILS}), chr(10)), '{WORDS}')) AS kept_words FROM l LEFT JOIN m ON m.r = l.r),
f AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_repeat_words, kept_words, len(w) < 50 OR 100 * n_repeat_words > 50 * len(w) AS base_failed FROM e)
SELECT *, NOT base_failed AND 100 * (n_words - kept_words) <= {rules.LOST_PERCENT} * n_words AS kept FROM f""",
}
