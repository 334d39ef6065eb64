"""Queries on the training-data operators, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import bpe, canonical, chunking, history_dedup, leakage, near_duplicates, secrets, survivor

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return history_dedup.known_reports(table(spark, sf, "finding_batches"), table(spark, sf, "findings"), table(spark, sf, "scans"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return survivor.survivors(table(spark, sf, "findings"), table(spark, sf, "source_trust")).select("finding_key", "field_name", "seq")


def p2_records(spark: SparkSession, sf: str) -> DataFrame:
    return survivor.surviving_records(table(spark, sf, "findings"), table(spark, sf, "source_trust"))


def p2_layers(spark: SparkSession, sf: str) -> DataFrame:
    """Completeness by the number of usable fields: later layers supply values."""
    return survivor.survivors(table(spark, sf, "findings"), table(spark, sf, "source_trust"), "count")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.canonical_entries(table(spark, sf, "findings"), table(spark, sf, "cwe_catalog"), table(spark, sf, "owasp_catalog"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.similar_reports(table(spark, sf, "findings"), table(spark, sf, "scans"))


def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.similar_groups(table(spark, sf, "findings"), table(spark, sf, "scans"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.found_secrets(table(spark, sf, "findings"))


def p6_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.redacted(table(spark, sf, "findings"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.token_ids(table(spark, sf, "documents"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    found = leakage.leaked_passages(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.where(f"exact_words >= {leakage.WORDS}").select("doc_id", "item_id")


def p8_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Passages of 12 words within two character edits, the exact ones included."""
    return leakage.leaked_passages(table(spark, sf, "documents"), table(spark, sf, "benchmark")).select("doc_id", "item_id", "edits")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.split_documents(table(spark, sf, "documents")).where("piece_no = 1").select("doc_id")


def p9_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.split_documents(table(spark, sf, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p2_found, p2_records, p2_layers, p3_found, p5_found, p5_groups, p6_found, p6_redacted, p7_ids, p8_found, p8_passages, p9_found, p9_pieces)}

_SPELLED = r"regexp_replace(lower(regexp_replace({c}, '^\s+|\s+$', '', 'g')), '[\\/]+', '/', 'g')"
_PLACED = (
    """targets AS (SELECT DISTINCT lower(trim(target_path)) AS seg FROM scans WHERE target_path IS NOT NULL),
paths AS (SELECT DISTINCT file_path, string_split("""
    + _SPELLED.format(c="file_path")
    + """, '/') AS parts FROM (SELECT file_path FROM findings UNION SELECT file_path FROM finding_batches) WHERE file_path IS NOT NULL),
marks AS (SELECT file_path, min(i) AS i FROM (SELECT file_path, parts, unnest(range(1, len(parts) + 1)) AS i FROM paths) p JOIN targets t ON p.parts[p.i] = t.seg GROUP BY file_path),
placed AS (SELECT p.file_path, array_to_string(p.parts[coalesce(m.i, 1):], '/') AS file_key FROM paths p LEFT JOIN marks m ON p.file_path = m.file_path)"""
)
_ID = r"nullif(lower(regexp_replace(finding_id, '^\s+|\s+$', '', 'g')), '')"

_GONE = "('', 'n/a', 'null', 'unknown', 'tbd', '-', '--', '?', 'none', 'todo')"
_CELLS = f"""
rows AS (
  SELECT f.seq, {_ID} AS finding_key, coalesce(t.trust_rank, 2000000000) AS r, coalesce(found_at, '-infinity'::DOUBLE) AS found, confidence, f.source, cwe_id, remediation,
    coalesce(confidence > 0 AND confidence <= 1, false) AS c_ok, f.source IS NOT NULL AS s_ok, coalesce(lower(trim(cwe_id)) NOT IN {_GONE}, false) AS w_ok, coalesce(lower(trim(remediation)) NOT IN {_GONE}, false) AS m_ok
  FROM findings f LEFT JOIN source_trust t ON lower(regexp_replace(f.source, '^\\s+|\\s+$', '', 'g')) = t.source
), many AS (SELECT finding_key FROM rows WHERE finding_key IS NOT NULL GROUP BY 1 HAVING count(*) >= 2),
cells AS (
  SELECT finding_key, 'confidence' AS field_name, seq, r, found, c_ok AS ok FROM rows UNION ALL SELECT finding_key, 'source', seq, r, found, s_ok FROM rows
  UNION ALL SELECT finding_key, 'cwe_id', seq, r, found, w_ok FROM rows UNION ALL SELECT finding_key, 'remediation', seq, r, found, m_ok FROM rows
)"""
_WON = "SELECT finding_key, field_name, seq FROM cells JOIN many USING (finding_key) WHERE ok QUALIFY row_number() OVER (PARTITION BY finding_key, field_name ORDER BY r, found DESC, seq) = 1"

_PAIRS = f"""{_PLACED},
rows AS (
  SELECT seq, {_ID} AS id_key, file_key, line_number AS line, list_distinct(regexp_extract_all(lower(concat_ws(' ', title, description)), '[a-z0-9]+')) AS w
  FROM findings JOIN placed USING (file_path) WHERE line_number IS NOT NULL
), pairs AS (
  SELECT a.seq AS seq_a, b.seq AS seq_b FROM rows a JOIN rows b ON a.file_key = b.file_key AND a.seq < b.seq AND abs(a.line - b.line) <= 5 AND a.id_key <> b.id_key
  WHERE len(list_intersect(a.w, b.w)) > 0 AND len(list_intersect(a.w, b.w)) >= 0.6 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))
)"""

ORACLES: dict[str, str] = {
    "p5_found": f"WITH {_PAIRS} SELECT seq_a, seq_b FROM pairs",
    "p5_groups": f"""WITH RECURSIVE {_PAIRS}, both_ways AS (SELECT seq_a AS u, seq_b AS v FROM pairs UNION ALL SELECT seq_b, seq_a FROM pairs),
reach AS (SELECT DISTINCT u AS seq, u AS met FROM both_ways UNION SELECT r.seq, b.v FROM reach r JOIN both_ways b ON r.met = b.u),
roots AS (SELECT seq, min(met) AS group_id FROM reach GROUP BY 1)
SELECT seq, group_id, links FROM roots JOIN (SELECT u AS seq, count(*) AS links FROM both_ways GROUP BY 1) USING (seq)""",
    "p2_found": f"WITH {_CELLS} {_WON}",
    "p2_records": f"""WITH {_CELLS}, won AS ({_WON}) SELECT w.finding_key, max(confidence) FILTER (field_name = 'confidence') AS confidence, max(cwe_id) FILTER (field_name = 'cwe_id') AS cwe_id,
max(remediation) FILTER (field_name = 'remediation') AS remediation, max(source) FILTER (field_name = 'source') AS source FROM won w JOIN rows r ON w.seq = r.seq GROUP BY 1""",
    "p2_layers": f"""WITH RECURSIVE {_CELLS},
points AS (SELECT r.*, c_ok::INT + s_ok::INT + w_ok::INT + m_ok::INT AS full_fields FROM rows r JOIN many USING (finding_key) QUALIFY row_number() OVER (PARTITION BY finding_key, r, c_ok, s_ok, w_ok, m_ok ORDER BY found DESC, seq) = 1),
above AS (SELECT a.seq AS high, b.seq AS low FROM points a JOIN points b ON a.finding_key = b.finding_key AND a.seq <> b.seq AND a.r <= b.r AND (a.found > b.found OR a.found = b.found AND a.seq < b.seq) AND a.full_fields >= b.full_fields),
steps AS (SELECT seq, 1 AS layer FROM points UNION SELECT low, layer + 1 FROM steps JOIN above ON high = seq),
layers AS (SELECT seq, max(layer)::INT AS layer FROM steps GROUP BY 1)
SELECT c.finding_key, field_name, c.seq, layer FROM cells c JOIN points p ON p.seq = c.seq JOIN layers l ON l.seq = c.seq WHERE ok QUALIFY row_number() OVER (PARTITION BY c.finding_key, field_name ORDER BY layer, c.r, c.found DESC, c.seq) = 1""",
    "p1_found": f"""
WITH {_PLACED},
reports AS (
  SELECT seq, arrival, {_ID} AS id_key, file_key, list_sort(regexp_extract_all(title, '[0-9]+')) AS nums, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS t, batched
  FROM (SELECT seq, -1 AS arrival, finding_id, title, file_path, false AS batched FROM findings UNION ALL SELECT seq, seq, finding_id, title, file_path, true FROM finding_batches) r
  LEFT JOIN placed USING (file_path)
),
grams AS (SELECT *, list_distinct(list_transform(range(1, greatest(len(t) - 1, 1)), lambda i: substr(t, i::INT, 3))) AS g FROM reports)
SELECT DISTINCT b.seq FROM grams b JOIN grams h ON h.arrival < b.arrival AND h.id_key = b.id_key WHERE b.batched
UNION
SELECT DISTINCT b.seq FROM grams b JOIN grams h ON h.arrival < b.arrival AND h.file_key = b.file_key AND h.nums = b.nums
WHERE b.batched AND len(b.g) > 0 AND len(list_intersect(b.g, h.g)) * 3 >= len(b.g) + len(h.g)
""",
    "p8_found": """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL),
dg AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12)),
ig AS (SELECT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
""",
    # A window within two edits keeps one of its thirds, so the first 16 characters of one of them; no window of the items is under 51.
    "p8_passages": """
WITH d AS (SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' ') AS t FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM iw WHERE len(w) >= 12)),
parts AS (SELECT item_id, s, n, off, substr(s, off + 1, 16) AS g FROM (SELECT item_id, s, len(s) AS n, unnest([0, len(s) // 3, 2 * (len(s) // 3)]) AS off FROM win)),
grams AS (SELECT doc_id, t, k, substr(t, k, 16) AS g FROM (SELECT doc_id, t, unnest(range(1, len(t) - 14)) AS k FROM d)),
near AS (SELECT DISTINCT doc_id, t, item_id, s, n, k - off AS start FROM grams JOIN parts USING (g)),
tried AS (SELECT doc_id, item_id, s, levenshtein(substr(t, b, least(len(t), e) - b + 1), s) AS x FROM (SELECT doc_id, t, item_id, s, greatest(1, start + a) AS b, start + n - 1 + z AS e FROM near, (SELECT unnest(range(-2, 3)) AS a), (SELECT unnest(range(-2, 3)) AS z)))
SELECT doc_id, item_id, min(x)::INT AS edits FROM tried GROUP BY 1, 2 HAVING min(x) <= 2
""",
}


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_PLAIN = "trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"
_KEY = "(?:^|[^a-z])(api|a)[^a-z0-9]*0*([0-9]{1,2})(?:[^0-9]|$)"
# Every form of a value against every reference text: the plain way to say what the segment join finds.
ORACLES["p3_found"] = f"""
WITH entered AS (
  SELECT seq, field_name, value FROM (SELECT seq, source, 'cwe_id' AS field_name, cwe_id AS value FROM findings UNION ALL SELECT seq, source, 'owasp_category', owasp_category FROM findings)
  WHERE source IS NOT NULL AND lower(regexp_replace(source, '^\\s+|\\s+$', '', 'g')) NOT IN ({", ".join(_quoted(s) for s in canonical.SCANNERS)}) AND regexp_matches(value, '\\S')
), v AS (SELECT DISTINCT field_name, value, lower(translate(value, {_quoted(canonical._WIDE)}, {_quoted(canonical._NARROW)})) AS a FROM entered),
keyed AS (
  SELECT field_name, value, a, CASE WHEN NOT regexp_matches(a, '[0-9]') THEN NULL
    WHEN field_name = 'cwe_id' THEN 'CWE-' || ltrim(regexp_extract(a, '([0-9]+)', 1), '0')
    WHEN regexp_matches(a, '{_KEY}') THEN upper(regexp_extract(a, '{_KEY}', 1)) || lpad(regexp_extract(a, '{_KEY}', 2), 2, '0') || ':' ||
      CASE WHEN regexp_matches(a, '(?:^|[^0-9])(?:19|20)[0-9]{{2}}(?:[^0-9]|$)') THEN regexp_extract(a, '(?:^|[^0-9])((?:19|20)[0-9]{{2}})(?:[^0-9]|$)', 1) WHEN regexp_extract(a, '{_KEY}', 1) = 'a' THEN '2021' ELSE '2023' END
    ELSE '' END AS k FROM v
), catalog AS (SELECT 'cwe_id' AS field_name, * FROM cwe_catalog UNION ALL SELECT 'owasp_category', * FROM owasp_catalog),
texts AS (SELECT field_name, canon_key, {_PLAIN.format(c="title")} AS t, alt_names FROM catalog),
refs AS (
  SELECT field_name, canon_key, t AS text FROM texts UNION SELECT field_name, canon_key, {_PLAIN.format(c="n")} FROM (SELECT field_name, canon_key, unnest(alt_names) AS n FROM catalog)
  UNION SELECT field_name, canon_key, array_to_string(w[1:i - 1] || w[i + 1:], ' ') FROM (SELECT field_name, canon_key, string_split(t, ' ') AS w, unnest(range(1, len(string_split(t, ' ')) + 1)) AS i FROM texts) WHERE len(w) > 3
), bounded AS (SELECT *, greatest(CASE WHEN len(text) >= 6 THEN 2 WHEN len(text) >= 4 THEN 1 ELSE 0 END, len(text) // {canonical.CHARS_PER_EDIT}) AS most FROM refs WHERE text != ''),
forms AS (SELECT DISTINCT field_name, value, unnest([p, regexp_replace(p, '^((?:{"|".join(canonical.HEDGES)}) )+', ''), {_PLAIN.format(c="regexp_replace(a, '^([^,]*),(.*)$', '\\2 \\1')")}]) AS form FROM (SELECT *, {_PLAIN.format(c="a")} AS p FROM keyed WHERE k IS NULL)),
near AS (SELECT f.field_name, f.value, r.canon_key, min(levenshtein(form, text)) AS d FROM forms f JOIN bounded r ON f.field_name = r.field_name AND abs(len(form) - len(text)) <= most WHERE form != '' AND levenshtein(form, text) <= most GROUP BY 1, 2, 3),
best AS (SELECT field_name, value, arg_min(canon_key, (d, canon_key)) AS canon_key FROM near GROUP BY 1, 2),
mapped AS (SELECT k.field_name, k.value, c.canon_key FROM keyed k JOIN catalog c ON k.field_name = c.field_name AND k.k = c.canon_key UNION ALL SELECT * FROM best)
SELECT e.seq, e.field_name, coalesce(m.canon_key, '{canonical.UNMATCHED}') AS canon_key FROM entered e LEFT JOIN mapped m ON e.field_name = m.field_name AND e.value = m.value
"""
