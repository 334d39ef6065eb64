"""Problem 3: free-entered weakness classes mapped to the catalogs, in SQL only.

A value that gives a key or number is decided by it alone. Any other text goes through a pigeonhole join: every reference text
(title, alternative name, title with one word left out) is cut into k+1 segments, where k is the number of edits allowed for its
length; a value within k edits holds one of them unchanged, shifted by at most k. Values are equality-joined on (segment, start),
candidates verified with the bounded levenshtein(), the closest entry taken, and what is left over found by an anti-join.

Forms shorter or longer than any reference text allows are left out before substrings are made, and the rest is spread over all
partitions: they are few bytes, but each makes many substrings. Only distinct values are matched, so repeated entries (a third of all rows may hold one value) are reduced map-side first; the
catalogs are fixed lists of some dozens of entries, from which the segment index is built (under 20,000 rows); Spark broadcasts it
by its size. The mapping returns to the rows by a join that AQE may split at a hot value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.text import SCANNERS

UNMATCHED = "UNMATCHED"
#: One edit is allowed for each so many characters of a reference text; two from six characters on (a swap of two letters counts
#: as two), one for four or five, none below. So no segment is longer than CHARS_PER_EDIT.
CHARS_PER_EDIT = 6
#: Words before a value that express doubt or repeat the field's name.
HEDGES = ["probably", "possibly", "perhaps", "likely", "maybe", "class", "category", "type", "see", "cwe", "owasp", "it is", "looks like", "i think", "suspected", "potential"]

_WIDE = "".join(chr(0xFF01 + i) for i in range(94)) + "　–—−‐‑"
_NARROW = "".join(chr(0x21 + i) for i in range(94)) + " -----"


def _sql_text(s: str) -> str:
    """A literal for a text that spark.sql() formats: braces doubled."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("{", "{{").replace("}", "}}") + "'"


_VALUES = """
SELECT field_name, value, ascii,
    CASE
      WHEN field_name = 'cwe_id' AND regexp_like(ascii, '[0-9]')
        THEN concat('CWE-', regexp_replace(regexp_extract(ascii, '([0-9]+)', 1), '^0+(?=[0-9])', ''))
      WHEN field_name = 'owasp_category' AND regexp_like(ascii, '[0-9]')
        THEN CASE WHEN regexp_like(ascii, {key_re})
          THEN concat(upper(regexp_extract(ascii, {key_re}, 1)), lpad(regexp_extract(ascii, {key_re}, 2), 2, '0'), ':',
                      coalesce(nullif(regexp_extract(ascii, {year_re}, 1), ''), CASE WHEN regexp_extract(ascii, {key_re}, 1) = 'a' THEN '2021' ELSE '2023' END))
          ELSE '' END
    END AS key_text
FROM (SELECT field_name, value, lower(translate(value, {wide}, {narrow})) AS ascii FROM {entered})
"""

_ENTERED = """
SELECT DISTINCT field_name, value FROM (
  SELECT stack(2, 'cwe_id', cwe_id, 'owasp_category', owasp_category) AS (field_name, value)
  FROM {findings}
  WHERE source IS NOT NULL AND lower(regexp_replace(source, '^\\\\s+|\\\\s+$', '')) NOT IN ({scanners})
) WHERE value IS NOT NULL AND regexp_like(value, '[^\\\\s\\u00a0\\u3000]')
"""

_PLAIN = "trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' '))"

_REFS = """
SELECT DISTINCT field_name, canon_key, text, length(text) AS len, cast(greatest(CASE WHEN length(text) >= 6 THEN 2 WHEN length(text) >= 4 THEN 1 ELSE 0 END, length(text) div {per}) AS int) AS k
FROM (
  SELECT field_name, canon_key, explode(concat(array(t), alts, IF(size(split(t, ' ')) > 3, transform(sequence(0, size(split(t, ' ')) - 1), i -> array_join(filter(split(t, ' '), (w, j) -> j != i), ' ')), array()))) AS text
  FROM (SELECT field_name, canon_key, {plain_title} AS t, transform(coalesce(alt_names, array()), a -> {plain_alt}) AS alts FROM (
    SELECT 'cwe_id' AS field_name, * FROM {cwe} UNION ALL SELECT 'owasp_category' AS field_name, * FROM {owasp}))
) WHERE text != ''
"""

_INDEX = """
SELECT field_name, canon_key, text, k, len, seg, start + shift AS start
FROM (
  SELECT *, explode(sequence(-k, k)) AS shift FROM (
    SELECT *, substr(text, start, cast(floor((i + 1) * len / (k + 1)) AS int) + 1 - start) AS seg FROM (
      SELECT *, cast(floor(i * len / (k + 1)) AS int) + 1 AS start FROM (
        SELECT *, explode(sequence(0, k)) AS i FROM {refs})))
) WHERE start + shift >= 1
"""

_FORMS = """
SELECT /*+ REPARTITION({parts}, form, value) */ * FROM (SELECT DISTINCT field_name, value, form FROM (
  SELECT field_name, value, explode(array(plain, regexp_replace(plain, {hedge_re}, ''), {turned})) AS form
  FROM (SELECT *, {plain} AS plain FROM {values} WHERE key_text IS NULL)
) WHERE length(form) BETWEEN (SELECT min(len - k) FROM {refs}) AND (SELECT max(len + k) FROM {refs}) AND form != '')
"""

_BEST = """
SELECT field_name, value, min_by(canon_key, struct(d, canon_key)) AS canon_key FROM (
  SELECT field_name, value, canon_key, min(levenshtein(form, text, k)) AS d FROM (
    SELECT DISTINCT f.field_name, f.value, f.form, x.canon_key, x.text, x.k
    FROM (SELECT *, explode(flatten(transform(sequence(1, length(form)), s -> transform(filter(array({lengths}), l -> s + l - 1 <= length(form)), l -> struct(s AS start, substr(form, s, l) AS seg))))) AS p FROM {forms}) f
    JOIN {index} x ON f.field_name = x.field_name AND f.p.start = x.start AND f.p.seg = x.seg AND abs(length(f.form) - x.len) <= x.k
  ) WHERE levenshtein(form, text, k) >= 0
  GROUP BY field_name, value, canon_key
) GROUP BY field_name, value
"""

_MAPPED = """
SELECT v.field_name, v.value, c.canon_key FROM {values} v JOIN {keys} c ON v.field_name = c.field_name AND v.key_text = c.canon_key
UNION ALL SELECT field_name, value, canon_key FROM {best}
"""

_RESULT = """
WITH entered AS (
  SELECT seq, field_name, value FROM (
    SELECT seq, stack(2, 'cwe_id', cwe_id, 'owasp_category', owasp_category) AS (field_name, value)
    FROM {findings}
    WHERE source IS NOT NULL AND lower(regexp_replace(source, '^\\\\s+|\\\\s+$', '')) NOT IN ({scanners})
  ) WHERE value IS NOT NULL AND regexp_like(value, '[^\\\\s\\u00a0\\u3000]')
), unmatched AS (
  SELECT v.field_name, v.value, '{none}' AS canon_key FROM {values} v LEFT ANTI JOIN {mapped} m ON v.field_name = m.field_name AND v.value = m.value
)
SELECT e.seq, e.field_name, a.canon_key
FROM entered e JOIN (SELECT * FROM {mapped} UNION ALL SELECT * FROM unmatched) a ON e.field_name = a.field_name AND e.value = a.value
"""

_KEY_RE = _sql_text("(?:^|[^a-z])(api|a)[^a-z0-9]*0*([0-9]{1,2})(?![0-9])")
_YEAR_RE = _sql_text("(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])")


def canonical_values(findings: DataFrame, cwe: DataFrame, owasp: DataFrame) -> DataFrame:
    """field_name, value, canon_key of each different value that an agent entered and that has an entry; the rest is unmatched."""
    return _mapping(findings, cwe, owasp)[1]


def _mapping(findings: DataFrame, cwe: DataFrame, owasp: DataFrame) -> tuple[DataFrame, DataFrame]:
    spark = findings.sparkSession
    scanners = ", ".join(_sql_text(s) for s in SCANNERS)
    entered = spark.sql(_ENTERED.replace("{scanners}", scanners), findings=findings)
    values = spark.sql(_VALUES.replace("{key_re}", _KEY_RE).replace("{year_re}", _YEAR_RE).replace("{wide}", _sql_text(_WIDE)).replace("{narrow}", _sql_text(_NARROW)), entered=entered)
    catalog = [c.select("canon_key", "title", "alt_names") for c in (cwe, owasp)]
    refs = spark.sql(_REFS.replace("{plain_title}", _PLAIN.format(c="title")).replace("{plain_alt}", _PLAIN.format(c="a")).replace("{per}", str(CHARS_PER_EDIT)), cwe=catalog[0], owasp=catalog[1])
    index = spark.sql(_INDEX, refs=refs)
    hedges = _sql_text("^((" + "|".join(HEDGES) + ") )+")
    turned = _PLAIN.format(c="regexp_replace(ascii, '^([^,]*),(.*)$', '$2 $1')")
    forms = spark.sql(_FORMS.replace("{hedge_re}", hedges).replace("{plain}", _PLAIN.format(c="ascii")).replace("{turned}", turned).replace("{parts}", findings.sparkSession.conf.get("spark.sql.shuffle.partitions")), values=values, refs=refs)
    lengths = ", ".join(str(n) for n in range(1, CHARS_PER_EDIT + 1))
    best = spark.sql(_BEST.replace("{lengths}", lengths), forms=forms, index=index)
    keys = spark.sql("SELECT 'cwe_id' AS field_name, canon_key FROM {cwe} UNION ALL SELECT 'owasp_category', canon_key FROM {owasp}", cwe=catalog[0], owasp=catalog[1])
    return values, spark.sql(_MAPPED, values=values, keys=keys, best=best)


def canonical_entries(findings: DataFrame, cwe: DataFrame, owasp: DataFrame) -> DataFrame:
    """seq, field_name, canon_key of each field an agent filled; UNMATCHED where no entry is meant.

    Rows with null source are no agent's. Null and blank fields give no row. Ties between entries go to the smaller key. An
    empty catalog leaves everything unmatched.
    """
    values, mapped = _mapping(findings, cwe, owasp)
    scanners = ", ".join(_sql_text(s) for s in SCANNERS)
    rows = findings.select("seq", "source", "cwe_id", "owasp_category")
    return findings.sparkSession.sql(_RESULT.replace("{scanners}", scanners).replace("{none}", UNMATCHED), findings=rows, values=values, mapped=mapped)
