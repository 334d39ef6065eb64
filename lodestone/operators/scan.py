"""Scans over files(path, content): selection, pattern rules, statistics, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..dims import CONFIG_DIRECTORIES, CONFIG_NAMES, EXTENSIONS, FRAMEWORKS, LANGUAGES, MANIFESTS, PATTERN_SKIPPED, PRIORITY_FILES, RULES, SECURITY_WORDS, SKIPPED_DIRECTORIES, Rule
from ..functions.text import basename, contains_any

#: Longest content that the pattern rules read, in characters.
MOST_CHARS = 500_000


def parts_of(path: Column) -> Column:
    return F.split(path, "/")


def extension(path: Column) -> Column:
    """Suffix of the base name with its dot; empty for names without or with a leading dot only."""
    return F.regexp_extract(basename(path), r"(?<=.)(\.[^.]+)$", 1)


def below(path: Column, directories: list[str]) -> Column:
    return F.arrays_overlap(F.slice(parts_of(path), F.lit(1), F.size(parts_of(path)) - 1), F.array(*[F.lit(d) for d in directories]))


def selected(files: DataFrame) -> DataFrame:
    """Files with a supported suffix (case matters) that lie in no skipped directory."""
    return files.where(extension(F.col("path")).isin(EXTENSIONS) & ~below(F.col("path"), SKIPPED_DIRECTORIES))


def line_count(content: Column) -> Column:
    """Lines as a reader counts them: a last line without a break counts."""
    breaks = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    return breaks + F.when((content != "") & ~F.endswith(content, F.lit("\n")), 1).otherwise(0)


def file_stats(files: DataFrame) -> DataFrame:
    """extension, files, lines of the selected files."""
    return selected(files).groupBy(extension(F.col("path")).alias("extension")).agg(F.count("*").alias("files"), F.sum(line_count(F.coalesce("content", F.lit("")))).alias("lines"))


def tech_stack(files: DataFrame) -> DataFrame:
    """One row: languages, frameworks (substring of any content), manifests, total_files, total_lines (line breaks)."""
    inside = files.where(~below(F.col("path"), SKIPPED_DIRECTORIES))
    ext, content = extension(F.col("path")), F.lower(F.coalesce("content", F.lit("")))
    read = ext.isin(EXTENSIONS)
    language = F.lit(None).cast("string")
    for e, name in LANGUAGES.items():
        language = F.when(ext == e, name).otherwise(language)
    flags = [F.bool_or(read & F.contains(content, F.lit(w))).alias(f"f_{name}") for name, w in FRAMEWORKS.items()]
    one = inside.agg(F.array_sort(F.collect_set(language)).alias("languages"), F.array_sort(F.collect_set(F.when(basename(F.col("path")).isin(MANIFESTS), basename(F.col("path"))))).alias("manifests"), F.count_if(read).alias("total_files"), F.sum(F.when(read, F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))).otherwise(0)).alias("total_lines"), *flags)
    return one.select("languages", F.array_compact(F.array(*[F.when(F.col(f"f_{n}"), F.lit(n)) for n in FRAMEWORKS])).alias("frameworks"), "manifests", "total_files", "total_lines")


def _matches(content: Column, regex: str) -> Column:
    """Array of (line, text) of all matches: what precedes match i is the first i+1 parts of a split and the first i matches."""
    pattern = "(?i)" + regex
    parts, found = F.split(content, pattern, -1), F.regexp_extract_all(content, F.lit(pattern), F.lit(0))

    def at(i: Column) -> Column:
        before = F.concat(F.array_join(F.slice(parts, F.lit(1), i + 1), ""), F.array_join(F.slice(found, F.lit(1), i), ""))
        return F.struct((F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int").alias("line"), F.get(found, i).alias("text"))

    return F.transform(F.sequence(F.lit(0), F.size(found) - 1), at)


def around(content: Column, line: Column, margin: int = 5) -> Column:
    """The lines from `margin` before to `margin` after a line."""
    first = F.greatest(F.lit(1), line - margin)
    return F.array_join(F.slice(F.split(content, "\n"), first, line + margin - first + 1), "\n")


def marked_lines(content: Column, line: Column, end_line: Column, margin: int = 5) -> Column:
    """Numbered lines around a place, those of the place marked; empty if the line is unknown."""
    last = F.when(F.coalesce(end_line, F.lit(0)) > 0, end_line).otherwise(line)
    lines, first = F.split(F.regexp_replace(content, r"\n$", ""), "\n"), F.greatest(F.lit(0), line - margin - 1)
    shown = F.slice(lines, first + 1, F.greatest(F.lit(0), F.least(F.size(lines), last + margin) - first))
    text = F.array_join(F.transform(shown, lambda x, i: F.format_string("%s %4d | %s", F.when((i + first + 1).between(line, last), ">>>").otherwise("   "), (i + first + 1).cast("int"), F.rtrim(x))), "\n")
    return F.when((line > 0) & F.coalesce(content != "", F.lit(False)), text).otherwise("")


def _rule_hits(files: DataFrame, rule: Rule) -> DataFrame:
    path, content = F.col("path"), F.col("content")
    fits = F.lit(False)
    for e in rule.extensions:
        fits = fits | F.endswith(path, F.lit(e))
    some = files.where(fits & F.regexp_like(content, F.lit("(?i)" + rule.regex)))
    if rule.absent:
        # Words are compared as they stand with lower-cased content, so mixed-case ones never occur.
        some = some.where(~contains_any(F.lower(content), list(rule.absent)) & contains_any(F.lower(path), list(rule.context)))
    hits = some.select("path", "content", F.explode(_matches(content, rule.regex)).alias("m")).select("path", F.col("m.line").alias("line"), F.col("m.text").alias("match"), around(content, F.col("m.line")).alias("context"))
    return hits.where(contains_any(F.lower("context"), list(rule.context))).select(F.lit(rule.id).alias("rule_id"), "path", "line", "match", "context")


def pattern_hits(files: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """rule_id, path, line, match, context of every match of a rule whose context (5 lines on either side) holds one of its words.

    One filter for all rules over the files is pushed before the single rules; contents over MOST_CHARS characters are left out by rule.
    """
    inside = files.where((F.length("content") <= MOST_CHARS) & ~below(F.col("path"), PATTERN_SKIPPED))
    out = None
    for r in rules:
        part = _rule_hits(inside, r)
        out = part if out is None else out.unionByName(part)
    return out


def last_parts(path: Column, n: int = 4) -> Column:
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.array_join(F.when(F.size(parts) >= n, F.slice(parts, -n, n)).otherwise(parts), "/")


def pattern_findings(files: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """One finding for each rule and file (last four parts of the path): the first match by path, line and text."""
    first = pattern_hits(files, rules).groupBy("rule_id", last_parts(F.col("path")).alias("tail")).agg(F.min(F.struct("path", "line", "match", "context")).alias("m"))
    pick = {k: F.lit(None).cast("string") for k in ("title", "severity", "cwe", "owasp")}
    for r in rules:
        for k in pick:
            pick[k] = F.when(F.col("rule_id") == r.id, getattr(r, k)).otherwise(pick[k])
    return first.select("rule_id", pick["title"].alias("title"), pick["severity"].alias("severity"), F.lit("semgrep").alias("source"), F.col("m.path").alias("file_path"), F.col("m.line").alias("line_number"), F.col("m.match").alias("match"), F.col("m.context").alias("code_snippet"), pick["cwe"].alias("cwe_id"), pick["owasp"].alias("owasp_category"), F.lit(0.95).alias("confidence"))


def file_hashes(files: DataFrame) -> DataFrame:
    """rel_path, sha256 of the content; empty where it is null."""
    return files.select(F.col("path").alias("rel_path"), F.coalesce(F.sha2("content", 256), F.lit("")).alias("sha256"))


def priority(path: Column) -> tuple[Column, Column]:
    return F.when(basename(path).isin(PRIORITY_FILES), 0).otherwise(1), F.when(contains_any(F.lower(path), SECURITY_WORDS), 1).otherwise(2)


def prioritised(files: DataFrame) -> DataFrame:
    """files with priority, security and size, the keys of the order in which a bounded context takes them."""
    p, s = priority(F.col("path"))
    return selected(files).withColumns({"priority": p, "security": s, "size": F.octet_length("content")})


def within_budget(files: DataFrame, most: int = 200_000, least_rest: int = 500) -> DataFrame:
    """path, content of the files that fit a budget of characters, in order of priority; the one that overflows is cut if enough is left.

    Only the paths and lengths of files with text are ordered, up to the budget: each has a character at least, so a limit by the budget
    bounds the window. Files without text come first in their class (priority, security) and start where the classes before it end.
    """
    order = ["priority", "security", "size", "path"]
    sized = prioritised(files).select(*order, F.length(F.coalesce("content", F.lit(""))).alias("n"))
    short = sized.where("n > 0").orderBy(*order).limit(most + 1)
    before = short.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rest = F.lit(most) - F.col("before")
    empty, classes = sized.where("n = 0"), short.groupBy("priority", "security").agg(F.sum("n").alias("m"))
    earlier = F.expr("c.priority < e.priority or c.priority = e.priority and c.security < e.security")
    starts = empty.select("priority", "security").distinct().alias("e").join(classes.alias("c"), earlier, "left").groupBy("e.priority", "e.security").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("before"))
    before = before.unionByName(empty.join(starts, ["priority", "security"]))
    kept = before.where((F.col("before") + F.col("n") <= most) | (rest > least_rest)).where(F.col("before") < most)
    return files.join(kept.select("path", *order[:3], rest.alias("rest"), "n"), "path").select(*order, F.when(F.col("n") > F.col("rest"), F.concat(F.substr("content", F.lit(1), F.col("rest").cast("int")), F.lit("\n... [TRUNCATED]"))).otherwise(F.col("content")).alias("content"))


def config_files(files: DataFrame, most_each: int = 4_000, most: int = 20_000) -> DataFrame:
    """path, content (cut) of configuration files until the running total reaches `most`, in order of path."""
    name, parts = basename(F.col("path")), parts_of(F.col("path"))
    in_dir = F.coalesce(F.lower(F.get(F.reverse(parts), F.lit(1))).isin(CONFIG_DIRECTORIES), F.lit(False)) & F.endswith(name, F.lit(".py"))
    some = files.where((name.isin(CONFIG_NAMES) | F.lower(name).isin(CONFIG_NAMES) | in_dir) & ~below(F.col("path"), SKIPPED_DIRECTORIES) & (F.trim("content") != ""))
    cut_ = some.select("path", F.substring("content", 1, most_each).alias("content")).orderBy("path").limit(most)
    running = F.coalesce(F.sum(F.length("content")).over(W.orderBy("path").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return cut_.withColumn("before", running).where(F.col("before") < most).drop("before")
