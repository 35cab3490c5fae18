"""Onboarding of new log formats: what do samples look like, does a candidate fit them, and a draft of its configuration."""

from __future__ import annotations

import json
import re
import subprocess
import sys
from re import _constants as ops
from re import _parser as parser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.functions import text, times
from slotwise.functions.patterns import matches_any, portable
from slotwise.operators.aggregates import best_by_count
from slotwise.sources.artifacts import Sample

#: Forms of times, names of fields and forms of sequences that samples are searched for.
TIME_FORMS = {
    "iso8601": r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?)(Z|[+-]\d{2}:?\d{2})?",
    "compact_iso8601": r"(\d{8}T\d{6}(?:[.,]\d+)?)(Z|[+-]\d{2}:?\d{2})?",
    "slash_datetime": r"(\d{4}/\d{2}/\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?)()",
    "syslog_without_year": r"((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})()",
}
FIELDS = {
    "Slot": ("Slot", "slot", "slotId", "slot_id"), "CPU_Id": ("CPU-Id", "CPU_Id", "cpuId", "cpu_id", "cpu"),
    "ProcessName": ("ProcessName", "process_name", "process", "proc"), "Context": ("Context", "context", "message", "msg", "ctx"),
}
SEQUENCES = {"no_brackets": r"No\[(\d+)\]", "sequence_label": r"(?i)(?:sequence|seq)\s*[=:]\s*(\d+)"}
REQUIRED = ("Slot", "CPU_Id", "ProcessName", "Context")
#: Limits of safe patterns, and the sandbox's time.
LONGEST, DEEPEST, MOST_REPEATS, MOST_GROUPS, SECONDS = 4096, 64, 16, 64, 5


def sample_table(spark: SparkSession, samples: list[Sample]) -> DataFrame:
    """(file_ord, name, line_no, line) of bounded samples."""
    rows = [(i, s.name, n, line) for i, s in enumerate(samples) for n, line in enumerate(s.lines)]
    return spark.createDataFrame(rows, "file_ord int, name string, line_no long, line string")


def analyze(lines: DataFrame) -> dict[str, DataFrame]:
    """Coverage of time forms, field names and sequence forms over non-empty lines, families of files, and name shapes."""
    rows = lines.filter(text.stripped(F.col("line")) != "")
    t = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(k).alias("key"), F.col("line").rlike(portable(p).java).alias("hit"), times.first_stamp(F.regexp_replace("line", ",(?=\\d)", "."), portable(p)).isNotNull().alias("parsed")) for i, (k, p) in enumerate(TIME_FORMS.items())]))
    by_file = rows.select("file_ord", "name", t.alias("t")).groupBy("file_ord", "name", "t.ord", "t.key").agg(F.count(F.lit(1)).alias("lines"), F.count_if("t.hit").alias("matched"), F.count_if("t.parsed").alias("parseable"))
    stamps = by_file.groupBy("ord", "key").agg(F.sum("lines").alias("eligible"), F.sum("matched").alias("matched"), F.sum("parseable").alias("parseable"), F.sort_array(F.collect_set(F.when(F.col("matched") > 0, F.col("file_ord")))).alias("files"))
    stamps = stamps.withColumn("coverage", F.bround(F.col("matched") / F.col("eligible"), 6)).filter("matched > 0")
    found = [F.struct(F.lit(f).alias("field"), F.lit(i).alias("ord"), F.lit(a).alias("alias"), text.has_field(F.col("line"), a).alias("hit")) for f, aliases in FIELDS.items() for i, a in enumerate(aliases)]
    named = rows.select("file_ord", F.explode(F.array(*found)).alias("f")).filter("f.hit").groupBy("file_ord", "f.field", "f.ord", "f.alias").agg(F.count(F.lit(1)).alias("n"))
    fields = named.groupBy("field", "ord", "alias").agg(F.sum("n").alias("n"))
    sequences = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col("line").rlike(portable(p).java).alias("hit")) for k, p in SEQUENCES.items()])).alias("s")).filter("s.hit").groupBy("s.key").agg(F.count(F.lit(1)).alias("n"))
    dominant = best_by_count(by_file.filter("matched > 0"), ["file_ord", "name"], "key", "matched", "ord")
    aliases = best_by_count(named, ["file_ord", "field"], "alias", "n", "ord").groupBy("file_ord").agg(F.sort_array(F.collect_list(F.struct("field", "alias"))).alias("aliases"))
    families = dominant.join(aliases, "file_ord", "left").groupBy("key", "aliases").agg(F.sort_array(F.collect_list("name")).alias("files"), F.min("file_ord").alias("file_ord"))
    shapes = lines.select("name").distinct().groupBy(text.name_shape(F.col("name")).alias("shape")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return {"timestamps": stamps, "fields": fields, "best_fields": best_by_count(fields, ["field"], "alias", "n", "ord"), "sequences": sequences, "families": families, "shapes": shapes}


def evaluate(lines: DataFrame, candidate: dict) -> DataFrame:
    """One row of counters of a candidate over sample lines: eligible, record matches, times, groups and sequences."""
    p, t = portable(candidate["diag_pattern"]), portable(candidate["timestamp_regex"])
    line = F.col("line")
    rows = lines.filter(matches_any(F.col("name"), candidate["file_patterns"]) & (text.stripped(line) != "") & line.contains(candidate["module_name"].upper()))
    hit = p.found(line)
    groups = [F.count_if(hit & (text.stripped(p.group(line, g)) != "")).alias(f"group_{g}") for g in REQUIRED]
    wide = F.regexp_extract_all(line, F.lit(t.java), F.lit(0))
    s = portable(candidate["sequence_pattern"]) if candidate.get("sequence_pattern") else None
    ordinals = [F.count_if(hit & s.found(line)).alias("ordinal_matches"), F.count_if(hit & s.group(line, 1).try_cast("int").isNotNull()).alias("ordinal_integers")] if s else [F.lit(0).alias("ordinal_matches"), F.lit(0).alias("ordinal_integers")]
    return rows.agg(
        F.count(F.lit(1)).alias("eligible"), F.count_if(hit).alias("record_matches"), F.count_if(hit & times.first_stamp(line, t).isNotNull()).alias("timestamp_parseable"),
        F.coalesce(F.sum(F.when(hit, F.size(wide) - F.size(times.extracted(line, t)))), F.lit(0)).alias("timestamp_runtime_errors"), *groups, *ordinals,
    )


def validate(lines: DataFrame, candidate: dict) -> dict:
    """Status ready, incomplete or invalid, the counters, and what is missing."""
    errors = file_pattern_errors(candidate.get("file_patterns")) + [e for f, n in (("timestamp_regex", 1), ("diag_pattern", 4)) for e in pattern_errors(candidate.get(f), f, n)]
    names = re.compile(candidate["diag_pattern"]).groupindex if not any(e.startswith("diag_pattern") for e in errors) else {}
    errors += ["diag_pattern.missing_named_groups"] if names is not None and set(REQUIRED) - set(names) and not any(e.startswith("diag_pattern") for e in errors) else []
    if candidate.get("sequence_pattern"):
        errors += pattern_errors(candidate["sequence_pattern"], "sequence_pattern", 1)
    if errors:
        return {"status": "invalid", "errors": errors, "counters": {}}
    c = evaluate(lines, candidate).first().asDict()
    missing = [k for k in ("eligible", "record_matches", "timestamp_parseable", *(f"group_{g}" for g in REQUIRED if g != "CPU_Id")) if not c[k]]
    missing += ["timestamp_runtime_errors"] if c["timestamp_runtime_errors"] else []
    return {"status": "incomplete" if missing else "ready", "errors": missing, "counters": c}


def build_draft(candidate: dict, key: str = "module1") -> dict:
    """A configuration fragment of a candidate; it is a draft, so never marked as ready to use."""
    config = {"module_name": candidate["module_name"], "diag_pattern": candidate["diag_pattern"], "sequence_pattern": candidate.get("sequence_pattern") or r"(?!)"}
    return {"final_config_ready": False, "fragment": {"discovery": {"diagnostic_globs": candidate["file_patterns"]}, "parser": {"timestamp_regex": candidate["timestamp_regex"]}, "mechanisms": {key: {"kind": "lifecycle", "config": config}}}}


def file_pattern_errors(globs) -> list[str]:
    if not globs:
        return ["file_patterns.empty"]
    out, seen = ["file_patterns.too_many"] if len(globs) > 128 else [], set()
    for g in globs:
        if not isinstance(g, str):
            out.append("file_patterns.invalid_type")
        elif g.casefold() in seen:
            out.append("file_patterns.duplicate")
        elif not g or len(g) > 255 or "/" in g or "\\" in g or not g.replace("*", "").replace("?", "").strip("._- "):
            out.append("file_patterns.invalid")
        else:
            seen.add(g.casefold())
    return list(dict.fromkeys(out))


# -- safe patterns ----------------------------------------------------------------------------------

_REPEATS = {ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT}


def _walk(tree, depth: int = 0):
    """(operation, argument, depth of unbounded repeats around, is the first of the pattern) in order."""
    for i, (op, arg) in enumerate(tree):
        yield op, arg, depth, i
        if op in _REPEATS:
            yield from _walk(arg[2], depth + (arg[1] is ops.MAXREPEAT or arg[1] > 64))
        elif op is ops.SUBPATTERN:
            yield from _walk(arg[3], depth)
        elif op is ops.BRANCH:
            for t in arg[1]:
                yield from _walk(t, depth)
        elif op is ops.ATOMIC_GROUP:
            yield from _walk(arg, depth)


def pattern_errors(pattern, label: str, groups: int = 0) -> list[str]:
    """Why a pattern from outside must not be run: it could take very long, or has not the groups that are needed.

    Refused are long, deep or empty patterns, back-references, look-arounds, zero width, nested or
    adjacent unbounded repeats, an unanchored leading one, many repeats, and more than one of any character.
    """
    if not isinstance(pattern, str) or not pattern:
        return [f"{label}.{'empty' if pattern == '' else 'invalid_type'}"]
    if len(pattern) > LONGEST:
        return [f"{label}.unsafe_too_long"]
    nesting = deepest = 0
    for c in re.sub(r"\\.|\[[^\]]*\]", "", pattern):
        nesting += (c == "(") - (c == ")")
        deepest = max(deepest, nesting)
    if deepest > DEEPEST:
        return [f"{label}.unsafe_too_deep"]
    try:
        tree = parser.parse(pattern)
    except (re.error, RecursionError, OverflowError):
        return [f"{label}.invalid"]
    nodes = list(_walk(tree))
    unbounded = [(arg, depth) for op, arg, depth, _ in nodes if op in _REPEATS and arg[1] is ops.MAXREPEAT]
    anything = [a for a, _ in unbounded if any(op is ops.ANY for op, _ in a[2])]
    if any(op in (ops.GROUPREF, ops.GROUPREF_EXISTS) for op, *_ in nodes):
        reason = "backreference"
    elif any(op in (ops.ASSERT, ops.ASSERT_NOT) for op, *_ in nodes):
        reason = "assertion"
    elif tree.getwidth()[0] == 0:
        reason = "zero_width"
    elif any(depth for _, depth in unbounded):
        reason = "risky_repetition"
    elif sum(op in _REPEATS for op, *_ in nodes) > MOST_REPEATS or len(anything) > 1:
        reason = "ambiguous_repeat_layout"
    elif _neighbours(tree) or (tree and tree[0][0] in _REPEATS and tree[0][1][1] is ops.MAXREPEAT):
        reason = "ambiguous_repeat_layout"
    else:
        reason = None
    if reason:
        return [f"{label}.unsafe_{reason}"]
    have = tree.state.groups - 1
    if have > MOST_GROUPS:
        return [f"{label}.too_many_capture_groups"]
    return [f"{label}.missing_capture_groups"] if have < groups else []


def _neighbours(tree) -> bool:
    """Whether two unbounded repeats stand side by side."""
    flat = [op in _REPEATS and arg[1] is ops.MAXREPEAT for op, arg in tree]
    return any(a and b for a, b in zip(flat, flat[1:]))


_WORKER = """
import json, re, sys
plan = json.load(sys.stdin)
p = re.compile(plan["pattern"])
out = {"matches": 0, "groups": {}}
for line in plan["lines"]:
    m = p.search(line)
    if m:
        out["matches"] += 1
        for k, v in m.groupdict().items():
            out["groups"][k] = out["groups"].get(k, 0) + bool(v and v.strip())
json.dump(out, sys.stdout)
"""


def sandboxed(pattern: str, lines: list[str], seconds: float = SECONDS) -> dict:
    """Counts of a pattern over sample lines in a process of its own, which ends after ``seconds``; only counts come back."""
    if errors := pattern_errors(pattern, "pattern"):
        return {"status": "refused", "errors": errors}
    try:
        done = subprocess.run([sys.executable, "-I", "-c", _WORKER], input=json.dumps({"pattern": pattern, "lines": lines}), capture_output=True, text=True, timeout=seconds)
    except subprocess.TimeoutExpired:
        return {"status": "timeout"}
    return {"status": "ok", **json.loads(done.stdout)} if done.returncode == 0 else {"status": "failed"}


def explain_line(spark: SparkSession, line: str, config) -> DataFrame:
    """One row that tells how the filters and patterns of a module take a line."""
    from slotwise.operators.extract import journal_match, sequence_of

    one = spark.createDataFrame([(line,)], "line string")
    p, c = portable(config.diag_pattern), F.col("line")
    return one.select(
        c.contains(config.module_name.upper()).alias("has_module_name"), p.found(c).alias("diag_pattern_fits"), *[p.group(c, g).alias(g) for g in REQUIRED if g in p.names],
        sequence_of(c, portable(config.sequence_pattern)).alias("sequence"), times.iso(times.first_stamp(c, portable(config.timestamp_regex))["ts_local"]).alias("timestamp"),
        F.lower(c).contains(config.identifying_keyword.lower()).alias("has_keyword"), journal_match(c, config)["pattern"].alias("journal_pattern") if config.line_pattern or config.line_pattern2 else F.lit(None).cast("string").alias("journal_pattern"),
    )
