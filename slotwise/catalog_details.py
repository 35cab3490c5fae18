"""More registered queries: scalar functions, single joins and small aggregations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotwise.catalog import _CYCLES, MATCHES, event_cycles, event_entries, event_points, event_upstream, query
from slotwise.functions import text, times
from slotwise.functions.patterns import matches_any, portable
from slotwise.operators import aggregates, correlate, entries, intervals, lifecycle
from slotwise.plans import evidence, target
from slotwise.storage import cut


def count(df, *by):
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


# -- names and times --------------------------------------------------------------------------------


@query("c10_process_split_dash", "SELECT process_name AS process, pid, count(*) AS n FROM e GROUP BY ALL")
def c10(spark, d):
    p = text.dashed_process(F.concat("process_name", F.lit("-"), "pid"))
    return count(event_entries(spark, d).select(p["process"].alias("process"), p["pid"].alias("pid")), "process", "pid")


@query("c11_process_split_journal", "SELECT CASE WHEN entry_ord < 1000 THEN process_name || '-' || entry_ord // 10 ELSE process_name END AS process, CASE WHEN entry_ord < 1000 THEN '' ELSE CAST(entry_ord // 10 AS VARCHAR) END AS pid, count(*) AS n FROM e GROUP BY ALL")
def c11(spark, d):
    """Fewer than three digits are no pid."""
    p = text.dashed_process(F.concat("process_name", F.lit("-"), F.floor(F.col("entry_ord") / 10)), 3)
    return count(event_entries(spark, d).select(p["process"].alias("process"), p["pid"].alias("pid")), "process", "pid")


@query("c12_process_split_bracket", "SELECT process_name AS process, pid, count(*) AS n FROM e GROUP BY ALL")
def c12(spark, d):
    p = text.bracket_process(F.concat("process_name", F.lit("["), "pid", F.lit("]")))
    return count(event_entries(spark, d).select(p["process"].alias("process"), p["pid"].alias("pid")), "process", "pid")


@query("c13_last_path_part", "SELECT slot AS part, count(*) AS n FROM e GROUP BY ALL")
def c13(spark, d):
    return count(event_entries(spark, d).select(text.last_part(F.concat(F.lit(" 0/ "), "slot", F.lit(" / "))).alias("part")), "part")


@query("c20_anchor_match", "SELECT entry_ord FROM e WHERE process_name = 'click' AND slot = '2' AND pid = '3'")
def c20(spark, d):
    return event_entries(spark, d).filter((F.lower("process_name") == "click") & (F.col("slot") == target.normal_slot(F.lit("SLOT_2"))) & (F.col("pid") == "3")).select("entry_ord")


@query("c23_name_globs", "SELECT process_name, count(*) AS n FROM e WHERE process_name LIKE 'c%' OR process_name LIKE '_iew' GROUP BY ALL")
def c23(spark, d):
    return count(event_entries(spark, d).filter(matches_any(F.col("process_name"), ["C*", "?iew"])), "process_name")


@query("t02_zulu_times", "SELECT entry_ord, ts_us FROM e")
def t02(spark, d):
    return event_entries(spark, d).select("entry_ord", times.parsed_loose(F.concat(times.iso_us(F.col("ts_local")), F.lit("Z")))["ts_us"].alias("ts_us"))


@query("t03_filled_offsets", "SELECT entry_ord, ts_us - CASE WHEN entry_ord % 2 = 0 THEN 3600000000 ELSE -1800000000 END AS ts_us FROM e")
def t03(spark, d):
    """Even rows take +01:00 over, odd ones have -00:30 already."""
    own = times.parsed(F.concat(times.iso_us(F.col("ts_local")), F.when(F.col("entry_ord") % 2 == 0, "").otherwise("-00:30")))
    return event_entries(spark, d).select("entry_ord", times.filled(own, F.lit(3600))["ts_us"].alias("ts_us"))


@query("t04_distances", ", c AS (SELECT entry_ord, ts_us % 1000 AS t, CASE WHEN entry_ord % 3 = 0 THEN NULL ELSE 300 END AS s, CASE WHEN entry_ord % 5 = 0 THEN NULL ELSE 600 END AS u FROM e) SELECT entry_ord, CASE WHEN s IS NULL AND u IS NULL THEN NULL WHEN (s IS NULL OR t >= s) AND (u IS NULL OR t <= u) THEN 0 ELSE least(coalesce(abs(t - s), 1000000), coalesce(abs(t - u), 1000000)) END AS far, CASE WHEN s IS NULL OR u IS NULL THEN NULL ELSE greatest(s - t, t - u, 0) END AS far_closed FROM c")
def t04(spark, d):
    long = lambda v: F.lit(v).cast("long")
    rows = event_entries(spark, d).select("entry_ord", (F.col("ts_us") % 1000).alias("t"), F.when(F.col("entry_ord") % 3 != 0, long(300)).alias("s"), F.when(F.col("entry_ord") % 5 != 0, long(600)).alias("u"))
    return rows.select("entry_ord", times.distance_us(F.col("s"), F.col("u"), F.col("t")).alias("far"), times.distance_closed_us(F.col("s"), F.col("u"), F.col("t")).alias("far_closed"))


@query("t05_dump_times", "SELECT entry_ord, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS dumped FROM e")
def t05(spark, d):
    name = F.concat(F.lit("diaglog_1_"), F.date_format("ts_local", "yyyyMMddHHmmss"), F.lit(".log.zip"))
    return event_entries(spark, d).select("entry_ord", F.date_format(times.dump_time(name, portable(r".*_(\d{14})\..*")), "yyyy-MM-dd'T'HH:mm:ss").alias("dumped"))


@query("t06_correlated_dirs", "SELECT entry_ord, strftime(ts, '%Y%m%dT%H%M%S') || '-' || strftime(ts, '%Y%m%dT%H%M%S') AS dir_name FROM e")
def t06(spark, d):
    return event_entries(spark, d).select("entry_ord", times.cycle_dir(F.col("ts_local"), F.col("ts_local"), "T").alias("dir_name"))


@query("t08_midpoints", "SELECT entry_ord, ts_us + entry_ord // 2 + CASE WHEN entry_ord % 4 = 3 THEN 1 ELSE 0 END AS middle FROM e")
def t08(spark, d):
    return event_entries(spark, d).select("entry_ord", times.midpoint_us(F.col("ts_us"), F.col("ts_us") + F.col("entry_ord")).alias("middle"))


@query("l22_cycle_identity", "SELECT entry_ord, 'slot:' || slot || CASE WHEN cpu_id = '' THEN '' ELSE '/cpu:' || cpu_id END || '/interval:' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '..open' AS ref FROM e")
def l22(spark, d):
    ref = F.concat(lifecycle.scope_reference(F.col("slot"), F.col("cpu_id")), F.lit("/"), lifecycle.cycle_identity(F.col("ts_local"), F.lit(None).cast("timestamp_ntz")))
    return event_entries(spark, d).select("entry_ord", ref.alias("ref"))


@query("s22_log_file_names", "SELECT DISTINCT process_name || '-' || pid || '.log' AS name FROM e")
def s22(spark, d):
    return event_entries(spark, d).select(text.log_file_name(F.col("process_name"), F.col("pid")).alias("name")).distinct()


@query("s24_rotation_numbers", "SELECT CAST(pid AS INT) AS rotation, count(*) AS n FROM e GROUP BY ALL")
def s24(spark, d):
    name = F.when(F.col("pid") == "0", "journal.log").otherwise(F.concat(F.lit("journal.log."), "pid", F.lit(".gz")))
    return count(event_entries(spark, d).select(text.rotation(name, r"journal\.log(?:\.(\d+))?(?:\.gz)?").alias("rotation")), "rotation")


@query("s25_compressed_names", "SELECT entry_ord % 3 <> 0 AS packed, count(*) AS n FROM e GROUP BY ALL")
def s25(spark, d):
    name = F.element_at(F.array(F.lit("a.log"), F.lit("a.TGZ"), F.lit("a.tar.gz")), (F.col("entry_ord") % 3 + 1).cast("int"))
    return count(event_entries(spark, d).select(text.is_compressed(name, [".gz", ".tgz", ".zip"]).alias("packed")), "packed")


@query("s27_all_raw", "SELECT doc_id, left(regexp_replace(regexp_replace(text, '^[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ''), '[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+$', ''), 500) AS raw FROM documents")
def s27_all(spark, d):
    """All texts."""
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", text.raw_text(F.col("text")).alias("raw"))


@query("s30_single_lines", "WITH x AS (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM benchmark) SELECT item_id, CASE WHEN length(t) > 120 THEN rtrim(left(t, 119)) || '…' ELSE t END AS line FROM x")
def s30(spark, d):
    return spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", text.shortened(text.single_line(F.col("text"))).alias("line"))


@query("s34_sequence_labels", "SELECT entry_ord, CASE WHEN sequence > 0 THEN '[' || lpad(CAST(sequence AS VARCHAR), 4, '0') || ']' ELSE '[....]' END AS label FROM e")
def s34(spark, d):
    return event_entries(spark, d).select("entry_ord", text.sequence_label(F.col("sequence")).alias("label"))


@query("b01_evidence_lines", "SELECT entry_ord, CASE WHEN sequence > 0 THEN '[' || lpad(CAST(sequence AS VARCHAR), 4, '0') || ']' ELSE '[....]' END || ' [' || source || '|slot_' || slot || '/events.log] ' || process_name || ' ' || entry_ord AS line FROM e")
def b01(spark, d):
    return event_entries(spark, d).select("entry_ord", evidence.evidence_line().alias("line"))


# -- joins and cycles -------------------------------------------------------------------------------


@query("j03_first_cycle", _CYCLES + "SELECT entry_ord, min(ord) AS ord FROM pt JOIN cy ON pt.slot = cy.slot AND ts_us BETWEEN start_us AND end_us GROUP BY 1")
def j03(spark, d):
    first = intervals.first_interval(event_points(spark, d), event_cycles(spark, d), ["entry_ord"], ["slot"], "ts_us", "start_us", "end_us", ["ord"])
    return first.select("entry_ord", "hit.ord")


@query("j06_pid_elsewhere", _CYCLES + """, p AS (SELECT pt.entry_ord, pt.slot, pt.pid, ord FROM pt JOIN cy ON pt.slot = cy.slot AND ts_us BETWEEN start_us AND end_us WHERE cpu_id = ''),
w AS (SELECT DISTINCT s.slot, s.seg AS ord, s.pid FROM s JOIN cy ON s.slot = cy.slot AND s.seg = cy.ord)
SELECT DISTINCT p.entry_ord FROM p JOIN w ON p.slot = w.slot AND p.pid = w.pid AND p.ord <> w.ord""")
def j06(spark, d):
    up = event_upstream(spark, d)
    rows = event_entries(spark, d).filter("source = 'journal' and cpu_id = ''")
    placed = rows.join(correlate.time_matches(rows, up), "entry_ord")
    return correlate.pid_elsewhere(placed, up).select("entry_ord")


@query("o07_nearest_three", _CYCLES + """, o AS (SELECT pt.* FROM pt WHERE NOT EXISTS (FROM cy WHERE cy.slot = pt.slot AND pt.ts_us BETWEEN start_us AND end_us)),
r AS (SELECT entry_ord, ord, greatest(start_us - ts_us, ts_us - end_us) AS distance_us FROM o JOIN cy ON o.slot = cy.slot)
SELECT *, CAST(row_number() OVER (PARTITION BY entry_ord ORDER BY distance_us, ord) AS INTEGER) AS place FROM r QUALIFY place <= 3""")
def o07(spark, d):
    near = intervals.nearest_few(event_points(spark, d), event_cycles(spark, d), ["entry_ord"], ["slot"], "ts_us", "ord")
    return near.select("entry_ord", "ord", "distance_us", "place")


@query("j14_active_roles", "SELECT slot, slot IN ('1', '3') AS is_active FROM e GROUP BY slot")
def j14(spark, d):
    rows = event_entries(spark, d).withColumn("is_active_signal", F.col("slot").isin("1", "3") & (F.col("entry_ord") % 2 == 1))
    active = lifecycle.active_slots(rows).withColumn("is_active", F.lit(True))
    return rows.select("slot").distinct().join(active, "slot", "left").select("slot", F.coalesce("is_active", F.lit(False)).alias("is_active"))


@query("j17_log_fallback", "SELECT DISTINCT pid, CASE CAST(pid AS INT) % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'exact' WHEN 2 THEN 'ambiguous' ELSE 'missing' END AS match_status FROM e")
def j17(spark, d):
    """By pid: the log is there, is in one CPU folder, in two, or nowhere."""
    pids = event_entries(spark, d).select("pid", (F.col("pid").cast("int") % 4).alias("k")).distinct()
    path = lambda folder: F.concat(F.lit(f"m/b/{folder}"), "pid", F.lit(".log")).alias("path")
    logs = pids.filter("k = 0").select(path("")).unionByName(pids.filter("k in (1, 2)").select(path("cpu_1/"))).unionByName(pids.filter("k = 2").select(path("cpu_2/")))
    none = F.lit(None).cast("string")
    want = pids.select(F.col("pid").alias("anchor_id"), F.lit("exact").alias("match_status"), none.alias("error_code"), none.alias("module_key"), none.alias("cycle_id"), path("").alias("log_path"), F.lit("").alias("reason"), F.array().cast("array<string>").alias("caveats"))
    return target.with_logs(want, logs).select(F.col("anchor_id").alias("pid"), "match_status")


@query("l10_process_pids", "SELECT DISTINCT slot || ':' || cpu_id AS id, process_name, pid FROM e")
def l10(spark, d):
    rows = event_entries(spark, d)
    who = F.concat("slot", F.lit(":"), "cpu_id")
    return lifecycle.process_pids(rows.withColumn("lifecycle_id", who).withColumn("cpu_lifecycle_id", who))


@query("l13_missing_sequences", ", t AS (SELECT slot, process_name, pid, list_sort(list(DISTINCT sequence) FILTER (sequence > 0)) AS s FROM e GROUP BY ALL) SELECT slot, process_name, pid, CAST(coalesce(list_sum(list_filter(range(s[1], s[len(s)] + 1), lambda x: NOT list_contains(s, CAST(x AS INTEGER)))), 0) AS BIGINT) AS total FROM t")
def l13(spark, d):
    sets = event_entries(spark, d).groupBy("slot", "process_name", "pid").agg(lifecycle.missing_sequences(F.collect_set("sequence")).alias("m"))
    return sets.select("slot", "process_name", "pid", F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("l16_clamped_bounds", ", c AS (SELECT entry_ord, ts_us % 100 AS s, ts_us % 100 + entry_ord % 50 AS u, CASE WHEN entry_ord % 3 = 0 THEN NULL ELSE 40 END AS lo, CASE WHEN entry_ord % 5 = 0 THEN NULL ELSE 60 END AS hi FROM e), b AS (SELECT *, greatest(s, coalesce(lo, s)) AS a, least(u, coalesce(hi, u)) AS z FROM c) SELECT entry_ord, CASE WHEN a > z THEN 1 ELSE a END AS start_us, CASE WHEN a > z THEN 2 ELSE z END AS end_us FROM b")
def l16(spark, d):
    long = lambda v: F.lit(v).cast("long")
    rows = event_entries(spark, d).select("entry_ord", (F.col("ts_us") % 100).alias("s"))
    c = intervals.clamped(F.col("s"), F.col("s") + F.col("entry_ord") % 50, F.when(F.col("entry_ord") % 3 != 0, long(40)), F.when(F.col("entry_ord") % 5 != 0, long(60)), long(1), long(2))
    return rows.select("entry_ord", c.alias("c")).select("entry_ord", "c.start_us", "c.end_us")


@query("l18_widened_cycles")
def l18(spark, d):
    up = event_upstream(spark, d)
    matched = cut(correlate.matches(event_entries(spark, d).filter("source = 'journal'"), up))
    return correlate.correlated_cycles(cut(correlate.reassigned(matched, up)), up)


@query("l19_all_decisions", MATCHES + "SELECT status, reason, board_id, own_id, blocked, ts_us, 'slot_' || slot || '/events.log' AS source_file, process_name, pid, TRUE AS referenced FROM fin")
def l19_all(spark, d):
    """Rows about all journals; references name one entry each."""
    out = correlate.decisions(correlate.matches(event_entries(spark, d).filter("source = 'journal'"), event_upstream(spark, d)))
    return out.select("status", "reason", "board_id", "own_id", F.col("pid_fallback_blocked_by_time_cycle").alias("blocked"), "ts_us", "source_file", "process_name", "pid", (F.length("entry_ref") > 0).alias("referenced"))


@query("l21_active_slots", "SELECT DISTINCT slot FROM e WHERE process_name = 'error'")
def l21(spark, d):
    return lifecycle.active_slots(event_entries(spark, d).withColumn("is_active_signal", F.col("process_name") == "error"))


@query("w03_all_adjacent_pairs", ", t AS (SELECT entry_ord, lead(entry_ord) OVER (PARTITION BY slot ORDER BY entry_ord) AS next FROM e) SELECT entry_ord, next FROM t WHERE next IS NOT NULL")
def w03_all(spark, d):
    """All pairs of neighbours in a slot."""
    by = W.partitionBy("slot").orderBy("entry_ord")
    return event_entries(spark, d).withColumn("next", F.lead("entry_ord").over(by)).filter("next is not null").select("entry_ord", "next")


# -- aggregations and sets --------------------------------------------------------------------------


@query("g02_run_counters", "SELECT count(DISTINCT slot) AS files, count(*) AS lines, count(*) AS entries FROM e")
def g02(spark, d):
    rows = event_entries(spark, d)
    out = aggregates.run_counters(rows.select("slot").distinct(), rows, rows)
    return out.select("files", "lines", F.element_at("entries", "module1").alias("entries"))


@query("g05_module_summary", ", p AS (SELECT DISTINCT slot, pid, process_name FROM e) SELECT 'module1' AS module_key, count(DISTINCT slot) AS slots, count(*) AS processes FROM p")
def g05(spark, d):
    rows = event_entries(spark, d).withColumn("id", F.concat("slot", F.lit(":"), "pid"))
    return aggregates.module_summary(rows.select("module_key", "slot", "id").distinct(), rows.select(F.col("id").alias("cycle_id"), "process_name").distinct())


@query("g06_cycle_totals", ", p AS (SELECT pid AS cycle_id, process_name, count(*) AS total_count FROM e GROUP BY ALL) SELECT cycle_id, count(*) AS n_processes, CAST(sum(total_count) AS BIGINT) AS total_count FROM p GROUP BY 1")
def g06(spark, d):
    return aggregates.cycle_totals(event_entries(spark, d).groupBy(F.col("pid").alias("cycle_id"), "process_name").agg(F.count(F.lit(1)).alias("total_count")))


@query("g08_slowest_stages", ", t AS (SELECT process_name || slot AS name, CAST(count(*) AS DOUBLE) AS seconds FROM e GROUP BY 1) SELECT * FROM t ORDER BY seconds DESC, name LIMIT 5")
def g08(spark, d):
    stages = event_entries(spark, d).groupBy(F.concat("process_name", "slot").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("seconds")).withColumn("status", F.lit("success"))
    return aggregates.performance_summary(stages)[0].select("name", "seconds")


@query("g10_time_bounds", "SELECT slot, min(ts_us) AS start_us, max(ts_us) AS end_us FROM e GROUP BY 1")
def g10(spark, d):
    return aggregates.time_bounds(event_entries(spark, d), ["slot"])


@query("g12_unknown", "SELECT count(*) FILTER (entry_ord % 7 = 0 OR (cpu_id <> '' AND entry_ord % 3 = 0)) AS unknown FROM e")
def g12(spark, d):
    i = F.col("entry_ord")
    return aggregates.unknown_count(event_entries(spark, d).withColumn("board_id", F.when(i % 7 != 0, "b")).withColumn("own_id", F.when(i % 3 != 0, "c")))


@query("o01_whole_order", "SELECT entry_ord, slot, CAST(row_number() OVER (PARTITION BY slot ORDER BY sequence, entry_ord) AS INTEGER) AS n FROM e")
def o01_whole(spark, d):
    """Every entry with its place; without times the order goes on with the sequence."""
    rows = event_entries(spark, d).withColumn("ts_us", F.lit(None).cast("long")).withColumn("raw", F.lit(""))
    return rows.withColumn("n", F.row_number().over(W.partitionBy("slot").orderBy(*entries.total_order()))).select("entry_ord", "slot", "n")


@query("u01_union_order", "SELECT entry_ord, CAST(row_number() OVER (ORDER BY source, entry_ord) - 1 AS BIGINT) AS place FROM e")
def u01(spark, d):
    rows = event_entries(spark, d).drop("entry_ord")
    both = rows.filter("source = 'diagnostic'").unionByName(rows.filter("source = 'journal'").withColumn("file_ord", F.lit(1)))
    return entries.with_ordinals(both).select(F.col("line_no").alias("entry_ord"), F.col("entry_ord").alias("place"))


@query("u04_intersection", ", t AS (SELECT slot, process_name, pid FROM e WHERE entry_ord % 2 = 0 INTERSECT SELECT slot, process_name, pid FROM e WHERE entry_ord % 3 = 0) SELECT slot, count(*) AS n FROM t GROUP BY 1")
def u04(spark, d):
    rows = event_entries(spark, d)
    pick = lambda k: rows.filter(F.col("entry_ord") % k == 0).select("slot", "process_name", "pid")
    return count(pick(2).intersect(pick(3)), "slot")


@query("u06_difference", "SELECT slot, process_name, pid FROM e WHERE entry_ord % 2 = 0 EXCEPT SELECT slot, process_name, pid FROM e WHERE entry_ord % 3 = 0")
def u06(spark, d):
    rows = event_entries(spark, d)
    pick = lambda k: rows.filter(F.col("entry_ord") % k == 0).select("slot", "process_name", "pid").distinct()
    return pick(2).join(pick(3), ["slot", "process_name", "pid"], "left_anti")


@query("u09_ordered_distinct", "SELECT process_name, min(entry_ord) AS entry_ord FROM e GROUP BY 1")
def u09(spark, d):
    return aggregates.first_seen(event_entries(spark, d), ["process_name"], "entry_ord")
