"""result.json, written and read a line at a time: a header a line for modules, slots and cycles, a line a process.

The document is plain JSON.  As its lines tell where cycles begin and end, nothing needs to hold it whole: the
driver reads headers only, and tasks read the processes of byte ranges.  Documents in other layouts are loaded.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from slotwise.functions import times
from slotwise.sources.artifacts import ArtifactError, read_artifact

INDEX = """module_key string, module_name string, slot string, id string, scope string, cpu_id string, parent_id string, dir_name string, start_time string, end_time string,
processes array<struct<process_name:string,pid:string,total_count:bigint,missing_sequences:array<int>>>"""
_PROCESS = pa.struct([("process_name", pa.string()), ("pid", pa.string()), ("total_count", pa.int64()), ("missing_sequences", pa.list_(pa.int32()))])
ARROW = pa.schema([(n, pa.string()) for n in ("module_key", "module_name", "slot", "id", "scope", "cpu_id", "parent_id", "dir_name", "start_time", "end_time")] + [("processes", pa.list_(_PROCESS))])
FIRST, PROCESS = b'{"schema_version":2,"mech_results":[\n', b'{"missing_sequences":'
#: Bytes of lines that go to the driver or into a task at once, and processes of an index row at most.
CHUNK_BYTES, PART_BYTES, ROW_PROCESSES = 1 << 20, 4 << 20, 1024


def compact(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), default=str)


def opened(header: dict, name: str) -> str:
    """An object's line up to the list ``name``, which the lines behind it fill."""
    return compact(header)[:-1] + f',"{name}":['


def is_lined(path: str | Path) -> bool:
    try:
        with open(path, "rb") as f:
            return f.readline(len(FIRST)) == FIRST
    except OSError:
        return False


# -- writing ----------------------------------------------------------------------------------------


def process_chunks(index: DataFrame) -> DataFrame:
    """(slot, board_id, scope, id, header, text): the processes of sorted cycles as JSON lines, many a row.

    ``index`` has a row a process: slot, id, scope, cpu_id, parent_id, dir_name, start_us, end_us, p (null: none).
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.string()) for n in ("slot", "board_id", "scope", "id", "header", "text")])
        now, lines, held = None, [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in (*now, "\n,".join(lines))], schema=schema)

        for b in batches:
            for *key, line in zip(*(c.to_pylist() for c in b.columns)):
                if now is not None and (key != now or held > CHUNK_BYTES):
                    yield row()
                    lines, held = [], 0
                now = key
                if line is not None:
                    lines.append(line)
                    held += len(line)
        if now is not None:
            yield row()

    iso = lambda c: times.iso(times.from_us(F.col(c)))
    kept = {"ignoreNullFields": "false"}
    header = F.to_json(F.struct("cpu_id", "dir_name", iso("end_us").alias("end_time"), "id", iso("start_us").alias("start_time")), kept)
    line = F.when(F.col("p").isNotNull(), F.to_json(F.struct(*[F.col(f"p.{n}").alias(n) for n in ("missing_sequences", "pid", "process_name", "total_count")]), kept))
    rows = index.withColumn("board_id", F.when(F.col("scope") == "board", F.col("id")).otherwise(F.col("parent_id")))
    boards = rows.filter("scope = 'board'").select("slot", "board_id", F.col("start_us").alias("board_us")).distinct()
    order = ["slot", "board_us", "board_id", "scope", F.when(F.col("scope") == "cpu", F.col("cpu_id")), "start_us", "header", "p.process_name", "p.pid", "p.total_count", "line"]  # 'board' goes before 'cpu'
    rows = rows.join(boards, ["slot", "board_id"]).withColumn("header", header).withColumn("line", line).orderBy(*order)
    return rows.select("slot", "board_id", "scope", "id", "header", "line").mapInArrow(packed, "slot string, board_id string, scope string, id string, header string, text string")


def cycle_lines(chunks: DataFrame) -> Iterator[str]:
    """Lines of slots, board cycles and CPU cycles from sorted chunks, which come to the driver one after another."""
    slot = board = cycle = None
    for r in chunks.toLocalIterator():
        if (r.slot, r.board_id, r.scope, r.id, r.header) == cycle:
            if r.text:
                yield "," + r.text
            continue
        if cycle is not None and cycle[2] == "cpu":
            yield "]}"
        elif cycle is not None:
            yield '],"cpu_cycles":['
        first_cpu = cycle is not None and cycle[2] == "board"
        if board is not None and (r.scope == "board" or (r.slot, r.board_id) != board):
            yield "]}"
        if r.slot != slot:
            if slot is not None:
                yield "]}"
            yield ("," if slot is not None else "") + opened({"slot_id": r.slot}, "board_cycles")
        later = first_cpu is False if r.scope == "cpu" else r.slot == slot
        slot, board, cycle = r.slot, (r.slot, r.board_id), (r.slot, r.board_id, r.scope, r.id, r.header)
        yield ("," if later else "") + r.header[:-1] + ',"processes":['
        if r.text:
            yield r.text
    if cycle is not None:
        yield "]}" if cycle[2] == "cpu" else '],"cpu_cycles":['
        yield "]}"
        yield "]}"


def write_lines(path: str | Path, modules: list[tuple[dict, Iterator[str]]]) -> None:
    """The document of modules, each a header and the lines of its slots."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    with open(part, "w", encoding="utf-8", newline="") as f:
        f.write(FIRST.decode())
        for i, (header, lines) in enumerate(modules):
            f.write(("," if i else "") + opened(header, "slots") + "\n")
            f.writelines(line + "\n" for line in lines)
            f.write("]}\n")
        f.write("]}\n")
    os.replace(part, path)


# -- reading ----------------------------------------------------------------------------------------


def scan(path: str | Path, strict: bool = False) -> Iterator[tuple[str, dict, int, int]]:
    """(kind, header, from, to) of modules, slots, board and CPU cycles; processes of a cycle lie in its byte range.

    ``strict`` parses the processes as well.  Lines that don't fit raise an ArtifactError.
    """
    stack: list[str] = []
    header, begin, at = None, 0, 0

    def bad(why: str) -> ArtifactError:
        return ArtifactError("invalid_json", f"{path}: {why} at byte {at}")

    with open(path, "rb") as f:
        at = len(f.readline())
        stack.append("root")
        for line in f:
            here, at = at, at + len(line)
            body = line.strip().removeprefix(b",")
            top = stack[-1] if stack else None
            try:
                if body.startswith(PROCESS):
                    if top not in ("board", "cpu"):
                        raise bad("a process without a cycle")
                    if strict:
                        json.loads(body)
                elif body == b'],"cpu_cycles":[' and top == "board":
                    yield "board", header, begin, here
                    stack[-1] = "cpus"
                elif body == b"]}" and top not in ("board", None):
                    if top == "cpu":
                        yield "cpu", header, begin, here
                    stack.pop()
                elif body.endswith(b'"slots":[') and top == "root":
                    yield "module", without(json.loads(body + b"]}"), "slots"), at, at
                    stack.append("module")
                elif body.endswith(b'"board_cycles":[') and top == "module":
                    yield "slot", without(json.loads(body + b"]}"), "board_cycles"), at, at
                    stack.append("slot")
                elif body.endswith(b'"processes":[') and top in ("slot", "cpus"):
                    header, begin = without(json.loads(body + b"]}"), "processes"), at
                    stack.append("board" if top == "slot" else "cpu")
                else:
                    raise bad("an unknown line")
            except ValueError as e:
                raise e if isinstance(e, ArtifactError) else bad(str(e)) from e
    if stack:
        raise bad("no end")


def without(header: dict, name: str) -> dict:
    return {k: v for k, v in header.items() if k != name}


def processes_in(path: str | Path, begin: int, end: int) -> Iterator[dict]:
    """Processes whose lines begin in a byte range of their cycle."""
    with open(path, "rb") as f:
        f.seek(begin - 1)
        at = begin - 1 + len(f.readline())
        while at < end:
            line = f.readline()
            at += len(line)
            yield json.loads(line.strip().removeprefix(b","))


def cycles_of(path: str | Path) -> Iterator[tuple[dict, str, str, dict, str, int, int]]:
    """(module, slot, scope, header, parent_id, from, to) of each cycle."""
    module, slot, board = {}, "", ""
    for kind, header, begin, end in scan(path):
        if kind == "module":
            module = header
        elif kind == "slot":
            slot = header["slot_id"]
        else:
            board = header["id"] if kind == "board" else board
            yield module, slot, kind, header, "" if kind == "board" else board, begin, end


@dataclass(frozen=True)
class _Ranges(InputPartition):
    ranges: tuple


class IndexReader(DataSourceReader):
    """Rows of INDEX; the driver reads headers, a task reads the processes of some MB."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Ranges]:
        out, ranges, held = [], [], 0
        for module, slot, scope, c, parent, begin, end in cycles_of(self.path):
            who = (module["module_key"], module["module_name"], slot, c["id"], scope, c["cpu_id"], parent, c["dir_name"], c["start_time"], c["end_time"])
            for a in range(begin, max(end, begin + 1), PART_BYTES):
                ranges.append((who, a, min(a + PART_BYTES, end)))
                held += min(PART_BYTES, end - a) + 256
                if held >= PART_BYTES:
                    out.append(_Ranges(tuple(ranges)))
                    ranges, held = [], 0
        return out + [_Ranges(tuple(ranges))]

    def read(self, part: _Ranges) -> Iterator[pa.RecordBatch]:
        def batch(who: tuple, held: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*who, held), ARROW)], schema=ARROW)

        for who, begin, end in part.ranges:
            held, some = [], False
            for p in processes_in(self.path, begin, end):
                held.append(p)
                if len(held) >= ROW_PROCESSES:
                    yield batch(who, held)
                    held, some = [], True
            if held or not some:
                yield batch(who, held)


class IndexSource(DataSource):
    """``spark.read.format("slotwise_index").load(result.json)``."""

    @classmethod
    def name(cls) -> str:
        return "slotwise_index"

    def schema(self) -> str:
        return INDEX

    def reader(self, schema) -> IndexReader:
        return IndexReader(self.options["path"])


def index_table(spark: SparkSession, path: str | Path) -> DataFrame:
    """The cycle index, see ``evidence.process_index``; a cycle of very many processes has several rows, each with some of them."""
    if is_lined(path):
        spark.dataSource.register(IndexSource)
        df = spark.read.format("slotwise_index").load(str(path))
    else:
        rows = []
        for m in read_artifact(path, (2,))["mech_results"]:
            for s in m["slots"]:
                for b in s["board_cycles"]:
                    for c, scope, parent in [(b, "board", ""), *((c, "cpu", b["id"]) for c in b["cpu_cycles"])]:
                        rows.append((m["module_key"], m["module_name"], s["slot_id"], c["id"], scope, c["cpu_id"], parent, c["dir_name"], c["start_time"], c["end_time"], [tuple(p[k] for k in ("process_name", "pid", "total_count", "missing_sequences")) for p in c["processes"]]))
        df = spark.createDataFrame(rows, INDEX)
    us = lambda c: times.parsed(F.col(c))["ts_us"]
    return df.withColumn("start_us", us("start_time")).withColumn("end_us", us("end_time")).drop("start_time", "end_time")
