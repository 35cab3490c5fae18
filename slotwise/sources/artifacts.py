"""Versioned JSON documents, candidate files and bounded samples: small inputs that the driver reads."""

from __future__ import annotations

import codecs
import gzip
import json
from dataclasses import dataclass
from pathlib import Path

#: Bounds of samples and candidate files.
SAMPLE_FILES, SAMPLE_LINES, LINE_CHARS, SAMPLE_BYTES = 64, 512, 4096, 1 << 20
CANDIDATE_BYTES, CANDIDATE_DEPTH, CANDIDATE_NODES = 64 << 10, 24, 4096


class ArtifactError(ValueError):
    """``kind`` is missing, unreadable, invalid_json, invalid_root, missing_schema, unsupported_schema or invalid_shape."""

    def __init__(self, kind: str, message: str):
        super().__init__(f"{kind}: {message}")
        self.kind = kind


def read_artifact(path: str | Path, versions: tuple[int, ...]) -> dict:
    """A JSON object whose ``schema_version`` is one of ``versions`` (a true integer)."""
    path = Path(path)
    if not path.exists():
        raise ArtifactError("missing", str(path))
    try:
        data = json.loads(path.read_text(encoding="utf-8"))
    except (OSError, UnicodeDecodeError) as e:
        raise ArtifactError("unreadable", f"{path}: {e}") from e
    except json.JSONDecodeError as e:
        raise ArtifactError("invalid_json", f"{path}: {e}") from e
    if not isinstance(data, dict):
        raise ArtifactError("invalid_root", f"{path}: not an object")
    if "schema_version" not in data:
        raise ArtifactError("missing_schema", str(path))
    if type(data["schema_version"]) is not int or data["schema_version"] not in versions:
        raise ArtifactError("unsupported_schema", f"{path}: {data['schema_version']!r}")
    return data


def checked_shape(data: dict, shape: dict, where: str = "$") -> dict:
    """``data`` if it has the fields of ``shape`` with just their types: booleans are no integers, nothing is converted."""
    for name, kind in shape.items():
        if name not in data:
            raise ArtifactError("invalid_shape", f"{where}.{name} is missing")
        value = data[name]
        if isinstance(kind, dict):
            if type(value) is not dict:
                raise ArtifactError("invalid_shape", f"{where}.{name} is no object")
            checked_shape(value, kind, f"{where}.{name}")
        elif isinstance(kind, list):
            if type(value) is not list:
                raise ArtifactError("invalid_shape", f"{where}.{name} is no list")
            for i, item in enumerate(value):
                if isinstance(kind[0], dict):
                    checked_shape(item if type(item) is dict else {}, kind[0], f"{where}.{name}[{i}]")
                elif type(item) is not kind[0]:
                    raise ArtifactError("invalid_shape", f"{where}.{name}[{i}]")
        elif type(value) not in (kind if isinstance(kind, tuple) else (kind,)):
            raise ArtifactError("invalid_shape", f"{where}.{name}: {type(value).__name__}")
    return data


def read_candidate(text: bytes) -> dict:
    """An onboarding candidate: small, shallow, without repeated keys, NaN or infinities."""
    if len(text) > CANDIDATE_BYTES:
        raise ArtifactError("invalid_shape", f"over {CANDIDATE_BYTES} bytes")

    def pairs(items):
        if len({k for k, _ in items}) < len(items):
            raise ArtifactError("invalid_shape", "repeated keys")
        return dict(items)

    def constant(name):
        raise ArtifactError("invalid_shape", f"{name} is no number here")

    try:
        data = json.loads(text.decode("utf-8"), object_pairs_hook=pairs, parse_constant=constant)
    except (UnicodeDecodeError, json.JSONDecodeError, RecursionError) as e:
        raise ArtifactError("invalid_json", str(e)) from e
    nodes, level = 0, [(data, 1)]
    while level:
        node, depth = level.pop()
        nodes += 1
        if depth > CANDIDATE_DEPTH or nodes > CANDIDATE_NODES:
            raise ArtifactError("invalid_shape", "too deep or too large")
        level += [(v, depth + 1) for v in (node.values() if isinstance(node, dict) else node if isinstance(node, list) else ())]
    if not isinstance(data, dict):
        raise ArtifactError("invalid_root", "not an object")
    return data


@dataclass
class Sample:
    name: str
    lines: list[str]
    replaced: int  # U+FFFD
    nul: int
    cut: bool

    @property
    def nonempty(self) -> list[str]:
        return [line for line in self.lines if line.strip()]


def text_codec(name: str) -> str:
    """The codec's own name; codecs that don't decode bytes to text are refused."""
    info = codecs.lookup(name)
    if not info._is_text_encoding:
        raise ValueError(f"{name} is no text encoding")
    return info.name


def read_samples(paths: list[str], encoding: str = "utf-8") -> list[Sample]:
    """The first lines of up to SAMPLE_FILES files under one byte budget, shared out fairly: each may use what is left per file left."""
    if len(paths) > SAMPLE_FILES:
        raise ValueError(f"more than {SAMPLE_FILES} samples")
    codec, left, out = text_codec(encoding), SAMPLE_BYTES, []
    for i, path in enumerate(paths):
        allowed, lines, cut = left // (len(paths) - i), [], False
        opened = gzip.open(path, "rb") if str(path).endswith(".gz") else open(path, "rb")
        with opened as f:
            data = f.read(allowed + 1)
        cut = len(data) > allowed
        data = data[:allowed]
        left -= len(data)
        for line in data.decode(codec, errors="replace").splitlines():
            if len(lines) == SAMPLE_LINES:
                cut = True
                break
            cut |= len(line) > LINE_CHARS
            lines.append(line[:LINE_CHARS])
        text = "\n".join(lines)
        out.append(Sample(Path(path).name, lines, text.count("�"), text.count("\0"), cut))
    return out
