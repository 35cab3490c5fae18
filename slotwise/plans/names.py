"""Evidence names on the driver, for single values; the columns' forms are in ``functions.text``."""

from __future__ import annotations

import hashlib
import re

from slotwise.functions.text import RESERVED


def is_safe(name: str) -> bool:
    return bool(re.fullmatch(r"[A-Za-z0-9_.-]+", name)) and not name.endswith(".") and name.split(".")[0].upper() not in RESERVED


def safe_segment(name: str | None) -> str:
    if not name:
        return "unknown"
    if is_safe(name):
        return name
    coded = "".join(c if re.match(r"[A-Za-z0-9_.-]", c) else f"~U{ord(c):08x}" for c in name)
    return f"{coded}~H{hashlib.sha256(name.encode()).hexdigest()[:16]}"


def log_file_name(process: str, pid: str) -> str:
    if process and is_safe(process) and (not pid or is_safe(pid)):
        return f"{process}-{pid}.log" if pid else f"{process}.log"
    return f"{safe_segment(process)}~P{safe_segment(pid)}.log" if pid else f"{safe_segment(process)}.log"
