"""Per-stage durations from a Spark event log (plain or zstd-compressed, rolling or single file).

usage: python scripts/stage_times.py <event log dir or file> [min_ms]

Prints one line per completed stage in submission order: id, task count, duration, start
offset, and the operators of the stage, so a single-task scan or a slow shuffle stands out.
"""
from __future__ import annotations

import glob
import io
import json
import os
import sys


def _lines(path: str):
    raw = open(path, "rb").read()
    if path.endswith(".zstd"):
        import zstandard
        raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read()
    return raw.decode().splitlines()


def _files(root: str) -> list[str]:
    if os.path.isfile(root):
        return [root]
    found = glob.glob(os.path.join(root, "**", "*"), recursive=True)
    return sorted(f for f in found if os.path.isfile(f) and
                  (os.path.basename(f).startswith(("events_", "local-", "app-"))))


def main() -> None:
    root = sys.argv[1]
    min_ms = int(sys.argv[2]) if len(sys.argv) > 2 else 0
    stages = []
    for f in _files(root):
        for line in _lines(f):
            e = json.loads(line)
            if e.get("Event") != "SparkListenerStageCompleted":
                continue
            si = e["Stage Info"]
            if "Completion Time" not in si:
                continue
            ops = []
            for r in si.get("RDD Info", []):
                name = json.loads(r["Scope"])["name"] if r.get("Scope") else r["Name"]
                if name not in ops:
                    ops.append(name)
            stages.append((si["Submission Time"], si["Stage ID"], si["Number of Tasks"],
                           si["Completion Time"] - si["Submission Time"], ops))
    stages.sort()
    base = stages[0][0] if stages else 0
    for sub, sid, tasks, dur, ops in stages:
        if dur >= min_ms:
            print(f"stage {sid:4d} tasks={tasks:4d} ms={dur:6d} at={sub - base:7d}  {', '.join(ops[:6])}")


if __name__ == "__main__":
    main()
