"""Command line: ``python -m lorekiln COMMAND ROOT [PATH]`` over a folder of tables.

stats ROOT; snapshot ROOT PATH writes one JSON document per concept; import ROOT PATH reads snapshot files; backup ROOT;
restore ROOT PATH writes the records of the chunk store as Parquet; restore-concepts ROOT takes them over into the concepts and rebuilds the
index; merge and rebase ROOT LOCAL REMOTE PATH work on files of records; sync ROOT PATH pulls markdown entries (JSON lines) and writes the
entries to push under PATH/push; tombstone ROOT PATH writes delete markers; embed ROOT TEXT prints a vector. Settings: see ``lorekiln.config``.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from lorekiln.api import Memory
from lorekiln.sources.records import write_snapshot


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lorekiln", description=__doc__)
    p.add_argument("command", choices=("stats", "snapshot", "import", "backup", "restore", "restore-concepts", "merge", "rebase", "sync", "tombstone", "embed"))
    p.add_argument("root")
    p.add_argument("path", nargs="*")
    p.add_argument("--prefer", choices=("local", "onchain"))
    p.add_argument("--policy", default="updatedAt")
    p.add_argument("--base", type=int)
    p.add_argument("--observed", type=int)
    p.add_argument("--namespace")
    a = p.parse_args(args)
    wanted = {"snapshot": 1, "import": 1, "restore": 1, "sync": 1, "tombstone": 1, "embed": 1, "merge": 3, "rebase": 3}.get(a.command, 0)
    if len(a.path) != wanted:
        p.error(f"{a.command} needs {wanted} arguments after ROOT")
    spark = SparkSession.builder.appName("lorekiln").getOrCreate()
    memory, now = Memory(spark, a.root), int(time.time() * 1000)
    if a.command == "stats":
        memory.stats(by_namespace=True).show(1000, truncate=False)
    elif a.command == "snapshot":
        write_snapshot(memory.concepts, a.path[0], namespace=a.namespace)
    elif a.command == "import":
        files = spark.read.option("wholetext", True).text(a.path[0])
        memory.import_snapshot(files, "value", now).show()
    elif a.command == "backup":
        memory.backup(now)
    elif a.command == "restore-concepts":
        counts, errors = memory.restore_concepts(now)
        counts.show()
        if errors.limit(1).count():
            errors.show(100, truncate=False)
            return 5
    elif a.command == "merge":
        memory.merge_files(*a.path, policy=a.policy, prefer=a.prefer).show()
    elif a.command == "rebase":
        memory.rebase_files(*a.path, now, a.base, a.observed, prefer=a.prefer).show()
    elif a.command == "sync":
        memory.pull(spark.read.json(a.path[0]), now)
        memory.push().write.json(f"{a.path[0]}/push/{now}")
    elif a.command == "tombstone":
        memory.tombstones().write.json(a.path[0])
    elif a.command == "embed":
        text = spark.createDataFrame([(a.path[0],)], "text string")
        print(list(memory.embed_text(text, "text").first().embedding))
    else:
        rows, errors = memory.restore()
        rows.write.parquet(a.path[0])
        if errors.limit(1).count():
            errors.show(100, truncate=False)
            return 5
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
