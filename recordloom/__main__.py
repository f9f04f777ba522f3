"""Command line: python -m recordloom COMMAND STORE …"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .errors import LoomError
from .plans.sql import SqlQuery
from .sources import importers, store


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="recordloom")
    p.add_argument("command", choices=["inspect", "ids", "get", "verify", "snapshots", "query", "import", "compact", "refold", "erase", "backup", "restore", "schema", "space"])
    p.add_argument("store")
    p.add_argument("rest", nargs="*")
    p.add_argument("--attr", metavar="NAME=VALUE")
    a = p.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    try:
        if a.command in ("import", "compact", "refold", "erase", "backup"):
            with store.Store.open(spark, a.store) as s:
                if a.command == "import":
                    rows = importers.jsonl(spark, a.rest[0])
                    out = {"imported": rows.where("not skipped").count(), "skipped": rows.where("skipped").count()}
                    s.ingest(rows.where("not skipped").select("id", "attrs", "body"))
                elif a.command == "compact":
                    out = s.compact()
                elif a.command == "refold":
                    out = s.refold()
                elif a.command == "backup":
                    out = s.backup(a.rest[0])
                else:
                    out = s.erase_where(*a.attr.split("=", 1)) if a.attr else s.erase_ids(sorted(set(a.rest)))
        elif a.command == "restore":
            out = store.restore(spark, a.store, a.rest[0])
        elif a.command == "snapshots":
            out = store.retained_commits(a.store)
        else:
            s = store.open_snapshot(spark, a.store)
            if a.command == "query":
                SqlQuery(s, a.rest[0]).df.show(truncate=False)
                return 0
            if a.command == "ids":
                for r in s.ids().toLocalIterator():
                    print(r["id"])
                return 0
            if a.command == "get":
                r = s.get(a.rest[0])
                out = None if r is None else {"id": r.id, "attrs": [[n, v.encode()] for n, v in r.attrs], "contents": r.contents}
            elif a.command == "verify":
                out = s.verify()
            elif a.command == "schema":
                out = {"attributes": s.schema().attributes, "contents": s.schema().contents}
            else:
                out = {"commit": s.commit.number, "parts": len(s.commit.parts), "distribution": s.part_distribution(), "liveness": s.content_liveness()}
        print(json.dumps(out, indent=2))
        return 0
    except LoomError as e:
        print(f"{e.code}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
