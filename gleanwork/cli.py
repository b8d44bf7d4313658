"""python -m gleanwork.cli INDEX COMMAND ...: a look into a stored index.

get ID ... | find [KEY ...] | search TEXT | tree [context|directory] | count [KEY ...] | scan FOLDER (files into the index, which is saved)
"""

from __future__ import annotations

import argparse
import json

from .index import Index
from .operators import derive
from .session import attach, names_in, session
from .sources import files


def main(argv: list[str] | None = None, spark=None) -> list[str]:
    """Runs one command and returns the lines it prints."""
    p = argparse.ArgumentParser(prog="gleanwork", description=__doc__)
    p.add_argument("index", help="folder of the index")
    p.add_argument("command", choices=("get", "find", "search", "tree", "count", "scan"))
    p.add_argument("words", nargs="*")
    p.add_argument("--limit", type=int, default=20)
    p.add_argument("--path", help="a context path to look under")
    a = p.parse_args(argv)
    spark = attach(spark or session("gleanwork-cli"))
    spec = {"features": a.words if a.command in ("find", "count") else [], "limit": a.limit} | ({"context": {"path": a.path}} if a.path else {})
    if a.command == "scan":
        known = any(n.startswith("manifest-") for n in names_in(spark, a.index))
        ix = Index.open(spark, a.index) if known else Index.from_docs(spark, spark.createDataFrame([], derive.DOCS))
        done = 0
        for folder in a.words:
            done += ix.put_many(files.scan(spark, folder))[0].count()
        ix.save(a.index)
        out = [f"{done} files"]
    else:
        ix = Index.open(spark, a.index)
        if a.command == "get":
            out = [json.dumps({k: v for k, v in r.asDict(True).items() if v is not None}, default=str) for r in ix.get_many([int(x) for x in a.words]).collect()]
        elif a.command == "find":
            out = [str(r["doc_id"]) for r in ix.list({**spec, "idsOnly": True}).collect()]
        elif a.command == "count":
            out = [str(ix.count({k: v for k, v in spec.items() if k != "limit"}))]
        elif a.command == "search":
            out = [f"{r['doc_id']}\t{r['score']}" for r in ix.query(" ".join(a.words), {"limit": a.limit, "mode": "fts"}).collect()]
        else:
            out = ix.tree(a.words[0] if a.words else "context").paths()
    for line in out:
        print(line)
    return out


if __name__ == "__main__":
    main()
