"""Run registered queries against their SQL checks: ``python tests/check_queries.py [folder] [name...]``."""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import compare, connect  # noqa: E402
from siftwright.plans import CHECKS, QUERIES  # noqa: E402
from siftwright.session import local_session  # noqa: E402


def main() -> int:
    args = sys.argv[1:]
    folder = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = [n for n in QUERIES if not args or any(a == n or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    spark, con, bad = local_session(), connect(folder), 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            if name in CHECKS:
                diff = compare(df, con, CHECKS[name])
                note = "ok" if diff is None else f"DIFF {diff}"
            else:
                note = f"rows {len(df.collect())}"
        except Exception as exc:  # report and go on
            note = "ERROR " + str(exc)[:1500]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += note.startswith(("DIFF", "ERROR"))
        print(f"{name:34s} {time.time() - start:7.2f}s {note}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main() and 1)
