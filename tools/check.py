"""Check queries against their SQL: ``python tools/check.py [folder] [name parts ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from clickloom.catalog import QUERIES  # noqa: E402
from clickloom.catalog.compare import compare  # noqa: E402
from clickloom.session import build_session  # noqa: E402


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    conf = {a.split("=", 1)[0]: a.split("=", 1)[1] for a in sys.argv[2:] if "=" in a}
    parts = [a for a in sys.argv[2:] if "=" not in a]
    spark = build_session(
        "check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", **conf}
    )
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in QUERIES:
        if parts and not any(name == p.rstrip("$") if p.endswith("$") else name.startswith(p) for p in parts):
            continue
        began = time.time()
        try:
            ok, note, rows = compare(spark, folder, name)
        except Exception as e:  # noqa: BLE001
            ok, note, rows = False, f"{type(e).__name__}: {str(e)[:700]}", 0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {time.time() - began:6.2f}s {rows:8d} {note}", flush=True)
    print("failures:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
