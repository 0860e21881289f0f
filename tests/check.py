"""Run named queries (or all) against their SQL: python tests/check.py FOLDER [NAME...]."""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from compare import duck, duck_rows, kinds, spark_rows  # noqa: E402

from tallymark.plans import load_catalog  # noqa: E402
from tallymark.session import build_session  # noqa: E402


def main(folder: str, names: list[str]) -> int:
    spark = build_session(
        "check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = duck(folder), []
    catalog = load_catalog()
    for name in names or list(catalog):
        entry, started = catalog[name], time.time()
        try:
            df = entry.run(spark, folder)
            ours = spark_rows(df)
            spent = time.time() - started
            if entry.oracle is None:
                print(f"rows  {name}: {len(ours)} rows, {spent:.1f}s", flush=True)
                continue
            started = time.time()
            columns, theirs = duck_rows(con, entry.oracle)
            sql_spent = time.time() - started
            problems = []
            if sorted(columns) != sorted(df.columns):
                problems.append(f"columns {sorted(df.columns)} vs {sorted(columns)}")
            else:
                a, b = kinds(df, con, entry.oracle)
                odd = {c: (a[c], b[c]) for c in a if a[c] != b[c]}
                if odd:
                    problems.append(f"types {odd}")
            if ours != theirs:
                only = [r for r in ours if r not in theirs][:3] if len(ours) < 20000 else []
                other = [r for r in theirs if r not in ours][:3] if len(ours) < 20000 else []
                problems.append(f"rows {len(ours)} vs {len(theirs)}\n   ours {only}\n   sql  {other}")
            if not ours:
                problems.append("empty")
            if problems:
                failed.append(name)
            status = "ok   " if not problems else "DIFF "
            print(f"{status} {name}: {len(ours)} rows, {spent:.1f}s, sql {sql_spent:.1f}s", *problems, flush=True)
        except Exception:
            failed.append(name)
            text = traceback.format_exc()
            print(f"FAIL  {name}\n{text[-1800:]}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
