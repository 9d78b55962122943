"""Markdown table of per-query times: Spark (bench.py JSON) beside DuckDB
on the oracle SQL (duckdb_baseline.py JSON).

    python tools/baseline_table.py bench.json duck.json
"""

import json
import sys


def main():
    b = json.load(open(sys.argv[1]))
    d = json.load(open(sys.argv[2]))["queries"]
    q = b["queries"]
    cold = b.get("cold", {})
    print("| Query | Spark best (s) | Spark first run (s) | DuckDB, oracle SQL (s) |")
    print("| --- | ---: | ---: | ---: |")
    for name in q:
        dv = d.get(name)
        cv = cold.get(name)
        print(f"| {name} | {q[name]:.2f} | {'-' if cv is None else f'{cv:.2f}'} | "
              f"{'-' if dv is None else f'{dv:.2f}'} |")
    tot_d = sum(v for k, v in d.items() if k in q)
    tot_c = b.get("cold_all_queries_sec")
    print(f"| **all {len(q)} queries** | **{b['all_queries_total_sec']:.1f}** | "
          f"**{'-' if tot_c is None else f'{tot_c:.1f}'}** | **{tot_d:.1f}** |")


if __name__ == "__main__":
    main()
