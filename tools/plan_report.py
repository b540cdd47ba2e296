"""Write PLANS.md: per query, the shuffles, joins, windows and scan pushdown
of its executed (post-AQE) plan at the given scale.

usage: python tools/plan_report.py [sf_dir] > PLANS.md
"""
import re
import sys

sys.path.insert(0, ".")
from saiflow.plans.catalog import QUERIES  # noqa: E402
from saiflow.session import build_session  # noqa: E402


def summarize(plan: str) -> dict:
    lines = plan.splitlines()
    joins = re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct)"
                       r" \[[^\]]*\], \[[^\]]*\], (\w+)", plan)
    subq = len(set(re.findall(r"Subquery subquery#(\d+)", plan)))
    return {
        # a subquery's plan is printed wherever it is referenced: count distinct exchange ids
        "shuffles": len({m for ln in lines if re.search(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", ln)
                         for m in re.findall(r"plan_id=(\d+)", ln)}),
        "single": len({m for ln in lines if "Exchange SinglePartition" in ln for m in re.findall(r"plan_id=(\d+)", ln)}),
        "joins": ", ".join(f"{k.replace('Join', '')}:{t}" for k, t in joins) or "-",
        "windows": len(re.findall(r"\bWindow \[", plan)),
        "pushed": sorted(set(re.findall(r"PushedFilters: \[([^\]]+)\]", plan))),
        "subqueries": subq,
        "python": "ArrowEvalPython" in plan or "MapInPandas" in plan or "BatchEvalPython" in plan,
        # whole-stage codegen spans are printed as "*(n)" before the fused operators
        "codegen": len(set(re.findall(r"\*\((\d+)\)", plan))),
    }


def table(spark, d: str) -> None:
    print("| query | shuffles | single | joins | windows | subq | codegen spans | python | pushed filters |")
    print("|---|---|---|---|---|---|---|---|---|")
    for name, fn in QUERIES.items():
        df = fn(spark, d)
        # run through the DataFrame's own query execution, so the adaptive
        # plan printed below is the final one (results are small at this scale)
        df.collect()
        root = df._jdf.queryExecution().executedPlan()
        if root.nodeName() == "AdaptiveSparkPlan":
            assert "isFinalPlan=true" in root.toString(), name
            root = root.executedPlan()          # the final tree only (no "Initial Plan" copy)
        plan = root.toString()
        s = summarize(plan)
        pushed = "; ".join(p[:80] for p in s["pushed"][:2]) or "-"
        print(f"| {name} | {s['shuffles']} | {s['single']} | {s['joins']} | {s['windows']} | {s['subqueries']} | "
              f"{s['codegen']} | {'yes' if s['python'] else '-'} | {pushed} |")


def main():
    d = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session()
    print(f"# Executed plans at {d.rsplit('/', 1)[-1]} (final adaptive plans)\n")
    print("Generated by `tools/plan_report.py`. `shuffles` counts exchanges; `single` the one-row "
          "SinglePartition exchanges of global aggregates (after map-side partial aggregation); "
          "`subq` distinct scalar subqueries (each evaluated once).\n")
    table(spark, d)
    # as on tables whose sides are too large to broadcast; only hinted sides still are
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(key, "-1")
    print("\n## Without automatic broadcasts\n")
    table(spark, d)


if __name__ == "__main__":
    main()
