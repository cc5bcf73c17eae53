"""Headline queries of the graph engine, timed; prints one JSON line. BENCH_SF_DIR: the tables; BENCH_CPUS: threads."""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

#: Registered queries that are timed over their whole result.
NAMED = ("callers", "callees", "references", "implementations", "unresolved_all", "routes", "search", "search_partial", "language_breakdown", "index_status", "relationships_by_kind", "bfs_capped", "impact", "neighbourhood", "detect_changes", "affected_set", "stable_relationship_ids", "resolve_module", "debounce_sessions")
INDEXED = int(os.environ.get("BENCH_FILES", "1000"))


def corpus(folder: Path, n: int) -> None:
    """n small sources, seven of ten TypeScript and three C#, each calling the one before."""
    for i in range(n):
        if i % 10 < 7:
            (folder / f"m{i}.ts").write_text(f"import {{ f{i - 1} }} from './m{i - 1}';\nexport class K{i} extends K{i - 1} {{ run() {{ f{i - 1}(); }} }}\nexport function f{i}() {{ return new K{i}(); }}\n")
        else:
            (folder / f"m{i}.cs").write_text(f"using System;\nnamespace N{i} {{ public class C{i} : C{i - 1} {{ public int P {{ get; set; }} public void Go() {{ new C{i - 1}(); }} }} }}\n")


def main() -> None:
    import tempfile

    from pyspark.sql import SparkSession

    from quillgraph.operators.extract.run import extract
    from quillgraph.plans import catalogue
    from quillgraph.sources import tree

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took: dict[str, float] = {}

    def timed(name, f):
        began = time.perf_counter()
        f().write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)

    for q in NAMED:
        timed(q, lambda q=q: catalogue.QUERIES[q](spark, sf_dir))
    with tempfile.TemporaryDirectory() as t:
        corpus(Path(t), INDEXED)
        timed(f"extract_{INDEXED}_files", lambda: extract(tree.read_sources(spark, t)))
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "graph queries and extraction, sum", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf[1]) if sf else None}))


if __name__ == "__main__":
    main()
