"""Run registered queries against their SQL: python tests/run_checks.py [sf_dir] [name prefix ...]"""

import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

import registry  # noqa: E402
from formline.session import local_session  # noqa: E402
from oracle import compare, connection  # noqa: E402


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:]) or ("",)
    if "--only" in prefixes:
        for module in prefixes[prefixes.index("--only") + 1 :]:
            __import__(f"registry.{module}")
        prefixes = ("",)
    else:
        registry.load()
    spark, con, bad = local_session(), connection(sf_dir), 0
    spark.sparkContext.setLogLevel("ERROR")
    for name, fn in registry.QUERIES.items():
        if not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            sql = registry.ORACLES.get(name)
            problems = compare(df, con, sql) if sql else ([] if len(df.collect()) else ["no rows"])
            tag = "sql" if sql else "rows"
        except Exception as exc:
            problems, tag = [f"{type(exc).__name__}: {str(exc)[:1500]}"], "error"
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok':5}{tag:6}{time.time() - start:7.2f}s {name}", flush=True)
        for p in problems:
            print("     ", p[:1800], flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main()))
