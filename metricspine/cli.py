"""python -m metricspine.cli describe|explain|query --pack FILE --data FOLDER [SPEC.json or -]"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys
from decimal import Decimal
from pathlib import Path

from pydantic import ValidationError
from pyspark.sql import SparkSession

from .errors import SpineError
from .facade import Guard, Spine
from .tools import Tools, refusal, serve


def plain(value):
    """JSON for what JSON lacks: exact numbers and dates as text."""
    if isinstance(value, (Decimal, dt.date, dt.datetime)):
        return str(value)
    raise TypeError(type(value).__name__)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="metricspine", description=__doc__)
    parser.add_argument("command", choices=("describe", "explain", "query", "serve"))
    parser.add_argument("spec", nargs="?", help="a request as JSON, a file of it, or - for standard input; for describe, an object")
    parser.add_argument("--pack", required=True, type=Path)
    parser.add_argument("--data", required=True)
    parser.add_argument("--engine", default="preaggregate")
    parser.add_argument("--verify", action="store_true", help="check declared keys and cardinalities against the data")
    parser.add_argument("--max-rows", type=int, default=Guard.max_rows)
    parser.add_argument("--timeout-ms", type=int, default=60_000)
    a = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("metricspine").getOrCreate()
    try:
        spine = Spine.load(spark, a.pack, a.data, engine=a.engine, guard=Guard(a.max_rows, a.timeout_ms), verify=a.verify)
        if a.command == "serve":
            serve(Tools(spine))
            return 0
        if a.command == "describe":
            out = spine.describe(a.spec)
        else:
            text = sys.stdin.read() if a.spec in (None, "-") else a.spec if a.spec.lstrip().startswith("{") else Path(a.spec).read_text()
            spec = json.loads(text)
            if a.command == "explain":
                out = spine.explain(spec)
            else:
                r = spine.query(spec)
                out = {"columns": r.columns, "rows": r.rows, "additive": r.additive, "non_additive_reason": r.non_additive_reason, "rewrites": r.rewrites, "limit_reached": r.limit_reached, "ontology_elements_used": r.elements, "engine": r.engine}
    except (SpineError, ValidationError) as e:
        print(json.dumps(refusal(e)), file=sys.stderr)
        return 1
    print(json.dumps(out, default=plain, indent=2, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
