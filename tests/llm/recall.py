"""python tests/llm/recall.py [SF_DIR]: near-duplicate components against brute force over all pairs that share a shingle."""

from __future__ import annotations

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    from tests.llm.helpers import components_of

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r["component_id"] for r in entry.queries()["op7_chosen_path"](spark, sf).collect()}
    expected = components_of(docs)
    linked = [i for i, c in expected.items() if i != c]
    same = sum(got[i] == expected[i] for i in docs)
    print(f"{len(docs)} documents, {len(linked)} of them linked to a smaller id; {sum(got[i] == expected[i] for i in linked)} of these and {same} of all have the right component")


if __name__ == "__main__":
    main()
