"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON.

"value" is the sum of the queries' seconds. "encode" also gives input MB/s, tokens and the checksum of ids.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "2m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from tessera import queries as base
    from tessera.operators.encode import encode, run_summary
    from tessera.plans.fixture import fixture_model
    from tessera.plans.model import load_model

    try:
        import public_tokenizers

        model = load_model(spark, "file://" + os.path.realpath(public_tokenizers.path("byte_bpe_50k.json")))
    except ImportError:
        model = fixture_model()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    seconds, extra = {}, {}

    def timed(name: str, run) -> object:
        began = time.time()
        out = run()
        seconds[name] = round(time.time() - began, 3)
        return out

    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    base.pretoken_rows(spark, sf_dir).limit(1).collect()
    row = timed("encode", lambda: run_summary(encode(docs, model)).first())
    extra["encode"] = {"mb_per_s": round(size / 1e6 / seconds["encode"], 2), "tokens": row["tokens"], "checksum": row["checksum"]}
    for name in ("word_stats", "word_count", "pretokens", "pretoken_class_hist", "byte_histogram", "pair_count", "top_pairs_k", "train_canonical_k", "encode_ids", "checksum_by_lang", "special_encode", "newline_docs", "pages_tokens", "conversations_tokens"):
        timed(name, lambda name=name: noop(base.queries()[name](spark, sf_dir)))
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "detail": extra}))


if __name__ == "__main__":
    main()
