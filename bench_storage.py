"""Own figures of the index on local[$BENCH_CPUS] over the line items of $BENCH_SF_DIR; prints one JSON line.

Rows and postings written in a second, time of a commit of 1 000 rows to the full index, of a merge of three segments, cold and warm latency
of a search, and bytes of storage for each posting by weight type.
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from sparsemill.config import IndexSettings
    from sparsemill.functions.vectors import collect_vectors
    from sparsemill.operators.merge import NoMerge
    from sparsemill.plans.queries import QUERY, line_vectors
    from sparsemill.sources.index import SparseIndex

    vectors = collect_vectors(line_vectors(spark, sf_dir)).cache()
    rows = vectors.count()
    few = vectors.limit(1000).withColumn("row_id", F.col("row_id") + 2**31).cache()
    few.count()

    def clock(run):
        start = time.time()
        run()
        return round(time.time() - start, 2)

    out = {"rows": rows}
    made = {"f32": IndexSettings(), "f16": IndexSettings(weight="f16", storage="compressed"), "u8": IndexSettings(weight="u8", storage="compressed"), "quantized": IndexSettings(quantized=True, storage="compressed")}
    for turn in range(2):
        for name, settings in made.items():
            index = SparseIndex.create_temporary(spark, settings)
            with index.writer(NoMerge()) as writer:
                seconds = clock(lambda: writer.append(vectors))
                writer.commit()
            s = index.snapshot().segments[0]
            out[name] = {"ingest_rows_s": round(rows / seconds), "postings": s.postings_count, "bytes_per_posting": round(index.folder.size(f"segments/{s.segment_id}/postings") / s.postings_count, 2)}
            if name == "f32":
                out["search_cold_s"] = clock(lambda: index.reader().searcher().search(QUERY, 10).collect())
                out["search_warm_s"] = clock(lambda: index.reader().searcher().search(QUERY, 10).collect())
                with index.writer(NoMerge()) as writer:
                    out["commit_1000_rows_s"] = clock(lambda: (writer.append(few), writer.commit()))
                    writer.append(vectors.withColumn("row_id", F.col("row_id") + 2**30))
                    writer.commit()
                    out["merge_three_segments_s"] = clock(lambda: writer.compact([s.segment_id for s in index.snapshot().segments]))
            index.drop()
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
