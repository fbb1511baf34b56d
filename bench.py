"""Times the headline queries: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default: all) the cores.  Each query writes its
whole result to Spark's no-op sink; the second of two runs counts, as code is compiled by then.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent}:{os.environ.get('PYTHONPATH', '')}"

from loamdex.operators.inverted import Index  # noqa: E402
from loamdex.plans.catalog import ENTRIES  # noqa: E402
from loamdex.plans.registry import Tables  # noqa: E402
from loamdex.session import local_session  # noqa: E402
from loamdex.streaming.jobs import folder as folder_of  # noqa: E402

HEADLINE = (
    "keyword_index_fill",
    "bm25_top10",
    "bm25_with_labels",
    "term_statistics",
    "unknown_word_fallback",
    "rrf_fuse",
    "phrase_gate",
    "cosine_topk",
    "zscore_gate",
    "ir_metrics",
    "eav_self_join_total",
    "strict_conjunction",
    "gap_sessions_events",
    "percentile_floor_idx",
    "word_window_chunks",
    "sentence_chunks",
    "near_dup_hamming",
    "html_strip_pages",
    "url_normalize",
    "facts_of_receipts",
    "content_hash_dups",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = local_session(cores=cores, memory="12g")
    tables, took = Tables(spark, folder), {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.perf_counter()
            ENTRIES[name].run(tables).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
    # the keyword index, the one figure with a published counterpart: the fill alone, from the texts to an index that can be searched
    fills = []
    for _ in range(3):
        began = time.perf_counter()
        index = Index(spark, folder_of(spark)).add(tables.documents, "doc_id", "text")
        fills.append(time.perf_counter() - began)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": Path(folder).name,
                "cpus": cores,
                "index_fill_sec": round(min(fills), 3),
                "index_rows_per_sec": round(index.live / min(fills)),
                "index_words_per_sec": round(index.words / min(fills)),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
