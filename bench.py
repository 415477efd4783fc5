"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from fathomline.plans.queries import registered
from fathomline.session import local_session

HEADLINE = [
    "macro_panel", "macro_ffill3", "macro_yoy_mom", "macro_summary_stats",
    "asof_sentiment_macro", "asof_same_day_ties", "corr_table",
    "page_stats", "text_profile", "sentences", "fixed_chunks", "overlap_chunks", "chunk_records",
    "html_text", "sections", "sections_cascade", "link_ranking", "filing_index",
    "embed_texts", "vector_cosine_topk", "vector_index_topk", "vector_index_recall", "passage_topk", "context_budget", "prompt_table",
    "lexicon_sentiment", "rule_sentiment", "sentiment_upsert", "chunk_upsert", "filing_summary",
    "tfidf", "lda_topics",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session("bench", cores)
    queries = registered()
    queries["store_stats"](spark, folder).write.format("noop").mode("overwrite").save()  # warm-up
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
