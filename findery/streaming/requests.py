"""Request stream against static index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from findery.operators.encode import embed_texts
from findery.plans.search import Index, expand_requests, search, split_requests


def answer_requests(requests: DataFrame, index: Index, vectors: DataFrame, passages: DataFrame, make_encoder,
                    out: str, checkpoint: str, fetch_k: int, **encode_options) -> StreamingQuery:
    """Search every micro-batch of a request stream as one batch.

    Answers go to a folder per batch number, so a repeated batch replaces itself;
    expansions and rejected requests are kept beside them.
    """

    def answer(batch: DataFrame, number: int) -> None:
        valid, rejected = split_requests(batch)
        expand_requests(valid, passages).write.mode("overwrite").parquet(f"{out}/expanded/batch={number}")
        rejected.select("query_id", "error").write.mode("overwrite").parquet(f"{out}/rejected/batch={number}")
        valid = valid.where("expand_index_id IS NULL")
        if valid.isEmpty():
            return
        embedded = embed_texts(valid, "query_id", "query", make_encoder, out="query_emb", **encode_options)
        asked = valid.join(embedded, "query_id")
        results = search(asked, index, vectors, passages, fetch_k)
        results.write.mode("overwrite").parquet(f"{out}/answers/batch={number}")

    return (
        requests.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(answer).start()
    )
