"""Token counts: rank-synchronous merging of ragged arrays (see `wordbpe`).

NULL and empty texts have 0 bytes and 0 tokens; rows may repeat; a row's result
depends on its text only, so there is no shuffle. Only the id and text columns
are read, so further columns of any name do no harm. An empty table gives none.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolemill.llm import wordbpe
from rolemill.llm.common import slices, texts


def count_tokens(df: DataFrame, path: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, n_bytes, n_tokens) of each row's whole text under the vocabulary at ``path``."""
    out = df.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))

    def work(batches):
        bpe = wordbpe.load(path)
        for batch in slices(batches, "text"):
            raw = texts(batch.column("text"))
            units = [bpe.units(t) for t in raw]
            bpe.learn(units)
            ids = bpe.ids
            n = [sum(len(ids[u]) for u in us) // 4 for us in units]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(map(len, raw), pa.int64()), pa.array(n, pa.int64())],
                names=[id, "n_bytes", "n_tokens"],
            )

    kind = out.schema["id"].dataType.simpleString()
    return out.mapInArrow(work, f"`{id}` {kind}, n_bytes long, n_tokens long")
