"""Token-ID output: flat files of unsigned integers with 64-bit document offsets, read through memory maps.

Documents are dealt into ranges of ascending id and sorted there; task p writes three flat files,
``shard-p.bin`` (ids), ``shard-p.idx`` (64-bit offsets, one more than documents) and ``shard-p.doc`` (64-bit
document ids). Offsets count from the shard's start; the shard's own base is the prefix sum of the counts
of the shards before it and is kept in ``manifest.json``. All three are written as the documents come, under private names, and
renamed, so that a task that runs again, or twice, leaves the same files. There is a shard for each SHARD_BYTES of text, about.

The folder must be one that the driver and all executors mount (memory maps need a file); it defaults to
the session's spark.checkpoint.dir.

Cases: null and empty texts are one end id; repeated ids stay apart, in input order; a null id sorts first
and is stored as the least 64-bit integer; an empty table gives a manifest without shards; other columns
play no part, whatever they are called.
"""

from __future__ import annotations

import contextlib
import json
import os
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.tokenizing import by_bytes, encoder, parts
from termweave.plans.shared import fresh_path, ship

NULL_ID = -(1 << 63)
#: Bytes of text in a shard, and of texts that a worker encodes at once (a longer one is encoded alone), about.
SHARD_BYTES, HELD_BYTES = 32 << 20, 2 << 20


def local_path(uri: str) -> str:
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a folder that is mounted everywhere, not {uri}")
    return parts.path if parts.scheme else uri


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, dtype: str = "<u2") -> str:
    """Write docs and return the folder. One row a shard comes back to the driver, for the prefix sums."""
    spark = docs.sparkSession
    ship(spark)
    at = local_path(folder or fresh_path(spark, "tokens"))
    os.makedirs(at, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer, dtype)
        shard, docs, total = TaskContext.get().partitionId(), 0, 0
        names = [f"{at}/shard-{shard:06d}.{kind}" for kind in ("idx", "doc", "bin")]
        private = [f"{name}.{TaskContext.get().taskAttemptId()}" for name in names]
        with contextlib.ExitStack() as stack:
            offsets, ids, flat = (stack.enter_context(open(name, "wb")) for name in private)
            offsets.write(np.zeros(1, "<u8").tobytes())
            for batch in batches:
                for part in by_bytes(batch, 1, HELD_BYTES):
                    bounds, encoded = parts(words.encode_array(part.column(1)))
                    ends = bounds[1:] // np.dtype(dtype).itemsize
                    flat.write(np.insert(np.frombuffer(encoded, dtype), ends, end_id))
                    ends = ends + np.arange(1, len(ends) + 1)
                    offsets.write((total + ends).astype("<u8").tobytes())
                    ids.write(part.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                    docs, total = docs + len(ends), total + int(ends[-1])
        if not docs:
            for name in private:
                os.remove(name)
            return
        for mine, name in zip(private, names):
            os.replace(mine, name)
        yield pa.RecordBatch.from_pylist([{"shard": shard, "docs": docs, "tokens": total}])

    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()[0]
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"), F.monotonically_increasing_id().alias("r"))
    dealt = source.repartitionByRange(max(1, -(-size // SHARD_BYTES)), "id", "r").sortWithinPartitions("id", "r").select("id", "t")
    shards = sorted(map(tuple, dealt.mapInArrow(run, "shard long, docs long, tokens long").collect()))
    bases = np.concatenate(([0], np.cumsum([s[2] for s in shards]))).astype(int).tolist()
    with open(f"{at}/manifest.json", "w") as f:
        json.dump({"dtype": dtype, "end_id": end_id, "shards": [{"shard": s, "docs": d, "tokens": t, "base": b} for (s, d, t), b in zip(shards, bases)]}, f)
    return at


class TokenFiles:
    """The written ids: documents by place, and DataFrames over all of them."""

    def __init__(self, folder: str):
        self.folder = local_path(folder)
        with open(f"{self.folder}/manifest.json") as f:
            self.manifest = json.load(f)

    def shard(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Memory maps of a shard's ids, offsets and document ids."""
        at = f"{self.folder}/shard-{k:06d}"
        return np.memmap(f"{at}.bin", self.manifest["dtype"], "r"), np.memmap(f"{at}.idx", "<u8", "r"), np.memmap(f"{at}.doc", "<i8", "r")

    def document(self, place: int) -> np.ndarray:
        """Ids of the document at this place in ascending order of ids."""
        for s in self.manifest["shards"]:
            if place < s["docs"]:
                ids, offsets, _ = self.shard(s["shard"])
                return np.asarray(ids[int(offsets[place]) : int(offsets[place + 1])])
            place -= s["docs"]
        raise IndexError(place)

    def documents(self, spark) -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files."""
        ship(spark)
        shards, files = self.manifest["shards"], self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    ids, offsets, docs = files.shard(shards[k]["shard"])
                    at = np.asarray(offsets).astype(np.int64)
                    for a in range(0, len(docs), 4096):
                        b = min(len(docs), a + 4096)
                        sums = [zlib.crc32(np.asarray(ids[at[i] : at[i + 1]]).astype("<u4")) for i in range(a, b)]
                        names = [None if x == NULL_ID else x for x in np.asarray(docs[a:b]).tolist()]
                        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(at[a:b] + shards[k]["base"]), pa.array(np.diff(at[a : b + 1])), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

        count = max(1, len(shards))
        return spark.range(0, len(shards), 1, count).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return TokenFiles(folder).documents(spark)
