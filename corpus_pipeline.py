"""A training corpus from raw documents: five stages, each over all rows that the one before kept.

1. Language ID drops documents without a letter and those whose words' languages are unsure; a text in several
   languages stays if its words are sure.
2. Order MinHash keeps one document of each near-duplicate class, that of the smallest doc_id.
3. Template decontamination drops documents that hold a benchmark item.
4. Anchor expansion puts a mark such as <email> in place of each span of personal data.
5. The SentencePiece codec adds the ids of each text.

Stages 1 to 4 return the columns of documents; the last adds ``piece_ids``, and ``n_ids`` and ``ids_crc32`` as digests of
them; columns of these three names that documents have already give way to them.

Null and empty texts have no letter and go in stage 1, as does a whole table in which no language can be learned. Very
long texts are handled whole. A null doc_id is no reason to go: such a row is judged by its text where a stage needs no
id, and stays in stage 2. Of rows that repeat a doc_id and a text one stays; rows that repeat a doc_id with other texts
are judged each by its own. Ties in a class go to the smallest doc_id, then to the smallest hash of the text. Empty
tables give empty results. Further columns pass through, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from rampart.llm import decontaminate, langid, neardup, pieces, pii, storage
from rampart.llm.queries import tokenizer_path

#: Least mean of every word's largest marginal.
LEAST_SURE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    storage.small_batches(spark)
    model = langid.fit(docs.select("doc_id", "text", "lang").where(~langid.held_out()))
    return langid.keep(docs, model, LEAST_SURE)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = [x or b"" for x in b.column(b.num_columns - 1).to_pylist()]
        digests = pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())
        yield pa.RecordBatch.from_arrays([*b.columns, *digests], names=[*b.schema.names, "n_ids", "ids_crc32"])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids themselves, with their number and CRC-32."""
    docs = docs.drop("piece_ids", "n_ids", "ids_crc32")
    encoded = pieces.encoding(tokenizer_path("piece_bpe_32k.model"), docs.columns.index("text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "piece_ids binary, n_ids bigint, ids_crc32 bigint"])
    return docs.mapInArrow(lambda batches: _digests(encoded(batches)), schema)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("near_dedup", deduplicate),
    ("decontaminate", remove_benchmark),
    ("pii", redact),
    ("sentencepiece", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, storage.materialize(stage(spark, docs, sf_dir), name)
        storage.discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
