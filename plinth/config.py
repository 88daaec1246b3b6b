"""Engine options and what each of them sets in Spark."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class EngineConfig:
    chunk_size: int = 8192
    default_batch_size: int = 5000
    hash_index_buckets: int = 65536
    enable_bloom_prefilter: bool = True
    enable_zone_maps: bool = True
    max_rows_in_memory: int = 10_000_000
    query_timeout_ms: int = 30_000
    profile_operators: bool = False
    cache_chunk_decodes: bool = False
    join_strategy: str = "hash"
    count_includes_nulls: bool = False
    compat_string_desc: bool = False
    extra: dict[str, str] = field(default_factory=dict)

    def spark_conf(self) -> dict[str, str]:
        """Session settings. ``max_rows_in_memory`` has none, since Spark spills by itself; ``query_timeout_ms`` is kept by ``Engine.collect``, ``cache_chunk_decodes`` by ``Engine.read_chunk``."""
        return {
            "spark.sql.parquet.columnarReaderBatchSize": str(self.chunk_size),
            "spark.sql.execution.arrow.maxRecordsPerBatch": str(self.default_batch_size),
            "spark.sql.optimizer.runtime.bloomFilter.enabled": str(self.enable_bloom_prefilter).lower(),
            "spark.sql.parquet.filterPushdown": str(self.enable_zone_maps).lower(),
            **self.extra,
        }

    def apply(self, spark: SparkSession) -> None:
        for key, value in self.spark_conf().items():
            spark.conf.set(key, value)
