"""Engine: named tables, the dialect, explain, results and counters over a SparkSession."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, types as T

from plinth.config import EngineConfig
from plinth.dialect import Translator, parse
from plinth.errors import PlanError
from plinth.plans.shared import _resolved, exists, folders


def build_session(app: str = "plinth", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in (conf or {}).items():
        builder = builder.config(k, v)
    return (builder.master(master) if master else builder).getOrCreate()


#: Tables opened before, by session and path, with what their files looked like then.
_opened: dict[tuple[str, str], tuple[list, DataFrame]] = {}


def open_parquet(spark: SparkSession, path: str) -> DataFrame:
    """``spark.read.parquet``, whose listing and footers are read again only when a file has changed. Folders of folders are always read anew."""
    files, at = _resolved(spark, path)
    if not files.exists(at):
        return spark.read.parquet(path)
    listed = files.listStatus(at)
    stamp = [(s.getPath().getName(), s.getModificationTime(), s.getLen()) for s in listed]
    if len(listed) > 1000 or any(s.isDirectory() for s in listed):
        return spark.read.parquet(path)
    key = (spark.sparkContext.applicationId, path)
    if key not in _opened or _opened[key][0] != stamp:
        _opened[key] = (stamp, spark.read.parquet(path))
    return _opened[key][1]


class Catalog:
    """Names of DataFrames. Registering a taken name or dropping a missing one is an error."""

    def __init__(self) -> None:
        self._tables: dict[str, DataFrame] = {}

    def register(self, name: str, df: DataFrame, replace: bool = False) -> None:
        if name in self._tables and not replace:
            raise PlanError(f"table {name!r} exists")
        self._tables[name] = df

    def get(self, name: str) -> DataFrame:
        if name not in self._tables:
            raise PlanError(f"no table {name!r}")
        return self._tables[name]

    def has(self, name: str) -> bool:
        return name in self._tables

    def drop(self, name: str) -> None:
        self.get(name)
        del self._tables[name]

    def list(self) -> list[str]:
        return sorted(self._tables)

    def schema(self, name: str) -> T.StructType:
        return self.get(name).schema

    def total_rows(self) -> int:
        return sum(df.count() for df in self._tables.values())

    def find_table_with_column(self, column: str) -> str | None:
        return next((n for n in self.list() if column in self._tables[n].columns), None)


class Engine:
    def __init__(self, spark: SparkSession, config: EngineConfig | None = None, warehouse: str | None = None, loader: Callable[[str], DataFrame] | None = None):
        """``loader`` opens tables that are not registered when a query first names them."""
        from plinth.plans.cache import DecodeCache
        from plinth.plans.metrics import Metrics

        self.loader = loader
        self.spark, self.config, self.warehouse = spark, config or EngineConfig(), warehouse
        self.config.apply(spark)
        self.catalog, self.metrics, self.queries_executed = Catalog(), Metrics(), 0
        self.decoded = DecodeCache()

    def register(self, name: str, df: DataFrame, replace: bool = False) -> DataFrame:
        self.catalog.register(name, df, replace)
        df.createOrReplaceTempView(name)
        return df

    def table(self, name: str) -> DataFrame:
        """A registered table, else one of the loader's or one saved in the warehouse folder."""
        if not self.catalog.has(name) and self.loader:
            self.catalog.register(name, self.loader(name))
        if not self.catalog.has(name) and self.warehouse and exists(self.spark, f"{self.warehouse}/{name}"):
            self.register(name, self.spark.read.parquet(f"{self.warehouse}/{name}"))
        return self.catalog.get(name)

    def save(self, name: str, df: DataFrame) -> DataFrame:
        """Write to the warehouse folder, so that later processes find the table."""
        if not self.warehouse:
            raise PlanError("this engine has no warehouse folder")
        df.write.mode("overwrite").parquet(f"{self.warehouse}/{name}")
        return self.register(name, self.spark.read.parquet(f"{self.warehouse}/{name}"), replace=True)

    def tables(self) -> list[str]:
        """Registered ones and those saved in the warehouse, in whatever store it is."""
        return sorted({*self.catalog.list(), *(folders(self.spark, self.warehouse) if self.warehouse else [])})

    def sql(self, text: str) -> DataFrame:
        """Plan a query; counted once it is planned. Nothing runs until an action."""
        began = time.perf_counter()
        df = Translator(self.table, self.config).plan(parse(text))
        self.queries_executed += 1
        self.metrics.record("plan", time.perf_counter() - began)
        return df

    def collect(self, text: str, max_rows: int = 1000) -> list:
        """At most ``max_rows`` rows of a query. Its jobs are cancelled after ``query_timeout_ms``, which is an error."""
        group, context = f"plinth-{uuid.uuid4().hex}", self.spark.sparkContext
        late, over = threading.Event(), threading.Event()

        def stop() -> None:
            if not over.wait(self.config.query_timeout_ms / 1000):
                late.set()
                while not over.wait(0.2):  # a query has several jobs
                    context.cancelJobGroup(group)

        context.setJobGroup(group, text, interruptOnCancel=True)
        threading.Thread(target=stop, daemon=True).start()
        try:
            return self.sql(text).limit(max_rows).collect()
        except Exception as e:
            if late.is_set():
                raise PlanError(f"the query took more than {self.config.query_timeout_ms} ms") from e
            raise
        finally:
            over.set()
            for p in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
                context.setLocalProperty(p, None)

    def read_chunk(self, table: str, column: str, order: str, chunk_id: int) -> list:
        """The values of one chunk of ``chunk_size`` rows in the table's order; kept in ``decoded`` if ``cache_chunk_decodes`` is set."""
        from plinth.operators.relational import read_rows

        found = self.decoded.get(f"{table}:{column}", chunk_id) if self.config.cache_chunk_decodes else None
        if found is None:
            first = chunk_id * self.config.chunk_size
            rows = read_rows(self.table(table).select(*dict.fromkeys((column, order))), order, first, first + self.config.chunk_size)
            found = [r[0] for r in rows.orderBy("row_id").select(column).collect()]
            if self.config.cache_chunk_decodes:
                self.decoded.put(f"{table}:{column}", chunk_id, found)
        return found

    def explain(self, text: str) -> str:
        df = Translator(self.table, self.config).plan(parse(text))
        return df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def reset_cache(self) -> None:
        self.spark.catalog.clearCache()
        self.decoded.clear()
