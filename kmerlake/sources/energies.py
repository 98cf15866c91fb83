"""A store of open energies: one byte an energy, with the table that decodes it, written in resumable slices.

Layout under a path: `codes/k=K` holds (code, low, high, energy), the bins and the energy that each stands for;
`energies/k=K/conc=C/slice=S` holds (read_id, codes), the bytes of a read's windows in order. A read's slice is the hash
of its id, so what a stopped write has left is known by reading the slices of the ids in question.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerlake.functions import sequence as sq
from kmerlake.operators.binning import gamma_quantiles

#: Directories that a sample's reads are dealt to.
SLICES = 16
CODES = 256


@dataclass(frozen=True)
class Discretisation:
    """CODES bins by their inner bounds, and the energy that each bin stands for. Energies beyond the ends go to the first or the last bin, missing ones count as 0."""

    bounds: tuple[float, ...]
    energies: tuple[float, ...]
    low: float
    high: float

    @classmethod
    def linear(cls, high: float, low: float = 0.0) -> "Discretisation":
        edge = np.linspace(low, high, CODES + 1)
        return cls(tuple(edge[1:-1].tolist()), tuple(((edge[1:] + edge[:-1]) / 2).tolist()), low, high)

    @classmethod
    def gamma(cls, shape: float, scale: float) -> "Discretisation":
        """Bins that hold equal shares of a gamma distribution, each standing for its median."""
        q = np.arange(CODES) / CODES
        return cls(tuple(gamma_quantiles(shape, scale, q[1:]).tolist()), tuple(gamma_quantiles(shape, scale, q + 0.5 / CODES).tolist()), 0.0, float("inf"))

    def encode(self, values: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.array(self.bounds), np.nan_to_num(values, nan=0.0), "right").astype(np.uint8)

    def table(self, spark: SparkSession) -> DataFrame:
        edge = [self.low, *self.bounds, self.high]
        return spark.createDataFrame([(i, edge[i], edge[i + 1], self.energies[i]) for i in range(CODES)], "code int, low double, high double, energy double")


def encoded(reads: DataFrame, bins: Discretisation, energy: str = "e") -> DataFrame:
    """(conc, read_id, codes): a byte for each energy of a read. Null energies within a row count as 0, null rows stay null."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = bins.encode(lists.values.to_numpy(zero_copy_only=False).astype(float)).tobytes()
            ends = lists.offsets.to_numpy().tolist()
            known = lists.is_valid().to_pylist()
            codes = [flat[a:b] if ok else None for a, b, ok in zip(ends[:-1], ends[1:], known)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.binary())], names=["conc", "read_id", "codes"])

    rows = reads.select(F.col("conc").cast("double"), F.col("read_id").cast("long"), F.col(energy).cast("array<double>"))
    return rows.mapInArrow(work, "conc double, read_id long, codes binary")


def decoded(stored: DataFrame, energies: list[float]) -> DataFrame:
    """(conc, read_id, e) of (conc, read_id, codes)."""
    table = np.array(energies)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [c.as_py() for c in batch.column(2)]
            ends = np.cumsum([0, *(len(c or b"") for c in codes)]).astype(np.int32)
            values = pa.array(table[np.frombuffer(b"".join(c or b"" for c in codes), np.uint8)])
            e = pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array([c is None for c in codes]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), e], names=["conc", "read_id", "e"])

    return stored.select("conc", "read_id", "codes").mapInArrow(work, "conc double, read_id long, e array<double>")


def _slice(read_id: str = "read_id") -> "F.Column":
    return F.pmod(F.xxhash64(F.col(read_id).cast("long")), F.lit(SLICES)).cast("int")


def _stored(spark: SparkSession, path: str, k: int) -> DataFrame | None:
    try:
        return spark.read.schema("read_id long, codes binary, conc double, slice int").parquet(f"{path}/energies/k={k}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def unstored(reads: DataFrame, path: str, k: int) -> DataFrame:
    """Reads with an id whose energies the store does not hold yet; of rows that share (conc, read_id) one."""
    own = reads.where("conc is not null and read_id is not null").dropDuplicates(["conc", "read_id"])
    stored = _stored(reads.sparkSession, path, k)
    if stored is None:
        return own
    return own.withColumn("_slice", _slice()).join(stored.select("conc", "read_id", F.col("slice").alias("_slice")), ["conc", "read_id", "_slice"], "left_anti").drop("_slice")


def store(reads: DataFrame, path: str, k: int, fold: Callable[[DataFrame], DataFrame], bins: Discretisation, steps: int = 1) -> int:
    """Folds and stores the reads that the store lacks; returns how many it then holds for k.

    fold adds `e`, the energies of a read's windows of k bases. The work is done in `steps` jobs over slices of the ids;
    each appends what its slices lack, so a write that was stopped, even while files were being moved into place, goes
    on where it ended and stores no read twice, and a repeated one adds nothing. A store keeps the bins of its first
    write; others are refused. One writer at a time.
    """
    spark = reads.sparkSession
    known = code_table(spark, path, k)
    if known is None:
        bins.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/codes/k={k}")
    elif not np.allclose(known, bins.energies):
        raise ValueError("the store has other bins")
    for i in range(steps):
        part = unstored(reads.where(F.pmod(_slice(), F.lit(steps)) == i) if steps > 1 else reads, path, k)
        rows = encoded(fold(part), bins).where("codes is not null").withColumn("slice", _slice())
        rows.repartition("conc", "slice").write.mode("append").partitionBy("conc", "slice").parquet(f"{path}/energies/k={k}")
    held = _stored(spark, path, k)
    return 0 if held is None else held.count()


def code_table(spark: SparkSession, path: str, k: int) -> list[float] | None:
    """The energy of each code, None without a store."""
    try:
        return [r["energy"] for r in spark.read.parquet(f"{path}/codes/k={k}").orderBy("code").collect()]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def stored_energies(spark: SparkSession, path: str, k: int) -> DataFrame:
    """(conc, read_id, e) of a store; no rows without one."""
    table, rows = code_table(spark, path, k), _stored(spark, path, k)
    if table is None or rows is None:
        return spark.createDataFrame([], "conc double, read_id long, e array<double>")
    return decoded(rows, table)


def with_stored_energies(reads: DataFrame, path: str, k: int, adapter_5: str = sq.ADAPTER_5, adapter_3: str = sq.ADAPTER_3, whole: bool = False) -> DataFrame:
    """reads with e from a store, and `missing` where it has none: such reads count as open, with energies of 0.

    Rows that cover the adapters too are told by their length; they are cut to the read's own windows, or with `whole` kept,
    and rows of the read's own windows get energies of 0 for the adapters. A row of any other length is an error.
    """
    own = F.greatest(F.lit(0), F.length("seq") - k + 1)
    l5, l3 = len(adapter_5), len(adapter_3)
    full = F.greatest(F.lit(0), F.length("seq") + l5 + l3 - k + 1)
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    rows = reads.join(stored_energies(reads.sparkSession, path, k).withColumnRenamed("e", "_e"), ["conc", "read_id"], "left")
    wrong = F.raise_error(F.concat(F.lit("energies of read "), F.col("read_id").cast("string"), F.lit(" have no fitting length"))).cast("array<double>")
    if whole:
        e = F.when(F.col("_e").isNull(), zeros(full)).when(F.size("_e") == full, F.col("_e")).when(F.size("_e") == own, F.concat(zeros(F.lit(l5)), F.col("_e"), zeros(full - own - l5))).otherwise(wrong)
    else:
        e = F.when(F.col("_e").isNull(), zeros(own)).when(F.size("_e") == own, F.col("_e")).when(F.size("_e") == full, F.slice("_e", l5 + 1, own)).otherwise(wrong)
    return rows.withColumn("e", e).withColumn("missing", F.col("_e").isNull()).drop("_e")
