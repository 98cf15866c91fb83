"""Query registry, and the reads that stand in for sequencing libraries in the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerlake.functions import sequence as sq
from kmerlake.functions.energy import rt
from kmerlake.operators.footprint import synthetic_energies, with_accessibility

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
LENGTH = 40


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir), with the DuckDB SQL of the same rows."""

    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conc, read_id, seq): the ACGTU letters of the documents in pieces of 40, the last one cut from the end; the source gives the concentration. Texts with fewer letters make no read."""
    n = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    conc = F.when(n <= 3, 0.0).when(n <= 7, 5.0).when(n <= 11, 20.0).otherwise(80.0)
    none = F.array().cast("array<string>")
    cut = lambda s: F.concat(F.regexp_extract_all(s, F.lit(f".{{{LENGTH}}}"), F.lit(0)), F.when((F.length(s) > LENGTH) & (F.length(s) % LENGTH > 0), F.array(sq.right(s, LENGTH))).otherwise(none))
    pieces = sq.bound(sq.normalised(F.regexp_replace("text", "[^ACGTUacgtu]+", "")), cut)
    docs = table(spark, sf_dir, "documents").select("doc_id", conc.alias("conc"), F.posexplode(pieces).alias("i", "seq"))
    return docs.select("conc", (F.col("doc_id") * 100000 + F.col("i")).alias("read_id"), "seq")


def folded(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """reads with stand-in open energies e and accessibilities acc."""
    return with_accessibility(synthetic_energies(reads(spark, sf_dir), k))


READS = f"""reads AS (
  SELECT (CASE WHEN n <= 3 THEN 0 WHEN n <= 7 THEN 5 WHEN n <= 11 THEN 20 ELSE 80 END)::DOUBLE AS conc, doc_id * 100000 + i AS read_id, substring(s, 1 + least({LENGTH} * i, length(s) - {LENGTH}), {LENGTH}) AS seq
  FROM (SELECT doc_id, n, s, unnest(range(0, (length(s) + {LENGTH - 1}) // {LENGTH})) AS i
    FROM (SELECT doc_id, substring(source, 4)::INTEGER AS n, replace(upper(regexp_replace(text, '[^ACGTUacgtu]', '', 'g')), 'T', 'U') AS s FROM documents) WHERE length(s) >= {LENGTH}))"""


def km(k: int, pad: bool = False, name: str = "km", source: str = "reads") -> str:
    """CTE of k-mer positions."""
    s = f"'{sq.ADAPTER_5[len(sq.ADAPTER_5) - (k - 1):] if k > 1 else ''}' || seq || '{sq.ADAPTER_3[: k - 1]}'" if pad else "seq"
    return f"{name} AS (SELECT conc, read_id, p - 1 AS pos, substring(s, p, {k}) AS kmer FROM (SELECT conc, read_id, s, unnest(range(1, length(s) - {k} + 2)) AS p FROM (SELECT conc, read_id, {s} AS s FROM {source})))"


def domain(k: int, name: str = "dom") -> str:
    froms = " CROSS JOIN ".join(f"(VALUES ('A'), ('C'), ('G'), ('U')) t{i}(x{i})" for i in range(k))
    return f"{name} AS (SELECT {' || '.join(f'x{i}' for i in range(k))} AS kmer FROM {froms})"


def full(k: int, pad: bool = True) -> str:
    """CTEs up to `full`: counts of every sample over the whole domain."""
    return f"""{READS}, {km(k, pad)}, {domain(k)},
cnt AS (SELECT conc, kmer, count(*) AS n FROM km GROUP BY conc, kmer),
samples AS (SELECT conc, count(*) AS reads FROM reads GROUP BY conc),
full_counts AS (SELECT s.conc, d.kmer, coalesce(c.n, 0) AS n, s.reads FROM samples s CROSS JOIN dom d LEFT JOIN cnt c ON c.conc = s.conc AND c.kmer = d.kmer)"""


def freq(k: int, pseudo: float = 10.0) -> str:
    return f"{full(k)}, freq AS (SELECT conc, kmer, (n + {pseudo}) / sum(n + {pseudo}) OVER (PARTITION BY conc)::DOUBLE * {4**k} AS f FROM full_counts)"


def r_of(k: int) -> str:
    return f"{freq(k)}, r AS (SELECT a.conc, a.kmer, a.f / b.f AS r FROM freq a JOIN freq b ON a.kmer = b.kmer AND b.conc = 0 WHERE a.conc <> 0)"


ENERGY = "(((read_id * 31 + pos * 17) % 97) / 24.25::DOUBLE)"
ACC = f"exp(-{ENERGY} / {rt(4.0)!r})"
U = "(((read_id * 1103515245 + 12345) % 2147483648) / 2147483648::DOUBLE)"


def replicate_u(i: int | str) -> str:
    """The uniform of a read in a replicate, as replicate_uniform()."""
    v = f"((read_id % 2147483648 * 1103515245 + (12345 + 610839777 * {i}) % 2147483648) % 2147483648)"
    return f"((({v} * {v}) // 65536 % 2147483648) / 2147483648::DOUBLE)"


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Rounded, and zero without a sign."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in cols})
