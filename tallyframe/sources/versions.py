"""Tables that change in one step: folders of rows, and one commit record that says which of them count.

``<root>/data/<id>/__bucket=<k>/`` holds rows whose key falls into bucket k; ``<root>/commits/`` holds one JSON record per
version with the folders of every bucket. A version is there once its record is: until then readers see the
one before, and folders no record names are never read. Only the buckets a batch has keys in are read and
written, so a small batch does not rewrite a large table. The driver holds one record: at most
``buckets * MAX_FOLDERS`` folder names, whatever the rows.

One writer at a time per table (a stream query is one): a second one is noticed before its record is written, not locked out.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

BUCKET, TASK, NEW = "__bucket", "__task", "__new"
#: A bucket that appends have spread over so many folders is written anew by the next batch that touches it.
MAX_FOLDERS = 8
#: Pieces that the keys of all buckets are cut into; the driver counts the rows of each, and tasks take whole ones.
SLICES = 4096
#: A piece with more rows a key than this is collapsed before its rows are shuffled, so a busy key is no hot task.
COPIES = 4
#: Rows of a task that writes, about.
TASK_ROWS = 1 << 21
_RECORD = (
    "version bigint, buckets int, schema string, writers map<string,bigint>, parts array<struct<bucket:int,folder:string>>"
)


def newest(spark: SparkSession, root: str, version: int | None = None) -> Row | None:
    """The commit record of a version, the last one by default; None where the table has none."""
    try:
        log = spark.read.schema(_RECORD).json(f"{root.rstrip('/')}/commits")
    except Exception as missing:  # nothing was ever committed
        if "PATH_NOT_FOUND" in str(missing):
            return None
        raise
    if version is not None:
        log = log.filter(F.col("version") == version)
    return log.agg(F.max_by(F.struct("*"), "version").alias("r")).first().r


def _rows(spark: SparkSession, root: str, record: Row, buckets: set[int] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(record.schema))
    paths = [
        f"{root.rstrip('/')}/data/{p.folder}/{BUCKET}={p.bucket}" for p in record.parts if buckets is None or p.bucket in buckets
    ]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """Rows of a version, the newest by default. Raises where it was never committed."""
    record = newest(spark, root, version)
    if record is None:
        raise ValueError(f"{root} has no version {'at all' if version is None else version}")
    return _rows(spark, root, record)


def apply_batch(
    batch: DataFrame, root: str, keys: Sequence[str], order: Sequence[str], keep: str = "last",
    writer: str = "batch", batch_id: int | None = None, buckets: int = 64,
) -> bool:
    """Bring a batch into the table as one new version; False where it was there already.

    ``keep="first"`` inserts and does nothing on conflict (in the batch the first row in ``order`` wins), ``keep="last"`` upserts
    the greatest row in ``order`` over table and batch; at equal order the smallest or greatest of the other columns.
    NULL key parts are equal to each other. A ``batch_id`` not above the last one committed by the same ``writer`` is
    a replay and changes nothing. The first batch sets schema and ``buckets``; later ones are cast to that
    schema and must hold its columns, others are left out. An empty batch is a version too.

    The batch is read more than once (its keys are counted first) and must give the same rows each time: persist what is
    dear or comes from a stateful stream.
    """
    if keep not in ("first", "last"):
        raise ValueError(f"keep must be 'first' or 'last', not {keep!r}")
    spark, keys, root = batch.sparkSession, list(keys), root.rstrip("/")
    now = newest(spark, root)
    writers = dict(now.writers) if now else {}
    if batch_id is not None and batch_id <= writers.get(writer, -1):
        return False
    if now:
        buckets, schema = now.buckets, T.StructType.fromJson(json.loads(now.schema))
        batch = batch.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    else:
        schema = batch.schema
    rest = [c for c in schema.names if c not in keys]
    ranked = [F.col(c) if c in rest else F.col(c).alias(f"__o{i}") for i, c in enumerate(dict.fromkeys(order))]
    ranked += [F.col(c) for c in rest if c not in order]
    # The key's text form, so a bucket does not depend on how wide the batch's own integer type is.
    digest = F.xxhash64(*[_one_zero(schema[k]).cast("string") for k in keys])
    bucket = F.pmod(digest, F.lit(buckets)).cast("int")
    per = max(1, SLICES // buckets)
    piece = (bucket * per + F.pmod(F.shiftrightunsigned(digest, 32), F.lit(per))).cast("int")

    def one(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        best = F.min(F.struct(NEW, *ranked)) if keep == "first" else F.max(F.struct(*ranked, NEW))
        return rows.groupBy(*by, *keys).agg(best.alias("__r")).select(*by, *keys, *[f"__r.{c}" for c in (*rest, NEW)])

    told = batch.groupBy(piece.alias("piece")).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(digest, 0.3).alias("keys")).collect()
    touched = {r.piece // per for r in told}
    parts = [(p.bucket, p.folder) for p in now.parts] if now else []
    folder = uuid.uuid4().hex
    if touched:
        busy = [r.piece for r in told if r.n > max(COPIES * r["keys"], 1000)]
        fresh = batch.withColumn(NEW, F.lit(1))
        if busy:
            fresh = fresh.filter(~piece.isin(busy)).unionByName(one(fresh.filter(piece.isin(busy))))
        rows, total = fresh, sum(r.n for r in told)
        folders = [b for b, _ in parts]
        anew = {b for b in touched if keep == "last" or folders.count(b) >= MAX_FOLDERS}
        if anew and now:
            old = _rows(spark, root, now, anew)
            rows, total = rows.unionByName(old.withColumn(NEW, F.lit(0))), total + old.count()
        if touched - anew and now:  # of a bucket that is only added to, the keys are enough
            old = _rows(spark, root, now, touched - anew).select(*keys, *[F.lit(None).cast(schema[c].dataType).alias(c) for c in rest])
            rows, total = rows.unionByName(old.withColumn(NEW, F.lit(0))), total + old.count()
        # Tasks take neighbouring pieces of the buckets, so rows are shuffled once and a bucket's files are few.
        cells, small = buckets * per, min(spark.sparkContext.defaultParallelism, math.ceil(total / 20_000))
        tasks = min(cells, math.ceil(max(math.ceil(total / TASK_ROWS), small) * buckets / len(touched)))
        rows = rows.withColumn(TASK, F.floor(piece.cast("bigint") * tasks / cells).cast("int"))
        unseen = F.raise_error(F.lit("the batch gave other keys when it was read again")).cast("int")
        dealt = rows.repartitionById(tasks, TASK).withColumn(BUCKET, F.when(bucket.isin(*touched), bucket).otherwise(unseen))
        out = one(dealt, [BUCKET, TASK])
        if keep == "first":
            out = out.filter((F.col(NEW) == 1) | F.col(BUCKET).isin(*anew))
        out.select(*schema.names, BUCKET).write.option("compression", "zstd").partitionBy(BUCKET).parquet(f"{root}/data/{folder}")
        full = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])
        written = spark.read.schema(full).parquet(f"{root}/data/{folder}").select(BUCKET).distinct().collect()
        parts = [p for p in parts if p[0] not in anew] + [(r[0], folder) for r in written]
    if batch_id is not None:
        writers[writer] = batch_id
    version = now.version + 1 if now else 0
    last = newest(spark, root)
    if (last.version if last else -1) != version - 1:
        raise RuntimeError(f"{root}: another writer committed version {last.version} meanwhile")
    record = [(version, buckets, _nullable(schema).json(), writers, sorted(parts))]
    # One record in one file: the rename that ends Spark's write is the commit.
    spark.createDataFrame(record, _RECORD).coalesce(1).write.mode("append").json(f"{root}/commits")
    return True


def _one_zero(field: T.StructField) -> Column:
    """The column, with -0.0 as 0.0: grouping holds them equal."""
    c = F.col(field.name)
    return F.when(c == 0, F.lit(0).cast(field.dataType)).otherwise(c) if isinstance(field.dataType, (T.FloatType, T.DoubleType)) else c


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
