"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.folders import new_folder

#: ASCII white space, as a class for Java and RE2 patterns.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _write(df: DataFrame, tag: str) -> str:
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, lost executors lose nothing. What a result still
    reads stays there; the owner of the folder removes it after use."""
    return df.sparkSession.read.schema(df.schema).parquet(_write(df, tag))


class Scratch:
    """The tables that one run of an operator writes for itself. `clear` removes them once nothing reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        path = _write(df, tag)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        for path in self.paths:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        self.paths = []


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def cut_text(text: Column, size: int, overlap: int = 0) -> Column:
    """The chunks of a text: `size` code points each, and the `overlap` after them as well; an empty text is one chunk.
    The text is gone through once, however long it is."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    blocks = F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(blocks)
    if not overlap:
        return blocks
    behind = lambda b, k: F.substring(F.array_join(F.slice(b, k + 2, -(-overlap // size)), ""), 1, overlap)
    return F.get(F.transform(F.array(blocks), lambda b: F.transform(b, lambda x, k: F.concat(x, behind(b, k)))), 0)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or a longer one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """Number rows without a shuffle. A second scan may give other numbers, since files are split by the cores that are
    there when it starts: what is read more than once has to be written first."""
    return df.withColumn(name, F.monotonically_increasing_id())


def global_rank(df: DataFrame, order: str, name: str) -> DataFrame:
    """0-based rank of distinct, non-null keys over all rows, without gathering them in one task.

    Rows are range-partitioned; each gets its place inside its partition plus the rows of all partitions before. Only
    the per-partition counts (as many as there are shuffle partitions) meet in one place."""
    parted = materialize(df.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()), "rank")
    counts = parted.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return parted.join(F.broadcast(offsets), "_part").withColumn(name, inner - 1 + F.col("_offset")).drop("_part", "_offset")


#: Parts that a group is joined in, so that no task gets a hot group whole: the bits of a long.
SALTS = 64


def with_salt(rows: DataFrame, row_id: str) -> DataFrame:
    return rows.withColumn("_salt", F.pmod(F.xxhash64(row_id), F.lit(SALTS)).cast("int"))


def salted_groups(salted: DataFrame, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """One row a group, with the parts that it has as a bit mask. Spark combines before the shuffle, so that a hot group
    reaches its task as one row of each map task."""
    return salted.groupBy(*keys).agg(*aggregates, F.bit_or(F.expr("shiftleft(1L, _salt)")).alias("_salts"))


def join_salted(salted: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Each row with its group; a group goes to those parts that it has, so a hot one is dealt to SALTS tasks."""
    parts = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.getbit("_salts", k) == 1)
    return salted.join(groups.withColumn("_salt", F.explode(parts)).drop("_salts"), [*keys, "_salt"], how).drop("_salt")


def join_groups(rows: DataFrame, keys: list[str], row_id: str, aggregates: list[Column], *, where: str | None = None, how: str = "inner") -> DataFrame:
    """rows with the aggregates of their group; rows are read twice. Groups that `where` leaves out take their rows with
    them, or with how="left" leave them without aggregates; so do null keys."""
    salted = with_salt(rows, row_id)
    groups = salted_groups(salted, keys, aggregates)
    return join_salted(salted, groups.where(where) if where else groups, keys, how)


#: Rows that a Python task turns into its own objects at once.
SLICE = 256


def add_columns(df: DataFrame, keep: list[str], make, fields: dict) -> DataFrame:
    """The columns `keep` of df and new ones, computed batch by batch in Python tasks.

    make() is called once a task and gives a function from a pyarrow RecordBatch to {name: list or array}; fields are
    {name: (SQL type, function that gives the pyarrow type)}. Kept columns pass through as they are, nulls included."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"`{k}` {types[k]}" for k in keep] + [f"`{k}` {sql}" for k, (sql, _) in fields.items()])

    def run(batches):
        import pyarrow as pa

        work = make()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                new = work(batch)
                arrays = [new[k] if isinstance(new[k], pa.Array) else pa.array(new[k], type=kind()) for k, (_, kind) in fields.items()]
                yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + arrays, names=[*keep, *fields])
            pa.default_memory_pool().release_unused()  # workers live on between stages

    return df.mapInArrow(run, schema)
