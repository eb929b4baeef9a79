"""Prepare a point table: cast, drop, bound, number and describe; read and write its files."""

from __future__ import annotations

import json
import operator
from dataclasses import asdict, dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPARE = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "==": operator.eq, "!=": operator.ne}


@dataclass
class Dataset:
    """dims: name -> closed bounds; drop_if: (column, comparison, value)."""

    dims: dict[str, tuple[float, float]]
    measures: list[str]
    drop_if: list[tuple[str, str, float]] = field(default_factory=list)
    max_rows: int | None = None
    order_by: list[str] = field(default_factory=list)


def as_double(df: DataFrame, name: str) -> Column:
    """Numbers, booleans, times (epoch seconds, UTC) and parseable strings; NaN becomes null."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(c.cast("timestamp")) / 1e6
    if isinstance(kind, T.StringType):
        out = F.expr(f"try_cast(`{name}` AS double)")
    elif isinstance(kind, T.BooleanType):
        out = c.cast("int").cast("double")
    elif isinstance(kind, T.NumericType):
        out = c.cast("double")
    else:
        raise ValueError(f"{name}: a {kind.simpleString()} can't become a number")
    return F.when(~F.isnan(out), out)


def prepare(df: DataFrame, spec: Dataset, row_id: str = "row_id") -> DataFrame:
    """row_id, dimensions and measures of the rows that stay. A column row_id is taken as it is, else rows are numbered.

    max_rows are the first by order_by, or by row_id if that is a column.
    """
    names = [*spec.dims, *spec.measures, *[c for c, _, _ in spec.drop_if]]
    if missing := [n for n in names + spec.order_by if n not in df.columns]:
        raise ValueError(f"no columns {missing}; there are {df.columns}")
    order = spec.order_by or ([row_id] if row_id in df.columns else [])
    if spec.max_rows is not None and not order:
        raise ValueError("max_rows needs order_by or a column row_id, or which rows stay is left to chance")
    own = F.col(row_id).cast("long") if row_id in df.columns else F.monotonically_increasing_id()
    keep = [n for n in dict.fromkeys(names) if n != row_id]
    out = df.select(own.alias(row_id), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], *[as_double(df, n).alias(n) for n in keep])
    for c, op, v in spec.drop_if:
        out = out.where(~F.coalesce(COMPARE[op](F.col(c), F.lit(float(v))), F.lit(False)))
    for d, (lo, hi) in spec.dims.items():
        out = out.where(F.col(d).isNotNull() & F.col(d).between(lo, hi))
    if spec.max_rows is not None:
        out = out.orderBy(*[f"__o{i}" for i in range(len(order))], row_id).limit(spec.max_rows)
    return out.select(row_id, *[c for c in dict.fromkeys([*spec.dims, *spec.measures]) if c != row_id])


def describe(points: DataFrame, measures: list[str]) -> DataFrame:
    """measure, non_nan_count, nan_count, sum, sum_sq, min, max: one scan, a row a measure."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    stats = lambda m: F.struct(F.lit(m).alias("measure"), F.count(m).alias("non_nan_count"), F.count_if(F.col(m).isNull()).alias("nan_count"), zero(F.sum(m)).alias("sum"), zero(F.sum(F.col(m) * F.col(m))).alias("sum_sq"), zero(F.min(m)).alias("min"), zero(F.max(m)).alias("max"))
    return points.agg(F.array(*[stats(m) for m in measures]).alias("x")).select(F.inline("x"))


def gather(points: DataFrame, ids: DataFrame, columns: list[str], row_id: str = "row_id", most: int = 100_000) -> DataFrame:
    """place and columns for every row of ids (place, row_id), in any number of copies; sorted by place this is the order asked for.

    IndexError if an id is asked for that no row has. Up to ``most`` ids
    (counted) are sent to all tasks, so that points aren't shuffled.
    """
    small = ids.limit(most + 1).count() <= most
    asked = ids.select("place", F.col(row_id))
    own = points.select(row_id, *columns)
    lost = asked.select(row_id).distinct().join(own.select(row_id), row_id, "left_anti").head(1)
    if lost:
        raise IndexError(f"no row with {row_id} {lost[0][0]}")
    return own.join(F.broadcast(asked) if small else asked, row_id).select("place", row_id, *columns)


def read_csv(spark: SparkSession, path: str, sep: str = ",", header: bool = True, null: str = "", time_formats: tuple[str, ...] = ()) -> DataFrame:
    """Typed CSV; without a header columns are col and their place. A column of texts that all parse by the time formats is a timestamp."""
    if sep not in (",", "\t"):
        raise ValueError("fields are parted by a comma or a tab")
    df = spark.read.options(sep=sep, header=header, nullValue=null, emptyValue="", nanValue="NaN", inferSchema=True, timestampFormat="yyyy-MM-dd HH:mm:ss").csv(path)
    if null:  # besides the spelling given, an empty field is missing too
        df = df.select(*[F.when(F.trim(F.col(f"`{f.name}`")) != "", F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema.fields])
    if not header:
        width = len(str(max(len(df.columns) - 1, 0)))
        df = df.toDF(*[f"col{i:0{width}d}" for i in range(len(df.columns))])
    for f in df.schema.fields:
        if time_formats and isinstance(f.dataType, T.StringType):
            parsed = F.coalesce(*[F.try_to_timestamp(F.col(f.name), F.lit(x)) for x in (*time_formats, "yyyy-MM-dd HH:mm:ss")])
            if not df.where(F.col(f.name).isNotNull() & parsed.isNull()).head(1):
                df = df.withColumn(f.name, parsed)
    return df


def write(points: DataFrame, path: str, overwrite: bool = False, cluster: list[str] | None = None) -> None:
    """Parquet with zstd; cluster: columns to range-partition and sort by, so that scans skip row groups."""
    if cluster:
        points = points.repartitionByRange(*cluster).sortWithinPartitions(*cluster)
    points.write.mode("overwrite" if overwrite else "error").option("compression", "zstd").parquet(path)


def manifest(points: DataFrame, spec: Dataset) -> str:
    """JSON of columns, bounds, rows and the measures' statistics."""
    rows = [r.asDict() for r in describe(points, spec.measures).collect()]  # a row a measure
    return json.dumps({"dimensions": [{"name": d, "low": lo, "high": hi} for d, (lo, hi) in spec.dims.items()], "measures": rows, "row_count": points.count()})


def write_manifest(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    """A manifest that has all that validate() wants; ValueError else."""
    return validate(json.loads("".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())))


def validate(told: dict) -> dict:
    """ValueError unless there are dimensions with low <= high, measures whose counts add up to the rows, and no name twice."""
    if bad := [k for k in ("dimensions", "measures", "row_count") if k not in told]:
        raise ValueError(f"no {bad}")
    if not told["dimensions"] or not all({"name", "low", "high"} <= d.keys() and d["low"] <= d["high"] for d in told["dimensions"]):
        raise ValueError("each dimension needs a name, low and high, and low must not be over high")
    if not all({"measure", "non_nan_count", "nan_count", "sum", "sum_sq", "min", "max"} <= m.keys() for m in told["measures"]):
        raise ValueError("each measure needs its statistics")
    if any(m["non_nan_count"] + m["nan_count"] != told["row_count"] or (m["non_nan_count"] and m["min"] > m["max"]) for m in told["measures"]):
        raise ValueError("a measure's counts don't add up to row_count, or its min is over its max")
    names = [d["name"] for d in told["dimensions"]] + [m["measure"] for m in told["measures"]]
    if len(set(names)) < len(names):
        raise ValueError(f"a name is there twice: {names}")
    return told


@dataclass
class Source:
    """A data set to prepare: Parquet files to read, or columns to make up (``synthetic.generate``)."""

    spec: Dataset
    parquet: str | None = None
    rows: int = 0
    columns: list = field(default_factory=list)
    seed: int = 0


def stamp(spark: SparkSession, source: Source) -> str:
    """What a prepared data set depends on: the specification, and the files' paths, sizes and times."""
    files = []
    if source.parquet:
        where = spark._jvm.org.apache.hadoop.fs.Path(source.parquet)
        seen = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(where)
        files = sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in seen)
    return json.dumps([asdict(source), files], sort_keys=True, default=str)


def ensure(spark: SparkSession, source: Source, path: str) -> bool:
    """Prepare source under path (points and manifest) unless what is there was made of the same; whether it was made now."""
    from .synthetic import generate

    own = stamp(spark, source)
    try:
        if "".join(r["value"] for r in spark.read.text(f"{path}/stamp", wholetext=True).collect()).strip() == own:
            read_manifest(spark, f"{path}/manifest")
            return False
    except AnalysisException:
        pass  # nothing is there yet
    raw = spark.read.parquet(source.parquet) if source.parquet else generate(spark, source.rows, source.columns, source.seed)
    write(prepare(raw, source.spec), f"{path}/points", overwrite=True)
    points = spark.read.parquet(f"{path}/points")
    write_manifest(spark, manifest(points, source.spec), f"{path}/manifest")
    write_manifest(spark, own, f"{path}/stamp")  # last, so a preparation that was cut short is made again
    return True
