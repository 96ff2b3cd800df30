"""Delimited files with irregular headers, layouts and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The 13 columns of the grid microdata file; the newer layout has a header and a leading year.
GRID_COLUMNS = ["grid_code", "x", "y", "release_no", "chemical_no", "facility_no", "media", "conc", "tox_conc",
                "score", "ct_conc", "nct_conc", "pop"]
_GRID_INTS = {"grid_code", "x", "y", "release_no", "media"}
_GRID_TEXT = {"chemical_no", "facility_no"}


def _plain(header: str) -> str:
    return header.lstrip("\ufeff").split(".")[0].strip()


def read_decorated_csv(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """CSV whose headers read ``65. ON-SITE TOTAL``: columns come back named by the number before the dot.

    Each file's own header says where a column stands, so files may differ in order and in the columns they have; a
    column that a file lacks is null in its rows. Files of one layout are read together. All values stay text, short
    records are padded with null, and no inference pass is run over the data. A byte-order mark before the first header
    is dropped.
    """
    want = [_plain(n) for n in names]
    layouts: dict[tuple[str, ...], list[str]] = {}
    for file in sorted(spark.read.text(path).inputFiles()):
        layouts.setdefault(tuple(map(_plain, header_of(spark, file))), []).append(file)
    out = spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType()) for n in want]))
    for layout, files in layouts.items():
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(layout))])
        rows = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(files)
        out = out.unionByName(rows.select(*[
            (F.col(f"c{layout.index(n)}") if n in layout else F.lit(None).cast("string")).alias(n) for n in want]))
    return out


def header_of(spark: SparkSession, path: str) -> list[str]:
    """The header cells of one CSV file, from its first line."""
    return spark.read.option("header", True).csv(path).columns


def _grid_schema(with_year: bool) -> T.StructType:
    fields = [T.StructField("year", T.IntegerType())] if with_year else []
    for c in GRID_COLUMNS:
        t = T.IntegerType() if c in _GRID_INTS else T.StringType() if c in _GRID_TEXT else T.DoubleType()
        fields.append(T.StructField(c, t))
    return T.StructType(fields)


def read_grid_microdata(spark: SparkSession, path: str, year: int | None = None) -> DataFrame:
    """Gzip grid rows in either layout, told apart by the first line (one line is read, not the file).

    A gzip file is one task; ``store_grid`` rewrites it once so that later reads split and prune.
    """
    first = spark.read.text(path).limit(1).first()[0]
    cells = first.count(",") + 1
    if cells == len(GRID_COLUMNS) + 1:
        return spark.read.schema(_grid_schema(True)).option("header", True).csv(path)
    if cells != len(GRID_COLUMNS):
        raise ValueError(f"{path}: {cells} columns, expected 13 or 14")
    if year is None:
        raise ValueError("the 13-column layout carries no year; pass it")
    return spark.read.schema(_grid_schema(False)).csv(path).select(F.lit(year).alias("year"), *GRID_COLUMNS)


def store_grid(df: DataFrame, path: str) -> None:
    """Rewrite for pruning: partition by year, rows of a tile of cells together and sorted by cell.

    The rows are read once (a range sort would sample, that is decompress, them twice); a tile that is too big for one
    file is split by the adaptive rebalance.
    """
    tile = F.struct(F.floor(F.col("x") / 64), F.floor(F.col("y") / 64))
    (df.withColumn("__tile", tile).hint("rebalance", F.col("year"), F.col("__tile")).drop("__tile")
     .sortWithinPartitions("year", "x", "y").write.mode("overwrite").partitionBy("year").parquet(path))


def coverage(present: DataFrame, years: Sequence[int] | DataFrame, parts: DataFrame, year: str, part: str) -> DataFrame:
    """Expected year x part partitions with whether each is there. An absent one is unknown, not zero.

    ``parts`` holds the distinct part names (state codes); the grid is years x parts, so it is small by nature.
    """
    yrs = years if isinstance(years, list) else list(years)
    grid = parts.select(part).distinct().withColumn(year, F.explode(F.array(*[F.lit(int(y)) for y in yrs])))
    have = present.select(F.col(year).cast("int").alias(year), part).distinct().withColumn("present", F.lit(True))
    return grid.join(have, [year, part], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def complete_years_only(df: DataFrame, cover: DataFrame, year: str) -> DataFrame:
    """Rows of years in which every expected part is present; a year missing any part is dropped whole."""
    ok = cover.groupBy(year).agg(F.bool_and("present").alias("__ok")).where("__ok").select(year)
    return df.join(ok, year, "left_semi")


def unpivot_inventory(df: DataFrame, ids: Sequence[str], measures: Sequence[str], name: str = "pollutant",
                      value: str = "value") -> DataFrame:
    """Wide annual inventory to long rows; blanks are dropped, so absence means not reported."""
    return df.unpivot(list(ids), list(measures), name, value).where(F.col(value).isNotNull())


def read_plot_file(spark: SparkSession, path: str) -> DataFrame:
    """Receptor rows of a dispersion plot file; only long-term (PERIOD, ANNUAL) averages are returned.

    The averaging period comes from the rows, never from the file name.
    """
    t = F.split(F.trim(F.col("value")), r"\s+")
    num = lambda i: t[i].try_cast("double")
    d = spark.read.text(path).where(~F.col("value").startswith("*")).where(F.size(t) >= 8)
    d = d.select(num(0).alias("x"), num(1).alias("y"), num(2).alias("conc"), num(3).alias("zelev"),
                 num(4).alias("zhill"), num(5).alias("zflag"), F.upper(t[6]).alias("ave"), F.upper(t[7]).alias("grp"))
    numeric = F.lit(True)
    for c in ("x", "y", "conc", "zelev", "zhill", "zflag"):
        numeric = numeric & F.col(c).isNotNull()
    return d.where(numeric & F.col("ave").isin("PERIOD", "ANNUAL"))
