"""Readers of the array world's file formats, and deterministic generators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..array import ArrayMeta, CellArray, domain
from ..storage import written


def read_tsv_matrix(spark: SparkSession, path: str, replicate: int = 1, keep: int = 4) -> CellArray:
    """A tab-separated string matrix less its header line; ``replicate`` repeats the columns after the first ``keep``.

    Row numbers follow the file: lines are numbered by file offset order within
    one file, so a matrix is one file. Blank fields stay empty strings.
    """
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\r", ""), "\n")).alias("line", "text"))
    rows = text.filter("line > 0 AND text <> ''").select((F.col("line") - 1).cast("long").alias("i"), F.split("text", "\t", -1).alias("f"))
    cells = written(rows.select("i", F.posexplode("f").alias("j", "v")), "tsv")
    shape = cells.agg(F.max("i"), F.max("j")).first()
    n, m = (shape[0] + 1, shape[1] + 1) if shape[0] is not None else (0, 0)
    if replicate > 1:
        width = m - keep
        more = cells.filter(F.col("j") >= keep).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(replicate - 1))))
        cells = cells.union(more.select("i", (F.col("j") + F.col("k") * width).cast("int"), "v"))
        m = keep + width * replicate
    return CellArray(cells, ArrayMeta(n, m, "string"))


def read_gene_text(spark: SparkSession, path: str) -> tuple[CellArray, CellArray]:
    """(training, test) arrays from lines of a name and numbers; a blank line stands between them."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "text"))
    lines = written(lines.withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " "))), "genes")
    cut = lines.filter("text = ''").agg(F.min("at")).first()[0]
    out = []
    for part in (lines.filter(F.col("at") < F.lit(cut if cut is not None else 2**30)), lines.filter(F.col("at") > F.lit(cut if cut is not None else 2**30))):
        rows = part.filter("text <> ''").select("at", F.slice(F.split("text", " "), F.lit(2), F.lit(1_000_000)).alias("f"))
        base = rows.agg(F.min("at")).first()[0] or 0
        cells = rows.select((F.col("at") - base).cast("long").alias("i"), F.posexplode("f").alias("j", "v")).select("i", "j", F.col("v").cast("double").alias("v"))
        shape = cells.agg(F.max("i"), F.max("j")).first()
        out.append(CellArray(cells, ArrayMeta((shape[0] if shape[0] is not None else -1) + 1, (shape[1] if shape[1] is not None else -1) + 1)))
    return out[0], out[1]


def read_gps_csv(spark: SparkSession, path: str) -> DataFrame:
    """(id, ts, lat, lon) of lines with ten fields; ts in seconds since 1970, lines that don't parse are left out."""
    f = F.split(F.col("value"), ",", -1)
    rows = spark.read.text(path).filter(F.size(f) == 10)
    ts = F.unix_timestamp(F.try_to_timestamp(f[1], F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))
    return rows.select(f[0].alias("id"), ts.alias("ts"), f[2].try_cast("double").alias("lat"), f[3].try_cast("double").alias("lon")).dropna()


def write_array(a: CellArray, path: str) -> None:
    a.df.write.mode("overwrite").parquet(path)


def read_array(spark: SparkSession, path: str, meta: ArrayMeta) -> CellArray:
    return CellArray(spark.read.parquet(path), meta)


def star_image(spark: SparkSession, n: int, stars: int = 10, radius: int = 4, rays: int = 30, seed: int = 7, brightness: float = 2000.0) -> CellArray:
    """An n x n image: discs of falling brightness and single bright cells, placed by arithmetic from the seed."""
    meta = ArrayMeta(n, n)
    place = lambda k, a, b: ((k * a + seed * 31) % n, (k * b + seed * 17) % n)
    centres = spark.createDataFrame([(*map(int, place(k + 1, 7919, 6101)),) for k in range(stars)], "ci long, cj long")
    single = spark.createDataFrame([(*map(int, place(k + 1, 5003, 4409)),) for k in range(rays)], "i long, j long").distinct().withColumn("ray", F.lit(brightness))
    near = F.sequence(F.lit(-radius), F.lit(radius))
    disc = centres.withColumn("a", F.explode(near)).withColumn("b", F.explode(near)).filter(F.col("a") ** 2 + F.col("b") ** 2 <= radius**2)
    disc = disc.select((F.col("ci") + F.col("a")).alias("i"), (F.col("cj") + F.col("b")).alias("j"), (brightness / (1 + F.col("a") ** 2 + F.col("b") ** 2)).alias("star"))
    disc = disc.groupBy("i", "j").agg(F.max("star").alias("star"))
    df = domain(spark, meta).join(F.broadcast(disc), ["i", "j"], "left").join(F.broadcast(single), ["i", "j"], "left")
    return CellArray(df.select("i", "j", F.greatest(F.coalesce("star", F.lit(0.0)), F.coalesce("ray", F.lit(0.0))).alias("v")), meta)


def zipf_cdf(n: int, s: float = 1.9) -> list[float]:
    """Cumulative shares of the ranks 1 to n under Zipf's law."""
    w = [1 / k**s for k in range(1, n + 1)]
    total, out, at = sum(w), [], 0.0
    for x in w:
        at += x / total
        out.append(at)
    return out


def region_pairs(spark: SparkSession, n: int, fanout: int, fanin: int, side: int = 1000, density: float = 1.0, seed: int = 0) -> DataFrame:
    """(outs, ins) of n / fanout clustered regions: squares of cells around hashed centres, inputs thinned to the density."""
    count = max(1, n // fanout)
    wide, deep = max(1, round((fanin / density) ** 0.5 + 0.4999)), max(1, round(fanout**0.5 + 0.4999))
    at = lambda salt, span: F.pmod(F.xxhash64("id", F.lit(seed * 8 + salt)), F.lit(max(1, side - span)))
    square = lambda span, k: F.slice(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(span - 1)), lambda a: F.transform(F.sequence(F.lit(0), F.lit(span - 1)), lambda b: a * side + b))), F.lit(1), F.lit(k))
    pairs = spark.range(count).withColumns({"o": at(1, deep) * side + at(2, deep), "n": at(3, wide) * side + at(4, wide)})
    step = max(1, round(1 / density))
    thin = F.slice(F.filter(square(wide, wide * wide), lambda c, k: k % step == 0), F.lit(1), F.lit(fanin))
    shift = lambda a, by: F.transform(a, lambda c: (c + F.col(by)).cast("long"))
    return pairs.select(shift(square(deep, fanout), "o").alias("outs"), shift(thin, "n").alias("ins"))
