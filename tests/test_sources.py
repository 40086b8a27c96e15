"""Readers, stores, statistics, the stream, and the entry module."""

import sys

from pyspark.sql import functions as F

from cellweave import sources, stats
from cellweave.array import ArrayMeta, CellArray
from cellweave.functions import decode_cell, decode_point, encode_cell, encode_point
from cellweave.storage import ArrayStore


def test_array_store_keys_hold_shape(spark, tmp_path):
    s = ArrayStore(spark, f"file://{tmp_path}/arrays")
    a = CellArray.from_matrix(spark, [[1, 2], [3, 4]])
    k = s.add(a)
    assert s.add(CellArray.from_matrix(spark, [[1, 2], [3, 4]])) == k and s.add(CellArray.from_matrix(spark, [[1, 2, 3, 4]])) != k
    assert s.get(k).to_matrix() == [[1, 2], [3, 4]] and s.size(k) > 0


def test_text_sources(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("F\tD\tT\tC\tp1\tp2\nr0\t\tx\t\tY\tNA\nr1\t\tx\t\tN\tA \n")
    m = sources.read_tsv_matrix(spark, f"file://{tmp_path}/m.tsv")
    assert m.to_matrix() == [["r0", "", "x", "", "Y", "NA"], ["r1", "", "x", "", "N", "A "]]
    assert sources.read_tsv_matrix(spark, f"file://{tmp_path}/m.tsv", replicate=3).to_matrix()[1][4:] == ["N", "A "] * 3
    (tmp_path / "g.txt").write_text("g1 1 2\ng2  3 4\n\ng1 5 6 7\n")
    train, test = sources.read_gene_text(spark, f"file://{tmp_path}/g.txt")
    assert train.to_matrix() == [[1, 2], [3, 4]] and test.to_matrix() == [[5, 6, 7]]
    (tmp_path / "t.csv").write_text("a,2011-01-01T00:00:00Z,1.5,2.5,,,,,,\nbad,line\nb,nodate,1,2,,,,,,\n")
    assert [tuple(r) for r in sources.read_gps_csv(spark, f"file://{tmp_path}/t.csv").collect()] == [("a", 1293840000, 1.5, 2.5)]


def test_generators(spark):
    a, b = sources.star_image(spark, 50).to_matrix(), sources.star_image(spark, 50).to_matrix()
    assert a == b and max(map(max, a)) == 2000.0
    c = sources.zipf_cdf(5)
    assert abs(c[-1] - 1) < 1e-12 and c == sorted(c)
    r = sources.region_pairs(spark, 100, 25, 9).collect()
    assert len(r) == 4 and {len(x.outs) for x in r} == {25} and {len(x.ins) for x in r} == {9}


def test_cell_codes_go_past_32_bits(spark):
    n = 10**6
    i, j = decode_cell(F.col("c"), n)
    r = spark.range(1).select(encode_cell(F.lit(987654321), F.lit(123456), n).alias("c")).select("c", i.alias("i"), j.alias("j")).first()
    assert (r.c, r.i, r.j) == (987654321 * n + 123456, 987654321, 123456)
    code = encode_point([F.lit(3), F.lit(1), F.lit(4)], [9, 5, 7])
    back = spark.range(1).select(code.alias("c")).select(*[x.alias(f"x{k}") for k, x in enumerate(decode_point(F.col("c"), [9, 5, 7]))]).first()
    assert tuple(back) == (3, 1, 4)


def test_statistics_tables(spark, tmp_path):
    s = stats.Statistics(spark, f"file://{tmp_path}/stats")
    assert s.table("exec").count() == 0
    s.append("exec", [(1, 0.0, 10, 10, 0, "stats", "", 0, "", None, None, None), (2, 0.0, 10, 10, 0, "opt", "", 1, "", None, None, None)])
    s.finish(1)
    assert [r.id for r in stats.matching_noops(s.table, 0, (10, 10)).collect()] == [1]
    assert [r.id for r in stats.similar(s.table, 1).collect()] == [2]
    s.append("workflow_run", [(7, 1, 1, 3, "Conv", "Q", 9.0, 1.0, 4.0, 16.0, 0.5, 0.0)])
    s.append("workflow_inputs", [(7, 0, 16.0)])
    s.append("capture_shape", [(7, 0, 9.0, 9.0, 1.0)])
    s.append("capture_cost", [(7, 0.0, 0.25, 0.0, 2097152.0, 0.0)])
    row = stats.op_stats(s.table, [1]).first()
    assert row["fanin"] == 9.0 and row["inputsize"] == 16.0
    assert stats.disk_of(s.table, 1, "Conv", "Q") == 2.0 and stats.overhead_of(s.table, 1, "none", "Q", 5.0) == 5.0


def test_stream_segments(spark, tmp_path):
    from cellweave.streaming import stream_segments

    rows = [("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-01 00:01:00", 2.0), ("b", "2024-01-01 00:00:30", 5.0), ("a", "2024-01-01 03:00:00", 9.0)]
    spark.createDataFrame(rows, "id string, time string, value double").select("id", F.to_timestamp("time").alias("time"), "value").coalesce(1).write.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema("id string, time timestamp, value double").parquet(f"{tmp_path}/in")
    q = stream_segments(src).writeStream.format("memory").queryName("segs").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.id, r.n, r.total) for r in spark.sql("select * from segs").collect()] == [("a", 2, 3.0)]


def test_entry_module(spark):
    import __spark_entry__ as e

    assert "flagship" in e.queries() and "flagship" in e.oracle_sql()
    assert e.entry(spark).columns == ["i", "j"] and e.entry(spark).count() >= 0
    assert not any(k not in e.queries() for k in e.oracle_sql())
    assert "cellweave" in sys.modules


def test_meta():
    assert ArrayMeta(3, 4).size == 12
