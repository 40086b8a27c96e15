"""Execution statistics: eleven tables, and the queries that analysis and prediction ask of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.strategy import MAP

#: Table schemas; ids are explicit columns.
SCHEMAS = {
    "exec": "id long, time double, width long, height long, runmode long, runtype string, logdir string, finished long, notes string, diskconstraint double, runconstraint double, modelparamseid long",
    "exec_stats": "eid long, disk double",
    "opt_mappings": "eid long, opid long, op string, strat string",
    "workflow_run": "wid long, eid long, runid long, opid long, op string, strat string, nptrs double, oclustsize double, noutcells double, outputsize double, opcost double, outputdisk double",
    "workflow_inputs": "wid long, arridx long, area double",
    "capture_cost": "wid long, save double, overhead double, serialize double, disk double, idx double",
    "capture_shape": "wid long, arridx long, fanin double, area double, density double",
    "pq": "pqid long, eid long, runid long, forward long, cost double, maxres double",
    "pq_inputs": "pqid long, arridx long, ncells long",
    "pq_path": "pqid long, idx long, opid long, op string",
    "iq": "iqid long, pqid long, opid long, op string, arridx long, strat string, noutputs double, ninputs double, forward long, cost double",
}


class Statistics:
    """Append-only Parquet tables under a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def append(self, table: str, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, SCHEMAS[table]).coalesce(1).write.mode("append").parquet(f"{self.root}/{table}")

    def finish(self, eid: int) -> None:
        """Mark an execution as finished: a later row replaces the earlier one."""
        row = self.table("exec").filter(F.col("id") == eid).first()
        self.append("exec", [tuple({**row.asDict(), "finished": 1}.values())])

    def table(self, name: str) -> DataFrame:
        try:
            df = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}")
            df.limit(1).count()
        except Exception as e:  # a table without rows has no folder yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], SCHEMAS[name])
        if name == "exec":
            return df.groupBy("id").agg(F.max_by(F.struct(*df.columns), "finished").alias("r")).select("r.*")
        return df


def matching_noops(t, runmode: int, shape: tuple[int, int], disk=None, runc=None) -> DataFrame:
    q = t("exec").filter((F.col("runmode") == runmode) & (F.col("width") == shape[0]) & (F.col("height") == shape[1]) & (F.col("finished") == 1) & (F.col("runtype") == "stats"))
    return (q if disk is None else q.filter((F.col("diskconstraint") == disk) & (F.col("runconstraint") == runc))).select("id")


def similar(t, eid: int, series: bool = False, disk=None, runc=None) -> DataFrame:
    """Finished executions of the same shape and mode; ``series``: optimized ones only."""
    one = t("exec").filter(F.col("id") == eid).select("width", "height", "runmode")
    q = t("exec").join(F.broadcast(one), ["width", "height", "runmode"]).filter("finished = 1")
    q = q.filter(F.substring("runtype", 1, 3) == "opt") if series else q.filter(~F.col("runtype").isin("noop", "stats"))
    if series and disk is not None and runc is not None:
        q = q.filter((F.col("diskconstraint") == disk) & (F.col("runconstraint") == runc))
    return q.select("id")


def store_stats(t, eids: list[int]) -> DataFrame:
    q = t("capture_shape").join(t("workflow_run").filter(F.col("eid").isin(eids) & (F.col("strat") != str(MAP))), "wid")
    return q.groupBy("opid", "arridx").agg(*[F.avg(c).alias(c) for c in ("fanin", "area", "density", "nptrs", "oclustsize", "noutcells", "opcost")])


def op_stats(t, eids: list[int]) -> DataFrame:
    """(opid, arridx) and the nine averages, in the order that prediction takes them."""
    ps = t("capture_shape")
    q = t("workflow_run").filter(F.col("eid").isin(eids)).join(t("workflow_inputs").withColumnRenamed("area", "inputsize"), "wid").join(ps, ["wid", "arridx"])
    return q.groupBy("opid", "arridx").agg(*[F.avg(c).alias(c) for c in ("fanin", "area", "density", "oclustsize", "nptrs", "noutcells", "outputsize", "inputsize", "opcost")])


def array_sizes(t, eid: int, opid: int, arridx: int) -> DataFrame:
    q = t("workflow_run").filter((F.col("eid") == eid) & (F.col("opid") == opid)).join(t("workflow_inputs").filter(F.col("arridx") == arridx), "wid")
    return q.agg(F.avg("area").alias("insize"), F.avg("outputsize").alias("outsize"))


def selectivity(t, forward: bool) -> DataFrame:
    """(eid, opid, arridx): average cells out per cell in, number of queries, average cells in; finished executions only."""
    per = F.try_divide(F.col("noutputs"), F.col("ninputs") + (1 if forward else 0))
    q = t("iq").filter(F.col("forward") == int(forward)).join(t("pq").select("pqid", "eid"), "pqid").join(t("exec").filter("finished = 1").select(F.col("id").alias("eid")), "eid")
    return q.groupBy("eid", "opid", "arridx").agg(F.avg(per).alias("sel"), F.count(F.lit(1)).alias("n"), F.avg("ninputs").alias("size"))


def disk_of(t, runid: int, op: str, strat: str, default: float = 0.0) -> float:
    row = t("workflow_run").filter((F.col("runid") == runid) & (F.col("op") == op) & (F.col("strat") == strat)).join(t("capture_cost"), "wid").select(F.col("disk") / 1048576.0).first()
    return row[0] if row else default


def overhead_of(t, runid: int, op: str, strat: str, default: float = 0.0) -> float:
    row = t("workflow_run").filter((F.col("runid") == runid) & (F.col("op") == op) & (F.col("strat") == strat)).join(t("capture_cost"), "wid").select("overhead").first()
    return row[0] if row else default


def overheads(t) -> DataFrame:
    """Capture overhead and disk (MiB) of each operator and strategy, largest first."""
    q = t("workflow_run").join(t("capture_cost"), "wid")
    return q.groupBy("op", "strat").agg(F.avg("overhead").alias("overhead"), (F.avg("disk") / 1048576.0).alias("disk"), F.avg("opcost").alias("opcost"))


def query_costs(t) -> DataFrame:
    """Average cost of path queries by run type and direction, next to the overheads of their runs."""
    runs = t("workflow_run").join(t("capture_cost"), "wid").groupBy("eid", "runid").agg(F.sum("overhead").alias("overhead"), F.sum("disk").alias("disk"))
    q = t("pq").join(t("exec").select(F.col("id").alias("eid"), "runtype"), "eid").join(runs, ["eid", "runid"])
    return q.groupBy("runtype", "forward").agg(F.avg("cost").alias("cost"), F.avg("overhead").alias("overhead"), F.avg("disk").alias("disk"))


def normalized(t) -> DataFrame:
    """Each execution's disk against the baseline of the same run mode."""
    base = t("exec").filter("runtype = 'noop'").select("runmode", F.col("id").alias("beid")).join(t("exec_stats").select(F.col("eid").alias("beid"), F.col("disk").alias("base")), "beid")
    q = t("exec").join(t("exec_stats"), F.col("id") == F.col("eid")).join(base, "runmode")
    return q.select("id", "runtype", "runmode", F.try_divide("disk", "base").alias("ratio"))


def paths(t) -> DataFrame:
    """(pqid, path): operators of each path query in order."""
    return t("pq_path").groupBy("pqid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "op"))), lambda x: x["op"]), ",").alias("path"))


def pivot_strategies(t, value: str = "overhead") -> DataFrame:
    q = t("workflow_run").join(t("capture_cost"), "wid")
    return q.groupBy("op").pivot("strat").agg(F.avg(value))
