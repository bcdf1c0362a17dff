"""Headline queries; prints one JSON line.  BENCH_SF_DIR and BENCH_CPUS set the input and the cores."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from tsqlspark import queries as Q

SHAPES = {
    "filter_project": "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_discount > 0.05",
    "group_agg": "SELECT l_returnflag, COUNT(*) AS cnt, AVG(l_quantity) AS a FROM lineitem GROUP BY l_returnflag",
    "filter_sort": "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_discount < 0.01 ORDER BY l_extendedprice",
    "join": "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey",
    "semi_join": Q.SELECTS["exists_corr"][0],
    "anti_join": Q.SELECTS["not_exists_corr"][0],
}


def timed(f, runs: int = 5) -> float:
    f()
    took = []
    for _ in range(runs):
        t = time.perf_counter()
        f()
        took.append(time.perf_counter() - t)
    return round(statistics.median(took), 4)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    s = Q.session(spark, folder)
    got = {k: timed(lambda sql=sql: s.sql(sql).write.format("noop").mode("overwrite").save()) for k, sql in SHAPES.items()}
    s.run("CREATE TABLE t (a INT, b FLOAT, c VARCHAR)")
    got["bulk_insert"] = timed(lambda: s.run("INSERT INTO t SELECT l_orderkey, l_extendedprice, l_returnflag FROM lineitem"), 3)
    s.run("CREATE TABLE pk (id INT PRIMARY KEY, q FLOAT CHECK (q >= 0))")

    def constrained():
        s.run("DELETE FROM pk")
        s.run("INSERT INTO pk SELECT o_orderkey, o_totalprice FROM orders")

    got["constraint_check"] = timed(constrained, 3)
    s.run("CREATE TABLE one (id INT)")
    t = time.perf_counter()
    for i in range(20):
        s.run(f"INSERT INTO one VALUES ({i})")
    got["single_insert"] = round((time.perf_counter() - t) / 20, 4)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(got.values()), 3), "unit": "sec", "queries": got, "sf": folder.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
