"""Registered queries over listings: texts of schedulers and machines are made of the driver tables and parsed again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text
from quillon.plans.queries import LISTED, query
from quillon.session import table
from quillon.sources import parsers


def order_columns() -> tuple[Column, Column]:
    return F.col("o_orderkey"), F.col("o_orderstatus")


def said(*parts: Column | str) -> Column:
    """Parts in a row: texts as they are, columns as text."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def blobs(rows: DataFrame, key: Column, number: Column, line: Column, head: str = "", tail: str = "") -> DataFrame:
    """id, value: one text for every key and block of LISTED numbers, a line for each row, in the order of the lines."""
    grouped = rows.groupBy(key.alias("id"), F.floor(number / LISTED).alias("_block"))
    return grouped.agg(F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list(line)), "\n"), F.lit(tail)).alias("value")).drop("_block")


@query("""SELECT o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS job_id, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'CANCELLED' ELSE 'odd State' END AS state,
    CAST(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 3 WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 5 ELSE 0 END AS INT) AS exit_code FROM orders""")
def accounting_listing(spark: SparkSession, sf: str) -> DataFrame:
    k, s = order_columns()
    state = F.when(s == "F", "COMPLETED").when(s == "O", "cancelled by 7").otherwise("odd State")
    value = said(k, ".batch|FAILED|1:0\n", k, "|", state, "|", k % 3, ":", k % 5, "\n", k, "|COMPLETED|0:0")
    return parsers.sacct(table(spark, sf, "orders").select(k.alias("id"), k.cast("string").alias("job_id"), value.alias("value")))


@query(f"""SELECT DISTINCT c_nationkey * 1000000 + c_custkey // {LISTED} AS id, c_mktsegment AS name FROM customer""")
def partition_listing(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    listing = blobs(table(spark, sf, "customer"), F.col("c_nationkey") * 1_000_000 + F.floor(k / LISTED), k, said(" ", F.col("c_mktsegment"), F.when(k % 2 == 0, "*").otherwise("")), tail="\n\n")
    return parsers.sinfo(listing).select("id", "name")


@query("""SELECT o_custkey AS id, CASE WHEN o_custkey % 2 = 0 THEN o_orderkey || '.srv' ELSE CAST(o_orderkey AS VARCHAR) END AS job_id, 'job' || o_orderkey AS name,
    CASE WHEN o_custkey % 2 = 0 THEN CASE o_orderstatus WHEN 'O' THEN 'R' WHEN 'F' THEN 'F' ELSE 'odd' END ELSE CASE o_orderstatus WHEN 'O' THEN 'R' WHEN 'F' THEN 'F' ELSE 'ODD' END END AS state,
    'q' || (o_orderkey % 4) AS queue FROM orders WHERE o_custkey % 2 = 0 OR o_orderkey % 5 > 0""")
def queue_layouts(spark: SparkSession, sf: str) -> DataFrame:
    """Standard listings of even customers, with and without a time, and wide ones of odd customers, some lines too short."""
    k, s = order_columns()
    orders = table(spark, sf, "orders")
    letter = F.when(s == "O", "R").when(s == "F", "finished").otherwise("odd")
    word = F.when(s == "O", "Running").when(s == "F", "F").otherwise("ODD")
    standard = said(k, ".srv job", k, " me", F.when(k % 2 == 0, " 00:01").otherwise(""), " ", letter, " q", k % 4)
    wide = F.when(k % 5 == 0, said(k, " job", k, " RUNNING p")).otherwise(said(k, " job", k, " ", word, " p q", k % 4, " a b c"))
    c = F.col("o_custkey")
    both = blobs(orders.where(c % 2 == 0), c, k, standard, "\nJob ID Name User Time s Queue\n---- ----\n").unionByName(blobs(orders.where(c % 2 == 1), c, k, wide, "JOB_ID JOB_NAME STATUS\n-----\n"))
    return parsers.qstat(both).select("id", "job_id", "name", "state", "queue")


@query("""SELECT o_custkey AS id, o_orderkey || '.srv' AS job_id, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'a = ' || o_orderkey END AS name, CASE o_orderstatus WHEN 'F' THEN 'F' WHEN 'O' THEN 'R' ELSE 'Q' END AS state,
    CASE WHEN o_orderkey % 3 > 0 THEN 'q' || (o_orderkey % 3) ELSE '' END AS queue, CAST(CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 9 END AS INT) AS exit_status FROM orders""")
def queue_records(spark: SparkSession, sf: str) -> DataFrame:
    k, s = order_columns()
    some = lambda c, *parts: F.when(c, said(*parts)).otherwise("")
    block = said(
        "Job Id: ", k, ".srv\n", some(k % 7 > 0, "    Job_Name = a = ", k, "\n"), F.when(s == "F", "    job_state = finished\n").when(s == "O", "    job_state = R\n").otherwise(""),
        some(s == "F", "    Exit_status = ", k % 9, "\n"), some(k % 3 > 0, "    queue = old\n\tqueue = q", k % 3, "\n"), "    comment",
    )
    return parsers.qstat_full(blobs(table(spark, sf, "orders"), F.col("o_custkey"), k, block, "header = x\n")).select("id", "job_id", "name", "state", "queue", "exit_status")


@query(f"""SELECT c_nationkey * 1000000 + c_custkey // {LISTED} AS id, 'q' || c_custkey AS name FROM customer""")
def queue_names(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    listing = blobs(table(spark, sf, "customer"), F.col("c_nationkey") * 1_000_000 + F.floor(k / LISTED), k, said("q", k, " -- ", k % 5), "server: x\n\nQueue Mem\n----- ---\n", "\n      ---\n      4\n")
    return parsers.qstat_queues(listing).select("id", "name")


@query(f"""SELECT c_nationkey * 1000000 + c_custkey // {LISTED} AS id, 'q' || c_custkey AS name FROM customer WHERE c_custkey % 3 > 0""")
def tree_queues(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    line = said(F.when(k % 2 == 0, "|-- q").otherwise("`-- q"), k, " [", F.when(k % 3 > 0, "ENABLE, START]").otherwise("DISABLE]"))
    return parsers.resource_queues(blobs(table(spark, sf, "customer"), F.col("c_nationkey") * 1_000_000 + F.floor(k / LISTED), k, line, "route\n")).select("id", "name")


@query("""SELECT o_custkey AS id, o_orderkey AS task, CASE WHEN o_orderkey % 2 = 0 THEN 'study:s' || (o_orderkey % 9) END AS label, CASE WHEN o_orderstatus = 'O' THEN 'Running' ELSE 'Done' END AS state,
    CASE WHEN o_orderstatus = 'F' THEN 'Success' WHEN o_orderstatus = 'P' THEN 'Failed' END AS result, CAST(CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderstatus = 'P' THEN o_orderkey % 99 END AS INT) AS exit_code,
    CASE WHEN o_orderstatus = 'O' THEN '2024-01-01T00:00:' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') END AS start,
    o_orderstatus = 'O' AND o_orderkey % 60 < 30 AS inherited FROM orders""")
def task_documents(spark: SparkSession, sf: str) -> DataFrame:
    k, s = order_columns()
    status = (
        F.when(s == "O", said('{"Running":{"start":"2024-01-01T00:00:', F.lpad((k % 60).cast("string"), 2, "0"), '"}}'))
        .when(s == "F", '{"Done":{"result":"Success"}}').otherwise(said('{"Done":{"result":{"Failed":', k % 99, "}}}"))
    )
    label = F.when(k % 2 == 0, said('"label":"study:s', k % 9, '",')).otherwise("")
    task = said('"', k, '":{"id":', k, ",", label, '"status":', status, "}")
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id"), F.floor(k / LISTED))
    docs = orders.agg(F.concat(F.lit('{"tasks":{'), F.array_join(F.collect_list(task), ","), F.lit("}}")).alias("value")).select("id", "value")
    return parsers.pueue(docs).withColumn("inherited", text.inherited("state", "start", F.lit("2024-01-01T00:00:30")))


@query("""SELECT s_suppkey AS id, '/w=' || s_suppkey AS root, CASE WHEN s_suppkey % 2 = 0 THEN 'pbs' ELSE 'slurm' END AS kind, '' AS account, NULL::VARCHAR AS queue, CASE WHEN s_suppkey % 3 > 0 THEN 'A' || (s_suppkey % 3) END AS gpu_name,
    CAST(CASE WHEN s_suppkey % 3 = 1 THEN s_suppkey % 90000 END AS INT) AS gpu_mem_mb, CAST(s_suppkey % 64 AS INT) AS sysmem_gb FROM supplier""")
def host_capabilities(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    gpu = F.when(k % 3 == 1, said("gpu=A1, ", k % 90_000, "\n")).when(k % 3 == 2, "gpu=A2, unknown\n").otherwise("gpu=\n")
    value = said("noise\nroot=/w=", k, "\nkind=slurm\n", F.when(k % 2 == 0, "kind=pbs\n").otherwise(""), "account=\n", gpu, "mem=", (k % 64) * 1_048_576 + 300_000, "\n")
    return parsers.capabilities(table(spark, sf, "supplier").select(k.alias("id"), value.alias("value"))).select("id", "root", "kind", "account", "queue", "gpu_name", "gpu_mem_mb", "sysmem_gb")


@query(f"""SELECT DISTINCT c_nationkey * 1000000 + c_custkey // {LISTED} AS id, 'c' || c_custkey AS alias FROM customer WHERE c_custkey % 3 > 0
    UNION SELECT DISTINCT c_nationkey * 1000000 + c_custkey // {LISTED}, 'gate' FROM customer""")
def host_aliases(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    line = said(F.when(k % 2 == 0, "Host c").otherwise("host\tc"), k, F.when(k % 3 == 0, "* ").otherwise(" "), "gate w?\n  HostName h", k)
    return parsers.ssh_hosts(blobs(table(spark, sf, "customer"), F.col("c_nationkey") * 1_000_000 + F.floor(k / LISTED), k, line, "Host *\n")).select("id", "alias")


@query("""SELECT l_orderkey AS id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INT) AS ordinal, CAST(l_linenumber AS VARCHAR) AS line, l_partkey || ':' || l_suppkey AS part FROM lineitem""")
def processor_records(spark: SparkSession, sf: str) -> DataFrame:
    pad = lambda c: F.lpad(F.col(c).cast("string"), 12, "0")
    block = F.struct(said(pad("l_linenumber"), pad("l_partkey"), pad("l_suppkey")).alias("at"), said("part\t: none\nno colon\nline : ", F.col("l_linenumber"), "\npart : ", F.col("l_partkey"), ":", F.col("l_suppkey")).alias("b"))
    per = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(block)).alias("_b"))
    out = parsers.cpu_records(per.select("id", F.array_join(F.transform("_b", lambda x: x["b"]), "\n\n").alias("value")))
    return out.select("id", "ordinal", F.try_element_at("fields", F.lit("line")).alias("line"), F.try_element_at("fields", F.lit("part")).alias("part"))


@query("""SELECT s_suppkey AS id, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END AS INT) AS version, CASE WHEN s_suppkey % 2 = 0 THEN '/v2:x/' || s_suppkey ELSE '/v1/' || s_suppkey END AS path FROM supplier WHERE s_suppkey % 5 > 0""")
def memory_groups(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    value = said("7:cpuset:/c\n", F.when(k % 5 > 0, said("5:cpu,memory:/v1/", k, "\n", F.when(k % 2 == 0, said("0::/v2:x/", k, "\n")).otherwise(""))).otherwise(""), "none\n")
    return parsers.cgroup(table(spark, sf, "supplier").select(k.alias("id"), value.alias("value")))


@query("""SELECT c_custkey AS id, 'A' AS name, 'v ' || c_custkey AS value FROM customer UNION ALL SELECT c_custkey, 'B', '1=' || c_custkey FROM customer UNION ALL SELECT c_custkey, 'D', '"' FROM customer""")
def environment_files(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    value = said("# A=0\nexport A='v ", k, "'\nB=1=", k, "\nA=z\nnone\n\nHOME=/root\n=x\nD=\"")
    rows = table(spark, sf, "customer").select(k.alias("id"), value.alias("value"))
    return parsers.dotenv(rows, spark.range(1).select(F.lit("HOME").alias("name"))).select("id", "name", "value")


@query("""SELECT p_partkey AS id, 'lib,a' || p_partkey || '.so' AS path FROM part UNION ALL SELECT p_partkey, 'x/' || p_partkey || '.pyd' FROM part WHERE p_partkey % 2 = 0""")
def install_records(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    value = said('"lib,a', k, '.so",sha256=x,1\npkg/', k, ".py,,\nx/", k, F.when(k % 2 == 0, ".pyd,,").otherwise(".pyc,,"), "\n")
    return parsers.record_artifacts(table(spark, sf, "part").select(k.alias("id"), value.alias("value"))).select("id", "path")


@query("""SELECT event_id AS id, CAST(CASE WHEN event_id % 5 > 0 THEN event_id % 7 END AS INT) AS exit_code FROM events""")
def exit_codes_of_logs(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    value = F.when(k % 5 > 0, said("start exit=3\nnoise\nexit=", k % 7, "\nexit=x\n")).otherwise("no marker\nexit=\n")
    return parsers.exit_markers(table(spark, sf, "events").select(k.alias("id"), value.alias("value")))


@query("""SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN 'a' || event_id ELSE 'a' || event_id || ',b' END AS breakages FROM events""")
def report_breakages(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    listed = F.when(k % 3 == 0, "[]").when(k % 3 == 1, said('["a', k, '"]')).otherwise(said('["a', k, '","b"]'))
    out = parsers.breakages(table(spark, sf, "events").select(k.alias("id"), said("warning: x\n", '{"report":{"bad":', listed, "}}").alias("value")), "report.bad")
    return out.select("id", F.concat_ws(",", "breakages").alias("breakages"))


@query("""SELECT p_partkey AS id, 'crate' || p_partkey AS name, (p_size % 9) || '.' || (p_partkey % 7) || '.0' AS version FROM part""")
def installed_crates(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    value = said('[v1]\n"crate', k, " ", F.col("p_size") % 9, ".", k % 7, '.0 (registry+https://x)" = ["bin"]\nother = 1\n')
    return parsers.installed_crates(table(spark, sf, "part").select(k.alias("id"), value.alias("value")))
