"""1,200 rules over JSON lines made of the event table: MB read a second on local[$BENCH_CPUS]; prints one JSON line.

python bench_rules.py [MB of JSON lines, 1024 by default]. The lines are written to a folder of their own first, which
isn't timed; the timed run reads, parses, matches and counts the detections of every rule."""

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tracewell.many_rules import rules
from tracewell.operators.detect import matches, resolver
from tracewell.sources.files import json_lines
from tracewell.sources.records import from_events


def main() -> None:
    cpus, sf_dir, mb = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int((sys.argv + ["1024"])[1])
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    events = from_events(spark, sf_dir)
    line = F.to_json(F.struct(
        F.col("ts").alias("@timestamp"), F.col("channel").alias("Channel"), F.col("event_id").alias("EventID"), F.col("computer").alias("Hostname"), F.col("record_id").alias("RecordNumber"),
        F.col("provider").alias("SourceName"), F.col("f_user_id").alias("user_id"), F.col("f_k").alias("k"), F.col("f_ip").alias("ip"), F.col("f_owner").alias("owner"), F.col("f_login").alias("login"),
        F.concat(F.lit("An account did something that a log describes at some length, as logs do. Account: "), "f_login", F.lit(" from "), "f_ip").alias("Message"),
    ))
    lines = events.select(line.alias("value"))
    size = lines.agg(F.sum(F.length("value") + 1)).first()[0]
    place = tempfile.mkdtemp(prefix="bench-rules-") + "/lines"
    copies = max(1, round(mb * 1e6 / size))
    spark.range(copies).repartition(int(cpus)).crossJoin(F.broadcast(lines)).select("value").write.text(place)  # copies of the table, for size only
    os.rename(place, place + ".d")
    place += ".d"
    found = json_lines(spark, place, extensions=("txt",))
    chosen = rules("events") + rules("documents")
    began = time.time()
    made = matches(found, chosen, resolver(found)).groupBy("rule_no").count().agg(F.sum("count"), F.count("*")).first()
    took = time.time() - began
    print(json.dumps({"metric": "MB of JSON lines a second", "value": round(size * copies / 1e6 / took, 2), "unit": "MB/s", "mb": round(size * copies / 1e6), "sec": round(took, 1), "rules": len(chosen), "detections": made[0], "rules_with_detections": made[1], "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
