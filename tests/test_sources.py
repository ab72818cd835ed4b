from conftest import rows
from faultline.sources import readers, sinks


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_spans_with_bad_lines(spark, tmp_path):
    p = write(
        tmp_path / "s.csv",
        "timestamp,cmdb_id,span_id,trace_id,duration,type,status_code,operation_name,parent_span\n"
        "1625138160000,a,s1,t1,12,rpc,Ok,/x,0\n1625138160500,b,s2,t1,5,rpc,500,/y,s1\nbroken\n",
    )
    got = readers.spans_b(spark, p)
    assert rows(got, "span_id", "parent_span_id", "anomaly", "duration") == [("s1", None, 0, 12.0), ("s2", "s1", 1, 5.0)]


def test_metric_files(spark, tmp_path):
    write(tmp_path / "kpi_container_memory_rss.csv", "timestamp,cmdb_id,value\n1,node-1.cart-0,2.5\n")
    write(tmp_path / "kpi_other.csv", "timestamp,cmdb_id,value\n1,node-1.cart-0,9\n")
    assert rows(readers.container_metrics(spark, str(tmp_path)), "service", "kpi", "value") == [("cart-0", "container_memory_rss", 2.5)]
    assert readers.node_metrics(spark, str(tmp_path / "absent")).count() == 0
    p = write(tmp_path / "svc" / "m.csv", "service,timestamp,rr,sr,mrt,count\ncart-grpc,1,1,2,3,4\n")
    assert rows(readers.service_metrics(spark, p), "service", "kpi", "value") == [
        ("cart", "count", 4.0), ("cart", "mrt", 3.0), ("cart", "rr", 1.0), ("cart", "sr", 2.0)
    ]


def test_metric_file_index(spark, tmp_path):
    for end in ("2021-07-15", "2021-07-31"):
        write(tmp_path / f"web1_0.0.0.1_docker_cpu_2021-07-01_{end}.csv", "timestamp,value\n1,2\n")
    got = readers.metric_index(readers.metric_files(spark, str(tmp_path))).collect()[0]
    assert (got.service, got.kpi, [f.end_date for f in got.files]) == ("web1", "docker_cpu", ["2021-07-15", "2021-07-31"])


def test_ground_truth_forms_agree(spark, tmp_path):
    c = write(tmp_path / "g.csv", "timestamp,level,cmdb_id,failure_type\n2,pod,b-0,cpu\n1,node,n1,disk\n")
    j = write(tmp_path / "g.json", '{"timestamp":[2,1],\n"level":["pod","node"],"cmdb_id":["b-0","n1"],"failure_type":["cpu","disk"]}')
    a, b = readers.ground_truth(spark, c).collect(), readers.ground_truth(spark, j, "json").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b] == [(1, "node", "n1", "disk"), (2, "pod", "b-0", "cpu")]


def test_run_table(spark, tmp_path):
    p = write(
        tmp_path / "r.csv",
        'datetime,service,message\n2021-07-01,a,"2021-07-01 10:00:00.5, cpu fault"\n2021-07-01,b,"2021-07-01 10:00:00, INFO x"\n'
        '2021-07-01,c,"2021-07-01 10:00:00 | ERROR"\n2021-07-02,d,no comma\n2021-07-03,e,"2021-07-03 01:02:03,x"\n',
    )
    got = readers.run_table(spark, p)
    assert [r.service for r in got.orderBy("service").collect()] == ["a", "e"]
    assert [r.date for r in readers.fault_dates(got).collect()] == ["2021-07-01", "2021-07-03"]


def test_run_log_order_and_resume(spark, tmp_path):
    write(tmp_path / "log1" / "part-0.log", "one\n[DONE] 0701 11-16\n")
    write(tmp_path / "log1" / "part-1.log", "two\n")
    got = [r.line for r in readers.run_log(spark, str(tmp_path / "log1")).orderBy("pos").collect()]
    assert got == ["one", "[DONE] 0701 11-16", "two"]
    done = readers.finished_keys(spark, str(tmp_path / "log1"))
    todo = spark.createDataFrame([("0701", "11-16"), ("0701", "12-00")], "date string, time string")
    assert rows(readers.remaining(todo, done, ["date", "time"])) == [("0701", "12-00")]


def test_merged_days_are_sorted(spark, tmp_path):
    df = spark.createDataFrame([(f"2021-07-0{1 + i % 2} 10:00:{i:02d}", i) for i in range(50)], "timestamp string, id int")
    sinks.merged_days(df, str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 50 and got.select("date").distinct().count() == 2


def test_references(spark, tmp_path):
    p = write(tmp_path / "c.json", '{"case_id":"c1",\n"references":{"LogExpert":"disk"}}')
    assert rows(readers.references(spark, p), "case_id", "expert", "text") == [("c1", "LogExpert", "disk")]
