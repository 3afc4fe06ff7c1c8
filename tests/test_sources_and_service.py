import json
import urllib.request

import pytest

import __spark_entry__
from tessera.model import EngineConf, InvalidQuery, RegionQuery
from tessera.service import RegionService
from tessera.sources import tables
from tessera.streaming import grid as stream_grid


def test_query_validation():
    for bad in ({"topk": 0}, {"eps": 0.0}, {"algo": 11}, {"sigma": 0.0}, {"kprime": 0}):
        with pytest.raises(InvalidQuery):
            RegionQuery(**({"topk": 1, "eps": 1.0} | bad))
    assert RegionQuery.from_parameters({"topk": "3", "eps": "0.5", "dist": "false", "keywordsColumn": "k", "algo": "9"}) == RegionQuery(topk=3, eps=0.5, dist=False, keywords_column="k", algo=9)
    assert RegionQuery(topk=1, eps=1.0, f="null").key() == RegionQuery(topk=1, eps=1.0).key()
    assert RegionQuery(topk=1, eps=1.0, dist=False).key() != RegionQuery(topk=1, eps=1.0).key()
    with pytest.raises(InvalidQuery):
        RegionQuery.from_parameters({"topk": "x", "eps": "1"})


def test_csv_and_positions(spark, tmp_path):
    (tmp_path / "a.csv").write_text("lon,lat,code,f\n1.5,2.5,10.10,7\nnull,1,10.1,\n")
    rows = tables.read_csv(spark, str(tmp_path / "a.csv"), ("lon", "lat", "f")).collect()
    assert (rows[0]["lon"], rows[0]["code"], rows[0]["f"]) == (1.5, "10.10", 7.0) and rows[1]["lon"] is None
    (tmp_path / "b.txt").write_text("x1,1.0,2.0, A ;b,3\nbad,row\nx2,,2,c,1\nx3,3,4,d,9\n")
    got = tables.read_positions(spark, str(tmp_path / "b.txt"), lon=2, lat=3, id=1, keywords=4, score=5).collect()
    assert [(r["id"], r["lon"], r["score"], r["name"]) for r in got] == [("x1", 1.0, 3.0, ""), ("x3", 3.0, 9.0, "")]
    some = tables.read_positions(spark, str(tmp_path / "b.txt"), lon=2, lat=3, keywords=4, wanted="a").collect()
    assert len(some) == 1 and some[0]["score"] == 1.0
    with pytest.raises(ValueError):
        tables.read_positions(spark, "x", lon=None, lat=2)


def test_fetch_sql():
    assert tables.fetch_sql("s.t", ["k", None, "null", "f", "k"]) == 'select "lat", "lon", "k", "f" from "s"."t" where "lat" is not null and "lon" is not null'
    with pytest.raises(ValueError):
        tables.fetch_sql("t; drop table x", [])


def test_extracts_are_reused(spark, tmp_path):
    calls = []

    def fetch():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert tables.cached_extract(spark, f"file://{tmp_path}/e", "t", ["k"], fetch).count() == 3
    assert calls == [1]


def test_service(spark, tmp_path):
    points = spark.createDataFrame([(0.0, 0.0, "a"), (0.1, 0.1, "b"), (5.0, 5.0, "b")], "lon double, lat double, k string")
    conf = EngineConf(results=str(tmp_path / "r.jsonl"), extracts=f"file://{tmp_path}/x", port=0)
    service = RegionService(spark, conf, load=lambda q: points)
    server = service.serve()
    get = lambda path: urllib.request.urlopen(f"http://127.0.0.1:{server.server_address[1]}/{path}", timeout=60).read().decode()
    assert "submitted" in get("BRS?topk=1&eps=1&input=t")
    service.jobs.join()
    assert json.loads(get("BRS?topk=1&eps=1&input=t"))[0]["score"] == 2.0
    assert get("BRS?topk=0&eps=1").startswith("Error")
    get("BRS?topk=1&eps=1&input=t&keywordsColumn=missing&keywords=b")
    service.jobs.join()
    assert get("BRS?topk=1&eps=1&input=t&keywordsColumn=missing&keywords=b") == "Column not found"
    assert get("changeAlgo?algo=unif") == "Done" and conf.algo == "uniform" and get("changeAlgo?algo=zz").startswith("Error")
    assert get("changeProteus?url=jdbc:x&username=u&pass=p") == "Done" and conf.password == "p"
    assert get("removeTables?table=t") == "Done" and get("alive") in ("free", "not free")
    again = RegionService(spark, conf, load=lambda q: points)
    assert len(again.results) == 2
    assert get("flushBuffer") == "Done" and not service.results
    server.shutdown()


def test_streaming_sums(spark, tmp_path):
    spark.createDataFrame([(0.5, 0.5, 2.0), (0.6, 0.6, 3.0), (1.5, 0.5, 1.0)], "lon double, lat double, f double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("lon double, lat double, f double").parquet(str(tmp_path / "in"))
    q = stream_grid.cell_sums(stream, 1.0, "f").writeStream.outputMode("complete").format("memory").queryName("sums").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["i"], r["j"], r["s"]) for r in spark.table("sums").collect()} == {(0, 0, 5.0), (1, 0, 1.0)}


def test_entry_contract(spark):
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 40
    assert __spark_entry__.entry(spark).columns == ["rank", "lon", "lat", "score"]


def test_sources_are_kept_apart(spark, tmp_path):
    conf = EngineConf(extracts=f"file://{tmp_path}/extracts", results=str(tmp_path / "results.jsonl"), jdbc_url="jdbc:a", user="u", password="p")
    asked = []
    points = spark.createDataFrame([(0.0, 0.0), (0.1, 0.1)], "lon double, lat double")
    work = RegionService(spark, conf, load=lambda query: asked.append(query.input) or points)
    given = {"topk": "1", "eps": "1", "table": "poi"}
    work.ask(given)
    work.jobs.join()
    assert json.loads(work.ask(given))[0]["score"] == 2.0 and asked == ["poi"]
    assert work.change_source(" ", "u", "p").startswith("Error") and conf.jdbc_url == "jdbc:a"
    assert work.change_source("jdbc:b", "u", "p") == "Done"
    assert "submitted" in work.ask(given)
    work.jobs.join()
    assert asked == ["poi", "poi"]
    folder = tmp_path / "extracts" / work.source()
    for name in ("poi", "poi-f", "poison", "poi2-f"):
        (folder / name).mkdir(parents=True)
    assert work.remove_tables("poi") == "Done"
    assert sorted(p.name for p in folder.iterdir()) == ["poi2-f", "poison"]


def test_worker_survives_a_failed_save(spark, tmp_path):
    conf = EngineConf(results=str(tmp_path / "no folder" / "results.jsonl"))
    points = spark.createDataFrame([(0.0, 0.0)], "lon double, lat double")
    work = RegionService(spark, conf, load=lambda query: points)
    for eps in ("1", "2"):
        work.ask({"topk": "1", "eps": eps})
        work.jobs.join()
        assert json.loads(work.ask({"topk": "1", "eps": eps}))[0]["score"] == 1.0
