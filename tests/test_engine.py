from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import inference
from tessera.operators.channels import ChannelAssembly, ChannelRegistry
from tessera.plans import names
from tessera.plans.session import Engine
from tessera.plans.tenancy import Tenancy
from tessera.sources.files import Source, read_vector_by_key, with_retry
from tessera.sources.mutable import MutableTableError, NoOrderColumn, PrimaryKeyConflict
from tessera.streaming.predicate import PredicateParse, PredicateUnsupported, matching
from tessera.streaming.topics import SchemaConflict

SF = "/root/testdata/sf0.001"
A, B = "00000000-0000-0000-0000-00000000000a", "00000000-0000-0000-0000-00000000000b"


@pytest.fixture
def engine(spark, tmp_path):
    made = Engine(spark, str(tmp_path / "root"), secret=b"s3")
    made.add_source("shop", Source(f"{SF}/orders.parquet"))
    made.add_source("docs", Source(f"{SF}/documents.parquet"))
    return made


def test_sql_over_three_part_names(engine, spark, tmp_path):
    n = spark.read.parquet(f"{SF}/orders.parquet").count()
    assert engine.sql("SELECT count(*) AS n FROM shop.public.orders -- shop.public.orders\n").first()["n"] == n
    assert engine.sql("""SELECT count(*) AS "many" FROM "shop"."public"."orders" o WHERE EXISTS (SELECT 1 FROM shop.public.orders i WHERE i.o_orderkey = o.o_orderkey)""").columns == ["many"]
    assert engine.sql("WITH a AS (SELECT shop.public.orders.o_custkey AS c, 'shop.public.orders' AS s FROM shop.public.orders) SELECT arrow_cast(max(c), 'Utf8') AS m, max(s) AS s FROM a").first()["s"] == "shop.public.orders"
    again = Engine(spark, engine.root)
    assert again.list_sources() == ["docs", "shop"] and again.describe_source("shop")["table"] == "orders"
    with pytest.raises(ValueError):
        engine.add_source("shop", Source(f"{SF}/orders.parquet"))
    with pytest.raises(NotImplementedError):
        engine.add_source("bird", Source("/x.avro", "avro"))
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,y\n")
    (tmp_path / "b.json").write_text('{"id": 1}\n{"id": 2}\n')
    engine.add_source("csv", Source(str(tmp_path / "a.csv"), "csv"))
    engine.add_source("json", Source(str(tmp_path / "b.json"), "json"))
    assert engine.sql("SELECT sum(a.id + b.id) AS s FROM csv.public.a a JOIN json.public.b b ON a.id = b.id").first()["s"] == 6
    assert "Filter" in engine.explain("SELECT * FROM shop.public.orders WHERE o_orderkey = 1")


def test_names():
    assert names.quote_relation('a.b"c') == '"a"."b""c"' and names.source_relation("s", "t") == "s.public.t"
    assert names.table_of("s3://x/y/orders.v1.parquet") == "orders"


def test_tenancy(engine, spark):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("region", T.StringType())])
    engine.create_mutable_table("t", schema, ["id"], order_column="id")
    frame = lambda *rows: spark.createDataFrame(list(rows), schema)
    assert engine.insert("t", frame((1, "x"))) == 1
    with engine.tenancy.scope(A):
        engine.insert("t", frame((2, "a")))
    with engine.tenancy.scope(B):
        engine.insert("t", frame((3, "b")))
        assert engine.sql("SELECT count(*) AS n FROM mutable.public.t x JOIN mutable.public.t y ON x.id = y.id").first()["n"] == 2
    count = lambda: engine.sql("SELECT count(*) AS n FROM mutable.public.t").first()["n"]
    assert count() == 1
    engine.tenancy.bind(A)
    assert count() == 2
    with engine.tenancy.admin():
        assert count() == 3
    engine.tenancy.bind("")
    for bad in ("x", "00000000-0000-0000-0000-000000000000"):
        with pytest.raises(ValueError):
            Tenancy.checked(bad)
    assert [r["id"] for r in engine.mutable["t"].scan_after(1).collect()] == [2, 3]


def test_mutable_rules(engine, spark):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("d", T.DateType())])
    t = engine.create_mutable_table("m", schema, ["id"])
    one = spark.createDataFrame([(1, None)], schema)
    t.insert(one)
    for rows in ([(1, None)], [(2, None), (2, None)], [(None, None)]):
        with pytest.raises(PrimaryKeyConflict):
            t.replace(spark.createDataFrame(rows, schema))
    assert t.scan().count() == 1
    with pytest.raises(NoOrderColumn):
        t.scan_after(0)
    with pytest.raises(NotImplementedError):
        t.update()
    for name, fields, key in (("Bad", [("id", T.LongType())], ["id"]), ("x", [("_id", T.LongType())], ["_id"]), ("x", [("id", T.LongType())], []), ("x", [("id", T.ArrayType(T.LongType()))], ["id"])):
        with pytest.raises(MutableTableError):
            engine.create_mutable_table(name, T.StructType([T.StructField(n, k) for n, k in fields]), key)


def test_topics(engine, spark, tmp_path):
    schema = T.StructType([T.StructField("kind", T.StringType()), T.StructField("v", T.LongType())])
    topic = engine.register_topic("news", schema)
    for i in range(4):
        assert topic.publish(spark.createDataFrame([("a", i), ("b", i)], schema)) == i
    with pytest.raises(SchemaConflict):
        topic.publish(spark.createDataFrame([(1,)], "v long"))
    assert topic.replay("kind = 'a'", 2).count() == 2 and topic.replay("kind = 'a'").count() == 0
    assert {r["_offset"] for r in topic.collect("v >= 1", 0, max_batches=2).collect()} == {1, 2}
    q = topic.subscribe("kind = 'b'", after_offset=1).writeStream.format("memory").queryName("tail").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["v"] for r in spark.table("tail").collect()) == [2, 3]
    engine.drop_topic("news")


def test_predicates(spark):
    rows = spark.createDataFrame([("Ab", 1), ("c", None)], "s string, n int")
    assert matching(rows, "starts_with(lower(s), 'a') AND n IN (1, 2) AND NOT (n IS NULL)").count() == 1
    assert matching(rows, "").count() == 2 and matching(rows, 'length("s") > 1 OR CAST(n AS BIGINT) BETWEEN 5 AND 6').count() == 1
    for bad in ("max(n) > 1", "n IN (SELECT 1)", "CASE WHEN true THEN true END", "sqrt(n) > 1", "missing = 1"):
        with pytest.raises(PredicateUnsupported):
            matching(rows, bad)
    for bad in ("n >", "n = 1; n = 2"):
        with pytest.raises(PredicateParse):
            matching(rows, bad)


def test_results_lineage_and_recompute(engine, spark):
    encoder = inference.Model("toy", "embedding", inference.hashing_encoder(8))
    table = engine.generate_embeddings("docs.public.documents", encoder, ["text"], "doc_id")
    assert engine.results.read(table.name).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    first = engine.build_neighbor_graph(table.name, 3, cache="use")
    assert engine.build_neighbor_graph(table.name, 3, cache="use").name == first.name
    assert engine.build_neighbor_graph(table.name, 3).name != first.name
    moved = engine.propagate_embeddings(table.name, f"results.{first.name}", hops=1)
    assert engine.derives_from(moved.name) == [table.name, first.name] and engine.results.closure(moved.name) == [table.name, first.name]
    assert engine.verify_materialization(first.name) == "match" and engine.staleness(first.name) == ("fresh", [])
    redone = engine.recompute(first.name, cascade=True)
    assert [r.name for r in redone] == [first.name, moved.name] and engine.staleness(moved.name)[0] == "fresh"
    engine.results.environment["engine"] = "2"
    assert engine.staleness(first.name)[0] == "stale"
    spark.range(1).write.mode("append").parquet(f"{engine.results.records[first.name].path}/rows")
    assert engine.verify_materialization(first.name) == "mismatch"
    with pytest.raises(ValueError):
        engine.recompute(table.name)
    query = read_vector_by_key(engine.results.read(table.name), "3")
    found = engine.search("docs.public.documents", query, 5, "doc_id", table.name).filter("n_chars > 0").limit(3).select("doc_id", "similarity").run().collect()
    assert len(found) == 3 and found[0]["similarity"] >= found[2]["similarity"]
    assert engine.search_by_id("docs.public.documents", "3", 5, "doc_id", table.name).run().first()["similarity"] > 0.999
    with pytest.raises(KeyError):
        engine.search_by_id("docs.public.documents", "none", 5, "doc_id", table.name)
    fused = engine.hybrid_search("docs.public.documents", query, "the of", ["text"], 5, "doc_id", table.name)
    assert fused.count() == 5
    engine.remove_source("docs")
    assert table.name not in engine.results.records


def test_inference_statuses(spark):
    def tight(texts):
        if len(texts) > 2:
            raise inference.OutOfMemory
        return [inference.scores_json(["x", "y"], [0.2, float(len(t))]) for t in texts]

    rows = spark.createDataFrame([(i, None if i == 2 else " " if i == 3 else "t" * i) for i in range(1, 9)], "id int, t string")
    got = {r["_row_id"]: r for r in inference.infer(rows, inference.Model("m", "classification", tight), ["t"], "id", "s").collect()}
    assert [got[k]["_status"] for k in ("1", "2", "3", "4")] == ["ok", "error", "error", "ok"] and got["4"]["label"] == "y"


def test_channels(spark):
    r = ChannelRegistry.seeded()
    r.register("extra", 0, [("note", "Utf8")])
    r.add_columns("extra", [("more", "Int64")])
    df = spark.createDataFrame([(1, 0.5)], "id int, similarity double")
    out = r.merge(df, {"vector": {"similarity": F.col("similarity")}, "extra": {"note": F.lit("n")}}, ["vector"])
    assert out.columns == ["id", "retrieved_by", "annotated_by", "note", "more", "similarity", "model", "task", "confidence", "score", "rank"]
    for call in (lambda: r.register("extra", 1, []), lambda: r.add_columns("extra", [("note", "Int32")]), lambda: r.merge(df, {"none": {}}, []), lambda: r.merge(df, {"vector": {"x": F.lit(1)}}, [])):
        with pytest.raises(ChannelAssembly):
            call()


def test_audit_and_ephemeral(engine, spark):
    key = engine.audit.append(A, "m", "1", {"q": 1}, ["1"], [0.5])
    record = engine.audit.by_id(A, key)
    assert engine.audit.verify(record) and not engine.audit.verify(record | {"model_id": "z"}) and engine.audit.by_id(B, key) is None
    with pytest.raises(ValueError):
        engine.audit.append(A, "m", "1", {"q": "x" * 9000}, [], [])
    with pytest.raises(PermissionError):
        engine.ephemeral_session()
    ended = []
    with engine.tenancy.scope(A), engine.ephemeral_session(on_end=lambda i, why: ended.append(why)) as session:
        view = session.put("t", spark.range(3))
        assert session.table("t").count() == 3
    assert ended == ["closed"] and not spark.catalog.tableExists(view)
    with pytest.raises(NotImplementedError):
        engine.fine_tune()


def test_retry():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return 7

    assert with_retry(flaky, first_wait=0.001) == 7
    with pytest.raises(KeyError):
        with_retry(lambda: {}["x"])
