import pytest

from rillfold.operators import schema as sc
from rillfold.sources import catalog as ct


def test_types():
    t = sc.parse("frozen <map< timeuuid , frozen<tuple<int,text>>>>")
    assert t.text() == "FROZEN<MAP<TIMEUUID, FROZEN<TUPLE<INT, TEXT>>>>" and t.atomic and t.spark() == "map<string,struct<_1:int,_2:string>>"
    assert not sc.parse("list<int>").atomic and sc.parse("INT").atomic and sc.parse("frozen<list<int>>").spark() == "array<int>"
    assert sc.parse("map<frozen<map<int,int>>,int>").spark() == "array<struct<key:map<int,int>,value:int>>"
    u = sc.parse("frozen<My>", {"my": [("b", "int"), ("c", "duration")]})
    assert u.spark() == "struct<b:int,c:struct<months:bigint,days:bigint,nanos:bigint>>" and u.text() == "FROZEN<my>"
    for bad in ("list<int,int>", "map<int>", "nope", "list<int", "int>", "frozen<int,int>", "", "list", "int<text>"):
        with pytest.raises(ValueError):
            sc.parse(bad)
    assert all(sc.parse(n.lower()).text() == n for n in sc.NATIVE)


BASE = [("pk", "PARTITION_KEY", "int"), ("ck", "CLUSTERING_KEY", "int"), ("v", "REGULAR", "set<int>"), ("v2", "REGULAR", "list<int>"), ("v3", "REGULAR", "map<double,text>"), ("v4", "REGULAR", "tuple<inet,int>"), ("v5", "REGULAR", "frozen<list<int>>"), ("v6", "REGULAR", "int")]


def known(base):
    return {n: (k, t) for n, k, t in base}


def test_log_of_a_table(spark):
    cols = dict(sc.log_columns(BASE))
    assert cols["cdc$deleted_elements_v"] == "FROZEN<SET<INT>>" and cols["cdc$deleted_elements_v2"] == "FROZEN<SET<TIMEUUID>>" and cols["v2"] == "FROZEN<MAP<TIMEUUID, INT>>"
    assert "cdc$deleted_pk" not in cols and "cdc$deleted_v6" in cols and "cdc$deleted_elements_v5" not in cols
    s = sc.infer(sc.log_columns(BASE), known(BASE))
    assert [c.name for c in s.base()] == [n for n, _, _ in BASE] and {c.kind for c in s.base()} == {"PARTITION_KEY", "CLUSTERING_KEY", "REGULAR"}
    assert s.column("v2").base_type.text() == "LIST<INT>" and s.column("v").base_type.text() == "SET<INT>" and s.column("v5").base_type.text() == "FROZEN<LIST<INT>>"
    assert s.deleted("v").name == "cdc$deleted_v" and s.deleted_elements("v3").log_type.text() == "FROZEN<SET<DOUBLE>>" and s.column(0).name == "cdc$stream_id"
    with pytest.raises(KeyError):
        s.deleted("pk")
    assert s.struct()["v2"].dataType.simpleString() == "map<string,int>" and s.struct()["v2"].metadata["base_type"] == "LIST<INT>" and len(s.meta()) + len(s.base()) == len(s.columns)


def test_skew_between_log_and_table():
    cols = sc.log_columns(BASE)
    gone = {n: x for n, x in known(BASE).items() if n != "v2"}
    with pytest.raises(sc.SchemaConflict):
        sc.infer(cols, gone)
    with pytest.raises(sc.SchemaConflict):
        sc.infer(cols, known(BASE) | {"v2": ("REGULAR", "text")})
    as_map = sc.infer(cols, known(BASE) | {"v2": ("REGULAR", "map<timeuuid,int>")})
    assert as_map.column("v2").base_type.text() == "MAP<TIMEUUID, INT>"
    renamed = {n: x for n, x in known(BASE).items() if n != "ck"} | {"ck_new": ("CLUSTERING_KEY", "int")}
    assert sc.infer(cols, renamed).column("ck").kind == "CLUSTERING_KEY"
    dropped = {n: x for n, x in known(BASE).items() if n != "v6"}
    assert sc.infer(cols, dropped).column("v6").kind == "REGULAR"


def test_catalog():
    t = ct.TableName.parse("ks.a")
    known_tables = [ct.TableInfo(t, True, "100"), ct.TableInfo(ct.TableName("ks", "b"), False)]
    assert ct.problems([t], known_tables) == [] and len(ct.problems([ct.TableName("ks", "b"), ct.TableName("ks", "c"), ct.TableName("x", "a")], known_tables)) == 3 and ct.problems([], known_tables)
    assert ct.ttl_seconds(known_tables[0]) == 100 and ct.ttl_seconds(ct.TableInfo(t, True, 0)) is None
    for bad in (None, "x", -1):
        with pytest.raises(ValueError):
            ct.ttl_seconds(ct.TableInfo(t, True, bad))
    with pytest.raises(ValueError):
        ct.TableName.parse("none")
    assert sorted([ct.TableName("b", "a"), ct.TableName("a", "z")])[0].keyspace == "a"


def test_headers_as_rows(spark):
    head = "table_name string, file_id bigint, column_index int, column_name string, cdc_log_data_type string, base_table_data_type string, base_table_column_kind string"
    rows = [
        ("a", 1, 0, "cdc$time", "timeuuid", None, None), ("a", 1, 1, "cdc$deleted_l", "boolean", None, None), ("a", 1, 2, "cdc$deleted_elements_l", "frozen<set<timeuuid>>", None, None), ("a", 1, 3, '"PK"', "int", "int", "partition_key"),
        ("a", 1, 4, "l", "frozen<map<timeuuid,int>>", "list<int>", "regular"), ("a", 1, 4, "l", "frozen<map<timeuuid,int>>", "list<int>", "regular"),
        ("a", 2, 0, "cdc$deleted_elements_l", "frozen<set<timeuuid>>", None, None), ("a", 2, 1, "l", "frozen<map<timeuuid,int>>", None, None), ("b", 3, 0, "x", "strange", None, None), (None, 4, 0, "x", "int", None, None), ("b", 5, 0, None, "int", None, None),
    ]
    got = {(r.file_id, r.column_name): (r.base_type, r.kind, r.deleted, r.deleted_elements, r.problem is not None) for r in sc.inferred(spark.createDataFrame(rows, head)).collect()}
    assert got[(1, "pk")] == ("INT", "PARTITION_KEY", None, None, False) and got[(1, "l")] == ("LIST<INT>", "REGULAR", 1, 2, False) and got[(1, "cdc$time")][:2] == (None, None)
    assert got[(2, None)][-1] and got[(3, None)][-1] and {k[0] for k in got} == {1, 2, 3}  # list or map can't be told; an unknown type
    texts = {r.spelling: r.text for r in sc.type_texts(spark.createDataFrame([("frozen <set <int>>",), ("nope",), (None,)], "t string")).collect()}
    assert texts == {"frozen <set <int>>": "FROZEN<SET<INT>>", "nope": None, None: None}
