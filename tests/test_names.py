"""Event types, message identifiers and payload numbers."""

import uuid

from pyspark.sql import functions as F

from loomlog.functions.names import payload_number, type_key, uuid_key, with_event_type


def test_type_key(spark):
    cases = {"OrderCompleted.11": "ordercompleted", "order_completed": "ordercompleted", "ORDER-2-DONE 7": "order2done", "": "", "123": "", None: None, "Émis3": "émis"}
    df = spark.createDataFrame([(k,) for k in cases], "name string")
    assert {r[0]: r[1] for r in df.select("name", type_key("name")).collect()} == cases


def test_unknown_names_have_no_type(spark):
    events = spark.createDataFrame([("A-b1", 1), ("zzz", 2), (None, 3)], "event_name string, event_type_no int")
    types = spark.createDataFrame([("ab", "x"), ("ab", "y"), (None, "z")], "event_type string, spelled string")
    got = {r["event_type_no"]: r["event_type"] for r in with_event_type(events, types).collect()}
    assert got == {1: "ab", 2: None, 3: None}


def test_uuid_forms_meet(spark):
    u = uuid.UUID("01b8db5b-d9b9-19d7-aa49-8507a5f77303")
    forms = [str(u), str(u).upper(), u.hex, u.hex.upper(), "{" + str(u) + "}", u.urn, f"  {u}\t", f" {u}\n"]
    df = spark.createDataFrame([(f,) for f in forms], "t string")
    assert {r[0] for r in df.select(uuid_key("t")).collect()} == {u.hex}


def test_other_texts_stand_for_themselves(spark):
    bad = ["", "x", "{" + "0" * 32 + "}", "URN:UUID:" + str(uuid.UUID(int=1)), str(uuid.UUID(int=1))[:-1] + "g"]
    df = spark.createDataFrame([(b,) for b in [*bad, None]], "t string")
    got = [r[0] for r in df.select(uuid_key("t")).collect()]
    assert got == [f"text:{b}" for b in bad] + [None]


def test_payload_numbers(spark):
    cases = [
        (b'{"amount":88.83,"qty":8}', 88.83), (b'{"amount":"145.27"}', 145.27), (b'{"amount":" 3 "}', 3.0), (b"", None), (None, None), (b'{"amount":40.5', None), (b'{"amount":40.5,"qt', None),
        (b'{"amount":null}', None), (b'{"amount":true}', None), (b'{"amount":[1]}', None), (b'{"amount":"x"}', None), (b'{"qty":3}', None), (b'{"amount":-2}', -2.0), (b"\xff\xfe", None),
        (b'{"amount":1e2}', 100.0), (b'{"amount":1e300}', None), (b'{"amount":5,"n":"\xff"}', None),
    ]
    df = spark.createDataFrame([(i, bytearray(p) if p is not None else None) for i, (p, _) in enumerate(cases)], "i int, p binary")
    got = dict(df.select("i", payload_number("p").cast("double")).collect())
    assert [got[i] for i in range(len(cases))] == [v for _, v in cases]


def test_payload_number_of_very_long_text(spark):
    df = spark.createDataFrame([(bytearray(b'{"note":"' + b"x" * 2_000_000 + b'","amount":7}'),)], "p binary")
    assert df.select(payload_number("p").cast("double")).first()[0] == 7.0
    assert df.limit(0).select(payload_number("p")).count() == 0
    assert df.select(F.lit(None).cast("binary").alias("p")).select(payload_number("p")).first()[0] is None
