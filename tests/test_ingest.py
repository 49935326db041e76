"""Strict JSON typing rules of validated ingest."""

from kestrel.sources import ingest as I

FIELDS = [I.Field("invoice_no", "text", True), I.Field("amount", "float", True), I.Field("qty", "integer"),
          I.Field("paid", "boolean"), I.Field("due", "date"), I.Field("at", "datetime"), I.Field("meta", "json")]


def run(spark, payloads):
    recs = spark.createDataFrame([(str(i), p) for i, p in enumerate(payloads)], "record_id string, payload string")
    v = I.validate(recs, FIELDS)
    acc = I.accepted(v, FIELDS, keep=["record_id"]).collect()
    rej = I.rejected(v, "record_id").collect()
    return acc, sorted((r.record_id, r.field, r.message) for r in rej)


def test_good_record_keeps_unknown_field_raw(spark):
    acc, rej = run(spark, ['{"invoice_no":"INV-001","amount":98.5,"remark":"raw only"}'])
    assert rej == []
    assert acc[0].invoice_no == "INV-001" and acc[0].amount == 98.5 and "remark" in acc[0].raw_payload
    assert "remark" not in acc[0].asDict()


def test_type_rules(spark):
    payloads = [
        '{"amount":1}',                                         # 0 missing required
        '{"invoice_no":"a","amount":"5"}',                      # 1 string is not a number
        '{"invoice_no":"a","amount":true}',                     # 2 boolean is not a number
        '{"invoice_no":"a","amount":1,"qty":5.0}',              # 3 5.0 is not an integer
        '{"invoice_no":"a","amount":1,"qty":"5"}',              # 4 "5" is not an integer
        '{"invoice_no":"a","amount":1,"due":"2024-1-5"}',       # 5 not strict ISO date
        '{"invoice_no":"a","amount":1,"due":"2024-02-30"}',     # 6 impossible date
        '{"invoice_no":"a","amount":1,"at":"yesterday"}',       # 7 bad datetime
        '{"invoice_no":"a","amount":1,"meta":5}',               # 8 json must be object/array
        '{"invoice_no":5,"amount":1}',                          # 9 text must be a string
        '[1,2]',                                                # 10 body not an object
        '{"invoice_no":"a","amount":1,"paid":"true"}',          # 11 boolean must be boolean
        '{"invoice_no":"a","amount":null}',                     # 12 JSON null = missing
        '{"invoice_no":"a","amount":2,"qty":3,"paid":false,"due":"2024-01-05",'
        '"at":"2024-01-05T10:00:00Z","meta":{"b":1,"a":[1]}}',  # 13 valid
    ]
    acc, rej = run(spark, payloads)
    assert [a.record_id for a in acc] == ["13"]
    fields = {r[0]: r[1] for r in rej}
    assert fields == {"0": "invoice_no", "1": "amount", "2": "amount", "3": "qty", "4": "qty", "5": "due", "6": "due",
                      "7": "at", "8": "meta", "9": "invoice_no", "10": "body", "11": "paid", "12": "amount"}
    a = acc[0]
    assert a.qty == 3 and a.paid is False and str(a.due) == "2024-01-05" and str(a.at) == "2024-01-05 10:00:00"


def test_schema_and_evolution(spark):
    schema = I.model_schema(FIELDS)
    assert [f.name for f in schema.fields][:4] == list(I.SYSTEM_COLUMNS)
    old = spark.createDataFrame([("x", 1.0)], "invoice_no string, amount double")
    ev = I.evolve_add_columns(old, FIELDS)
    assert ev.columns[:2] == ["invoice_no", "amount"] and "meta" in ev.columns and ev.first().qty is None


def test_a_number_is_no_date_string(spark):
    fields = [I.Field("d", "date"), I.Field("t", "datetime")]
    df = spark.createDataFrame([("1", '{"d": 20240101, "t": true}'), ("2", '{"d": "2024-13-01", "t": "soon"}')], "record_id string, payload string")
    got = {(r.record_id, r.field): r.message for r in I.rejected(I.validate(df, fields), "record_id").collect()}
    assert got == {("1", "d"): "must be an ISO date string", ("1", "t"): "must be an ISO datetime string",
                   ("2", "d"): "must be a valid ISO date YYYY-MM-DD", ("2", "t"): "must be a valid ISO datetime string"}
