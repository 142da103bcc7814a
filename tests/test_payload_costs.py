"""Payloads are read key by key out of a map, with the results of asking the variant."""

from pyspark.sql import functions as F

from tessera import plans
from tessera.operators import payloads

SF = "/root/testdata/sf0.001"
ODD = {
    '{"industry": null}': (True, ""), '{"a.b": 1}': (False, "empty"), '{"social": {}}': (True, ""), '{"social": [1]}': (False, "empty"), '{"executives": null}': (True, ""), '{"addresses": null}': (False, "empty"), '{"emails": []}': (True, ""),
    "null": None, "[{}]": None, '"{}"': None, "{": None, '{"email": "a", "email": "b"}': None,
}


def test_odd_payloads(spark):
    rows = spark.createDataFrame([(t,) for t in ODD], "t string").select("t", payloads.coerced(F.try_parse_json("t")).alias("p")).collect()
    assert {r.t: r.p and (r.p.ok, r.p.reason) for r in rows} == ODD


def test_texts_with_brackets_and_numbers(spark):
    raw = '{"company_name": "[a]", "industry": ["x"], "description": {"a": 1}, "phone": 1.50, "website": true, "linkedin": "{b}", "xing": "", "social": {"xing": 7, "wechat": ["w"]}, "emails": [{"email": 5}, "A@b.example", null], "executives": [null, [1], {"name": " Jo Do ", "role": {"x": 1}}]}'
    p = spark.createDataFrame([(raw,)], "t string").select(payloads.coerced(F.try_parse_json("t")).alias("p")).first().p
    assert (p.company_name, p.industry, p.description, p.phone, p.website, p.linkedin, p.xing, p.wechat) == ("[a]", "", "", "1.5", "true", "{b}", "7", "")
    assert [(e.email, e.department) for e in p.emails] == [("a@b.example", "general")] and [(e.name, e.role) for e in p.executives] == [("Jo Do", "")]


def test_variants_are_not_asked_for_each_key(spark):
    own = plans.QUERIES["payload_coerce"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert own.count("$.") == 0
