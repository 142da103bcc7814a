"""Company records as rows, and their exports.

A record is a row with a string column for each field, addresses and phone_numbers (arrays of strings),
emails (array of email, department), executives (array of name, role, email, linkedin, xing, wechat),
language, pages_visited (array of URLs) and extracted_at (text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.functions import patterns as P

PEOPLE = ("name", "role", "email", "linkedin", "xing", "wechat")


def _value(key: str, masked: bool):
    value = C.text(F.col(key))
    if masked and key == "email":
        return C.mask_email(value)
    return C.mask_phone(value) if masked and key == "phone" else value


def _or_scalar(items, scalar):
    """An array, or where it is empty the scalar as its only element (none if that is empty)."""
    return F.when(F.size(F.coalesce(items, F.array().cast("array<string>"))) > 0, items).when(scalar != "", F.array(scalar)).otherwise(F.array().cast("array<string>"))


def target(records: DataFrame, masked: bool = False, as_listed: bool = False) -> DataFrame:
    """The eight columns of the target schema, with the records' other key columns in front (site)."""
    entry = (lambda x: x) if as_listed else C.trimmed
    phones = F.transform("phone_numbers", C.mask_phone) if masked else F.transform("phone_numbers", entry)
    filled = lambda a: F.filter(a, lambda x: x != "")
    people = F.transform("executives", lambda e: F.struct(C.text(e["name"]).alias("name"), C.text(e["role"]).alias("role")))
    return records.select(
        "site", *[_value(k, masked).alias(k) for k in ("company_name", "industry", "description")],
        _or_scalar(filled(F.transform("addresses", entry)), C.trimmed(C.text(F.col("address")))).alias("addresses"),
        _or_scalar(filled(phones), C.trimmed(_value("phone", masked))).alias("phone_numbers"),
        *[_value(k, masked).alias(k) for k in ("email", "website")], people.alias("executives"),
    )


def target_json(records: DataFrame, masked: bool = False, as_listed: bool = False) -> DataFrame:
    """The target schema as JSON; with ``as_listed`` entries of addresses and of unmasked phone_numbers keep their blanks."""
    rows = target(records, masked, as_listed)
    return rows.select("site", F.to_json(F.struct(*[c for c in rows.columns if c != "site"]), {"ignoreNullFields": "false"}).alias("json"))


def full_json(records: DataFrame, masked: bool = False, compatible: bool = True) -> DataFrame:
    """The whole record as JSON.  With ``compatible`` the e-mails of the array stay unmasked, as they always were."""
    mails = F.when(F.size("emails") > 0, F.col("emails")).when(C.text(F.col("email")) != "", F.array(F.struct(_value("email", masked).alias("email"), F.lit("general").alias("department")))).otherwise(F.expr("cast(array() as array<struct<email:string,department:string>>)"))
    if masked and not compatible:
        mails = F.transform(mails, lambda e: F.struct(C.mask_email(e["email"]).alias("email"), e["department"].alias("department")))
    phones = F.transform("phone_numbers", C.mask_phone) if masked else F.col("phone_numbers")
    shown = lambda e, k: F.when(F.lit(masked) & (k == "email") & (C.text(e["email"]) != ""), C.mask_email(e[k])).otherwise(e[k]) if k == "email" else e[k]
    people = F.transform("executives", lambda e: F.struct(*[shown(e, k).alias(k) for k in PEOPLE]))
    value = lambda k: _value(k, masked)
    body = F.struct(
        *[value(k).alias(k) for k in ("company_name", "legal_name", "industry", "description", "address")], _or_scalar(F.col("addresses"), value("address")).alias("addresses"),
        value("email").alias("email"), mails.alias("emails"), value("phone").alias("phone"), _or_scalar(phones, value("phone")).alias("phone_numbers"), value("website").alias("website"),
        F.struct(*[value(k).alias(k) for k in ("linkedin", "xing", "wechat")]).alias("social"), people.alias("executives"), "language", "pages_visited", "extracted_at",
    )
    return records.select("site", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def csv_cell(col):
    return F.when(col.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(col, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(col)


def executives_csv(records: DataFrame, masked: bool = False) -> DataFrame:
    """One CSV text a record: a header, and a line for each executive."""
    def line(e):
        mail = C.text(e["email"])
        mail = F.when(mail != "", C.mask_email(mail)).otherwise("") if masked else mail
        return F.concat_ws(",", csv_cell(C.text(e["name"])), csv_cell(C.text(e["role"])), csv_cell(mail))

    lines = F.concat(F.array(F.lit("name,role,email")), F.transform("executives", line))
    return records.select("site", F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("csv"))


def markdown(records: DataFrame, masked: bool = False) -> DataFrame:
    """A heading and one bullet for each field that has a value."""
    lines = [F.when(_value(k, masked) != "", F.concat(F.lit(f"- **{label}**: "), _value(k, masked))) for k, label in P.FIELDS.items()]
    head = F.concat(F.lit("# "), C.text(F.col("company_name")))
    return records.select("site", F.concat_ws("\n", head, F.lit(""), *lines).alias("markdown"))
