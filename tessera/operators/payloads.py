"""Payloads of a language model: JSON out of free text, coerced into the company schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.functions import entities as E
from tessera.functions import patterns as P
from tessera.functions.columns import let

STRINGS = ("company_name", "legal_name", "industry", "description", "address", "email", "phone", "website", "linkedin", "xing", "wechat", "language")
PEOPLE = ("name", "role", "email", "linkedin", "xing", "wechat")
LISTS = ("addresses", "phone_numbers", "emails")
NONE = "array<string>"


def _object(text):
    """A variant of a JSON object; null for other texts."""
    return let(F.try_parse_json(text), lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), v))


def recovered(raw):
    """The JSON object in a model's answer: in a fence, between the outermost braces, or the whole text."""
    text = C.trimmed(C.text(raw))
    fence = C.trimmed(F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)```", 1))
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.coalesce(_object(F.nullif(fence, F.lit(""))), _object(F.nullif(braces, F.lit(""))), _object(text))


def _kind(v):
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _text(t, of):
    """A value's text, or an empty one for null, objects and lists, whose texts begin with a bracket; only such are looked at as ``of``."""
    def judged(t):
        kind = _kind(of)
        nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        return F.when((t.startswith("{") | t.startswith("[")) & nested, "").otherwise(C.text(t))

    return let(t, judged)


def string_of(v):
    """Strings as they are, numbers and booleans as text, all else empty."""
    return _text(F.try_variant_get(v, "$", "string"), v)


def _fields(v):
    """An object's values by key, or null for what is none.  A map tells at once that a key is absent; asking a variant for one is slow."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _at(fields, key):
    return F.try_element_at(fields, F.lit(key))


def string_at(fields, key):
    return string_of(_at(fields, key))


def _get(v, key):
    return F.try_variant_get(v, f"$.{key}", "variant")


def _is_array(v):
    return _kind(v).startswith("ARRAY")


def _list(v):
    return F.try_variant_get(v, "$", "array<variant>")


def _items(v):
    return F.coalesce(_list(v), F.expr("cast(array() as array<variant>)"))


def _texts(items):
    return F.filter(F.transform(items, lambda x: C.trimmed(string_of(x))), lambda t: t != "")


def _person(x):
    """An executive of the payload, or null for navigation words, metrics and entries without a name."""
    row = lambda o: F.struct(C.trimmed(string_at(o, "name")).alias("name"), *[string_at(o, k).alias(k) for k in PEOPLE[1:]])

    def judged(r):
        noise = C.matches(r["name"], P.NON_PERSON) | C.matches(r["name"], P.FEATURE_METRIC)
        best = lambda clean: F.when(clean.isNotNull(), F.struct(clean["name"].alias("name"), clean["role"].alias("role"), *[r[k].alias(k) for k in PEOPLE[2:]])).when(F.length(r["name"]) <= 60, r)
        return F.when((r["name"] != "") & ~noise, let(E.executive(r["name"], r["role"]), best))

    return let(_fields(x), lambda o: F.when(o.isNotNull(), let(row(o), judged)))


def coerced(v):
    """Struct of ok, reason, each string key, addresses, phone_numbers, emails and executives of a variant; null for no object."""
    def made(o):
        """Each text, list and the social links are read once; what follows takes them from there."""
        read = [*[string_at(o, k).alias(k) for k in STRINGS], *[_list(_at(o, k)).alias(f"list_{k}") for k in LISTS], _fields(_at(o, "social")).alias("social")]
        return let(F.struct(*read), lambda r: made_of(o, r))

    def made_of(o, r):
        has = lambda k: _at(o, k).isNotNull()
        listed = lambda k: r[f"list_{k}"].isNotNull()
        is_social = r["social"].isNotNull()
        value = {k: r[k] for k in STRINGS}
        for k in ("linkedin", "xing", "wechat"):
            value[k] = F.when((r[k] == "") & is_social, string_at(r["social"], k)).otherwise(r[k])
        none = F.array().cast(NONE)
        one = lambda k: F.when(value[k] != "", F.array(value[k])).otherwise(none)
        addresses = F.when(listed("addresses"), E.distinct_addresses(none, _texts(r["list_addresses"]))).otherwise(one("address"))
        phones = F.when(listed("phone_numbers"), E.distinct_phones(none, _texts(r["list_phone_numbers"]))).otherwise(one("phone"))
        no_mail = F.expr("cast(array() as array<struct<email:string,department:string>>)")

        def mail(x):
            plain = F.struct(string_of(x).alias("email"), F.lit("").alias("department"))
            return let(_fields(x), lambda o: F.when(o.isNotNull(), F.struct(string_at(o, "email").alias("email"), string_at(o, "department").alias("department"))).otherwise(plain))

        given = F.when(listed("emails"), F.transform(r["list_emails"], mail)).when(value["email"] != "", F.array(F.struct(value["email"].alias("email"), F.lit("").alias("department")))).otherwise(no_mail)
        emails = E.distinct_emails(no_mail, given)
        people = F.filter(F.transform(_items(_at(o, "executives")), _person), lambda p: p.isNotNull())
        # what has a text is there; the object is asked again only where none has
        known = [r[k] != "" for k in STRINGS] + [listed(k) for k in LISTS] + [is_social, has("executives")] + [has(k) for k in STRINGS]
        any_ = known[0]
        for k in known[1:]:
            any_ = any_ | k

        def filled(x):
            any_ = x["any"]
            first = {"address": F.get(x["addresses"], 0), "phone": F.get(x["phone_numbers"], 0), "email": F.get(x["emails"], 0)["email"]}
            strings = [(F.coalesce(F.nullif(value[k], F.lit("")), first[k], F.lit("")) if k in first else value[k]).alias(k) for k in STRINGS]
            return F.struct(any_.alias("ok"), F.when(any_, "").otherwise("empty").alias("reason"), *strings, *[x[k].alias(k) for k in ("addresses", "phone_numbers", "emails", "executives")])

        return let(F.struct(addresses.alias("addresses"), phones.alias("phone_numbers"), emails.alias("emails"), people.alias("executives"), any_.alias("any")), filled)

    return let(_fields(v), lambda o: F.when(o.isNotNull(), made(o)))


def strict(v):
    """Whether a payload has the right type everywhere: strings, and executives a list of objects of strings."""
    def text_or_absent(o, k):
        return _get(o, k).isNull() | (_kind(_get(o, k)) == "STRING")

    def person(x):
        good = F.lit(True)
        for k in PEOPLE[1:]:
            good = good & text_or_absent(x, k)
        named = C.trimmed(F.when(_kind(_get(x, "name")) == "STRING", string_of(_get(x, "name"))).otherwise(""))
        return _kind(x).startswith("OBJECT") & (good | (named == ""))  # an entry without a name is passed over

    def judged(o):
        good, people = F.lit(True), _get(o, "executives")
        for k in STRINGS:
            good = good & text_or_absent(o, k)
        return good & (people.isNull() | (_is_array(people) & F.forall(_items(people), person)))

    return F.coalesce(let(v, lambda o: F.when(_kind(o).startswith("OBJECT"), judged(o))), F.lit(False))


def availability(value):
    s = F.lower(C.trimmed(C.text(value)))
    return (F.when(s.isin("available", "readily"), "available").when(s.isin("downloadable", "after-download"), "downloadable").when(s == "downloading", s)
            .when(s.isin("unavailable", "no", "none"), "unavailable").when(s == "", "unknown").otherwise(s))
