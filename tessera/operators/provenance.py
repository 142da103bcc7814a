"""Where values come from: stamps of page elements, matched to the values of a record."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.functions import patterns as P
from tessera.functions.columns import let

#: Kinds of stamps that a field's value may come from.
KINDS = {"company_name": ("heading",), "legal_name": ("heading",), "email": ("email",), "phone": ("phone",), "address": ("heading",)}
HEADING = r"(?is)<h[1-4][^>]*>(.*?)</h[1-4]>"
MAIL_LINK, PHONE_LINK = r"""(?is)<a[^>]+href=["']mailto:[^>]*>(.*?)</a>""", r"""(?is)<a[^>]+href=["']tel:[^>]*>(.*?)</a>"""
BLOCK = r"(?is)<(?:li|p|figcaption|td)(?:\s[^>]*)?>(.*?)</(?:li|p|figcaption|td)>"
STAMP = "array<struct<id:string,kind:string,text:string>>"


def normal(col):
    return F.lower(C.squeezed(C.text(col)))


def _best(sources, scored):
    """id of the first source with the highest score above 0; empty without one."""
    start = F.struct(F.lit("").alias("id"), F.lit(0).alias("score"))

    def step(best, s):
        return let(scored(s), lambda n: F.when(n > best["score"], F.struct(C.text(s["id"]).alias("id"), n.alias("score"))).otherwise(best))

    return F.aggregate(sources, start, step, lambda best: best["id"])


def match(sources, value, kinds: tuple[str, ...] = ()):
    """id of the stamp whose text is the value (4), holds it or lies in it (2), or holds its first 48 characters (1)."""
    def of(needle):
        def scored(s):
            hay = normal(s["text"])
            prefix = F.left(needle, F.lit(48))
            n = F.when(hay == "", 0).when(hay == needle, 4).when(hay.contains(needle) | needle.contains(hay), 2).when((F.length(prefix) >= 4) & hay.contains(prefix), 1).otherwise(0)
            return F.when(s["kind"].isin(*kinds), n).otherwise(0) if kinds else n

        return F.when((needle == "") | sources.isNull(), "").otherwise(_best(sources, scored))

    return let(normal(value), of)


def executive_source(sources, name, role):
    own = lambda v: F.nullif(match(sources, v, ("person",)), F.lit(""))
    return F.coalesce(own(name), own(C.trimmed(F.concat_ws(" ", name, C.text(role)))), F.lit(""))


def snippet(sources, wanted, kind):
    """id of the stamp that a snippet points to: equal texts before containing ones, the wanted kind before others."""
    def of(needle):
        def scored(s):
            hay = normal(s["text"])
            own = F.when((kind == "") | (s["kind"] == kind), 1).otherwise(0)
            return F.when(hay == "", 0).when(hay == needle, 3 + own).when(hay.contains(needle), 1 + own).otherwise(0)

        return F.when(needle == "", "").otherwise(_best(sources, scored))

    return let(F.left(normal(wanted), F.lit(80)), of)


def stamps(html):
    """Stamps of a page's source: headings, mail and phone links, then e-mail, phone and person texts of
    blocks (li, p, figcaption, td), each kind in the order of the page, numbered through."""
    def texts(pattern, group, kind):
        return F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(group)), lambda t: F.struct(F.lit(kind).alias("kind"), C.squeezed(F.regexp_replace(t, "<[^>]+>", "")).alias("text")))

    headings = texts(HEADING, 1, "heading")
    mails = texts(MAIL_LINK, 1, "email")
    phones = texts(PHONE_LINK, 1, "phone")
    blocks = F.filter(texts(BLOCK, 1, "block"), lambda b: b["text"] != "")

    def kind(b):
        t = b["text"]
        found = F.when(C.matches(t, P.EMAIL), "email").when(t.rlike(P.PHONE) & (F.length(t) < 40), "phone").when((F.length(t) < 220) & C.matches(t, P.STAMP_ROLE_HINTS), "person")
        return F.when(found.isNotNull(), F.struct(found.alias("kind"), t.alias("text")))

    more = F.filter(F.transform(blocks, kind), lambda b: b.isNotNull())
    every = F.filter(F.concat(headings, mails, phones, more), lambda s: s["text"] != "")
    return F.transform(every, lambda s, i: F.struct(F.concat(F.lit("src-"), s["kind"], F.lit("-"), (i + 1).cast("string")).alias("id"), s["kind"].alias("kind"), F.substring(s["text"], 1, 240).alias("text")))
