"""Column functions: texts, URLs, contacts, addresses.  All run inside the JVM."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import functions as F

from tessera.functions import patterns as P

BLANK = "[\\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def let(value, body):
    """``body`` of a value that is computed once; named expressions would be computed at every use."""
    return F.get(F.transform(F.array(value), body), 0)


def text(col):
    return F.coalesce(col, F.lit(""))


def matches(col, pattern: str):
    return F.coalesce(col.rlike(P.java(pattern)), F.lit(False))


#: The characters of BLANK.
BLANKS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(col):
    return F.btrim(col, F.lit(BLANKS))


def squeezed(col):
    """Runs of blanks as one space; those that are one already are passed over."""
    return trimmed(F.regexp_replace(col, f"{BLANK}{{2,}}|(?! ){BLANK}", " "))


def squeezed_start(col, n: int):
    """The first ``n`` characters of the squeezed text, most often read off its first ``4 * n``; else they lie in the first ``n``
    words' characters, and the rest is not read."""
    whole = F.substring(squeezed(F.regexp_extract(col, f"^(?:{BLANK}*[^{BLANK[1:]}){{0,{n}}}", 0)), 1, n)
    return let(squeezed(F.substring(col, 1, 4 * n)), lambda head: F.when(F.length(head) >= n, F.substring(head, 1, n)).otherwise(whole))


def once(rows, columns: dict):
    """``rows`` with more columns, computed once a row: neither a filter nor a later use repeats them, as they come out of a generator."""
    held = rows.select("*", F.explode(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))).alias("__once"))
    return held.select(*[c for c in rows.columns if c not in columns], *[F.col("__once")[k].alias(k) for k in columns])


def first_email(col):
    """The first e-mail of a text; texts without an @ are not searched."""
    return F.when(col.contains("@"), F.regexp_extract(col, P.EMAIL, 0)).otherwise(F.when(col.isNotNull(), F.lit("")))


def replaced(col, steps):
    for pattern, by in steps:
        col = F.regexp_replace(col, pattern, by)
    return col


def stepped(col, steps):
    """As ``replaced``; neighbouring steps that ``P.NEEDS`` has the same test for are passed over together where a text fails it.

    While a text fails the test none of them changes it, so what one would leave for the next need not be looked at."""
    for test, own in groupby(steps, lambda step: P.NEEDS.get(step[0])):
        own = list(own)
        if test is None:
            col = replaced(col, own)
        else:
            held = lambda t: t.contains(test) if test in P.LITERAL else t.rlike(test)
            col = let(col, lambda t: F.when(held(t), replaced(t, own)).otherwise(t))
    return col


def sanitize_html(col):
    return stepped(col, P.SANITIZE)


def html_to_markdown(col):
    return trimmed(stepped(sanitize_html(col), P.MARKDOWN))


def sanitize_dom(html):
    """As sanitize_html, and without video, audio and meta elements and images of up to two pixels."""
    return replaced(html, P.SANITIZE_DOM)


def serialized(html):
    """(title, lang, markdown) of a page: the first body, main or article element, 200,000 characters at most."""
    root = F.regexp_extract(html, P.ROOT, 1)
    lang = F.regexp_extract(html, P.LANG_ATTRIBUTE, 1)
    text = trimmed(replaced(sanitize_dom(F.when(root != "", root).otherwise(html)), P.MARKDOWN))
    return page_title(html), F.when(lang != "", lang).otherwise("en"), F.substring(text, 1, 200_000)


def page_title(html):
    return squeezed(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def token_estimate(col):
    return F.ceil(F.length(F.coalesce(col, F.lit(""))) / 4).cast("long")


def token_count(col):
    return F.size(F.split(col, f"{BLANK}+")).cast("long")


def description(markdown):
    """The first line of over 50 characters that is prose, without a greeting in front; null without one."""
    def good(s):
        return (F.length(s) > 50) & ~s.rlike("^(#|-|Address:|Contact:)") & ~matches(s, P.BORING)

    # once a line is found the later ones are passed over
    first = lambda held, s: F.when(held.isNotNull(), held).otherwise(let(trimmed(s), lambda t: F.when(good(t), t)))
    line = F.aggregate(F.split(markdown, "\n"), F.lit(None).cast("string"), first)
    return let(line, lambda s: F.substring(trimmed(F.regexp_replace(s, "(?i)" + P.GREETING, "")), 1, 320))


def detect_language(attr, text):
    asian, umlaut = text.rlike("[\u3040-\u30ff\u4e00-\u9faf]"), text.rlike("[äöüßÄÖÜ]") | matches(text, P.GERMAN)
    return F.when((attr != "") & (attr != "und"), F.substring_index(attr, "-", 1)).when(asian, "ja").when(umlaut, "de").otherwise("en")


def language_name(code):
    base = F.substring_index(F.lower(F.coalesce(code, F.lit("en"))), "-", 1)
    names = F.create_map(*[F.lit(x) for pair in P.LANGUAGE_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, base), F.nullif(code, F.lit("")), F.lit("English"))


def url_origin(url):
    """scheme://host of a web URL in lower case, without user and default port; else empty."""
    def of(u):
        scheme = F.lower(F.regexp_extract(u, r"(?i)^(https?)://", 1))
        host = F.lower(F.regexp_extract(u, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#]+)", 1))
        host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(F.regexp_replace(host, ":443$", ""))
        return let(host, lambda h: F.when((scheme != "") & (h != ""), F.concat(scheme, F.lit("://"), h)).otherwise(""))

    return let(url, of)


def undotted(path):
    """A path without . and .. segments."""
    def step(held, s):
        return F.when(s == ".", held).when(s == "..", F.when(F.size(held) > 1, F.slice(held, 1, F.size(held) - 1)).otherwise(held)).otherwise(F.concat(held, F.array(s)))

    def of(p):
        tail = F.when(p.rlike(r"/\.{1,2}$"), "/").otherwise("")
        joined = F.concat(F.array_join(F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step), "/"), tail)
        return F.when(p.rlike(r"(?:^|/)\.{1,2}(?:/|$)"), joined).otherwise(p)

    return let(path, of)


def resolve(href, base):
    """Absolute form of an href: absolute, //host, /path, ?query or relative to the base's folder."""
    def of(x):
        h, b = x["href"], x["base"]
        folder = F.regexp_extract(b, r"(?i)^(https?://[^/?#]+(?:/[^?#]*/|/)?)", 1)
        folder = let(folder, lambda f: F.when(f.endswith("/"), f).otherwise(F.concat(f, F.lit("/"))))
        return (F.when(h.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), h).when(h.startswith("//"), F.concat(F.regexp_extract(b, r"(?i)^(https?:)", 1), h))
                .when(h.startswith("/"), F.concat(url_origin(b), h)).when(h.startswith("?"), F.concat(F.regexp_extract(b, r"^([^?#]*)", 1), h)).otherwise(F.concat(folder, h)))

    return let(F.struct(href.alias("href"), base.alias("base")), of)


#: Characters that a URL's path has only percent-encoded.
UNSAFE = r"""[^!-~]|["<>`{}]"""


def percent_encoded(path):
    """A path with unsafe characters as the percent-encoded bytes of their UTF-8."""
    each = F.transform(F.split(path, ""), lambda c: F.when(c.rlike(UNSAFE), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c))
    return F.when(path.rlike(UNSAFE), F.array_join(each, "")).otherwise(path)


def slashed(url):
    """A web URL with its backslashes read as slashes, as far as query and fragment."""
    head = F.regexp_extract(url, r"(?i)^(https?:[^?#]*)", 1)
    return F.when(head.contains("\\"), F.concat(F.replace(head, F.lit("\\"), F.lit("/")), F.substring(url, F.length(head) + 1, F.length(url)))).otherwise(url)


def url_path(url):
    return F.regexp_extract(url, r"(?i)^https?://[^/?#]+([^?#]*)", 1)


def canonical_url(url):
    """The URL without tracking parameters, fragment and trailing slash; null for what isn't a page."""
    def of(u):
        query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
        kept = F.array_join(F.filter(F.split(query, "&"), lambda kv: (kv != "") & ~F.lower(F.substring_index(kv, "=", 1)).isin(*P.TRACKING)), "&")
        path = undotted(F.lower(let(url_path(u), percent_encoded)))
        return let(F.struct(url_origin(u).alias("origin"), path.alias("path"), kept.alias("kept")), judged)

    def judged(x):
        path, segments = x["path"], F.filter(F.split(x["path"], "/"), lambda s: s != "")

        def page(own):
            last = text(F.element_at(F.when(F.size(own) > 0, own), -1))
            extension = F.when(last.contains("."), F.substring_index(last, ".", -1)).otherwise("")
            cyclic = (F.size(own) > 3) & (F.size(F.array_distinct(own)) < F.size(own) / 1.5)
            return ~extension.isin(*P.ASSETS) & ~matches(path, P.PATH_TRAP) & ~cyclic

        clean = F.concat(x["origin"], F.when(path == "", "/").otherwise(path), F.when(x["kept"] != "", F.concat(F.lit("?"), x["kept"])).otherwise(""))
        return F.when((x["origin"] != "") & let(segments, page), F.regexp_replace(clean, "/+$", ""))

    return let(slashed(url), of)


def fnv1a(col):
    """32-bit FNV-1a over UTF-16 code units, as hexadecimal."""
    def folded(code):
        units = F.transform(F.sequence(F.lit(1), F.length(code) - 3, F.lit(4)), lambda k: F.conv(F.substring(code, k, F.lit(4)), 16, 10).cast("long"))
        units = F.when(F.length(code) > 0, units).otherwise(F.array().cast("array<bigint>"))
        return F.lower(F.hex(F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))))

    return let(F.hex(F.encode(col, "UTF-16BE")), folded)


def email_department(email):
    user, out = F.substring_index(F.lower(email), "@", 1), None
    for name, pattern in P.DEPARTMENTS:
        out = F.when(matches(user, pattern), name) if out is None else out.when(matches(user, pattern), name)
    return out.otherwise("general")


def valid_email(email):
    return matches(email, f"^{P.EMAIL}$") & ~matches(email, P.NO_REPLY) & ~matches(email, P.PLACEHOLDER)


def phone_digits(raw):
    """Digits in front of an extension; null unless there are 7 to 15."""
    digits = F.regexp_replace(F.get(F.split(trimmed(raw), P.java(r"\b(?:ext|extension|x)\b")), 0), r"\D", "")
    return F.when(F.length(digits).between(7, 15), digits)


def mask_email(email):
    at = F.locate("@", email)
    domain = F.get(F.split(email, "@"), 1)
    return F.when(F.coalesce(domain, F.lit("")) != "", F.concat(F.when(at > 1, F.substring(email, 1, 1)).otherwise(""), F.lit("•••@"), domain)).otherwise(F.when(email == "", "").otherwise("•••"))


def mask_phone(phone):
    return F.regexp_replace(phone, "[0-9]", "•")


def address_tokens(address):
    clean = F.regexp_replace(F.lower(address), r"[^\p{L}\p{N}\s]", " ")
    return F.array_distinct(F.filter(F.split(clean, r"\s+"), lambda t: F.length(t) > 1))


def jaccard(a, b):
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def escaped(col):
    """A text as HTML shows it: ampersands, opening brackets and double quotes as entities."""
    for c, entity in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
        col = F.replace(text(col), F.lit(c), F.lit(entity))
    return col


def progress(loaded, total):
    """The loaded part, between 0 and 1; without a total, numbers up to 1 are parts and larger ones all of it."""
    known = lambda n: n.isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf"))
    part = F.when(known(total) & (total > 0) & known(loaded), loaded / total).when(known(loaded), F.when(loaded <= 1, loaded).otherwise(1.0)).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), part))


def duration(ms):
    small = F.concat(F.floor(ms + 0.5).cast("long").cast("string"), F.lit(" ms"))
    return F.when(ms.isNull() | F.isnan(ms) | (F.abs(ms) == float("inf")) | (ms < 0), "").when(ms < 1000, small).when(ms >= 10000, F.concat(F.format_string("%.1f", ms / 1000), F.lit(" s"))).otherwise(F.concat(F.format_string("%.2f", ms / 1000), F.lit(" s")))
