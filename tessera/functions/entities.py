"""People, addresses, phones and e-mails as Column functions over texts and arrays.

Folds keep the order of their input: the first of equal entries stays, and what is kept of two
similar ones is decided one after the other, in the row, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.functions import patterns as P
from tessera.functions.columns import let

NONE = "array<string>"


def first_of_equal(items, key):
    """Array elements of which no earlier one has the same key."""
    return let(F.transform(items, key), lambda keys: F.filter(items, lambda x, i: F.array_position(keys, key(x)) == i + 1))


# ---- people

def plain_name(col):
    return C.squeezed(F.regexp_replace(C.text(col), r"[#*_`]", ""))


def banned(name):
    return C.matches(F.lower(name), f"^(?:{'|'.join(P.BANNED_NAMES)})(?: |$)")


def is_person(col):
    """Whether a text found on a page can be a person's name."""
    def judged(t):
        return (F.length(t).between(2, 80) & ~t.rlike("@|https?:|www\\.|#") & ~banned(t) & ~C.matches(t, P.RECRUITING) & (F.size(F.split(t, " ")) <= 5)
                & ~C.matches(t, P.HEADER_WORD) & t.rlike(P.NAME_WORDS))

    return let(C.squeezed(F.replace(C.text(col), F.lit("**"), F.lit(""))), judged)


def is_person_strict(col):
    def judged(t):
        return F.length(t).between(2, 50) & ~banned(t) & ~C.matches(t, P.RECRUITING) & (F.size(F.split(t, r"\s+")) <= 5) & t.rlike(P.NAME_WORDS_STRICT)

    return let(plain_name(col), judged)


def executive(name, role):
    """(name, role) cleaned, or null for what is no person with an executive title."""
    def judged(x):
        n, r = x["name"], x["role"]
        good = is_person_strict(n) & F.length(r).between(2, 90) & ~C.matches(r, P.RECRUITING) & C.matches(r, P.EXECUTIVE_TITLE)
        return F.when(good, x)

    return let(F.struct(plain_name(name).alias("name"), plain_name(role).alias("role")), judged)


def plain_role(col):
    return C.squeezed(F.regexp_replace(F.replace(C.text(col), F.lit("**"), F.lit("")), r"\s+[—–-]\s+\S+@\S+\s*$", ""))


def _if(condition, text):
    """A text that a pattern is sought in, or none where a cheap test says that it can't match."""
    return F.when(condition, text).otherwise(F.when(text.isNotNull(), F.lit("")))


def _found(text, pattern, groups):
    """The matches of a pattern that ends at a line's end, with their groups, which are read from each match alone.

    As nothing before or after a match decides how it is cut, this is the cut that the whole text gives."""
    part = lambda m: F.struct(m.alias("all"), *[F.regexp_extract(m, pattern, g).alias(name) for name, g in groups.items()])
    return lambda keep: F.transform(F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), keep), part)


def executives(markdown):
    """Array of (name, role, email, confidence): bold bullets, then dashed lines, then comma lines with an executive's title."""
    def made(x, email=None):
        return F.struct(x["name"].alias("name"), x["role"].alias("role"), (x["email"] if email is None else F.lit(email)).alias("email"))

    # a text without what every match holds is not searched
    bold = F.transform(_found(_if(markdown.contains("**"), markdown), P.EXEC_BOLD, {"name": 1, "role": 2, "email": 3})(lambda m: F.lit(True)), lambda x: made(x))
    dash = _found(_if(markdown.rlike(r"\s[—–-]\s"), markdown), P.EXEC_DASH, {"name": 1, "role": 2, "email": 3})(lambda m: ~m.contains("**"))
    comma = F.filter(_found(_if(markdown.rlike(r",\s"), markdown), P.EXEC_COMMA, {"name": 1, "role": 2})(lambda m: F.lit(True)), lambda x: C.matches(C.trimmed(x["role"]), P.ROLE_HINTS))
    every = F.concat(bold, F.transform(dash, lambda x: made(x)), F.transform(comma, lambda x: made(x, "")))

    def cleaned(x):
        name, role = C.squeezed(F.replace(x["name"], F.lit("**"), F.lit(""))), plain_role(x["role"])
        one_word = C.matches(name, P.ROLE_HINTS) & (F.size(F.split(name, r"\s+")) == 1)
        own = F.when(is_person(name) & (role != "") & (F.length(role) <= 120) & ~one_word, executive(name, role))
        sure = F.when(C.matches(own["role"], P.ROLE_HINTS), "high").otherwise("medium")
        return F.when(own.isNotNull(), F.struct(own["name"].alias("name"), own["role"].alias("role"), C.trimmed(C.text(x["email"])).alias("email"), sure.alias("confidence")))

    return let(F.filter(F.transform(every, cleaned), lambda x: x.isNotNull()), lambda good: first_of_equal(good, lambda x: F.lower(x["name"])))


# ---- addresses

def _replaced_or_added(held, at, item):
    """``held`` with ``item`` in the place of element ``at`` (from 1) if it is longer, or at the end if ``at`` is 0."""
    swapped = F.transform(held, lambda x, i: F.when((i == at - 1) & (F.length(item) > F.length(x)), item).otherwise(x))
    return F.when(at > 0, swapped).otherwise(F.concat(held, F.array(item)))


def contained_once(items):
    """Addresses cleaned; of two of which one holds the other the longer stays, in the first one's place."""
    clean = F.transform(items, lambda a: C.squeezed(F.regexp_replace(a, rf"^(?:[*\-•#]|{C.BLANK})+", "")))

    def step(held, a):
        low = F.lower(a)
        at = F.array_position(F.transform(held, lambda x: F.lower(x).contains(low) | low.contains(F.lower(x))), F.lit(True))
        return let(at, lambda k: _replaced_or_added(held, k, a))

    return F.aggregate(F.filter(clean, lambda a: F.length(a) > 5), F.array().cast(NONE), step)


def addresses_found(markdown):
    """Addresses of a text: labelled ones, postal patterns, else a fallback; contained ones once."""
    usable = lambda a: ~a.contains("@") & ~a.startswith("http")
    back = P.java(P.ADDRESS_FALLBACK)

    def of(x):
        text = x["text"]
        labelled = F.filter(F.transform(F.regexp_extract_all(_if(x["label"], text), F.lit(P.java(P.ADDRESS_START + P.ADDRESS_LABELLED)), F.lit(1)), C.trimmed), usable)
        postal = F.filter(F.regexp_extract_all(_if(x["number"], text), F.lit(P.java(P.ADDRESS_POSTAL)), F.lit(0)), usable)
        parts = lambda m: F.coalesce(*[F.nullif(F.regexp_extract(m, back, g), F.lit("")) for g in (1, 2)], F.nullif(m, F.lit("")))  # groups read from the match
        fallback = F.filter(F.array(C.trimmed(let(F.regexp_extract(text, back, 0), parts))), lambda a: a.isNotNull())
        found = let(contained_once(F.concat(labelled, postal)), lambda found: F.when(F.size(found) > 0, found).otherwise(contained_once(fallback)))
        return F.when(x["label"] | x["number"], found).otherwise(F.when(text.isNotNull(), F.array().cast(NONE)))

    # what every match holds, in all that the patterns' case folding takes for it
    def labelled_at_all(low):
        label = low.contains("ſ") | low.contains("ı") | low.contains("i̇")
        for word in P.ADDRESS_WORDS:
            label = label | low.contains(word)
        return label

    label = let(F.lower(markdown), labelled_at_all)
    return let(F.struct(markdown.alias("text"), label.alias("label"), markdown.rlike(P.ADDRESS_NUMBER).alias("number")), of)


def distinct_addresses(existing, incoming):
    """``existing`` and, one after the other, the incoming ones of 8 characters or more: one whose tokens
    are over 75 % like an earlier address replaces it if longer."""
    clean = F.filter(F.transform(incoming, C.squeezed), lambda a: F.length(a) >= 8)

    def step(held, a):
        mine = C.address_tokens(a)
        at = let(mine, lambda t: F.array_position(F.transform(held, lambda x: C.jaccard(t, C.address_tokens(x)) > 0.75), F.lit(True)))
        return let(at, lambda k: _replaced_or_added(held, k, a))

    return F.aggregate(clean, F.coalesce(existing, F.array().cast(NONE)), step)


# ---- phones and e-mails

def distinct_phones(existing, incoming):
    """One phone for each last eight digits: a longer one, or one with + after one without, takes the place."""
    every = F.filter(F.transform(F.concat(existing, incoming), C.trimmed), lambda p: C.phone_digits(p).isNotNull())
    foot = lambda p: F.right(C.phone_digits(p), F.lit(8))

    def kept(all_):
        feet = F.transform(all_, foot)
        better = lambda cur, x: F.when((cur == "") | (F.length(x) > F.length(cur)) | (x.startswith("+") & ~cur.startswith("+")), x).otherwise(cur)
        return F.transform(F.array_distinct(feet), lambda f: F.aggregate(F.filter(all_, lambda p: foot(p) == f), F.lit(""), better))

    return let(every, kept)


def phones_found(markdown):
    text = _if(markdown.rlike(r"[+\d]"), markdown)  # which every number holds
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(P.PHONE), F.lit(0)), C.trimmed), lambda p: F.length(p) >= 7))


def distinct_emails(existing, incoming):
    """(email, department) once for each valid address; a given department other than general stays."""
    def made(x):
        email = C.trimmed(F.lower(C.text(x["email"])))
        given = C.text(x["department"])
        return F.struct(email.alias("email"), F.when((given != "") & (given != "general"), given).otherwise(C.email_department(email)).alias("department"))

    every = F.filter(F.transform(F.concat(existing, incoming), made), lambda x: C.valid_email(x["email"]))
    return let(every, lambda good: first_of_equal(good, lambda x: x["email"]))


# ---- other contacts

def profile_link(text, pattern):
    found = C.trimmed(F.regexp_extract(_if(text.contains("m/") | text.contains("M/"), text), P.java(pattern), 0))  # both patterns hold .com/
    return F.when((found == "") | found.startswith("http"), found).otherwise(F.concat(F.lit("https://"), found))


def wechat(text):
    return F.regexp_extract(text, P.java(P.WECHAT), 1)


def masked_text(text):
    """The text with e-mails and phone numbers masked, each where it stands."""
    mails = F.regexp_replace(text, r"([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\.[A-Za-z]{2,})", "$1•••@$2")

    def phones(t):
        between = F.split(t, P.PHONE)
        found = F.concat(F.transform(F.regexp_extract_all(t, F.lit(P.PHONE), F.lit(0)), C.mask_phone), F.array(F.lit("")))
        return F.array_join(F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return let(mails, lambda t: F.when(t.rlike(P.PHONE), phones(t)).otherwise(t))
