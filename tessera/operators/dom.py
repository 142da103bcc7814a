"""The tree of a page: elements and texts as rows with nested intervals, and what is read off them.

``nodes`` is an Arrow stage: the standard library's tokenizer and a stack of open elements give a row for every
element and text, in pieces, so that a long page is not held as rows.  ``node`` counts in document
order and ``stop`` is the last node inside, so that B lies in A when A.node < B.node <= A.stop.  Walks over the
tree (``markdown``, ``stamps``) are windows over these intervals.

The rules of the stack: html and body are there even if no tag says so; what follows ``</body>`` is still in it.
Void elements hold nothing.  A block ends an open p; li, option, dt and dd, tr, td and th, and a end open ones of
their kind, inside the nearest list, table or select.  An end tag closes what is open
down to its own element and is ignored where none is open; the end of the page closes all.  (Browsers also reopen
wrongly nested formatting, which changes no text.)

A null page has no nodes.  Pages are told apart by ``page_id`` and a hash of the source, so ids that are null or
repeat do not mix; rows that repeat both count once.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.functions import patterns as P

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TEXT = "#text"
# Fixed values
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
STRIPPED = frozenset("script style noscript iframe svg canvas video audio link meta".split())
HEAD = frozenset("base link meta noscript script style template title".split())
BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: tag -> (tags that it ends, tags that shield them)
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)), "a": (("a",), ("table", "td", "th")),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "tbody": (("thead", "tbody", "tr"), ("table",)), "tfoot": (("thead", "tbody", "tr"), ("table",)),
}
P_SHIELDS = ("table", "td", "th", "button", "object", "caption")
LEAVES = ("p", "address", "figcaption", "td", "th")
PERSON_BLOCKS = ("li", "p", "article", "figcaption", "td")
PREVIEW, PERSON_CHARS, PHONE_CHARS, PAGE_CHARS = 240, 220, 40, 200_000
# End of fixed values

NODES = "page_id long, page long, node long, parent long, place int, depth int, tag string, attributes map<string,string>, stop long, n_texts long, own string, inner string, hidden boolean"
#: Characters that the tokenizer gets at a time, and rows of an Arrow batch.
PIECE, ROWS = 1 << 16, 4096


def _tree():
    """The class that turns markup into rows; made here, as executors import this module by name."""
    import re
    from html.parser import HTMLParser

    blanks = re.compile(f"{C.BLANK}+", re.ASCII)

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.rows, self.open, self.count, self.texts, self.gap, self.body, self.hidden, self.pending = [], [], 0, 0, False, False, 0, []

        def push(self, tag, attributes):
            above = self.open[-1] if self.open else None
            if above:
                above["children"] += 1
            self.count += 1
            self.hidden += tag in STRIPPED
            self.gap |= tag in BLOCKS or tag in ("br", "li", "tr", "td", "th")
            self.open.append({"node": self.count, "parent": above["node"] if above else None, "place": above["children"] if above else 1, "depth": len(self.open), "tag": tag, "attributes": attributes, "before": self.texts, "own": [], "inner": "", "children": 0})

        def pop(self):
            e = self.open.pop()
            self.hidden -= e["tag"] in STRIPPED
            self.gap |= e["tag"] in BLOCKS or e["tag"] in ("li", "tr", "td", "th")
            self.rows.append((e["node"], e["parent"], e["place"], e["depth"], e["tag"], e["attributes"], self.count, self.texts - e["before"], blanks.sub(" ", " ".join(e["own"])).strip(" "), e["inner"].strip(" ")[:PREVIEW], self.hidden > 0 or e["tag"] in STRIPPED))

        def close_down_to(self, tags, shields):
            for k in range(len(self.open) - 1, -1, -1):
                tag = self.open[k]["tag"]
                if tag in tags:
                    while len(self.open) > k:
                        self.pop()
                    return True
                if tag in shields:
                    return False
            return False

        def ready(self, tag):
            """html, head or body around what comes next."""
            if not self.open:
                self.push("html", {})
            if self.body or tag in ("head", "body") or (tag in HEAD and not self.body):
                return
            while len(self.open) > 1:  # an open head
                self.pop()
            self.push("body", {})
            self.body = True

        def handle_starttag(self, tag, attributes):
            self.text()
            held = {}
            for name, value in attributes:
                held.setdefault(name, value or "")
            if tag in ("html", "body") and self.open and (tag == "html" or self.body):
                e = self.open[0 if tag == "html" else 1]
                e["attributes"] = held | e["attributes"]
                return
            if tag == "html":
                self.push(tag, held)
                return
            if tag == "head" and (self.body or len(self.open) > 1):
                return
            self.ready(tag)
            if tag == "body":
                while len(self.open) > 1:
                    self.pop()
                self.push(tag, held)
                self.body = True
                return
            if tag in BLOCKS:
                self.close_down_to(("p",), P_SHIELDS)
            if tag in ENDS:
                while self.close_down_to(*ENDS[tag]):
                    pass
            self.push(tag, held)
            if tag in VOID:
                self.pop()

        def handle_startendtag(self, tag, attributes):
            self.handle_starttag(tag, attributes)
            if tag not in VOID and self.open and self.open[-1]["tag"] == tag and any(x["tag"] == "svg" for x in self.open):  # elsewhere the slash means nothing
                self.pop()

        def handle_endtag(self, tag):
            self.text()
            if tag not in ("html", "body") and tag not in VOID:
                self.close_down_to((tag,), ("body", "td", "th", "table") if tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot") else ("body",) if tag == "table" else ("body", "table"))

        def handle_comment(self, data):
            self.text()

        def handle_data(self, data):
            self.pending.append(data)

        def text(self):
            """The text since the last tag, which may have come in pieces."""
            data, self.pending = "".join(self.pending), []
            if not data or not self.body and not data.strip():
                return
            if not self.open or not self.body and self.open[-1]["tag"] in ("html", "head"):
                self.ready(TEXT)
            above = self.open[-1]
            self.count += 1
            hidden = self.hidden > 0
            text = blanks.sub(" ", data)
            self.rows.append((self.count, above["node"], None, len(self.open), TEXT, None, self.count, 0, data, None, hidden))
            above["own"].append(data)
            if hidden:
                return
            self.texts += text != " "
            shown = " " + text if self.gap else text
            self.gap = False
            for e in reversed(self.open):  # an ancestor has at least what its descendants have
                if len(e["inner"]) > PREVIEW:
                    break
                e["inner"] += (shown.lstrip(" ") if e["inner"].endswith(" ") or not e["inner"] else shown)[: PREVIEW + 2]

        def finish(self):
            self.close()
            self.text()
            while self.open:
                self.pop()

    return Tree


def parse(batches):
    """Rows (page_id, page, html) -> NODES, a piece of a page at a time."""
    import pyarrow as pa

    kinds = [("page_id", pa.int64()), ("page", pa.int64()), ("node", pa.int64()), ("parent", pa.int64()), ("place", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("stop", pa.int64()), ("n_texts", pa.int64()), ("own", pa.string()), ("inner", pa.string()), ("hidden", pa.bool_())]
    schema, tree, held = pa.schema(kinds), _tree(), []

    def batch_of(rows):
        columns = list(zip(*rows))
        columns[7] = [None if a is None else list(a.items()) for a in columns[7]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds)], schema=schema)

    for batch in batches:
        for page_id, page, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "page", "html"))):
            parser = tree()
            for at in range(0, len(html), PIECE):
                parser.feed(html[at : at + PIECE])
                if at + PIECE >= len(html):
                    parser.finish()
                held += [(page_id, page, *r) for r in parser.rows]
                parser.rows.clear()
                while len(held) >= ROWS:
                    yield batch_of(held[:ROWS])
                    held = held[ROWS:]
    if held:
        yield batch_of(held)


def nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """NODES of every page.  ``own`` of a text is the text as it stands, of an element its own texts squeezed; ``inner``
    begins the text inside (240 characters); ``n_texts`` counts the texts inside that show."""
    root = ROOT

    def call(batches):
        if root not in sys.path:
            sys.path.append(root)
        from tessera.operators import dom

        yield from dom.parse(batches)

    html = F.col(html_col)
    rows = pages.filter(html.isNotNull() & (html != "")).select(F.col(id_col).cast("long").alias("page_id"), F.xxhash64(html).alias("page"), html.alias("html"))
    return rows.dropDuplicates(["page_id", "page"]).mapInArrow(call, NODES)


_PAGE = ["page_id", "page"]


def _within():
    return W.partitionBy(*_PAGE)


def _up_to(last: int):
    return _within().orderBy("node").rowsBetween(W.unboundedPreceding, last)


def outermost(rows: DataFrame, chosen, name: str) -> DataFrame:
    """``rows`` with ``name``: the node of the outermost chosen element that a node is or lies in, else null."""
    covered = F.coalesce(F.max(F.when(F.col("_chosen"), F.col("stop"))).over(_up_to(-1)) >= F.col("node"), F.lit(False))
    marked = rows.withColumn("_chosen", chosen).withColumn("_top", F.when(F.col("_chosen") & ~covered, F.struct("node", "stop")))
    last = F.last("_top", ignorenulls=True).over(_up_to(0))
    return marked.withColumn("_last", last).withColumn(name, F.when(F.col("_last.stop") >= F.col("node"), F.col("_last.node"))).drop("_chosen", "_top", "_last")


def markdown(rows: DataFrame, urls: DataFrame) -> DataFrame:
    """(page_id, page, n_blocks, markdown) of the first of main, article, role=main and body of every page.

    Headings, links, list items and leaves (LEAVES) are blocks; nothing inside a block is one.  ``urls``
    has page_id, page and url, against which links are resolved.
    """
    tag = F.col("tag")
    shown = rows.filter(~F.col("hidden"))
    main = F.when(tag.isin("main", "article", "body") | (F.col("attributes")["role"] == "main"), F.struct("node", "stop"))
    inside = shown.withColumn("main", F.min(main).over(_within())).filter((F.col("node") >= F.col("main.node")) & (F.col("node") <= F.col("main.stop"))).drop("main", "inner")
    heading = tag.isin("h1", "h2", "h3", "h4")
    block = ((heading | tag.isin("li", *LEAVES)) & (F.col("n_texts") > 0)) | ((tag == "a") & (C.text(F.col("attributes")["href"]) != ""))
    held = outermost(inside.withColumn("_block", block), F.col("_block"), "block").filter("block is not null")
    # the texts of one block of one page
    parts = F.when(tag == TEXT, F.struct("node", F.col("own").alias("text")))
    first = F.when(F.col("node") == F.col("block"), F.struct("tag", F.col("attributes")["href"].alias("href")))
    blocks = held.groupBy(*_PAGE, "block").agg(C.squeezed(F.array_join(F.transform(F.array_sort(F.collect_list(parts)), lambda t: t["text"]), "")).alias("text"), F.max(first).alias("e"))
    link = C.resolve(C.trimmed(F.col("e.href")), F.col("url"))
    line = (
        F.when(F.col("e.tag").isin("h1", "h2", "h3", "h4"), F.concat(F.repeat(F.lit("#"), F.substring("e.tag", 2, 1).cast("int")), F.lit(" "), "text"))
        .when(F.col("e.tag") == "a", F.concat(F.lit("["), F.coalesce(F.nullif("text", F.lit("")), "link"), F.lit("]("), "link", F.lit(")")))
        .when(F.col("e.tag") == "li", F.concat(F.lit("- "), "text")).otherwise(F.col("text"))
    )
    bases = urls.select(F.col("page_id").alias("_id"), F.col("page").alias("_page"), "url")
    lines = blocks.join(bases, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("page") == F.col("_page"))).withColumn("link", link).select(*_PAGE, F.struct("block", line.alias("line")).alias("l"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda l: l["line"]), "\n\n")
    return lines.groupBy(*_PAGE).agg(F.count("*").alias("n_blocks"), F.substring(joined, 1, PAGE_CHARS).alias("markdown"))


def stamps(rows: DataFrame) -> DataFrame:
    """(page_id, page, node, number, id, kind, text): headings, mail links, phone links, then elements of the body whose own
    text has an e-mail or is a phone, and short blocks that name a role; numbered through in that order."""
    tag, href, own = F.col("tag"), C.text(F.col("attributes")["href"]), F.col("own")
    elements = rows.filter(tag != TEXT).withColumn("body", F.min(F.when(tag == "body", F.col("node"))).over(_within()))
    inner = F.col("inner")
    walked = F.when(C.matches(own, P.EMAIL), "email").when(own.rlike(P.PHONE) & (F.length(own) < PHONE_CHARS), "phone").when(tag.isin(*PERSON_BLOCKS) & (inner != "") & (F.length(inner) < PERSON_CHARS) & C.matches(inner, P.STAMP_ROLE_HINTS), "person")
    place = F.when(tag.isin("h1", "h2", "h3", "h4"), 0).when((tag == "a") & href.startswith("mailto:"), 1).when((tag == "a") & href.startswith("tel:"), 2).otherwise(3)
    kind = F.when(F.col("turn") == 0, "heading").when(F.col("turn") == 1, "email").when(F.col("turn") == 2, "phone").when(F.col("walks"), walked)
    walks = (F.col("node") >= F.col("body")) & ~tag.isin(*STRIPPED)
    found = elements.withColumn("turn", place).withColumn("walks", F.coalesce(walks, F.lit(False))).withColumn("kind", kind).filter("kind is not null")
    numbered = found.withColumn("number", F.row_number().over(W.partitionBy(*_PAGE).orderBy("turn", "node")))
    text = F.substring(F.coalesce(F.nullif(inner, F.lit("")), C.squeezed(href)), 1, PREVIEW)
    return numbered.select(*_PAGE, "node", "number", F.concat(F.lit("src-"), "kind", F.lit("-"), F.col("number").cast("string")).alias("id"), "kind", text.alias("text")).filter("text <> ''")
