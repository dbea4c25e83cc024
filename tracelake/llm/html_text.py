"""Main text of web pages: page structure, and removal of subtrees that recur over a host.

A page is read into a tree of elements; comments, scripts, styles and the like are no elements, so what they mention counts
for nothing. Its content is its outermost article or main elements that hold text, or its body where none does. Two things take
parts out of the content:
  * site templates: each element's subtree is hashed (names and texts, attributes left out), Spark counts on how many pages of
    different content of a host a hash occurs, and subtrees on at least `least` of them and `share` of the host's different
    contents, or on `plenty` of them however large the host, are deleted. Within an article only containers can go that way;
    a paragraph that several pages quote is text;
  * elements that say what they are: nav, footer, aside, form, a header outside an article; and containers whose class, id or
    role is a name for menus, notices, adverts, sharing or reader comments, as a whole name: `search-box` is one,
    `search-results` and `social-science` are none.
Neither takes all text of a page: where nothing would be left, names count for nothing, then counts for nothing, and a form
that wraps paragraphs stands for a page in a form.

Defined results: null or empty html gives an empty text, as does a page of menus and forms alone; an unreadable url counts as
the host ""; tags cut off at the end of a page are dropped, unclosed elements end with their parent; pages that share a page_id
are told apart by their html and url; very long pages are read whole, in memory of one task; an empty table gives an empty
table; columns other than page_id, url and html are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

LEAST, SHARE, PLENTY = 5, 0.2, 50
TOKENS = (
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea|title|noscript|template|svg|iframe)\b[^>]*+(?:>.*?(?:</(?P=raw)\s*+>|\Z)|\Z)"
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>"""
    r"|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z|(?P<text>[^<]++|<)"
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
GONE = frozenset("nav footer aside head button select menu dialog".split())
CONTAINERS = frozenset("div section ul ol dl table figure fieldset details center header article".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 article main blockquote pre".split())
# names of parts that are no content, and words that say no more than "part" in such names
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup"
    " sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar footer masthead comment comments disqus respond replies reply related recommended share sharing social"
    " contentinfo complementary alert login search".split()
)
PARTS = frozenset("area bar block bottom box button buttons col column container content-info form group holder inner item items left link links list main nav outer panel part right section side site slot thread top unit widget widgets wrap wrapper".split())
ADS = frozenset("ad ads advert advertisement sponsored".split())
ENDS_P = BLOCKS - {"body", "html", "li", "tr", "tbody", "thead", "tfoot", "caption", "dd", "dt", "summary", "figcaption"}
ATTRS = r"""(?i)\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
NAME, NAMED, PARTS_OF, DIGEST, SAYS = range(5)


def names_a_part(name: str, attrs: str, finder) -> bool:
    """Whether class, id or role say that an element is no content. Paragraphs and the like only go as adverts."""
    if "=" not in attrs or name in ("html", "body", "main"):
        return False
    for value in finder.findall(attrs):
        for word in value.lower().strip("\"'").split():
            if name not in CONTAINERS:
                if word in ADS and name in BLOCKS:
                    return True
                continue
            pieces = [x for x in re.split(r"[-_]+", word) if x]
            if any(x in NAMES for x in pieces) and all(x in NAMES or x in PARTS or x.isdigit() for x in pieces):
                return True
    return False


def read_tree(html: str, tokens, finder) -> list:
    """The page's elements: [name, named as no content, texts and elements, subtree hash, whether it holds text]."""
    root = ["#", False, [], 0, False]
    stack = [root]

    def close(upto: int):
        while len(stack) > upto:
            node = stack.pop()
            seen = hashlib.blake2b(node[NAME].encode(), digest_size=8)
            for part in node[PARTS_OF]:
                if type(part) is str:
                    words = " ".join(part.split())
                    if words:
                        node[SAYS] = True
                        seen.update(b"t" + words.encode())
                elif part[SAYS]:
                    node[SAYS] = True
                    seen.update(b"e" + part[DIGEST])
            node[DIGEST] = seen.digest()

    for m in tokens.finditer(html):
        text = m["text"]
        if text is not None:
            stack[-1][PARTS_OF].append(entities.unescape(text) if "&" in text else text)
            continue
        name = m["name"] or m["name2"]
        if name is None:
            continue
        name = name.lower()
        if m["end"] or m["end2"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][NAME] == name:
                    close(k)
                    break
            else:
                if name in BLOCKS:
                    stack[-1][PARTS_OF].append(["hr", False, [], b"", False])  # it still parts two blocks
            continue
        if name == "br":
            stack[-1][PARTS_OF].append(" ")
            continue
        if name in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][NAME] == "p":
                    close(k)
                    break
                if stack[k][NAME] in ("div", "article", "section", "td", "body", "li"):
                    break
        elif name in ("li", "dd", "dt", "tr", "td", "th"):
            stop = {"li": ("ul", "ol"), "tr": ("table",), "td": ("tr",), "th": ("tr",)}.get(name, ("dl",))
            same = {"td": ("td", "th"), "th": ("td", "th"), "dd": ("dd", "dt"), "dt": ("dd", "dt")}.get(name, (name,))
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][NAME] in same:
                    close(k)
                    break
                if stack[k][NAME] in stop:
                    break
        elif name == "body":  # a head without an end
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][NAME] == "head":
                    close(k)
        attrs = m["attrs"] or m["attrs2"] or ""
        node = [name, bool(attrs) and names_a_part(name, attrs, finder), [], b"", False]
        stack[-1][PARTS_OF].append(node)
        if name not in VOID and not (attrs.endswith("/") and name not in BLOCKS):
            stack.append(node)
    close(0)
    return root


def walk(node: list):
    """An element and all elements in it, in page order."""
    todo = [node]
    while todo:
        at = todo.pop()
        yield at
        todo += [x for x in reversed(at[PARTS_OF]) if type(x) is list]


def contents(root: list, unwanted) -> list[list]:
    """The outermost article and main elements that hold text, else the whole page."""
    found, todo = [], [root]
    while todo:
        at = todo.pop()
        if at[NAME] in ("article", "main"):
            if at[SAYS]:
                found.append(at)
        elif not unwanted(at, False):
            todo += [x for x in reversed(at[PARTS_OF]) if type(x) is list]
    return found or [root]


def lines(root: list, unwanted) -> list[str]:
    """The blocks of an element, without the elements that are unwanted."""
    blocks: list[str] = []
    pieces: list[str] = []

    def flush():
        line = " ".join("".join(pieces).split())
        pieces.clear()
        if line:
            blocks.append(line)

    in_article = root[NAME] in ("article", "main")
    stack = [(root, iter(root[PARTS_OF]), in_article)]
    while stack:
        node, parts, inside = stack[-1]
        for part in parts:
            if type(part) is str:
                pieces.append(part)
                continue
            name = part[NAME]
            if name in BLOCKS:
                flush()
            elif name in ("td", "th"):
                pieces.append(" ")
            if not unwanted(part, inside):
                stack.append((part, iter(part[PARTS_OF]), inside or name in ("article", "main")))
                break
        else:
            if node[NAME] in BLOCKS:
                flush()
            stack.pop()
    flush()
    return blocks


def main_lines(root: list, deleted: frozenset) -> list[str]:
    """The blocks of a page's content."""
    named = lambda at, inside: at[NAMED] and (inside or at[NAME] != "article") or at[NAME] == "header" and not inside
    gone = lambda at, inside: at[NAME] in GONE or at[NAME] == "form"
    # a form that wraps the page's prose is no form field
    bare = lambda at, inside: at[NAME] in GONE or at[NAME] == "form" and not any(x[NAME] in PROSE and x[SAYS] for x in walk(at))
    recurs = lambda at, inside: at[DIGEST] in deleted and may_recur(at, inside)
    for tests in ((gone, named, recurs), (gone, recurs), (gone, named), (gone,), (bare, named), (bare,)):
        if recurs in tests and not deleted:
            continue
        unwanted = lambda at, inside, tests=tests: any(t(at, inside) for t in tests)
        blocks = [b for part in contents(root, unwanted) for b in lines(part, unwanted)]
        if blocks:
            return blocks
    return []


def may_recur(node: list, inside: bool) -> bool:
    """Whether an element can be a site template: any block of a page, only containers in an article."""
    name = node[NAME]
    return name not in ("html", "body", "article", "main") and (name in CONTAINERS if inside else name in CONTAINERS or name in BLOCKS)


def subtrees(root: list) -> set[bytes]:
    """Hashes of the elements of a page's content that a template may consist of."""
    plain = lambda at, inside: at[NAME] in GONE
    found = set()
    for part in contents(root, plain):
        inside = part[NAME] in ("article", "main")
        todo = [(x, inside) for x in part[PARTS_OF] if type(x) is list]
        while todo:
            at, within = todo.pop()
            if plain(at, within) or not at[SAYS]:
                continue
            if may_recur(at, within):
                found.add(at[DIGEST])
            todo += [(x, within or at[NAME] in ("article", "main")) for x in at[PARTS_OF] if type(x) is list]
    return found


def _compiled():
    return re.compile(TOKENS, re.S | re.I), re.compile(ATTRS)


def _number(digest: bytes) -> int:
    return int.from_bytes(digest, "big", signed=True)


def _hashes(batches):
    schema = pa.schema([("page_id", pa.int64()), ("pkey", pa.int64()), ("host", pa.string()), ("subtree", pa.int64()), ("content", pa.int64())])
    compiled = _compiled()
    for batch in batches:
        out = []
        for page, key, host, html in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "pkey", "host", "html")), strict=True):
            root = read_tree(html.as_py() or "", *compiled)
            text = "\n".join(main_lines(root, frozenset()))
            content = _number(hashlib.blake2b(text.encode(), digest_size=8).digest())
            out += [(page.as_py(), key.as_py(), host.as_py(), h and _number(h), content) for h in subtrees(root) or (None,)]  # its content counts for the host all the same
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _extract(batches):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    compiled = _compiled()
    for batch in batches:
        out = []
        for page, url, html, deleted in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "html", "subtrees")), strict=True):
            deleted = frozenset(x.to_bytes(8, "big", signed=True) for x in deleted.as_py() or ())
            text = "\n".join(main_lines(read_tree(html.as_py() or "", *compiled), deleted))
            out.append((page.as_py(), url.as_py(), text, len(text)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def main_text(pages: DataFrame, least: int = LEAST, share: float = SHARE, plenty: int = PLENTY) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    key = ["page_id", "pkey"]
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.xxhash64("html", "url").alias("pkey"))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)), F.lit(""))
    seen = rows.withColumn("host", host).mapInArrow(_hashes, "page_id long, pkey long, host string, subtree long, content long")
    seen = materialize(seen, "subtrees")
    size = seen.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("contents"))
    counts = seen.where("subtree is not null").select("host", "subtree", "content").distinct().groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    templates = counts.join(size, "host").where(F.col("n") >= F.least(share * F.col("contents"), F.lit(plenty))).select("host", "subtree")
    found = seen.join(templates, ["host", "subtree"]).groupBy(*key).agg(F.collect_set("subtree").alias("subtrees"))
    return rows.join(found.hint("shuffle_hash"), key, "left").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
