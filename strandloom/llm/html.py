"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of one host.

A page is a stream of tags and text slots. Folding turns tandem repeats into groups (x)+; aligning two expressions turns what
only one has into optional groups (x)? and texts that differ into slots, so the wrapper of a host grows page by page.
Wrappers are merged as a tree, in each step at most FAN of them, so a host with a third of all pages is never one task's group.
What stands under an article or main element is the content, and where a page has none, everything else in the body but the
template: texts that stand at the same path on all pages of a host with pages that differ. Menus, headers, footers, sidebars,
notices, adverts, forms and comments are told by their elements and class names. A class that says no more than such a name
(comments, user-reviews, ad-slot, cookiebar) marks a box; of one that only has such a name among others (header-note, related-work)
the wrapper decides: slots of it that vary over the host's pages are text, fixed ones are template, and on a host whose pages don't
differ the name takes nothing away. Marks are overruled, too: a page whose articles are all marked is their text or the unmarked
rest, whichever is more once the template is gone; and where nothing is left without marked boxes, the slots of the host that
vary inside them are the content.

Optional tokens in a row are kept as one repeated group of the different ones among them, which matches all that they match, so a
wrapper is no longer than what all its pages share and the different paths between; and a task merges the shapes of a host when it
has SHAPES of them. So a host of irregular pages costs each page one alignment with a short wrapper.

Defined results: null html or html without main text gives an empty text; cut tags at the end are markup; an element that is
not closed ends with the box around it; a null url is a host of its own; repeated rows are extracted each; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import scan_parts, written

#: HTML elements by role.
SKIP = {"object", "select", "button"}
BOX = {"html", "body", "article", "main", "section", "div", "nav", "header", "footer", "aside", "form", "ul", "ol", "dl", "table", "figure", "dialog"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br"}
CHROME = {"nav", "header", "footer", "aside", "form", "dialog"}
CHROME_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disclaimer", "footer", "header", "masthead", "menu", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "popup", "promo", "related", "replies", "reviews", "share", "sidebar", "social", "sponsor", "sponsored", "subscribe", "teaser", "teasers", "thread", "toolbar"}
#: Parts of class names that say nothing of what a box holds.
NEUTRAL = {"area", "bar", "block", "bottom", "box", "button", "buttons", "container", "content", "discussion", "global", "group", "inner", "item", "items", "left", "links", "list", "main", "nav", "outer", "page", "panel", "reader", "right", "row", "section", "site", "slot", "top", "unit", "user", "widget", "wrap", "wrapper"}
#: Whole class names that mark a block element such as a paragraph.
LEAF_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "breadcrumb", "breadcrumbs", "cookie", "cookies", "newsletter", "promo", "share", "sponsored", "teaser"}
CONTENT = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements without text of the page: the first group ends with the page where it is not closed, of the second an open tag alone counts for nothing.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>script|style|textarea|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<pair>noscript|template|svg|iframe)\b[^>]*(?<!/)>.*?</(?P=pair)\s*>"
    r"|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<more>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)",
    re.S | re.I,
)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", re.I)
LONGEST_PERIOD = 12
#: Wrappers merged at once, and salts of a host where its rules can't be broadcast.
FAN, SALTS = 32, 16
#: Shapes of a host's pages that a task holds before it merges them, and optional tokens in a row that stay apart.
SHAPES, RUN = 64, 4


def stream(page: str | None) -> Iterator[tuple[str, str, str]]:
    """("open" | "close" | "text", tag, class names or text) of a page; comments, scripts and styles are gone."""
    at = 0
    for m in TOKEN.finditer(page or ""):
        if m.start() > at:
            yield "text", "", page[at : m.start()]
        at = m.end()
        if m["tag"]:
            names = " ".join("".join(g) for g in NAMES.findall(m["more"])) if m["more"] and not m["end"] else ""
            yield "close" if m["end"] else "open", m["tag"].lower(), names.lower()
    if page and at < len(page):
        yield "text", "", page[at:]


def marked(names: str, known: set[str]) -> str:
    """"~" if one of the class names says no more than a name of page furniture, "?" if one only has such a name among others, else ""."""
    weak = ""
    for name in names.split():
        parts = [p for p in re.split(r"[_-]+", name) if p]
        own = [p for p in parts if p in known or any(p.startswith(k) and p[len(k) :] in NEUTRAL for k in known if len(k) > 2)]
        if own and all(p in own or p in NEUTRAL or p.isdigit() for p in parts):
            return "~"
        weak = "?" if own else weak
    return weak


def blocks(page: str | None) -> list[tuple[str, str]]:
    """(path of boxes and the block element, text) of each block, in page order; what marks page furniture is in the path, ! for an element, ~ for a class name and ? with the names for part of one."""
    stack: list[tuple[str, str]] = []
    out: list[tuple[str, str]] = []
    held: list[str] = []
    skipping, leaf = "", ""

    def path() -> str:
        return ">".join([*(label for _, label in stack), *([leaf] if leaf else [])])

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((path(), text))

    for kind, tag, more in stream(page):
        if skipping and kind != "text":
            if kind == "close" and tag == skipping:
                skipping = ""
                continue
            # Not closed: a box or heading cannot stand in it, and it ends with the box around it.
            if tag in BOX and (kind == "open" or any(t == tag for t, _ in stack)) or tag in HEADINGS:
                skipping = ""
        if kind == "text":
            if not skipping:
                held.append(more)
        elif skipping:
            continue
        elif kind == "open" and tag in SKIP:
            skipping = tag
        elif tag in INLINE:
            if tag == "br":
                held.append(" ")
        else:
            flush()
            leaf = tag + "~" * (marked(more, LEAF_NAMES) == "~") if kind == "open" and tag not in BOX else ""
            if tag in BOX:
                if kind == "open":
                    named = marked(more, CHROME_NAMES) if more and tag not in ("html", "body") else ""
                    stack.append((tag, tag + ("!" if tag in CHROME else named + re.sub(r"[^a-z0-9_-]+", ".", more) if named == "?" else named)))
                elif any(t == tag for t, _ in stack):
                    while stack.pop()[0] != tag:
                        pass
    flush()
    return out


# --- expressions: a list of tokens; a token is [path, text digest or None] or ["+" | "?", expression] -------------------


def _shape(x: list) -> str:
    return x[0] if x[0] not in ("+", "?") else x[0] + "(" + " ".join(map(_shape, x[1])) + ")"


def _met(a: list, b: list) -> list:
    """Two tokens of one shape: texts that differ become a slot."""
    if a[0] in ("+", "?"):
        return [a[0], [_met(x, y) for x, y in zip(a[1], b[1], strict=True)]]
    return [a[0], a[1] if a[1] == b[1] else None]


def fold(tokens: list) -> list:
    """Tandem repeats to groups, shortest period first, until none is left."""
    changed = True
    while changed:
        changed = False
        for period in range(1, LONGEST_PERIOD + 1):
            shapes, i, out = [_shape(t) for t in tokens], 0, []
            while i < len(tokens):
                n = 1
                while shapes[i : i + period] == shapes[i + n * period : i + (n + 1) * period] and i + (n + 1) * period <= len(tokens):
                    n += 1
                if n == 1:
                    out.append(tokens[i])
                    i += 1
                    continue
                group = tokens[i : i + period]
                for k in range(1, n):
                    group = [_met(a, b) for a, b in zip(group, tokens[i + k * period : i + (k + 1) * period], strict=True)]
                one = group[0] if period == 1 and group[0][0] == "+" else ["+", group]
                out.append(one)
                i, changed = i + n * period, True
            tokens = out
            if changed:
                break
    return tokens


def _plain(token: list) -> tuple[list, str]:
    """A token without its marks, and the marks: x, (x)+ and (x)? align with each other."""
    marks = ""
    while token[0] in ("+", "?") and len(token[1]) == 1:
        marks, token = marks + token[0], token[1][0]
    return token, marks


def align(a: list, b: list) -> list:
    """The union-free expression of two: common tokens in order, the rest optional."""
    pa_, pb = [_plain(t) for t in a], [_plain(t) for t in b]
    out: list = []
    for op, i, j, k, m in SequenceMatcher(None, [_shape(t) for t, _ in pa_], [_shape(t) for t, _ in pb], autojunk=False).get_opcodes():
        if op == "equal":
            for (x, mx), (y, my) in zip(pa_[i:j], pb[k:m], strict=True):
                token = _met(x, y)
                for mark in "+?":
                    if mark in mx + my:
                        token = [mark, [token]]
                out.append(token)
        else:
            out += [t if t[0] == "?" else ["?", [t]] for t in a[i:j] + b[k:m]]
    return shortened(fold(out))


def plain_tokens(token: list) -> Iterator[list]:
    """The texts of a token, out of all groups."""
    if token[0] in ("+", "?"):
        for t in token[1]:
            yield from plain_tokens(t)
    else:
        yield token


def shortened(tokens: list) -> list:
    """The same expression with each long run of optional tokens as ((a)?(b)?...)+ of the different ones in it."""
    out, i = [], 0
    while i < len(tokens):
        j = i
        while j < len(tokens) and tokens[j][0] == "?":
            j += 1
        if j - i <= RUN:
            out += tokens[i : max(j, i + 1)]
            i = max(j, i + 1)
            continue
        different: dict[str, list] = {}
        for token in tokens[i:j]:
            for t in plain_tokens(token):
                different[t[0]] = _met(different[t[0]], t) if t[0] in different else t
        out.append(["?", [["+", [["?", [t]] for t in different.values()]]]])
        i = j
    return out


def digest_of(text: str) -> str:
    """128 bits of a text."""
    return xxhash.xxh3_128_hexdigest(text.encode("utf-8", "surrogatepass"))


def expression(page: list[tuple[str, str]]) -> list:
    return fold([[path, digest_of(text)] for path, text in page])


def merged(parts: list[tuple[int, list]]) -> tuple[int, list]:
    """(pages, wrapper) of several wrappers, in a fixed order."""
    parts = sorted(parts, key=lambda p: json.dumps(p[1]))
    pages, out = parts[0]
    for n, e in parts[1:]:
        pages, out = pages + n, out if e == out else align(out, e)
    return pages, out


def slots(wrapper: list, varies: bool = False) -> Iterator[tuple[str, bool]]:
    """(path, whether it varies by page) of each slot; what is optional or repeated varies."""
    for token, x in wrapper:
        if token in ("+", "?"):
            yield from slots(x, True)
        else:
            yield token, varies or x is None


def rules(differ: bool, wrapper: list) -> str:
    """What extraction needs of a wrapper: (path, digest, times) of the template's own texts outside articles, and the paths in boxes
    marked by class names whose slots vary. differ: the host has pages that differ; copies of one page tell nothing about its template."""
    fixed = Counter((p, d) for p, d in wrapper if differ and p not in ("+", "?") and d is not None and not is_content(p))
    varied = {p for p, varies in slots(wrapper) if differ and varies and ("~" in p or "?" in p) and "!" not in p}
    return json.dumps({"fixed": sorted([p, d, n] for (p, d), n in fixed.items()), "varied": sorted(varied), "differ": differ})


def in_content(path: str) -> bool:
    return "!" not in path and any(re.split("[~?]", label)[0] in CONTENT for label in path.split(">"))


def is_content(path: str) -> bool:
    return "~" not in path and in_content(path)


def main_text(page: list[tuple[str, str]], rule: dict) -> str:
    varied = set(rule["varied"])
    # The wrapper decides what a part of a name leaves open.
    page = [(p, t) for p, t in page if "?" not in p or not rule["differ"] or p in varied]
    keep = [t for p, t in page if is_content(p)]
    if not keep:
        left = {(p, d): n for p, d, n in rule["fixed"]}
        for p, t in page:
            if "!" in p or "~" in p:
                continue
            key = (p, digest_of(t)) if left else None
            if left.get(key, 0):
                left[key] -= 1
            else:
                keep.append(t)
        named = [t for p, t in page if in_content(p)]
        if sum(map(len, named)) > sum(map(len, keep)) > 0:
            keep = named
    if not keep:
        able = [(p, t) for p, t in page if (p in varied if rule["differ"] else in_content(p))]
        keep = [t for p, t in able if in_content(p)] or [t for _, t in able]
    return "\n".join(keep)


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


def wrappers(pages: DataFrame) -> DataFrame:
    """host, rules: the wrapper of each host, as its extraction rules."""

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[str, list]] = {}  # by host and shape: pages, expression
        ends: dict[str, tuple[str, str]] = {}  # by host: smallest and largest digest of a page
        for batch in batches:
            for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                found, host = blocks(page), host_of(url)
                e, digest = expression(found), digest_of(json.dumps(found))
                lo, hi = ends.get(host, (digest, digest))
                ends[host] = min(lo, digest), max(hi, digest)
                shape = " ".join(map(_shape, e))
                seen = known.setdefault(host, {}).get(shape)
                if seen is None:
                    if len(known[host]) >= SHAPES:
                        known[host] = {"": list(merged([tuple(x) for x in known[host].values()]))}
                    known[host][shape] = [1, e]
                else:
                    seen[0], seen[1] = seen[0] + 1, [_met(a, b) for a, b in zip(seen[1], e, strict=True)]
        salt = TaskContext.get().partitionId()
        rows = [(h, salt, *merged([tuple(x) for x in of.values()]), *ends[h]) for h, of in known.items()]
        col = lambda i, kind: pa.array([json.dumps(r[i]) if i == 3 else r[i] for r in rows], kind)
        yield pa.RecordBatch.from_arrays([col(0, pa.string()), col(1, pa.int32()), col(2, pa.int64()), col(3, pa.string()), col(4, pa.string()), col(5, pa.string())], names=["host", "salt", "pages", "wrapper", "lo", "hi"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        pages, wrapper = merged([(int(n), json.loads(w)) for n, w in zip(rows["pages"], rows["wrapper"], strict=True)])
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "salt": [rows["salt"].iloc[0]], "pages": [pages], "wrapper": [json.dumps(wrapper)], "lo": [rows["lo"].min()], "hi": [rows["hi"].max()]})

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        one = merge(rows)
        return pd.DataFrame({"host": one["host"], "rules": [rules(one["lo"][0] != one["hi"][0], json.loads(one["wrapper"][0]))]})

    schema = "host string, salt int, pages long, wrapper string, lo string, hi string"
    source = pages.select("url", "html")
    parts, left = source.mapInArrow(infer, schema), scan_parts(source)
    while left > FAN:  # a tree: each step merges FAN parts of a host
        left = -(-left // FAN)
        parts = parts.withColumn("salt", (F.col("salt") % left).cast("int")).groupBy("host", "salt").applyInPandas(merge, schema)
    return parts.groupBy("host").applyInPandas(finish, "host string, rules string")


def extract(pages: DataFrame, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """page_id, url, text, n_chars. The rules are broadcast only if they are small by measure, else both sides are joined by host."""
    found = written(wrappers(pages))
    size = found.agg(F.sum(F.length("host") + F.length("rules") + 64)).first()[0] or 0
    kind = pages.schema["page_id"].dataType.simpleString()
    host = F.coalesce(F.lower(F.regexp_extract("url", "(?i)" + HOST.pattern, 1)), F.lit(""))
    asked = pages.select("page_id", "url", "html", host.alias("of"), F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).alias("of_salt"))
    if size <= broadcast_bytes:
        met = asked.join(F.broadcast(found), F.col("of") == F.col("host"), "left")
    else:  # a host with very many pages is SALTS tasks
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = asked.join(salted, (F.col("of") == F.col("host")) & (F.col("of_salt") == F.col("salt")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rule = None, {"fixed": [], "varied": [], "differ": False}
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part, texts = batch.slice(i, 256), []
                for page, r in zip(part.column("html").to_pylist(), part.column("rules").to_pylist(), strict=True):
                    if r and r != last:
                        last, rule = r, json.loads(r)
                    texts.append(main_text(blocks(page), rule))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return met.select("page_id", "url", "html", "rules").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
