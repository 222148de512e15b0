"""HTML extraction by union-free wrappers that are inferred for each host.

A page is a tree of tags (name, class, id) and texts.  Two trees with the same root are aligned child by
child (longest common subsequence of tags); what only one of them has becomes an optional group, equal
neighbours become a repeated group, and texts that differ become a slot - texts that stay equal are part of
the template.  Folding all pages of a host gives its wrapper: a regular expression over tags without unions.

The fold is associative enough to run in levels.  A scan task folds its own pages by (host, skeleton);
partial trees are folded by (host, skeleton, salt), then by (host, skeleton), then by host, so a host with a
third of all pages reaches a task as its distinct skeletons.  Pages meet their wrapper by a broadcast of at
most ``broadcast_bytes``, or by a shuffled join on the host beyond that.

A slot is main text if it lies in the article (or <main>; without either, anywhere in the body) and under
none of the elements or class and id words of PARTS_OUT.  Template is what has the same text wherever its place was
seen, in at least three pages of different main text and in half of the host's.  In an article, template text is main
(a heading may be the same on every page) but for menus: elements of LISTS all of whose text is in links and which
are template as a whole.  Without an article no template text is main.  Copies of a page and equal neighbours in it
are one sighting.  All of a host's pages with an article, and all without one, are counted, by names (hashes of main
text).  Pages of one skeleton have the same places, so a place is seen in whole groups of pages: the fold keeps sets of
groups, and names are counted by the groups that they are in, apart from the fold.

Levels below DEEPEST are flattened: their tags stay on the stack, so end tags match, and only an article, a
header or a part without main text is still an element of its own there.

Nulls: null html is the empty page, a null url has the empty host.  Broken markup is read as far as it goes.
Repeated rows get a row each.  An empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash64, stage, text_array

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>"']*+(?:["'][^\s/>"']*+)*)((?:"[^"]*"|'[^']*'|[^>"']++)*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: The open elements that a start tag ends, and the ends of RAW elements.
SHUTS = {x: CLOSES.get(x, set()) | ({"p"} if x in ENDS_P else set()) for x in CLOSES.keys() | ENDS_P}
RAW_END = {x: re.compile(rf"</{x}\s*[^>]*>", re.I) for x in RAW}
#: Elements and words of class, id and role that hold no main text.
PARTS_OUT = frozenset("nav aside footer form script style head title textarea noscript iframe template svg button select dialog menu".split())
WORDS_OUT = frozenset(
    "ad ads adv advert adverts advertisement sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead cookie cookies consent notice alert popup modal overlay comment comments disqus respond share sharing social related recommended newsletter subscribe signup login search form widget toolbar pagination pager copyright legal complementary contentinfo".split()
)
#: Elements that are menus if links hold all their text.
LISTS = frozenset("dir div dl ol p section table ul".split())
#: Levels of the tree; deeper ones are flattened.
DEEPEST = 120


class Node:
    """A tag with children; tag "#" is a text. opt and rep: optional and repeated group; const: what a text, or all that a list
    of links holds, was each of the times it was seen; seen: the groups of pages it (or the root) was seen in, as bits, and of a
    finished wrapper the numbers of these pages without and with an article."""

    __slots__ = ("tag", "marks", "key", "kids", "opt", "rep", "text", "const", "seen")

    def __init__(self, tag: str, marks: str = "", kids=None, opt=False, rep=False, text="", const=None, seen=0):
        self.tag, self.marks, self.key, self.kids, self.opt, self.rep, self.text, self.const, self.seen = tag, marks, f"{tag} {marks}", kids or [], opt, rep, text, const, seen


#: White space between inline parts.
BLANK = Node("_")


def marks_of(attributes: str) -> str:
    found = set()
    for name, value in ATTRIBUTE.findall(attributes):
        if name.lower() == "hidden":
            found.add("hidden")
        elif name.lower() in ("class", "role") or not re.search(r"\d", value):
            found.update(re.split(r"[^a-z]+", value.lower()))
    return " ".join(sorted(found - {""}))


def parse(page: str) -> Node:
    root = Node("root")
    open_ = [root]
    names: dict[str, int] = {}  # of the open tags
    deep: list[tuple] = []  # of each open tag below DEEPEST: flattened, and whether outside, an article or a header is around
    at, size = 0, len(page)

    def shut_from(k: int) -> None:
        for x in open_[k:]:
            names[x.tag] -= 1
        apart = any(d[0] and x.tag not in INLINE for x, d in zip(open_[max(k, DEEPEST) :], deep[max(0, k - DEEPEST) :], strict=True))
        del open_[k:], deep[max(0, k - DEEPEST) :]
        if apart:
            open_[-1].kids.append(BLANK)

    def enter_deep(node: Node) -> None:
        out, article, header = deep[-1][1:] if deep else (any(map(outside, open_[1:])), any(x.tag in ("article", "main") for x in open_), any(x.tag == "header" for x in open_))
        own = (not out and outside(node), not out and not article and node.tag in ("article", "main"), not out and not article and not header and node.tag == "header")
        flat = not any(own)
        deep.append((flat, out or own[0], article or own[1], header or own[2]))
        if flat:
            node.kids = open_[-1].kids
            if node.tag not in INLINE:
                node.kids.append(BLANK)
        else:
            open_[-1].kids.append(node)

    while at < size:
        start = page.find("<", at)
        m = TOKEN.match(page, start) or TOKEN.search(page, start + 1) if start >= 0 else None
        start = m.start() if m else size
        if at < start:
            text, kids = page[at:start], open_[-1].kids
            if not text.isspace():
                kids.append(Node("#", text=text))
            elif kids:
                kids.append(BLANK)
        if not m:
            break
        at = m.end()
        end, name, attributes, end_, name_, attributes_ = m.groups()
        if name is None:
            if name_ is None:
                continue
            end, name, attributes = end_, name_, attributes_
        name = name.lower()
        if end:
            if not names.get(name):
                continue
            if open_[-1].tag == name and len(open_) <= DEEPEST:
                open_.pop()
                names[name] -= 1
                continue
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag == name:
                    shut_from(k)
                    break
            continue
        if name in SHUTS:
            shut = SHUTS[name]
            for k in range(len(open_) - 1, 0, -1) if any([names.get(x) for x in shut]) else ():
                if open_[k].tag in shut:
                    shut_from(k)
                    break
                if open_[k].tag not in INLINE and open_[k].tag not in ("p", "td", "th"):
                    break
        node = Node(name, marks_of(attributes) if attributes else "")
        if name in VOID or attributes.endswith("/") and name in ("svg", "path"):
            open_[-1].kids.append(node)
        elif name in RAW:
            open_[-1].kids.append(node)
            m = RAW_END[name].search(page, at)
            text = page[at : m.start() if m else size]
            at = m.end() if m else size
            if text.strip():
                node.kids.append(Node("#", text=text))
        else:
            if len(open_) < DEEPEST:
                open_[-1].kids.append(node)
            else:
                enter_deep(node)
            open_.append(node)
            names[name] = names.get(name, 0) + 1
    return root


def fold_kids(kids: list[Node]) -> list[Node]:
    """Equal neighbours become one repeated group."""
    out: list[Node] = []
    for k in kids:
        if k.tag == "_":
            continue
        if out and out[-1].key == k.key:
            one = merge(out[-1], k)
            one.rep, one.opt = True, out[-1].opt and k.opt
            out[-1] = one
        else:
            out.append(k)
    return out


def linked(node: Node, inside: bool, out: list[str]) -> bool:
    """Puts the texts of an element, in order, into out; false if one is outside links."""
    for k in node.kids:
        if k.tag == "#":
            if not inside:
                return False
            out.append(" ".join(k.text.split()))
        elif k.kids and not linked(k, inside or k.tag == "a", out):
            return False
    return True


def crc(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def menu_name(node: Node) -> int | None:
    """A name of the text of a list if links, and nothing else, hold it."""
    found: list[str] = []
    return crc("\n".join(found)) if node.tag in LISTS and linked(node, False, found) and found else None


def skeleton(node: Node, seen: int = 0) -> Node:
    """A copy with repeated groups folded and texts as slots or template text, seen in the pages of that group."""
    if node.tag == "#":
        return Node("#", const=crc(" ".join(node.text.split())), seen=seen)
    const = menu_name(node)
    kids = [skeleton(k, seen) for k in node.kids if k.tag != "_"]
    return Node(node.tag, node.marks, fold_kids(kids) if len(kids) > 1 else kids, const=const, seen=seen if node.tag == "root" or const is not None else 0)


@lru_cache(1 << 11)
def matching(ka: tuple[str, ...], kb: tuple[str, ...]) -> list:
    return SequenceMatcher(None, ka, kb, autojunk=False).get_matching_blocks()


def aligned(a: list[Node], b: list[Node]) -> Iterator[tuple[Node | None, Node | None]]:
    ka, kb = tuple([x.key for x in a]), tuple([x.key for x in b])
    if ka == kb:
        return zip(a, b, strict=True)
    out: list[tuple[Node | None, Node | None]] = []
    i = j = 0
    # short lists come again and again; long ones would only fill the memory
    for at, to, size in (matching if len(ka) + len(kb) <= 32 else matching.__wrapped__)(ka, kb):
        out += [(x, None) for x in a[i:at]]
        out += [(None, x) for x in b[j:to]]
        i, j = at + size, to + size
        out += zip(a[at:i], b[to:j], strict=True)
    return iter(out)


def merge(a: Node, b: Node) -> Node:
    """The least expression of this kind that matches both."""
    same = a.const is not None and a.const == b.const
    const = a.const if same else None
    if a.tag == "#":
        return Node("#", "", None, a.opt or b.opt, a.rep or b.rep, "", const, a.seen | b.seen if same else 0)
    kids = []
    for x, y in aligned(a.kids, b.kids):
        if x and y:
            kids.append(merge(x, y))
        else:
            one = x or y
            kids.append(Node(one.tag, one.marks, one.kids, True, one.rep, const=one.const, seen=one.seen))
    return Node(a.tag, a.marks, fold_kids(kids) if len(kids) > 1 else kids, a.opt or b.opt, a.rep or b.rep, "", const, a.seen | b.seen if same or a.tag == "root" else 0)


def dump(n: Node) -> list:
    return ["#", int(n.opt), int(n.rep), n.const, n.seen] if n.tag == "#" else [n.tag, int(n.opt), int(n.rep), n.marks, [dump(k) for k in n.kids], n.seen, n.const]


def load(x: list) -> Node:
    return Node("#", opt=bool(x[1]), rep=bool(x[2]), const=x[3], seen=x[4]) if x[0] == "#" else Node(x[0], x[3], [load(k) for k in x[4]], bool(x[1]), bool(x[2]), seen=x[5], const=x[6])


def shape(n: Node) -> str:
    return "#" if n.tag == "#" else f"{n.key}{'+' if n.rep else ''}{'?' if n.opt else ''}({','.join(shape(k) for k in n.kids)})"


def outside(n: Node) -> bool:
    if n.tag in PARTS_OUT or not n.marks:
        return n.tag in PARTS_OUT
    words = n.marks.split()
    return not WORDS_OUT.isdisjoint(words) or "hidden" in words


def has_article(n: Node) -> bool:
    if n.tag in ("article", "main"):
        return True
    for k in n.kids:
        if k.kids or k.tag in ("article", "main"):
            if not outside(k) and has_article(k):
                return True
    return False


class Wrapper:
    """A host's expression and what of it is main text."""

    def __init__(self, tree: Node | None, pages: int):
        self.tree, self.pages = tree, pages
        self.known: dict[int, tuple[dict[str, Node], dict[str, Node]]] = {}

    def keys(self, template: Node) -> tuple[dict[str, Node], dict[str, Node]]:
        """The first and the last child of each key."""
        if id(template) not in self.known:
            self.known[id(template)] = {t.key: t for t in reversed(template.kids)}, {t.key: t for t in template.kids}
        return self.known[id(template)]

    def fixed(self, slot: Node, article: bool) -> bool:
        return slot.const is not None and bool(slot.seen) and slot.seen[article] >= max(3, (self.tree.seen[article] + 1) // 2)

    def blocks(self, page: Node) -> list[str]:
        article = has_article(page)
        out: list[str] = []
        part: list[str] = []

        def close() -> None:
            if part:
                text = " ".join(entities.unescape("".join(part)).split())
                if text:
                    out.append(text)
                part.clear()

        def walk(node: Node, template: Node | None, main: bool) -> None:
            match, by_key = {}, None
            if template is not None:
                first, last = self.keys(template)
                if not template.rep:
                    match = {id(k): t for k, t in aligned([k for k in node.kids if k is not BLANK], template.kids) if k}
                by_key = first if match else last
            for k in node.kids:
                if k is BLANK:
                    part.append(" ")
                    continue
                t = None if by_key is None else match.get(id(k)) or by_key.get(k.key)
                if k.tag == "#":
                    fixed = t is not None and not article and self.fixed(t, False)
                    if main and not fixed:
                        part.append(k.text)
                elif outside(k) or k.tag == "header" and not (main and article):
                    close()
                elif t is not None and main and article and self.fixed(t, True) and menu_name(k) == t.const:
                    close()
                else:
                    inside = main or article and k.tag in ("article", "main")
                    inline = k.tag in INLINE
                    if not inline:
                        close()
                    if k.kids:
                        walk(k, t, inside)
                    if not inline:
                        close()

        walk(page, self.tree, not article)
        close()
        return out


def page_name(page: Node) -> int:
    """The name of the page's main text, before anything is template: odd for pages with an article."""
    name = int(hash64(["\n".join(Wrapper(None, 0).blocks(page)).encode("utf-8", "surrogatepass")])[0]) >> 1
    return name | 1 if has_article(page) else name & ~1


def shape_name(s: str) -> str:
    b = s.encode("utf-8", "surrogatepass")
    return f"{zlib.crc32(b)}-{int(hash64([b])[0]):x}"


HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PARTIAL = "host string, shape string, pages long, tree string"
NAMED = f"{PARTIAL}, names array<long>"


def partial_trees(flush: int = 2000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list] = {}
        size = 0  # pages held

        def out() -> pa.RecordBatch:
            rows = [(h, shape_name(s), n, json.dumps(dump(t), separators=(",", ":")), list(names)) for (h, s), (n, t, names) in held.items()]
            held.clear()
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["host", "shape", "pages", "tree", "names"])

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), text_array(batch.column(1)), strict=True):
                parsed = parse(page.as_py())
                tree = skeleton(parsed)
                key = (host, shape(tree))
                if key in held:
                    n, other, names = held[key]
                    names.add(page_name(parsed))
                    held[key] = [n + 1, merge(other, tree), names]
                else:
                    held[key] = [1, tree, {page_name(parsed)}]
                size += 1
                if len(held) >= flush or size >= 50 * flush:
                    yield out()
                    size = 0
        if held:
            yield out()

    return run


def fold_rows(key: tuple, rows: Iterator[pa.RecordBatch] | pa.Table) -> pa.Table:
    table = rows if isinstance(rows, pa.Table) else pa.Table.from_batches(rows)
    tree, pages = None, 0
    ordered = sorted(zip(table["shape"].to_pylist(), table["tree"].to_pylist(), table["pages"].to_pylist(), strict=True))
    for _, text, n in ordered:
        other = load(json.loads(text))
        tree = other if tree is None else merge(tree, other)
        pages += n
    return pa.table({"host": pa.array([table["host"][0].as_py()]), "shape": pa.array([ordered[0][0]]), "pages": pa.array([pages], pa.int64()), "tree": pa.array([json.dumps(dump(tree), separators=(",", ":"))])})


def placed(node: Node, seen: int) -> Node:
    """The tree of a group of pages, with what stays equal in all of them seen in that group."""
    node.seen = seen if node.tag == "root" or node.const is not None else 0
    for k in node.kids:
        placed(k, seen)
    return node


def counted(node: Node, counts: list[tuple[int, int, int]], known: dict[int, tuple[int, int]]) -> Node:
    """The tree with numbers of pages for groups; counts: groups as bits, with an article or not, names in just these groups."""
    if node.seen not in known:
        known[node.seen] = tuple(sum(n for groups, kind, n in counts if kind == k and groups & node.seen) for k in (0, 1)) if node.seen else ()
    node.seen = known[node.seen]
    for k in node.kids:
        counted(k, counts, known)
    return node


def fold_host(key: tuple, trees: pa.Table, names: pa.Table) -> pa.Table:
    """host, pages, tree: the wrapper of a host of its trees, one of each shape, and of its names' counts (shapes, kind, n)."""
    tree, pages, groups = None, 0, {}
    for at, (shape_, text, n) in enumerate(sorted(zip(trees["shape"].to_pylist(), trees["tree"].to_pylist(), trees["pages"].to_pylist(), strict=True))):
        groups[shape_] = 1 << at
        other = placed(load(json.loads(text)), 1 << at)
        tree = other if tree is None else merge(tree, other)
        pages += n
    counts = [(sum(groups[s] for s in shapes), kind, n) for shapes, kind, n in zip(names["shapes"].to_pylist(), names["kind"].to_pylist(), names["n"].to_pylist(), strict=True)]
    tree = counted(tree, counts, {})
    return pa.table({"host": pa.array([trees["host"][0].as_py()]), "pages": pa.array([pages], pa.int64()), "tree": pa.array([json.dumps(dump(tree), separators=(",", ":"))])})


def infer(pages: DataFrame, salts: int = 64) -> DataFrame:
    """host, pages, tree: the wrapper of every host."""
    rows = pages.select(F.coalesce(F.lower(F.regexp_extract("url", HOST, 1)), F.lit("")).alias("host"), F.col("html").cast("string").alias("html"))
    found = stage(rows.mapInArrow(partial_trees(), NAMED), "partial")
    rows = found.withColumn("salt", F.pmod(F.xxhash64("tree", F.spark_partition_id()), F.lit(salts)))
    rows = rows.groupBy("host", "shape", "salt").applyInArrow(lambda key, t: fold_rows(key, t.select(["host", "shape", "pages", "tree"])), PARTIAL)
    rows = rows.groupBy("host", "shape").applyInArrow(fold_rows, PARTIAL)
    names = found.select("host", "shape", F.explode("names").alias("name")).groupBy("host", "name").agg(F.array_sort(F.collect_set("shape")).alias("shapes"))
    names = names.groupBy("host", "shapes", F.pmod("name", F.lit(2)).cast("int").alias("kind")).agg(F.count("*").alias("n"))
    return stage(rows.groupBy("host").cogroup(names.groupBy("host")).applyInArrow(fold_host, "host string, pages long, tree string"), "wrappers")


def extract(pages: DataFrame, *, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    wrappers = infer(pages)
    size = wrappers.agg(F.coalesce(F.sum(F.length("tree") + F.length("host")), F.lit(0))).first()[0]
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), F.coalesce(F.lower(F.regexp_extract("url", HOST, 1)), F.lit("")).alias("host"))
    joined = rows.join(F.broadcast(wrappers) if size <= broadcast_bytes else wrappers, "host", "left").select("page_id", "url", "html", "pages", "tree")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Wrapper] = {}
        for batch in batches:
            out = []
            for page, n, tree in zip(text_array(batch.column(2)), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if tree not in known:
                    if len(known) > 500:
                        known.clear()
                    known[tree] = Wrapper(load(json.loads(tree)) if tree else None, n or 0)
                out.append(" ".join(known[tree].blocks(parse(page.as_py()))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return joined.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
