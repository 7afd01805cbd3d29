"""Main text by wrapper induction.

A page is a tree of blocks: the block elements of its marked articles, or else of the whole page, labelled by tag and classes,
with the texts between them as leaves. For each host, one page is the reference, and every page's tree is aligned with it
by simple tree matching. A text that pairs with a text of the reference is in that text's slot, wherever siblings come or
go before it; each text is also in the slot of its path of labels, which is all that a text without a pair has. Texts
that stay the same in their slot on most of the host's distinct pages are template; what varies, or is on fewer pages, is content, so a
sentence that a few pages quote at one place stays. So a passage that most pages of a host quote is template, marked or not. Pages of the same blocks are
one page in this, however many copies there are. What a reference lacks can still be template, by its path.

Tags and names are a further hint. Parts whose element or class names another role (navigation, advert, form, comments and
so on) are never content; inside a marked article, names that its own parts have as well (WEAK, such as "notice" or
"related") count only for a part that is mostly links.

Pages are parsed once, into a table of their trees. The template of a host comes from counts of (host, slot, text), summed
before and after the shuffle, so that a host's pages never meet in one task and a page's text depends on neither the size
of its host's input nor that of all. Only hashes are shuffled. A host's reference and template are joined to its pages; a
template is as large as what LEAST pages of a host share.

Defined cases: a null or empty html, or one without text, gives an empty text; a null url is a host of its own; null ids
are kept; repeated rows are extracted each; very long pages are read whole, and very deep ones flat below DEEPEST elements, where
parts of another role are still left out;
of equally good references the greatest by hash and text is taken; broken markup is closed as browsers do for paragraphs,
list items and cells; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Hashable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written

#: A block is template if at least LEAST distinct pages have it in its slot, and SHARE of all of the host's.
LEAST, SHARE = 4, 0.8

#: A reference has at most so many blocks if its host has such a page.
LARGEST = 256
#: Of the table of sums of two rows of siblings; beyond it the rows are halved.
CELLS = 1 << 22
#: Elements in each other that are kept apart.
DEEPEST = 200
LEAF = "#"
#: Distinct subtrees that a task remembers.
REMEMBERED = 100_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template head title nav footer aside form iframe svg canvas object button select textarea option dialog menu audio video map".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img data output".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
OTHER_ROLE = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adsense|sponsor(?:ed)?|promo(?:tion)?s?|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|nav|navbar|navigation|navi|menu|breadcrumbs?|pagination|pager|sidebar|side|widget|footer|foot|comments?|commentlist|disqus|respond|reply|replies|share|sharing|social|related|recommended|login|search|skip|tags?|toolbar|topbar|masthead|copyright)(?:$|[\s_-])", re.I)
HEADING_ROLE = re.compile(r"(?:^|[\s_-])(?:header|site-?header|page-?header|topnav)(?:$|[\s_-])", re.I)
#: Names that an article's own parts have as well: inside one they count only for a part that is mostly links.
WEAK = frozenset("alert banner copyright foot notice notices promo promos promotion promotions recommended related search side skip tag tags widget".split())
_NAME, _NUMBER = re.compile(r"[\s_-]+"), re.compile(r"\d+")
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())


class Node:
    __slots__ = ("tag", "classes", "names", "role", "hidden", "children")

    def __init__(self, tag: str, attrs: dict[str, str | None]) -> None:
        self.tag, self.children, self.classes = tag, [], attrs.get("class") or ""
        if not attrs:
            self.names, self.role, self.hidden = "", "", False
            return
        self.names = f"{self.classes} {attrs.get('id') or ''}".strip()
        self.role = (attrs.get("role") or "").lower()
        self.hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in (attrs.get("style") or "").replace(" ", "").lower()


class Tree(HTMLParser):
    """Elements deeper than DEEPEST lie flat in the deepest one, as browsers lay them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open, self.n, self.over = [self.root], Counter(), 0
        self.muted = 0  # open elements from one of another role on that lies too deep to be kept apart

    def updatepos(self, i: int, j: int) -> int:
        """Lines and columns aren't asked for."""
        return j

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.muted:
            self.muted += tag not in VOID
            return
        if tag not in INLINE and tag not in ("tr", "td", "th", "tbody", "thead", "tfoot"):
            self._close({"p"}, {"table", "td", "th", "button"})
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        node = Node(tag, dict(attrs))
        if len(self.open) >= DEEPEST and tag not in VOID and deep_role(node):
            self.muted = 1
            return
        self.open[-1].children.append(node)
        if tag in VOID:
            return
        if len(self.open) >= DEEPEST:
            self.over += 1
        else:
            self.open.append(node)
            self.n[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("script", "style", "textarea", "title"):
            self.handle_endtag(tag)

    def _cut(self, i: int) -> None:
        for x in self.open[i:]:
            self.n[x.tag] -= 1
        del self.open[i:]
        self.over = 0

    def _close(self, tags: set[str], within: set[str]) -> None:
        if not any(self.n[t] for t in tags):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in within:
                return
            if self.open[i].tag in tags:
                self._cut(i)
                return

    def handle_endtag(self, tag: str) -> None:
        if self.muted:
            self.muted -= tag not in VOID
        elif self.over:
            self.over -= 1
        elif self.n[tag]:
            self._cut(next(i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == tag))

    def handle_data(self, data: str) -> None:
        if not self.muted:
            self.open[-1].children.append(data)


def parse(html: str | None) -> Node:
    tree = Tree()
    if html:
        tree.feed(html.replace("\x00", ""))
        tree.close()
    return tree.root


def other_role(n: Node, inside: bool) -> bool:
    """Not part of an article; inside: within a marked article, where a header is the article's own."""
    if n.tag in SKIPPED or n.hidden or n.role in ROLES:
        return True
    if n.tag in ("html", "body", "article", "main") and not (n.tag == "article" and inside):
        return False
    if not inside and (n.tag == "header" or n.names and HEADING_ROLE.search(n.names)):
        return True
    if not n.names or not OTHER_ROLE.search(n.names):
        return False
    return not inside or mostly_links(n) or any(OTHER_ROLE.search(w) for w in _NAME.split(n.names.lower()) if w not in WEAK)


def deep_role(n: Node) -> bool:
    """Of another role by itself, whatever is in it and around it."""
    if n.tag in SKIPPED or n.hidden or n.role in ROLES:
        return True
    return bool(n.names) and any(OTHER_ROLE.search(w) for w in _NAME.split(n.names.lower()) if w not in WEAK)


def mostly_links(n: Node) -> bool:
    """Half of its characters or more are in links."""
    size = [0, 0]

    def walk(x: Node, link: bool) -> None:
        for c in x.children:
            if isinstance(c, str):
                size[link] += len("".join(c.split()))
            else:
                walk(c, link or c.tag == "a")

    walk(n, n.tag == "a")
    return size[1] >= size[0]


def articles(n: Node) -> list[Node]:
    """The outermost marked articles; those inside a main element unless it has none."""
    found, mains = [], []

    def walk(x: Node) -> None:
        for c in x.children:
            if isinstance(c, str) or other_role(c, False):
                continue
            if c.tag == "article" and not (c.names and OTHER_ROLE.search(c.names)):
                found.append(c)
            elif c.tag == "main" or c.role == "main":
                mains.append(c)
                walk(c)
            else:
                walk(c)

    walk(n)
    return found or mains


def step(n: Node) -> str:
    """A node in a path: its tag and classes, numbers left out, as those of page ids differ."""
    return f"{n.tag}.{_NUMBER.sub('#', ' '.join(n.classes.split()))}" if n.classes else n.tag


def blocks(n: Node, inside: bool) -> Iterator[tuple[int, str, str | None]]:
    """The block elements below n, n first, and the text of each run between them as a leaf: depth, label, text."""
    run: list[str] = []
    out: list[tuple[int, str, str | None]] = [(0, n.tag, None)]

    def close(depth: int) -> None:
        if text := " ".join("".join(run).split()):
            out.append((depth, LEAF, text))
        run.clear()

    def walk(x: Node, depth: int) -> None:
        for c in x.children:
            if isinstance(c, str):
                run.append(c)
            elif c.tag == "br":
                run.append(" ")
            elif other_role(c, inside):
                if c.tag not in INLINE:
                    close(depth)
            elif c.tag in INLINE:
                walk(c, depth)
            else:
                close(depth)
                out.append((depth, step(c), None))
                walk(c, depth + 1)
                close(depth + 1)

    walk(n, 1)
    close(1)
    return iter(out)


class Blocks:
    """A page as its tree of blocks in document order: its marked articles, or else the whole page, below one root."""

    __slots__ = ("labels", "texts", "kids", "paths", "shape", "whole", "size", "ends", "leaves")

    def __init__(self, rows: list[tuple[int, str, Hashable | None]], shapes: dict, wholes: dict) -> None:
        """rows: depth, label and text, or a hash of it. shapes, wholes: what numbers equal subtrees, without and with their texts,
        alike among the pages compared."""
        n = len(rows)
        depths, self.labels, self.texts = [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]
        self.kids, self.paths = [[] for _ in range(n)], [""] * n
        around: list[int] = []
        for i in range(n):
            del around[depths[i] :]
            if around:
                self.kids[around[-1]].append(i)
                self.paths[i] = self.paths[around[-1]] if self.texts[i] is not None else f"{self.paths[around[-1]]}/{self.labels[i]}"
            around.append(i)
        self.shape, self.whole, self.size, self.ends, self.leaves = [0] * n, [0] * n, [1] * n, [0] * n, [0] * n
        for i in range(n - 1, -1, -1):
            k = self.kids[i]
            self.shape[i] = shapes.setdefault((self.labels[i], *(self.shape[c] for c in k)), len(shapes))
            self.whole[i] = wholes.setdefault((self.labels[i], self.texts[i], *(self.whole[c] for c in k)), len(wholes))
            self.size[i] = 1 + sum(self.size[c] for c in k)
            self.ends[i] = self.ends[k[-1]] if k else i + 1
            self.leaves[i] = sum(self.leaves[c] for c in k) if k else int(self.texts[i] is not None)


def block_rows(html: str | None) -> list[tuple[int, str, str | None]]:
    page = parse(html)
    roots = articles(page)
    return [(0, "#page", None)] + [(d + 1, label, text) for r in roots or [page] for d, label, text in blocks(r, bool(roots))]


class Match:
    """Simple tree matching of two pages: the greatest number of nodes that pair with equal labels, parents with parents and
    in order; subtrees of equal texts count once more for each text, so that what stays the same pairs with itself."""

    def __init__(self, a: Blocks, b: Blocks) -> None:
        self.a, self.b, self.known = a, b, {}

    def score(self, x: int, y: int) -> int:
        a, b = self.a, self.b
        if a.labels[x] != b.labels[y]:
            return 0
        if a.shape[x] == b.shape[y]:
            return a.size[x]
        key = (a.shape[x], b.shape[y])
        if key not in self.known:
            self.known[key] = 1 + sum(self.weight(i, j) for i, j in self.paired(a.kids[x], b.kids[y]))
        return self.known[key]

    def weight(self, x: int, y: int) -> int:
        return self.score(x, y) + (self.a.leaves[x] if self.a.whole[x] == self.b.whole[y] else 0)

    def paired(self, p: list[int], q: list[int]) -> list[tuple[int, int]]:
        """The pairs of two rows of siblings with the greatest sum of weights, in order. Equal ends pair with each other, as
        nothing outweighs them; where no texts are equal, that holds for ends of equal shape."""
        head, p, q, tail = _ends(p, q, self.a.whole, self.b.whole)
        if p and q and not {self.a.whole[i] for i in p} & {self.b.whole[j] for j in q}:
            more, p, q, less = _ends(p, q, self.a.shape, self.b.shape)
            head, tail = head + more, less + tail
        if p and q:
            head += self._best(p, q)
        return head + tail

    def _best(self, p: list[int], q: list[int]) -> list[tuple[int, int]]:
        if len(p) * len(q) > CELLS and len(p) > 1:  # halves, so that memory stays that of one row
            m = len(p) // 2
            fore, back = self._sums(p[:m], q)[-1], self._sums(p[m:][::-1], q[::-1])[-1][::-1]
            at = int(np.argmax(fore + back))
            return (self._best(p[:m], q[:at]) if at else []) + (self._best(p[m:], q[at:]) if at < len(q) else [])
        sums = self._sums(p, q, True)
        out, i, j = [], len(p), len(q)
        while i and j:
            if sums[i][j] == sums[i - 1][j]:
                i -= 1
            elif sums[i][j] == sums[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((p[i], q[j]))
        return out[::-1]

    def _sums(self, p: list[int], q: list[int], keep: bool = False) -> list[np.ndarray]:
        """Rows of best sums over the first so many of p and of q; all of them, or the last."""
        b_shape, b_whole = np.array([self.b.shape[j] for j in q]), np.array([self.b.whole[j] for j in q])
        shapes, first, place = np.unique(b_shape, return_index=True, return_inverse=True)
        row, rows, by_shape = np.zeros(len(q) + 1, np.int64), [], {}
        rows.append(row)
        for i in p:
            s = self.a.shape[i]
            if s not in by_shape:
                by_shape[s] = np.array([self.score(i, q[k]) for k in first])[place]
            w = by_shape[s] + np.where(b_whole == self.a.whole[i], self.a.leaves[i], 0)
            over = np.where(w > 0, row[:-1] + w, 0)
            row = np.maximum.accumulate(np.maximum(row, np.concatenate([[0], over])))
            rows = [*rows, row] if keep else [row]
        return rows

    def pairs(self) -> dict[int, int]:
        """For each node of b that pairs with one of a, that one."""
        out, todo = {}, [(0, 0)] if self.a.labels[0] == self.b.labels[0] else []
        while todo:
            x, y = todo.pop()
            if self.a.shape[x] == self.b.shape[y] and (self.a.whole[x] == self.b.whole[y] or self.a.leaves[x] <= 1):
                out.update(zip(range(y, self.b.ends[y]), range(x, self.a.ends[x]), strict=True))
                continue
            out[y] = x
            todo += self.paired(self.a.kids[x], self.b.kids[y])
        return out


def _ends(p: list[int], q: list[int], of_p: list[int], of_q: list[int]) -> tuple[list, list[int], list[int], list]:
    """Pairs of the equal first and of the equal last siblings, and what is between."""
    n, most = 0, min(len(p), len(q))
    while n < most and of_p[p[n]] == of_q[q[n]]:
        n += 1
    m = 0
    while m < most - n and of_p[p[-1 - m]] == of_q[q[-1 - m]]:
        m += 1
    return list(zip(p[:n], q[:n], strict=True)), p[n : len(p) - m], q[n : len(q) - m], list(zip(p[len(p) - m :], q[len(q) - m :], strict=True))


def _key(*parts: str) -> int:
    import xxhash

    k = xxhash.xxh64_intdigest("\0".join(parts).encode("utf-8", "replace"))
    return k - (1 << 64) if k >> 63 else k


def slots(page: Blocks, reference: Blocks) -> list[tuple[int, str, Hashable | None]]:
    """For each text of the page: its place, a slot it is in, and the text, or None where the slot's text varies. Each is in
    the slot of its path; if it pairs with a text of the reference, in the slot of that one as well."""
    pairs = Match(reference, page).pairs()
    out: list[tuple[int, str, Hashable | None]] = []
    for i, t in enumerate(page.texts):
        if t is not None:
            out.append((i, page.paths[i], t))
            if i in pairs:
                out.append((i, f"#{pairs[i]}", t if t == reference.texts[pairs[i]] else None))
    return out


def template(pages: list[Blocks], reference: Blocks) -> set[tuple[str, str]]:
    """The (slot, text) that stay the same on most of the distinct pages."""
    distinct = {frozenset((p.paths[i], t) for i, t in enumerate(p.texts) if t is not None): p for p in pages}
    found = [{(slot, t) for _, slot, t in slots(p, reference)} for p in distinct.values()]
    n = Counter(x for f in found for x in f if x[1] is not None)
    return {x for x, k in n.items() if k >= LEAST and k >= SHARE * len(distinct)}


def page_key(rows: list[tuple]) -> int:
    """Alike for pages of the same blocks, whatever their order."""
    return _key(*sorted({f"{p}\n{t}" for p, t in _paths(rows)}))


def worth(rows: list[tuple]) -> int:
    """A host's reference is its page of the greatest worth: of the most blocks that aren't too many, else of the fewest."""
    return len(rows) if len(rows) <= LARGEST else -len(rows)


def extract(htmls: list[str | None]) -> list[str]:
    """The main texts of pages of one host."""
    rows, shapes, wholes = [block_rows(h) for h in htmls], {}, {}
    pages = [Blocks(r, shapes, wholes) for r in rows]
    reference = pages[max(range(len(rows)), key=lambda i: (worth(rows[i]), page_key(rows[i]), *_packed(rows[i])[1:]))]
    same = template(pages, reference)
    drop = [{i for i, slot, t in slots(p, reference) if (slot, t) in same} for p in pages]
    return ["\n".join(t for i, t in enumerate(p.texts) if t is not None and i not in d) for p, d in zip(pages, drop, strict=True)]


_BLOCKS = "page_id long, url string, host string, page long, worth long, depths binary, labels string, marks binary, texts string"


def _packed(rows: list[tuple[int, str, str | None]]) -> tuple[bytes, str, bytes, str]:
    """Depths, labels, hashes of the texts, and the texts; labels and texts have no line ends, a text no empty form."""
    texts = [r[2] for r in rows if r[2] is not None]
    return bytes(r[0] for r in rows), "\n".join(r[1] for r in rows), np.array([_key(t) for t in texts], np.int64).tobytes(), "\n".join(texts)


def _unpacked(depths: bytes, labels: str, marks: bytes) -> list[tuple[int, str, int | None]]:
    """With the hash of a text in its place."""
    of_leaf = iter(np.frombuffer(marks, np.int64).tolist())
    return [(d, label, next(of_leaf) if label == LEAF else None) for d, label in zip(depths, labels.split("\n"), strict=True)]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.binary(), pa.string())
    for b in slices(batches):
        out = []
        for page_id, url, host, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "host", "html")), strict=True):
            rows = block_rows(html)
            out.append((page_id, url, host, page_key(rows), worth(rows), *_packed(rows)))
        columns = zip(*out, strict=True) if out else ((),) * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _BLOCKS.split(", ")])


def _paths(rows: list[tuple[int, str, str | None]]) -> Iterator[tuple[str, str]]:
    around: list[str] = []
    for depth, label, text in rows:
        del around[depth:]
        if text is not None:
            yield "/".join(around), text
        around.append(label)


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple[int, str, int | None]]]]:
    """Each page's other columns, and its slots by alignment with its host's reference."""
    tree = ("depths", "labels", "marks", "r_depths", "r_labels", "r_marks")
    shapes, wholes, met = {}, {}, {}
    for b in slices(batches):
        if len(wholes) > REMEMBERED:
            shapes, wholes, met = {}, {}, {}
        columns = [b.column(c).to_pylist() for c in tree]
        rest = zip(*(b.column(c).to_pylist() for c in b.schema.names if c not in tree), strict=True)
        for other, (*own, depths, labels, marks) in zip(rest, zip(*columns, strict=True), strict=True):
            reference = met.get((depths, labels, marks))
            if reference is None:
                reference = met[depths, labels, marks] = Blocks(_unpacked(depths, labels, marks), shapes, wholes)
            yield other, slots(Blocks(_unpacked(*own), shapes, wholes), reference)


def _pair(slot: int, mark: int) -> int:
    """A hash of both."""
    k = (slot * 0x9E3779B97F4A7C15 + mark * 0xBF58476D1CE4E5B9 + (slot ^ mark)) & 0xFFFFFFFFFFFFFFFF
    return k - (1 << 64) if k >> 63 else k


_VOTE = pa.schema([("host", pa.string()), ("page", pa.int64()), ("block", pa.int64())])


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page a row without a block, and its distinct blocks."""
    out: list[tuple] = []
    keys: dict[str, int] = {}
    for (host, page), found in _aligned(batches):
        own = {(host, page, None)}
        for _, slot, mark in found:
            if mark is None:
                continue
            k = keys.get(slot)
            if k is None:
                k = keys[slot] = _key(slot)
            own.add((host, page, _pair(k, mark)))
        out += own
        if len(out) > 20_000:
            yield _batch(out, _VOTE)
            out = []
        if len(keys) > REMEMBERED:
            keys.clear()
    if out:
        yield _batch(out, _VOTE)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_TEXT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for (page_id, url, texts, template), found in _aligned(batches):
        if texts and template:
            same = set(template)
            leaf = {i: k for k, i in enumerate(sorted({i for i, _, _ in found}))}
            drop = {leaf[i] for i, slot, mark in found if mark is not None and _pair(_key(slot), mark) in same}
            texts = "\n".join(t for k, t in enumerate(texts.split("\n")) if k not in drop) if drop else texts
        out.append((page_id, url, texts))
        size += len(texts) + 100
        if size > 2**21:
            yield _batch(out, _TEXT)
            out, size = [], 0
    if out:
        yield _batch(out, _TEXT)


def with_references(parsed: DataFrame) -> DataFrame:
    """The parsed pages, each with the blocks of its host's reference."""
    tree = F.struct(*(F.col(c).alias(f"r_{c}") for c in ("depths", "labels", "marks")))
    best = parsed.groupBy("host").agg(F.max_by(tree, F.struct("worth", "page", "labels", "marks", "depths")).alias("r")).select("host", "r.*")
    return parsed.join(written(best), "host")


def templates(aligned: DataFrame) -> DataFrame:
    """host, template: the hashes of the blocks that stay the same, by counts over all distinct pages of the host."""
    tree = [f"{r}{c}" for r in ("", "r_") for c in ("depths", "labels", "marks")]
    votes = aligned.select("host", "page", *tree).mapInArrow(_votes, "host string, page long, block long").distinct()
    counts = written(votes.groupBy("host", "block").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST))
    total = counts.filter("block is null").select("host", F.col("n").alias("total"))
    same = counts.filter("block is not null").join(total, "host").filter(F.col("n") >= SHARE * F.col("total"))
    return written(same.groupBy("host").agg(F.collect_set("block").alias("template")))


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), "html")
    aligned = with_references(written(rows.mapInArrow(_parsed, _BLOCKS)))
    tree = [f"{r}{c}" for r in ("", "r_") for c in ("depths", "labels", "marks")]
    texts = aligned.join(templates(aligned), "host", "left").select("page_id", "url", "texts", "template", *tree).mapInArrow(_texts, "page_id long, url string, text string")
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def query(pages: DataFrame) -> DataFrame:
    return main_texts(pages)
