"""Main text of web pages by wrappers: union-free regular expressions learnt from a host's pages.

A page is a tree of block elements and texts. The wrapper of a host is an expression over the same
symbols: elements with their content, texts that all pages share, slots whose text varies, optional
items, repeated items and repeated groups. Distinct pages of a host are aligned with it one after
another (`align`): content that both share literally anchors the alignment; between two anchors each
side is folded (what recurs among siblings becomes a repeated item or group), what corresponds is
aligned within, and what has no counterpart becomes optional. Where two texts differ the slot
varies; a slot keeps its most frequent text by majority votes, so that odd pages do not undo it.
A folded list holds each kind of element once between texts that half of the pages share, so wrappers do
not grow with pages or hosts.

Texts are read off by the wrapper's slots (`rules_of`): a slot whose text stands nearly alone there is
template and goes, inside articles too; elements whose name or class speaks for menus, adverts,
comments and the like are voted out unless the host's articles stand only inside of them; where a host
has articles, what lies outside of them goes; elsewhere slots that are mostly links go.

Rows go to tasks by host, in shares of SHARE rows where a host has more (salted by the page's hash, so
that copies of a page meet and count once); a task holds one wrapper at a time; the shares' wrappers
are aligned last. What is broadcast is counted and measured first.

Defined cases: null or empty html has empty text; a null url or one without host belongs to the host
""; repeated rows are read each and learnt from once; columns other than page_id, url and html are ignored.
Texts below DEEP nested blocks belong to the last of these. An h1 of an article is never template, nor is
anything on pages that would lose more than half of their text.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlog.llm.common import broadcast_if_small, materialise, small_batches, table

#: Rows of a host that one task aligns; nesting that the tree follows; pages from which text is template.
SHARE, DEEP, ENOUGH = 2000, 100, 4

#: Elements that end a block of text, and those without content.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text (raw up to their end), and controls of forms.
RAW = set("script style title textarea".split())
HIDDEN = set("noscript template svg select".split())
APART = set("nav aside footer form menu dialog head".split())
#: Those of them that never hold the article.
NEVER = set("nav aside footer menu dialog head".split())
#: Words in class, id or role that speak for menus, adverts, notices, comments and the like.
MARKS = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent "
    "contentinfo cookie cookies copyright disclaimer discussion disqus feedback footer form legal login masthead menu modal nav navbar "
    "navigation newsletter notice notices notification pager pagination popup promo promoted promotion recommended related replies "
    "reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
MAIN = {"article", "main"}
#: Open elements that an opening tag ends, nearest first, where the end tag may be omitted.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th", "caption"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"thead", "tbody", "tr", "td", "th", "caption"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}, "thead": {"caption"}, "body": {"head"},
}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</?[a-zA-Z][^>]*\Z|</?[a-zA-Z](?:\"[^\"]*\"|'[^']*'|[^>\"'])*[>\"']?|[^<]+|<", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
MARKING = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORD = re.compile(r"[\s_-]+")
LINK = re.compile(r"\shref\s*=", re.I)
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
#: Marks of a wrapper's items.
OPTIONAL, REPEATED = 1, 2
MASK = (1 << 63) - 1
GROUP = "+"


def signature(name: str, tag: str) -> str:
    """The element with its marking words: what pages of one template share."""
    words = sorted({w for m in MARKING.finditer(tag) for w in WORD.split((m[1] or m[2] or m[3] or "").lower()) if w in MARKS})
    return ".".join([name, *words])


class Block:
    """One block of text: the elements around it, its text, how much of it is linked."""

    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple[str, ...]):
        self.path, self.text, self.linked = path, [], 0


# items of trees and wrappers: [None, marks, literal, text's hash, votes, number, characters, linked ones],
# [signature, marks, literal, content] and [GROUP, marks, 0, members]; literal is 0 where text varies


def text_item(text: str, linked: int) -> list:
    h = xxhash.xxh64_intdigest(text) & MASK | 1
    return [None, 0, h, h, 1, 1, len(text), min(linked, len(text))]


def element(sig: str, marks: int, content: list) -> list:
    literal = 0
    if content:
        literal = zlib.crc32(sig.encode()) | 1
        for x in content:
            if x[1] or not x[2]:
                literal = 0
                break
            literal = (literal * 1_000_003 + x[2]) & MASK
    return [sig, marks, literal, content]


def parse(source: str) -> tuple[list, list[Block]]:
    """The page's tree and its blocks of text in order."""
    blocks: list[Block] = []
    root: list = []
    stack: list[tuple[str, tuple[str, ...], list]] = []  # name, path, content (the parent's below DEEP)
    own: Block | None = None
    silent, depth, link = "", 0, -1

    def close() -> None:
        nonlocal own
        if own is not None:
            joined = " ".join(entities.unescape("".join(own.text)).split())
            if joined:
                own.text = joined
                blocks.append(own)
                (stack[-1][2] if stack else root).append(text_item(joined, own.linked))
        own = None

    def pop() -> None:
        nonlocal link
        name, path, content = stack.pop()
        if len(stack) < link:
            link = -1
        above = stack[-1][2] if stack else root
        if content is not above:
            above.append(element(path[-1], 0, content))

    def push(name: str, sig: str) -> None:
        path = stack[-1][1] if stack else ()
        if len(path) < DEEP:
            stack.append((name, (*path, sig), []))
        else:
            stack.append((name, path, stack[-1][2]))

    for m in TOKEN.finditer(source):
        t = m[0]
        name = ""
        if t[0] == "<" and (n := NAME.match(t)):
            name = n[1].lower().rstrip("\"'")
        if silent:
            if name == silent:
                if t[1] == "/":
                    depth -= 1
                elif silent in HIDDEN and not t.endswith("/>"):
                    depth += 1
                if not depth:
                    silent = ""
            continue
        if not name:
            if t[0] == "<" and len(t) > 1:  # a comment or declaration; of CDATA the content
                if not t.startswith("<![CDATA["):
                    continue
                t = entities.escape(t[9:].removesuffix("]]>"))
            if own is None:
                if not t.strip():
                    continue
                own = Block(stack[-1][1] if stack else ())
            own.text.append(t)
            if link >= 0:
                own.linked += len(t)
            continue
        ending = t[1] == "/"
        if name in RAW or name in HIDDEN:
            if not ending and not t.endswith("/>") and (name in RAW or re.compile(f"</{name}", re.I).search(source, m.end())):
                silent, depth = name, 1
            continue
        if name == "br":
            if own is not None:
                own.text.append(" ")
            continue
        if name == "a":
            link = len(stack) if not ending and LINK.search(t) else -1
        if name not in BLOCKS:
            if name == "option" and own is not None:
                own.text.append(" ")
            continue
        close()
        if ending:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if at is not None:
                while len(stack) > at:
                    pop()
            continue
        if name in VOID:
            continue
        ends = ENDS.get(name, ())
        while stack and (stack[-1][0] == "p" or stack[-1][0] in ends or (stack[-1][0] == "head" and name != "head")):
            pop()
        push(name, signature(name, t))
    close()
    while stack:
        pop()
    return root, blocks


def support(x: list) -> int:
    """How many texts speak for an item's literal content, 0 if it has none."""
    return 0 if not x[2] else x[5] if x[0] is None else min(map(support, x[3]))


def keys(x: list, need: float) -> list:
    """The kinds of items that an item stands for. What `need` texts state literally is a kind of its own."""
    if x[0] == GROUP:
        return [m[0] for m in x[3]]
    return [x[2]] if support(x) >= need else [x[0]]


def marked(x: list, mark: int) -> list:
    return x if x[1] & mark else [x[0], x[1] | mark, *x[2:]]


def merged(x: list, y: list, need: float, within: bool) -> list:
    """Two items of one kind as one; within: from the same pages, so that their numbers don't add up, and
    texts that differ make the slot vary (hash 0) there."""
    marks = x[1] | y[1]
    if x[0] is not None:
        return element(x[0], marks, align(x[3], y[3], need, within))
    if within:
        n = max(x[5], y[5])
        h, votes = (x[3], max(x[4], y[4])) if x[3] == y[3] else (0, n)
    else:
        n = x[5] + y[5]
        if x[3] == y[3]:
            h, votes = x[3], x[4] + y[4]
        else:
            h, votes = (x[3], x[4] - y[4]) if x[4] >= y[4] else (y[3], y[4] - x[4])
    return [None, marks, h if votes * 2 >= n else 0, h, votes, n, x[6] + y[6], x[7] + y[7]]


def collapsed(span: list, need: float, within: bool) -> list:
    """A repeated item, or a repeated group of optional ones, that stands for all of these."""
    members: dict = {}
    for x in span:
        for m in x[3] if x[0] == GROUP else [x]:
            members[m[0]] = merged(members[m[0]], m, need, within) if m[0] in members else m
    if len(members) == 1:
        return marked(next(iter(members.values())), REPEATED)
    return [GROUP, 0, 0, [marked(m, OPTIONAL) for m in members.values()]]


def fold(items: list, need: float) -> list:
    """The list with each kind of item once between two items that are stated literally: from its first
    to its last place, what recurs is one repeated item or group."""
    out: list = []
    at: dict = {}
    for x in items:
        if support(x) >= need:
            at.clear()
            out.append(x)
            continue
        own = keys(x, need)
        i = min((at[k] for k in own if k in at), default=-1)
        if i < 0:
            for k in own:
                at[k] = len(out)
            out.append(x)
            continue
        g = collapsed([*out[i:], x], need, True)
        del out[i:]
        for k in keys(g, need):
            at[k] = i
        out.append(g)
    return out


def anchors(a: list, b: list) -> list[tuple[int, int]]:
    """Places of items that stand literally once in both, as many as keep their order."""
    there: dict[int, int] = {}
    for j, y in enumerate(b):
        if y[2]:
            there[y[2]] = -1 if y[2] in there else j
    once: dict[int, int] = {}
    for x in a:
        if x[2]:
            once[x[2]] = once.get(x[2], 0) + 1
    pairs = [(i, there[x[2]]) for i, x in enumerate(a) if x[2] and once[x[2]] == 1 and there.get(x[2], -1) >= 0]
    if len(pairs) < 2:
        return pairs
    # longest increasing subsequence of the second places
    from bisect import bisect_left

    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tails, j)
        before[k] = ends[p - 1] if p else -1
        tails[p : p + 1] = [j]
        ends[p : p + 1] = [k]
    out, k = [], ends[-1]
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def align(a: list, b: list, need: float, within: bool = False) -> list:
    """The expression that covers both lists of items."""
    if len(a) == 1 and len(b) == 1 and a[0][0] == b[0][0] and a[0][0] != GROUP:
        return [merged(a[0], b[0], need, within)]
    out: list = []
    i = j = 0
    for p, q in [*anchors(a, b), (len(a), len(b))]:
        out += mended(a[i:p], b[j:q], need, within)
        if p < len(a):
            out.append(merged(a[p], b[q], need, within))
        i, j = p + 1, q + 1
    return out


def mended(a: list, b: list, need: float, within: bool) -> list:
    """Covers two stretches without common literal content: corresponding items in order, the rest optional."""
    if not a or not b:
        return [marked(x, OPTIONAL) for x in fold(a or b, need)]
    a, b = fold(a, need), fold(b, need)
    ka, kb = [set(keys(x, need)) for x in a], [set(keys(y, need)) for y in b]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(len(b) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if ka[i] & kb[j] else max(below[j], row[j + 1])
    out: list = []
    i = j = 0
    while i < len(a) and j < len(b):
        if ka[i] & kb[j]:
            x, y = a[i], b[j]
            out.append(merged(x, y, need, within) if x[0] == y[0] != GROUP else collapsed([x, y], need, within))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append(marked(a[i], OPTIONAL))
            i += 1
        else:
            out.append(marked(b[j], OPTIONAL))
            j += 1
    out += [marked(x, OPTIONAL) for x in [*a[i:], *b[j:]]]
    return fold(out, need)


def joined_wrappers(a: list, n: int, b: list, k: int) -> list:
    """The wrapper of n and k pages. Literal content that half of all pages state stands by itself."""
    return align(a, b, max(3, (n + k) / 2)) if n else b


def slots(wrapper: list) -> Iterator[tuple[tuple[str, ...], list | None]]:
    """The paths of all elements (with None) and of all slots (with their items)."""
    todo = [((), x) for x in reversed(wrapper)]
    while todo:
        path, x = todo.pop()
        if x[0] is None:
            yield path, x
            continue
        if x[0] != GROUP:
            path = (*path, x[0])
            yield path, None
        todo += [(path, y) for y in reversed(x[3])]


def speaks_against(path: tuple[str, ...]) -> bool:
    """Whether the last element's name or words speak for something beside the article."""
    name, *words = path[-1].split(".")
    return name in APART or bool(words) or (name == "header" and not any(s.split(".")[0] in MAIN for s in path[:-1]))


class Rules:
    """What a host's wrapper decides about the places of its pages."""

    def __init__(self, freed: set[tuple[str, ...]], fixed: dict[tuple[str, ...], set[int]]):
        self.freed, self.fixed = freed, fixed
        self.known: dict[tuple[str, ...], int] = {}

    def outermost(self, path: tuple[str, ...]) -> tuple[str, ...] | None:
        """The first element on the path that is voted out."""
        for n in range(1, len(path) + 1):
            if path[:n] not in self.freed and speaks_against(path[:n]):
                return path[:n]
        return None

    def place(self, path: tuple[str, ...]) -> int:
        """0: voted out; 1: beside an article; 2: in one."""
        found = self.known.get(path)
        if found is None:
            found = 0 if self.outermost(path) else 2 if any(s.split(".")[0] in MAIN for s in path) else 1
            self.known[path] = found
        return found

    def dumps(self) -> str:
        return json.dumps({"freed": sorted(map(list, self.freed)), "fixed": [[list(p), sorted(h)] for p, h in sorted(self.fixed.items())]}, separators=(",", ":"))

    @staticmethod
    def loads(said: str) -> Rules:
        own = json.loads(said)
        return Rules({tuple(p) for p in own["freed"]}, {tuple(p): set(h) for p, h in own["fixed"]})


def rules_of(wrapper: list, pages: int) -> Rules:
    """The rules of a wrapper that was learnt from so many distinct pages."""
    paths: set[tuple[str, ...]] = set()
    mass: dict[tuple[str, ...], int] = {}
    fixed: dict[tuple[str, ...], set[int]] = {}
    for path, x in slots(wrapper):
        if x is None:
            paths.add(path)
            continue
        if x[7] * 2 <= x[6]:
            mass[path] = mass.get(path, 0) + x[6]
        # three of four texts in this slot are the same, and half of the pages have it
        if pages >= ENOUGH and x[2] and x[4] * 2 >= x[5] and x[5] * 2 >= pages:
            fixed.setdefault(path, set()).add(x[3])
    rules = Rules(set(), fixed)
    articles = [p for p in paths if p[-1].split(".")[0] in MAIN]
    # articles that stand only inside elements voted out free the outermost of these
    while articles and all(rules.outermost(p) for p in articles):
        out = {q for p in articles if (q := rules.outermost(p)) and q[-1].split(".")[0] not in NEVER}
        if not out:
            break
        rules.freed |= out
    if not articles:
        # without articles, one class word is outvoted by a title and most of the text
        whole = sum(mass.values())
        for p in sorted((p for p in paths if rules.outermost(p) == p and p[-1].split(".")[0] not in NEVER), key=len):
            held = sum(n for q, n in mass.items() if q[: len(p)] == p)
            if held * 2 > whole and any(q[: len(p)] == p and q[-1].split(".")[0] == "h1" and rules.outermost(q) == p for q in paths):
                rules.freed.add(p)
    rules.known.clear()
    return rules


def main_text(source: str | None, rules: Rules | None) -> str:
    """The article's blocks, joined by empty lines; without rules those of the page's own wrapper."""
    tree, blocks = parse(source or "")
    if rules is None:
        rules = rules_of(tree, 1)
    found = [(b, p) for b in blocks if (p := rules.place(b.path))]
    own = [b for b, p in found if p == 2]
    if not own:
        own = [b for b, _ in found if b.linked * 2 <= len(b.text)]
    if rules.fixed:
        rest = [
            b for b in own
            if b.path not in rules.fixed or (b.path[-1] == "h1" and rules.place(b.path) == 2) or (xxhash.xxh64_intdigest(b.text) & MASK | 1) not in rules.fixed[b.path]
        ]
        if 2 * sum(len(b.text) for b in rest) >= sum(len(b.text) for b in own):
            own = rest
    return "\n\n".join(b.text for b in own)


def learnt(sources: Iterator[str | None]) -> tuple[list, int]:
    """The wrapper of these distinct pages, and their number."""
    wrapper, n = [], 0
    for source in sources:
        tree = parse(source or "")[0]
        wrapper, n = joined_wrappers(wrapper, n, tree, 1), n + 1
    return wrapper, n


def wrappers(hosted: DataFrame) -> DataFrame:
    """host, rules: what each host's wrapper decides, from pages (host, html)."""
    spark = hosted.sparkSession
    small_batches(spark)
    kinds = (pa.string(), pa.string(), pa.int64())

    def rows(done: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*done, strict=True)) if done else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["host", "wrapper", "n"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pages come sorted by host, share and hash; one wrapper is held at a time."""
        key, wrapper, n, last = None, [], 0, None
        for b in batches:
            for host, share, h, source in zip(*(b.column(c).to_pylist() for c in ("host", "share", "hash", "html")), strict=True):
                if (host, share) != key:
                    if key is not None:
                        yield rows([(key[0], json.dumps(wrapper, separators=(",", ":")), n)])
                    key, wrapper, n, last = (host, share), [], 0, None
                if h == last:
                    continue
                tree = parse(source or "")[0]
                wrapper, n, last = joined_wrappers(wrapper, n, tree, 1), n + 1, h
        if key is not None:
            yield rows([(key[0], json.dumps(wrapper, separators=(",", ":")), n)])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shares' wrappers come sorted by host."""
        key, wrapper, n = None, [], 0
        for b in batches:
            for host, own, k in zip(*(b.column(c).to_pylist() for c in ("host", "wrapper", "n")), strict=True):
                if host != key:
                    if key is not None:
                        yield rows([(key, rules_of(wrapper, n).dumps(), n)])
                    key, wrapper, n = host, [], 0
                own = json.loads(own)
                wrapper, n = joined_wrappers(wrapper, n, own, k), n + k
        if key is not None:
            yield rows([(key, rules_of(wrapper, n).dumps(), n)])

    many = materialise(hosted.groupBy("host").agg(F.count("*").alias("rows")).filter(F.col("rows") > SHARE), "hot-hosts")
    own = hosted.withColumn("hash", F.xxhash64("html")).join(broadcast_if_small(many), "host", "left")
    shares = F.pmod("hash", F.ceil(F.col("rows") / SHARE).cast("long"))
    own = own.select("host", F.coalesce(shares, F.lit(0)).alias("share"), "hash", "html")
    shape = "host string, wrapper string, n long"
    parts = own.repartition("host", "share").sortWithinPartitions("host", "share", "hash").mapInArrow(learn, shape)
    whole = materialise(parts, "wrapper-shares").repartition("host").sortWithinPartitions("host", "n", "wrapper").mapInArrow(decide, shape)
    return whole.select("host", F.col("wrapper").alias("rules"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row for each page."""
    small_batches(pages.sparkSession)
    hosted = pages.select("page_id", "url", "html").withColumn("host", F.coalesce(F.lower(F.regexp_extract("url", HOST, 1)), F.lit("")))
    made = materialise(wrappers(hosted.select("host", "html")), "rules")
    joined = hosted.join(broadcast_if_small(made), "host", "left").select("page_id", "url", "host", "rules", "html")
    schema = pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Rules] = {}
        for b in batches:
            texts = []
            for host, said, source in zip(*(b.column(c).to_pylist() for c in ("host", "rules", "html")), strict=True):
                if host not in known:
                    if len(known) >= 2000:
                        known.clear()
                    known[host] = Rules.loads(said)
                texts.append(main_text(source, known[host]))
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return joined.mapInArrow(read, schema)


def op2_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
