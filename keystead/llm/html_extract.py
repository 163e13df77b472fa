"""Operator 6, main text of web pages by wrappers inferred from pages of one host.

A page is read as a stream of structural tags and texts. Pages of a host are
aligned one after the other with the host's wrapper, a union-free expression. At
every level the two token sequences are aligned in page order by their longest
common subsequence of tags with their classes. Matched tags are joined; tags that only
some pages have become optional groups; where a tag occurs in other numbers beside itself,
it becomes a repeated group; texts that stay the same are constants, texts that
differ become slots. Levels of more than 64 tokens, as those of generated class names,
become one repeated group of optional tags without their classes.

The wrapper then tells which groups are the article. Article and main elements
are; of several, those with slots. On other hosts the article is the smallest
element with most of the slot text that is not links, without the parts that
are the same on every page. Only where that holds no slot text (copies of one page, or
fewer than three pages) all text counts. Groups marked as menus, adverts, forms, comments
and the like are left out of it. A word in a class or id alone marks no element that is or
holds an article or main element or, on hosts without those, most of the free
text; comments count so only where no other article is. Each page is aligned with its host's wrapper
again, and the texts at the article's places are its blocks.

Wrappers are folded in the tasks that read the pages, so a hot host sends one
wrapper a task; a level holds at most 64 tokens or one a kind of tag, whatever the number of
pages. What extraction needs is smaller still: the levels on the way to where the
article begins and ends, mostly alike among hosts. The planner broadcasts them or not by their size.

Defined cases: null and empty pages and pages without an article have the empty
text; a null url is a host of its own; elements nested over 100 deep
belong to the hundredth; very long pages are read whole, in one pass, also where tags or
quotes are never closed: from a tag on that its quotes leave open to the end of the page, tags
end at their first ``>``, and a tag without one is text; of ties the first element in page order
counts; repeated rows give repeated results; extra columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import itertools
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystead.llm.common import batched, materialise
from keystead.llm.url_filter import host_of

TAG = re.compile(r"<(/?)([a-z][a-z0-9:-]*)", re.I)
#: What ends a tag or begins a quote in it.
STOP = re.compile(r"[>\"']")
#: Elements whose content is not page text, with what ends them.
RAW = {
    tag: re.compile(rf"</{tag}\s*>", re.I)
    for tag in ("script", "style", "noscript", "template", "iframe", "svg", "textarea", "select")
}
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: Elements that stand alone, elements inside a line, and elements that end an open one of their group.
VOID = frozenset("area base col embed img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong"
    " sub sup time tt u var br ruby rb rt rp nobr".split()
)
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 dt dd li td th tr option".split())
HOLDERS = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table"}
HOLDERS = {tag: frozenset(holders.split()) for tag, holders in HOLDERS.items()}
#: Elements, roles and parts of class names that are not the article.
OTHER_TAGS = frozenset("head nav footer aside form button dialog menu fieldset object audio video canvas title".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
OTHER_NAMES = frozenset(
    "nav navbar navigation menu footer sidebar aside ad ads advert adverts advertisement advertising banner promo"
    " sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay share sharing social related"
    " recommended recommendations comment comments commentlist disqus discussion replies respond breadcrumb breadcrumbs"
    " widget newsletter subscribe subscription login signup search pagination pager toolbar copyright disclaimer"
    " masthead topbar skip".split()
)
#: Those of them that mark answers and further articles, and what their names are made of besides.
REPLY_NAMES = frozenset(
    "related recommended recommendations comment comments commentlist disqus discussion replies respond".split()
)
REPLY_PARTS = REPLY_NAMES | frozenset("list area section wrapper container body thread item post posts article articles".split())
ARTICLE_NAMES = frozenset("article articlebody post entry story content main".split())
DEEPEST = 100
#: Longer runs of one tag are a repeated group at once; longer levels lose their order; fewer pages show no constants.
LONG_RUN, WIDEST, LEAST_PAGES = 8, 64, 3


class Node:
    """An element with its children in page order; texts are children too, with their characters in links."""

    __slots__ = ("kids", "kind", "label", "tag")

    def __init__(self, tag: str, label: str, kind: str):
        self.tag, self.label, self.kind = tag, label, kind
        self.kids: list[Node | tuple[str, int]] = []


def describe(tag: str, attributes: str) -> tuple[str, str]:
    """The element's label in a wrapper, and whether it is ``other`` matter, ``article`` or neither.

    Class words of other matter go before the kind, as ``words`` or ``replies``: the wrapper tells what they weigh.
    """
    found = {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
    names = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
    parts = {part for name in names for part in re.split(r"[^a-z]+", name)} - {""}
    role = found.get("role", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    label = ".".join([tag, *sorted(re.sub(r"[0-9]+", "", name) for name in names)])
    worded = parts & OTHER_NAMES and tag not in ("html", "body")
    if hidden or tag in OTHER_TAGS or role in OTHER_ROLES or (worded and tag == "header"):
        return label, "other"
    if tag == "header":
        return label, "header"
    if tag in ("article", "main") or role in ("main", "article"):
        kind = "article"
    else:
        kind = "named" if parts & ARTICLE_NAMES and tag in ("div", "section", "td") else ""
    if worded:
        split = [{*re.split(r"[^a-z]+", name)} - {""} for name in names]
        replies = any(own & REPLY_NAMES and own <= REPLY_PARTS for own in split)
        kind = f"{'replies' if replies else 'words'} {kind}"
    return label, kind


def markup(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Start, end, tag, whether it ends an element, and attributes of all markup; comments and raw elements have no tag."""
    at, quotes, absent = 0, True, set()

    def find(sign: str, start: int) -> int:
        """The sign's next place; one that was not found once is never looked for again."""
        found = -1 if sign in absent else page.find(sign, start)
        if found < 0:
            absent.add(sign)
        return found

    while (start := find("<", at)) >= 0:
        at = start + 1
        if page.startswith("<!--", start):
            end = find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            yield start, at, "", False, ""
            continue
        if page.startswith(("<!", "<?"), start):
            if (end := find(">", at)) >= 0:
                at = end + 1
                yield start, at, "", False, ""
            continue
        m = TAG.match(page, start)
        if not m:
            continue
        tag, end = m[2].lower(), m.end()
        while quotes:
            stop = STOP.search(page, end)
            if not stop:
                quotes = False
            elif stop[0] == ">":
                end = stop.start()
                break
            else:
                # a quote that nothing closes is a sign like others
                closed = find(stop[0], stop.end())
                end = closed + 1 if closed >= 0 else stop.end()
        else:
            if (end := find(">", m.end())) < 0:
                continue
        at = end + 1
        if tag in RAW and not m[1]:
            closes = RAW[tag].search(page, at)
            at = closes.end() if closes else len(page)
            yield start, at, "", False, ""
        else:
            yield start, at, tag, bool(m[1]), page[m.end() : end]


def parse(page: str) -> Node:
    """The page's elements, leniently: open paragraphs end at the next block, stray ends are ignored."""
    root = Node("", "", "")
    stack, pieces, links, linked, beyond = [root], [], 0, 0, 0

    def close_block() -> None:
        nonlocal pieces, linked
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            stack[-1].kids.append((text, min(linked, len(text))))
        pieces, linked = [], 0

    last = 0
    for start, end, tag, ends, attributes in markup(page):
        if start > last:
            pieces.append(page[last:start])
            if links:
                linked += start - last
        last = end
        if not tag:
            continue
        if tag in INLINE:
            if tag == "br":
                pieces.append(" ")
            elif tag == "a":
                links = 0 if ends else 1
            continue
        if tag in VOID:
            continue
        close_block()
        if tag == "hr":
            continue
        if ends:
            if beyond and tag not in PARAGRAPHS:
                beyond -= 1
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
            continue
        # a paragraph or heading ends at any block, an item at the next of its list
        while stack[-1].tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
            stack.pop()
        if tag in HOLDERS:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in HOLDERS[tag]:
                    break
                if stack[depth].tag == tag or (tag in ("dt", "dd") and stack[depth].tag in ("dt", "dd")):
                    del stack[depth:]
                    break
        if len(stack) > DEEPEST:
            beyond += tag not in PARAGRAPHS
            continue
        node = Node(tag, *describe(tag, attributes))
        stack[-1].kids.append(node)
        stack.append(node)
    if last < len(page):
        pieces.append(page[last:])
    close_block()
    return root


def sign(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def wrapper_of(node: Node | tuple[str, int]) -> dict:
    """A page as a wrapper of one page: tokens with label, kind, pages, whether repeated or optional, and tokens inside.

    Texts have their characters, those in links and a sign, which slots lose.
    """
    if isinstance(node, tuple):
        text, links = node
        return {"label": "#", "kind": "#", "n": 1, "rep": 0, "opt": 0, "chars": len(text), "links": links, "sign": sign(text)}
    out = {"label": f"{node.label}|{node.kind}", "kind": node.kind, "n": 1, "rep": 0, "opt": 0, "loose": 0}
    tokens = []
    for run in runs([wrapper_of(kid) for kid in node.kids]):
        tokens += [repeated(run)] if len(run) > LONG_RUN else run
    return out | {"kids": tokens} if len(tokens) <= WIDEST else out | {"kids": loosened(tokens), "loose": 1}


def runs(tokens: list[dict]) -> list[list[dict]]:
    """Tokens of one label beside each other."""
    out: list[list[dict]] = []
    for token in tokens:
        if out and out[-1][0]["label"] == token["label"]:
            out[-1].append(token)
        else:
            out.append([token])
    return out


def repeated(run: list[dict]) -> dict:
    """A run as one repeated group."""
    one = run[0]
    for token in run[1:]:
        one = align(one, token, same_page=True)
    return one | {"rep": 1}


def loose_label(label: str) -> str:
    """The label without classes."""
    names, _, kind = label.rpartition("|")
    return f"{names.partition('.')[0]}|{kind}" if names else label


def loosened(tokens: list[dict]) -> list[dict]:
    """A level as a repeated group of optional tokens, one for a tag and kind."""
    out: dict[str, dict] = {}
    for token in tokens:
        label = loose_label(token["label"])
        token = token | {"label": label, "rep": 1, "opt": 1}
        out[label] = align(out[label], token, same_page=True) if label in out else token
    return [out[label] for label in sorted(out)]


def align(a: dict, b: dict, same_page: bool = False) -> dict:
    """The wrapper that fits what either fits. same_page: both are parts of the same pages, so pages do not add up."""
    out = {"label": a["label"], "kind": a["kind"], "rep": a["rep"] | b["rep"], "opt": a["opt"] | b["opt"]}
    out["n"] = max(a["n"], b["n"]) if same_page else a["n"] + b["n"]
    if a["kind"] == "#":
        both = a["sign"] is not None and b["sign"] is not None
        if same_page:
            # repeated texts are constant if every page has the same ones
            kept = sign(f"{a['sign']} {b['sign']}") if both else None
        else:
            kept = a["sign"] if both and a["sign"] == b["sign"] else None
        return out | {"chars": a["chars"] + b["chars"], "links": a["links"] + b["links"], "sign": kept}
    if not a["loose"] and not b["loose"]:
        tokens = aligned(a["kids"], b["kids"], same_page)
        if len(tokens) <= WIDEST:
            return out | {"kids": tokens, "loose": 0}
        return out | {"kids": loosened(tokens), "loose": 1}
    own, other = ({t["label"]: t for t in (x["kids"] if x["loose"] else loosened(x["kids"]))} for x in (a, b))
    for label, token in other.items():
        own[label] = align(own[label], token, same_page) if label in own else token
    return out | {"kids": [own[label] for label in sorted(own)], "loose": 1}


def aligned(x: list[dict], y: list[dict], same_page: bool) -> list[dict]:
    """Two token sequences as one, in order: mismatches become optional or repeated groups."""
    xs, ys = runs(x), runs(y)
    out = []
    for i, j in common([run[0]["label"] for run in xs], [run[0]["label"] for run in ys]):
        if i is None or j is None:
            out += [token | {"opt": 1} for token in (ys[j] if i is None else xs[i])]
        elif len(xs[i]) == len(ys[j]):
            out += [align(a, b, same_page) for a, b in zip(xs[i], ys[j], strict=True)]
        else:
            out.append(align(repeated(xs[i]), repeated(ys[j]), same_page))
    return out


def common(x: list[str], y: list[str]) -> list[tuple[int | None, int | None]]:
    """Places of both sequences, paired along a longest common subsequence; equal starts and ends are paired first."""
    start, least = 0, min(len(x), len(y))
    while start < least and x[start] == y[start]:
        start += 1
    end = 0
    while end < least - start and x[-1 - end] == y[-1 - end]:
        end += 1
    a, b = x[start : len(x) - end], y[start : len(y) - end]
    longest = [[0] * (len(b) + 1) for _ in range(len(a) + 1)] if a and b else []
    for i in range(len(a) - 1, -1, -1) if longest else ():
        row, below = longest[i], longest[i + 1]
        for j in range(len(b) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if a[i] == b[j] else max(below[j], row[j + 1])
    out: list[tuple[int | None, int | None]] = [(k, k) for k in range(start)]
    i = j = 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            out.append((start + i, start + j))
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and longest[i + 1][j] >= longest[i][j + 1]):
            out.append((start + i, None))
            i += 1
        else:
            out.append((None, start + j))
            j += 1
    return out + [(len(x) - k, len(y) - k) for k in range(end, 0, -1)]


def weighed(node: dict, slots: bool) -> dict:
    """The wrapper with ``slot``, the characters in slots, and ``free``, those not in links. slots: constants weigh nothing."""
    if node["kind"] == "#":
        constant = slots and node["sign"] is not None and node["n"] >= LEAST_PAGES
        chars = 0 if constant else node["chars"]
        return node | {"slot": chars, "free": max(0, chars - 2 * node["links"])}
    tokens = [weighed(token, slots) for token in node["kids"]]
    return node | {"kids": tokens, "slot": sum(token["slot"] for token in tokens)}


def worded(kind: str) -> bool:
    return kind.startswith(("words", "replies"))


def holds_article(node: dict, skip: tuple, least: int = 0) -> bool:
    """Whether the group is or holds an article or main element, of ``least`` characters in slots, outside the kinds to skip."""
    if node["kind"] in ("#", "other") or node["kind"].startswith(skip):
        return False
    own = node["kind"].endswith("article") and node["slot"] >= least
    return own or any(holds_article(token, skip, least) for token in node["kids"])


def settled(node: dict, skip: tuple, least: float) -> dict:
    """The wrapper with worded groups as other matter, or ``lifted`` to what they are without the words.

    Lifted are groups that are or hold an article, and those of more than ``least`` free characters.
    """
    if node["kind"] == "#":
        return node
    tokens = []
    for token in node["kids"]:
        kind, lifted = token["kind"], False
        if worded(kind):
            lifted = not kind.startswith(skip) and (holds_article(token, skip) or free_chars(token, skip) > least)
            kind = kind.partition(" ")[2] if lifted else "other"
        tokens.append(settled(token | {"kind": kind}, skip, least) | {"lifted": lifted})
    return node | {"kids": tokens}


def free_chars(node: dict, skip: tuple = ("words", "replies")) -> int:
    """Characters outside links and outside other matter."""
    if node["kind"] == "#":
        return node["free"]
    if node["kind"] in ("other", "header") or node["kind"].startswith(skip):
        return 0
    return sum(free_chars(token, skip) for token in node["kids"])


def mark(node: dict, kinds: tuple, inside: bool = False, least: int = 0, varied: bool = False) -> dict | None:
    """Where the article begins and ends; None if all inside is like the element itself.

    ``at``: label, 1 in the article, 2 in it whatever its class, 0 outside, and marks of every token of the level.
    least: characters in slots that make a group of the kinds an article. varied: without what every page has alike.
    """
    at, differs = [], False
    for token in node["kids"]:
        own = inside or (token["kind"] in kinds and token["slot"] >= least)
        alike = varied and token["n"] == node["n"] >= LEAST_PAGES and not token["opt"] and not token["slot"]
        if token["kind"] == "other" or (token["kind"] == "header" and not inside) or (alike and inside):
            own, below = False, None
        else:
            below = None if token["kind"] == "#" else mark(token, kinds, own, least, varied)
        lifted = own and token.get("lifted", False)
        at.append([token["label"], 2 if lifted else int(own), below])
        differs = differs or own != inside or lifted or below is not None
    return {"loose": node["loose"], "at": at} if differs else None


def begins(marks: dict | None) -> bool:
    return marks is not None and any(own or begins(below) for _, own, below in marks["at"])


def only(node: dict, chosen: int, own: int, below: dict | None) -> dict:
    """Marks of a level of which only one token counts."""
    at = [[token["label"], own, below] if k == chosen else [token["label"], 0, None] for k, token in enumerate(node["kids"])]
    return {"loose": node["loose"], "at": at}


def heaviest(node: dict) -> dict | None:
    """Marks of the smallest element with most of the free text."""
    total = free_chars(node)
    for place, token in enumerate(node["kids"]):
        if token["kind"] != "#" and token["kids"] and free_chars(token) > 0.7 * total > 0:
            texts = [t for t in token["kids"] if t["kind"] == "#"]
            if sum(t["free"] for t in texts) < 0.7 * total or len(texts) > 1:
                deeper = heaviest(token)
                if deeper:
                    return only(node, place, 0, deeper)
            if loose_label(token["label"]).startswith("p|"):
                return None
            return only(node, place, 1, mark(token, (), True, varied=True))
    return None


def marked_chars(node: dict, marks: dict | None, inside: bool = False) -> int:
    """Free characters at the article's places."""
    if node["kind"] == "#":
        return node["free"] if inside else 0
    if marks is None:
        return free_chars(node) if inside else 0
    pairs = zip(node["kids"], marks["at"], strict=True)
    return sum(marked_chars(token, below, bool(own)) for token, (_, own, below) in pairs)


def article_marks(wrapper: dict, by_text: bool = True) -> dict | None:
    """The places of the article in a host's wrapper. by_text: worded groups with most of the free text are none."""
    wrapper, whole = weighed(wrapper, True), wrapper
    # "-" is no kind: with it nothing is skipped
    if not free_chars(wrapper, ("-",)):
        wrapper = weighed(whole, False)
    for skip in (("replies",), ("-",)):
        if holds_article(wrapper, skip):
            least = int(holds_article(wrapper, skip, 1))
            marks = mark(settled(wrapper, skip, math.inf), ("article",), least=least)
            if begins(marks):
                return marks
    for skip in (("replies",), ("-",)) if by_text else (("words", "replies"),):
        own = settled(wrapper, skip, free_chars(wrapper, skip) / 2 if by_text else math.inf)
        named = mark(own, ("named",))
        # names decide only where most of the text outside worded groups is so named
        if not begins(named) or marked_chars(own, named) <= free_chars(wrapper) / 2:
            marks = heaviest(own)
            named = marks if begins(marks) else named
        if begins(named):
            return named
    return None


def assigned(kids: list, marks: dict) -> list[list | None]:
    """The token of the wrapper's level that each child meets, if any."""
    labels = ["#" if isinstance(kid, tuple) else f"{kid.label}|{kid.kind}" for kid in kids]
    if marks["loose"]:
        labels = [loose_label(label) for label in labels]
    own = groups(labels)
    other = groups([token[0] for token in marks["at"]])
    names = [labels[run[0]] for run in own]
    known = {marks["at"][run[0]][0]: run for run in other}
    if len(known) == len(other):
        met = [known.get(name) for name in names]
    else:
        met = [None] * len(own)
        for i, j in common(names, [marks["at"][run[0]][0] for run in other]):
            if i is not None:
                met[i] = other[j] if j is not None else known.get(names[i])
    out: list[list | None] = []
    for run, tokens in zip(own, met, strict=True):
        out += [marks["at"][tokens[min(k, len(tokens) - 1)]] if tokens else None for k in range(len(run))]
    return out


def groups(labels: list[str]) -> list[list[int]]:
    """Places of equal labels beside each other."""
    return [list(run) for _, run in itertools.groupby(range(len(labels)), labels.__getitem__)]


def blocks(node: Node, marks: dict | None, inside: bool = False) -> Iterator[str]:
    """The texts at the article's places, in page order."""
    for kid, met in zip(node.kids, assigned(node.kids, marks) if marks else [None] * len(node.kids), strict=True):
        own, below = (bool(met[1]), met[2]) if met else (inside, None)
        if isinstance(kid, tuple):
            if own:
                yield kid[0]
            continue
        if own and not met and (kid.kind == "other" or (kid.kind == "header" and not inside) or worded(kid.kind)):
            own = False
        if own or below:
            yield from blocks(kid, below, own)


def extract(page: str, marks: dict | None) -> str:
    """The article by the host's marks; a page that has nothing there is a wrapper of its own."""
    root = parse(page)
    found = list(blocks(root, marks)) or list(blocks(root, article_marks(wrapper_of(root), by_text=False)))
    return "\n\n".join(found)


def tokens_in(node: dict) -> int:
    return 1 + sum(tokens_in(token) for token in node.get("kids", ()))


def host_marks(pages: DataFrame, kept: int = 200_000) -> DataFrame:
    """host, marks: the places of the article for every host. kept: tokens of wrappers a task holds before it passes them on."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict] = {}
        size = 0
        for batch in batches:
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                new = wrapper_of(parse(page or ""))
                held[host] = align(held[host], new) if host in held else new
                # an upper bound, as tokens that meet are counted twice; counted anew where it is reached
                size += tokens_in(new)
                if size > kept and (size := sum(map(tokens_in, held.values()))) > kept // 2:
                    yield passed(held, json.dumps)
                    held, size = {}, 0
        yield passed(held, json.dumps)

    def passed(held: dict, write) -> pa.RecordBatch:
        return batched(["host", "wrapper"], [pa.string()] * 2, [list(held), [write(w) for w in held.values()]])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, wrapper = None, None
        for batch in batches:
            for host, text in zip(batch.column("host").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
                if last is not None and host != last:
                    yield passed({last: article_marks(wrapper)}, json.dumps)
                wrapper = align(wrapper, json.loads(text)) if host == last else json.loads(text)
                last = host
        if last is not None:
            yield passed({last: article_marks(wrapper)}, json.dumps)

    folded = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(fold, "host string, wrapper string")
    ordered = folded.repartition("host").sortWithinPartitions("host", "wrapper")
    return ordered.mapInArrow(join, "host string, wrapper string").withColumnRenamed("wrapper", "marks")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    known = materialise(host_marks(pages), "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "text", "n_chars"]
        read: dict[str, dict] = {}
        for batch in batches:
            ids, urls = batch.column("page_id").to_pylist(), batch.column("url").to_pylist()
            whole, marks = batch.column("html").to_pylist(), batch.column("marks").to_pylist()
            for at in range(0, len(ids), 256):
                texts = []
                for page, mark_ in zip(whole[at : at + 256], marks[at : at + 256], strict=True):
                    if len(read) > 5000:
                        read.clear()
                    if mark_ not in read:
                        read[mark_] = json.loads(mark_ or "null")
                    texts.append(extract(page or "", read[mark_]))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield batched(names, kinds, [ids[at : at + 256], urls[at : at + 256], texts, [len(t) for t in texts]])

    hosted = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    joined = hosted.join(known, "host", "left").select("page_id", "url", "html", "marks")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
