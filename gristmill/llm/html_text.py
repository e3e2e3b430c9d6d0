"""HTML extraction by wrappers: union-free regular expressions inferred per host.

A page becomes a tree of tokens (tags and text). Its regular expression folds runs of one to four tags that repeat into
a repeated group; two expressions are aligned child by child, what only one has becomes optional or part of a repetition,
unequal texts become slots. This is done page by page within a task and then over the tasks' partial wrappers, a bounded
number at a time, so that no task holds a host's pages. What is the same on a host's pages is its template, and what fills
the slots its content: the wrapper tells by the slots' letters which region has the main text, and which texts in it are
the template's. Pages are then cut by it.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from hashlib import blake2b

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import by_batch, map_batches, written
from gristmill.llm.url_filter import host_and_path

#: A tag's beginning, and one without quotes, or with closed ones that hold no ``<``, as nearly all are.
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^<\"]*\"|'[^<']*')*+)>")
STOP = re.compile("[>\"']")
NAMES = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
TOKENS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=>/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
RAW = frozenset("script style noscript template iframe object svg math textarea title xmp noembed noframes".split())
#: Regions that aren't the article, wherever they stand.
OUTSIDE = frozenset("nav aside footer form button select option dialog menu head".split()) | RAW
#: Words that say the same, as a whole token of class or role, or the id of a div: alone, after what they
#: belong to, or before what holds them. So ``ad-slot`` is one, ``no-sidebar`` and ``search-result`` are none.
OUTSIDE_WORDS = (
    r"nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-?bar|aside|footer|ads?|adverts?|advertisements?|advertorial|sponsor(?:ed)?|promo(?:tion)?s?|banner|"
    r"cookies?|consent|gdpr|notices?|alerts?|popup|pop-up|modal|newsletter|subscribe|subscription|signup|sign-up|login|share|sharing|social|related|recommended|recommendations|"
    r"comments?|commentlist|disqus|respond|replies|reply|widgets?|pagination|pager|toolbar|toc|search|skip|masthead|site-header|page-header|topbar|copyright|complementary|contentinfo|dialog|alertdialog"
)
OUTSIDE_NAME = re.compile(
    rf"(?:(?:site|page|post|article|entry|main|top|bottom|left|right|social|global|primary|secondary|header|mobile|sticky|cookie|user|reader|blog|home)[_-])?(?:{OUTSIDE_WORDS})"
    r"(?:[_-](?:box|bar|area|list|links?|posts?|articles?|buttons?|icons?|container|wrapper|wrap|block|unit|slot|inner|section|\d+))*",
    re.I,
)
#: Of these, what an article's own sections are named as well: there they say it only of what holds no paragraph.
WEAK_NAME = re.compile(r"(?:\w+[_-])?(?:alerts?|notices?|share|sharing|social|search|skip|toc|related|recommended|recommendations|widgets?|toolbar|promo(?:tion)?s?|banner|dialog|copyright)(?:[_-]\w+)*", re.I)
#: Words of a paragraph; letters that say so where names would leave out most of a page; code points of a byline, items of a thread.
PARAGRAPH, SAYS, BYLINE, POSTS = 25, 150, 60, 3
MAIN = ("article", "main")
MAIN_NAMES = re.compile(r"(?:^|[\s_-])(?:article(?:-?body)?|articlebody|post(?:-?(?:body|content))?|entry(?:-content)?|content|story|main|main-content|body-content|text)(?=$|[\s_-])", re.I)
#: Elements that hold text, not regions.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote tr dt dd".split())
#: Elements of a repeated run at most; partial wrappers that are aligned at a time; children of a wrapper's element from
#: which optional ones of a tag are one; pages from which a text that all have alike is the template's.
LONGEST, MERGED, MOST_KIDS, FIXED_PAGES = 4, 256, 64, 3
GAP = "\x1f"
#: An open element that these end: fixed by the HTML standard's rules on omitted end tags.
ENDS = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "option": frozenset(["option", "optgroup"]), "head": frozenset(["body"]),
}
#: No end tag or implied end reaches beyond these.
SCOPE = frozenset("article aside body div footer form header html main nav section table td th ul ol dl blockquote".split())
#: The tree keeps elements nested deeper than this as marks only: their text is their ancestor's, in order. Those outside
#: the article and article elements keep their own, DEEPER levels more; end tags are matched at any depth.
DEEPEST, DEEPER = 150, 20
#: Elements whose names don't tell.
NEVER = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 legend caption".split())
HIDDEN_MARK, OUTSIDE_MARK = "\0", "\3"
NUMBERS = re.compile(r"\d+")


class Node:
    """An element: its tag, what its class, id and role say, and its children, which are elements or texts."""

    __slots__ = ("tag", "names", "children", "tokens")

    def __init__(self, tag: str, names: str = "", tokens: tuple[str, ...] = ()):
        self.tag, self.names, self.children, self.tokens = tag, names, [], tokens

    @property
    def key(self) -> str:
        return f"{self.tag}.{self.names}" if self.names else self.tag

    @property
    def outside(self) -> str:
        """"tag" or "name", by what the element says that it isn't of the article, or empty. Headings' names don't tell."""
        if self.tag in OUTSIDE or HIDDEN_MARK in self.names:
            return "tag"
        return "name" if self.tokens and self.tag not in NEVER and any(map(OUTSIDE_NAME.fullmatch, self.tokens)) else ""


def tokens_of(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, tag, rest) of each tag in order, the tag empty for comments and declarations; the caller may
    send the place from which to go on. A quote that
    is never closed ends with the tag, at the next ``>``; where one scan of quotes has come to nothing, none begins again, so
    that a page costs its length."""
    last, failed, pos = page.rfind(">"), set(), 0

    def closing(at: int) -> int:
        first, seen = at, []
        while at <= last:
            stop = STOP.search(page, at).start()
            if page[stop] == ">":
                return stop
            if stop in failed:
                break
            seen.append(stop)
            at = page.find(page[stop], stop + 1) + 1
            if not at:
                break
        failed.update(seen)
        return page.find(">", first) if first <= last else -1

    while (at := page.find("<", pos)) >= 0:
        slash = tag = rest = ""
        if m := PLAIN_TAG.match(page, at):
            pos = (yield at, m.end(), m[1], m[2].lower(), m[3]) or m.end()
            continue
        if page.startswith("<!--", at) or page.startswith("<![CDATA[", at):
            mark = "-->" if page[at + 2] == "-" else "]]>"
            end = page.find(mark, at + (4 if mark == "-->" else 9))
            end = end + 3 if end >= 0 else len(page)
        elif page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at) + 1 if at <= last else 0
        elif m := TAG.match(page, at):
            end = closing(m.end()) + 1
            slash, tag, rest = m[1], m[2].lower(), page[m.end() : end - 1] if end else ""
        else:
            end = 0
        if not end:  # no tag: text
            pos = at + 1
            continue
        pos = (yield at, end, slash, tag, rest) or end


def parse(page: str) -> Node:
    """The token stream as a tree. Inline tags leave only their text; ends that are missing are implied, stray ones dropped."""
    root = Node("#root")
    stack, levels, stops, opened, at = [root], [0], [0], Counter(), 0
    held: list[str] = []
    doubtful: list[Node] = []

    def flush() -> None:
        if held:
            kids, part = stack[-1].children, "".join(held)
            held.clear()
            if kids and isinstance(kids[-1], str):
                kids[-1] += part
            else:
                kids.append(part)

    def close(k: int) -> None:
        flush()
        opened.subtract(n.tag for n in stack[k:])
        if stack[k].children is stack[k - 1].children:
            stack[k].children.append(Node("hr"))
        del stack[k:], levels[k:], stops[k:]

    found = tokens_of(page)
    token = next(found, None)
    while token:
        start, end, slash, tag, rest = token
        if start > at:
            held.append(page[at:start])
        at, go = end, None
        if not tag:
            pass
        elif tag in RAW:
            if not slash and not rest.endswith("/"):
                over = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = go = over.end() if over else len(page)
                flush()
                stack[-1].children.append(Node(tag))
        elif tag == "br":
            held.append(" ")
        elif tag in INLINE or tag in VOID and tag != "hr":
            if tag == "a":
                held.append("\2" if slash else "\1")  # marks of link text, taken out again
        elif slash:
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in SCOPE and tag not in SCOPE:
                    break
        else:
            k = stops[-1]
            while k > 0:
                if tag in ENDS.get(stack[k].tag, ()):
                    close(k)
                    break
                if stack[k].tag in SCOPE:
                    break
                k = stops[k - 1]
            flush()
            names = NUMBERS.sub("0", " ".join(a or b or c for a, b, c in NAMES.findall(rest)).strip()) if rest else ""
            tokens = [t for name, a, b, c in TOKENS.findall(rest) if name.lower() != "id" or tag == "div" for t in (a or b or c).split()] if names else []
            node = Node(tag, names, tuple(tokens))
            if rest and HIDDEN.search(rest):
                node.names += HIDDEN_MARK
            if node.outside == "name":
                if opened["article"] > 0 and all(map(WEAK_NAME.fullmatch, filter(OUTSIDE_NAME.fullmatch, tokens))):
                    doubtful.append(node)
                else:
                    node.names += OUTSIDE_MARK
            stack[-1].children.append(node)
            if tag != "hr" and not rest.endswith("/"):
                level = levels[-1] + 1
                if level >= DEEPEST and not (level < DEEPEST + DEEPER and (node.outside or tag in MAIN)):
                    node, level = Node(tag, names), levels[-1]  # what it holds is its ancestor's, but blocks stay apart
                    node.children = stack[-1].children
                stack.append(node)
                levels.append(level)
                stops.append(len(stack) - 1 if tag in SCOPE or tag in ENDS else stops[-1])
                opened[tag] += 1
        try:
            token = found.send(go)
        except StopIteration:
            token = None
    if at < len(page):
        held.append(page[at:])
    flush()
    for node in doubtful:
        if not has_paragraph(node):
            node.names += OUTSIDE_MARK
    mark_threads(root)
    return root


def has_paragraph(node: Node) -> bool:
    """Whether a text below has ``PARAGRAPH`` words at least, most of its letters outside links."""
    for child in node.children:
        if isinstance(child, str):
            linked = sum(len(part.partition("\2")[0]) for part in child.split("\1")[1:])
            if 2 * linked < len(child) and len(child.split()) >= PARAGRAPH:
                return True
        elif not left_out(child.key) and has_paragraph(child):
            return True
    return False


def is_thread(items: list[Node]) -> bool:
    """Whether siblings of one key are readers' posts: each has several blocks and no heading, is signed by a short one
    at its beginning or end, and either all these have a number, as dates do, or some short block is the same in all."""
    first: list[str] = []
    numbered, shared = True, None
    for item in items:
        if any(n.tag in HEADINGS for n in below(item)):
            return False
        texts = list(blocks(item, True))
        if len(texts) < 2 or max(map(len, texts)) <= min(len(texts[0]), len(texts[-1])):
            return False
        signs = [t for t in (texts[0], texts[-1]) if len(t) <= BYLINE and t[-1] not in ".!?:;…"]
        short = {t for t in texts if len(t) <= BYLINE // 2 and t[-1] not in ".!?:;…"}
        numbered = numbered and any(any(map(str.isdigit, t)) for t in signs)
        shared = short if shared is None else shared & short
        if not signs or not numbered and not shared:
            return False
        first.append(max(texts, key=len))
    return len(set(first)) > len(first) // 2


def below(node: Node) -> Iterator[Node]:
    for child in node.children:
        if not isinstance(child, str):
            yield child
            yield from below(child)


def mark_threads(node: Node) -> None:
    """Marks runs of readers' posts as outside of the article, and headings right before them."""
    some = [c for c in node.children if not isinstance(c, str) or c.strip()]
    at = 0
    while at < len(some):
        to = at + 1
        if isinstance(some[at], str):
            at = to
            continue
        while to < len(some) and not isinstance(some[to], str) and some[to].key == some[at].key:
            to += 1
        if to - at >= POSTS and some[at].tag in ("div", "li", "article", "section", "blockquote", "dd") and not left_out(some[at].key) and is_thread(some[at:to]):
            for item in some[at:to]:
                item.names += OUTSIDE_MARK
            while at and not isinstance(some[at - 1], str) and some[at - 1].tag in HEADINGS:
                at -= 1
                some[at].names += OUTSIDE_MARK
        else:
            for item in some[at:to]:
                mark_threads(item)
        at = to


def clean(text: str) -> str:
    """Character references decoded once, white space as one blank, trimmed."""
    return " ".join(html.unescape(text.replace("\1", "").replace("\2", "")).split())


# An expression is [key, flags, children, text, letters, link letters, pages]: flags has "?" for optional and "+" for
# repeated; text is a digest of all text below, where it is the same on all pages, or None for a slot; letters are sums
# over the pages; pages tells how many have it. The key of a group of several elements is "(" and theirs; it has no tag.


def digest(text: str) -> str:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def expression(node: Node) -> list:
    """The page's expression of a node: children in order, runs that repeat folded into groups."""
    kids: list[list] = []
    for child in node.children:
        if isinstance(child, str):
            text = clean(child)
            if text:
                linked = sum(len(part.partition("\2")[0]) for part in child.split("\1")[1:])
                kids.append(["#", "", [], digest(text), len(text), linked, 1])
        else:
            kids.append(expression(child))
    whole = digest(" ".join(k[3] for k in kids)) if kids else ""
    return [node.key, "", folded(kids), whole, sum(k[4] for k in kids), sum(k[5] for k in kids), 1]


def repeats(keys: list[str], at: int) -> tuple[int, int]:
    """(period, times) of the run from ``at`` that repeats over the most elements, of periods up to ``LONGEST``."""
    best = (1, 1)
    for period in range(1, LONGEST + 1):
        first, to = keys[at : at + period], at + period
        while keys[to : to + period] == first:
            to += period
        if to - at > max(period, best[0] * best[1]):
            best = (period, (to - at) // period)
    return best


def folded(kids: list[list]) -> list[list]:
    """The children of one page with runs that repeat as one repeated element or group each."""
    keys, out, at = [k[0] for k in kids], [], 0
    while at < len(kids):
        period, times = repeats(keys, at)
        if times == 1:
            out.append(kids[at])
            at += 1
            continue
        rounds = [kids[k] if period == 1 else group(kids[k : k + period]) for k in range(at, at + period * times, period)]
        whole = digest(" ".join(r[3] for r in rounds))
        while len(rounds) > 1:  # halves: each element is aligned a few times only
            rounds = [align(*rounds[k : k + 2], within=True) if k + 1 < len(rounds) else rounds[k] for k in range(0, len(rounds), 2)]
        rounds[0][1], rounds[0][3] = ("?" if "?" in rounds[0][1] else "") + "+", whole
        out.append(rounds[0])
        at += period * times
    return out


def group(kids: list[list]) -> list:
    return ["(" + GAP.join(k[0] for k in kids) + ")", "", kids, digest(" ".join(k[3] or "" for k in kids)), sum(k[4] for k in kids), sum(k[5] for k in kids), max(k[6] for k in kids)]


def regrouped(kids: list[list], wanted: set[str]) -> list[list]:
    """Children with runs that are a group elsewhere as that group, taken once."""
    out, at = [], 0
    by_size = sorted(((w[1:-1].split(GAP), w) for w in wanted), key=lambda w: -len(w[0]))
    while at < len(kids):
        for keys, _ in by_size:
            if [k[0] for k in kids[at : at + len(keys)]] == keys:
                out.append(group(kids[at : at + len(keys)]))
                at += len(keys)
                break
        else:
            out.append(kids[at])
            at += 1
    return out


def optional(e: list) -> list:
    return e if "?" in e[1] else [e[0], "?" + e[1], *e[2:]]


def align(a: list, b: list, within: bool = False) -> list:
    """The union-free expression of two expressions of one key: unmatched children become optional, unequal texts slots.
    ``within`` one page, both are rounds of a repetition."""
    flags = ("?" if "?" in a[1] + b[1] else "") + ("+" if "+" in a[1] + b[1] else "")
    x, y, kids = a[2], b[2], []
    if [k[0] for k in x] != [k[0] for k in y]:
        groups = [{k[0] for k in e if k[0][0] == "("} for e in (x, y)]
        x, y = regrouped(x, groups[1] - groups[0]) if groups[1] else x, regrouped(y, groups[0] - groups[1]) if groups[0] else y
    if [k[0] for k in x] == [k[0] for k in y]:
        kids = [align(p, q, within) for p, q in zip(x, y, strict=True)]
    else:
        i = j = 0
        for p, q, n in SequenceMatcher(None, [k[0] for k in x], [k[0] for k in y]).get_matching_blocks():
            kids += map(optional, x[i:p])
            kids += map(optional, y[j:q])
            kids += [align(x[p + k], y[q + k], within) for k in range(n)]
            i, j = p + n, q + n
    new: list[list] = []
    for k in kids:  # an optional beside its like is a repetition
        if new and new[-1][0] == k[0]:
            new[-1] = align(new[-1], k, within)
            new[-1][1] = ("?" if "?" in new[-1][1] else "") + "+"
        else:
            new.append(k)
    return [a[0], flags, bounded(new), a[3] if a[3] == b[3] else None, a[4] + b[4], a[5] + b[5], max(a[6], b[6]) if within else a[6] + b[6]]


def bounded(kids: list[list]) -> list[list]:
    """Children with the optional ones of one tag, or of one group, as one repetition where they are many, so that pages
    unlike all others don't let a wrapper grow."""
    if len(kids) <= MOST_KIDS:
        return kids
    out: list[list] = []
    place: dict[str, int] = {}
    for k in kids:
        if "?" not in k[1] or k[0][0] == "(":
            out.append(k)
            continue
        name = k[0].partition(".")[0]
        mark = "".join(m for m in (HIDDEN_MARK, OUTSIDE_MARK) if m in k[0])
        name = f"{name}.*{mark}" if "." in k[0] else name
        like = [name, k[1], *k[2:]]
        if name in place:
            out[place[name]] = align(out[place[name]], like)
            out[place[name]][1] = "?+"
        else:
            place[name] = len(out)
            out.append(like)
    return out


def left_out(key: str, names: bool = True) -> bool:
    """Whether an element of this key isn't of the article; where ``names`` is false, its class, id and role don't tell."""
    return key.partition(".")[0] in OUTSIDE or HIDDEN_MARK in key or names and OUTSIDE_MARK in key


def weight(e: list, names: bool, constants: bool) -> int:
    """Letters outside links below ``e`` and outside regions that aren't the article's; ``constants``: those of the template too."""
    if left_out(e[0], names) or not constants and e[3] is not None and e[6] > 1:
        return 0
    return max(0, e[4] - 2 * e[5]) if e[0] == "#" else sum(weight(k, names, constants) for k in e[2])


def main_region(wrapper: list) -> dict:
    """Where the wrapper's main text is: ``path``, keys from the top; ``names``, whether classes and ids tell what is
    outside; ``fixed``, (path below, digest) of the template's own texts there.

    An article element that a page has once is taken whatever its share. Else the slots' letters weigh, what pages don't
    share; but where these make no region of like kind with the heaviest one of all letters, as a teaser beside an article
    that all pages have, all letters weigh, as on one page. Names don't tell where they would leave out nine tenths of the
    letters and what they leave is no paragraph. Fixed texts are those outside a region that says what it is.
    """
    some = lambda names: weight(wrapper, names, True)
    names = 10 * some(True) >= some(False) or some(True) >= SAYS * wrapper[6]
    kind, path, every = region_of(wrapper, names, True)
    if not weight(wrapper, names, False):
        return {"path": path, "names": names, "fixed": []}
    own_kind, own_path, own = region_of(wrapper, names, False)
    if own_kind:
        return {"path": own_path, "names": names, "fixed": []}
    slots, heaviest = weight(own, names, False), weight(every, names, True)
    if kind or 8 * slots < heaviest or 2 * slots < heaviest and not several(own, names):
        return {"path": path, "names": names, "fixed": []}
    return {"path": own_path, "names": names, "fixed": fixed(own)}


def several(e: list, names: bool) -> bool:
    """Whether a page has several slots below ``e``."""

    def slots(e: list) -> int:
        if left_out(e[0], names) or e[3] is not None and e[6] > 1:
            return 0
        own = 1 if e[0] == "#" else sum(map(slots, e[2]))
        return 2 * own if "+" in e[1] else own

    return slots(e) > 1


def region_of(wrapper: list, names: bool, constants: bool) -> tuple[int, list[str], list]:
    """(kind, path, element) of the region: a single element that says it is the article (2), whatever its share, or the
    main one (1), or several alike, with a tenth of the weight; else (0), from the top, the child that has two thirds of
    it, while there is one, with names that say so before others."""
    heavy = lambda e: weight(e, names, constants)
    found: list[tuple[int, bool, list[str], list]] = []

    def look(e: list, path: list[str], repeated: bool) -> None:
        for k in e[2]:
            if left_out(k[0], names) or k[0] == "#":
                continue
            again, below = repeated or "+" in k[1], path if k[0][0] == "(" else [*path, k[0]]
            tag, _, said = k[0].partition(".")
            if tag in MAIN or tag in ("div", "section", "td") and said and MAIN_NAMES.search(said):
                found.append(((tag == "article") * 2 + (tag == "main"), again, below, k))
            look(k, below, again)

    look(wrapper, [], False)
    everything = weight(wrapper, names, True)
    single = [(heavy(k), weight(k, names, True), path, k) for known, again, path, k in found if known == 2 and not again]
    if single:
        _, letters, path, e = max(single, key=lambda o: o[:2])
        if letters:
            return 2, path, e
    for kind, share in ((2, 10), (1, 10), (0, 2)):  # article, main, names
        own = [(weight(k, names, True) if kind else heavy(k), path, k) for known, again, path, k in found if known == kind and (not again or kind)]
        if own:
            most, path, e = max(own, key=lambda o: o[0])
            if most and share * most >= (everything if kind else heavy(wrapper)):
                return kind, path, e
    path, here = [], wrapper
    while True:
        kids = [k for k in here[2] if k[0] != "#" and not left_out(k[0], names)]
        top = max(kids, key=heavy, default=None)
        if top is None or top[0].partition(".")[0] in TEXT_TAGS or 3 * heavy(top) < 2 * heavy(here) or not heavy(top) or "+" in top[1]:
            return 0, path, here
        path, here = path if top[0][0] == "(" else [*path, top[0]], top


def fixed(e: list) -> list[list[str]]:
    """(path, digest) of the texts below ``e`` that all its pages have alike, three at least."""
    out: list[list[str]] = []

    def walk(e: list, path: str) -> None:
        for k in e[2]:
            if k[0] == "#" and k[3] is not None and k[6] >= max(FIXED_PAGES, pages):
                out.append([path, k[3]])
            elif k[0] != "#":
                walk(k, path if k[0][0] == "(" else f"{path}{GAP}{k[0]}")

    pages = e[6]
    if pages >= FIXED_PAGES:
        walk(e, "")
    return out


def blocks(node: Node, names: bool, known: set[tuple[str, str]] = frozenset(), path: str = "") -> Iterator[str]:
    """The blocks' texts under a node in page order, without regions outside the article and without ``known`` texts. A
    header holding the article's headings stays; one beside the article has been left out with the region."""
    for child in node.children:
        if isinstance(child, str):
            if (text := clean(child)) and not (known and (path, digest(text)) in known):
                yield text
        elif not left_out(child.key, names):
            yield from blocks(child, names, known, f"{path}{GAP}{child.key}" if known else "")


def regions(node: Node, path: list[str], names: bool, exact: bool = True) -> Iterator[Node]:
    """The nodes at a path of keys below ``node``, skipping levels that the path doesn't name where ``exact`` is false."""
    if not path:
        yield node
        return
    for child in node.children:
        if isinstance(child, Node) and not left_out(child.key, names):
            if child.key == path[0]:
                yield from regions(child, path[1:], names, exact)
            elif not exact:
                yield from regions(child, path, names, exact)


def extract(page: str, region: dict | None) -> str:
    """The page's main text under its host's wrapper; a page that lacks the region, or has no text there, is its own."""
    root = parse(page)
    for own in (region, None):
        own = own or main_region(expression(root))
        path, names, known = own["path"], own["names"], {(a, b) for a, b in own["fixed"]}
        found = list(regions(root, path, names)) or (list(regions(root, path[-1:], names, exact=False)) if path else [])
        top = len(found) == 1 and found[0].tag in ("#root", "html", "body")
        if top:  # a header beside the text isn't the article's
            drop_headers(found[0])
        text = "\n".join(b for n in found for b in blocks(n, names, known))
        if text:
            return text
    return ""


def drop_headers(node: Node) -> None:
    node.children = [c for c in node.children if isinstance(c, str) or c.tag != "header"]
    for c in node.children:
        if not isinstance(c, str) and c.tag in ("html", "body"):
            drop_headers(c)


def wrappers(pages: DataFrame) -> DataFrame:
    """``pages`` (host, html) to a row for each host: host, region (JSON of where the main text is).

    Each task aligns its own pages' expressions host by host and gives a partial wrapper for each. These are aligned
    ``MERGED`` of a host at a time, in levels, until a host has no more than that, and these once more: a host with a
    third of all pages is many tasks' work, and each holds few wrappers of bounded width.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, task, n = {}, TaskContext.get().partitionId(), 0

        def give() -> pa.RecordBatch:
            nonlocal n
            n += 1
            ids = pa.array([task << 32 | n] * len(known), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(list(known)), ids, pa.array([json.dumps(e) for e in known.values()])], names=["host", "part", "wrapper"])

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                new = expression(parse(page.as_py()))
                known[host] = align(known[host], new) if host in known else new
                if len(known) >= 2000:
                    yield give()
                    known.clear()
        if known:
            yield give()

    def joined(table: pa.Table) -> list:
        wrappers = [json.loads(w) for w in sorted(table.column("wrapper").to_pylist())]
        first = wrappers[0]
        for other in wrappers[1:]:
            first = align(first, other)
        return first

    def merged(table: pa.Table) -> pa.Table:
        return pa.table({"host": table.column("host").slice(0, 1), "part": table.column("part").slice(0, 1), "wrapper": [json.dumps(joined(table))]})

    def whole(table: pa.Table) -> pa.Table:
        return pa.table({"host": table.column("host").slice(0, 1), "region": [json.dumps(main_region(joined(table)))]})

    parts = written(map_batches(pages.where("host IS NOT NULL AND html <> ''"), partial, "host string, part long, wrapper string"), "partial_wrappers")
    while (most := parts.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > MERGED:
        salted = parts.withColumn("salt", F.pmod(F.xxhash64("part"), F.lit(-(-most // MERGED))))
        parts = written(salted.groupBy("host", "salt").applyInArrow(lambda t: merged(t.drop_columns("salt")), "host string, part long, wrapper string"), "partial_wrappers")
    return parts.groupBy("host").applyInArrow(whole, "host string, region string")


def extract_pages(pages: DataFrame, id_column: str = "page_id") -> DataFrame:
    """Per row: id, url, text, n_chars (code points). Null or empty html gives an empty text, a null url is a host of
    its own (the empty one); repeated rows give a row each; other columns are left out; an empty table, an empty result.
    Pages of any length are read whole; elements nested deeper than ``DEEPEST`` keep text and blocks."""
    kinds = dict(pages.dtypes)
    host, _ = host_and_path(F.col("url").cast("string"))
    rows = pages.select(id_column, "url", host.alias("_host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("_html"))
    found = written(wrappers(rows.select(F.col("_host").alias("host"), F.col("_html").alias("html"))), "wrappers")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [extract(h.as_py(), json.loads(r.as_py() or "null")) if h.as_py() else "" for h, r in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[id_column, "url", "text", "n_chars"])

    both = rows.join(found, F.col("_host") == F.col("host"), "left").select(id_column, "url", "_html", "region")
    return by_batch(both, run, f"`{id_column}` {kinds[id_column]}, url {kinds['url']}, text string, n_chars long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
