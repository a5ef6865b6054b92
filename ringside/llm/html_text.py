"""4. HTML extraction: composite text density over the DOM, the subtree with the largest sum of child densities.

`parse` reads a page in one pass into flat lists (no recursion), closing what HTML lets authors leave open. Scripts, styles,
forms, menus, page headers and footers and sidebars are taken out (`_is_boilerplate`), and so are parts whose class, id
or role is the name of an advert, notice, comment thread and so on (`_is_named`), unless the text of the page or article is
wrapped in them, which their place tells and not their length (`_spared`). For every node left, with C characters, T tags, and LC, LT of them in links:

    density = C / T * log(C / LC * T / LT) / log(log(C / (C - LC) * LC + LC_body / C_body * C + e))

The node with the largest sum of its children's densities is the main one. The smallest density on its path from the body is the
threshold: parts beside the path count as text if they reach it. A main node inside an article or main element stands for
all of that element. Outside the main node, and before its text if that is no article or main, a list or block
of three or more links and nothing else is a menu and no text. A form or menu that the text is wrapped in stays without its controls.

Text: character references decoded, white space inside a block one space, blocks joined by one line feed in page order.

Edge cases: null, blank or textless html: empty text, 0. Broken markup never fails: a `<` that opens no tag is text. A
page without elements is its text. Repeated rows are returned as often as they are there. Empty table: no rows.
"""

import math
import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.llm import frames

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)[^>]*+>|<[!?][^>]*+>""", re.S)
_RAW = {name: re.compile(rf"</{name}\s*>|\Z", re.I) for name in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes")}
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_TOKEN = re.compile(r"[a-z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
#: What a start tag closes if it is open: itself or its siblings, up to the named container.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
            "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
DROPPED = frozenset("head script style noscript template iframe object svg canvas form button select textarea input nav aside footer menu dialog audio video".split())
#: Names that mark a part as no text, where a whole class, id or role is made of them and of words for boxes.
NOISE = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert
comment comments disqus respond reply replies sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead toolbar share sharing social related
newsletter subscribe subscription signup login popup modal overlay pagination pager widget complementary contentinfo""".split())
BOXES = frozenset("area bar block box button buttons container group holder inner item items link links list outer panel row section slot thread unit wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of DROPPED that may hold the text of a page; the CLOSED ones, and a header, only with an article or main in it.
WRAPPERS = frozenset("form menu".split())
OPEN, CLOSED = WRAPPERS | frozenset("aside dialog".split()), frozenset("canvas footer header nav object".split())
CODE = frozenset("pre code samp kbd".split())
WHOLE = frozenset(("article", "main"))
NEVER_INSIDE = frozenset(("aside", "dialog", "nav"))
PARAGRAPHS = frozenset(("p", "blockquote", "pre"))
SENTENCE_ENDS = frozenset(".!?…。！？\"'”’»)")


class Page:
    """Nodes in document order: parent numbers, tags, attributes; text pieces as (node, segment, text)."""

    def __init__(self):
        self.parent, self.tag, self.attributes, self.pieces = [-1], ["#page"], [""], []

    def open(self, tag, attributes, parent):
        self.parent.append(parent)
        self.tag.append(tag)
        self.attributes.append(attributes)
        return len(self.tag) - 1


def parse(html: str) -> Page:
    page, stack, at, segment = Page(), [0], 0, 0

    def text(start, end):
        if end > start:
            page.pieces.append((stack[-1], segment, html[start:end]))

    def close_to(depth):
        nonlocal segment
        if any(page.tag[n] in BLOCK for n in stack[depth:]):
            segment += 1
        del stack[depth:]

    def close(names, within=()):
        for depth in range(len(stack) - 1, 0, -1):
            name = page.tag[stack[depth]]
            if name in names:
                return close_to(depth)
            if name in within:
                return None
        return None

    size = len(html)
    while at < size:
        found = _TAG.search(html, at)
        if found is None:
            text(at, size)
            break
        text(at, found.start())
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        if found[1] or found[4]:
            if name in BLOCK:
                close({name})
                segment += 1
            else:
                close({name}, BLOCK)
            continue
        if name in BLOCK:
            close({"p"}, {"table", "td", "th", "button"} if name == "p" else {"table", "td", "th", "button", "li"})
            segment += 1
        if name in SIBLINGS:
            close(*SIBLINGS[name])
        node = page.open(name, found[3] or "", stack[-1])
        if name in VOID or (found[3] or "").rstrip().endswith("/") and name not in BLOCK:
            if name in ("br", "hr"):
                page.pieces.append((stack[-1], segment, " "))
        elif name in _RAW:
            at = _RAW[name].search(html, at).end()
        else:
            stack.append(node)
            if name in ("td", "th"):
                page.pieces.append((node, segment, " "))
    return page


def _values_of(attributes):
    named = {}
    for name, value in _ATTRIBUTE.findall(attributes):
        named.setdefault(name.lower(), value.strip("\"'").lower())
    return named


def _is_boilerplate(tag, in_article):
    return tag in DROPPED or tag == "header" and not in_article


def _is_hidden(tag, attributes):
    if not attributes or tag in ("html", "body"):
        return False
    named = _values_of(attributes)
    return "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in named.get("style", "").replace(" ", "")


def _is_noise(value):
    """All words are names of NOISE, box words or numbers: `comments`, `ad-box-2`, not `no-sidebar` or `related-work`."""
    found = _TOKEN.findall(value)
    return any(w in NOISE for w in found) and all(w in NOISE or w in BOXES or w.isdigit() for w in found)


def _is_named(attributes, in_article, heading):
    """A class, role or, outside an article, id is a name of no text. An id that repeats the part's heading was made from it."""
    named = _values_of(attributes)
    if any(_is_noise(v) for name in ("class", "role") for v in named.get(name, "").split()):
        return True
    value = named.get("id", "")
    return not in_article and _is_noise(value) and _TOKEN.findall(value) != heading()


def _headings(page):
    """Words of each heading, by node."""
    within, found = [0] * len(page.tag), {}
    for i in range(1, len(page.tag)):
        within[i] = i if page.tag[i] in HEADINGS else within[page.parent[i]]
    for node, _, t in page.pieces:
        if within[node]:
            found.setdefault(within[node], []).append(unescape(t).lower())
    return {i: _TOKEN.findall("".join(t)) for i, t in found.items()}


def _spared(page, candidates, in_article, gone):
    """The candidates that wrap the text of their page or article, told by structure, whatever their length.

    One outside all articles stays if it holds the page's first h1 or main, or is a sibling like that one, or if nothing beside it is text: no article
    or main that has any, and no paragraph that is a sentence. One inside an article stays if that article has no text beside it;
    an aside, dialog or nav there never does. What stands in other candidates is no text beside one.
    """
    n, parent, tag = len(page.tag), page.parent, page.tag
    kept = set()
    for name in ("h1", "main"):
        i = next((i for i in range(1, n) if tag[i] == name and not gone[i]), 0)
        while i:
            if i in candidates and not in_article[i]:
                kept.add(i)
            i = parent[i]
    alike = {(parent[i], tag[i], page.attributes[i]) for i in kept}
    kept |= {i for i in candidates if page.attributes[i] and (parent[i], tag[i], page.attributes[i]) in alike}
    scope, whole, block, linked = [0] * n, [0] * n, [0] * n, [False] * n
    for i in range(1, n):
        p = parent[i]
        scope[i] = i if i in candidates and i not in kept else scope[p]
        whole[i] = i if tag[i] in WHOLE and i not in candidates else whole[p]
        block[i] = i if tag[i] in PARAGRAPHS else block[p]
        linked[i] = linked[p] or tag[i] == "a"
    articles, paragraphs = set(), {}
    for node, _, t in page.pieces:
        if not gone[node] and not linked[node] and not t.isspace():
            articles.add((scope[node], whole[node]))
            if block[node]:
                paragraphs[block[node]] = paragraphs.get(block[node], "") + t
    beside = {s for s, w in articles if w} | {scope[i] for i, t in paragraphs.items() if unescape(t).rstrip()[-1:] in SENTENCE_ENDS}
    for i in candidates - kept:
        around = scope[parent[i]]
        if in_article[i]:
            if tag[i] not in NEVER_INSIDE and (around, whole[parent[i]]) not in articles:
                kept.add(i)
        elif around not in beside:
            kept.add(i)
    return kept


def main_text(html: str | None) -> str:
    if not html or not html.strip():
        return ""
    page = parse(html)
    n = len(page.tag)
    parent, tag = page.parent, page.tag
    holds, in_article, gone, linked, code, candidates = [False] * n, [False] * n, [False] * n, [False] * n, [False] * n, set()
    headings = None

    def heading(i):
        nonlocal headings
        if i + 1 == n or parent[i + 1] != i or tag[i + 1] not in HEADINGS:
            return None
        headings = _headings(page) if headings is None else headings
        return headings.get(i + 1)

    for i in range(n - 1, 0, -1):
        holds[parent[i]] |= holds[i] or tag[i] in WHOLE
    for i in range(1, n):
        in_article[i] = in_article[parent[i]] or tag[parent[i]] in WHOLE
        dropped = _is_boilerplate(tag[i], in_article[i])
        wraps = dropped and (tag[i] in OPEN or tag[i] in CLOSED and holds[i])
        gone[i] = gone[parent[i]] or dropped and not wraps or _is_hidden(tag[i], page.attributes[i])
        linked[i] = linked[parent[i]] or tag[i] == "a"
        code[i] = code[parent[i]] or tag[i] in CODE
        named = page.attributes[i] and not (gone[i] or code[i] or tag[i] in HEADINGS or tag[i] in WHOLE and not in_article[i] or tag[i] in ("html", "body", "main"))
        if not gone[i] and (wraps or named and _is_named(page.attributes[i], in_article[i], lambda i=i: heading(i))):
            candidates.add(i)
    if candidates:
        candidates -= _spared(page, candidates, in_article, gone)
        for i in range(1, n):
            gone[i] = gone[i] or gone[parent[i]] or i in candidates
    pieces = [(node, segment, unescape(t) if "&" in t else t) for node, segment, t in page.pieces if not gone[node]]
    chars, tags, link_chars, link_tags, links = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for node, _, t in pieces:
        size = len("".join(t.split()))
        chars[node] += size
        link_chars[node] += size if linked[node] else 0
    for i in range(n - 1, 0, -1):
        if gone[i]:
            continue
        p = parent[i]
        chars[p] += chars[i]
        link_chars[p] += link_chars[i]
        tags[p] += tags[i] + 1
        link_tags[p] += link_tags[i] + linked[i]
        links[p] += links[i] + (tag[i] == "a")
    # Parts that are nothing but links are menus outside the main node: lists, or blocks of several links.
    menu = [False] * n
    for i in range(1, n):
        alone = chars[i] and link_chars[i] >= 0.9 * chars[i] and tag[i] in ("ul", "ol", "div", "section", "dl") and links[i] >= 3
        menu[i] = menu[parent[i]] or bool(alone)
    body = next((i for i in range(1, n) if tag[i] == "body"), 0)
    rate = link_chars[body] / max(1, chars[body])
    density = [0.0] * n
    sums = [0.0] * n
    for i in range(n - 1, -1, -1):
        if not gone[i] and not menu[i] and chars[i]:
            c, t, lc, lt = chars[i], max(1, tags[i]), max(1, link_chars[i]), max(1, link_tags[i])
            base = math.log(c / max(1, c - link_chars[i]) * link_chars[i] + rate * c + math.e)
            density[i] = c / t * math.log(max(c / lc * t / lt, 1.0) + 1) / math.log(base + 1)
            if i:
                sums[parent[i]] += density[i]
    best = max(range(n), key=lambda i: (sums[i], -i))
    path, whole = set(), None
    i = best
    least = density[best]
    while i >= 0:
        path.add(i)
        if tag[i] in WHOLE:
            whole = i
        if i >= body and density[i]:
            least = min(least, density[i])
        i = parent[i]
    kept = [False] * n
    top = best if whole is None else whole
    # Without an article or main, the main node may reach over the menus before its text.
    text_from = 0 if whole is not None else next((node for node, _, t in pieces if node >= top and not menu[node] and not t.isspace()), 0)
    for i in range(n):
        if gone[i] or menu[i] and (i < text_from or i != top and not kept[parent[i]]):
            continue
        inside = i and kept[parent[i]]
        beside = whole is None and i not in path and parent[i] in path and i > body and density[i] >= least and link_chars[i] < 0.5 * chars[i]
        kept[i] = bool(i == top or inside or beside)
    blocks, last = [], None
    for node, segment, t in pieces:
        if gone[node] or not (kept[node] or whole is None and node in path):
            continue
        if segment != last:
            blocks.append([])
            last = segment
        blocks[-1].append(t)
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""

    def make():
        def step(batch):
            found = [main_text(h) for h in batch.column(batch.schema.get_field_index("html")).to_pylist()]
            return found, [len(t) for t in found]

        return step

    return frames.added(pages.select("page_id", "url", "html"), make, {"text": "string", "n_chars": "long"}, drop=["html"])


def op4_html_extraction(spark, sf_dir):
    return extracted(frames.table(spark, sf_dir, "pages"))
