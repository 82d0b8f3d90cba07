"""Main text of pages by equivalence-class template deduction.

A token is an element at its path (tags with class, id and role, figures left out), standing for its opening and its
closing tag, or a text block at its path. Tokens of a host that have the same occurrence vector over its pages form
an equivalence class. Vectors are compared by a sum of one hash of (page, count) a page, which adds up over
partitions, so every page counts and no list of pages is gathered.

A class is valid if it is frequent enough (SUPPORT, SHARE) and nests: the element around each of its tokens is in a
valid class too, so the valid elements are one tree, the host's template. A text block is a constant of the template
if it is in the class of the element that it stands in, or in the root's class. What else stands between template
elements are slots. A slot's role comes from the template as well: from the root down, the template is followed into
the container that holds most of the text of all slots of the host, and its slots are the main text, less constants
and slots of boilerplate elements. Tags and class words rank below the masses: an article element ends the descent,
an element with a boilerplate word counts for less unless it holds nearly all. On hosts of fewer than SUPPORT
different pages, and on pages without a container of their host's template, the page's own tree is followed.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .urls import parsed

#: A class is valid on so many pages, at least this share of its host's pages, of hosts of so many different pages.
SUPPORT, SHARE = 3, 0.5
#: A text is a constant only on so many pages: fewer may be copies of one article.
CONSTANT = 5
#: A container is entered if it holds this share of the text around it; text under boilerplate words counts SOFT.
ENTERED, SOFT = 0.5, 0.1
#: Templates are broadcast up to so many tokens over all hosts (8 bytes each); beyond that they are joined by host.
BROADCAST_TOKENS = 500_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg xmp".split())
BLOCKS = frozenset("address article aside blockquote body br button caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}
ENDS_P = BLOCKS - frozenset("br button option title head html body li dd dt td th tr tbody thead tfoot caption legend summary".split())
BOILER_TAGS = frozenset("nav header footer aside form menu button select dialog head".split()) | RAW
BOILER_WORDS = frozenset("ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices notification popup promo promoted related reply replies search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())
#: A class with one of these says what stands elsewhere, not what the element is.
RELATIVE = frozenset("no not has with without hide show after before".split())
CONTAINERS = frozenset("html body div section article main table tbody tr td".split())
MAIN_TAGS = frozenset(("article", "main"))
OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
MARK = re.compile(r"(?:^|\s)(class|id|role|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
FIGURES = re.compile(r"\d+")

NONE, WORDS, HARD = 0, 1, 2  # boilerplate by nothing, by class words, by tag
TEXT, OTHER, BOX, MAIN, HEADING, PAGE = range(6)  # kinds of tokens; PAGE: one row a different page


def boilerplate(tag: str, marks: list[tuple[str, str]]) -> int:
    if tag in BOILER_TAGS or any(k == "hidden" for k, _ in marks):
        return HARD
    if tag in ("html", "body"):
        return NONE
    for _, value in marks:
        for name in value.lower().split():
            words = re.split(r"[^a-z]+", name)
            if not BOILER_WORDS.isdisjoint(words) and RELATIVE.isdisjoint(words):
                return WORDS
    return NONE


def kind_of(tag: str, marks: list[tuple[str, str]]) -> int:
    if tag in MAIN_TAGS or ("role", "main") in marks:
        return MAIN
    return HEADING if tag == "h1" else BOX if tag in CONTAINERS else OTHER


class Tree:
    """Elements of a page in page order as parallel lists (token, parent, kind, off, link) and its text blocks as
    (element, text). Element 0 is the page itself. The scanner is linear: each character is passed a bounded number
    of times, whatever the markup."""

    def __init__(self, page: str) -> None:
        self.token, self.parent, self.kind, self.off, self.link = [0], [-1], [BOX], [NONE], [False]
        self.blocks: list[tuple[int, str]] = []
        self.scan(page)

    def scan(self, page: str) -> None:
        stack: list[tuple[str, int]] = [("", 0)]
        opened: Counter = Counter()
        held: list[str] = []
        at, n, last, pattern = 0, len(page), page.rfind(">"), OPEN

        def flush() -> None:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                self.blocks.append((stack[-1][1], text))

        def drop(i: int) -> None:
            for name, _ in stack[i:]:
                opened[name] -= 1
            del stack[i:]

        while at < n:
            i = page.find("<", at)
            if i < 0 or i > last and not page.startswith("<!--", i):
                held.append(page[at:])  # no tag can end any more
                break
            held.append(page[at:i])
            head = page[i + 1 : i + 3]
            if page.startswith("<!--", i):
                end = page.find("-->", i + 2)
                at = end + 3 if end >= 0 else n
                continue
            if head[:1] in ("!", "?"):
                at = page.find(">", i) + 1
                continue
            name = head[1:] if head[:1] == "/" else head[:1]
            if not (name.isascii() and name.isalpha()):
                held.append("<")
                at = i + 1
                continue
            m = pattern.match(page, i)
            if not m and pattern is OPEN:
                pattern = LOOSE  # a quote that never closes: from here on quotes mean nothing
                m = pattern.match(page, i)
            if not m:
                held.append(page[i:])
                break
            at = m.end()
            tag = m[2].lower()
            if m[1]:
                if opened[tag]:
                    j = next(j for j in range(len(stack) - 1, 0, -1) if stack[j][0] == tag)
                    if any(s[0] in BLOCKS for s in stack[j:]):
                        flush()
                    drop(j)
                elif tag == "p":
                    flush()
                continue
            if tag in BLOCKS:
                flush()
            closes = [c for c in CLOSES.get(tag, ()) if opened[c]]
            ends_p = opened["p"] and tag in ENDS_P
            if closes or ends_p:
                for j in range(len(stack) - 1, 0, -1):
                    inner = stack[j][0]
                    if inner in closes or inner == "p" and ends_p:
                        drop(j)
                        break
                    if inner in BLOCKS and inner != "p":
                        break
            marks = [(k.lower(), FIGURES.sub("0", a or b or c)) for k, a, b, c in MARK.findall(m[3])] if m[3] else []
            above = stack[-1][1]
            mine = len(self.token)
            self.token.append(xxhash.xxh3_64_intdigest(f"{self.token[above]}/{tag}|{'|'.join(f'{k}={v}' for k, v in marks)}"))
            self.parent.append(above)
            self.kind.append(kind_of(tag, marks))
            self.off.append(boilerplate(tag, marks))
            self.link.append(self.link[above] or tag == "a")
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
                stop = page.find(">", end.end()) if end else -1
                at = stop + 1 if stop >= 0 else n
            elif tag not in VOID and not m[3].endswith("/"):
                stack.append((tag, mine))
                opened[tag] += 1
        flush()

    def weights(self) -> list[float]:
        """By element, what a character of text right in it counts."""
        out = [1.0]
        for i in range(1, len(self.token)):
            out.append(out[self.parent[i]] * (1.0, SOFT, 0.0)[self.off[i]])
        return out


def signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def text_token(path: int, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{path}#{text}")


def mark(seed: int, n: int) -> int:
    """A page's part of the fingerprint of a vector."""
    x = (seed ^ (n * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93 & (1 << 64) - 1
    return (x ^ x >> 32) * 0xBF58476D1CE4E5B9 >> 16 & (1 << 48) - 1


def tokens(tree: Tree) -> dict[int, list]:
    """token -> [parent token, kind, count, weighted characters of text right in it (a text: in each of it)]"""
    found: dict[int, list] = {}
    for t, p, kind in zip(tree.token, tree.parent, tree.kind):
        found.setdefault(t, [tree.token[p] if p >= 0 else 0, kind, 0, 0.0])[2] += 1
    weight = tree.weights()
    for i, text in tree.blocks:
        own = 0.0 if tree.link[i] else weight[i] * len(text)
        found[tree.token[i]][3] += own
        found.setdefault(text_token(tree.token[i], text), [tree.token[i], TEXT, 0, own])[2] += 1
    return found


def descend(rows: dict[int, tuple[int, int, float]]) -> int:
    """rows: element token -> (parent token, kind, weighted characters right in it), closed under parents. The token
    of the container that is followed to from the root."""
    depth: dict[int, int] = {0: 0}
    for t in rows:
        path = []
        while t not in depth:
            path.append(t)
            t = rows[t][0]
        for k, p in enumerate(reversed(path), depth[t] + 1):
            depth[p] = k
    total = {t: r[2] for t, r in rows.items()}
    below: dict[int, list[int]] = {}
    for t in sorted(rows, key=lambda t: (-depth[t], t)):
        if t:
            total[rows[t][0]] += total[t]
            below.setdefault(rows[t][0], []).append(t)
    at, main = 0, 0
    while total[at] > 0:
        if rows[at][1] == MAIN:
            main = at
        inner = below.get(at, [])
        if any(rows[t][1] == HEADING and total[t] > 0 for t in inner):
            break
        best = max((t for t in inner if rows[t][1] in (BOX, MAIN)), key=lambda t: (total[t], rows[t][1] == MAIN, t), default=None)
        if best is None or total[best] < ENTERED * total[at]:
            break
        at = best
    if rows[at][1] == MAIN:
        main = at
    return main or at


def deduced(rows: Iterable[tuple]) -> tuple[int | None, list[int]]:
    """rows of one host: (token, parent, kind, pages, n, mark, chars). The container's token and the constants."""
    by = {r[0]: r for r in rows if r[2] != PAGE}
    pages = by[0][3]
    if sum(r[2] == PAGE for r in rows) < SUPPORT:
        return None, []
    frequent = lambda r: r[3] >= SUPPORT and r[3] >= SHARE * pages
    vector = lambda r: r[3:6]
    valid: dict[int, bool] = {0: True}
    for t in by:
        path = []
        while t not in valid and t in by and by[t][2] != TEXT and frequent(by[t]):
            path.append(t)
            t = by[t][1]
        good = valid.get(t, False)
        for p in path:
            valid[p] = good
    fixed = [t for t, r in by.items() if r[2] == TEXT and frequent(r) and r[3] >= CONSTANT and valid.get(r[1]) and vector(r) in (vector(by[0]), vector(by[r[1]]))]
    chars = {t: r[6] for t, r in by.items() if r[2] != TEXT and valid.get(t)}
    for t in fixed:
        chars[by[t][1]] -= by[t][6]
    return descend({t: (by[t][1], by[t][2], max(c, 0.0)) for t, c in chars.items()}), fixed


def tokens_by_page(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for host, seed, page in zip(*(b.column(i).to_pylist() for i in range(3))):
                page = page or ""
                for t, (parent, kind, n, chars) in tokens(Tree(page)).items():
                    out.append((host, signed(t), signed(parent), kind, n, mark(seed, n), chars * n if kind == TEXT else chars))
                out.append((host, signed(xxhash.xxh3_64_intdigest(page)), 0, PAGE, 1, 0, 0.0))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int8(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 7, kinds)], ["host", "token", "parent", "kind", "n", "mark", "chars"])

    seed = F.xxhash64("__page", "__url")
    return pages.select(F.xxhash64("__host").alias("host"), seed.alias("seed"), "__html").mapInArrow(run, "host long, token long, parent long, kind byte, n long, mark long, chars double")


def templates(pages: DataFrame) -> DataFrame:
    """(__of, __container, __fixed) by host. Only tokens that can be in a valid class, a number that the page
    structure bounds whatever the number of pages, meet in one row set by host."""
    seen = tokens_by_page(pages).groupBy("host", "token", "kind").agg(F.min("parent").alias("parent"), F.count("*").alias("pages"), F.sum("n").alias("n"), F.sum(F.col("mark").cast("decimal(38,0)")).alias("mark"), F.sum("chars").alias("chars"))
    seen = stored(seen, "tokens")
    # a host has at least SUPPORT different pages or no template; of those pages SUPPORT rows are enough to say so
    whole = seen.where(F.col("kind") != PAGE).where("token = 0").select(F.col("host").alias("__of"), F.col("pages").alias("__all"))
    whole = whole.join(seen.where(F.col("kind") == PAGE).groupBy(F.col("host").alias("__h")).agg(F.count("*").alias("__different")), F.col("__of") == F.col("__h")).where(F.col("__different") >= SUPPORT).drop("__h")
    fit = seen.where((F.col("kind") != PAGE) & (F.col("pages") >= SUPPORT)).join(whole, F.col("host") == F.col("__of")).where((F.col("pages") >= SHARE * F.col("__all")))

    def run(group: pa.Table) -> pa.Table:
        host = group["host"][0].as_py()
        rows = list(zip(*(group[c].to_pylist() for c in ("token", "parent", "kind", "pages", "n", "mark", "chars"))))
        box, fixed = deduced(rows + [(k, 0, PAGE, 1, 1, 0, 0.0) for k in range(SUPPORT)])
        return pa.table([pa.array([host], pa.int64()), pa.array([box], pa.int64()), pa.array([fixed], pa.list_(pa.int64()))], names=["__of", "__container", "__fixed"])

    got = fit.select("host", "token", "parent", "kind", "pages", "n", F.col("mark").cast("string").alias("mark"), "chars").groupBy("host").applyInArrow(run, "__of long, __container long, __fixed array<long>")
    return stored(got, "templates")


def main_text(page: str, container: int | None, fixed: Iterable[int]) -> str:
    """container and fixed: signed tokens of the host's template, or None and nothing."""
    tree = Tree(page)
    fixed = set(fixed)
    if container is None or not any(signed(t) == container for t in tree.token):
        container = signed(descend({t: (r[0], r[1], r[3]) for t, r in tokens(tree).items() if r[1] != TEXT}))
    inside, off = [], []
    for t, p, by in zip(tree.token, tree.parent, tree.off):
        top = signed(t) == container
        inside.append(top or p >= 0 and inside[p])
        state = max(by, off[p]) if p >= 0 else by
        # words on the way to the container mean nothing, tags do
        off.append(NONE if top and state == WORDS else state)
    return " ".join(text for i, text in tree.blocks if inside[i] and off[i] == NONE and signed(text_token(tree.token[i], text)) not in fixed)


def extracted(df: DataFrame, ident: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row a page: page_id, url, text, n_chars.

    Defined cases: null and empty pages have no text; pages without a usable url share the empty host; on hosts of
    fewer than SUPPORT different pages each page's own tree decides; text outside of any container is a slot of the
    page itself; repeated rows each get their row; broken markup never fails: a tag or comment that does not end is
    text or, for a comment, ends the page, a quote that does not end means nothing; other columns are not read.
    """
    pages = parsed(df.select(F.col(ident).alias("__page"), F.col(url).cast("string").alias("__link"), F.col(html).cast("string").alias("__html")), "__link")
    known = templates(pages)
    total = known.agg(F.sum(F.size("__fixed") + 2)).first()[0] or 0
    both = pages.join(F.broadcast(known) if total <= BROADCAST_TOKENS else known, F.xxhash64("__host") == F.col("__of"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(page or "", box, fixed or ()) for page, box, fixed in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = df.schema[ident].dataType.simpleString()
    return both.select("__page", "__link", "__html", "__container", "__fixed").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op7_template_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
