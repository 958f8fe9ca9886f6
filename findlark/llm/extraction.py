"""Operator 1: main text of web pages by structure and the suffixes of a host.

A page is cut into blocks by its tags. Menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and comments are known by tag, role,
class or id - of whatever tag has them - and what is hidden by attribute or style; all these go. If the page marks an article, its blocks are the main text;
otherwise all other blocks are.

What templates repeat without saying so is found on the token streams of a host:
every suffix is keyed by the host and its first ``depth`` tokens, every whole
block shorter than that by its text, and a key's different contents are counted
(sorted, delta coded keys to shards by key range; nothing is ever collected for
a host). A repeated run of ``depth`` tokens or more is covered from end to end by
its own suffixes; shorter ones count only as whole blocks. What is counted are
contents, not pages: pages with equal least hashes (``SKETCH`` of them) of their
suffixes are copies of one content, so that equal pages always and near copies
mostly count once, and a copied text is no template. Tokens with keys of at least
``min_pages`` contents, and of ``share`` as many as the host has texts, are
boilerplate, with or without an article.

Frequent suffixes are broadcast up to ``most`` of them; beyond that they are
joined to the pages by a shuffle, with the same result.

Defined results: null or empty html gives the empty text; an odd url
makes a host of its own, and pages without a host are compared with none; equal pages count once and have equal texts; unclosed tags, comments and
scripts end with the page.
"""

from __future__ import annotations

import html as html_lib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .ngramlm import pack, unpack

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|object|textarea|select|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))"
    r"|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
QUOTED = re.compile(r""""[^"]*"|'[^']*'""")
#: Tags outside BOX that the next block ends.
ENDED = frozenset("p h1 h2 h3 h4 h5 h6 span a b i em strong small font dt dd".split())
LISTS = frozenset("ul ol table menu".split())
ARTICLE_END = re.compile(r"</?(?:article|main)\b", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img".split())
BOX = frozenset("article aside body details dialog div fieldset figure footer form head header html li main menu nav ol section table tbody td tfoot th thead tr ul blockquote center dl button".split())
NOISE_TAGS = frozenset("nav footer aside form head dialog menu button fieldset".split())
NOISE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner cookie cookies consent notice gdpr popup modal newsletter subscribe signup nav navbar navigation menu breadcrumb breadcrumbs sidebar footer comment comments commentlist commentlists disqus reply replies respond share sharing social related recommended recommendations widget toolbar pagination pager login search disclaimer copyright responses discussion masthead topbar sidenav".split())
#: Words that articles use as well: a class of several words is noise by them only if all its words are of these, of NOISE_WORDS or of PARTS.
WEAK_WORDS = frozenset("banner notice menu comment reply replies respond share sharing social related recommended search responses discussion copyright disclaimer promotion consent".split())
PARTS = frozenset("area bar block box button buttons col column container content footer form group head header icon icons inner item items left link links list main outer panel posts post article articles section site stories thread title top wrap wrapper right row widget page your policy message overlay form field input results count feed user users reader".split()) | frozenset("0123456789")
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
MAIN_WORDS = frozenset(("articlebody", "article-body", "post-content", "entry-content", "article-content", "story-body", "post-body", "main-content"))


@dataclass
class Block:
    text: str
    article: bool


def blocks(html: str | None) -> list[Block]:
    """Text blocks of a page that no tag, role, class or id marks as noise, in order; those of the article if it has any."""
    out: list[Block] = []
    if not html:
        return out
    odd = 0  # open tags outside BOX that are noise
    stack: list[tuple[str, int, int, bool]] = []  # tag, whether it is noise, whether it is the article, whether only its name says noise
    noise = article = 0
    parts: list[str] = []
    linked = total = in_link = 0

    def flush():
        nonlocal parts, linked, total
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            if text and not (total and linked > 0.6 * total and not article and listed):
                out.append(Block(text, article > 0))
        parts, linked, total = [], 0, 0

    listed = 0  # open lists and tables

    def add(piece: str):
        nonlocal linked, total
        if piece and not noise:
            parts.append(piece)
            n = len(piece.strip())
            total += n
            linked += n if in_link else 0

    at = 0
    for m in TAG.finditer(html):
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        tag = m.group(3)
        if tag is None:
            if m.group(1):
                parts.append(" ") if parts else None
            continue
        tag, closing = tag.lower(), m.group(2)
        plain = tag not in BOX
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
        else:
            flush()
            if odd and not closing:  # what stands open inside a line ends with it
                while stack and stack[-1][0] in ENDED:
                    noise, odd = noise - stack.pop()[1], odd - 1
        if plain:
            if closing:
                k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), -1) if odd else -1
                if k >= 0:
                    noise -= sum(x[1] for x in stack[k:])
                    article -= sum(x[2] for x in stack[k:])
                    odd -= sum(x[0] not in BOX for x in stack[k:])
                    listed -= sum(x[0] in LISTS for x in stack[k:])
                    del stack[k:]
            elif tag not in VOID and len(m.group(4)) > 1 and not m.group(4).rstrip(">").endswith("/") and marks(m.group(4), tag)[0]:
                stack.append((tag, 1, 0, True))
                noise, odd = noise + 1, odd + 1
            continue
        if closing:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), -1)
            if k >= 0:
                noise -= sum(x[1] for x in stack[k:])
                article -= sum(x[2] for x in stack[k:])
                odd -= sum(x[0] not in BOX for x in stack[k:])
                listed -= sum(x[0] in LISTS for x in stack[k:])
                del stack[k:]
            continue
        if m.group(4).rstrip(">").endswith("/") or tag == "html":
            continue
        if tag == "body":  # an open head ends here
            noise -= sum(x[1] for x in stack)
            article -= sum(x[2] for x in stack)
            odd = listed = 0
            stack.clear()
        elif tag == "li":  # implied end
            if stack and stack[-1][0] == "li":
                _, a, b, _ = stack.pop()
                noise, article = noise - a, article - b
        named = False  # noise by class or id alone
        bad, good = tag in NOISE_TAGS or (tag == "header" and not article), tag in ("article", "main")
        if len(m.group(4)) > 1:
            said, good_, head, by_role = marks(m.group(4), tag)
            bad, good, named = bad or said or by_role or (head and not article and tag != "body"), good or good_, said
        bad = bad and tag != "body"
        if tag == "article" and teaser(html, m.end(), stack):
            bad = True
        good = good and not bad
        if good and noise and not any(b.article for b in out):
            # What holds the page's article is a wrapper, whatever its class says.
            for k, (t, a, b, by_name) in enumerate(stack):
                if by_name:
                    noise -= a
                    stack[k] = (t, 0, b, False)
        stack.append((tag, int(bad), int(good), named and tag not in NOISE_TAGS))
        noise += bad
        article += good
        listed += tag in LISTS
    if at < len(html):
        add(html[at:])
    flush()
    own = [b for b in out if b.article]
    return own or out


#: A card that only leads to another page: an article tag with no paragraph of its own, in a main text that has articles besides.
def teaser(html: str, at: int, stack: list) -> bool:
    if not any(x[2] for x in stack):
        return False
    end = ARTICLE_END.search(html, at)
    inside = html[at : end.start() if end else len(html)]
    text = re.sub(r"<[^>]*>", " ", inside)
    links = " ".join(re.findall(r"<a\b[^>]*>(.*?)</a", inside, re.S | re.I))
    return len(re.sub(r"<[^>]*>", " ", links).split()) > 0.6 * len(text.split()) > 0


def noisy(value: str, tag: str) -> bool:
    """Whether a class or id attribute says that a tag is no main text."""
    for token in value.split():
        words = [w for w in re.split(r"[^a-z0-9]+", token) if w]
        hit = NOISE_WORDS.intersection(words)
        if not hit or {"has", "with", "no", "without"}.intersection(words):
            continue
        if tag not in BOX and len(words) > 1 and not all(w in NOISE_WORDS or w in PARTS for w in words):
            continue  # a line of the text needs a plainer word
        if tag == "section" and words in (["discussion"], ["responses"]):
            continue  # of a paper
        if not hit <= WEAK_WORDS or all(w in NOISE_WORDS or w in PARTS for w in words):
            return True
    return False


def marks(attributes: str, tag: str) -> tuple[bool, bool, bool, bool]:
    """What a tag's attributes say: noise by class or id, or hidden; the main text; a page header by class or id; noise by role."""
    bad = good = head = by_role = False
    bare = QUOTED.sub('""', attributes).lower()
    if "hidden" in bare and re.search(r"(?<![\w-])hidden(?![\w-])", bare):
        bad = True
    for name, *values in ATTR.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name in ("class", "id"):
            bad |= noisy(value, tag)
            good |= not MAIN_WORDS.isdisjoint(value.split())
            head |= "header" in re.split(r"[^a-z0-9]+", value)
        elif name == "role":
            by_role |= value in NOISE_ROLES
            good |= value == "main"
        elif name == "itemprop":
            good |= value == "articlebody"
        elif name == "style":
            bad |= "display:none" in (v := value.replace(" ", "")) or "visibility:hidden" in v
        elif name == "aria-hidden":
            bad |= value == "true"
    return bad or by_role and tag not in BOX, good and not bad, head, by_role


def host(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][\w+.-]*://([^/?#\s]+)", url or "")
    name = m.group(1).rsplit("@", 1)[-1].lower() if m else (url or "")
    return re.sub(r":\d+$", "", name).removeprefix("www.").removeprefix("m.")


@dataclass(frozen=True)
class Params:
    depth: int = 8
    min_pages: int = 5
    share: float = 0.3
    most: int = 1 << 22


#: Keys have KEY_BITS, so that a key and the number of a content among a chunk's fit 64 bits.
KEY_BITS = 46
SHIFT = np.uint64(64 - KEY_BITS)
#: Least hashes of a page's suffixes that have to be equal for pages to be copies.
SKETCH = 4


class Pages:
    """A chunk of pages: their blocks, words, and keys (x, made with the host's name) of all suffixes by their first tokens and of all whole blocks that are shorter, with page (row), place among the page's words (at) and length."""

    def __init__(self, urls: list[str | None], htmls: list[str | None], p: Params):
        self.blocks = [blocks(h) for h in htmls]
        self.texts = [" ".join(b.text for b in x) for x in self.blocks]
        w = common.Words(pa.array(self.texts, pa.string()))
        known: dict[str, int] = {}
        names = list(map(host, urls))
        self.host = np.array([known.setdefault(n, xxhash.xxh64_intdigest(n)) for n in names], dtype=np.uint64)
        self.named = np.array([n != "" for n in names], dtype=bool)
        x, at = w.windows(common.word_hashes(w.vocab), p.depth)
        row = w.row[at]
        self._identify(x, row, w.n)
        short = []
        for i, own in enumerate(self.blocks):
            place = 0
            for b in own:
                n = b.text.count(" ") + 1
                if n < p.depth:
                    short.append((xxhash.xxh64_intdigest(b.text, n), i, place, n))
                place += n
        sx, srow, sat, sn = (np.array(v, t) for v, t in zip(zip(*short) if short else [()] * 4, (np.uint64, np.int64, np.int64, np.int64)))
        x, row = np.concatenate([x, sx]), np.concatenate([row, srow])
        at, length = np.concatenate([at - w.start[row[: len(at)]], sat]), np.concatenate([np.full(len(at), p.depth), sn])
        o = np.lexsort((at, row))
        o = o[self.named[row[o]]]
        self.row, self.at, self.length = row[o], at[o], length[o]
        self.x = common.mix(x[o] ^ self.host[self.row]) >> SHIFT

    def _identify(self, x: np.ndarray, row: np.ndarray, n: int) -> None:
        """text: hash of each page's text. content: equal for copies and, by the sketch of their suffixes, for most near copies."""
        self.text = np.array([xxhash.xxh64_intdigest(t) for t in self.texts], dtype=np.uint64)
        self.content = self.text.copy()
        if len(x):
            start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            acc = np.zeros(len(start), np.uint64)
            for k in range(SKETCH):
                acc = common.mix(acc ^ np.minimum.reduceat(common.mix(x ^ common.MULT[k]), start))
            self.content[row[start]] = acc


def host_key(h: np.ndarray) -> np.ndarray:
    return common.mix(h ^ np.uint64(0xABCDEF)) >> SHIFT


SENT = pa.schema([("shard", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("of", pa.binary()), ("contents", pa.binary())])


def suffix_counts(pages: DataFrame, p: Params) -> DataFrame:
    """(x, n) of the keys that at least min_pages different contents of a host have; a host's own key has its number of different texts."""
    shards = max(8, pages.count() // 2000)

    def run(batches):
        for b in common.chunks(batches, "html"):
            c = Pages(b.column("url").to_pylist(), b.column("html").to_pylist(), p)
            ids, of = np.unique(np.concatenate([c.content, c.text]), return_inverse=True)
            keys = np.concatenate([c.x, host_key(c.host)])
            of = of[np.concatenate([c.row, np.arange(b.num_rows) + b.num_rows])]
            s = common.distinct(keys << SHIFT | of.astype(np.uint64))
            keys, of = s >> SHIFT, (s & np.uint64((1 << int(SHIFT)) - 1)).astype(np.int64)
            cuts = np.searchsorted((keys >> np.uint64(KEY_BITS - 20)) * np.uint64(shards) >> np.uint64(20), np.arange(shards + 1))
            rows = []
            for k in range(shards):
                own = slice(cuts[k], cuts[k + 1])
                if cuts[k + 1] > cuts[k]:
                    used, number = np.unique(of[own], return_inverse=True)
                    rows.append((k, int(cuts[k + 1] - cuts[k]), pack(np.diff(keys[own], prepend=np.uint64(0))), pack(number), ids[used].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), SENT)], schema=SENT)

    def count(t: pa.Table) -> pa.Table:
        parts = list(zip(*(t.column(k).to_pylist() for k in ("n", "keys", "of", "contents"))))
        keys = [np.cumsum(unpack(k, n), dtype=np.uint64) for n, k, _, _ in parts]
        s = np.sort(np.concatenate(keys))
        cut = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        often = s[cut][np.diff(np.append(cut, len(s))) >= p.min_pages]
        x, c = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        for k, (n, _, of, ids) in zip(keys, parts):
            if len(often):
                on = np.flatnonzero(often[np.minimum(np.searchsorted(often, k), len(often) - 1)] == k)
                x.append(k[on])
                c.append(np.frombuffer(ids, np.uint64)[unpack(of, n)[on].astype(np.int64)])
        x, c = np.concatenate(x), np.concatenate(c)
        o = np.lexsort((c, x))
        x, c = x[o], c[o]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (c[1:] != c[:-1])
        x, n = np.unique(x[new], return_counts=True)
        on = n >= p.min_pages
        return pa.table([pa.array(x[on].view(np.int64)), pa.array(n[on], pa.int32())], names=["x", "n"])

    sent = pages.select("url", "html").mapInArrow(run, "shard int, n long, keys binary, of binary, contents binary")
    return sent.groupBy("shard").applyInArrow(count, "x long, n int")


def uncovered(own: list[Block], runs: list[tuple[int, int, int]], host_texts: int, p: Params) -> str:
    """The text of a page's blocks without covered runs. runs: place, length and number of contents of the keys that several contents of the host have."""
    need = max(p.min_pages, p.share * host_texts)
    tokens = [b.text.split(" ") for b in own]
    covered = np.zeros(sum(map(len, tokens)), bool)
    for at, n, contents in runs:
        if contents >= need:
            covered[at : at + n] = True
    out, at = [], 0
    for t in tokens:
        kept = [w for w, c in zip(t, covered[at : at + len(t)].tolist()) if not c]
        at += len(t)
        if kept:
            out.append(" ".join(kept))
    return " ".join(out)


def extract(pages: DataFrame, p: Params = Params()) -> DataFrame:
    """pages(page_id, url, html, ...) without html, with text and n_chars; input columns of those names are replaced."""
    common.small_batches(pages.sparkSession)
    spark = pages.sparkSession
    pages = pages.drop("text", "n_chars")
    frequent = suffix_counts(pages, p)
    names = [c for c in pages.columns if c != "html"]
    schema = T.StructType([*(pages.schema[c] for c in names), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    got = frequent.limit(p.most + 1).toArrow()
    own = got.num_rows <= p.most
    if own:
        x, n = np.asarray(got.column("x")).view(np.uint64), np.asarray(got.column("n"))
        o = np.argsort(x)
        shipped = spark.sparkContext.broadcast((x[o], n[o]))
    else:
        pages = _joined(pages, frequent, p)

    def run(batches):
        for b in common.chunks(batches, "html"):
            c = Pages(b.column("url").to_pylist(), b.column("html").to_pylist(), p)
            if own:
                known, n = shipped.value
            else:
                found = {d["x"] % (1 << 64): d["n"] for x in b.column("_found").to_pylist() for d in x or ()}
                known = np.array(sorted(found), dtype=np.uint64)
                n = np.array([found[k] for k in known.tolist()], dtype=np.int64)

            def pages_of(x):
                if not len(known):
                    return np.zeros(len(x), np.int64)
                at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                return np.where(known[at] == x, n[at], 0)

            here, hosts = pages_of(c.x), pages_of(host_key(c.host)).tolist()
            cut = np.searchsorted(c.row, np.arange(b.num_rows + 1))
            for i in np.unique(c.row[here > 0]).tolist():
                part = slice(cut[i], cut[i + 1])
                c.texts[i] = uncovered(c.blocks[i], list(zip(c.at[part].tolist(), c.length[part].tolist(), here[part].tolist())), hosts[i], p)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in names), pa.array(c.texts, pa.string()), pa.array(list(map(len, c.texts)), pa.int64())], names=[*names, "text", "n_chars"])

    return pages.mapInArrow(run, schema)


def _joined(pages: DataFrame, frequent: DataFrame, p: Params) -> DataFrame:
    """pages with _found: its own frequent suffixes, by a shuffle join."""
    key = F.xxhash64("url", "html")

    def run(batches):
        for b in common.chunks(batches, "html"):
            c = Pages(b.column("url").to_pylist(), b.column("html").to_pylist(), p)
            key_of = np.asarray(b.column("_key"))
            keys = np.concatenate([key_of[c.row], key_of])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.concatenate([c.x, host_key(c.host)]).view(np.int64))], names=["_key", "x"])

    keyed = pages.withColumn("_key", key)
    own = keyed.select("_key", "url", "html").mapInArrow(run, "_key long, x long").join(frequent, "x").distinct()
    return keyed.join(own.groupBy("_key").agg(F.collect_list(F.struct("x", "n")).alias("_found")), "_key", "left").drop("_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.load(spark, sf_dir, "pages").select("page_id", "url", "html"))
