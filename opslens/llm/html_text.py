"""Main text of web pages by wrappers of their hosts.

A page becomes a stream of tokens: one for each block of text, named by the chain of open elements
with their classes and ids.  Wrappers are union-free regular expressions over such tokens.  Neighbouring repeats
(of up to four tokens) fold into a repeated group; two streams of one host are aligned, tokens that only one of them
has become optional, and texts that differ turn from constants into text slots.  Every task aligns the pages it
reads, host by host, and partial wrappers are aligned with each other in rounds of bounded fan-in, so a host with
a third of all pages is many small tasks.

The wrapper says which texts outside of ``article`` and ``main`` are the host's template and, where pages have no ``article`` or ``main``, which
container holds the slots that vary.  Names of elements, classes and ids rule out menus, headers, footers, sidebars,
notices, adverts, forms and reader comments.

Defined cases: a null or empty page gives an empty text; a null or odd url is a host of its own (the empty one); null
and repeated ids are kept as they are; unclosed and stray tags are read as a browser would; an empty table gives
no rows.  Nothing else is dropped or capped.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.llm.store import cut, parts_for

FAN_IN = 64
SALTS = 16
# fixed values: elements of HTML by their effect on text
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea title iframe template svg object canvas select annotation annotation-xml".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img br "
    "math semantics mi mo mn ms mtext mrow msup msub msubsup mfrac msqrt mroot mspace mover munder munderover mtable mtr mtd mstyle mpadded mphantom menclose".split()
)
CLOSES = {  # a start tag ends an open element of these names, up to the boundary elements
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}
SIDE_TAGS = frozenset("nav footer aside form head button menu dialog fieldset".split())
SIDE_NAMES = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs crumbs header masthead topbar footer sidebar aside rail widget widgets ad ads advert adverts "
    "advertisement adbox sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social comment comments reply replies respond disqus discussion related recommended teaser pagination pager "
    "search form copyright legal disclaimer skip tags toolbar byline-social paywall".split()
)
MAIN_NAMES = frozenset("content article post entry story main maincontent articlebody postbody entrycontent maintext text bodytext".split())
# marks that a page's layout may put around everything, and names that say which parts a layout has
LAYOUT = frozenset("form fieldset header sidebar aside rail widget modal overlay dialog paywall search".split())
_HAS = re.compile(r"(?:has|no|not|with|without)[-_]")
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?:(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|(?P<rest>[^>]*)(?:>|\Z))",
    re.S,
)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_DIGITS = re.compile(r"\d+")


@dataclass
class Block:
    path: str
    text: str
    linked: int
    side: bool
    role: int  # 3 inside article, 2 inside main, 1 inside an element named like content, else 0
    marks: tuple = ()  # open elements with a side mark, as (number, whether a layout may have it)
    boxes: tuple = ()  # open elements with a role of their own, as (number, role)


class _Open:
    __slots__ = ("name", "path", "side", "role", "own", "layout", "mine")

    def __init__(self, name: str, attrs: str, above: _Open | None):
        self.name = name
        names: list[str] = []
        main = False
        if attrs and ("class" in attrs or "id" in attrs or "role" in attrs or "CLASS" in attrs or "ID" in attrs):
            for kind, one, two, three in _NAMED.findall(attrs):
                value = one or two or three
                names += value.lower().split()
                main |= kind.lower() == "role" and value.lower() == "main"
        label = ".".join([name, *sorted(set(_DIGITS.sub("0", n) for n in names))])
        self.path = f"{above.path}/{label}" if above else label
        told = [n for n in names if not _HAS.match(n)]
        parts = {p for n in told for p in (n, *re.split(r"[-_]+", n))}
        inner = above is not None and above.role >= 2
        for n in told:  # the header of an article is part of it
            pieces = set(re.split(r"[-_]+", n))
            if "header" in pieces and (inner or pieces & MAIN_NAMES):
                parts -= {"header", n}
        side = name in SIDE_TAGS or name == "header" and not inner or bool(parts & SIDE_NAMES and not (name in ("html", "body", "article", "main") and not parts & {"comment", "comments"}))
        self.own = side
        self.side = side or above is not None and above.side
        self.layout = side and (name in LAYOUT or name not in SIDE_TAGS and not (parts & SIDE_NAMES) - LAYOUT)
        mine = 3 if name == "article" else 2 if name == "main" or main else 1 if {n.replace("-", "").replace("_", "") for n in names} & MAIN_NAMES or parts & MAIN_NAMES else 0
        self.mine = 0 if mine == 1 and name in ("html", "body") else mine
        self.role = max(mine, above.role if above else 0)


def _opened(name: str, attrs: str, above: _Open | None, held: dict = {}) -> _Open:  # noqa: B006
    """An open element; those without names of their own look alike below the same parent."""
    plain = not attrs or not ("class" in attrs or "id" in attrs or "role" in attrs or "CLASS" in attrs or "ID" in attrs)
    if not plain:
        return _Open(name, attrs, above)
    key = (name, above.path, above.side, above.role) if above else (name,)
    found = held.get(key)
    if found is None:
        if len(held) > 50_000:
            held.clear()
        found = held[key] = _Open(name, "", above)
    return found


def blocks(page: str) -> list[Block]:
    """All blocks of text in page order, with what stands around them."""
    out: list[Block] = []
    open_: list[_Open] = []
    text: list[str] = []
    where: _Open | None = None
    around: tuple[tuple, tuple] = (), ()
    numbers: list[int] = []  # of the open elements
    linked = links = opened = 0

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join("".join(text).split())
            text.clear()
            if whole:
                out.append(Block(where.path if where else "", whole, linked, where.side if where else False, where.role if where else 0, *around))
        linked = 0

    def say(piece: str) -> None:
        nonlocal where, around, linked
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            if not text or not where:
                at = next((k for k in range(len(open_) - 1, -1, -1) if open_[k].name not in INLINE or open_[k].own), -1)
                where = open_[at] if at >= 0 else None
                outer = [(n, o) for n, o in zip(numbers, open_[: at + 1]) if o.own or o.mine]
                around = tuple((n, o.layout) for n, o in outer if o.own), tuple((n, o.mine) for n, o in outer if o.mine)
            text.append(piece)
            if links:
                linked += len(piece.strip())

    at, size = 0, len(page)
    while at < size:
        found = _TAG.search(page, at)
        if found is None:
            say(page[at:])
            break
        say(page[at : found.start()])
        at = found.end()
        name = found["name"]
        if name is None:
            if found["cdata"]:
                say(found["cdata"])
            continue
        name = name.lower()
        if found["end"]:
            if name not in INLINE:
                flush()
            for depth in range(len(open_) - 1, -1, -1):
                if open_[depth].name == name:
                    if any(o.name not in INLINE for o in open_[depth:]):
                        flush()
                    links -= sum(o.name == "a" for o in open_[depth:])
                    del open_[depth:]
                    break
                if name in INLINE and open_[depth].name not in INLINE:
                    break
            continue
        attrs = found["attrs"] if found["attrs"] is not None else found["rest"] or ""
        if name in RAW:
            if not attrs.endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if name in VOID:
            if name in ("br", "wbr", "img"):
                say(" " if name != "wbr" else "")
            else:
                flush()
            continue
        if name not in INLINE:
            flush()
            ends, bounds = CLOSES.get(name, ((), ()))
            for depth in range(len(open_) - 1, -1, -1):
                if open_[depth].name in ends or open_[depth].name == "p":
                    links -= sum(o.name == "a" for o in open_[depth:])
                    del open_[depth:]
                    if not ends or open_ and open_[-1].name not in ends:
                        break
                elif open_[depth].name in bounds or not ends and open_[depth].name not in INLINE:
                    break
        if not attrs.endswith("/") or name in INLINE:
            del numbers[len(open_) :]
            opened += 1
            numbers.append(opened)
            open_.append(_opened(name, attrs, open_[-1] if open_ else None))
            links += name == "a"
            if name in INLINE and open_[-1].own:
                flush()
    flush()
    return out


Token = list  # [path, pages that have it, repeated, its constant texts as {checksum: characters}, characters in all]


def fold(stream: list[Block]) -> list[Token]:
    """Tokens of one page with neighbouring repeats as one repeated group each."""
    tokens: list[Token] = []
    for b in stream:
        tokens.append([b.path, 1, False, {str(crc32(b.text.encode())): len(b.text)}, len(b.text)])
        for period in range(1, 5):
            a, z = tokens[-2 * period : -period], tokens[-period:]
            if len(a) == period and [t[0] for t in a] == [t[0] for t in z]:
                for x, y in zip(a, z):
                    x[2], x[4] = True, x[4] + y[4]
                    x[3].update(y[3])
                del tokens[-period:]
                break
    return tokens


def _both(one: dict, two: dict) -> dict:
    return {k: n for k, n in one.items() if k in two}


def align(one: list[Token], two: list[Token]) -> list[Token]:
    """One wrapper for what both describe."""
    keys, others = [t[0] for t in one], [t[0] for t in two]
    if keys == others:
        steps = [("equal", 0, len(one), 0, len(two))]
    else:
        steps = SequenceMatcher(None, keys, others, autojunk=False).get_opcodes()
    out: list[Token] = []
    for kind, a, b, c, d in steps:
        if kind == "equal":
            for x, y in zip(one[a:b], two[c:d]):
                out.append([x[0], x[1] + y[1], x[2] or y[2], _both(x[3], y[3]), x[4] + y[4]])
        else:
            for t in [*one[a:b], *two[c:d]]:  # optional on the other side; a repeat of the token before joins its group
                if out and out[-1][0] == t[0]:
                    out[-1] = [t[0], max(out[-1][1], t[1]), True, _both(out[-1][3], t[3]), out[-1][4] + t[4]]
                else:
                    out.append(list(t))
    return out


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made: dict[str, tuple[int, list[Token]]] = {}
        for host, page in zip(batch["host"].to_pylist(), batch["html"].to_pylist()):
            stream = fold(blocks(page or ""))
            count, wrapper = made.get(host, (0, None))
            made[host] = (count + 1, align(wrapper, stream) if wrapper is not None else stream)
        yield pa.record_batch(
            {
                "host": pa.array(list(made), pa.string()),
                "pages": pa.array([n for n, _ in made.values()], pa.int64()),
                "wrapper": pa.array([json.dumps(w) for _, w in made.values()], pa.string()),
            }
        )


def _merge(rows: pa.Table) -> pa.Table:
    pages, wrapper = 0, None
    for count, text in sorted(zip(rows["pages"].to_pylist(), rows["wrapper"].to_pylist())):
        other = json.loads(text)
        pages, wrapper = pages + count, align(wrapper, other) if wrapper is not None else other
    return pa.table({"host": rows["host"].slice(0, 1), "pages": pa.array([pages], pa.int64()), "wrapper": pa.array([json.dumps(wrapper)], pa.string())})


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, pages, wrapper: one wrapper for each host, from all its pages."""
    kinds = "host string, pages long, wrapper string"
    parts = cut(pages.select("host", "html").mapInArrow(_partial, kinds), "partial-wrappers")
    while True:
        most = parts.groupBy("host").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return parts
        # the draw decides only which parts meet
        dealt = parts.withColumn("deal", F.pmod(F.xxhash64("wrapper", "pages"), F.lit(parts_for(most, FAN_IN))))
        if most > FAN_IN:
            dealt = dealt.withColumn("deal", F.pmod(F.monotonically_increasing_id(), F.lit(parts_for(most, FAN_IN))))
        parts = cut(dealt.groupBy("host", "deal").applyInArrow(_merge, kinds), "wrappers")


def rules(pages: int, wrapper: list[Token]) -> dict:
    """What extraction needs to know of a host: constants of its template and the container of varying text."""
    chars: dict[str, int] = {}
    total = varying = 0
    for path, having, _, constant, size in wrapper:
        free = max(0, size - having * sum(constant.values()))
        total, varying = total + size, varying + free
        for depth in range(1, path.count("/") + 2):
            above = "/".join(path.split("/")[:depth])
            chars[above] = chars.get(above, 0) + free
    deep = [p for p, n in chars.items() if n >= 0.7 * varying]
    fixed = [[t[0], int(k)] for t in wrapper for k in t[3] if pages >= 4 and t[1] >= max(4, 0.5 * pages)]
    # copies of one page make everything constant: then nothing tells template from text
    return {"fixed": fixed if varying >= 0.5 * total else [], "container": max(deep, key=lambda p: p.count("/"), default="")}


def _unmarked(page: list[Block]) -> list[Block]:
    """Blocks without a side mark.  A layout's mark around nearly all text says nothing, if no container is outside of it."""
    open_ = [b for b in page if all(layout for _, layout in b.marks)]
    size, covered = sum(len(b.text) for b in open_), {}
    for b in open_:
        for number, _ in b.marks:
            covered[number] = covered.get(number, 0) + len(b.text)
    if any(b.boxes for b in open_ if not b.marks):
        covered = {}
    lifted = {n for n, chars in covered.items() if chars >= 0.9 * size}
    # menus are no text to fall back on
    if sum(b.linked for b in open_ if b.marks) > 0.5 * size:
        lifted = set()
    return [b for b in open_ if all(n in lifted for n, _ in b.marks)]


def _contained(stream: list[Block]) -> list[Block]:
    """The blocks of the outermost containers of the kind with most text."""
    chars: dict[tuple, int] = {}
    for b in stream:
        if b.boxes:
            chars[b.boxes[0]] = chars.get(b.boxes[0], 0) + len(b.text)
    if not chars:
        return stream
    kinds: dict[int, int] = {}
    for (_, role), n in chars.items():
        kinds[role] = kinds.get(role, 0) + n
    best = max(kinds, key=lambda role: (kinds[role], role))
    return [b for b in stream if b.boxes and b.boxes[0][1] == best]


def main_text(page: str, rule: dict) -> str:
    """Blocks of the article, one per line."""
    stream = _unmarked(blocks(page))
    best = max((b.role for b in stream), default=0)
    if best:
        stream = _contained(stream)
    elif rule.get("container"):
        inside = [b for b in stream if (b.path + "/").startswith(rule["container"] + "/")]
        stream = inside or stream
    fixed = {tuple(f) for f in rule.get("fixed", ())}
    # what an article repeats on every page is its own
    kept = [b for b in stream if b.role >= 2 or not (fixed and (b.path, crc32(b.text.encode())) in fixed)]
    # lists of nothing but links are menus
    kept = [b for b in kept if not (b.role < 2 and b.linked >= 0.9 * len(b.text) and b.path.rsplit("/", 1)[-1].startswith("li"))]
    return "\n".join(b.text for b in kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, dict] = {}
    for batch in batches:
        texts = []
        for page, host, count, wrapper in zip(*(batch[c].to_pylist() for c in ("html", "host", "pages", "wrapper"))):
            if host not in known:
                if len(known) > 2000:
                    known.clear()
                known[host] = rules(count or 0, json.loads(wrapper) if wrapper else [])
            texts.append(main_text(page or "", known[host]))
        yield pa.record_batch(
            {"page_id": batch["page_id"], "url": batch["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())}
        )


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    kind = dict(pages.dtypes)["page_id"]
    held = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    held = held.withColumn("host", host_of(F.col("url")))
    wrappers = infer_wrappers(held)
    # every host's wrapper stands ready in several places, so the pages of a large host are spread
    ready = wrappers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = held.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = dealt.join(ready, ["host", "salt"], "left").select("page_id", "url", "html", "host", "pages", "wrapper")
    return joined.mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")
