"""Main text of web pages by nearest-URL page differencing.

The distinct URLs of a host are put in the order of their paths; each page is paired with the neighbour whose path shares the
longest prefix (and knows the neighbour on the other side). The pair's text lines are aligned by their longest common
subsequence, over all lines that a browser would show, menus and footers included, and lines that both have are the site's frame:
they are deleted. Two things hold deletion back:

* Prose (a line of PROSE words or more that isn't all links) is the site's only if the neighbour on the other side has it too; an
  article that one neighbour copies isn't on both. Where there is no other neighbour, prose goes only if the page has other prose.
  A page that would be left without a line of its own is itself a copy: its prose stays, and all but links if it has no prose.
* Lines of an article element that aren't all links stay, as whole articles are republished within a host.

Markup then decides what differencing can't, as menus, adverts and footers may differ from page to page: lines in navigation,
header, footer, aside, forms or elements whose name says that they are adverts, notices, menus or comments go. Such a name (other
than of adverts and comments) isn't believed of prose that is most of what is left of a page without an article element.
"""

from __future__ import annotations

import html as entities
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_partitions, written

#: Elements that show no text of the page, those that hold a frame, and those whose content isn't markup.
UNSEEN = frozenset("script style noscript template svg annotation annotation-xml iframe object embed select button textarea head title canvas audio video datalist".split())
FRAMES = frozenset("nav header footer aside form dialog menu".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that run inside a line; any other tag ends the line.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr math mi mn mo mrow msup msub msubsup mfrac msqrt mroot mtext mspace mstyle mover munder munderover semantics".split())
#: Words of class, id or role that name adverts, notices of consent and readers' comments; other frame parts; what
#: may follow such a word in a name; words before it that make it say something else.
ADVERTS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr comment comments disqus reply replies respond werbung anzeige anzeigen kommentar kommentare publicite commentaire commentaires publicidad anuncio anuncios comentario comentarios".split())
PARTS = frozenset("banner menu nav navbar navigation breadcrumb breadcrumbs sidebar aside footer header masthead notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended widget widgets pagination pager toolbar search skip contentinfo complementary".split())
HOLDERS = frozenset("area bar block body box button buttons center container content form group inner inline item items label left line link links list outer panel right row section slot text top bottom unit wrap wrapper".split())
#: Words of names that say whose, where or which the part is; with any other word beside it a name is in doubt ("market-share").
OF = frozenset("site page global main primary secondary left right top bottom upper lower inner outer side float floating sticky fixed mobile desktop post article blog news story entry user users reader readers visitor google dfp taboola outbrain social text image native house js wp bs md lg sm xs nav sub mega mini full header footer sidebar aside".split())
NOT_NAMED = frozenset("has with no not non without is hide show".split())
#: Elements and names that mark the article itself.
CONTENT_TAGS = frozenset(("article", "main"))
#: Start tags that end an open element whose end tag may be left out, and the elements beyond which none is looked for.
_CELLS, _TABLE = frozenset(("table", "td", "th", "caption")), frozenset(("table",))
IMPLIED: dict[str, tuple[frozenset, frozenset]] = {
    **{t: (frozenset("p"), _CELLS) for t in "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()},
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", *_CELLS))), "dt": (frozenset(("dt", "dd")), frozenset(("dl", *_CELLS))), "dd": (frozenset(("dt", "dd")), frozenset(("dl", *_CELLS))),
    "tr": (frozenset(("tr", "caption")), _TABLE), "td": (frozenset(("td", "th")), frozenset(("table", "tr"))), "th": (frozenset(("td", "th")), frozenset(("table", "tr"))),
    **{t: (frozenset(("thead", "tbody", "tfoot", "caption")), _TABLE) for t in ("thead", "tbody", "tfoot")},
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))), "optgroup": (frozenset(("optgroup",)), frozenset(("select",))), "body": (frozenset(("head",)), frozenset()),
}
#: Words from which on a line that isn't all links is prose.
PROSE = 8
#: Flags of lines.
ARTICLE, LINKS, FRAME, NAMED, UNSEEN_PART, FORM, DOUBTED, MENU = 1, 2, 4, 8, 16, 32, 64, 128
#: Those of a frame's lines.
_OF_FRAME = LINKS | FRAME | NAMED | FORM | DOUBTED

#: A tag ends at its ">" outside of quotes; where another "<" comes first there is none, so that no sign is looked at for many tags.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^<>]*+>|<\?[^<>]*+>|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z]+|[0-9]+")


def _named(value: str) -> int:
    """What the names of an element say: FRAME for adverts and comments, NAMED for other frame parts, else 0; DOUBTED instead where
    that is only the last word beside others that may say something else.

    A name is read as a compound: its last word is what it is ("site-footer"), unless that only holds something ("ad-slot")."""
    out = 0
    for name in value.split():
        words = [w for w in _WORDS.findall(name) if not w.isdigit()]
        while len(words) > 1 and words[-1] in HOLDERS:
            words.pop()
        if words and not NOT_NAMED.intersection(words[:-1]):
            said = FRAME if words[-1] in ADVERTS or words[0] in ADVERTS and words[-1] in PARTS else NAMED if words[-1] in PARTS else 0
            known = all(w in OF or w in HOLDERS or w in PARTS or w in ADVERTS for w in words)
            out |= said if known or not said else DOUBTED
    return out & -out if out & (FRAME | NAMED) else out


def _kind(tag: str, attributes: str) -> int:
    """The flag that an element gives to the lines in it."""
    if tag in UNSEEN:
        return UNSEEN_PART
    article, names = tag in CONTENT_TAGS, 0
    if attributes and not attributes.isspace():
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), next((v for v in values if v), "").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return UNSEEN_PART
            if name == "itemprop":
                article |= value == "articlebody"
            elif name == "role" and value in CONTENT_TAGS:
                article = True
            elif name in ("class", "id", "role"):
                names |= _named(value)
    if article:
        return ARTICLE
    if tag in FRAMES and tag != "form":
        return FRAME
    if tag == "form":
        return FRAME if names & FRAME else FORM
    return 0 if tag in ("html", "body") else names


def lines(page: str | None) -> tuple[list[str], list[int]]:
    """The text lines of a page, in page order, and the flags of each: ARTICLE, FRAME, NAMED, DOUBTED and FORM by the elements that it
    is in, LINKS if all of it is links, MENU if it is several. A form around an article says nothing of the article's lines."""
    page = page or ""
    out: list[str] = []
    flags: list[int] = []
    stack: list[tuple[str, int]] = []  # open block elements, and others that matter: tag, kind
    names: dict[str, int] = {}  # how many of each are open
    kinds = dict.fromkeys((0, ARTICLE, FRAME, NAMED, UNSEEN_PART, FORM, DOUBTED), 0)
    around: list[int] = []  # for each open article the forms that it is in
    links = anchors = 0
    line: list[str] = []
    plain = linked = False

    def end():
        nonlocal plain, linked, anchors
        if line:
            text = " ".join(entities.unescape("".join(line)).split())
            if text:
                out.append(text)
                form = FORM if kinds[FORM] > (around[-1] if around else 0) else 0
                flags.append(sum(k for k in (ARTICLE, FRAME, NAMED, DOUBTED) if kinds[k]) | form | ((LINKS | (MENU if anchors > 1 else 0)) if linked and not plain else 0))
            line.clear()
        plain = linked = False
        anchors = 0

    def add(piece: str):
        nonlocal plain, linked
        if piece and not kinds[UNSEEN_PART]:
            line.append(piece)
            if piece.strip():
                if links:
                    linked = True
                else:
                    plain = True

    def close(tags: frozenset, bounds: frozenset):
        """Ends the innermost open element of these tags, with all inside it, unless one of `bounds` is nearer."""
        if not any(names.get(t) for t in tags):
            return
        for place in range(len(stack) - 1, -1, -1):
            if stack[place][0] in tags:
                end_of = stack[place:]
                if any(kind not in (0, UNSEEN_PART) for _, kind in end_of):
                    end()
                for name, kind in end_of:
                    names[name] -= 1
                    kinds[kind] -= 1
                    if kind == ARTICLE:
                        around.pop()
                del stack[place:]
                return
            if stack[place][0] in bounds:
                return

    at, size = 0, len(page)
    while at < size:
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        add(page[at:start])
        found = _TAG.match(page, start)
        if not found:
            add("<")  # a bare sign
            at = start + 1
            continue
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            if tag not in INLINE:
                end()
            if tag == "a":
                links = max(0, links - 1)
            close(frozenset((tag,)), _TABLE if tag in _TABLE or tag in ("td", "th", "caption", "tr", "thead", "tbody", "tfoot") else frozenset() if tag in ("body", "html") else _CELLS)
            continue
        if tag not in INLINE and tag not in RAW:
            end()
        elif tag == "a":
            links += 1
            anchors += 1
        if tag in IMPLIED:
            close(*IMPLIED[tag])
            if tag in ("li", "dt", "dd"):
                close(*IMPLIED["p"])
        if tag == "br":
            add(" ")
        if tag in VOID or found[3].endswith("/") and tag not in UNSEEN and tag not in FRAMES and tag not in INLINE and tag != "div":
            continue
        kind = _kind(tag, found[3])
        if tag in INLINE and kind:
            kind = ARTICLE if kind == ARTICLE else UNSEEN_PART  # a frame part inside a line isn't a line of its own
        if tag in RAW:
            closed = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = closed.end() if closed else size
            continue
        if kind or tag not in INLINE or names.get(tag):
            # Blocks, and elements of the same name as an open one: their ends must not close an outer one.
            stack.append((tag, kind))
            names[tag] = names.get(tag, 0) + 1
            if kind == ARTICLE:
                around.append(kinds[FORM])
            kinds[kind] += 1
    end()
    return out, flags


def common_lines(a: list, b: list) -> set[int]:
    """Indices in `a` of a longest common subsequence with `b`."""
    here, there = set(a), set(b)
    kept, other = [i for i, line in enumerate(a) if line in there], [line for line in b if line in here]
    return {kept[i] for i in _subsequence([a[i] for i in kept], other)}


def _rows(where: dict, full: int, state: int, y: list) -> list[int]:
    """Rows of bits, one after each element of `y` from `state` on: a zero bit i after j elements says that the common length of
    x[:i + 1] and y[:j] is one more than that of x[:i]. where: the bits of x's lines."""
    states = [state]
    for line in y:
        match = where.get(line, 0)
        state = (state + (state & match) | state & ~match) & full
        states.append(state)
    return states


def _subsequence(x: list, y: list, every: int = 0) -> set[int]:
    """Indices in `x` of the common subsequence that a way back through all rows finds: the first place for the last line, and so on.
    Of the rows one in `every` (a root of their number) is kept and those between are made again, so that memory is far below
    their product and the lines are the same for every size."""
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    out = {*range(head), *range(len(x) - tail, len(x))}
    x, y = x[head : len(x) - tail], y[head : len(y) - tail]
    if not x or not y:
        return out
    where: dict = {}
    for i, line in enumerate(x):
        where[line] = where.get(line, 0) | 1 << i
    full, every = (1 << len(x)) - 1, every or int(len(y) ** 0.5) + 1
    kept = [full]
    for at in range(0, len(y), every):
        state = kept[-1]
        for line in y[at : at + every]:
            match = where.get(line, 0)
            state = (state + (state & match) | state & ~match) & full
        kept.append(state)
    i = len(x) - 1
    for part in range(len(kept) - 2, -1, -1):
        states = _rows(where, full, kept[part], y[part * every : (part + 1) * every])
        j = len(states) - 1
        while i >= 0 and j > 0:
            if states[j] >> i & 1:
                i -= 1
            elif not states[j - 1] >> i & 1:
                j -= 1
            else:
                out.add(head + i)
                i, j = i - 1, j - 1
    return out


def compared(flag: int) -> bool:
    """Whether a line with these flags takes part in differencing: all but an article's own text."""
    return not flag & ARTICLE or bool(flag & _OF_FRAME)


def shared_lines(own: list, flags: list[int], prose: list[bool], nearest: list | None, second: list | None) -> set[int]:
    """Indices of the lines that differencing deletes. own: a page's lines (or keys of them), prose: whether each is prose; nearest
    and second: the lines of the neighbours that take part, None for a neighbour that isn't there."""
    if nearest is None:
        return set()
    mine = [i for i, f in enumerate(flags) if compared(f)]
    common = {mine[i] for i in common_lines([own[i] for i in mine], nearest)}
    sure = common if second is None else {mine[i] for i in common_lines([own[i] for i in mine], second)}
    out = {i for i in common if not prose[i] or i in sure}

    def left(of: set[int]) -> list[int]:
        return [i for i in range(len(own)) if i not in of and not flags[i] & _OF_FRAME]

    alone = second is None and any(prose[i] for i in out) and not any(prose[i] for i in left(out))
    if alone or not left(out):
        out = {i for i in out if not prose[i] or flags[i] & FRAME}
    return out if left(out) else {i for i in out if flags[i] & _OF_FRAME}


def assemble(own: list[str], flags: list[int], deleted: set[int]) -> str:
    """The main text: lines that differencing left and whose markup doesn't say that they are the frame's.

    Lines that are several links alone are menus, and beside an article those that are one; an article's own stay. A form around
    most of the text is the page's, not a part of it. A name in doubt isn't believed of an article's prose, nor where nothing else is left.
    """
    left = [i for i in range(len(own)) if i not in deleted]
    article = any(f & ARTICLE for f in flags)
    menu = LINKS if article else MENU
    left = [i for i in left if not flags[i] & menu or flags[i] & ARTICLE]
    plain = [i for i in left if not flags[i] & (FRAME | NAMED | DOUBTED | LINKS) and not (flags[i] & FORM and flags[i] & ARTICLE)]
    forms = sum(len(own[i]) for i in plain if flags[i] & FORM)
    form = FORM if 2 * forms <= sum(len(own[i]) for i in plain) else 0
    out = [i for i in left if not flags[i] & FRAME and not flags[i] & (form if not flags[i] & ARTICLE else FORM)]
    if not article:
        text = [i for i in out if not flags[i] & LINKS]
        doubted = sum(len(own[i]) for i in text if flags[i] & (NAMED | DOUBTED) and is_prose(own[i], flags[i]))
        if 2 * doubted > sum(len(own[i]) for i in text):
            return " ".join(own[i] for i in out if not flags[i] & (NAMED | DOUBTED) or is_prose(own[i], flags[i]))
    kept = [i for i in out if not flags[i] & NAMED and not (flags[i] & DOUBTED and not (flags[i] & ARTICLE and is_prose(own[i], flags[i])))]
    return " ".join(own[i] for i in kept or out if not flags[i] & NAMED)


def is_prose(line: str, flag: int) -> bool:
    return not flag & LINKS and len(line.split(None, PROSE)) >= PROSE


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages to lines, flags, and for those that take part in differencing a 64-bit key."""
    from xxhash import xxh3_64_intdigest

    for batch in batches:
        got = [lines(t.as_py()) for t in batch.column("html")]
        keys = [np.fromiter((xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t, f in zip(*g, strict=True) if compared(f)), np.uint64).astype("<u8").tobytes() for g in got]
        yield pa.record_batch({
            "rid": batch.column("rid"), "id": batch.column("id"), "url": batch.column("url"), "lines": pa.array([g[0] for g in got], pa.list_(pa.string())),
            "flags": pa.array([bytes(g[1]) for g in got], pa.binary()), "prose": pa.array([bytes(is_prose(t, f) for t, f in zip(*g, strict=True)) for g in got], pa.binary()), "keys": pa.array(keys, pa.binary()),
        })


def _keys(packed: bytes | None) -> list[int] | None:
    return None if packed is None else np.frombuffer(packed, "<u8").tolist()


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, deleted): places of the lines that differencing deletes, 32-bit numbers."""
    for batch in batches:
        rids, out = [], []
        for row in batch.to_pylist():
            flags, keys = list(row["flags"]), iter(_keys(row["keys"]))
            own = [next(keys) if compared(f) else None for f in flags]
            gone = shared_lines(own, flags, [bool(p) for p in row["prose"]], _keys(row["nearest"]), _keys(row["second"]))
            if gone:
                rids.append(row["rid"])
                out.append(np.array(sorted(gone), "<u4").tobytes())
        yield pa.record_batch({"rid": pa.array(rids, pa.int64()), "deleted": pa.array(out, pa.binary())})


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = []
        for own, flags, deleted in zip(*(batch.column(c).to_pylist() for c in ("lines", "flags", "deleted")), strict=True):
            text.append(assemble(own, list(flags), set(np.frombuffer(deleted or b"", "<u4").tolist())))
        yield pa.record_batch({"id": batch.column("id"), "url": batch.column("url"), "text": pa.array(text, pa.string())})


def located(url: str = "url") -> list:
    """Columns host (without case or credentials) and path of a URL."""
    path = F.regexp_replace(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", "")
    safe = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", 0)
    return [F.lower(F.regexp_replace(safe, r"^[^:]*://(?:[^@]*@)?", "")).alias("host"), path.alias("path")]


def neighbours(urls: DataFrame) -> DataFrame:
    """(host, path, nearest, second) from (rid, host, path), one row a distinct URL: the first pages (rid) of the URLs next to it
    in (host, path) order; nearest is the one whose path shares more of its start, the one before on a tie. Null where the host
    has no more URLs. Range partitions keep a host of any size in many tasks; the rows at their borders are joined to their
    neighbours' ends, so the borders make no difference."""
    distinct = urls.groupBy("host", "path").agg(F.min("rid").alias("rid"))
    dealt = written(distinct.repartitionByRange(shuffle_partitions(urls.sparkSession), "host", "path").withColumn("slot", F.spark_partition_id()), "urls")
    inside = Window.partitionBy("slot").orderBy("host", "path")
    here = F.struct("rid", "host", "path")
    rows = dealt.select("slot", "rid", "host", "path", F.lag(here).over(inside).alias("before"), F.lead(here).over(inside).alias("after"))
    order = F.struct("host", "path")
    ends = dealt.groupBy("slot").agg(F.min_by(here, order).alias("first"), F.max_by(here, order).alias("last"))
    slots = Window.orderBy("slot")  # one row a partition
    ends = ends.select("slot", F.lag("last").over(slots).alias("earlier"), F.lead("first").over(slots).alias("later"))
    rows = rows.join(ends, "slot").select("rid", "host", "path", F.coalesce("before", "earlier").alias("before"), F.coalesce("after", "later").alias("after"))

    near = rows.select("host", "path", *[F.when(F.col(f"{o}.host") == F.col("host"), F.col(f"{o}.{c}")).alias(f"{o}_{c}") for o in ("before", "after") for c in ("rid", "path")])
    return near.mapInArrow(_nearer, "host string, path string, nearest long, second long")


def _nearer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the neighbours in URL order, first the one whose path shares more of its start."""
    for batch in batches:
        nearest, second = [], []
        for path, before, one, after, two in zip(*(batch.column(c).to_pylist() for c in ("path", "before_rid", "before_path", "after_rid", "after_path")), strict=True):
            s = len(os.path.commonprefix([path, one])) if before is not None else -1
            t = len(os.path.commonprefix([path, two])) if after is not None else -1
            nearest.append(before if s >= t else after)
            second.append(after if s >= t else before)
        yield pa.record_batch({"host": batch.column("host"), "path": batch.column("path"), "nearest": pa.array(nearest, pa.int64()), "second": pa.array(second, pa.int64())})


def parse(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The pages as lines: rid, id, url, lines, flags, prose, keys; written once, as both passes read it."""
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html")).withColumn("rid", F.monotonically_increasing_id())
    fields = T.StructType([T.StructField("rid", T.LongType()), rows.schema["id"], *T.StructType.fromDDL("url string, lines array<string>, flags binary, prose binary, keys binary")])
    return written(rows.mapInArrow(_lines, fields), "lines")


def differences(parsed: DataFrame) -> DataFrame:
    """(rid, deleted) of the pages of which differencing deletes lines. Only keys of lines are shuffled."""
    located_pages = parsed.filter(F.col("url").isNotNull()).select("rid", *located())
    pairs = neighbours(located_pages)
    keys = parsed.select(F.col("rid").alias("r"), "keys")
    # A neighbour is one page of its URL, so each page's keys go along twice at most.
    for side in ("nearest", "second"):
        pairs = pairs.join(keys.withColumnRenamed("keys", f"{side}_keys"), F.col(side) == F.col("r"), "left").drop("r", side).withColumnRenamed(f"{side}_keys", side)
    own = parsed.filter(F.col("url").isNotNull()).select("rid", "flags", "prose", "keys", *located())
    # A URL with many pages is a hot key of the larger side, whose partitions Spark splits.
    return own.join(pairs.filter(F.col("nearest").isNotNull()), ["host", "path"]).select("rid", "flags", "prose", "keys", "nearest", "second").mapInArrow(_decide, "rid long, deleted binary")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """`id_col`, `url_col`, text and n_chars (code points) of every page.

    Character references are decoded, white space inside a line becomes one space, lines are joined by one space in page order.
    Null or empty html gives an empty text. A null url has no neighbours; hosts are compared without case. Pages of the same URL
    have the same neighbours and aren't compared with each other. An empty table gives no rows; null ids stay null; other columns
    are ignored.
    """
    parsed = parse(pages, id_col, url_col, html_col)
    gone = written(differences(parsed), "differences")
    rows = parsed.join(gone, "rid", "left").select("id", "url", "lines", "flags", "deleted")
    out = rows.mapInArrow(_assemble, T.StructType([rows.schema["id"], *T.StructType.fromDDL("url string, text string")]))
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
