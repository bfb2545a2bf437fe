"""Main text of web pages by equivalence classes of tokens.

Tokens are tags with the containers around them and whole text blocks of pages that mark no main
part. Over the pages of one host a token has an occurrence vector: how often it stands on each page.
Tokens with equal vectors form a class. Tags that stand once on nearly every page, in one order, and
text blocks that stand on nearly every page without main part are the root of the host's template;
empty pages do not count. A token that stands once in each instance of its container has the
container's vector and belongs to its class, which nests so in others.

Classes tell roles of tokens apart, and new roles make new classes: a tag takes the place in its
container's class where it stands, and one that stands equally often in each instance of its container
takes its number there. A told container tells what is inside it. Tokens that leave the order of their
class are taken out of it. This goes on by rounds, for the hosts that still change, until nothing new
is told apart.

A container holds the slots inside it, and how much text they hold over all its pages is known from
the same counts. One container of each host is its main one: of those of the root marked as article
or main part the one with the most text, or else, on hosts of ``LEAST_PAGES`` pages or more, the
innermost that holds ``MOST`` of the text. Where the root tells nothing, as its container holds all
text, each other class whose container stands once on its pages (a layout) has its own. A page's text
is what stands in the slots of its main container, less text of the template and less the instances of
repeated classes that hold a fixed text (comments, teasers). Menus, footers, notices and the like
inside it are told by their tags and class names: they may vary from page to page as an article does.
Pages that lack the main container go by their own marks.

A vector is never gathered: its fingerprint is the sum over pages of a hash of (page, count), so
vectors are compared by two sums that Spark adds up with partial aggregation. A host with a third
of all pages costs no more than others, and pages are not grouped by host. Pages are scanned once for
their outline (tags, containers, lengths); rounds read outlines.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, small_batches, tidy

#: Template tokens up to which templates are broadcast; beyond it hosts are joined by a shuffle.
BROADCAST_TOKENS = 100_000
#: Pages that a class of tags not of the root must stand on.
LEAST_PAGES = 5
#: Share of a host's pages (two at least for text) that a token of the root stands on.
SUPPORT = 0.9
#: Share of a host's text that a main container without mark holds.
MOST = 0.6

_SCAN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|title|svg|iframe)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^>]*>|<[!?][^>]*>",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main"
    " menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CONTAINER = _BLOCK - {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "hr"}
_OUTSIDE = set("nav footer aside form button select menu dialog head".split())
_OUTSIDE_WORDS = set(
    "ad ads advert adverts advertisement advertising promo sponsor sponsored cookie cookies consent gdpr notice notices banner comment comments reply replies respond disqus sidebar"
    " menu nav navbar navigation breadcrumb breadcrumbs share sharing social related recommended footer masthead topbar subscribe newsletter popup modal overlay login signup search widget pagination pager toc".split()
)
_MAIN_WORDS = set("article content entry main maincontent post story".split())
_MODIFIER = re.compile(r"(has|with|without|no|not|is|hide|show)[-_]|.*[-_](free|less)$")


@dataclass(frozen=True)
class Place:
    """The containers around a token."""

    key: int
    hard: bool  #: outside by a tag or by a whole class name
    main: bool
    weak: bool = False  #: outside by a part of a class name only
    up: int = 0  #: key of the container around this one
    outer: Place | None = field(default=None, compare=False, repr=False)

    @property
    def outside(self) -> bool:
        return self.hard or self.weak


_TOP = Place(0, False, False)


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) >> 1


def _enter(place: Place, tag: str, attrs: str) -> Place:
    words, names, named = set(), set(), []
    for kind, *values in _NAMES.findall(attrs):
        value = next((v for v in values if v), "").lower()
        named.append(f"{kind.lower()}={value}" if kind.lower() != "id" or not re.search(r"\d", value) else "id")
        words |= set(re.split(r"[^a-z]+", value))
        names |= set(value.split())
    head = tag == "header" and not place.main
    # The page, its main part and whatever is named as that are never outside by a word.
    frame = tag in ("html", "body", "main") or tag == "article" and not place.main
    parts = [{w for w in re.split(r"[^a-z]+", n) if w} for n in names if not _MODIFIER.match(n)]
    whole = not frame and any(p and p <= _OUTSIDE_WORDS for p in parts)
    weak = not frame and not names & _MAIN_WORDS and any(p & _OUTSIDE_WORDS for p in parts)
    hard = (place.hard and tag != "main") or tag in _OUTSIDE or head or whole
    return Place(_hash(f"{place.key}<{tag} {' '.join(sorted(named))}"), hard, place.main or tag in ("article", "main") or bool(words & _MAIN_WORDS) and tag in ("div", "section", "td"), place.weak and tag != "main" or weak, place.key, place)


def scan(page: str) -> Iterator[tuple[str, int, Place, str]]:
    """(kind, token, place, text) of a page in order; kind is "tag", "text" or "block" (a block ends).

    The place of a tag is the one that follows it. Left-open elements close with their container,
    a block ends an open paragraph, and a page cut short ends where it ends.
    """
    stack: list[tuple[str, Place]] = []
    place, at = _TOP, 0
    for m in _SCAN.finditer(page):
        if m.start() > at:
            yield "text", 0, place, page[at : m.start()]
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in _BLOCK:
            yield "block", 0, place, ""
        if not m["end"]:
            if tag in _BLOCK:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in _CONTAINER:
                        break
                    if stack[i][0] == "p":
                        del stack[i:]
                        place = stack[-1][1] if stack else _TOP
                        break
            inner = _enter(place, tag, m["attrs"] or "") if tag in _CONTAINER else place
            yield "tag", _hash(f"{place.key} {tag} {inner.key}"), inner, tag
            if tag not in _VOID and not (m["attrs"] or "").endswith("/"):
                stack.append((tag, inner))
                place = inner
        else:
            open_at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if open_at is not None:
                del stack[open_at:]
                place = stack[-1][1] if stack else _TOP
            yield "tag", _hash(f"{place.key} /{tag}"), place, "/" + tag
    if at < len(page):
        yield "text", 0, place, page[at:]
    yield "block", 0, place, ""


def _clean(text: str) -> str:
    return " ".join(htmllib.unescape(text).split())


def _parts(events: list[tuple[str, int, Place, str]]) -> Iterator[tuple[bool, int, Place, str]]:
    """(is text, token, place, text) of opened tags and of text blocks in page order."""
    parts, where = [], _TOP
    for kind, token, place, text in events:
        if kind == "text":
            if parts and (where.hard, where.weak, where.main) != (place.hard, place.weak, place.main) and (done := _clean("".join(parts))):
                yield True, 0, where, done
                parts = []
            if not parts:
                where = place
            parts.append(text)
        elif kind == "tag":
            if text == "br":
                parts.append(" ")
            if not text.startswith("/"):
                yield False, token, place, text
        else:
            if parts and (done := _clean("".join(parts))):
                yield True, 0, where, done
            parts = []


def blocks_of(events: list[tuple[str, int, Place, str]]) -> Iterator[tuple[Place, str]]:
    """(place, text) of the text blocks among the events of :func:`scan`."""
    return ((place, text) for is_text, _, place, text in _parts(events) if is_text)


# ---- outlines and roles ----------------------------------------------------------------------

_MAIN, _OUT, _TEXT, _TAG = 1, 2, 4, 8


@dataclass
class Outline:
    """Opened tags and text blocks of a page in order. ``up`` is the number of the container around
    each and ``own`` of the one a tag opens, else 0; ``size`` counts the characters of a text."""

    token: list[int]
    up: list[int]
    own: list[int]
    size: list[int]
    flag: list[int]


def outline_of(parts: list[tuple[bool, int, Place, str]]) -> Outline:
    out, number = Outline([], [], [], [], []), {id(_TOP): 0}
    for is_text, token, place, text in parts:
        opens = not is_text and text in _CONTAINER
        around = place.outer if opens else place
        out.up.append(number[id(around)])
        if opens:
            number[id(place)] = len(number)
        out.own.append(number[id(place)] if opens else 0)
        out.token.append(place.key if opens else _hash(f"{place.key} text {text}") if is_text else token)
        out.size.append(len(text) if is_text else 0)
        out.flag.append(_MAIN * place.main + _OUT * place.outside + (_TEXT if is_text else _TAG))
    return out


def _mix(a: int, b: int) -> int:
    x = (a * 0x9E3779B97F4A7C15 + b) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    return (x ^ (x >> 32)) >> 1


@dataclass
class Template:
    """What the classes of a host say about a page."""

    order: dict[int, float] = field(default_factory=dict)  #: tokens of classes, with their mean place
    nth: dict[int, int] = field(default_factory=dict)  #: tokens that stand so often in each container
    lists: set[int] = field(default_factory=set)  #: repeated containers, of which texts are counted too
    fixed: set[int] = field(default_factory=set)  #: texts of the template
    marked: list[int] = field(default_factory=list)  #: main containers by mark, the first on a page counts
    big: list[int] = field(default_factory=list)  #: main containers by their text
    records: dict[int, int] = field(default_factory=dict)  #: repeated containers and their fixed texts, with the class


def roles_of(page: Outline, template: Template) -> tuple[list[int], list[bool]]:
    """The role of each token, and whether it comes before one that it follows in its class.

    A role is the token, told apart by the role of its container, then by its number in it, or else by
    the token of the container's class that it follows.
    """
    told, after, seen = {0: 0}, {}, Counter()
    often = Counter(zip(page.up, page.token)) if template.nth else {}
    roles, late = [], []
    for token, up, own, flag in zip(page.token, page.up, page.own, page.flag):
        role = _mix(token, told[up]) if told[up] else token
        if own and role in template.nth and often[up, token] == template.nth[role]:
            seen[up, token] += 1
            role = _mix(role, seen[up, token])
        elif role not in template.order and flag & _TAG and up in after:
            role = _mix(role, after[up])
        late.append(role in template.order and up in after and (template.order[role], role) < (template.order[after[up]], after[up]))
        if role in template.order:
            after[up] = role
        if own:
            told[own] = role if role != token else 0
        roles.append(role)
    return roles, late


# ---- templates -------------------------------------------------------------------------------

#: Stand for the pages of a host that are not empty, and those of them without main part.
_PAGES, _PLAIN = -1, -2
_OUTLINES = "host string, page string, token array<long>, up array<int>, own array<int>, size array<int>, flag array<tinyint>"
_TOKENS = "host string, token long, each int, around long, kind int, own boolean, s1 long, s2 long, pages long, total long, late long, place double, chars long, whole long"


def _masses(events: list[tuple[str, int, Place, str]]) -> dict[int, int]:
    """Characters of text in each container and all inside it, without what is outside by its name."""
    mass, up = {0: 0}, {0: 0}
    for kind, _, place, _ in events:
        if place.key not in mass:
            mass[place.key], up[place.key] = 0, place.up
    for place, text in blocks_of(events):
        if not place.outside:
            mass[place.key] += len(text)
    for key in reversed(list(mass)):  # a container comes after the one around it
        if key:
            mass[up[key]] += mass[key]
    return mass


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<tinyint>": pa.list_(pa.int8())}
    names, types = zip(*(c.split() for c in schema.split(", ")))
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types)], list(names))


def _outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Outlines of pages that are not empty."""
    for batch in batches:
        rows = []
        for host, page_id, page in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "html"))):
            events = list(scan(page))
            if events[:-1] and page.strip():
                o = outline_of(list(_parts(events)))
                rows.append((host, page_id, o.token, o.up, o.own, o.size, o.flag))
        yield _batch(rows, _OUTLINES)


def _count(page: Outline, template: Template) -> Iterator[tuple]:
    """(role, count, count in each container or 0, container's role, kind, opens, late, place, chars, whole)."""
    roles, late = roles_of(page, template)
    role_of, above, held = {0: 0}, {0: 0}, Counter()
    for role, up, own, size, flag in zip(roles, page.up, page.own, page.size, page.flag):
        if own:
            role_of[own], above[own] = role, up
        if not flag & _OUT:
            held[up] += size
    for e in range(len(role_of) - 1, 0, -1):  # a container comes after the one around it
        held[above[e]] += held[e]
    plain = not any(f & _MAIN for f in page.flag)
    found: dict[int, list] = {}
    inside: dict[int, Counter] = {}
    n = sum(bool(f & _TAG) for f in page.flag)
    at = 0
    for role, up, own, flag, behind in zip(roles, page.up, page.own, page.flag, late):
        at += bool(flag & _TAG)
        if flag & _TEXT and not plain and role_of[up] not in template.lists:
            continue
        f = found.setdefault(role, [0, role_of[up], flag, bool(own), 0, at / max(1, n), 0])
        f[0] += 1
        f[4] |= behind
        f[6] += held[own] if own else 0
        inside.setdefault(role, Counter())[up] += 1
    for role, (count, around, flag, own, behind, place, chars) in found.items():
        each = set(inside[role].values())
        yield role, count, each.pop() if len(each) == 1 else 0, around, flag, own, int(behind), place, chars, held[0]
    yield _PAGES, 1, 0, 0, 0, False, 0, 0.0, 0, held[0]
    if plain:
        yield _PLAIN, 1, 0, 0, 0, False, 0, 0.0, 0, held[0]


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each (host, role, count in each container): the vector's fingerprint and sums over pages."""
    for batch in batches:
        sums: dict[tuple[str, int, int], list] = {}
        templates = _templates(batch, "host")
        columns = (batch.column(c).to_pylist() for c in ("host", "page", "token", "up", "own", "size", "flag"))
        for host, page_id, *lists in zip(*columns):
            for role, count, each, around, kind, own, *more in _count(Outline(*lists), templates[host]):
                h = xxhash.xxh64_intdigest(f"{page_id} {count}")
                s = sums.setdefault((host, role, each), [around, kind, own, 0, 0, 0, 0, 0, 0.0, 0, 0])
                for i, v in enumerate((h & 0x3FFFFFFF, h >> 34, 1, count, *more), 3):
                    s[i] += v
        yield _batch([(*k, *s) for k, s in sums.items()], _TOKENS)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def _narrow(pages: DataFrame) -> DataFrame:
    identity = F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce(F.col("url"), F.lit("")))
    return pages.select(host_of(F.col("url")).alias("host"), identity.alias("page"), F.coalesce(F.col("html"), F.lit("")).alias("html"))


#: A line of a host's template: a token, what it is used for, and the number that goes with it.
_USES = ("order", "nth", "lists", "fixed", "marked", "big", "records")
_LINES = "__gw_token", "__gw_use", "__gw_value"


def _templates(batch: pa.RecordBatch, host: str) -> dict[str, Template]:
    """The template of each host in a batch; lines come as arrays beside the rows."""
    out: dict[str, Template] = {}
    for i, name in enumerate(batch.column(host).to_pylist()):
        if name in out:
            continue
        t = out[name] = Template()
        if _LINES[0] not in batch.schema.names:
            continue
        lines = list(zip(*(batch.column(c)[i].as_py() or () for c in _LINES)))
        for token, use, value in sorted(lines, key=lambda line: (line[1], line[2])):
            kept = getattr(t, _USES[use])
            if isinstance(kept, list):
                kept.append(token)
            elif isinstance(kept, set):
                kept.add(token)
            else:
                kept[token] = value if use == 0 else int(value)
    return out


def _with_lines(rows: DataFrame, host: str, lines: DataFrame) -> DataFrame:
    """``rows`` with the template lines (host, token, use, value) of their host as arrays."""
    lists = lines.groupBy(F.col("host").alias("__gw_host")).agg(F.collect_list(F.struct("token", "use", "value")).alias("l"))
    lists = lists.select("__gw_host", *(F.col(f"l.{c}").alias(n) for c, n in zip(("token", "use", "value"), _LINES)))
    if lines.count() <= BROADCAST_TOKENS:
        lists = F.broadcast(lists)
    return rows.join(lists, F.col(host) == F.col("__gw_host"), "left").drop("__gw_host")


def _vectors(outlines: DataFrame) -> DataFrame:
    """host, token, class, around, kind, flags and sums of every token, with the pages of its host."""
    sums = outlines.mapInArrow(tidy(_occurrences), _TOKENS).groupBy("host", "token", "each").agg(
        F.min("around").alias("around"), F.min("kind").alias("kind"), F.bool_or("own").alias("own"), F.max(F.col("kind").bitwiseAND(_MAIN)).alias("main"), F.max(F.col("kind").bitwiseAND(_OUT)).alias("out"),
        *(F.sum(c).alias(c) for c in ("s1", "s2", "pages", "total", "late", "place", "chars", "whole")),
    )
    found = sums.groupBy("host", "token").agg(
        F.max_by("each", F.struct("pages", "each")).alias("each"), F.max("pages").alias("each_pages"), F.min("around").alias("around"), (F.min("kind").bitwiseAND(_TEXT) > 0).alias("text"), F.bool_or("own").alias("own"),
        (F.max("main") > 0).alias("main"), (F.max("out") > 0).alias("outside"), F.struct(F.sum("s1").alias("s1"), F.sum("s2").alias("s2")).alias("class"),
        *(F.sum(c).alias(c) for c in ("pages", "total", "late", "chars", "whole")), (F.sum("place") / F.sum("pages")).alias("place"),
    )
    found = materialize(found, "tokens")
    counted = found.filter(F.col("token") < 0).groupBy("host")
    hosts = counted.agg(*(F.max(F.when(F.col("token") == t, F.col("pages"))).alias(n) for t, n in ((_PAGES, "host_pages"), (_PLAIN, "plain_pages"))))
    fixed = (F.col("pages") >= 2) & (F.col("pages") >= F.col("plain_pages") * SUPPORT)
    once = (F.col("total") == F.col("pages")) & (F.col("pages") >= F.col("host_pages") * SUPPORT)
    known = found.filter(F.col("token") >= 0).join(hosts, "host").withColumn("root", F.coalesce(F.when(F.col("text"), fixed).otherwise(once), F.lit(False)))
    return known.filter(F.col("root") | (F.col("pages") >= LEAST_PAGES) | (F.col("each") > 1) & (F.col("pages") >= 2)).drop("plain_pages")


def _told(known: DataFrame) -> DataFrame:
    """host, token, use, value: what the classes of a round tell apart; use -1 takes a token out of its class."""
    many = known.filter("host_pages >= 2")
    opened = many.filter("own").select("host", F.col("token").alias("around"), F.col("class").alias("outer"))
    once = (F.col("each") == 1) & (F.col("each_pages") == F.col("pages"))
    # A token of its container's vector that stands once in each instance is of the container's class.
    nested = ~F.col("root") & once & (F.col("class") == F.col("outer"))
    even = F.col("own") & (F.col("each") > 1) & (F.col("each_pages") >= F.col("pages") * SUPPORT) & (F.col("pages") >= 2)
    repeated = F.col("own") & ~F.col("outside") & (F.col("total") > F.col("pages")) & (F.col("pages") >= LEAST_PAGES)
    uses = [
        (F.col("root") & (F.col("total") == F.col("pages")) | nested, 0, F.col("place")),
        (even, 1, F.col("each")),
        (repeated, 2, F.lit(0)),
        (F.col("late") > F.col("pages") * (1 - SUPPORT), -1, F.lit(0)),
    ]
    lines = F.array(*(F.when(on, F.struct(F.lit(use).alias("use"), value.cast("double").alias("value"))) for on, use, value in uses))
    return many.join(opened, ["host", "around"], "left").select("host", "token", F.explode(F.array_compact(lines)).alias("line")).select("host", "token", "line.*")


def _in_force(told: DataFrame) -> DataFrame:
    return told.filter("use >= 0").join(told.filter("use = -1").select("host", "token", F.lit(0).alias("use")), ["host", "token", "use"], "left_anti").select("host", "token", "use", "value")


def _deduce(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tokens of each host's classes in its last round, and all that rounds told apart."""
    outlines = materialize(_narrow(pages).mapInArrow(tidy(_outlines), _OUTLINES), "outlines")
    known = materialize(_vectors(outlines), "classes")
    told = materialize(_told(known), "told")
    fresh, rounds = told, [known]
    while not fresh.isEmpty():
        hosts = fresh.select("host").distinct()
        again = outlines.join(F.broadcast(hosts), "host", "left_semi")
        now = materialize(_vectors(_with_lines(again, "host", _in_force(told.join(hosts, "host", "left_semi")))), "classes")
        fresh = materialize(_told(now).join(told.select("host", "token", "use"), ["host", "token", "use"], "left_anti"), "told")
        rounds = [*(r.join(F.broadcast(hosts), "host", "left_anti") for r in rounds), now]
        told = told.union(fresh)
    known = rounds[0]
    for r in rounds[1:]:
        known = known.unionByName(r)
    final = materialize(known, "templates"), materialize(_in_force(told), "told")
    discard(outlines)
    return final


def deduce_templates(pages: DataFrame) -> DataFrame:
    """host, class, token, around, text, own, main, outside, place, root and sums: the tokens of each host's classes.

    ``class`` is the fingerprint of the shared vector; ``root`` marks tags that stand once on each of
    nearly all pages of the host, and text that stands, how often ever, on nearly all without main part. ``around`` is
    the role of the container, ``own`` marks tokens that open one, ``place`` is the mean order of the token on its pages. Tokens
    on few pages are left out unless they are root or stand equally often in each container.
    """
    return _deduce(pages)[0]


def main_containers(templates: DataFrame) -> DataFrame:
    """host, chosen, marked, rank: the keys of the main containers of each host that has some, the root's
    and, where that is none or holds all text, those of other classes of two tokens or more."""
    group = F.when(F.col("root"), F.struct(F.lit(0).cast("long").alias("s1"), F.lit(0).cast("long").alias("s2"))).otherwise(F.col("class"))
    grouped = templates.filter((F.col("total") == F.col("pages")) & (F.col("root") | ~F.col("text"))).withColumn("group", group)
    sizes = grouped.groupBy("host", "group").agg(F.count("*").alias("n"))
    held = grouped.filter(F.col("own") & (F.col("chars") > 0) & ~F.col("outside") & (F.col("root") | (F.col("pages") >= LEAST_PAGES))).join(sizes, ["host", "group"]).filter("root or n > 1")
    big = (F.col("chars") >= F.col("whole") * MOST) & (F.col("host_pages") >= LEAST_PAGES)
    kept = F.struct("token", "place", (F.col("chars") >= F.col("whole")).alias("all"))
    by_mark = F.max_by(F.when(F.col("main"), kept), F.when(F.col("main"), F.struct(F.col("chars"), -F.col("place"))))
    by_text = F.max_by(F.when(big, kept), F.when(big, F.struct("place")))
    best = held.groupBy("host", "group").agg(F.bool_or("root").alias("root"), by_mark.alias("m"), by_text.alias("b")).withColumn("c", F.coalesce("m", "b")).filter("c is not null")
    clear = best.filter(F.col("root") & (F.col("m").isNotNull() | ~F.col("c.all"))).select("host")
    layouts = best.filter(~F.col("root")).join(clear, "host", "left_anti")
    # Of nested layouts that hold a page's text the innermost comes first, the root last.
    rank = F.when(F.col("root"), F.when(F.col("m").isNotNull(), -1.0).otherwise(2.0)).otherwise(1 - F.col("c.place"))
    return best.filter("root").unionByName(layouts).select("host", F.col("c.token").alias("chosen"), F.col("m").isNotNull().alias("marked"), rank.alias("rank"))


def nest_classes(templates: DataFrame) -> DataFrame:
    """host, class, size, parent: valid classes (two tokens or more, or root) with the class their
    containers belong to; null where the containers are of several classes or of none."""
    tags = templates.filter(~F.col("text"))
    opens = tags.filter("own").select("host", F.col("token").alias("inner"), F.col("class").alias("outer"))
    sized = tags.groupBy("host", "class").agg(F.count("*").alias("size"), F.bool_or("root").alias("root"), F.collect_set("around").alias("around"))
    pairs = sized.select("host", "class", "size", "root", F.explode("around").alias("inner")).join(opens, ["host", "inner"], "left")
    parent = F.when(F.countDistinct(F.when(F.col("outer") != F.col("class"), F.col("outer"))) == 1, F.min(F.when(F.col("outer") != F.col("class"), F.col("outer"))))
    return pairs.groupBy("host", "class").agg(F.max("size").alias("size"), F.bool_or("root").alias("root"), parent.alias("parent")).filter(F.col("root") | (F.col("size") > 1))


def record_classes(templates: DataFrame) -> DataFrame:
    """host, token, record: containers and texts of repeated classes that hold a fixed text in each
    instance and together less of the pages' text than a main container leaves."""
    repeated = templates.filter((F.col("total") > F.col("pages")) & (F.col("pages") >= LEAST_PAGES) & (F.col("text") | F.col("own")))
    small = F.max(F.when(F.col("own"), F.col("chars") / F.greatest(F.lit(1), F.col("whole")))) < 1 - MOST
    classes = repeated.groupBy("host", "class").agg(F.bool_or("text").alias("labelled"), small.alias("small")).filter("labelled and small")
    # Below 2^53, as the number travels as a double.
    record = F.shiftrightunsigned(F.xxhash64("class.s1", "class.s2"), 11)
    return repeated.join(classes, ["host", "class"]).select("host", "token", record.alias("record"))


def extract_page(page: str, template: Template | None = None) -> str:
    """Main text of a page under the template of its host."""
    template = template or Template()
    parts = list(_parts(list(scan(page))))
    shape = outline_of(parts)
    roles, _ = roles_of(shape, template)
    role, above = {0: 0}, {0: 0}
    for r, up, own in zip(roles, shape.up, shape.own):
        if own:
            role[own], above[own] = r, up
    present = set(role.values())

    def within(roots: set[int]) -> list[bool]:
        inside = {0: 0 in roots}
        for e in above:  # a container comes after the one around it
            inside[e] = e in roots or inside[above[e]]
        return [inside[up] for up in shape.up]

    records = set()
    for r, up, own in zip(roles, shape.up, shape.own):
        if not own and r in template.records:
            top = None
            while up and template.records.get(role[up]) == template.records[r]:
                top, up = up, above[up]
            if top:
                records.add(top)
    gone = within(records)
    chosen = next((c for c in template.marked if c in present), None)
    has_main = any(place.main for _, _, place, _ in parts)
    if chosen is None and not has_main:
        chosen = next((c for c in template.big if c in present), None)
    own = within({e for e, r in role.items() if e and r == chosen})
    blocks = [(place, text, r, i, g) for (is_text, _, place, text), r, i, g in zip(parts, roles, own, gone) if is_text and not place.hard]
    if inner := [b for b in blocks if b[3]]:
        blocks = inner
    elif has_main:
        blocks = [b for b in blocks if b[0].main]
    # A page of records alone is a list by nature.
    blocks = [b for b in blocks if not b[4]] or blocks
    # A container of a partly listed name that holds all of the main part is no menu.
    blocks = [b for b in blocks if not b[0].weak] or blocks
    # A page of which nothing else is left is a copy of others, not their template.
    blocks = [b for b in blocks if has_main or b[2] not in template.fixed] or blocks
    return "\n\n".join(b[1] for b in blocks)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        templates = _templates(batch, "__gw_of")
        texts = [extract_page(page or "", templates[host]) for page, host in zip(batch.column("__gw_html").to_pylist(), batch.column("__gw_of").to_pylist())]
        keep = [n for n in batch.schema.names if not n.startswith("__gw_")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    A null page is empty and has an empty text. A page without url belongs to the host of the
    empty name. Pages of a host with one page have their own tags as template. Hosts of less than
    ``LEAST_PAGES`` pages without a marked main part have no main container: what is not told apart by
    tags, names or repeated text stays. Repeated pages are extracted one by one.
    """
    small_batches(pages.sparkSession)
    known, told = _deduce(pages)
    line = lambda use, value: ("token", F.lit(use).alias("use"), F.lit(value).cast("double").alias("value"))
    fixed = known.filter("root and text").select("host", *line(3, 0))
    mains = main_containers(known).select("host", F.col("chosen").alias("token"), F.when(F.col("marked"), 4).otherwise(5).alias("use"), F.col("rank").alias("value"))
    records = record_classes(known).select("host", *line(6, F.col("record")))
    # Of what was told apart, pages need what leads to these tokens; lists have done their part.
    lines = materialize(told.filter("use < 2").union(fixed).union(mains).union(records), "mains")
    narrow = pages.select("page_id", "url", F.col("html").alias("__gw_html"), host_of(F.col("url")).alias("__gw_of"))
    joined = _with_lines(narrow, "__gw_of", lines)
    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema.fields}
    return joined.mapInArrow(tidy(_extract), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
