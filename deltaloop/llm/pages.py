"""Main text of web pages by template deduction.

Method: a page is a sequence of tokens: its tags, each with the path of elements above it, and the
texts between them. Pages without a text don't count, and copies of one text on a host count as one
page. Over the pages of one host,
tokens are grouped by their occurrence vectors (how often they occur in each page), which are
compared by sums of keyed hashes, so that a host of any size is aggregated before the shuffle and
never collected. Tokens with one vector are a class, if a share SHARE of the pages holds them. Two
more passes over the sequences check a class: a token stays that keeps its class's order, and a class
stays that doesn't overlap a better supported one, so each lies in one gap of the other. What is left
is the host's template, and what stands behind one of its tokens is a slot. A text that is a token of
the template is no main text; nor is one inside an element, or under a name, that serves navigation,
notices, adverts, forms, comments and the like.

Article and main elements are a hint to the slots: a slot is main text if its text on the host's
pages is inside them, other text if it is outside on pages that have them, and judged by each page's
own elements if it is a mixture. A slot that is on no page with such an element is main text unless
it is mostly links.

Defined cases: a null or empty html gives an empty text; so does a page without text; repeated rows
each give a row; pages of hosts with fewer than three pages have no template and are judged by their
elements alone, and by blocks that are mostly links if there is no article; an empty table gives an
empty result; extra columns are ignored; urls may be null.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloop.llm.common import map_batches, only, small, utf8, written

#: Fewest pages of a host that make a template, and the share of them that holds a token of it.
PAGES, SHARE = 3, 0.5
#: More than this share of links makes a slot navigation; up to this share of a slot's text may be on the other side of an article's border.
LINKS, MIXED = 0.8, 0.1
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)
    |<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^<>"']|"[^"]*"|'[^']*')*)(?:>|$)""",
    re.S | re.X,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"\s(?:hidden|aria-hidden\s*=\s*[\"']?true)(?=[\s/=>]|$)", re.I)
_RAW = {"script", "style", "noscript", "template", "textarea", "xmp", "iframe", "noembed", "noframes", "title"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BESIDE = {"nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog", "head", "svg", "canvas", "object", "audio", "video", "fieldset", "datalist"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rb", "rp",
    "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img",
}
#: Words of class, id and role that name parts beside the main text.
_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent",
    "contentinfo", "cookie", "cookies", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
    "notices", "pager", "pagination", "popup", "promo", "promotion", "recommended", "related", "replies", "search", "share", "sharing", "sidebar", "signup",
    "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget", "widgets", "discussion", "respond", "reply",
}
_PARAGRAPH_ENDS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}


def host(url: str | None) -> str:
    found = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", url or "")
    return found[1].rsplit("@", 1)[-1].split(":")[0].lower() if found else ""


def _named_beside(attributes: str) -> bool:
    if not attributes or "=" not in attributes:
        return bool(_HIDDEN.search(attributes))
    for m in _ATTRIBUTE.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        if any(w in _NAMES for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower())):
            return True
    return bool(_HIDDEN.search(attributes))


class Slot:
    """Text behind a tag: the tag's token, whether it stands beside the main text, inside an article, inside a link, and all tags since the text before."""

    __slots__ = ("token", "beside", "inside", "link", "text", "gap", "tags")

    def __init__(self, token: str, beside: bool, inside: int, link: bool, text: str, gap: bool, tags: list[str]) -> None:
        self.token, self.beside, self.inside, self.link, self.text, self.gap, self.tags = token, beside, inside, link, text, gap, tags


def slots(page: str) -> list[Slot]:
    """All texts in page order, and an empty one for tags behind the last; gap: a block ends before it."""
    out: list[Slot] = []
    tags: list[str] = []
    stack: list[tuple[str, bool, int, bool]] = [("", False, 0, False)]  # name, beside, inside, link
    path = ""
    at, token, gap = 0, "", False
    n = len(page)
    position = 0
    while position <= n:
        m = _TOKEN.search(page, position)
        end = m.start() if m else n
        if end > at:
            _, beside, inside, link = stack[-1]
            out.append(Slot(token, beside, inside, link, page[at:end], gap, tags))
            gap, tags = False, []
        if not m:
            break
        at = position = max(m.end(), position + 1)
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name not in _INLINE:
            gap = True
        if m["close"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        else:
            if name in _PARAGRAPH_ENDS and len(stack) > 1:
                for k in range(len(stack) - 1, 0, -1):  # an open paragraph ends here
                    if stack[k][0] == "p":
                        del stack[k:]
                        break
                    if stack[k][0] not in _INLINE:
                        break
            elif name == "li" and stack[-1][0] == "li":
                del stack[-1]
            attributes = m["attributes"] or ""
            closed = name in _VOID or attributes.endswith("/") and name in ("svg", "path")
            if name in _RAW:
                close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, m.end())
                at = position = close.end() if close else n + 1
            elif not closed:
                _, beside, inside, link = stack[-1]
                main = 2 if name == "article" else 1 if name == "main" or "role" in attributes and re.search(r"role\s*=\s*[\"']?(?:main|article)\b", attributes, re.I) else 0
                aside = name in _BESIDE or _named_beside(attributes)
                stack.append((name, beside or aside and name not in ("html", "body", "article", "main"), max(inside, main), link or name == "a"))
        path = "/".join(x[0] for x in stack[-6:])
        token = f"{path}{'/' if m['close'] else '.'}{name}"
        tags.append(token)
    if tags:
        out.append(Slot(token, *stack[-1][1:], "", gap, tags))
    return out


def joined(parts: list[Slot]) -> str:
    """Blocks with white space turned into one space, trimmed, joined by one space."""
    text = "".join((" " if s.gap else "") + s.text for s in parts)
    return " ".join(entities.unescape(text).split())


def _hash(token: str) -> int:
    return xxhash.xxh64_intdigest(token) >> 1


def _text_token(s: Slot) -> int:
    return _hash(f"{s.token}\0{' '.join(s.text.split())}")


def sequence(every: list[Slot]) -> tuple[list[int], list[int], bool]:
    """Hashes of a page's tokens in order: its tags and the texts not beside the main text.

    With each text its length and whether it is linked and inside the article, with each tag -1; at last whether there is an article.
    """
    known: dict[str, int] = {}
    token: list[int] = []
    info: list[int] = []
    best = max((s.inside for s in every if not s.beside and s.text.strip()), default=0)
    for s in every:
        for t in s.tags:
            if t not in known:
                known[t] = _hash(t)
            token.append(known[t])
            info.append(-1)
        if not s.beside and s.text.strip():
            token.append(_text_token(s))
            info.append(len(s.text.strip()) << 2 | s.link << 1 | (best > 0 and s.inside == best))
    return token, info, best > 0


def arranged(known: list[dict]) -> tuple[dict[int, tuple[int, int]], list[int]]:
    """Class and place of every token of a host, and the sizes of the classes, the best supported first.

    A class holds the tokens of one occurrence vector, in the order of their mean rank.
    """
    members: dict[tuple, list[dict]] = {}
    for x in known:
        members.setdefault((-x["n"], x["v1"], x["v2"]), []).append(x)
    order = sorted(members, key=lambda v: (v[0], -len(members[v]), v))
    place = {}
    for c, v in enumerate(order):
        for k, x in enumerate(sorted(members[v], key=lambda x: (x["rank"] / x["n"], x["token"]))):
            place[x["token"]] = (c, k)
    return place, [len(members[v]) for v in order]


def _rising(xs: list[int]) -> set[int]:
    """Indexes of a longest rising subsequence."""
    if all(a < b for a, b in zip(xs, xs[1:])):
        return set(range(len(xs)))
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(xs)
    for i, x in enumerate(xs):
        k = bisect_left(tails, x)
        before[i] = ends[k - 1] if k else -1
        tails[k : k + 1], ends[k : k + 1] = [x], [i]
    out, i = set(), ends[-1] if ends else -1
    while i >= 0:
        out.add(i)
        i = before[i]
    return out


def checked(token: list[int], place: dict[int, tuple[int, int]], sizes: list[int]) -> tuple[list[int], list[int]]:
    """Tokens of one page that keep their class's order, and classes that overlap no better supported one."""
    at: dict[int, list[int]] = {}
    for i, t in enumerate(token):
        if t in place:
            at.setdefault(place[t][0], []).append(i)
    bad: set[int] = set()
    runs: dict[int, list[list[int]]] = {}  # class: its passes, each the positions of tokens in order
    for c, here in at.items():
        for k in range(0, len(here), sizes[c]):
            part = here[k : k + sizes[c]]
            fine = _rising([place[token[i]][1] for i in part])
            bad.update(token[i] for j, i in enumerate(part) if j not in fine)
            runs.setdefault(c, []).append([i for j, i in enumerate(part) if j in fine])
    good = list({token[i] for here in at.values() for i in here} - bad)
    nested = []
    taken: list[list[list[int]]] = []
    for c in sorted(runs):
        if all(_nests(run, other) for run in runs[c] for passes in taken for other in passes):
            nested.append(c)
            taken.append(runs[c])
    return good, nested


def _nests(one: list[int], other: list[int]) -> bool:
    """Whether two runs of positions are apart, or one lies in one gap of the other."""
    if not one or not other or one[-1] < other[0] or other[-1] < one[0]:
        return True
    return bisect_left(other, one[0]) == bisect_left(other, one[-1]) or bisect_left(one, other[0]) == bisect_left(one, other[-1])


def _by_host(pages: DataFrame, made: DataFrame) -> DataFrame:
    """Pages with what was made for their host; most hosts are broadcast, so that one of many pages is no large task."""
    return pages.join(small(made), "host", "left")


def _per_host(batch: pa.RecordBatch, column: str, make):  # noqa: ANN001, ANN202
    """make(value of the column) of each row, once a host."""
    made: dict[str, object] = {}
    for k, name in enumerate(batch.column("host").to_pylist()):
        if name not in made:
            made[name] = make(batch.column(column)[k].as_py() or [])
        yield name, made[name]


def _counted(rows: Counter, name: str) -> pa.RecordBatch:
    keys = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([rows[k] for k in keys], pa.int64())], names=["host", name, "n"])


def templates(pages: DataFrame) -> DataFrame:
    """(host, fixed, slots): the tokens of the host's template, and its slots (by the token before) with 1 for main text, 0 for other text, 2 for a mixture."""

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(5)]
        for url, page in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
            token, info, article = sequence(slots(page))
            if not any(x >= 0 for x in info):
                continue  # no text, no page of the template
            same = xxhash.xxh64_intdigest(repr([t for t, x in zip(token, info) if x >= 0 and (x & 1 or not article)])) >> 1  # copies of a text are one page
            for column, value in zip(out, (host(url), same, token, info, article)):
                column.append(value)
        kinds = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["host", "same", "token", "info", "article"])

    some = only(pages, "url", "html")
    read_ = map_batches(some, read, "host string, same bigint, token array<bigint>, info array<bigint>, article boolean")
    parsed = written(read_.dropDuplicates(["host", "same"]), "sequences")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: dict[tuple[str, int], list[int]] = {}
        for name, same, token in zip(*(batch.column(k).to_pylist() for k in range(3))):
            rows.setdefault((name, -1), [0] * 4)[0] += 1
            first: dict[int, int] = {}
            times = Counter(token)
            for k, t in enumerate(token):
                first.setdefault(t, k)
            by_times: dict[int, int] = {}
            for t, c in times.items():
                if c not in by_times:
                    by_times[c] = xxhash.xxh64_intdigest(f"{same}|{c}")
                v = by_times[c]
                row = rows.setdefault((name, t), [0] * 4)
                row[0] += 1
                row[1] += v >> 32
                row[2] += v & 0xFFFFFFFF
                row[3] += first[t]
        columns = list(zip(*((*key, *row) for key, row in rows.items()))) if rows else [()] * 6
        kinds = [pa.string(), *[pa.int64()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["host", "token", "n", "v1", "v2", "rank"])

    sums = [F.sum(c).alias(c) for c in ("n", "v1", "v2", "rank")]
    seen = written(map_batches(parsed, count, "host string, token bigint, n bigint, v1 bigint, v2 bigint, rank bigint").groupBy("host", "token").agg(*sums).where(F.col("n") >= PAGES), "tokens")
    size = seen.where("token = -1").select("host", F.col("n").alias("pages"))
    frequent = seen.where("token >= 0").join(size, "host").where(F.col("n") >= F.col("pages") * SHARE)
    known = written(frequent.groupBy("host").agg(F.collect_list(F.struct("token", "n", "v1", "v2", "rank")).alias("known")), "classes")

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: Counter = Counter()
        for (name, (place, sizes)), token in zip(_per_host(batch, "known", arranged), batch.column("token").to_pylist()):
            good, nested = checked(token, place, sizes)
            rows.update((name, t) for t in good)
            rows.update((name, -1 - c) for c in nested)
        return _counted(rows, "item")

    fine = map_batches(_by_host(parsed.select("host", "token"), known).where("known IS NOT NULL"), check, "host string, item bigint, n bigint")
    fine = fine.groupBy("host", "item").agg(F.sum("n").alias("n")).groupBy("host").agg(F.collect_list(F.struct("item", "n")).alias("fine"))

    def choose(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for own, ok in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            place, _ = arranged(own)
            held = {x["item"]: x["n"] for x in ok}
            out.append([x["token"] for x in own if min(held.get(x["token"], 0), held.get(-1 - place[x["token"]][0], 0)) >= SHARE * x["n"]])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=["host", "fixed"])

    fixed = written(map_batches(known.join(fine, "host").select("host", "known", "fine"), choose, "host string, fixed array<bigint>"), "template")

    def weigh(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: dict[tuple[str, int], list[int]] = {}
        columns = (batch.column(c).to_pylist() for c in ("token", "info", "article"))
        for (name, own), token, info, article in zip(_per_host(batch, "fixed", frozenset), *columns):
            slot = -1
            for t, x in zip(token, info):
                if t in own:
                    slot = t
                elif x >= 0:
                    row = rows.setdefault((name, slot), [0] * 4)
                    row[0 if x & 1 else 1 if article else 2] += x >> 2
                    row[3] += (x >> 2) * (x >> 1 & 1)
        columns = list(zip(*((*key, *row) for key, row in rows.items()))) if rows else [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [pa.string(), *[pa.int64()] * 5])], names=["host", "slot", "inside", "outside", "free", "links"])

    weight = map_batches(_by_host(parsed.select("host", "token", "info", "article"), fixed).where("fixed IS NOT NULL"), weigh, "host string, slot bigint, inside bigint, outside bigint, free bigint, links bigint")
    weight = weight.groupBy("host", "slot").agg(*[F.sum(c).alias(c) for c in ("inside", "outside", "free", "links")])
    hinted = F.col("inside") + F.col("outside")
    verdict = (
        F.when(hinted == 0, (F.col("links") <= LINKS * F.col("free")).cast("int"))
        .when(F.col("outside") <= MIXED * hinted, 1)
        .when(F.col("inside") <= MIXED * hinted, 0)
        .otherwise(2)
    )
    judged = weight.groupBy("host").agg(F.collect_list(F.struct("slot", verdict.alias("verdict"))).alias("slots"))
    return fixed.join(judged, "host", "left").select("host", "fixed", "slots")


def main_text(page: str, fixed: frozenset[int] = frozenset(), verdicts: dict[int, int] | None = None) -> str:
    every = slots(page)
    best = max((s.inside for s in every if not s.beside and s.text.strip()), default=0)
    linked = _linked_blocks(every)
    slot, wanted = -1, set()
    for k, s in enumerate(every):
        for t in s.tags if fixed else ():
            if (h := _hash(t)) in fixed:
                slot = h
        if s.beside:
            continue
        if fixed and s.text.strip() and (h := _text_token(s)) in fixed:
            slot = h
            continue
        verdict = (verdicts or {}).get(slot, 2)
        if verdict == 1 or verdict == 2 and (s.inside == best if best else k not in linked):
            wanted.add(k)
    return joined(_kept(every, wanted))


def _linked_blocks(every: list[Slot]) -> set[int]:
    """Indexes of the texts in blocks that are mostly links."""
    out: set[int] = set()
    start = 0
    for k in range(1, len(every) + 1):
        if k == len(every) or every[k].gap:
            block = [s for s in every[start:k] if not s.beside]
            if sum(len(s.text.strip()) for s in block if s.link) > LINKS * sum(len(s.text.strip()) for s in block):
                out.update(range(start, k))
            start = k
    return out


def _kept(parts: list[Slot], wanted: set[int]) -> list[Slot]:
    """The wanted slots; a gap before a dropped one stays."""
    out, gap = [], False
    for k, s in enumerate(parts):
        gap |= s.gap
        if k in wanted:
            s.gap = gap
            out.append(s)
            gap = False
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    made = written(templates(pages), "templates")
    slim = only(pages, "page_id", "url", "html")
    hosts = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(F.regexp_extract("url", r"^\s*(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", 1), F.lit("")), r"^.*@", ""), r":.*$", ""))
    both = _by_host(slim.withColumn("host", hosts), made).select("page_id", "url", "html", "host", "fixed", "slots")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fixed = _per_host(batch, "fixed", frozenset)
        verdicts = _per_host(batch, "slots", lambda own: {x["slot"]: x["verdict"] for x in own})
        texts = [main_text(page, f, v) for page, (_, f), (_, v) in zip(utf8(batch.column(2)), fixed, verdicts)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    return map_batches(both, run, f"page_id {kind}, url string, text string, n_chars bigint")
