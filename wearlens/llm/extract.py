"""Main text of web pages by wrappers: union-free regular expressions inferred from the token streams of a host.

A page becomes a stream of block tags and text slots; inline markup belongs to the slot it stands in. Adjacent repetitions
are folded into repeated groups. Equal streams of a host are counted together. Different ones are aligned: what only one
of two streams has becomes an optional group, what repeats is a repeated group, differing texts are one text slot. There are
no alternatives ("union-free"). Streams of a host are aligned in groups of at most FAN, and the results again, so that no
task holds all streams of a large host.

Every page is then matched against its host's wrapper, which gives each of its texts a slot. Per host and slot it is counted
on how many distinct pages each text stands; copies of a page count once. A text on more than half of the pages that have
the slot (SEEN pages at least) belongs to the template, and a slot whose characters are nearly all such texts is fixed. Main
text is what the elements with varying slots hold, their own headings and other repeated texts included. Where several elements hold varying text, article, main and class words choose the element,
else the innermost one with most of it; navigation, forms, adverts, notices and comments are left out, unless they are around
the element with most of the text. html and body give no such cue. A host without varying text, or too few pages to tell, is read
by the cues alone.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearlens.functions.joins import attach_facts
from wearlens.session import written

FAN = 64
MOST = 0.6
SEEN = 3
VARYING = 0.2
CUED = 0.25

# Element names by their part in a page, and words of class, id or role.
RAW = frozenset("script style noscript template svg iframe select textarea object canvas title".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HOLDERS = frozenset("html head body div section article main nav header footer aside form ul ol dl table tbody thead tr td th figure blockquote details fieldset dialog menu".split())
SPLITTERS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre figcaption caption address summary hr legend center".split())
OUTSIDE = frozenset("head nav footer aside form dialog menu fieldset".split())
OUTSIDE_CUES = frozenset(
    "ad ads advert advertisement adverts banner promo sponsor sponsored cookie cookies consent notice popup modal menu nav navigation navbar breadcrumb breadcrumbs"
    " sidebar footer comment comments reply replies respond disqus share sharing social related recommended newsletter subscribe login search pagination pager toolbar".split()
)
MAIN_CUES = frozenset("article articlebody content post entry story main".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|[^<]+|<""", re.DOTALL)
CUES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
HIDDEN = re.compile(r"""\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.IGNORECASE)
SPACE = re.compile(r"\s+")


class Block:
    """A run of text without a block tag inside, with the elements around it."""

    __slots__ = ("path", "elements", "parts")

    def __init__(self, path: tuple[str, ...], elements: tuple[int, ...]):
        self.path, self.elements, self.parts = path, elements, []

    def text(self) -> str:
        return SPACE.sub(" ", html.unescape("".join(self.parts))).strip()


def read(page: str) -> tuple[list[Block], list[str]]:
    """Blocks of a page, and its token stream ('#' is a text slot, '!' marks a cue of main text, '~' one of other parts)."""
    blocks: list[Block] = []
    stream: list[str] = []
    stack: list[tuple[str, str, int]] = []  # name, label, number of the element in the page
    block: Block | None = None
    inside = 0
    at = 0

    def close_to(i: int) -> None:
        nonlocal inside
        while len(stack) > i:
            name, label, _ = stack.pop()
            inside -= name in ("article", "main")
            stream.append(f"/{label}")

    while m := TOKEN.match(page, at):
        at = m.end()
        slash, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            piece = m[0]
            if piece.startswith("<") and piece != "<":
                continue
            if block is None:
                if not piece.strip():
                    continue
                block = Block(tuple(label for _, label, _ in stack), tuple(number for _, _, number in stack))
                blocks.append(block)
                stream.append("#")
            block.parts.append(piece)
            continue
        name = name.lower()
        if name in RAW:
            if not slash and not rest.endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name == "br":
            if block is not None:
                block.parts.append(" ")
            continue
        if name in HOLDERS:
            block = None
            if slash:
                places = [i for i, (n, _, _) in enumerate(stack) if n == name]
                if places:
                    close_to(places[-1])
                continue
            words = {w for c in CUES.findall(rest) for w in re.split(r"[^a-z0-9]+", "".join(c).lower())} if rest else set()
            if name in ("html", "body"):
                words, rest = set(), "/" if rest.endswith("/") else ""
            out = name in OUTSIDE or (name == "header" and not inside) or bool(words & OUTSIDE_CUES and not words & {"article", "articlebody"}) or bool(rest and HIDDEN.search(rest))
            label = name + ("!" if words & MAIN_CUES else "") + ("~" if out else "")
            if not rest.endswith("/"):
                stack.append((name, label, at))
                inside += name in ("article", "main")
                stream.append(label)
        elif name in SPLITTERS:
            block = None
            stream.append(("/" if slash else "") + name)
        elif name in VOID:
            continue
    close_to(0)
    return blocks, stream


def folded(stream: list[str], widest: int = 12) -> tuple:
    """The stream with adjacent repetitions as ('+', group); nested repetitions come first."""
    items: list = list(stream)
    for width in range(1, widest + 1):
        out: list = []
        i = 0
        while i < len(items):
            unit = items[i : i + width]
            j = i + width
            while len(unit) == width and items[j : j + width] == unit:
                j += width
            if j > i + width:
                group = ("+", tuple(unit))
                if width == 1 and isinstance(unit[0], tuple):
                    group = unit[0]
                if out and out[-1] == group:
                    out.pop()
                out.append(group)
                i = j
            else:
                out.append(items[i])
                i += 1
        items = out
    return tuple(items)


def _absorbed(a: tuple, b: tuple) -> tuple:
    """b with single occurrences of a's repeated groups turned into those groups."""
    for group in [g for g in a if isinstance(g, tuple) and g[0] == "+"]:
        unit, out, i = list(group[1]), [], 0
        items = list(b)
        while i < len(items):
            if items[i : i + len(unit)] == unit:
                i += len(unit)
                if not (out and out[-1] == group):
                    out.append(group)
            elif items[i] == group and out and out[-1] == group:
                i += 1
            else:
                out.append(items[i])
                i += 1
        b = tuple(out)
    return b


def _plain(items: tuple) -> tuple:
    """Optional groups opened, so that streams are compared by what they may hold."""
    out: list = []
    for x in items:
        out += x[1] if isinstance(x, tuple) and x[0] == "?" else [x]
    return tuple(out)


def aligned(a: tuple, b: tuple) -> tuple:
    """A union-free expression that describes both."""
    if a == b:
        return a
    b = _absorbed(a, b)
    a = _absorbed(b, a)
    optional = {k for k, x in enumerate(_marks(a)) if x}, {k for k, x in enumerate(_marks(b)) if x}
    x, y = _plain(a), _plain(b)
    out: list = []

    def put(items: tuple, maybe: bool) -> None:
        for item in items:
            if not maybe:
                out.append(item)
            elif out and isinstance(out[-1], tuple) and out[-1][0] == "?":
                out[-1] = ("?", (*out[-1][1], item))
            else:
                out.append(("?", (item,)))

    for kind, i1, i2, j1, j2 in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        if kind == "equal":
            for i, j in zip(range(i1, i2), range(j1, j2), strict=True):
                put((x[i],), i in optional[0] or j in optional[1])
        else:
            put(x[i1:i2], True)
            put(y[j1:j2], True)
    return tuple(out)


def _marks(items: tuple) -> list[bool]:
    return [m for x in items for m in ([True] * len(x[1]) if isinstance(x, tuple) and x[0] == "?" else [False])]


def describes(wrapper: tuple, stream: tuple) -> bool:
    return set(_plain(aligned(wrapper, stream))) <= set(_plain(_absorbed(stream, wrapper))) | set(_plain(wrapper))


def written_as(items: tuple) -> str:
    """The expression as text; parsed again by `parsed`."""
    return " ".join(f"( {written_as(x[1])} ){x[0]}" if isinstance(x, tuple) else x for x in items)


def parsed(text: str) -> tuple:
    stack: list[list] = [[]]
    for word in text.split():
        if word == "(":
            stack.append([])
        elif word in (")+", ")?"):
            group = (word[1], tuple(stack.pop()))
            stack[-1].append(group)
        else:
            stack[-1].append(word)
    return tuple(stack[0])


class Matcher:
    """Slots of a wrapper: its texts are numbered, and a stream is matched as by a regular expression, without backtracking.

    What stands in an optional group is optional by itself, as `aligned` opens such groups. Sets of positions are bits of a number.
    """

    def __init__(self, wrapper: tuple):
        self.tokens: list[str] = []
        self.after: list[int] = []
        self.at: dict[str, int] = {}
        self.first, self.last, self.empty = self._sequence(wrapper, False)
        for k, token in enumerate(self.tokens):
            self.at[token] = self.at.get(token, 0) | 1 << k

    def _follow(self, ends: int, starts: int) -> None:
        for k in _bits(ends):
            self.after[k] |= starts

    def _sequence(self, items: tuple, maybe: bool) -> tuple[int, int, bool]:
        first, last, empty = 0, 0, True
        for item in items:
            if isinstance(item, str):
                self.tokens.append(item)
                self.after.append(0)
                f = z = 1 << len(self.tokens) - 1
                e = False
            else:
                f, z, e = self._sequence(item[1], item[0] == "?")
                if item[0] == "+":
                    self._follow(z, f)
            e = e or maybe
            self._follow(last, f)
            first |= f if empty else 0
            last = z | (last if e else 0)
            empty = empty and e
        return first, last, empty

    def slots(self, stream: list[str]) -> list[int] | None:
        """The position in the wrapper of each text of the stream; None if the wrapper does not describe the stream."""
        if not stream:
            return [] if self.empty else None
        reached, steps = self.first & self.at.get(stream[0], 0), []
        for token in stream[1:]:
            steps.append(reached)
            following = 0
            for k in _bits(reached):
                following |= self.after[k]
            reached = following & self.at.get(token, 0)
            if not reached:
                return None
        reached &= self.last
        if not reached:
            return None
        here = next(_bits(reached))
        places = [here]
        for before in reversed(steps):
            here = next(k for k in _bits(before) if self.after[k] >> here & 1)
            places.append(here)
        return [k for k, token in zip(reversed(places), stream, strict=True) if token == "#"]


def _bits(number: int) -> Iterator[int]:
    while number:
        low = number & -number
        yield low.bit_length() - 1
        number ^= low


def text_key(slot: int, text: int) -> int:
    return xxhash.xxh3_64_intdigest(slot.to_bytes(8, "little") + text.to_bytes(8, "little", signed=True)) - (1 << 63)


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def cues(path: tuple[str, ...]) -> list[str]:
    """The elements of a path that a cue sets apart from main text."""
    return ["/".join(path[: i + 1]) for i, label in enumerate(path) if label.endswith("~")]


def chosen(sizes: Counter) -> tuple[str, frozenset[str]]:
    """The element that holds the main text, by characters per path of a block; and cues not to be followed, being around it.

    Text under a cue counts CUED of its characters when the path with most text is sought.
    """
    if not sizes:
        return "", frozenset()
    marks = {p: cues(tuple(p.split("/"))) for p in sizes}
    void = frozenset(marks[max(sizes, key=lambda p: (sizes[p] * (CUED if marks[p] else 1), p))])
    total: Counter = Counter()
    for p, n in sizes.items():
        if void.issuperset(marks[p]):
            labels = p.split("/") if p else []
            for i in range(1, len(labels) + 1):
                total["/".join(labels[:i])] += n
            total[""] += n
    return best_path(total), void


def rank(path: str) -> int:
    last = path.rpartition("/")[2]
    return 3 if last.startswith("article") else 2 if last.startswith("main") else 1 if last.endswith("!") else 0


def best_path(sizes: Counter) -> str:
    total = sizes.get("", 0)
    cands = [(rank(p), n if rank(p) else 0, p.count("/"), p) for p, n in sizes.items() if p and (rank(p) or n >= MOST * total)]
    return max(cands)[3] if cands else ""


def _observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page: its stream, folded too, and per block the hash and characters of the text, and the path."""
    kinds = {"host": pa.string(), "stream": pa.string(), "wrapper": pa.string(), "texts": pa.list_(pa.int64()), "sizes": pa.list_(pa.int32()), "paths": pa.list_(pa.string()), "copy": pa.int64()}
    for batch in batches:
        rows = []
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            blocks, stream = read(page or "")
            texts = [b.text() for b in blocks]
            hashes = [text_hash(t) for t in texts]
            raw = " ".join(stream)
            rows.append((host, raw, written_as(folded(stream)), hashes, [len(t) for t in texts], ["/".join(b.path) for b in blocks], text_hash(f"{raw} {hashes}")))
        columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def _slotted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text of a page: slot, path, key of slot and text, characters, and whether slot and key are new on the page."""
    kinds = {"host": pa.string(), "slot": pa.int32(), "path": pa.string(), "key": pa.int64(), "chars": pa.int64(), "new_slot": pa.int32(), "new_key": pa.int32()}
    known: dict[str, Matcher] = {}
    for batch in batches:
        rows = []
        for host, stream, wrapper, texts, sizes, paths in zip(*(batch.column(c).to_pylist() for c in ("host", "stream", "wrapper", "texts", "sizes", "paths")), strict=True):
            slots = _matcher(known, wrapper).slots(stream.split())
            met: set = set()
            for slot, text, size, path in zip(slots or [], texts, sizes, paths, strict=False):
                key = text_key(slot, text)
                rows.append((host, slot, path, key, size, int(slot not in met), int((slot, key) not in met)))
                met |= {slot, (slot, key)}
        columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def _matcher(known: dict[str, Matcher], wrapper: str) -> Matcher:
    if wrapper not in known:
        if len(known) > 200:
            known.clear()
        known[wrapper] = Matcher(parsed(wrapper))
    return known[wrapper]


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["pages", "wrapper"], ascending=[False, True])
    found = parsed(rows["wrapper"].iloc[0])
    for text in rows["wrapper"].iloc[1:]:
        found = aligned(found, parsed(text))
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [written_as(found)], "pages": [rows["pages"].sum()]})


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper, path, rules: per host one expression over all its pages, the element that holds the main text, and as
    JSON the fixed slots, the keys of template texts in other slots and the cues not to be followed."""
    seen = written(
        pages.select("host", "html").mapInArrow(_observed, "host string, stream string, wrapper string, texts array<bigint>, sizes array<int>, paths array<string>, copy bigint"), "streams"
    )
    streams = seen.groupBy("host", "wrapper").agg(F.count("*").alias("pages"))
    while True:
        most = streams.groupBy("host").agg(F.count("*").alias("n"))
        largest = most.agg(F.max("n")).first()[0] or 0
        salted = streams.join(most, "host").withColumn("part", F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("n") / (FAN // 2))))
        streams = written(salted.groupBy("host", "part").applyInPandas(_merge, "host string, wrapper string, pages bigint"), "wrappers")
        if largest <= FAN // 2:
            break
    wrapper = streams.select("host", "wrapper")
    single = seen.drop("wrapper").dropDuplicates(["host", "copy"])
    slotted = written(
        attach_facts(single, wrapper, ["host"], "copy").mapInArrow(_slotted, "host string, slot int, path string, key bigint, chars bigint, new_slot int, new_key int"), "slots"
    )
    slots = slotted.groupBy("host", "slot").agg(F.sum("new_slot").alias("pages"), F.sum("chars").alias("chars"))
    texts = slotted.groupBy("host", "slot", "key").agg(F.sum("new_key").alias("held"), F.sum("chars").alias("chars")).where(F.col("held") >= SEEN)
    # more than half of the pages: at most twice the texts of an average page remain per host
    common = written(texts.join(slots.select("host", "slot", "pages"), ["host", "slot"]).where(2 * F.col("held") > F.col("pages")), "template")
    shares = slots.join(common.groupBy("host", "slot").agg(F.sum("chars").alias("same")), ["host", "slot"], "left")
    shares = written(shares.select("host", "slot", (1 - F.coalesce("same", F.lit(0)) / F.greatest("chars", F.lit(1))).alias("varies")), "shares")
    places = slotted.groupBy("host", "slot", "path").agg(F.sum("chars").alias("chars")).join(shares, ["host", "slot"])
    facts = places.select("host", "slot", "path", F.lit(0).cast("bigint").alias("key"), "chars", "varies").unionAll(
        common.join(shares, ["host", "slot"]).where(F.col("varies") >= VARYING).select("host", "slot", F.lit(None).cast("string"), "key", F.lit(0).cast("bigint"), "varies")
    )
    return wrapper.join(facts.groupBy("host").applyInPandas(_rules, "host string, path string, rules string"), "host", "left")


def _rules(rows: pd.DataFrame) -> pd.DataFrame:
    """What a host's slots say."""
    texts, places = rows[rows["path"].isna()], rows[rows["path"].notna()]
    fixed = set(places["slot"][places["varies"] < VARYING].tolist())
    varying = places[~places["slot"].isin(fixed)]
    sizes: Counter = Counter()
    if not (varying["chars"] * varying["varies"]).sum() > 0:
        # nothing varies: cues alone
        fixed, texts = set(), texts[:0]
        for p, n in zip(places["path"], places["chars"], strict=True):
            sizes[p] += int(n)
    else:
        for p, n, share in zip(varying["path"], varying["chars"], varying["varies"], strict=True):
            sizes[p] += float(n) * float(share)
    path, void = chosen(sizes)
    rules = json.dumps({"fixed": sorted(fixed), "texts": sorted(texts["key"].tolist()), "void": sorted(void)})
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "path": [path or None], "rules": [rules]})


NO_RULES: dict[str, frozenset] = {"fixed": frozenset(), "texts": frozenset(), "void": frozenset()}


def main_text(page: str, wrapper: Matcher | None, path: str | None, rules: dict[str, frozenset] = NO_RULES) -> tuple[str, bool]:
    """Main text of a page, and whether its host's wrapper describes it."""
    blocks, stream = read(page)
    slots = wrapper.slots(stream) if wrapper is not None else None
    texts = [b.text() for b in blocks]
    varying = [
        k for k, t in enumerate(texts)
        if slots is None or not (slots[k] in rules["fixed"] or (rules["texts"] and text_key(slots[k], text_hash(t)) in rules["texts"]))
    ]
    asked = tuple(path.split("/")) if path and slots is not None else ()
    void = rules["void"] if slots is not None else frozenset()

    def inside(k: int) -> bool:
        p = blocks[k].path
        return p[: len(asked)] == asked and void.issuperset(cues(p))

    if not any(asked and inside(k) for k in varying):
        sizes: Counter = Counter()
        for k in varying:
            sizes["/".join(blocks[k].path)] += len(texts[k])
        own, void = chosen(sizes)
        asked = tuple(own.split("/")) if own else ()
    # repeated text only chooses the elements: what an element with varying text holds besides, a heading say, belongs to it
    found = {blocks[k].elements[: len(asked)] for k in varying if inside(k)}
    shown = set(varying) if not asked else {k for k, b in enumerate(blocks) if b.elements[: len(asked)] in found}
    return "\n".join(t for k, t in enumerate(texts) if t and k in shown and inside(k)), slots is not None


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, Matcher] = {}
    ruled: dict[str, dict[str, frozenset]] = {}
    for batch in batches:
        texts, fits = [], []
        for page, wrapper, path, rules in zip(*(batch.column(c).to_pylist() for c in ("html", "wrapper", "path", "rules")), strict=True):
            if rules is not None and rules not in ruled:
                if len(ruled) > 200:
                    ruled.clear()
                ruled[rules] = {k: frozenset(v) for k, v in json.loads(rules).items()}
            text, fit = main_text(page or "", _matcher(known, wrapper) if wrapper is not None else None, path, ruled.get(rules, NO_RULES))
            texts.append(text)
            fits.append(fit)
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(fits, pa.bool_())], names=["page_id", "url", "text", "described"])


def extracted(pages: DataFrame) -> DataFrame:
    """Per page row: page_id, url, text (main text, blocks joined by a newline), described (by its host's wrapper).

    A null or empty html gives an empty text; a null url has the host ''. Unclosed and stray tags are closed as they come.
    Repeated rows are pages of their own. Other columns are not read.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", "html", F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))).alias("host"))
    joined = attach_facts(rows, wrappers(rows), ["host"], "page_id")
    return joined.mapInArrow(_extracted, f"page_id {kind}, url string, text string, described boolean")
