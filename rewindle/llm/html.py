"""Main text of web pages: the page's structure first, then what a host's pages repeat.

A page is cut into blocks at block-level tags. Blocks inside elements that never hold an article (menus, page
headers and footers, sidebars, forms, scripts, or elements whose class, id or role says so) are left
out; an article's own header is not. What is left has readings: a marked ``article``, a ``main``, what stands in neither, and the
same inside a wrapper whose label only says boilerplate. A page with one reading has that text. Of several the structure proposes one
(``main`` where it has more text outside its articles than in them, or has none, else the articles; not what a label leaves out, unless it
outweighs what is kept elsewhere), and the host's streams decide: text that its other pages hold too weighs nothing. So ``main`` gives way to its
article if its own part is the host's, and a marked article in which nothing is the page's own gives way to more unique text elsewhere.
A marked article is returned whole, repeats and all, since different articles quote the same passages.

Host streams. Wherever some page of a host has several readings or no mark, each task concatenates the streams of the host's pages it holds and sorts
their suffixes by prefix doubling up to ``RUN`` tokens. Suffixes that agree so far are one stretch; the task passes on
each stretch once, with the least and greatest content it stands in, and Spark merges the tasks' arrays by host and
stretch. A stretch found on pages of different content is repeated, and so are the longer ones it is part of. Readings are weighed against the whole
of the host's pages. A page without a mark keeps the tokens that no stretch repeated outside marked articles covers: its unique runs. So the result
depends on neither the size of a host nor the layout of files, and no task holds a host. Stretches and contents are compared by 128 and 64 bits of hash.

With ``shared_words`` the suffixes of all pages of all hosts are compared, and each page says from how many words of its marked article (of the whole page, if none)
a stretch goes on that stands on other pages of its host: ``n_repeated``, see ``repeated_words``. Every suffix counts. To keep the shuffle below the input, those
that hold no part which other pages hold too are left out before the sort: they cannot repeat. It changes no text.

White space inside a block, character references decoded, becomes one blank; blocks are joined by a line feed. A
``br`` is white space. Nulls: a null page is empty and gives an empty text; a null url is a host of its own. Repeated rows
give repeated results and do not count as different pages, nor do pages whose streams are equal. Pages are read whole
however long. Only the three named columns are read, so others may have any name. A table without rows gives none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewindle.llm.common import ready, written
from rewindle.llm.urls import KEYS, MOST, bloom, possible
from rewindle.operators.joins import broadcast_if_small

RUN = 16
#: Tokens whose suffixes a task sorts at once; its arrays are merged like those of other tasks.
HELD = 1 << 20
#: A stretch has so many parts of which the least is its seed, and of so many pages a task sorts the suffixes at once.
EVERY, PAGES = 8, 512
#: Bits of the filter of a bucket's seeds.
FILTER = 1 << 15

#: Element names by their role in a page.
RAW = "script style textarea title noscript iframe xmp noembed noframes".split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset("nav header footer aside form script style noscript iframe template button select option svg math object canvas audio video dialog menu head title textarea".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul option select button textarea".split()
)
#: Words of a class, id or role that mark boilerplate.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent gdpr notice popup modal overlay newsletter "
    "subscribe sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments disqus share sharing social related "
    "widget pagination contentinfo complementary search login signup".split()
)
#: Those of them that mark what holds articles of its own, not the page's; the others may also stand on a wrapper of the whole page.
OTHERS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo comment comments disqus related widget".split())
#: A start of one of these ends an open paragraph.
_ENDS_P = BLOCK - {"html", "body"}
_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|([^<]++|<)",
    re.S,
)
_LABEL = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in RAW}


def _labelled(attributes: str) -> int:
    """1 if class, id or role of a start tag name boilerplate; 2 if articles inside are not the page's, or it is not shown."""
    if not attributes:
        return 0
    if _HIDDEN.search(attributes):
        return 2
    words: set[str] = set()
    for found in _LABEL.finditer(attributes):
        value = unescape(found[1] or found[2] or found[3] or "").lower()
        words.update(re.split(r"[^a-z0-9]+", value))
    return 0 if MARKED.isdisjoint(words) else 1 if OTHERS.isdisjoint(words) else 2


def blocks(page: str) -> list[tuple[str, int, str | None]]:
    """(text, left out, region) of each block in order; region is ``article``, ``main``, ``inner`` (an article in main) or none.

    Left out is 2, or 1 if only a label on an element around the region says so, which may be a wrapper of the page.
    """
    out: list[tuple[str, int, str | None]] = []
    stack: list[tuple[str, int, str | None]] = [("", 0, None)]
    parts: list[str] = []
    at, size = 0, len(page)

    def flush() -> None:
        text = " ".join(unescape("".join(parts)).split())
        if text:
            out.append((text, *stack[-1][1:]))
        parts.clear()

    def close(name: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == name:
                if any(x[0] in BLOCK or x[1:] != stack[k - 1][1:] for x in stack[k:]):
                    flush()
                del stack[k:]
                return

    while at < size:
        found = _PIECE.match(page, at)
        if found is None:  # a quote in a tag is never closed: the tag ends at the next bracket
            end = page.find(">", at)
            at = size if end < 0 else end + 1
            continue
        at = found.end()
        if found[5] is not None:
            parts.append(found[5])
        elif found[1] is not None:
            parts.append(found[1].replace("&", "&amp;"))
        elif found[3] is not None:
            name = found[3].lower()
            if found[2]:
                if name == "br":
                    parts.append(" ")
                else:
                    close(name)
                continue
            if name in _RAW_END:
                end = _RAW_END[name].search(page, at)
                at = end.end() if end else size
                continue
            if name in VOID:
                if name == "hr":
                    flush()
                elif name == "br":
                    parts.append(" ")
                continue
            if name in _ENDS_P and any(x[0] == "p" for x in stack[-8:]):
                close("p")
            _, left, region = stack[-1]
            if name in ("article", "main") and region not in ("article", "inner"):
                new = (name, 2 if _labelled(found[4]) else left, "inner" if (name, region) == ("article", "main") else name)
            else:
                plain = name in ("html", "body") or name == "header" and region in ("article", "inner") and not _labelled(found[4])
                label = 0 if plain else 2 if name in ASIDE else _labelled(found[4])
                if label and (region in ("article", "inner") or region == "main" and left):
                    label = 2
                new = (name, max(left, label), region)
            if name in BLOCK or new[1:] != (left, region):
                flush()
            if not found[4].endswith("/"):
                stack.append(new)
            elif name in BLOCK:
                flush()
    flush()
    return out


def readings(all_: list[tuple[str, int, str | None]]) -> int:
    """How many kinds of block could be the text: kept or left out by a wrapper's label only, by region; one leaves no choice."""
    return len({(left, region) for _, left, region in all_ if not left or left == 1 and region})


def chosen(all_: list[tuple[str, int, str | None]], repeated: list[int] | None = None) -> list[bool] | None:
    """Which blocks are the text of the page's marked article; none if no mark holds it.

    ``repeated`` gives the characters of each block that other pages of the host hold too. What is left, the unique text, weighs first.
    """
    unique = [len(t) - n for (t, _, _), n in zip(all_, repeated or [0] * len(all_), strict=True)]

    def weigh(own: list[bool]) -> tuple[int, int]:
        return sum(n for n, o in zip(unique, own, strict=True) if o), sum(len(t) for (t, _, _), o in zip(all_, own, strict=True) if o)

    inside = lambda *regions, label=0: [r in regions and left == label for _, left, r in all_]
    elsewhere = lambda own: weigh([not left and not o for (_, left, _), o in zip(all_, own, strict=True)])
    articles, main = ("article", "inner"), ("main", "inner")
    inner = weigh(inside("inner"))
    for regions in (main, articles) if inner[1] and weigh(inside("main")) > inner else (articles, main):
        own = inside(*regions)
        # no text of the page's own in it, and more of it elsewhere than all it holds: what is marked is the host's
        if any(own) and (weigh(own)[0] or elsewhere(own)[0] <= weigh(own)[1]):
            return own
        # inside a labelled wrapper: the page's if it outweighs all that is kept elsewhere
        own = inside(*regions, label=1)
        kept, size = weigh([not left for _, left, _ in all_]), weigh(own)
        if any(own) and (size[1] + sum(own) - 1 > kept[1] or size[0] > kept[0]):
            return own
    return None


def parsed(page: str) -> tuple[str | None, bool, list[dict]]:
    """The text by structure, whether other readings are open, and the blocks: all if so, else those outside the text."""
    all_ = blocks(page)
    own = chosen(all_)
    text = None if own is None else "\n".join(t for (t, _, _), o in zip(all_, own, strict=True) if o)
    several = readings(all_) > 1
    parts = zip(all_, own or [False] * len(all_), strict=True)
    return text, several, [{"own": o, "left": left, "region": region, "text": t} for (t, left, region), o in parts if several or not o]


def divided(page: str) -> tuple[str | None, list[tuple[bool, str]]]:
    """By structure alone: the text of a marked article (or none), and the other blocks with whether they may be kept."""
    text, _, parts = parsed(page)
    return text, [(text is None and not p["left"], p["text"]) for p in parts if not p["own"]]


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _keys(tokens: np.ndarray, at: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of the ``run`` token hashes from each place on."""
    keys = []
    with np.errstate(over="ignore"):
        for factor, shift in ((0x9E3779B97F4A7C15, 29), (0xC2B2AE3D27D4EB4F, 31)):
            key = np.zeros(len(at), np.uint64)
            mixed = (tokens.view(np.uint64) ^ (tokens.view(np.uint64) >> np.uint64(shift))) * np.uint64(factor)
            for j in range(run):
                key = (key ^ (key >> np.uint64(shift))) * np.uint64(factor) + mixed[at + j]
            keys.append(key.view(np.int64))
    return keys[0], keys[1]


def _token_hashes(streams: list[list[str]]) -> list[np.ndarray]:
    known: dict[str, int] = {}
    return [np.array([known[t] if t in known else known.setdefault(t, _hash(t)) for t in s], np.int64) for s in streams]


def _ranked(tokens: np.ndarray, room: np.ndarray, run: int) -> np.ndarray:
    """The rank of each suffix of some concatenated streams by its first ``run`` tokens, of which ``room`` are left in its stream."""
    total = len(tokens)
    rank, length = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while length < run:
        step = min(length, run - length)
        second = np.full(total, -1, np.int64)
        second[: total - step] = rank[step:]
        second[room <= step] = -1
        rank = np.unique(rank * (int(second.max()) + 2) + second + 1, return_inverse=True)[1].astype(np.int64)
        length += step
    return rank


def stretches(streams: list[list[str]], run: int = RUN, contents: list[int] | None = None) -> tuple[np.ndarray, ...]:
    """The different stretches of ``run`` tokens in some streams: two keys, and the least and greatest content they stand in.

    A stream's content is itself unless given, as for the two streams of one page.

    Suffixes of the concatenated streams are ranked by their first token, then by 2, 4, ... tokens, until ``run``;
    equal ranks then mean equal stretches. A stretch that would leave its stream is none.
    """
    ids = _token_hashes(streams)
    sizes = np.array([len(x) for x in ids], np.int64)
    total = int(sizes.sum())
    tokens = np.concatenate([*ids, np.zeros(0, np.int64)])
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(total)  # tokens left in the stream
    whole = np.flatnonzero(room >= run)
    if not len(whole):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    own = np.array([_hash(" ".join(s)) for s in streams] if contents is None else contents, np.int64)
    rank = _ranked(tokens, room, run)
    order = whole[np.argsort(rank[whole], kind="stable")]  # the suffixes in order
    first = np.flatnonzero(np.r_[True, rank[order][1:] != rank[order][:-1]])
    content = np.repeat(own, sizes)[order]
    return *_keys(tokens, order[first], run), np.minimum.reduceat(content, first), np.maximum.reduceat(content, first)


def _laid(pages: list[tuple[str, list[str], list[str]]], run: int) -> tuple[np.ndarray, ...]:
    """The streams of some pages (host, tokens outside and inside their article) one after the other: hashes of host and token, tokens
    left in the stream, the page, and whether the stream is the article (the page, if none). Streams without a stretch are left out."""
    sides = [(k, of, s, s is inside or not inside) for k, (of, outside, inside) in enumerate(pages) for s in (outside, inside) if len(s) >= run]
    ids = _token_hashes([s for _, _, s, _ in sides])
    sizes = np.array([len(x) for x in ids], np.int64)
    tokens = np.concatenate([np.zeros(0, np.int64), *(x ^ np.int64(_hash(of)) for x, (_, of, _, _) in zip(ids, sides, strict=True))])
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(tokens))
    return tokens, room, *(np.repeat(np.array([x[k] for x in sides], np.int64), sizes) for k in (0, 3))


def _seeds(tokens: np.ndarray, run: int) -> np.ndarray:
    """The seed of the stretch at each place: the least key of its ``EVERY`` parts of ``run - EVERY + 1`` tokens. Equal stretches have equal seeds."""
    size = run - EVERY + 1
    keys = _keys(tokens, np.arange(len(tokens) - size + 1), size)[0].view(np.uint64)
    least = np.minimum.reduce([keys[j : len(keys) - EVERY + 1 + j] for j in range(EVERY)])
    return (least ^ (least >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)  # the least are small numbers: buckets go by the first bits


def _bits(longs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of its bucket's filter that a seed sets, from the long behind the bits of the bucket."""
    return tuple((longs >> np.uint64(k)).astype(np.int64) & (FILTER - 1) for k in (49, 34))


def sown(pages: list[tuple[str, list[str], list[str]]], bits: int, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """What a task passes on of the seeds of some pages, one for each different seed: bucket, and a long.

    The long is the seed behind the ``bits`` of the bucket, but for its last bit, which says that two of these pages hold it.
    """
    tokens, room, page, _ = _laid(pages, run)
    whole = np.flatnonzero(room >= run)
    if not len(whole):
        return whole, whole
    seed, page = _seeds(tokens, run)[whole], page[whole]
    new = np.r_[True, (seed[1:] != seed[:-1]) | (page[1:] != page[:-1])]
    seed, page = seed[new], page[new]
    order = np.argsort(seed, kind="stable")
    seed, page = seed[order], page[order]
    heads = np.flatnonzero(np.r_[True, seed[1:] != seed[:-1]])
    several = page[heads] < np.maximum.reduceat(page, heads)
    longs = seed[heads] << np.uint64(bits) & ~np.uint64(1) | several.astype(np.uint64)
    return (seed[heads] >> np.uint64(64 - bits)).view(np.int64), longs.view(np.int64)


def met(table: pa.Table) -> pa.Table:
    """The filter of a bucket's seeds that stand on several pages: those that a task knows to, and those that two tasks' pages hold."""
    longs = np.sort(table.column("found").combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64))
    same = np.r_[longs[1:] >> np.uint64(1) == longs[:-1] >> np.uint64(1), np.zeros(min(1, len(longs)), bool)]
    marks = np.zeros(FILTER, bool)
    for at in _bits(longs[same | (longs & np.uint64(1) == 1)]):
        marks[at] = True
    return pa.table({"bucket": table.column("bucket").slice(0, 1), "marks": pa.array([np.packbits(marks).tobytes()])})


def passed(pages: list[tuple[str, list[str], list[str]]], bits: int, marks: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a task knows of some pages (host, tokens outside and inside their article), and what it passes on.

    A stretch counts at each of its places in the article (in the page, if none). ``marks`` has the filters of all buckets: a stretch whose seed
    is in none stands on no other page, so only the runs of tokens that the others cover are sorted. Given are each page's places
    whose stretch stands on two of these pages, and the suffixes that go on, one for each such stretch: bucket and long. The top 54 bits
    of the long are the key of host and stretch behind the ``bits`` of the bucket, then come 9 bits for the page and one that counts.
    """
    words = np.zeros(len(pages), np.int64)
    tokens, room, page, size = _laid(pages, run)
    at = np.flatnonzero(room >= run)
    if len(at):
        seed = _seeds(tokens, run)[at]
        bucket = (seed >> np.uint64(64 - bits)).view(np.int64)
        one, two = (marks[bucket, k >> 3] >> (7 - (k & 7)).astype(np.uint8) & 1 for k in _bits(seed << np.uint64(bits)))
        at = at[(one & two).view(bool)]
    if not len(at):
        return words, at, at
    asked = np.zeros(len(tokens), bool)
    asked[at] = True
    cover = covered(len(tokens), at, run)
    ends = np.flatnonzero(cover & (np.r_[~cover[1:], True] | (room == 1)))
    kept = np.flatnonzero(cover)
    whole = np.flatnonzero(asked[kept])
    tokens, room = tokens[kept], ends[np.searchsorted(ends, kept)] + 1 - kept
    page, size = page[kept[whole]], size[kept[whole]]
    _, first, same = np.unique(_ranked(tokens, room, run)[whole], return_index=True, return_inverse=True)
    least = _keys(tokens, whole[first], run)[0]
    order = np.argsort(same, kind="stable")
    of, page, size = same[order], page[order], size[order]
    heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    several = np.repeat(page[heads] < np.maximum.reduceat(page, heads), np.diff(heads, append=len(of)))
    np.add.at(words, page[several], size[several])
    size[several] = 0
    on = ~several
    on[heads] = True
    key = least[of[on]].view(np.uint64)
    longs = (key << np.uint64(bits)) >> np.uint64(10) << np.uint64(10) | (page[on] << 1 | size[on]).astype(np.uint64)
    return words, (key >> np.uint64(64 - bits)).view(np.int64), longs.view(np.int64)


def shared(table: pa.Table) -> pa.Table:
    """The places of each page whose stretch stands on several: of those in a bucket, and those that tasks know already."""
    found, known = (table.column(c).combine_chunks() for c in ("found", "known"))
    base = table.column("base").to_numpy()
    pages_of = lambda x: np.repeat(base, x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    longs, own = (x.flatten().to_numpy(zero_copy_only=False) for x in (found, known))
    pages = pages_of(found) + (longs >> 1 & 511)
    order = np.argsort(longs >> 10, kind="stable")
    longs, pages = longs[order], pages[order]
    hit = np.zeros(0, bool)
    if len(longs):
        first = np.flatnonzero(np.r_[True, (longs[1:] >> 10) != (longs[:-1] >> 10)])
        several = np.minimum.reduceat(pages, first) < np.maximum.reduceat(pages, first)
        hit = np.repeat(several, np.diff(first, append=len(longs))) & ((longs & 1) > 0)
    rids, at = np.unique(np.concatenate([pages[hit], pages_of(known) + (own & 511)]), return_inverse=True)
    words = np.zeros(len(rids), np.int64)
    np.add.at(words, at, np.concatenate([longs[hit] & 1, own >> 9]))
    return pa.table({"rid": rids, "n_repeated": words})


def _chars(pages: DataFrame) -> int:
    return pages.agg(F.expr("sum(coalesce(length(article), 0) + aggregate(blocks, 0L, (n, b) -> n + length(b.text)))")).first()[0] or 0


def repeated_words(pages: DataFrame) -> DataFrame:
    """(``rid``, ``n_repeated``) of the pages that share stretches with others of their host, from the suffixes of all pages.

    ``n_repeated`` counts the words of a page's article as the structure has it (of the whole page, if it marks none) from which on ``RUN`` words
    stand on another page too, be it a copy. Two rounds keep the shuffle below the input: first the tasks' seeds meet, about two of nine
    suffixes; then all suffixes whose seed stands on several pages do. The filter of those seeds, ``FILTER`` bits a bucket and 64 MB at most, goes
    to all tasks; a fuller one lets more suffixes through and changes no count.
    """
    bits = min(14, max(6, (_chars(pages) >> 24).bit_length()))
    rows = pages.select("host", "rid", "article", "blocks")

    def groups(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[str, list[str], list[str]]]]]:
        held: list[tuple[str, list[str], list[str]]] = []
        base = size = 0
        for part in parts:
            for of, rid, article, others in zip(*(part.column(c) for c in range(4)), strict=True):
                if held and (rid.as_py() != base + len(held) or len(held) == PAGES or size > HELD):
                    yield base, held
                    held, size = [], 0
                if not held:
                    base = rid.as_py()
                held.append((of.as_py(), *_streams(others.as_py(), article.as_py())))
                size += len(held[-1][1]) + len(held[-1][2])
        if held:
            yield base, held

    def dealt(bucket: np.ndarray, longs: np.ndarray, *more: int) -> tuple[np.ndarray, pa.ListArray]:
        order = np.argsort(bucket, kind="stable")
        of, first = np.unique(bucket[order], return_index=True)
        return of, pa.ListArray.from_arrays(pa.array([*first, len(longs), *more], pa.int32()), pa.array(longs[order]))

    def sow(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in groups(parts):
            of, found = dealt(*sown(held, bits))
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), found], ["bucket", "found"])

    marks = np.zeros((1 << bits, FILTER // 8), np.uint8)
    for bucket, own in zip(*rows.mapInArrow(sow, "bucket long, found array<long>").groupBy("bucket").applyInArrow(met, "bucket long, marks binary").toArrow().columns, strict=True):
        marks[bucket.as_py()] = np.frombuffer(own.as_py(), np.uint8)
    sent = pages.sparkSession.sparkContext.broadcast(marks)

    def sort(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for base, held in groups(parts):
            words, bucket, longs = passed(held, bits, sent.value)
            of, found = dealt(bucket, longs, len(longs))
            known = np.flatnonzero(words)
            known = pa.array([[]] * len(of) + [(words[known] << 9 | known).tolist()], pa.list_(pa.int64()))
            of = pa.array([*of, _hash(str(base)) % (1 << bits)], pa.int64())
            yield pa.RecordBatch.from_arrays([of, pa.array([base] * len(of), pa.int64()), found, known], ["bucket", "base", "found", "known"])

    found = rows.mapInArrow(sort, "bucket long, base long, found array<long>, known array<long>")
    return found.groupBy("bucket").applyInArrow(shared, "rid long, n_repeated long").groupBy("rid").agg(F.sum("n_repeated").alias("n_repeated"))


def starts(stream: list[str], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """The two keys of the stretch at each place of a stream that has room for one."""
    tokens = _token_hashes([stream])[0]
    return _keys(tokens, np.arange(max(0, len(tokens) - run + 1)), run)


def covered(size: int, at: list[int] | np.ndarray, run: int = RUN) -> np.ndarray:
    """Which of ``size`` tokens lie in a stretch that starts at one of the places ``at``."""
    marks = np.zeros(size + 1, np.int64)
    np.add.at(marks, np.array(at, np.int64), 1)
    np.add.at(marks, np.array(at, np.int64) + run, -1)
    return np.cumsum(marks[:size]) > 0


def _runs(blocks: list[str], flags: np.ndarray) -> list[str]:
    """What is left of each block without the tokens that are covered; ``flags`` follow the blocks' tokens."""
    out, place = [], 0
    for block in blocks:
        tokens = block.split()
        out.append(" ".join(t for t, c in zip(tokens, flags[place : place + len(tokens)].tolist(), strict=True) if not c))
        place += len(tokens)
    return out


def unique_runs(blocks: list[tuple[bool, str]], at: list[int], run: int = RUN) -> str:
    """The kept blocks without the tokens that repeated stretches, starting at the places ``at`` of the page's stream, cover."""
    flags = covered(sum(len(t.split()) for _, t in blocks), at, run)
    return "\n".join(left for (keep, _), left in zip(blocks, _runs([t for _, t in blocks], flags), strict=True) if keep and left)


def weighed(parts: list[dict], at: list[int], run: int = RUN) -> str | None:
    """The text of a page with several readings: the one that holds most of what repeated stretches do not cover.

    ``parts`` are the page's blocks, ``at`` places of its stream: first the blocks that are not ``own``, then those that are. None
    if neither the structure nor the weights find a marked article.
    """
    order = sorted(range(len(parts)), key=lambda k: parts[k]["own"])
    flags = covered(sum(len(p["text"].split()) for p in parts), at, run)
    left = dict(zip(order, _runs([parts[k]["text"] for k in order], flags), strict=True))
    own = chosen([(p["text"], p["left"], p["region"]) for p in parts], [len(p["text"]) - len(left[k]) for k, p in enumerate(parts)])
    if own is None:
        return "\n".join(left[k] for k, p in enumerate(parts) if not p["left"] and left[k]) if any(p["own"] for p in parts) else None
    return "\n".join(p["text"] for p, o in zip(parts, own, strict=True) if o)


def _streams(parts: list[dict], article: str | None) -> tuple[list[str], list[str]]:
    """The tokens outside and inside what the structure takes for the article."""
    return [t for p in parts if not p["own"] for t in p["text"].split()], (article or "").split()


def extracted(df: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", shared_words: bool = False) -> DataFrame:
    """(id, url, ``text``) of every page; with ``shared_words`` also ``n_repeated``, see ``repeated_words``."""
    spark = df.sparkSession
    ready(spark)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = df.select(F.col(id).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"), host.alias("host"), F.monotonically_increasing_id().alias("rid"))
    kind = rows.schema["id"].dataType.simpleString()
    block = pa.list_(pa.struct([("own", pa.bool_()), ("left", pa.int8()), ("region", pa.string()), ("text", pa.string())]))

    def parse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [parsed(x.as_py() or "") for x in part.column("html")]
            own = [pa.array([x[k] for x in found], of) for k, of in enumerate((pa.string(), pa.bool_(), block))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "url", "host", "rid")), *own], ["id", "url", "host", "rid", "article", "several", "blocks"])

    shape = "article string, several boolean, blocks array<struct<own: boolean, left: tinyint, region: string, text: string>>"
    pages = written(rows.mapInArrow(parse, f"id {kind}, url string, host string, rid long, {shape}"), "parsed-pages", "zstd")
    marked = pages.where("article IS NOT NULL AND NOT several").select("id", "url", "rid", F.col("article").alias("text"))
    unsure = pages.where("article IS NULL OR several")

    def arrays(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[bool, bool, list[str], list[str]]]] = {}
        size = 0

        def sorted_() -> Iterator[pa.RecordBatch]:
            for of, pages in held.items():
                whole = [_hash("\n".join((" ".join(o), " ".join(i)))) for _, _, o, i in pages if pages[0][1] for _ in range(2)]
                for several, streams, contents in (False, [o for _, _, o, _ in pages if pages[0][0]], None), (True, [s for _, _, *both in pages if pages[0][1] for s in both], whole):
                    found = stretches(streams, contents=contents)
                    n = len(found[0])
                    if n:
                        yield pa.RecordBatch.from_arrays([pa.array([of] * n, pa.string()), pa.array([several] * n), *map(pa.array, found)], ["host", "several", "k1", "k2", "low", "high"])
            held.clear()

        for part in parts:
            for of, bare, several, article, others in zip(*(part.column(c) for c in range(5)), strict=True):
                outside, inside = _streams(others.as_py(), article.as_py() if several.as_py() else None)
                held.setdefault(of.as_py(), []).append((bare.as_py(), several.as_py(), outside, inside))
                size += len(outside) + len(inside)
                if size > HELD:
                    yield from sorted_()
                    size = 0
        yield from sorted_()

    # Only hosts with a page that the streams decide; one row a host, broadcast if a count shows them few.
    asked = unsure.groupBy("host").agg(F.bool_or(F.col("article").isNull()).alias("bare"), F.bool_or("several").alias("open"))
    asked = broadcast_if_small(written(asked, "hosts"))
    streams = pages.join(asked, "host").select("host", "bare", "open", "article", "blocks")
    found = streams.mapInArrow(arrays, "host string, several boolean, k1 long, k2 long, low long, high long")
    def places(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for of, rid, article, several, others in zip(*(part.column(c) for c in range(5)), strict=True):
                outside, inside = _streams(others.as_py(), article.as_py())
                for stream, first in ((outside, 0), (inside, len(outside))):
                    one, two = starts(stream)
                    n = len(one)
                    for asks in (False,) * (not article.is_valid) + (True,) * several.as_py() if n else ():
                        same = [pa.array([of.as_py()] * n, pa.string()), pa.array([asks] * n), pa.array([rid.as_py()] * n, pa.int64())]
                        yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(n) + first), pa.array(one), pa.array(two)], ["host", "several", "rid", "at", "k1", "k2"])

    own = unsure.select("host", "rid", "article", "several", "blocks").mapInArrow(places, "host string, several boolean, rid long, at long, k1 long, k2 long")
    # Only stretches that such a page may hold are merged: a filter of at most 16 MB tells, whatever its pages' size.
    blocks = min(MOST, 1 + _chars(unsure) // 6 // KEYS)
    found = possible(found, "k1", written(bloom(own, "k1", blocks), "asked-stretches"), blocks, "maybe").where("maybe")
    merged = found.groupBy("host", "several", "k1", "k2").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    repeats = written(merged.where("low < high").select("host", "several", "k1", "k2"), "repeats")
    hits = own.join(broadcast_if_small(repeats), ["host", "several", "k1", "k2"], "left_semi")
    hits = hits.groupBy("rid").agg(*[F.collect_list(F.when(F.col("several") == k, F.col("at"))).alias(c) for k, c in ((True, "at"), (False, "bare"))])

    def finish(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = []
            for several, own, at, bare in zip(*([x.as_py() for x in part.column(c)] for c in ("several", "blocks", "at", "bare")), strict=True):
                text = weighed(own, at or []) if several else None
                texts.append(unique_runs([(not p["left"], p["text"]) for p in own], bare or []) if text is None else text)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "url", "rid")), pa.array(texts, pa.string())], ["id", "url", "rid", "text"])

    decided = unsure.join(hits, "rid", "left").select("id", "url", "rid", "several", "blocks", "at", "bare")
    texts = marked.unionByName(decided.mapInArrow(finish, f"id {kind}, url string, rid long, text string"))
    own = [F.col("id").alias(id), F.col("url").alias(url), F.col("text")]
    if not shared_words:
        return texts.select(*own)
    counted = broadcast_if_small(written(repeated_words(pages), "repeated-words"))
    return texts.join(counted, "rid", "left").select(*own, F.coalesce("n_repeated", F.lit(0).cast("long")).alias("n_repeated"))
