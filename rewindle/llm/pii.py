"""Personal data in whole texts: fixed patterns, and a trained character tagger that adds spans.

Patterns find emails, network addresses, card and phone numbers (``base_spans``). The tagger, a
bidirectional LSTM with CRF transitions, learns from windows around such spans, some of them in spellings the
patterns miss. A text is read in windows that overlap by half. Spans that touch an inner edge of their
window are put together with what the neighbouring windows hold of them. Of the spans that
look like their kind (``plausible``) the best set without overlaps is chosen for the whole text at once, weighing length by the number
of windows that found a span; those that do not meet a pattern's span are added. Every kind
needs a digit or an at sign, so a window with neither holds no span and is not run.

Training takes at most ``WINDOWS`` different labelled windows of each of two sorts (with a span, an equal share of each kind, and
without), drawn from all texts by hash; that bound is the only one, all texts are read whole. Without any labelled window nothing is
added. Other columns are not read by ``digests``; ``masked`` keeps them.

Nulls: a null text counts as empty, a null id is kept. Equal rows get equal results. A table without
rows gives none. Places are code points, ends exclusive.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rewindle.llm.common import ready
from rewindle.llm.tagger import Tagger, encoded, trained

#: The kinds, in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone")
WIDTH, STRIDE = 96, 48
WINDOWS, EPOCHS = 800, 7

Span = tuple[str, int, int]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """From each at sign whose right side fits, back to the start of its left side or the last match."""
    at, free = 0, 0
    while found := _DOMAIN.search(text, at):
        start = found.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < found.start():
            yield "email", start, found.end()
            at = free = found.end()
        else:
            at = found.start() + 1


def _is_ip(text: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in text.split("."))


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, by start and then by kind."""
    out = list(_emails(text)) if "@" in text else []
    if _TRIGGER.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if _is_ip(m[0])]
        out += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15] if "+" in text else []
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


_LOOKS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+ ?@ ?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9](?:[ .-]?[0-9]){13,18}"),
    "phone": re.compile(r"\+?[0-9(][ ().0-9-]+[0-9]"),
}


def plausible(kind: str, text: str, start: int, end: int) -> bool:
    """Whether a tagged span looks like its kind and is no part of a longer word or number."""
    own, digits = text[start:end], _digits(text[start:end])
    if not _LOOKS[kind].fullmatch(own) or text[max(0, start - 1) : start].isalnum() or text[end : end + 1].isalnum():
        return False
    if kind == "ip":
        return _is_ip(own)
    if kind == "card":
        return luhn(digits)
    return kind == "email" or (10 <= len(digits) <= 15 and not digits == own)


def windows(text: str) -> list[int]:
    """Starts of the windows that hold a digit or an at sign, on a fixed grid."""
    last = max(0, -(-(len(text) - WIDTH) // STRIDE))
    out: list[int] = []
    found = _TRIGGER.search(text)
    while found:
        k = found.start() // STRIDE
        out += [i for i in (k - 1, k) if 0 <= i <= last and (not out or i > out[-1])]
        if k >= last:
            out += [last] if not out or out[-1] < last else []
            break
        found = _TRIGGER.search(text, (k + 1) * STRIDE)
    return [i * STRIDE for i in out]


def _tagged(labels: np.ndarray, at: int, length: int, size: int) -> Iterator[tuple[Span, bool, bool]]:
    """The spans of one window's labels, and whether each begins and ends for sure: not at an inner edge of the window."""
    row, i = labels[:length].tolist(), 0
    while i < length:
        if row[i] % 2:
            j = i + 1
            while j < length and row[j] == row[i] + 1:
                j += 1
            yield (KINDS[row[i] // 2], at + i, at + j), i > 0 or at == 0, j < WIDTH or at + j == size
            i = j
        else:
            i += 1


def joined(tagged: list[tuple[Span, bool, bool]]) -> list[Span]:
    """Spans that one window holds whole, and those put together from the pieces that neighbouring windows hold.

    Pieces of one kind that overlap are one span, however many windows it runs through, if its first piece begins and its last
    one ends for sure.
    """
    out = [span for span, begins, ends in tagged if begins and ends]
    held: dict[str, tuple[int, int, bool, bool]] = {}
    for (kind, a, b), begins, ends in sorted(tagged, key=lambda t: t[0][1:]):
        if begins and ends:
            continue
        start, end, begun, ended = held.get(kind, (0, -1, False, False))
        if a < end:
            held[kind] = (start, max(b, end), begun, ends if b >= end else ended)
        else:
            if begun and ended:
                out.append((kind, start, end))
            held[kind] = (a, b, begins, ends)
    return out + [(kind, start, end) for kind, (start, end, begun, ended) in held.items() if begun and ended]


def reconciled(found: list[Span]) -> list[Span]:
    """Of spans from all windows, the set without overlaps that weighs most."""
    votes = sorted(Counter(found).items(), key=lambda x: (x[0][2], x[0][1], x[0][0]))
    ends = [s[2] for s, _ in votes]
    best: list[tuple[int, int, bool]] = [(0, 0, False)]
    for k, ((_, start, end), n) in enumerate(votes):
        before = int(np.searchsorted(ends, start, "right"))
        take = best[min(before, k)][0] + n * (end - start)
        best.append((take, min(before, k), True) if take > best[k][0] else (best[k][0], k, False))
    out, k = [], len(votes)
    while k:
        _, back, taken = best[k]
        if taken:
            out.append(votes[k - 1][0])
        k = back
    return out[::-1]


def spans_of(texts: list[str], model: Tagger | None, batch: int = 512) -> list[tuple[list[Span], list[Span]]]:
    """For each whole text its base spans and all its spans."""
    base = [base_spans(t) for t in texts]
    found: list[list[tuple[Span, bool, bool]]] = [[] for _ in texts]
    todo = [(k, at) for k, t in enumerate(texts) for at in windows(t)] if model else []
    for i in range(0, len(todo), batch):
        part = todo[i : i + batch]
        labels = model.decode(encoded([texts[k][at : at + WIDTH] for k, at in part], WIDTH))
        for (k, at), row in zip(part, labels, strict=True):
            found[k] += _tagged(row, at, min(WIDTH, len(texts[k]) - at), len(texts[k]))
    out = []
    for text, own, more in zip(texts, base, found, strict=True):
        if more:
            more = reconciled([s for s in joined(more) if plausible(s[0], text, s[1], s[2])])
            own_ends = sorted((a, b) for _, a, b in own)
            more = [s for s in more if not any(a < s[2] and s[1] < b for a, b in own_ends)]
        out.append((own, sorted(own + more, key=lambda s: (s[1], KINDS.index(s[0])))))
    return out


def _labelled(df: DataFrame, spans: bool) -> list[tuple[str, list[Span]]]:
    """At most ``WINDOWS`` windows with a span of the patterns, or with a digit or at sign but no span.

    They are drawn from all texts by hash, so that neither the files' order nor their layout matters, and each kind (of a
    window's first span) has an equal share.
    """

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for text in part.column(0).to_pylist():
                own = base_spans(text)
                pick = random.Random(len(text))
                for at in [max(0, s[1] - pick.randrange(WIDTH - 40)) for s in own] if spans else windows(text):
                    inside = [s for s in own if at <= s[1] and s[2] <= at + WIDTH]
                    if spans == bool(inside) and not any(s[1] < at < s[2] or s[1] < at + WIDTH < s[2] for s in own):
                        rows.append((text[at : at + WIDTH], ",".join(f"{k}:{a - at}:{b - at}" for k, a, b in inside)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["text", "spans"])

    out = []
    cuts = df.where(F.col("text").rlike("[0-9@]")).mapInArrow(cut, "text string, spans string").distinct()
    drawn = Window.partitionBy(F.substring_index("spans", ":", 1)).orderBy(F.xxhash64("text", "spans"), "text", "spans")
    share = WINDOWS // len(KINDS) if spans else WINDOWS
    # A group limit before the shuffle: a task passes on at most a share of each kind.
    for row in cuts.withColumn("place", F.row_number().over(drawn)).where(F.col("place") <= share).orderBy("place", "spans", "text").collect():
        own = [s.split(":") for s in row["spans"].split(",") if s]
        out.append((row["text"], [(k, int(a), int(b)) for k, a, b in own]))
    return out


def _respelled(text: str, spans: list[Span], pick: random.Random) -> tuple[str, list[Span]]:
    """A window with one span written another way: phone numbers without plus or country, emails with blanks."""
    kind, a, b = pick.choice(spans)
    own = text[a:b]
    if kind == "phone":
        new = re.sub(r"^\+[0-9]{1,3}[ .-]*", "", own)
        new = new if pick.random() < 0.5 else re.sub(r"[()]", "", new).strip().replace(" ", pick.choice(" -."))
    elif kind == "email":
        new = own.replace("@", " @ ")
    elif kind == "card" and pick.random() < 0.5:
        d, mark = _digits(own), pick.choice(" -.")
        new = mark.join(d[i : i + 4] for i in range(0, len(d), 4))
    else:
        new = own
    shift = len(new) - len(own)
    moved = [(k, x, y) if y <= a else (k, x + shift, y + shift) if x >= b else (k, a, a + len(new)) for k, x, y in spans]
    return (text[:a] + new + text[b:])[:WIDTH], [s for s in moved if s[2] <= WIDTH]


def train(df: DataFrame, text: str = "text") -> Tagger | None:
    """A tagger for the texts of ``df``, or none where the patterns find nothing."""
    ready(df.sparkSession)
    texts = df.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    good = _labelled(texts, True)
    if not good:
        return None
    pick = random.Random(5)
    rows = good + [_respelled(t, s, pick) for t, s in good] + _labelled(texts, False)
    chars = encoded([t for t, _ in rows], WIDTH)
    labels = np.zeros(chars.shape, np.int64)
    for row, (_, spans) in zip(labels, rows, strict=True):
        for kind, a, b in spans:
            k = KINDS.index(kind)
            row[a], row[a + 1 : b] = 1 + 2 * k, 2 + 2 * k
    return trained(chars, labels, len(KINDS), EPOCHS).single()


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def found(df: DataFrame, model: Tagger | None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, a count for each kind, ``base``, ``spans``): base spans and all spans as ``kind:start:end``."""
    ready(df.sparkSession)
    kind = df.schema[id].dataType.simpleString()
    counts = [f"n_{k}" for k in KINDS]

    def tag(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = spans_of([t or "" for t in part.column(1).to_pylist()], model)
            tally = [Counter(s[0] for s in base) for base, _ in rows]
            numbers = [pa.array([t[k] for t in tally], pa.int64()) for k in KINDS]
            texts = [pa.array([_listed(r[i]) for r in rows], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([part.column(0), *numbers, *texts], ["id", *counts, "base", "spans"])

    schema = f"id {kind}, {', '.join(f'{c} long' for c in counts)}, base string, spans string"
    return df.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(tag, schema).withColumnRenamed("id", id)


def digests(df: DataFrame, model: Tagger | None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``found`` with the SHA-256 of the base spans in their place."""
    rows = found(df, model, id, text)
    return rows.select(id, *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")


def masked_text(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind in angle brackets."""
    out, done = [], 0
    for kind, a, b in spans:
        if a >= done:
            out += [text[done:a], f"<{kind}>"]
        done = max(done, b)
    return "".join(out) + text[done:]


def masked(df: DataFrame, model: Tagger | None, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``df`` with personal data masked in ``text``, and the column ``length`` (if there is one) counted anew.

    A null text stays null.
    """
    ready(df.sparkSession)
    others = [F.col(f"`{c}`") for c in df.columns if c != text]
    own = df.select(F.col(text).alias("text"), F.struct(*(others or [F.lit(0)])).alias("row"))

    def hide(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column(0).to_pylist()
            rows = spans_of([t or "" for t in texts], model)
            new = [None if t is None else masked_text(t, s) for t, (_, s) in zip(texts, rows, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()), part.column(1)], ["text", "row"])

    done = own.mapInArrow(hide, own.schema)
    columns = []
    for c in df.columns:
        kind = df.schema[c].dataType
        if c == text:
            columns.append(F.col("text").alias(c))
        elif c == length:
            columns.append(F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col(f"row.`{c}`")).cast(kind).alias(c))
        else:
            columns.append(F.col(f"row.`{c}`").alias(c))
    return done.select(*columns)
