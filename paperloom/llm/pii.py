"""Personal data: spans by fixed patterns, and more by a character-level BiLSTM-CRF trained on them."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import with_package
from paperloom.llm.tagger import Tagger, char_classes

# The kinds and base patterns of the contract. The look-behind only spares starts inside a run
# of digits; a match that begins in one also begins at its start.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

TRIGGER = re.compile(r"[0-9@]")
MARGIN = 24  # characters around a trigger that are read
WINDOW, STEP = 96, 48
MOST_WINDOWS = 600  # windows that the tagger is trained on, at most
SURE = 0.6
Span = tuple[int, int, int]  # kind, start, end


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(number)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards, so that the time is linear in the text."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            yield start, match.end()
            last = match.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[Span]:
    """The spans of the base patterns, by kind, then start."""
    out: list[Span] = [(0, s, e) for s, e in _emails(text)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return out


def plausible(kind: int, text: str) -> bool:
    """Whether what the tagger marks can be of its kind at all."""
    number = digits(text)
    if kind == 0:
        return bool(re.fullmatch(r"[^@\s]+\s?@\s?[^@\s]+\.[^@\s]+", text))
    if kind == 1:
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 13 <= len(number) <= 19 and luhn(number)
    return 9 <= len(number) <= 15 and len(number) < len(text)


def whole(kind: int, text: str, start: int, end: int) -> tuple[int, int] | None:
    """The span with a bracket that it lacks, or None where it is only a piece of a longer number or address."""
    before, after = text[start - 1 : start], text[end : end + 1]
    if kind == 3 and before == "(" and ")" in text[start:end] and "(" not in text[start:end]:
        start, before = start - 1, text[start - 2 : start - 1]
    if before.isalnum() and text[start].isalnum() or after.isalnum() and text[end - 1].isalnum():
        return None
    if kind in (1, 2) and (re.match(r"[.-]?[0-9]", text[end : end + 2]) or re.search(r"[0-9][.-]?\Z", text[max(0, start - 2) : start])):
        return None
    return start, end


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of the text around digits and @, without which it holds no personal data of these kinds."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        low, high = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and low <= out[-1][1]:
            out[-1][1] = high
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def tags_of(spans: list[Span], low: int, high: int) -> np.ndarray:
    """Tags of a part of a text: 0 outside, 1 + 2 * kind at the first character of a span, 2 + 2 * kind inside."""
    tags = np.zeros(high - low, np.uint8)
    for kind, s, e in spans:
        a, b = max(s, low), min(e, high)
        if a < b:
            tags[a - low : b - low] = 2 + 2 * kind
            if s >= low:
                tags[s - low] = 1 + 2 * kind
    return tags


def _windows(documents: DataFrame, most: int) -> list[tuple[str, bytes]]:
    """Bounded training data: windows with spans of the base patterns and their tags, the first by a hash; a quarter
    of them without spans, so that numbers that are not personal are seen too."""

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, tags = [], []
            for text in batch.column(0).to_pylist():
                if not text or not TRIGGER.search(text):
                    continue
                spans = base_spans(text)
                for low, high in stretches(text):
                    for a in range(low, high, WINDOW):
                        own = tags_of(spans, a, min(a + WINDOW, high))
                        texts.append(text[a : min(a + WINDOW, high)])
                        tags.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(tags, pa.binary())], names=["window", "tags"])

    rows = documents.select(F.col("text").cast("string")).mapInArrow(of_batches, "window string, tags binary").distinct()
    without = F.rtrim(F.hex("tags"), F.lit("0")) == ""
    order = [F.xxhash64("window"), F.col("window")]
    first = rows.where(~without).orderBy(*order).limit(most - most // 4)
    others = rows.where(without).orderBy(*order).limit(most // 4)
    return sorted((r.window, bytes(r.tags)) for r in first.union(others).collect())


def _at_home(phone: str, form: int) -> str:
    """A phone number without its plus (form 0), or in one of three forms without the country's number."""
    found = digits(phone)
    if form == 0 or len(found) < 9:
        return phone[1:]
    area, first, last = found[-10:-7], found[-7:-4], found[-4:]
    return (f"({area}) {first}-{last}", f"{area} {first} {last}", f"{area}-{first}-{last}")[form - 1]


def _examples(windows: list[tuple[str, bytes]], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Windows as character classes and tags; each also with its spans changed or another span beside them."""
    draw = np.random.default_rng(seed)
    spans: list[tuple[int, str]] = []
    for text, tags in windows:
        y = np.frombuffer(tags, np.uint8)
        for s in np.flatnonzero(y % 2 == 1):
            e = s + 1
            while e < len(y) and y[e] == y[s] + 1:
                e += 1
            spans.append((int(y[s] - 1) // 2, text[s:e]))
    pairs = [(t, np.frombuffer(y, np.uint8)) for t, y in windows]
    for text, tags in windows:
        y = np.frombuffer(tags, np.uint8)
        starts = np.flatnonzero(y % 2 == 1)
        if not len(starts):
            continue
        s = int(starts[0])
        if y[s] == 7 and text[s] == "+" and draw.random() < 0.6:  # a phone number without its plus, or as it is written at home
            e = s + 1
            while e < len(y) and y[e] == 8:
                e += 1
            other = _at_home(text[s:e], int(draw.integers(4)))
            mark = np.array([7, *[8] * (len(other) - 1)], np.uint8)
            pairs.append((text[:s] + other + text[e:], np.concatenate([y[:s], mark, y[e:]])))
        else:  # another span before the first, after a blank
            kind, other = spans[int(draw.integers(len(spans)))]
            mark = np.array([1 + 2 * kind, *[2 + 2 * kind] * (len(other) - 1), 0], np.uint8)
            pairs.append((f"{text[:s]}{other} {text[s:]}", np.concatenate([y[:s], mark, y[s:]])))
    x, y = np.zeros((len(pairs), WINDOW), np.uint8), np.zeros((len(pairs), WINDOW), np.uint8)
    for k, (text, tags) in enumerate(pairs):
        n = min(WINDOW, len(text))
        x[k, :n], y[k, :n] = char_classes(text[:n]), tags[:n]
    return x, y


def train(documents: DataFrame, most_windows: int = MOST_WINDOWS, epochs: int = 20) -> Tagger | None:
    """A tagger from the labelled spans of the base patterns, on at most ``most_windows`` windows of the corpus
    (the first by a hash, a quarter of them without spans) and as many changed ones; None where the corpus has no such
    span."""
    with_package(documents.sparkSession)
    windows = _windows(documents, most_windows)
    if not any(any(tags) for _, tags in windows):
        return None
    tagger = Tagger(1 + 2 * len(KINDS))
    tagger.fit(*_examples(windows), epochs=epochs)
    return tagger


def tagged(tagger: Tagger, parts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Spans (kind, start, end) that the tagger finds in each part of a text.

    Long parts are read in overlapping windows; every character's scores are their mean, weighted towards
    the middle of a window, and the tags are then decoded over the whole part at once.
    """
    x, owner, at = [], [], []
    for k, part in enumerate(parts):
        codes = char_classes(part)
        for a in range(0, max(1, len(codes) - WINDOW + STEP), STEP):
            row = np.zeros(WINDOW, np.uint8)
            row[: len(codes[a : a + WINDOW])] = codes[a : a + WINDOW]
            x.append(row)
            owner.append(k)
            at.append(a)
    scores: list[np.ndarray] = [np.zeros((len(p), tagger.tags), np.float32) for p in parts]
    weight = [np.zeros(len(p), np.float32) for p in parts]
    slope = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)
    for low in range(0, len(x), 1024):
        found = tagger.emissions(np.array(x[low : low + 1024]))
        for e, k, a in zip(found, owner[low : low + 1024], at[low : low + 1024], strict=True):
            n = min(WINDOW, len(parts[k]) - a)
            scores[k][a : a + n] += e[:n] * slope[:n, None]
            weight[k][a : a + n] += slope[:n]
    out: list[list[tuple[int, int, int]]] = [[] for _ in parts]
    order = sorted(range(len(parts)), key=lambda k: len(parts[k]))
    groups: list[list[int]] = []
    for k in order:  # parts of like length are decoded side by side
        if groups and len(groups[-1]) < 512 and len(parts[k]) <= 1.25 * len(parts[groups[-1][0]]) + 8:
            groups[-1].append(k)
        else:
            groups.append([k])
    for group in groups:
        longest = max(len(parts[k]) for k in group)
        if not longest:
            continue
        padded = np.zeros((len(group), longest, tagger.tags), np.float32)
        for row, k in enumerate(group):
            padded[row, : len(parts[k])] = scores[k] / weight[k][:, None]
            padded[row, len(parts[k]) :, 0] = 50  # nothing follows
        tags = tagger.decode(padded)
        likely = np.exp(padded - padded.max(2, keepdims=True))
        likely /= likely.sum(2, keepdims=True)
        for row, k in enumerate(group):
            y = tags[row, : len(parts[k])]
            for s in np.flatnonzero(y % 2 == 1):
                e = int(s) + 1
                while e < len(y) and y[e] == y[s] + 1:
                    e += 1
                kind = int(y[s] - 1) // 2
                sure = likely[row, s:e, [1 + 2 * kind, 2 + 2 * kind]].sum(0).mean()
                if sure >= SURE:
                    out[k].append((kind, int(s), e))
    return out


def find(texts: list[str | None], tagger: Tagger | None) -> list[tuple[list[Span], list[Span]]]:
    """For each text the spans of the base patterns, and all spans: these and what the tagger adds beside them."""
    base = [base_spans(t) if t and TRIGGER.search(t) else [] for t in texts]
    places = [(k, a, b) for k, t in enumerate(texts) if t for a, b in stretches(t)] if tagger else []
    more: list[list[Span]] = [[] for _ in texts]
    marks = tagged(tagger, [texts[k][a:b] for k, a, b in places]) if places else []
    for (k, a, _), spans in zip(places, marks, strict=True):
        for kind, s, e in spans:
            text = texts[k][a + s : a + e]
            s, e = s + len(text) - len(text.lstrip()), e - len(text) + len(text.rstrip())
            place = whole(kind, texts[k], a + s, a + e) if s < e else None
            if place and not any(x[1] < place[1] and place[0] < x[2] for x in base[k]) and plausible(kind, texts[k][slice(*place)]):
                more[k].append((kind, *place))
    return [(b, sorted({*b, *m})) for b, m in zip(base, more, strict=True)]


def spans_in(documents: DataFrame, tagger: Tagger | None) -> DataFrame:
    """``doc_id, base, spans`` for every row: spans as arrays of kind, start and end (code points, end exclusive)."""

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

        def column(rows: list[list[Span]]) -> pa.Array:
            return pa.array([[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in row] for row in rows], kind)

        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                found = find(part.column(1).to_pylist(), tagger)
                yield pa.RecordBatch.from_arrays([part.column(0), column([f[0] for f in found]), column([f[1] for f in found])], names=["doc_id", "base", "spans"])

    with_package(documents.sparkSession)
    rows = documents.select("doc_id", F.col("text").cast("string"))
    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    return rows.mapInArrow(of_batches, f"doc_id {dict(rows.dtypes)['doc_id']}, base {span}, spans {span}")


def detect(documents: DataFrame, most_windows: int = MOST_WINDOWS, epochs: int = 20) -> DataFrame:
    """Personal data in every row's text; see ``train`` and ``spans_in``.

    The base patterns give the labelled spans; the tagger adds what they miss, such as numbers that run into
    each other or lack a mark. Its additions must not overlap a base span, must be of a possible form, and must not
    be a piece of a longer number.
    Null and empty texts have no spans; repeated rows come back repeated; rows without an id are read too; an
    empty table gives an empty result; other columns are ignored. Time is linear in the text, of which only
    the parts around digits and @ go through the network.
    """
    return spans_in(documents, train(documents, most_windows, epochs))


def digest(documents: DataFrame) -> DataFrame:
    """The spans as counts of the base patterns, a hash of their spans, and all spans as text."""
    found = detect(documents)

    def text(column: str):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
