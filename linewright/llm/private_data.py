"""Personal data: fixed patterns, and a skip-chain conditional random field beside them.

The patterns give the base spans.  The field labels the other words that hold a digit or an ``@``
(words without either are taken as outside): each has potentials from its shape, neighbours in the
text share transition potentials, and distant words that repeat or resemble each other (the same
word, the same last seven digits, the same name before ``@``) share agreement potentials, each
with its next occurrence.  Words in base spans are observed.  Messages are passed in both
directions along all links until they settle; a word whose belief in one kind is high enough is
added, so that what is found once is found again where the patterns miss it.

The field is fitted by pseudo-likelihood to the labels the patterns give on a sample of up to
SAMPLE_DOCUMENTS rows of at most SAMPLE_CANDIDATES such words, chosen by a hash; everything else covers all texts.  Texts are independent,
so there is no shuffle; work and memory go with the length of a text, links included.

Defined results: a NULL text is empty and has no spans; rows are judged each for itself, repeated
ids and NULL ids included; an empty table gives no rows; extra columns are kept by ``masked`` and
ignored by ``private_spans``.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.llm.words import text_bytes

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCUMENTS = 40_000
# Documents of more candidates than this are left out of the fit, not of the search.
SAMPLE_CANDIDATES = 200
LEAST_BELIEF = 0.9
# Agreement of linked words where the sample says nothing else.
AGREEMENT = 4.0
# Rounds over all texts at once, then sweeps over those that need more; the first are not damped.
ROUNDS = 30
SWEEPS = 200
_PLAIN_SWEEPS = 10
SETTLED = 1e-4
TRAINING_STEPS = 200
_LABELS = len(KINDS) + 1
_CHAIN, _SAME, _DIGITS, _NAME = range(4)
_LINKS = 4
_CHUNK_ROWS = 512

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# From the head of a run of digits only: inside it the pattern fails where it fails at the head.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")
_SIGN = re.compile("[0-9@]")
_REST = re.compile(r"[^\x20\x09-\x0D]*")
_RUN = re.compile(r"[0-9]+|[^\W\d_]+")
_WHITE = frozenset(" \t\n\v\f\r")
_EDGE = ".,;:!?\"'<>[]{}"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches around each ``@``: the name before it cannot hold another one."""
    bound, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > bound and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            bound = found.end()
        at = text.find("@", max(at + 1, bound))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, kinds as listed, then by start."""
    spans = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            spans.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                spans.append((3, *m.span()))
    return spans


def candidates(text: str) -> list[tuple[int, int]]:
    """Words that hold a digit or an ``@``."""
    found, end = [], 0
    for m in _SIGN.finditer(text):
        at = m.start()
        if at < end:
            continue
        start = at
        while start > end and text[start - 1] not in _WHITE:
            start -= 1
        end = _REST.match(text, at).end()
        found.append((start, end))
    return found


def _length_class(n: int) -> str:
    return str(n) if n <= 4 else "5-9" if n <= 9 else "10-15" if n <= 15 else "16-19" if n <= 19 else "20-"


def features(word: str) -> list[str]:
    """The word's shape, and coarser signs of it."""
    core = word.strip(_EDGE)
    shape = _RUN.sub(
        lambda m: f"9{_length_class(m.end() - m.start())}" if m.group()[0].isdecimal() else "a", core
    )
    digits = len(_NOT_DIGIT.sub("", core))
    return [
        f"shape {shape[:80]}",
        f"digits {_length_class(digits)}",
        f"at {min(core.count('@'), 2)} dots {min(core.count('.'), 4)}",
        f"first {'9' if core[:1].isdecimal() else 'a' if core[:1].isalpha() else core[:1]}",
        f"letters {any(c.isalpha() for c in core)}",
        "any",
    ]


def link_keys(word: str) -> list[tuple[int, str]]:
    core = word.strip(_EDGE).lower()
    keys = [(_SAME, core)]
    digits = _NOT_DIGIT.sub("", core)
    if len(digits) >= 7 and "@" not in core:
        keys.append((_DIGITS, digits[-7:]))
    if "@" in core:
        keys.append((_NAME, core.partition("@")[0]))
    return keys


@dataclass
class Graph:
    """Candidates of several texts: where they are, what is observed, and their links."""

    text_of: list[int]
    spans: list[tuple[int, int]]
    words: list[str]
    observed: list[int]
    links: list[tuple[int, int, int]]
    alone_left: list[bool]
    alone_right: list[bool]


def build_graph(texts: list[str], base: list[list[tuple[int, int, int]]]) -> Graph:
    graph = Graph([], [], [], [], [], [], [])
    for t, text in enumerate(texts):
        taken = sorted((s, e, kind) for kind, s, e in base[t])
        last: dict[tuple[int, str], int] = {}
        k, before = 0, -1
        for start, end in candidates(text):
            while k < len(taken) and taken[k][1] <= start:
                k += 1
            inside = k < len(taken) and taken[k][0] < end
            node = len(graph.words)
            word = text[start:end]
            near = before >= 0 and not text[graph.spans[before][1] : start].strip(" \t\n\v\f\r")
            if near:
                graph.links.append((before, node, _CHAIN))
                graph.alone_right[before] = False
            for key in link_keys(word):
                if key in last and not (near and last[key] == before):
                    graph.links.append((last[key], node, key[0]))
                last[key] = node
            graph.text_of.append(t)
            graph.spans.append((start, end))
            graph.words.append(word)
            graph.observed.append(taken[k][2] + 1 if inside else -1)
            graph.alone_left.append(not near)
            graph.alone_right.append(True)
            before = node
    return graph


@dataclass
class Field:
    """Weights of the field: features by label, and label pairs by kind of link."""

    index: dict[str, int]
    unary: np.ndarray
    pair: np.ndarray

    def potentials(self, graph: Graph) -> np.ndarray:
        scores = np.zeros((len(graph.words), _LABELS))
        for i, word in enumerate(graph.words):
            for name in features(word):
                if name in self.index:
                    scores[i] += self.unary[self.index[name]]
        # A word without a candidate beside it stands next to one that is outside.
        scores[np.array(graph.alone_left, bool)] += self.pair[_CHAIN, 0]
        scores[np.array(graph.alone_right, bool)] += self.pair[_CHAIN, :, 0]
        seen = np.array(graph.observed)
        for label in range(_LABELS):
            rows = np.flatnonzero(seen == label)
            scores[rows] = -50.0
            scores[rows, label] = 0.0
        return scores


def beliefs(
    unary: np.ndarray, links: np.ndarray, pair: np.ndarray, text_of: np.ndarray | None = None
) -> np.ndarray:
    """Label probabilities of each word by loopy sum-product message passing.

    All texts are flooded together, and each stops when its own messages settle, so a text's result
    does not depend on the others.  Texts that have not settled after ROUNDS, those with long chains
    of repeats, are swept word by word from start to end and back until they do.
    """
    total = unary
    if len(links):
        text_of = np.zeros(len(unary), np.int64) if text_of is None else text_of
        source = np.append(links[:, 0], links[:, 1])
        target = np.append(links[:, 1], links[:, 0])
        table = np.concatenate([pair[links[:, 2]], pair[links[:, 2]].transpose(0, 2, 1)])
        back = np.append(np.arange(len(links)) + len(links), np.arange(len(links)))
        text = text_of[source]
        messages = np.zeros((len(source), unary.shape[1]))
        live = np.ones(int(text.max()) + 1, bool)
        for _ in range(ROUNDS):
            total = unary.copy()
            np.add.at(total, target, messages)
            own = np.flatnonzero(live[text])
            sent = (total[source[own]] - messages[back[own]])[:, :, None] + table[own]
            top = sent.max(axis=1, keepdims=True)
            fresh = np.log(np.exp(sent - top).sum(axis=1)) + top[:, 0]
            fresh -= fresh.max(axis=1, keepdims=True)
            fresh = 0.5 * messages[own] + 0.5 * fresh
            moved = np.zeros(len(live))
            np.maximum.at(moved, text[own], np.abs(fresh - messages[own]).max(axis=1))
            messages[own] = fresh
            live = moved >= SETTLED
            if not live.any():
                break
        for number in np.flatnonzero(live).tolist():
            own = np.flatnonzero(text == number)
            _sweep(unary, source, target, table, back, messages, own)
        total = unary.copy()
        np.add.at(total, target, messages)
    odds = np.exp(total - total.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


def _sweep(
    unary: np.ndarray,
    source: np.ndarray,
    target: np.ndarray,
    table: np.ndarray,
    back: np.ndarray,
    messages: np.ndarray,
    own: np.ndarray,
) -> None:
    """Pass one text's messages in the order of its words, forwards and backwards, in place.

    A pair of sweeps carries evidence along a whole chain, however long.  Later sweeps are damped,
    as loops may swing.
    """
    total = {int(n): unary[n].copy() for n in np.unique(source[own])}
    for edge in own.tolist():
        total[int(target[edge])] += messages[edge]
    ahead = own[source[own] < target[own]]
    behind = own[source[own] > target[own]]
    ahead = ahead[np.argsort(source[ahead], kind="stable")].tolist()
    behind = behind[np.argsort(-source[behind], kind="stable")].tolist()
    for sweep in range(SWEEPS):
        moved = 0.0
        for edge in (*ahead, *behind):
            sent = (total[int(source[edge])] - messages[back[edge]])[:, None] + table[edge]
            top = sent.max(axis=0)
            fresh = np.log(np.exp(sent - top).sum(axis=0)) + top
            fresh -= fresh.max()
            if sweep >= _PLAIN_SWEEPS:
                fresh = 0.5 * messages[edge] + 0.5 * fresh
            change = fresh - messages[edge]
            total[int(target[edge])] += change
            messages[edge] = fresh
            moved = max(moved, float(np.abs(change).max()))
        if moved < SETTLED:
            return


def fit_field(graphs: list[tuple[list[str], list[int], list[tuple[int, int, int]], list, list]]) -> Field:
    """Pseudo-likelihood fit: each word's label given its features and its neighbours' labels."""
    names: dict[str, int] = {}
    rows: list[list[int]] = []
    labels: list[int] = []
    context: list[np.ndarray] = []
    for words, given, links, left, right in graphs:
        around = np.zeros((len(words), 2 * _LINKS * _LABELS))
        for i in range(len(words)):
            around[i, 0] += left[i]
            around[i, _LABELS * _LINKS] += right[i]
        for a, b, kind in links:
            around[b, kind * _LABELS + given[a]] += 1
            around[a, (_LINKS + kind) * _LABELS + given[b]] += 1
        context.append(around)
        labels += given
        rows += [[names.setdefault(f, len(names)) for f in features(w)] for w in words]
    # Weights are drawn towards these: words that repeat or resemble each other agree.
    pair = np.zeros((_LINKS, _LABELS, _LABELS))
    pair[_SAME:] = AGREEMENT * np.eye(_LABELS)
    unary = np.zeros((max(1, len(names)), _LABELS))
    if not labels:
        return Field(names, unary, pair)
    x, y = np.array(rows), np.array(labels)
    c = np.concatenate(context)
    start = np.concatenate([pair, pair]).reshape(-1, _LABELS)
    weights = start.copy()
    target = np.eye(_LABELS)[y]
    rate, decay = 2.0, 1e-4
    for _ in range(TRAINING_STEPS):
        scores = unary[x].sum(axis=1) + c @ weights
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        error = (scores / scores.sum(axis=1, keepdims=True) - target) / len(y)
        step = np.zeros_like(unary)
        for column in range(x.shape[1]):
            np.add.at(step, x[:, column], error)
        unary -= rate * (step + decay * unary)
        weights -= rate * (c.T @ error + decay * (weights - start))
    before = weights[: _LINKS * _LABELS].reshape(_LINKS, _LABELS, _LABELS)
    after = weights[_LINKS * _LABELS :].reshape(_LINKS, _LABELS, _LABELS)
    return Field(names, unary, 0.5 * (before + after.transpose(0, 2, 1)))


def added_spans(graph: Graph, field: Field) -> list[tuple[int, int, int, int]]:
    """(text, kind, start, end) of runs of neighbouring words believed to be of one kind."""
    free = np.array(graph.observed) < 0
    if not free.any():
        return []
    links = np.array(graph.links, np.int64).reshape(-1, 3)
    belief = beliefs(field.potentials(graph), links, field.pair, np.array(graph.text_of))
    label = np.where(free & (belief.max(axis=1) >= LEAST_BELIEF), belief.argmax(axis=1), 0)
    spans: list[list[int]] = []
    last = -2
    for i in np.flatnonzero(label).tolist():
        start, end = graph.spans[i]
        if last == i - 1 and label[last] == label[i] and not graph.alone_left[i]:
            spans[-1][3] = end
        else:
            spans.append([graph.text_of[i], int(label[i]) - 1, start, end])
        last = i
    return [tuple(s) for s in spans]


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start] in _EDGE:
        start += 1
    while end > start and text[end - 1] in _EDGE:
        end -= 1
    return start, end


def _with_signs(batch: pa.RecordBatch) -> np.ndarray:
    """Rows whose text holds a digit or an ``@``; the others have nothing to find."""
    data, offsets = text_bytes(batch.column("text"))
    signs = np.flatnonzero(((data >= 48) & (data <= 57)) | (data == 64))
    return np.flatnonzero(np.diff(np.searchsorted(signs, offsets)))


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [
            ("words", pa.list_(pa.string())),
            ("labels", pa.list_(pa.int32())),
            ("links", pa.list_(pa.list_(pa.int32()))),
            ("left", pa.list_(pa.bool_())),
            ("right", pa.list_(pa.bool_())),
        ]
    )
    for batch in batches:
        rows = []
        for i in _with_signs(batch).tolist():
            text = batch.column("text")[i].as_py()
            graph = build_graph([text], [base_spans(text)])
            if len(graph.words) <= SAMPLE_CANDIDATES:
                rows.append(
                    {
                        "words": graph.words,
                        "labels": [max(0, k) for k in graph.observed],
                        "links": [list(link) for link in graph.links],
                        "left": graph.alone_left,
                        "right": graph.alone_right,
                    }
                )
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def train(docs: DataFrame) -> Field:
    """The field fitted on a sample of ``docs`` (``doc_id``, ``text``)."""
    total = docs.count()
    # A little fewer than the limit, so that it only cuts where one id has very many rows.
    share = min(1.0, 0.95 * SAMPLE_DOCUMENTS / max(1, total))
    picked = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < round(share * 1_000_000)
    found = (
        docs.filter(picked)
        .mapInArrow(
            _examples,
            "words array<string>, labels array<int>, links array<array<int>>, "
            "left array<boolean>, right array<boolean>",
        )
        .limit(SAMPLE_DOCUMENTS)
        .toArrow()
        .to_pylist()
    )
    graphs = [
        (r["words"], r["labels"], [tuple(x) for x in r["links"]], r["left"], r["right"])
        for r in sorted(found, key=lambda r: r["words"])
    ]
    return fit_field(graphs)


def _found(texts: list[str], field: Field) -> tuple[list[list], list[list]]:
    """Base spans and all spans of each text, ordered by kind, then start."""
    base = [base_spans(t) for t in texts]
    graph = build_graph(texts, base)
    every = [list(spans) for spans in base]
    for t, kind, start, end in added_spans(graph, field):
        start, end = _trimmed(texts[t], start, end)
        if start < end:
            every[t].append((kind, start, end))
    return base, [sorted(spans) for spans in every]


def _searched(field: Field, row_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), _CHUNK_ROWS):
                part = batch.slice(first, _CHUNK_ROWS)
                rows = _with_signs(part)
                texts = [part.column("text")[i].as_py() for i in rows.tolist()]
                base, every = _found(texts, field)
                yield row_of(part, rows.tolist(), texts, base, every)

    return run


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for kind, start, end in spans)


_EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def _digest_rows(part, rows, texts, base, every) -> pa.RecordBatch:
    n = len(part)
    counts = np.zeros((len(KINDS), n), np.int64)
    digests, spans = [_EMPTY_SHA256] * n, [""] * n
    for i, own, full in zip(rows, base, every, strict=True):
        for kind, _, _ in own:
            counts[kind, i] += 1
        if own:
            digests[i] = hashlib.sha256(_listed(own).encode()).hexdigest()
        spans[i] = _listed(full)
    return pa.record_batch(
        [part.column("doc_id"), *map(pa.array, counts), pa.array(digests), pa.array(spans)],
        names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
    )


def private_spans(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Counts of base spans per kind, the digest of their list, and the list of all spans."""
    slim = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")
    )
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return slim.mapInArrow(
        _searched(train(slim), _digest_rows), f"doc_id long, {counts}, base_sha256 string, spans string"
    )


def _mask_rows(part, rows, texts, base, every) -> pa.RecordBatch:
    masked = part.column("text").to_pylist()
    for i, text, spans in zip(rows, texts, every, strict=True):
        pieces, at = [], 0
        for start, end, kind in sorted((s, e, k) for k, s, e in spans):
            if end <= at:
                continue
            # Spans of two kinds may overlap; what is left of the second is masked as it.
            pieces.append(text[at : max(at, start)] + f"<{KINDS[kind].upper()}>")
            at = end
        masked[i] = "".join(pieces) + text[at:]
    return pa.record_batch([part.column("row"), pa.array(masked, pa.string())], names=["row", "text"])


def masked(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with each span replaced by the name of its kind; all rows and columns stay."""
    slim = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")
    )
    field = train(slim)
    others = [F.col(c) for c in docs.columns if c != text_column]
    packed = docs.select(F.struct(*others).alias("row"), F.col(text_column).alias("text"))
    out = packed.mapInArrow(_searched(field, _mask_rows), packed.schema)
    return out.select("row.*", F.col("text").alias(text_column)).select(*docs.columns)
