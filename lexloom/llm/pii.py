"""Personal data: base patterns, and a linear-chain conditional random field over word-shape features that adds to them.

The patterns give spans of kinds email, ip, card and phone. The model is trained on the driver from a small labelled
table, and decoded by Viterbi in numpy over all sentences of a batch at once; it adds spans of its own kinds where they
overlap no base span. Positions are code points, the end exclusive.

Defined results: null and empty texts have no spans. Repeated rows each give a row, an empty table gives none, other
columns are left alone. Texts of any length are read whole; ``mask`` keeps every row and column.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from operator import ne

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import pii_labels
from lexloom.llm.words import slices

Span = tuple[str, int, int]
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, *pii_labels.KINDS)
CACHE = 400_000
#: tokens decoded at once
BLOCK = 150_000
#: rows under which a loop over tags costs more than it saves
FEW = 32

DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match never starts inside a run of digits: the run's start would have matched, or fails as its inside does.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def base_spans(text: str) -> list[Span]:
    """In order of kind, then start. Addresses are found from their @ signs, so that long runs cost linear time."""
    out: list[Span] = []
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", at + 1)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if 16 <= len(d := _only_digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= len(_only_digits(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


# ---- features


CUES = frozenset(
    "call phone tel tel: telefon telefon: téléphone teléfono mobile fax ring number phone: fax: mail email e-mail e-mail: email: contact write to at (at) [at] dot (dot) [dot] "
    "token token: key key: api_key api_key: apikey password password: passwd pwd pwd: secret secret: bearer access aws passwort: contraseña: clave passe = : is or and + | - "
    "ssn ssn: social security passport dni nie: steuernummer personalausweis sécurité sociale passeport national id licence insurance no. my cell: tel. tel.: tél. text al "
    "com org net de fr es edu io .com {at} {dot} <at> <dot> -at- -dot-".split()
)
_UP, _LOW, _DIG = re.compile(r"[^\W\d_a-zß-ÿ]+"), re.compile(r"[a-zß-ÿ]+"), re.compile(r"[0-9]+")
_RUNS = re.compile(r"[0-9]+|[^\W\d_]+")
_NO_DIGITS = dict.fromkeys(map(ord, "0123456789"))
ENDS = frozenset(".!?;")


def token_features(token: str) -> tuple[str, ...]:
    """Word-shape features: the collapsed shape, length, digits, mix of letters and digits, and the token if it is a cue."""
    head = token[:64]
    digits = len(head) - len(head.translate(_NO_DIGITS)) if _DIG.search(head) else 0
    shape = _DIG.sub("9", _LOW.sub("a", _UP.sub("A", head.replace("9", "0"))))[:10]
    out = ["s:" + shape, f"l:{min(len(token), 40) // 4}", f"d:{min(digits, 12)}"]
    if digits and any(map(str.isalpha, head)):
        kinds = list(map(str.isdigit, head))
        switches = sum(map(ne, kinds, kinds[1:]))
        out.append(f"m:{min(switches, 8) // 2}{len(head) >= 14}")
    low = token.lower().rstrip(".,;") or token.lower()
    if low in CUES or token.lower() in CUES:
        out.append("w:" + low)
    if head.isalnum():
        out.append(f"k:{head.islower()}{head.isupper()}{bool(digits)}{min(len(head), 40) // 8}")
    if digits:  # lengths of the first runs of digits and what is between them
        out.append("r:" + _RUNS.sub(lambda m: str(min(len(m[0]), 9)) if m[0][0] in "0123456789" else "a", head)[:9])
    return tuple(out)


# ---- model


@dataclass(frozen=True)
class CrfModel:
    """weights[place, feature, tag]: place 0 the token itself, 1 the one before, 2 the one after."""

    tags: tuple[str, ...]
    features: dict[str, int]
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray

    def tables(self, token: str) -> np.ndarray:
        ids = [i for f in token_features(token) if (i := self.features.get(f)) is not None]
        return self.weights[:, ids].sum(axis=1) if ids else np.zeros((3, len(self.tags)))


def _allowed(tags: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    start = np.array([t[0] != "I" for t in tags])
    follow = np.array([[b[0] != "I" or a[2:] == b[2:] and a != "O" for b in tags] for a in tags])
    return start, follow


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(rows: list[list[tuple[str, str]]], epochs: int = 8, rate: float = 0.3, decay: float = 2e-3) -> CrfModel:
    """Maximum likelihood by gradient ascent, a sentence at a time (Adagrad); deterministic."""
    tags = ("O", *[f"{p}-{k}" for k in pii_labels.KINDS for p in "BI"])
    number = {t: i for i, t in enumerate(tags)}
    names = sorted({f for row in rows for token, _ in row for f in token_features(token)})
    features = {f: i for i, f in enumerate(names)}
    data = [([[features[f] for f in token_features(t)] for t, _ in row], [number[y] for _, y in row]) for row in rows]
    ok_start, ok = _allowed(tags)
    w = np.zeros((3, len(names), len(tags)))
    trans, start = np.where(ok, 0.0, -1e4), np.where(ok_start, 0.0, -1e4)
    gw, gt, gs = np.full_like(w, 1e-8), np.full_like(trans, 1e-8), np.full_like(start, 1e-8)
    order = np.random.RandomState(7)
    for _ in range(epochs):
        for k in order.permutation(len(data)):
            ids, y = data[k]
            n = len(ids)
            e = np.zeros((n, len(tags)))
            for i in range(n):
                e[i] += w[0, ids[i]].sum(axis=0)
                if i:
                    e[i] += w[1, ids[i - 1]].sum(axis=0)
                if i + 1 < n:
                    e[i] += w[2, ids[i + 1]].sum(axis=0)
            a, b = np.empty_like(e), np.zeros_like(e)
            a[0] = start + e[0]
            for i in range(1, n):
                a[i] = e[i] + _logsum(a[i - 1][:, None] + trans, 0)
            for i in range(n - 2, -1, -1):
                b[i] = _logsum(trans + (e[i + 1] + b[i + 1])[None], 1)
            z = _logsum(a[-1][None], 1)[0]
            miss = -np.exp(a + b - z)  # observed minus expected
            miss[np.arange(n), y] += 1
            dt = np.zeros_like(trans)
            for i in range(1, n):
                dt -= np.exp(a[i - 1][:, None] + trans + (e[i] + b[i])[None] - z)
                dt[y[i - 1], y[i]] += 1
            for i in range(n):
                for place, at in ((0, i), (1, i - 1), (2, i + 1)):
                    if 0 <= at < n:
                        f = ids[at]
                        g = miss[i] - decay * w[place, f]
                        gw[place, f] += g * g
                        w[place, f] += rate * g / np.sqrt(gw[place, f])
            dt = np.where(ok, dt - decay * trans, 0)
            gt += dt * dt
            trans += rate * dt / np.sqrt(gt)
            ds = np.where(ok_start, miss[0], 0)
            gs += ds * ds
            start += rate * ds / np.sqrt(gs)
    return CrfModel(tags, features, w, trans, start)


# ---- decoding


class Decoder:
    """Viterbi over all sentences of a block; tokens with the same features share a row of the score tables."""

    def __init__(self, model: CrfModel):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.by_token: dict[str, int] = {}
        self.by_features: dict[tuple, int] = {}
        self.rows: list[np.ndarray] = []
        self.ends: list[bool] = []
        self.stacked = None

    def number(self, token: str) -> int:
        key = (token_features(token), token[-1] in ENDS)
        n = self.by_features.get(key)
        if n is None:
            n = self.by_features[key] = len(self.rows)
            self.rows.append(self.model.tables(token).astype(np.float32))
            self.ends.append(key[1])
            self.stacked = None
        self.by_token[token] = n
        return n

    def tags(self, texts: list[list[str]]) -> list[np.ndarray | None]:
        """For each token list its tags, or None where all are O."""
        if len(self.by_token) > CACHE:
            self.clear()
        get, ids = self.by_token.get, []
        for tokens in texts:
            ids += [n if (n := get(t)) is not None else self.number(t) for t in tokens]
        sizes = np.array([len(t) for t in texts])
        if not ids:
            return [None] * len(texts)
        ids = np.array(ids)
        if self.stacked is None:
            self.stacked = (np.ascontiguousarray(np.stack(self.rows, axis=1)), np.array(self.ends))
        tables, ends = self.stacked
        last = ends[ids]
        last[np.cumsum(sizes[sizes > 0]) - 1] = True
        found = self.viterbi(ids, last, tables)
        out, at = [], 0
        for n in sizes:
            part = found[at : at + n]
            out.append(part if part.any() else None)
            at += n
        return out

    @staticmethod
    def best_before(best: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row and tag the best score over the tags before it, and the first tag that gives it."""
        if len(best) < FEW:
            score = best[:, :, None] + trans
            from_ = score.argmax(axis=1)
            return np.take_along_axis(score, from_[:, None], 1)[:, 0], from_.astype(np.int8)
        # a tag after another over all rows: argmax along so short an axis costs several times as much
        top = best[:, :1] + trans[0]
        from_ = np.zeros(top.shape, np.int8)
        for tag in range(1, len(trans)):
            score = best[:, tag : tag + 1] + trans[tag]
            np.copyto(from_, tag, where=score > top)
            np.maximum(top, score, out=top)
        return top, from_

    def viterbi(self, ids: np.ndarray, last: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Best tag of each token; last marks the ends of sentences."""
        inside = ~last[:-1]
        e = tables[0, ids]
        e[1:][inside] += tables[1, ids[:-1][inside]]
        e[:-1][inside] += tables[2, ids[1:][inside]]
        stop = np.flatnonzero(last) + 1
        begin = np.concatenate([[0], stop[:-1]])
        order = np.argsort(begin - stop, kind="stable")  # longest first
        begin, length = begin[order], (stop - begin)[order]
        trans, start = self.model.transitions.astype(np.float32), self.model.start.astype(np.float32)
        best = start + e[begin]
        steps = int(length[0])
        active = np.searchsorted(-length, -np.arange(1, steps + 1), side="right")
        back = []
        final = np.empty((len(begin), len(start)), np.float32)
        for t in range(1, steps):
            n = active[t]
            final[n : len(best)] = best[n:]
            top, from_ = self.best_before(best[:n], trans)
            back.append(from_)
            best = top + e[begin[:n] + t]
        final[: len(best)] = best
        out = np.zeros(len(ids), np.int8)
        tag = final.argmax(axis=1)
        if not tag.any() and not any(b.shape[0] and (b[:, 0] != 0).any() for b in back):
            return out
        out[begin + length - 1] = tag
        for t in range(steps - 1, 0, -1):
            n = active[t]
            tag[:n] = back[t - 1][np.arange(n), tag[:n]]
            out[begin[:n] + t - 1] = tag[:n]
        return out


TOKEN = re.compile(r"\S+")
_TRIM = "\"'.,;:!?#$%&*|<>"


def model_spans(text: str, tags: np.ndarray, names: tuple[str, ...], taken: list[Span]) -> list[Span]:
    """Spans of tagged tokens, trimmed of quotes and stops, that overlap none of those taken."""
    out: list[Span] = []
    current: list | None = None
    for m, tag in zip(TOKEN.finditer(text), tags):
        name = names[tag]
        if name[0] == "I" and current:
            current[2] = m.end()
            continue
        if current:
            out.append(tuple(current))
        current = [name[2:], m.start(), m.end()] if name != "O" else None
    if current:
        out.append(tuple(current))
    kept, held = [], sorted((x, y) for _, x, y in taken)
    starts, ends = [x for x, _ in held], list(accumulate((y for _, y in held), max))
    for kind, a, b in out:
        while a < b and text[a] in _TRIM:
            a += 1
        while a < b and text[b - 1] in _TRIM:
            b -= 1
        before = bisect_left(starts, b)  # of those that start before b, does one end behind a?
        if a < b and not (before and ends[before - 1] > a):
            kept.append((kind, a, b))
    return kept


def find_all(texts: list[str], decoder: Decoder) -> list[list[Span]]:
    """Base spans, then the model's, of each text."""
    out, at = [], 0
    while at < len(texts):
        end, tokens, n = at, [], 0
        while end < len(texts) and (n < BLOCK or end == at):
            tokens.append(texts[end].split())
            n += len(tokens[-1])
            end += 1
        for text, tags in zip(texts[at:end], decoder.tags(tokens)):
            spans = base_spans(text)
            more = model_spans(text, tags, decoder.model.tags, spans) if tags is not None else []
            out.append(sorted(spans + more, key=lambda s: (KINDS.index(s[0]), s[1])))
        at = end
    return out


SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_spans(docs: DataFrame, model: CrfModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end) by kind as listed in KINDS, then start; one pass, no shuffle."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model)
        for batch in slices(batches, 1):
            found = find_all([t or "" for t in batch.column(1).to_pylist()], decoder)
            spans = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in found], _SPANS)
            yield pa.RecordBatch.from_arrays([batch.column(0), spans], ["doc_id", "spans"])

    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, spans {SPANS}")


def mask(docs: DataFrame, model: CrfModel, text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; overlapping spans are replaced as one, by the first's kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model)
        for batch in slices(batches, text_col):
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).to_pylist()
            new = [t if t is None else _masked(t, s) for t, s in zip(texts, find_all([t or "" for t in texts], decoder))]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def _masked(text: str, spans: list[Span]) -> str:
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"<{kind}>"]
        done = max(done, b)
    return "".join(out) + text[done:]
