"""The reversible split of whole Arrow arrays of texts, in numpy: characters get kinds, neighbours give the borders of pieces, and the
words are cut out of the texts' bytes all at once. Costs a few passes over a batch, whatever its words are."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Fixed values of the word format.
BLANK, NEWLINE = " ", "\n"
NO_BLANK_AFTER = "#$=-+*/'\"\\(<[]~^&@%_\n "
NO_BLANK_BEFORE = ".,:;?!=-+*/'\"\\)>]~^&@%_\n 1234567890"
NO_WS, WS, LINE = "<|no_ws|>", "<|ws|>", "<|\n|>"
RUN_OF = {WS: "<-ws->", LINE: "<-\n->"}

SPECIAL = re.compile(r"<\|[^\n]*?\|>")
#: bytes of text handled at once; a longer text is handled alone
CHUNK_BYTES = 1 << 20

_SINGLE, _LETTER, _BLANK, _LINE, _TOKEN, _UNKNOWN = range(6)
_kinds = np.full(0x110000, _UNKNOWN, np.uint8)
_kinds[[ord(BLANK), ord(NEWLINE)]] = _BLANK, _LINE


def _kind_of(points: np.ndarray) -> np.ndarray:
    """Kinds of code points: letters and numbers other than decimal digits form runs, anything else stands alone."""
    found = _kinds[points]
    if (found == _UNKNOWN).any():
        for p in np.unique(points[found == _UNKNOWN]).tolist():
            category = unicodedata.category(chr(p))
            _kinds[p] = _LETTER if category[0] in "LN" and category != "Nd" else _SINGLE
        found = _kinds[points]
    return found


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_AFTER, _BEFORE = _table(NO_BLANK_AFTER), _table(NO_BLANK_BEFORE)
#: tokens in the order in which a run uses them, behind the texts' bytes
_TOKENS = [NO_WS] + [w for t in (WS, LINE) for w in (f"<|4{RUN_OF[t]}|>", f"<|2{RUN_OF[t]}|>", t)]
_TOKEN_BYTES = "".join(_TOKENS).encode()
_TOKEN_ENDS = np.cumsum([len(t.encode()) for t in _TOKENS])
_TOKEN_STARTS = _TOKEN_ENDS - [len(t.encode()) for t in _TOKENS]


def _in(table: np.ndarray, points: np.ndarray) -> np.ndarray:
    return table[np.minimum(points, 255)] & (points < 256)


def _segments(text: str, at: int, kinds: np.ndarray, starts: np.ndarray) -> None:
    """Marks a text's special tokens, and stretches between them that look like one, as single pieces of their own."""
    end = 0
    spans = [m.span() for m in SPECIAL.finditer(text)]
    for lo, hi in [*spans, (len(text), len(text))]:
        if lo > end:
            starts[at + end] = True
            if text.startswith("<|", end, lo) and text.endswith("|>", end, lo):
                kinds[at + end : at + lo] = _TOKEN
        if hi > lo:
            starts[at + lo], kinds[at + lo : at + hi] = True, _TOKEN
        end = hi


def _split_chunk(texts: pa.Array) -> pa.ListArray:
    joined = "".join(texts.to_pylist())
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    data = np.frombuffer(joined.encode(), np.uint8)
    sizes = pc.utf8_length(texts).to_numpy().astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    n = len(points)
    if not n:
        return pa.ListArray.from_arrays(pa.array(np.zeros(len(texts) + 1, np.int32)), pa.array([], pa.string()))
    kinds = _kind_of(points)
    head = np.zeros(n + 1, bool)  # first characters of segments, and the end
    head[bounds[:-1][sizes > 0]] = head[n] = True
    special = pc.match_substring(texts, "<|")
    if pc.any(special).as_py():
        for k in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist():
            _segments(texts[k].as_py(), int(bounds[k]), kinds, head)

    border = head[:n].copy()
    border[1:] |= (kinds[1:] != kinds[:-1]) | (kinds[1:] == _SINGLE)
    first = np.flatnonzero(border)
    last = np.append(first[1:], n) - 1
    length, kind = last - first + 1, kinds[first]
    opens, closes = head[first], head[last + 1]
    before, after = points[np.maximum(first - 1, 0)], points[np.minimum(last + 1, n - 1)]
    after_tight = _in(_BEFORE, after)  # blanks and newlines are in both sets
    blank, line = kind == _BLANK, kind == _LINE
    kept = blank & ((length > 1) | opens | closes | _in(_AFTER, before) | after_tight) | line
    missing = ~blank & ~line & ~closes & ~_in(_AFTER, points[last]) & ~after_tight

    fours, twos, ones = length // 4, (length % 4) // 2, length % 2
    counts = np.where(blank | line, np.where(kept, fours + twos + ones, 0), 1 + missing)
    piece = np.repeat(np.arange(len(first)), counts)
    nth = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
    run, token = (blank | line)[piece], np.zeros(len(piece), np.int64)
    step = np.where(nth < fours[piece], 0, np.where((nth == fours[piece]) & (twos[piece] > 0), 1, 2))
    token[run] = (1 + 3 * line[piece] + step)[run]
    plain = ~run & (nth == 0)

    byte = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    source = np.concatenate([data, np.frombuffer(_TOKEN_BYTES, np.uint8)])
    begin = np.where(plain, byte[first[piece]], len(data) + _TOKEN_STARTS[token])
    end = np.where(plain, byte[last[piece] + 1], len(data) + _TOKEN_ENDS[token])
    size = end - begin
    upto = np.concatenate([[0], np.cumsum(size)])
    out = source[np.repeat(begin - upto[:-1], size) + np.arange(upto[-1])]
    words = pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(out)])
    of_text = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(first, bounds)]
    return pa.ListArray.from_arrays(pa.array(of_text.astype(np.int32)), words)


def split(texts: pa.Array) -> pa.ListArray:
    """The words of each text; null for null."""
    filled = pc.fill_null(texts.cast(pa.string()), "")
    upto = np.cumsum(pc.binary_length(filled).to_numpy().astype(np.int64))
    parts, at = [], 0
    while at < len(filled):
        until = (int(upto[at - 1]) if at else 0) + CHUNK_BYTES
        stop = max(at + 1, int(np.searchsorted(upto, until, side="right")))
        parts.append(_split_chunk(filled.slice(at, stop - at)))
        at = stop
    found = pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))
    return pa.ListArray.from_arrays(found.offsets, found.values, mask=pc.is_null(texts)) if texts.null_count else found


RUN = r"^<\|([0-9]+)<-(ws|\n)->\|>$"


def _without_empty_runs(lists: pa.ListArray, runs: dict[str, str]) -> pa.ListArray:
    gone = [w for w, x in runs.items() if not x]
    if not gone:
        return lists
    keep = pc.invert(pc.is_in(lists.values, pa.array(gone))).to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(keep)])
    return pa.ListArray.from_arrays(pa.array(upto[lists.offsets.to_numpy()].astype(np.int32)), lists.values.filter(pa.array(keep)))


def join(words: pa.ListArray) -> pa.Array:
    """The texts that split() made the words from: a blank between two words unless either is a special token, the first one ends
    or the second one begins with a character that has none there."""
    nulls = pc.is_null(words)
    lists = pa.array([[]] * len(words), pa.list_(pa.string())) if words.null_count == len(words) else pc.fill_null(words, pa.scalar([], pa.list_(pa.string())))
    lists = pa.ListArray.from_arrays(pa.array((lists.offsets.to_numpy() - lists.offsets[0].as_py()).astype(np.int32)), pc.fill_null(lists.flatten().cast(pa.string()), ""))
    odd = pc.unique(lists.values.filter(pc.match_substring_regex(lists.values, RUN))).to_pylist()
    runs = {w: (BLANK if m[2] == "ws" else NEWLINE) * int(m[1]) for w in odd for m in [re.match(RUN, w)]}
    lists = _without_empty_runs(lists, runs)
    values, offsets = lists.values, lists.offsets.to_numpy()
    if len(values):
        special = pc.and_(pc.starts_with(values, "<|"), pc.ends_with(values, "|>")).to_numpy(zero_copy_only=False)
        sizes = pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
        data = np.frombuffer(values.cast(pa.binary()).buffers()[2] or b"\0", np.uint8) if sizes.sum() else np.zeros(1, np.uint8)
        starts = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values)].astype(np.int64)
        first, last = data[np.minimum(starts, len(data) - 1)], data[np.clip(starts + sizes - 1, 0, len(data) - 1)]
        tight_first, tight_last = _BEFORE[first] | (sizes == 0) | special, _AFTER[last] | (sizes == 0) | special
        apart = np.zeros(len(values), bool)
        apart[1:] = ~tight_last[:-1] & ~tight_first[1:]
        apart[offsets[:-1][offsets[:-1] < len(values)]] = False
        own = values
        for token, text in {NO_WS: "", WS: BLANK, LINE: NEWLINE, **{w: x for w, x in runs.items() if x}}.items():
            own = pc.if_else(pc.equal(own, token), text, own)
        values = pc.if_else(pa.array(apart), pc.binary_join_element_wise(BLANK, own, ""), own)
    texts = pc.binary_join(pa.ListArray.from_arrays(lists.offsets, values), "")
    return pc.if_else(nulls, pa.scalar(None, pa.string()), texts)
