"""A linear-chain conditional random field over word-shape features, in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np

from txnguard.llm.pii_patterns import KINDS
from txnguard.llm.pii_table import SENTENCES

LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
NEVER = -1e4
STEPS = 400
RATE = 0.1
DECAY = 2e-3
WORD = re.compile(r"\S+")
#: A word can only be labelled if it has a digit, an @ or a bracketed at or dot, or stands beside such a bracket, or beside an
#: at or dot that is spelled out in a row with another one; in upper or lower case.
MARK = re.compile(r"[0-9@]|[(\[{](?:at|dot)[)\]}]", re.ASCII | re.IGNORECASE)
BRACKET = re.compile(r"^[(\[{](?:at|dot)[)\]}]$", re.IGNORECASE)
SPELLED = re.compile(r"(?<!\S)(?:at|dot)\s+\S+\s+dot(?!\S)|(?<!\S)dot\s+\S+\s+at(?!\S)", re.IGNORECASE)
SIGNS = ("at", "dot")
MARKED = re.compile(r"\{(\w+)\|((?:[^{}]|\{(?:at|dot)\})*)\}")

Word = tuple[int, int]


@dataclass(frozen=True)
class Crf:
    """Weights of features by label and of label pairs; row O of ``pairs`` also begins and column O ends a chain."""

    features: dict[str, int]
    weights: np.ndarray
    pairs: np.ndarray


def shape(word: str) -> str:
    """Letters by case, digits by the length of their run, other characters as they are."""
    out = re.sub(r"[0-9]+", lambda m: f"d{min(len(m[0]), 5)}" if len(m[0]) < 12 else "dd", re.sub(r"[^\W\d_]+", lambda m: "X" if m[0][0].isupper() else "x", word))
    return out


def spelled(words: list[str]) -> list[bool]:
    """Which words are an at or dot with another one two words away, of which one is a dot."""
    low = [w.lower() if len(w) < 4 else "" for w in words]
    pair = [a in SIGNS and b in SIGNS and "dot" in (a, b) for a, b in zip(low, low[2:], strict=False)]
    return [w in SIGNS and ((k < len(pair) and pair[k]) or (k > 1 and pair[k - 2])) for k, w in enumerate(low)]


def is_open(words: list[str]) -> list[bool]:
    """Which words can carry a label; all others are no personal data."""
    own = [bool(MARK.search(w)) for w in words]
    mark = [b or bool(BRACKET.match(w)) for w, b in zip(words, spelled(words), strict=True)]
    own = [o or m for o, m in zip(own, mark, strict=True)]
    return [o or (k > 0 and mark[k - 1]) or (k + 1 < len(mark) and mark[k + 1]) for k, o in enumerate(own)]


def features_of(words: list[str], k: int) -> list[str]:
    word = words[k]
    digits = sum(c in "0123456789" for c in word)
    out = ["bias", f"s={shape(word)}", f"n={min(digits, 20)}", f"p={shape(word)[:2]}", f"z={shape(word)[-2:]}"]
    signs = sorted({c for c in word if not c.isalnum()})
    out += [f"c={c}" for c in signs] + [f"no={''.join(signs)}"]
    if BRACKET.match(word):
        out.append("bracket")
    for off in (-2, 0, 2):
        if 0 <= k + off < len(words) and words[k + off].lower() in SIGNS:
            out.append(f"{off}w={words[k + off].lower()}")
    if digits and not re.search(r"[^0-9a-fA-F:]", word) and word.count(":") > 2:
        out.append("colons")
    for name, at in (("b", k - 1), ("a", k + 1)):
        near = words[at] if 0 <= at < len(words) else ""
        out.append(f"{name}s={shape(near) if near else '-'}")
        if near and not MARK.search(near):
            out.append(f"{name}w={near.lower().strip('.,:;!?')}")
        elif BRACKET.match(near):
            out.append(f"{name}bracket")
    return out


def labelled() -> list[tuple[list[str], list[int]]]:
    """The words of each sentence of the table with their labels."""
    out = []
    for line in filter(None, SENTENCES.strip().split("\n")):
        plain, spans, at = "", [], 0
        for m in MARKED.finditer(line):
            plain += line[at : m.start()]
            spans.append((m[1], len(plain), len(plain) + len(m[2])))
            plain, at = plain + m[2], m.end()
        plain += line[at:]
        words = [m.span() for m in WORD.finditer(plain)]
        labels = []
        for s, _ in words:
            kind = next(((k, s == a) for k, a, b in spans if a <= s < b), None)
            labels.append(LABELS.index(f"{'B' if kind[1] else 'I'}-{kind[0]}") if kind else 0)
        out.append(([plain[s:e] for s, e in words], labels))
    return out


def forbidden() -> np.ndarray:
    """An inner label only follows a label of its own kind."""
    out = np.zeros((len(LABELS), len(LABELS)))
    for j, name in enumerate(LABELS):
        if name[0] == "I":
            out[[i for i, before in enumerate(LABELS) if before[2:] != name[2:] or before == "O"], j] = NEVER
    return out


@cache
def trained() -> Crf:
    """Maximum likelihood with decay on the whole table by Adam; a small fixed amount of work, the same every time."""
    rows = labelled()
    index: dict[str, int] = {}
    longest = max(len(w) for w, _ in rows)
    known = [[[index.setdefault(f, len(index)) for f in features_of(w, k)] for k in range(len(w))] for w, _ in rows]
    x = np.zeros((len(rows), longest, len(index)), np.float32)
    gold, mask = np.zeros((len(rows), longest), int), np.zeros((len(rows), longest), bool)
    closed = np.zeros((len(rows), longest, len(LABELS)))
    for r, (words, labels) in enumerate(rows):
        mask[r, : len(words)], gold[r, : len(words)] = True, labels
        for k, (ids, free) in enumerate(zip(known[r], is_open(words), strict=True)):
            x[r, k, ids] = 1
            if not free:
                closed[r, k, 1:] = NEVER
    closed[~mask, 1:] = NEVER  # words beyond the end count as O
    n, limit = len(LABELS), forbidden()
    w, t = np.zeros((len(index), n)), np.zeros((n, n))
    one = np.eye(n)[gold]
    paired = np.concatenate((np.broadcast_to(np.eye(n)[0], (len(rows), 1, n)), one, np.broadcast_to(np.eye(n)[0], (len(rows), 1, n))), axis=1)
    seen_pairs = np.einsum("rti,rtj->ij", paired[:, :-1], paired[:, 1:])
    seen = np.einsum("rtf,rtl->fl", x, one)
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    for step in range(1, STEPS + 1):
        emit, pair = np.where(mask[..., None], x @ w, 0) + closed, t + limit
        p, joint = marginals(emit, pair)
        grads = (np.einsum("rtf,rtl->fl", x, p) - seen + DECAY * len(rows) * w, joint - seen_pairs + DECAY * len(rows) * t)
        for g, value, (m, v) in zip(grads, (w, t), (moments[:2], moments[2:]), strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            value -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Crf(index, w, t + limit)


def marginals(emit: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label chances of each word and expected label pairs, by forward and backward sums in logarithms."""

    def total(a: np.ndarray, axis: int) -> np.ndarray:
        top = a.max(axis=axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))

    length = emit.shape[1]
    ahead = [pair[0] + emit[:, 0]]
    for k in range(1, length):
        ahead.append(total(ahead[-1][:, :, None] + pair, 1) + emit[:, k])
    back = [np.broadcast_to(pair[:, 0], ahead[0].shape)]
    for k in range(length - 1, 0, -1):
        back.append(total(pair + (emit[:, k] + back[-1])[:, None, :], 2))
    back.reverse()
    z = total(ahead[-1] + back[-1], 1)
    joint = np.zeros_like(pair)
    for k in range(1, length):
        joint += np.exp(ahead[k - 1][:, :, None] + pair + (emit[:, k] + back[k])[:, None, :] - z[:, None, None]).sum(axis=0)
    p = np.exp(np.array(ahead).transpose(1, 0, 2) + np.array(back).transpose(1, 0, 2) - z[:, None, None])
    joint[0] += p[:, 0].sum(axis=0)
    joint[:, 0] += p[:, -1].sum(axis=0)
    return p, joint


def viterbi(emit: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """The best labels of chains of one length that stand between words labelled O."""
    best, steps = pair[0] + emit[:, 0], []
    for k in range(1, emit.shape[1]):
        through = best[:, :, None] + pair
        steps.append(through.argmax(axis=1))
        best = through.max(axis=1) + emit[:, k]
    last = (best + pair[:, 0]).argmax(axis=1)
    out = [last]
    for step in reversed(steps):
        out.append(np.take_along_axis(step, out[-1][:, None], 1)[:, 0])
    return np.array(out[::-1]).T


def chains(text: str) -> Iterator[tuple[list[Word], list[list[str]]]]:
    """Runs of words that can be labelled, with their features. A word between two runs is O whatever stands beside it,
    so each run is decoded by itself without any loss."""
    if not MARK.search(text) and not SPELLED.search(text):
        return
    spans = [m.span() for m in WORD.finditer(text)]
    words = [text[s:e] for s, e in spans]
    free, k = is_open(words), 0
    while k < len(words):
        if not free[k]:
            k += 1
            continue
        end = k
        while end < len(words) and free[end]:
            end += 1
        yield spans[k:end], [features_of(words, i) for i in range(k, end)]
        k = end


def decode(crf: Crf, found: list[list[list[str]]]) -> list[np.ndarray]:
    """The labels of each chain; chains of one length are decoded together."""
    out: list[np.ndarray] = [np.zeros(0, int)] * len(found)
    by_length: dict[int, list[int]] = {}
    for k, chain in enumerate(found):
        by_length.setdefault(len(chain), []).append(k)
    for length, group in by_length.items():
        for at in range(0, len(group), max(1, 8192 // length)):
            part = group[at : at + max(1, 8192 // length)]
            emit = np.array([[crf.weights[[crf.features[f] for f in word if f in crf.features]].sum(axis=0) for word in found[k]] for k in part])
            for k, labels in zip(part, viterbi(emit, crf.pairs), strict=True):
                out[k] = labels
    return out
