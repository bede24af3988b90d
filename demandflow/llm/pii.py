"""Operator 3: personal data by patterns and a character-level bidirectional LSTM with CRF transitions.

The patterns give the base spans.  The tagger is trained in numpy on a bounded sample of documents, from the spans
that the patterns label there and from the same spans in disguises that the patterns miss (an address
with ``(at)`` or a bare ``at`` and ``dot``, a phone number without its plus, card groups parted by dots, an address part by
part), and from places without personal data.  Its gates are piecewise linear (clipped lines in place of the logistic and the
hyperbolic functions), in training and scoring alike.  It reads every text from its first character to its last in
overlapping windows.  Where two windows overlap, their tag scores are joined with weights that pass from one to the other, and the
best path through the CRF transitions is found for each text as a whole: places that are on no path but the
"none" path part it into runs, which Viterbi decodes.  Spans found that way are added where no base span lies.
Scoring is one narrow pass.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandflow.llm.common import batches_of, frame, schema_with, table

KINDS = ("email", "ip", "card", "phone")
#: Base patterns (fixed), cut so that each is found in linear time: an e-mail's host after its @, runs of dotted numbers
HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A text without this character has no base span of the kind
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
DIGIT = re.compile("[0-9]")
#: Places that training windows are taken around; scoring reads every place
CUE = re.compile(r"[0-9@]|[\[(] ?[Aa][Tt] ?[\])]")

#: Bounds of the training sample: documents, characters of each that may count, windows around cues and as many without
TRAIN_DOCS, TRAIN_CHARS, TRAIN_WINDOWS = 600, 20_000, 1000
#: Characters of a training window, and of a scored one, which shares SHARED with the next
TRAIN_WINDOW, TRAIN_APART = 96, 48
WINDOW, SHARED = 512, 48
STRIDE = WINDOW - SHARED
#: A text's last window is filled up to a multiple of this
ROUND = 128
EMBED, HIDDEN, EPOCHS, BATCH, RATE = 12, 16, 10, 50, 0.02
TAGS = 1 + 2 * len(KINDS)  # none; begin and inside of each kind
#: Mean probability (of the CRF), over its places, that an added span is in some span
SURE = 0.8
#: Fewest and most digits of an added span (a card's pass Luhn, too)
DIGITS = {"email": (0, 64), "ip": (4, 12), "card": (13, 19), "phone": (9, 15)}
PIECE_BYTES = 4 << 20
#: Windows scored at once, windows whose scores are held at once (more if one text has more), and steps of a window that are sifted at once
ROWS, HELD, STEPS = 1024, 4096, 16


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _valid(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in found.split("."))
    if kind == "card":
        digits = re.sub("[ -]", "", found)
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(DIGIT.findall(found)) <= 15
    return True


def _emails(text: str):
    """Leftmost e-mails: from each @ to the left as far as names go (or the last e-mail), to the right by the host."""
    end, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > end and text[lo - 1] in NAME:
            lo -= 1
        host = HOST.match(text, at + 1) if lo < at else None
        if host:
            end = host.end()
            yield lo, end
        at = text.find("@", max(at + 1, end))


def _addresses(text: str):
    """Leftmost runs of four dotted numbers."""
    for m in DOTTED.finditer(text):
        lo, parts = m.start(), m[0].split(".")
        for i in range(0, len(parts) - 3, 4):
            n = sum(map(len, parts[i:i + 4])) + 3
            yield lo, lo + n
            lo += n + 1


FINDERS = {"email": _emails, "ip": _addresses, "card": lambda text: (m.span() for m in CARD.finditer(text)),
           "phone": lambda text: (m.span() for m in PHONE.finditer(text))}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind as listed, then start; in time linear in the text."""
    out = []
    has_digit = DIGIT.search(text) is not None
    for kind in KINDS:
        if (has_digit or kind == "email") and NEEDS[kind] in text:
            out += [(kind, lo, hi) for lo, hi in FINDERS[kind](text) if _valid(kind, text[lo:hi])]
    return out


# --- the tagger ---------------------------------------------------------------------------------

@functools.cache
def _symbol_table() -> np.ndarray:
    """The id of each code point."""
    ids = np.array([128 if chr(x).isalpha() else 129 for x in range(sys.maxunicode + 1)], np.uint8)
    ids[:128] = np.arange(128)
    for x in range(128, sys.maxunicode + 1):
        if chr(x).isdecimal():
            ids[x] = 48 + unicodedata.decimal(chr(x))
    return ids


def symbols(text: str) -> np.ndarray:
    """Ids of characters: ASCII as they are, digits of any script as ASCII ones, letters beyond ASCII 128, anything else 129."""
    return _symbol_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def digits_of(text: str) -> str:
    """The digits of a text, of any script, as ASCII ones."""
    return "".join(DIGIT.findall(text)) if text.isascii() else "".join(str(unicodedata.decimal(c)) for c in text if c.isdecimal())


def _gate(x):
    """The clipped line that stands for the logistic function."""
    return np.clip(0.25 * x + 0.5, 0, 1)


def _new(x):
    """The clipped line that stands for the hyperbolic tangent."""
    return np.clip(x, -1, 1)


def new_model(seed: int = 3) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    m = {"E": r.normal(0, 0.3, (131, EMBED)), "Wo": r.normal(0, 0.2, (2 * HIDDEN, TAGS)), "bo": np.zeros(TAGS), "T": np.zeros((TAGS, TAGS))}
    for d in "fb":
        m["Wx" + d] = r.normal(0, EMBED**-0.5, (EMBED, 4 * HIDDEN))
        m["Wh" + d] = r.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
        m["b" + d] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]  # forget gates start open
    return m


def _lstm(x, wx, wh, b):
    """Hidden states (time first) and what the backward pass needs; gates in the order input, forget, output, new."""
    t, n, _ = x.shape
    z = x @ wx + b
    h, c, keep = np.zeros((n, HIDDEN), x.dtype), np.zeros((n, HIDDEN), x.dtype), []
    out = np.empty((t, n, HIDDEN), x.dtype)
    for i in range(t):
        a = z[i] + h @ wh
        g = _gate(a[:, :3 * HIDDEN])
        u = _new(a[:, 3 * HIDDEN:])
        before = c
        c = g[:, HIDDEN:2 * HIDDEN] * c + g[:, :HIDDEN] * u
        s = _new(c)
        keep.append((h, before, g, u, s))
        h = g[:, 2 * HIDDEN:] * s
        out[i] = h
    return out, keep


def _lstm_back(x, wx, wh, keep, dout):
    t, n, _ = x.shape
    dz = np.empty((t, n, 4 * HIDDEN), x.dtype)
    dh, dc = np.zeros((n, HIDDEN), x.dtype), np.zeros((n, HIDDEN), x.dtype)
    dwh = np.zeros_like(wh)
    for i in range(t - 1, -1, -1):
        h, before, g, u, s = keep[i]
        gi, gf, go = g[:, :HIDDEN], g[:, HIDDEN:2 * HIDDEN], g[:, 2 * HIDDEN:]
        dh = dh + dout[i]
        dc = dc + dh * go * (np.abs(s) < 1)
        slope = 0.25 * ((g > 0) & (g < 1))
        da = np.concatenate([np.concatenate([dc * u, dc * before, dh * s], axis=1) * slope, dc * gi * (np.abs(u) < 1)], axis=1)
        dz[i] = da
        dwh += h.T @ da
        dh, dc = da @ wh.T, dc * gf
    return np.einsum("tne,tng->eg", x, dz), dwh, dz.sum(axis=(0, 1)), dz @ wx.T


def emissions(m: dict, ids: np.ndarray, keep: bool = False):
    """Tag scores (time, window, tag) of windows of symbols (window, time)."""
    x = m["E"][ids.T]
    f, kf = _lstm(x, m["Wxf"], m["Whf"], m["bf"])
    b, kb = _lstm(x[::-1], m["Wxb"], m["Whb"], m["bb"])
    h = np.concatenate([f, b[::-1]], axis=2)
    e = h @ m["Wo"] + m["bo"]
    return (e, (x, h, kf, kb)) if keep else e


def _lse(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def marginals(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Probability of each tag at each place for scores (time, row, tag)."""
    a, b = np.empty_like(e), np.zeros_like(e)
    a[0] = e[0]
    for i in range(1, len(e)):
        a[i] = e[i] + _lse(a[i - 1][:, :, None] + trans, 1)
    for i in range(len(e) - 2, -1, -1):
        b[i] = _lse(trans + (e[i + 1] + b[i + 1])[:, None, :], 2)
    return np.exp(a + b - _lse(a[-1], 1)[None, :, None])


def crf_gradient(e: np.ndarray, trans: np.ndarray, tags: np.ndarray):
    """Mean negative log likelihood and its gradients for scores (time, window, tag) and tags (time, window)."""
    t, n, k = e.shape
    a, b = np.empty_like(e), np.zeros_like(e)
    a[0] = e[0]
    for i in range(1, t):
        a[i] = e[i] + _lse(a[i - 1][:, :, None] + trans, 1)
    for i in range(t - 2, -1, -1):
        b[i] = _lse(trans + (e[i + 1] + b[i + 1])[:, None, :], 2)
    total = _lse(a[-1], 1)
    de = np.exp(a + b - total[None, :, None])
    rows = np.arange(n)
    gold = sum(e[i, rows, tags[i]] for i in range(t)) + sum(trans[tags[i - 1], tags[i]] for i in range(1, t))
    dt = np.zeros_like(trans)
    for i in range(1, t):
        dt += np.exp(a[i - 1][:, :, None] + trans + (e[i] + b[i])[:, None, :] - total[:, None, None]).sum(axis=0)
        np.add.at(dt, (tags[i - 1], tags[i]), -1)
    for i in range(t):
        de[i, rows, tags[i]] -= 1
    return float((total - gold).mean()), de / n, dt / n


def gradient(m: dict, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
    """Loss and gradient for windows of symbols and tags (window, time)."""
    e, (x, h, kf, kb) = emissions(m, ids, keep=True)
    loss, de, dt = crf_gradient(e, m["T"], tags.T)
    g = {"T": dt, "Wo": np.einsum("tnh,tnk->hk", h, de), "bo": de.sum(axis=(0, 1))}
    dh = de @ m["Wo"].T
    g["Wxf"], g["Whf"], g["bf"], dx = _lstm_back(x, m["Wxf"], m["Whf"], kf, dh[:, :, :HIDDEN])
    g["Wxb"], g["Whb"], g["bb"], dxb = _lstm_back(x[::-1], m["Wxb"], m["Whb"], kb, dh[::-1, :, HIDDEN:])
    g["E"] = np.zeros_like(m["E"])
    np.add.at(g["E"], ids.T, dx + dxb[::-1])
    return loss, g


def train(windows: np.ndarray, tags: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> dict:
    m, r, step = new_model(seed), np.random.default_rng(seed), 0
    mean = {k: np.zeros_like(v) for k, v in m.items()}
    var = {k: np.zeros_like(v) for k, v in m.items()}
    for epoch in range(epochs):
        order = r.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            pick = order[at:at + BATCH]
            _, g = gradient(m, windows[pick], tags[pick])
            step += 1
            rate = RATE * (1 - 0.8 * epoch / epochs)
            size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            for k in m:
                d = g[k] * min(1.0, 5.0 / (size + 1e-9))
                mean[k] = 0.9 * mean[k] + 0.1 * d
                var[k] = 0.999 * var[k] + 0.001 * d * d
                m[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.999**step)) + 1e-8)
    return m


AT_DOT = ((" (at) ", " dot "), ("[at]", "[dot]"), (" [at] ", "."), ("(at)", "."), (" at ", " dot "), (" at ", "."), (" AT ", " DOT "),
          (" {at} ", "."), ("{at}", "{dot}"), (" <at> ", "."), ("<at>", "<dot>"))


def disguise(kind: str, found: str, r: np.random.Generator, words: list[str] | None = None) -> str:
    """The same data as the patterns do not see it; most e-mails with some of the given words as names."""
    if kind == "email":
        if words and r.random() < 0.75:
            name = [words[i] for i in r.integers(len(words), size=4)]
            user, host = (name[0], f"{name[0]}.{name[1]}", f"{name[0]}_{name[1]}")[r.integers(3)], (name[2], f"{name[2]}.{name[3]}")[r.integers(2)]
            found = f"{user}@{host}.{('com', 'org', 'net', 'de', 'fr', 'es', 'io')[r.integers(7)]}"
        at, dot = AT_DOT[r.integers(len(AT_DOT))]
        return found.replace("@", at).replace(".", dot)
    if kind == "phone":
        digits = "".join(DIGIT.findall(found))[-10:]
        return ("({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "00{} {} {}")[r.integers(4)].format(digits[:3], digits[3:6], digits[6:])
    if kind == "card":
        digits = "".join(DIGIT.findall(found))
        return "._/"[r.integers(3)].join(digits[i:i + 4] for i in range(0, len(digits), 4))
    return found.replace(".", (" . ", "[.]", "-")[r.integers(3)])


def training_windows(texts: list[str], limit: int = TRAIN_WINDOWS, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Windows around spans and cues, with tags: as they stand, and with their spans disguised; then, up to as many each,
    windows with a disguised e-mail put in and windows without personal data.

    The latter: anywhere in the texts, and around the places where spans were that have lost their digits, @ and plus;
    some with a bare ``at`` or ``dot`` between their words.
    """
    r = np.random.default_rng(seed)
    with_cue, made, without = [], [], []

    def cut(sym, tag, place, to):
        lo = max(0, place - int(r.integers(8, TRAIN_WINDOW - 8)))
        if r.random() < 0.2:  # as at a text's first character
            lo = max(0, place - int(r.integers(0, 24)))
        n = min(TRAIN_WINDOW, len(sym) - lo)
        to.append((np.pad(sym[lo:lo + n], (0, TRAIN_WINDOW - n), constant_values=130), np.pad(tag[lo:lo + n], (0, TRAIN_WINDOW - n))))

    mails = [text[lo:hi] for text in texts for kind, lo, hi in base_spans(text) if kind == "email"]
    for text in texts:
        spans = []
        for s in sorted(base_spans(text), key=lambda s: (s[1], -s[2])):
            if not spans or s[1] >= spans[-1][2]:
                spans.append(s)
        words = re.findall("[A-Za-z]{2,12}", text) if spans else []
        for hidden in (False, True, True):
            out, tag, at, begins, n = [], [], 0, [], 0
            for kind, lo, hi in spans:
                shown = disguise(kind, text[lo:hi], r, words) if hidden else text[lo:hi]
                k = 1 + 2 * KINDS.index(kind)
                begins.append(n + lo - at)
                out += [text[at:lo], shown]
                tag += [np.zeros(lo - at, np.int64), np.r_[k, np.full(len(shown) - 1, k + 1)]]
                n += lo - at + len(shown)
                at = hi
            whole = "".join([*out, text[at:]])
            tag = np.concatenate([*tag, np.zeros(len(text) - at, np.int64)])
            sym, last = symbols(whole), -TRAIN_WINDOW
            for place in sorted({*begins, *(m.start() for m in CUE.finditer(whole))}):
                if place >= last + TRAIN_APART:
                    last = place
                    cut(sym, tag, place, with_cue)
        words = re.findall("[A-Za-z]{2,12}", text)
        for _ in range(2 if mails and words else 0):  # an e-mail under made-up names between two words
            near = re.sub("[0-9@]", "", text[(at := int(r.integers(len(text)))):at + TRAIN_WINDOW]).split(" ") if r.random() < 0.85 else []
            k = int(r.integers(len(near) + 1))
            head, mail, tail = " ".join([*near[:k], ""]) if k else "", disguise("email", mails[r.integers(len(mails))], r, words), " ".join(["", *near[k:]]) if near[k:] else ""
            k = 1 + 2 * KINDS.index("email")
            tag = np.r_[np.zeros(len(head), np.int64), k, np.full(len(mail) - 1, k + 1), np.zeros(len(tail), np.int64)]
            cut(symbols(head + mail + tail), tag, len(head), made)
        out, places, at, n = [], [], 0, 0
        for _, lo, hi in spans:
            left = re.sub("[0-9@+]", "", text[lo:hi])
            out += [text[at:lo], left]
            places.append(n + lo - at)
            n += lo - at + len(left)
            at = hi
        bare = re.sub("[0-9@]", "", "".join([*out, text[at:]]))
        if not bare:
            continue
        places = r.integers(0, len(bare), 3).tolist() + [min(p, len(bare) - 1) for p in places]
        for i, place in enumerate(places):
            lo = max(0, place - TRAIN_WINDOW)
            piece = bare[lo:place + TRAIN_WINDOW]
            if i % 8 == 0:  # one word or two, again and again
                again = re.findall(r"\S{2,12}", piece)[:1 + int(r.integers(2))]
                piece = " ".join(again * TRAIN_WINDOW)[:2 * TRAIN_WINDOW] or piece
            elif i % 2:
                piece = re.sub(" ", lambda _: (" ", " ", " ", " ", " ", " at ", " dot ", ". ")[r.integers(8)], piece)
            cut(symbols(piece), np.zeros(len(piece), np.int64), min(place - lo, len(piece) - 1), without)
    if not with_cue and not made and not without:
        return np.zeros((0, TRAIN_WINDOW), np.int64), np.zeros((0, TRAIN_WINDOW), np.int64)
    picked = [w[i] for w in (with_cue, made, without) for i in r.permutation(len(w))[:limit]]
    return np.stack([x for x, _ in picked]), np.stack([y for _, y in picked])


def viterbi(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best tags (time, row) for scores (time, row, tag)."""
    t, n, _ = e.shape
    best, back = e[0], []
    for i in range(1, t):
        s = best[:, :, None] + trans
        back.append(s.argmax(axis=1))
        best = s.max(axis=1) + e[i]
    out = np.empty((t, n), np.int64)
    out[-1] = best.argmax(axis=1)
    for i in range(t - 2, -1, -1):
        out[i] = back[i][np.arange(n), out[i + 1]]
    return out


#: Weight of a window's scores where it shares places with the one before; the other's is what is left to 1
RAMP = np.arange(1, SHARED + 1) / (SHARED + 1)


def scorer(m: dict):
    """``emissions`` without the backward pass's keepings, in single precision and one product per step, with the gates'
    slopes taken into the weights."""
    slope = np.r_[np.full(3 * HIDDEN, 0.25), np.ones(HIDDEN)]
    both = []
    for d, part in (("f", m["Wo"][:HIDDEN]), ("b", m["Wo"][HIDDEN:])):
        w = np.concatenate([m["Wh" + d], m["Wx" + d], m["b" + d][None]]) * slope
        w[-1, :3 * HIDDEN] += 0.5
        both.append((np.ascontiguousarray(w.T, np.float32), np.ascontiguousarray(part.T, np.float32)))
    embed, bias = np.ascontiguousarray(m["E"].T, np.float32), m["bo"].astype(np.float32)[:, None]
    floor = np.r_[np.zeros(3 * HIDDEN), np.full(HIDDEN, -1)].astype(np.float32)[:, None]

    def score(ids: np.ndarray) -> np.ndarray:
        """Tag scores (time, tag, window) of windows of symbols (window, time)."""
        n, t = ids.shape
        col = np.ascontiguousarray(ids.T).astype(np.intp)
        e = np.empty((t, TAGS, n), np.float32)
        e[:] = bias
        a, c, u, given = (np.empty((rows, n), np.float32) for rows in (4 * HIDDEN, HIDDEN, HIDDEN, TAGS))
        high, low = np.ones_like(a), np.repeat(floor, n, axis=1)  # whole arrays: several times as fast as scalars
        for (w, wo), steps in zip(both, (range(t), range(t - 1, -1, -1)), strict=True):
            x = np.ones((HIDDEN + EMBED + 1, n), np.float32)
            x[:HIDDEN], c[:] = 0, 0
            h = x[:HIDDEN]
            for i in steps:
                np.take(embed, col[i], axis=1, out=x[HIDDEN:-1], mode="clip")
                np.matmul(w, x, out=a)
                np.minimum(a, high, out=a)
                np.maximum(a, low, out=a)
                c *= a[HIDDEN:2 * HIDDEN]
                np.multiply(a[:HIDDEN], a[3 * HIDDEN:], out=u)
                c += u
                np.minimum(c, high[:HIDDEN], out=u)
                np.maximum(u, low[3 * HIDDEN:], out=u)
                np.multiply(a[2 * HIDDEN:3 * HIDDEN], u, out=h)
                e[i] += np.matmul(wo, h, out=given)
        return e

    return score


def possible(place: np.ndarray, lead: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Which places can lie in a span of the best path, all others being "none"; ``lead`` is the best tag's over "none".

    A span from i to j gains at most the best tags' leads over "none" plus the best transitions in, within and out,
    less those of "none"; a place is possible if a stretch of its run that holds it does not lose by that measure.
    """
    enter, inner, leave, none = trans[0, 1:].max(), trans[1:, 1:].max(), trans[1:, 0].max(), trans[0, 0]
    lead = lead + inner - none
    run = np.cumsum(np.r_[True, np.diff(place) > 1])
    at = np.arange(len(place)) + run  # one wall before each run
    gain = np.full(len(place) + run[-1] + 1, -1e4)
    gain[at] = lead
    total = np.cumsum(gain)
    before = total - np.minimum.accumulate(total - gain)  # best stretch that ends here
    after = np.maximum.accumulate(total[::-1])[::-1] - (total - gain)  # best stretch that begins here
    return (before + after - gain)[at] >= inner + none - enter - leave - 1e-3


def windows_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, first character) of every window: one each STRIDE characters, but for ends that the window before covers."""
    n = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - WINDOW) // STRIDE)), 0)
    text = np.repeat(np.arange(len(lengths)), n)
    return text, (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE


def open_places(m: dict, texts: list[str], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, tag scores) of the places that can lie in a span, rising; places of text d are numbered from first[d].

    Whole texts are read together, as many as have HELD windows.
    """
    score, windows = scorer(m), np.cumsum(np.bincount(windows_of(np.array([len(t) for t in texts], np.int64))[0], minlength=len(texts)))
    places, scores, lo = [np.zeros(0, np.int64)], [np.zeros((0, TAGS), np.float32)], 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(windows, (windows[lo - 1] if lo else 0) + HELD, "right")))
        place, found = _open_places(m["T"], score, texts[lo:hi], first[lo:hi] - first[lo])
        places.append(first[lo] + place)
        scores.append(found)
        lo = hi
    return np.concatenate(places), np.concatenate(scores)


def _open_places(trans: np.ndarray, score, texts: list[str], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``open_places`` of a few texts, all of whose scores are held.

    Of every place only the lead over "none" goes into the bound; the scores of all tags are taken where it leaves a place open.
    A place is shut at once where "none" leads by more than any transitions can give back: it is on no other path.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    text, at = windows_of(lengths)
    if not len(text):
        return np.zeros(0, np.int64), np.zeros((0, TAGS), np.float32)
    sym = np.r_[symbols("".join(texts)), np.full(WINDOW, 130, np.uint8)]
    size = np.minimum(WINDOW, lengths[text] - at)
    base = (np.cumsum(lengths) - lengths)[text] + at
    where = first[text] + at
    follows = at > 0
    shown = np.where(np.r_[follows[1:], False], STRIDE, size)  # the rest is given by the next window
    back = ((trans - trans[:, :1]).max(axis=0) + (trans - trans[:1]).max(axis=1))[1:].astype(np.float32)
    ramp = RAMP[:, None, None].astype(np.float32)
    lead = np.full(int(first[-1] + lengths[-1]), -np.inf)
    heads, tails = (np.zeros((SHARED, TAGS, len(text)), np.float32) for _ in range(2))
    batches, batch, column = [], np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)

    def sift(e, w, inside):
        """Notes the leads of the scores e (time, tag, window) of windows w where ``inside`` (time, window)."""
        for k in range(0, len(e), STEPS):  # what a few steps need stays in the processor's cache
            part = e[k:k + STEPS]
            top, most = part[:, 1].copy(), part[:, 1] + back[0]
            for tag in range(2, TAGS):
                np.maximum(top, part[:, tag], out=top)
                np.maximum(most, part[:, tag] + back[tag - 1], out=most)
            j, i = np.nonzero((most >= part[:, 0]) & inside[k:k + STEPS])
            lead[where[w[i]] + j + k] = top[j, i].astype(float) - part[j, 0, i]

    filled = -(-size // ROUND) * ROUND
    for n in np.unique(filled).tolist():  # a window's scores depend on its own length only
        like, step = np.flatnonzero(filled == n), np.arange(n)[:, None]
        for k in range(0, len(like), ROWS):
            w = like[k:k + ROWS]
            ids = np.lib.stride_tricks.sliding_window_view(sym, n)[base[w]]
            short = np.flatnonzero(size[w] < n)
            ids[short] = np.where(step.T < size[w[short], None], ids[short], 130)
            e = score(ids)
            heads[:, :, w] = e[:SHARED]
            if n == WINDOW:
                tails[:, :, w] = e[STRIDE:]
            sift(e, w, (step >= np.where(follows[w], SHARED, 0)) & (step < shown[w]))
            batch[w], column[w] = len(batches), np.arange(len(w))
            batches.append(e)
    later = np.flatnonzero(follows)
    for k in range(0, len(later), ROWS):
        w = later[k:k + ROWS]
        sift(ramp * heads[:, :, w] + (1 - ramp) * tails[:, :, w - 1], w, np.arange(SHARED)[:, None] < shown[w])
    place = np.flatnonzero(lead > -np.inf)
    if len(place):
        place = place[possible(place, lead[place], trans)]
    # the window that shows a place, and the place in it
    windows = np.bincount(text, minlength=len(texts))
    d = np.searchsorted(first, place, "right") - 1
    nth = np.minimum((place - first[d]) // STRIDE, windows[d] - 1)
    w, j = (np.cumsum(windows) - windows)[d] + nth, place - first[d] - nth * STRIDE
    out, joined = np.empty((len(place), TAGS), np.float32), (nth > 0) & (j < SHARED)
    for b, e in enumerate(batches):
        some = np.flatnonzero((batch[w] == b) & ~joined)
        out[some] = e[j[some], :, column[w[some]]]
    w, j = w[joined], j[joined]
    out[joined] = ramp[j, 0] * heads[j, :, w] + (1 - ramp[j, 0]) * tails[j, :, w - 1]
    return place, out


def tag_texts(m: dict, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """Spans (kind, start, end) that the tagger finds in each text; windows cover every character of it."""
    found: list[list] = [[] for _ in texts]
    lengths = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(lengths + 1) - lengths - 1  # with one free place between texts
    if not lengths.sum():
        return found
    trans = m["T"]
    place, score = open_places(m, texts, first)
    if not len(place):
        return found
    lo = np.r_[0, np.flatnonzero(np.diff(place) > 1) + 1]
    length = np.diff(np.r_[lo, len(place)])
    order = np.argsort(-length, kind="stable")  # runs of like length together, longest first
    none = np.r_[0.0, np.full(TAGS - 1, -1e4)]
    while len(order):
        longest = int(length[order[0]])
        size = max(1, 100_000 // longest)
        group, order = order[:size], order[size:]
        step = np.arange(longest)[:, None]
        inside = step < length[group]
        e = np.empty((longest + 2, len(group), TAGS))
        e[0] = e[-1] = none  # "none" before and after a run
        e[1:-1] = np.where(inside[:, :, None], score[np.minimum(lo[group] + step, len(place) - 1)], none)
        tags = viterbi(e, trans)[1:-1]
        hits = np.flatnonzero(tags.any(axis=0))
        inside_span = 1 - marginals(e[:, hits], trans)[1:-1, :, 0] if len(hits) else None
        for at_hit, i in enumerate(hits.tolist()):
            n, at = int(length[group[i]]), int(lo[group[i]])
            t, p = tags[:n, i], inside_span[:n, at_hit]
            d = int(np.searchsorted(first, place[at], "right")) - 1
            shift = int(place[at]) - int(first[d])
            kind = (t + 1) // 2
            new = np.r_[True, (kind[1:] != kind[:-1]) | ((t[1:] % 2 == 1) & (t[1:] > 0))]
            begin = np.flatnonzero(new)
            for x, y in zip(begin.tolist(), [*begin[1:].tolist(), n], strict=True):
                if kind[x] and p[x:y].mean() >= SURE:
                    found[d].append((KINDS[kind[x] - 1], shift + x, shift + y))
    return [sorted(x, key=lambda s: s[1]) for x in found]


def added_spans(text: str, base: list[tuple[str, int, int]], tagged: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Tagged spans, without white space at their ends, that hold fitting digits and overlap no base span."""
    out = []
    for kind, lo, hi in tagged:
        piece = text[lo:hi]
        lo, hi = lo + len(piece) - len(piece.lstrip()), hi - len(piece) + len(piece.rstrip())
        digits = digits_of(text[lo:hi])
        likely = DIGITS[kind][0] <= len(digits) <= DIGITS[kind][1]
        likely = likely and (kind != "card" or luhn(digits))
        if hi - lo >= 7 and likely and all(hi <= a or lo >= b for _, a, b in base):
            out.append((kind, lo, hi))
    return out


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> dict | None:
    """The tagger, or None where no document of the sample holds a cue.

    The sample: the ``train_docs`` distinct texts with a digit or @, of up to ``train_chars`` characters, that
    hash lowest.  Their number is counted first, so that only texts below a hash bound, about half as many
    again as wanted, ever leave the executors.
    """
    cues = docs.where(F.length("text") <= train_chars).where(F.rlike("text", F.lit("[0-9@]"))).select("text", F.xxhash64("text").alias("h"))
    n = cues.agg(F.approx_count_distinct("h", 0.02)).first()[0] or 0
    share = min(1.0, (1.5 * train_docs + 50) / max(n, 1))
    bound = min(2**63 - 1, int(-(2**63) + share * 2**64))
    some = cues.where(F.col("h") <= bound).groupBy("h").agg(F.any_value("text").alias("text")).collect()
    windows, tags = training_windows([r.text for r in sorted(some, key=lambda r: r.h)[:train_docs]])
    return train(windows, tags) if len(windows) else None


def find(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs plus base_spans and all_spans (arrays of kind, first, end), in code points, end exclusive.

    docs: text and any other columns, kept; columns with the new names are replaced.  Null and empty texts: no spans.
    Without a model there are only base spans.  Equal rows get equal results.
    """
    docs = docs.drop("base_spans", "all_spans")
    known = docs.sparkSession.sparkContext.broadcast(model)
    span = "array<struct<kind:string,first:int,end:int>>"
    schema = schema_with(docs, f"base_spans {span}, all_spans {span}")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int32()), ("end", pa.int32())]))

    def go(it):
        m = known.value
        for b in batches_of(PIECE_BYTES)(it):
            texts = frame(b, "text").fill_null("").to_pylist()
            base = [base_spans(t) for t in texts]
            tagged = tag_texts(m, texts) if m is not None else [[] for _ in texts]
            every = [x + added_spans(t, x, y) for t, x, y in zip(texts, base, tagged, strict=True)]
            every = [sorted(x, key=lambda s: (KINDS.index(s[0]), s[1])) for x in every]
            as_rows = [pa.array([[{"kind": k, "first": lo, "end": hi} for k, lo, hi in x] for x in col], kind) for col in (base, every)]
            yield pa.RecordBatch.from_arrays([*b.columns, *as_rows], names=schema.names)

    return docs.mapInArrow(go, schema)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents; the tagger is trained on a bounded sample of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, fit(docs))

    def written(name):
        return F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["kind"], s["first"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(written("base_spans"), 256).alias("base_sha256"), written("all_spans").alias("spans"))


QUERIES = {"op3_pii": op3_pii}
ORACLE: dict = {}
