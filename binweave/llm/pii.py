"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions for what the patterns miss.

The network is trained in numpy on the driver, from a bounded set of generated labelled spans (`examples`, `seed`), and
sent along.  Every kind of span that it is taught has digits, an @ or an @ in words (SIGN), so a text is cut to the regions within
`REACH` characters of one, up to the end of the word there.  Regions are read in overlapping windows; a character's tag scores come from the
windows that see it, weighted by its distance to their edges, and one Viterbi path per region reconciles them.  A path's spans
count if they are plausible (digits, check sum) and don't touch a pattern's span.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import small_batches

KINDS = ("email", "ip", "card", "phone")
# Fixed patterns of the four kinds.  (A match never begins inside a run of digits: where its first digit fails, the others do; saying so keeps long runs linear.)
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _byte(s: str) -> bool:
    """Whether ASCII digits say 255 at most; they may be very many."""
    s = s.lstrip("0")
    return len(s) <= 3 and int(s or "0") <= 255


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the patterns, leftmost and non-overlapping within a kind; matches that fail their test are dropped."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:  # the part before an @ is all that may stand there since the last match
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(_byte(p) for p in m.group().split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 16 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


# --- the network

SYMBOLS = 98  # printable ASCII, line ends, other letters, others
EMBED, HIDDEN, WINDOW, STRIDE, REACH, WORD_END = 10, 16, 96, 64, 24, 64
TAGS = 1 + 2 * len(KINDS)


def symbols(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out = np.where((code >= 32) & (code < 127), code - 32, 97)
    out[(code == 10) | (code == 9) | (code == 13)] = 95
    out[code > 191] = 96
    return out.astype(np.int64)


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _lstm(x: np.ndarray, w: np.ndarray, b: np.ndarray):
    """Hidden states of a batch (time, batch, features) and what the backward pass needs."""
    steps, batch, _ = x.shape
    h, c, kept = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32), []
    out = np.empty((steps, batch, HIDDEN), np.float32)
    given = x.reshape(steps * batch, -1) @ w[: x.shape[2]] + b
    given = given.reshape(steps, batch, -1)
    for t in range(steps):
        g = given[t] + h @ w[x.shape[2] :]
        gates = _sigmoid(g[:, : 3 * HIDDEN])
        i, f, o, u = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :], np.tanh(g[:, 3 * HIDDEN :])
        before, c = c, f * c + i * u
        th = np.tanh(c)
        kept.append((i, f, o, u, before, th, h))
        h = o * th
        out[t] = h
    return out, kept


def _lstm_back(x, w, kept, d_out):
    steps, batch, n = x.shape
    dw, db, dx = np.zeros_like(w), np.zeros(4 * HIDDEN, np.float32), np.empty_like(x)
    dh, dc = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        i, f, o, u, before, th, h = kept[t]
        dh = dh + d_out[t]
        dc = dc + dh * o * (1 - th * th)
        dg = np.concatenate([dc * u * i * (1 - i), dc * before * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - u * u)], 1)
        dw[:n] += x[t].T @ dg
        dw[n:] += h.T @ dg
        db += dg.sum(0)
        dx[t] = dg @ w[:n].T
        dh, dc = dg @ w[n:].T, dc * f
    return dw, db, dx


def _emissions(p: dict, ids: np.ndarray):
    x = p["embed"][ids.T]  # time, batch, features
    fore, kf = _lstm(x, p["wf"], p["bf"])
    back, kb = _lstm(x[::-1], p["wb"], p["bb"])
    both = np.concatenate([fore, back[::-1]], 2)
    return both @ p["wo"] + p["bo"], (x, kf, kb, both)


def _logsum(a, axis):
    m = a.max(axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis, keepdims=True))).squeeze(axis)


def _crf_loss(emit: np.ndarray, move: np.ndarray, tags: np.ndarray):
    """Mean negative log likelihood, and its gradients by emissions and transitions."""
    steps, batch, k = emit.shape
    alpha, beta = np.empty_like(emit), np.zeros_like(emit)
    alpha[0] = emit[0]
    for t in range(1, steps):
        alpha[t] = emit[t] + _logsum(alpha[t - 1][:, :, None] + move, 1)
    for t in range(steps - 2, -1, -1):
        beta[t] = _logsum(move + (emit[t + 1] + beta[t + 1])[:, None, :], 2)
    total = _logsum(alpha[-1], 1)
    d_emit = np.exp(alpha + beta - total[None, :, None])
    d_move = np.zeros_like(move)
    for t in range(1, steps):
        d_move += np.exp(alpha[t - 1][:, :, None] + move + (emit[t] + beta[t])[:, None, :] - total[:, None, None]).sum(0)
    at, row = np.arange(steps)[:, None], np.arange(batch)[None]
    score = emit[at, row, tags.T].sum(0) + move[tags[:, :-1], tags[:, 1:]].sum(1)
    d_emit[at, row, tags.T] -= 1
    np.add.at(d_move, (tags[:, :-1], tags[:, 1:]), -1)
    return float((total - score).mean()), d_emit / batch, d_move / batch


def labelled_spans(examples: int, seed: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Generated texts with their spans: the patterns' forms and looser ones, among numbers that are none."""
    r = random.Random(seed)
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("aeiourtnsldmhcpgbfvéäñ") for _ in range(r.randint(2, 9)))

    def email():
        a, b = r.choice(["{0}.{1}", "{0}{1}", "{0}_{1}", "{0}"]).format(word(), number(2)), f"{word()}{r.choice(['', number(1)])}.{r.choice(['example.com', 'org', 'net', 'co.uk'])}"
        a, b = (x.encode("ascii", "ignore").decode() or "x" for x in (a, b))
        return a + r.choice(["@"] * 5 + [" @ ", " [at] ", "(@)"]) + b

    def ip():
        return ".".join(str(r.randint(0, 255)) for _ in range(4))

    def card():
        d = number(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        return r.choice(["", " ", "-"]).join(d[i : i + 4] for i in range(0, 16, 4))

    def phone():
        return r.choice(["+{0} {1} {2} {3}", "+{0}-{1}-{2}-{3}", "+{0} ({1}) {2}-{3}", "({1}) {2}-{3}", "{1}-{2}-{3}", "00{0} {1} {2} {3}", "+{0}{1}{2}{3}"]).format(number(r.randint(1, 2)), number(3), number(3), number(4))

    def none():
        return r.choice([number(r.randint(1, 6)), f"{number(2)}.{number(2)}.{number(4)}", f"{number(1)}.{number(1)}", f"{number(2)}:{number(2)}", f"${number(3)}.{number(2)}", f"v{number(1)}.{number(1)}.{number(1)}", f"#{number(5)}", f"{number(4)}-{number(2)}-{number(2)}", f"@{word()}", f"{number(3)},{number(3)}"])

    make, out = dict(zip(KINDS, (email, ip, card, phone))), []
    for _ in range(examples):
        text, spans = "", []
        while len(text) < WINDOW + 20:
            kind = r.choice([*KINDS, "none", "none", "word", "word", "word", "word"])
            part = make[kind]() if kind in make else none() if kind == "none" else word()
            if kind in make:
                spans.append((kind, len(text), len(text) + len(part)))
            text += part + r.choice([" ", " ", " ", ", ", ". ", "\n"])
        shift = r.randint(0, 20)
        text, spans = text[shift : shift + WINDOW], [(k, max(0, a - shift), min(WINDOW, b - shift)) for k, a, b in spans if b > shift and a < shift + WINDOW]
        out.append((text, spans))
    return out


@lru_cache(maxsize=2)
def train(examples: int = 1500, epochs: int = 10, seed: int = 3) -> dict:
    """Weights fitted with Adam on labelled spans."""
    rng, data = np.random.default_rng(seed), labelled_spans(examples, seed)
    ids = np.stack([symbols(t) for t, _ in data])
    tags = np.zeros_like(ids)
    for row, (_, spans) in enumerate(data):
        for kind, a, b in spans:
            k = 1 + 2 * KINDS.index(kind)
            tags[row, a:b] = k + 1
            tags[row, a] = k
    normal = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    p = {"embed": normal(SYMBOLS, EMBED) * 3, "wo": normal(2 * HIDDEN, TAGS), "bo": np.zeros(TAGS, np.float32), "move": np.zeros((TAGS, TAGS), np.float32)}
    for d in "fb":
        p["w" + d], p["b" + d] = normal(EMBED + HIDDEN, 4 * HIDDEN), np.zeros(4 * HIDDEN, np.float32)
        p["b" + d][HIDDEN : 2 * HIDDEN] = 1
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(examples)
        for a in range(0, examples, 64):
            rows = order[a : a + 64]
            emit, (x, kf, kb, both) = _emissions(p, ids[rows])
            _, d_emit, d_move = _crf_loss(emit, p["move"], tags[rows])
            flat = d_emit.reshape(-1, TAGS)
            grad = {"wo": both.reshape(-1, 2 * HIDDEN).T @ flat, "bo": flat.sum(0), "move": d_move}
            d_both = d_emit @ p["wo"].T
            grad["wf"], grad["bf"], dx1 = _lstm_back(x, p["wf"], kf, d_both[:, :, :HIDDEN])
            grad["wb"], grad["bb"], dx2 = _lstm_back(x[::-1], p["wb"], kb, d_both[::-1, :, HIDDEN:])
            grad["embed"] = np.zeros_like(p["embed"])
            np.add.at(grad["embed"], ids[rows].T, dx1 + dx2[::-1])
            step += 1
            rate = 0.02 * (1 - 0.9 * epoch / epochs)
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] = (p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p


#: What every kind of span has one of: an @, a digit, or an @ in words (fixed forms).
SIGN = re.compile(r"@|[0-9]+|\[at\]|\(at\)")
_BEFORE, _AFTER = re.compile(r"\S{0,%d}\Z" % WORD_END), re.compile(r"\S{0,%d}" % WORD_END)


def _regions(text: str) -> list[tuple[int, int]]:
    """Stretches within REACH of a sign, and on to the end of the word there (of WORD_END characters at most)."""
    out: list[tuple[int, int]] = []
    for m in SIGN.finditer(text):
        if out and m.end() + REACH <= out[-1][1]:
            continue
        a = max(0, m.start() - REACH)
        a = a - len(_BEFORE.search(text[max(0, a - WORD_END) : a]).group())
        b = _AFTER.match(text, min(len(text), m.end() + REACH)).end()
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _viterbi(emit: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best tags of a batch (batch, time, tags) of regions of the given lengths."""
    batch, steps, k = emit.shape
    score, back = emit[:, 0].copy(), np.zeros((steps, batch, k), np.int8)
    for t in range(1, steps):
        ways = score[:, :, None] + move
        back[t] = ways.argmax(1)
        live = (t < lengths)[:, None]
        score = np.where(live, np.take_along_axis(ways, back[t][:, None].astype(np.int64), 1)[:, 0] + emit[:, t], score)
    out, now = np.zeros((batch, steps), np.int64), score.argmax(1)
    for t in range(steps - 1, -1, -1):
        inside = t < lengths
        out[:, t] = np.where(inside, now, 0)
        now = np.where(inside & (t > 0), back[t][np.arange(batch), now], now)
    return out


def _plausible(kind: str, s: str) -> bool:
    d = _digits(s)
    if kind == "email":
        return ("@" in s or " at" in s or "[at" in s) and "." in s and len(s) >= 6
    if kind == "ip":
        return len(p := re.split(r"[^0-9]+", s.strip())) == 4 and all(x and _byte(x) for x in p)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15


def model_spans(p: dict, texts: list[str], step: int = 2048) -> list[list[tuple[str, int, int]]]:
    """Spans on the best path of every region of the texts."""
    regions = [(i, a, b) for i, t in enumerate(texts) for a, b in _regions(t)]
    # a region's windows overlap by WINDOW - STRIDE
    windows = [(n, s) for n, (_, a, b) in enumerate(regions) for s in range(a, max(a + 1, b - WINDOW + STRIDE), STRIDE)]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not regions:
        return out
    codes = {i: symbols(texts[i]) for i in {i for i, _, _ in regions}}
    near = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]).astype(np.float32)[:, None] + 1
    size = np.array([b - a for _, a, b in regions])
    base = np.cumsum(size) - size
    emit, seen = np.zeros((int(size.sum()), TAGS), np.float32), np.zeros((int(size.sum()), 1), np.float32)
    for a in range(0, len(windows), step):
        part = windows[a : a + step]
        ids = np.zeros((len(part), WINDOW), np.int64)
        for row, (n, s) in enumerate(part):
            i, _, end = regions[n]
            cut = codes[i][s : min(s + WINDOW, end)]
            ids[row, : len(cut)] = cut
        found = _emissions(p, ids)[0]
        for row, (n, s) in enumerate(part):
            _, begin, end = regions[n]
            long = min(WINDOW, end - s)
            at = base[n] + s - begin
            emit[at : at + long] += found[:long, row] * near[:long]
            seen[at : at + long] += near[:long]
    emit /= np.maximum(seen, 1)
    order = np.argsort(size, kind="stable")
    for a in range(0, len(order), step):
        some = order[a : a + step]
        rows = max(1, (1 << 20) // int(size[some[-1]]))  # a few long regions at a time
        groups = [some[k : k + rows] for k in range(0, len(some), rows)]
        for group in groups:
            wide = np.zeros((len(group), int(size[group].max()), TAGS), np.float32)
            for row, n in enumerate(group):
                wide[row, : size[n]] = emit[base[n] : base[n] + size[n]]
            for row, tags in enumerate(_viterbi(wide, size[group], p["move"])):
                i, begin, _ = regions[group[row]]
                for kind, s, e in _read(tags[: size[group[row]]]):
                    if _plausible(kind, texts[i][begin + s : begin + e]):
                        out[i].append((kind, begin + s, begin + e))
    return out


def _in_parts(p: dict, texts: list[str], most: int = 1 << 20):
    """model_spans() of about `most` characters at a time."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= most:
            yield from model_spans(p, part)
            part, size = [], 0
    yield from model_spans(p, part)


def _read(tags: np.ndarray):
    """Spans of a path: runs of one kind, a new one at each begin tag."""
    kind = (tags + 1) // 2
    edge = np.flatnonzero(np.append(True, (kind[1:] != kind[:-1]) | ((tags[1:] % 2 == 1) & (tags[:-1] != tags[1:]))))
    for a, b in zip(edge, np.append(edge[1:], len(tags))):
        if kind[a]:
            yield KINDS[kind[a] - 1], int(a), int(b)


def _find(held):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches):
        p = held.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = []
            for text, more in zip(texts, _in_parts(p, texts)):
                base = base_spans(text)
                spans = [{"kind": k, "start": a, "end": b, "base": True} for k, a, b in base]
                spans += [{"kind": k, "start": a, "end": b, "base": False} for k, a, b in more if all(b <= s or a >= e for _, s, e in base)]
                found.append(sorted(spans, key=lambda x: (KINDS.index(x["kind"]), x["start"])))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, kind)], ["row", "spans"])

    return run


def find_personal_data(docs: DataFrame, examples: int = 1500, epochs: int = 10, seed: int = 3, text_col: str = "text") -> DataFrame:
    """All columns of `docs`, then spans (kind, start, end, base): code points, end exclusive, by kind as in KINDS, then start.

    Edges: null texts count as empty and have no spans; a very long text is read whole, some windows at a time; a column of the input named spans is replaced; repeated rows are searched alike.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() != "spans"]
    held = docs.sparkSession.sparkContext.broadcast(train(examples, epochs, seed))
    source = docs.select(F.struct(*kept).alias("row"), F.col(text_col).cast("string").alias("text"))
    out = source.mapInArrow(_find(held), f"row {source.schema['row'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in kept), "spans")


def joined(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The text with every character of a span replaced by *; spans of other kinds may overlap; a null text stays null."""
    def cover(text: Column, s: Column) -> Column:
        return F.concat(F.substring(text, F.lit(1), s["start"].cast("int")), F.repeat(F.lit("*"), (s["end"] - s["start"]).cast("int")), F.substring(text, (s["end"] + 1).cast("int"), F.length(text)))

    return docs.withColumn(text_col, F.aggregate("spans", F.col(text_col), cover))
