"""Personal data by a semi-Markov conditional random field: whole-span features score candidate segments, and a dynamic
programme over segments of bounded length chooses boundaries and types jointly. Spans of the base patterns always stay.

The field is trained here, by likelihood, on sentences made from a seeded grammar (``training_sentences``); no corpus
text is learned from.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import blocks, spread, table, tuned

KINDS = ("email", "ip", "card", "phone", "ssn", "iban")
BASE = KINDS[:4]
#: Tokens in a segment at most, and tokens around a trigger that the field sees.
LONGEST, CONTEXT = 7, 3
BINS = 1 << 12
#: Tokens whose candidates are scored together.
WINDOW = 2000
#: How much likelier than none, in logits, a span of the field must be to be added.
MARGIN = 1.0

# fixed values: the base patterns
_LOCAL = "[A-Za-z0-9._%+-]"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # from each @ outwards, so that long runs of letters are not tried from each of their characters
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _DOTTED.finditer(text):
        parts = [p.span() for p in re.compile("[0-9]+").finditer(text, m.start(), m.end())]
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            if all(len(text[a:b].lstrip("0")) <= 3 and int(text[a:b].lstrip("0") or 0) <= 255 for a, b in four):
                yield four[0][0], four[3][1]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, in code points: per kind leftmost and non-overlapping, matches that fail
    their check dropped without a further try. All take time in proportion to the text."""
    out = [(a, b, "email") for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [(a, b, "ip") for a, b in _ips(text)]
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
        if "+" in text:
            out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return out


# --- the field -----------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"\S+")
_GAP = re.compile(r"\s")
_TRIGGER = re.compile(r"[0-9@]|[\[({](?:at|dot)[\])}]", re.IGNORECASE)
_EDGE = re.compile(r"[^\w+(\[{]*$")
_OBFUSCATED = re.compile(r"[\w.+-]+\s*[\[({]at[\])}]\s*[\w-]+(?:\s*(?:[\[({]dot[\])}]|\.)\s*[\w-]+)+", re.IGNORECASE)
_PARTLY = re.compile(r"\(?\d{3}\)?[ .-]?\d{3}[ .-]\d{4}")
_SSN = re.compile(r"\d{3}-\d{2}-\d{4}")
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?")
_WHOLE = {"phone": _PHONE, "card": _CARD, "plain": _PARTLY, "ssn": _SSN, "iban": _IBAN, "hidden": _OBFUSCATED, "dotted": re.compile(r"\d{1,3}(?:\[?\.\]?\d{1,3}){3}"), "mail": re.compile(_LOCAL + r"+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")}
# fixed values: the words that tell a kind
CUES = {
    "email": ("email", "e-mail", "mail", "write", "contact", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "client", "from"),
    "card": ("card", "visa", "mastercard", "credit", "tarjeta", "karte", "carte"),
    "phone": ("call", "phone", "tel", "mobile", "fax", "telefon", "telefono"),
    "ssn": ("ssn", "social", "security"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
}
_CUE_OF = {w: k for k, ws in CUES.items() for w in ws}


def _iban_valid(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def segment_features(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> tuple[list[int], int, int]:
    """Hashed features of the whole span of tokens i..j-1, and its start and end without the punctuation after it."""
    a = tokens[i][0]
    raw = text[a : tokens[j - 1][1]]
    span = raw[: _EDGE.search(raw).start()] if len(raw) < 200 else raw
    digits = _NOT_DIGIT.sub("", span)
    names = ["bias", f"n{j - i}", f"d{min(len(digits), 20)}"]
    if span:
        for name, pattern in _WHOLE.items():
            if len(span) < 200 and pattern.fullmatch(span):
                names += [f"w{name}", f"w{name}-d{min(len(digits), 20)}"]
                if name == "card":
                    names.append(f"luhn{luhn(digits)}")
                elif name == "iban":
                    names.append(f"mod97{_iban_valid(span)}")
                elif name == "dotted":
                    names.append(f"byte{all(int(p) < 256 for p in re.findall('[0-9]+', span))}")
                elif name == "ssn":
                    names.append(f"area{span[:3] not in ('000', '666') and span[0] != '9'}")
        shape = re.sub(r"9+", "9", re.sub(r"[^\W\d_]", "a", re.sub(r"[0-9]", "9", span)))
        names.append("s" + re.sub(r"a+", "a", shape)[:24])
        names.append(f"at{span.count('@')}")
    for k in range(max(0, i - 2), i):
        cue = _CUE_OF.get(text[tokens[k][0] : tokens[k][1]].strip(".,:;()").lower())
        if cue:
            names.append(f"cue{cue}")
            names += [f"cue{cue}-{n}" for n in names if n.startswith("w")]
    return [zlib.crc32(n.encode("utf-8", "replace")) % BINS for n in names], a, a + len(span)


def lattice(text: str, tokens: list[tuple[int, int]], first: int = 0, end: int | None = None) -> tuple[list[tuple[int, int]], list[list[int]], list[tuple[int, int]]]:
    """The candidate segments (i, j) of a stretch of tokens that begin at the tokens first..end-1, their features and their
    spans. Names and hosts of any length belong to them: 120 characters and LONGEST tokens bound a segment."""
    end = len(tokens) if end is None else end
    digits = [bool(_TRIGGER.search(text, a, b)) for a, b in tokens[first : end + LONGEST]]
    segments, feats, spans = [], [], []
    for i in range(first, end):
        for j in range(i + 1, min(len(tokens), i + LONGEST) + 1):
            if tokens[j - 1][1] - tokens[i][0] > 120:
                break
            if any(digits[i - first : j - first]) and (j - i == 1 or digits[i - first] or digits[i + 1 - first]):
                f, a, b = segment_features(text, tokens, i, j)
                if b > a:
                    segments.append((i, j))
                    feats.append(f)
                    spans.append((a, b))
    return segments, feats, spans


def _segment_scores(weights: np.ndarray, feats: list[list[int]]) -> np.ndarray:
    """Segment x kind, over the score of as many tokens outside of any entity, which is 0."""
    return np.array([weights[:, f].sum(1) for f in feats]) if feats else np.zeros((0, len(KINDS)))


def _forward(n: int, segments: list[tuple[int, int]], scores: np.ndarray) -> np.ndarray:
    best = np.full(n + 1, -np.inf)
    best[0] = 0.0
    by_end: dict[int, list[int]] = {}
    for s, (_, j) in enumerate(segments):
        by_end.setdefault(j, []).append(s)
    whole = np.logaddexp.reduce(scores, axis=1) if len(scores) else np.zeros(0)
    for j in range(1, n + 1):
        best[j] = np.logaddexp.reduce([best[j - 1], *(best[segments[s][0]] + whole[s] for s in by_end.get(j, ()))])
    return best


def marginals(n: int, segments: list[tuple[int, int]], scores: np.ndarray) -> tuple[np.ndarray, float]:
    """The probability of every segment and kind, and the log of the partition function."""
    alpha = _forward(n, segments, scores)
    beta = _forward(n, [(n - j, n - i) for i, j in segments], scores)[::-1]
    edge = np.array([alpha[i] + beta[j] for i, j in segments])
    return (np.exp(scores + edge[:, None] - alpha[n]) if segments else np.zeros((0, len(KINDS)))), float(alpha[n])


def decode(n: int, segments: list[tuple[int, int]], scores: np.ndarray, margin: float = 0.0) -> list[tuple[int, int]]:
    """(segment, kind) of the best segmentation."""
    best, back = np.full(n + 1, -np.inf), [None] * (n + 1)
    best[0] = 0.0
    kind = scores.argmax(1) if len(scores) else []
    by_end: dict[int, list[int]] = {}
    for s, (_, j) in enumerate(segments):
        by_end.setdefault(j, []).append(s)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for s in by_end.get(j, ()):
            v = best[segments[s][0]] + scores[s, kind[s]] - margin
            if v > best[j]:
                best[j], back[j] = v, s
    out, j = [], n
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            out.append((back[j], int(kind[back[j]])))
            j = segments[back[j]][0]
    return out[::-1]


def training_sentences(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Sentences with known spans, and with numbers that are none: years, prices, versions, references, dates."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("aeiourstnlmdc") for _ in range(rng.randint(2, 9)))
    # names, hosts and words around them are long at times
    name = lambda: word() if rng.random() < 0.6 else rng.choice(["", ".", "-"]).join((word() + word(), word()))

    person = lambda: rng.choice([word(), f"{word()}{word()}", f"{word()}.{word()}{word()}", f"{word()}-{word()}{word()}"])

    def card() -> str:
        body = rng.choice("3456") + d(14)
        s = next(body + c for c in "0123456789" if luhn(body + c))
        sep = rng.choice(["", "", " ", "-"])
        return sep.join(s[k : k + 4] for k in range(0, 16, 4))

    def iban() -> str:
        body = d(18)
        check = next(c for c in range(2, 99) if _iban_valid(f"DE{c:02d}{body}"))
        s = f"DE{check:02d}{body}"
        return s if rng.random() < 0.5 else " ".join(s[k : k + 4] for k in range(0, len(s), 4))

    def email() -> str:
        user, host = f"{name()}.{d(2)}", f"mail{d(1)}.{name()}"
        return rng.choice([f"{user}@{host}.com", f"{person()}[at]{name()}[dot]com", f"{person()} (at) {name()} (dot) org", f"{person()} [at] {name()} [dot] net"])

    ip = lambda: rng.choice([".", ".", "[.]"]).join(str(rng.randint(1, 255)) for _ in range(4))
    phone = lambda: rng.choice([f"+1 ({d(3)}) 555-{d(4)}", f"+{rng.randint(20, 99)} {d(3)} {d(4)} {d(3)}", f"({rng.randint(201, 989)}) 555-{d(4)}", f"{rng.randint(201, 989)}-555-{d(4)}"])
    ssn = lambda: f"{rng.choice('12345')}{d(2)}-{rng.randint(10, 99)}-{d(4)}"
    made = {"email": email, "ip": ip, "card": card, "phone": phone, "ssn": ssn, "iban": iban}
    bad16 = lambda: next(s for s in iter(lambda: d(16), None) if not luhn(s))
    none = [lambda: d(4), lambda: f"{d(2)}.{d(2)}", lambda: f"{d(1)}.{d(1)}.{d(2)}", lambda: f"20{d(2)}-{d(2)}-{d(2)}", lambda: f"#{d(6)}", bad16, bad16, lambda: f"{d(2)}:{d(2)}", lambda: f"${d(3)},{d(3)}", lambda: d(8), lambda: f"{d(3)}-{d(3)}", lambda: f"@{word()}", lambda: f"{rng.randint(256, 999)}.{d(3)}.{d(3)}.{d(3)}", lambda: f"{d(2)} {d(3)} {d(3)}", lambda: f"{word()}{d(2)}", lambda: f"9{d(2)}-{d(2)}-{d(4)}", lambda: f"{d(4)}-{d(4)}"]
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(1, 4)):
            text += " ".join(name() if rng.random() < 0.3 else word() for _ in range(rng.randint(1, 5))) + " "
            kind = rng.choice([*KINDS, None, None, None, None])
            if kind is None:
                text += rng.choice(none)()
            else:
                if rng.random() < 0.4:
                    text += rng.choice(CUES[kind]) + rng.choice([" ", ": "])
                value = made[kind]()
                spans.append((len(text), len(text) + len(value), kind))
                text += value
            text += rng.choice([" ", " ", ". ", ", "])
        out.append((text + word(), spans))
    return out


def train(n: int = 400, seed: int = 7, rounds: int = 25, decay: float = 0.01) -> np.ndarray:
    """Weights (kind x feature) by gradient ascent on the likelihood of the known segmentations."""
    data = []
    for text, spans in training_sentences(n, seed):
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        segments, feats, where = lattice(text, tokens)
        want = {(a, b): KINDS.index(k) for a, b, k in spans}
        gold = np.zeros((len(segments), len(KINDS)))
        for s, span in enumerate(where):
            if span in want:
                gold[s, want[span]] = 1
        data.append((len(tokens), segments, feats, gold))
    rows = np.concatenate([np.repeat(np.arange(len(f)), [len(x) for x in f]) + o for f, o in zip((x[2] for x in data), np.cumsum([0, *(len(x[2]) for x in data[:-1])]))])
    cols = np.concatenate([np.concatenate([np.array(x) for x in f]) for *_, f, _ in data])
    total = sum(len(x[2]) for x in data)
    w, m1, m2 = np.full((len(KINDS), BINS), 0.0), np.zeros((len(KINDS), BINS)), np.zeros((len(KINDS), BINS))
    for t in range(1, rounds + 1):
        scores = np.stack([np.bincount(rows, w[k][cols], total) for k in range(len(KINDS))], 1) - 2.0
        at, diff = 0, np.zeros((total, len(KINDS)))
        for size, segments, feats, gold in data:
            p, _ = marginals(size, segments, scores[at : at + len(feats)])
            diff[at : at + len(feats)] = gold - p
            at += len(feats)
        g = np.stack([np.bincount(cols, diff[rows, k], BINS) for k in range(len(KINDS))]) / n * 10 - decay * w
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.98 * m2 + 0.02 * g * g
        w = w + 0.3 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.98**t)) + 1e-6)
    return w


def best_spans(text: str, tokens: list[tuple[int, int]], weights: np.ndarray, margin: float = MARGIN, window: int = WINDOW) -> list[tuple[int, int, str]]:
    """As ``decode``, over any number of tokens: candidates are scored a window of beginnings at a time, and the best scores up
    to each token are carried over, so windows do not change the result."""
    n = len(tokens)
    best, back = np.full(n + 1, -np.inf), [None] * (n + 1)
    best[0] = 0.0
    for first in range(0, n, window):
        end = min(n, first + window)
        segments, feats, where = lattice(text, tokens, first, end)
        scores = _segment_scores(weights, feats) - 2.0
        kind, s = scores.argmax(1) if len(scores) else [], 0
        for i in range(first, end):
            if i and best[i - 1] >= best[i]:
                best[i], back[i] = best[i - 1], None
            while s < len(segments) and segments[s][0] == i:
                v, j = best[i] + scores[s, kind[s]] - margin, segments[s][1]
                if v > best[j]:
                    best[j], back[j] = v, (i, *where[s], KINDS[kind[s]])
                s += 1
    if n and best[n - 1] >= best[n]:
        back[n] = None
    out, j = [], n
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            j, *span = back[j]
            out.append(tuple(span))
    return out[::-1]


def field_spans(text: str, weights: np.ndarray, margin: float = MARGIN) -> list[tuple[int, int, str]]:
    """Spans that the field chooses. Tokens without a trigger near them are outside of every entity, so that the text falls
    into stretches of whole tokens that are decoded on their own, which gives the best segmentation of the whole."""
    triggers = [m.start() for m in _TRIGGER.finditer(text)]
    out, k, done, reach = [], 0, 0, 13 * CONTEXT
    while k < len(triggers):
        lo = max(done, triggers[k] - reach)
        while lo > done and not text[lo - 1].isspace():
            lo -= 1
        hi = triggers[k]
        while k < len(triggers) and triggers[k] - reach <= hi + reach:
            gap = _GAP.search(text, min(len(text), triggers[k] + reach))
            hi = gap.start() if gap else len(text)
            while k < len(triggers) and triggers[k] < hi:
                k += 1
        tokens = [m.span() for m in _TOKEN.finditer(text, lo, hi)]
        out += best_spans(text, tokens, weights, margin)
        done = hi
    return out


def find_spans(text: str, weights: np.ndarray) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The base spans, and these with the field's that overlap none of them; both by kind, then start."""
    base = base_spans(text)
    # the stretches that base spans cover
    covered: list[list[int]] = []
    for a, b, _ in sorted(base):
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], b)
        else:
            covered.append([a, b])
    starts = [a for a, _ in covered]
    free = lambda a, b: not (k := bisect_left(starts, b)) or covered[k - 1][1] <= a
    more = [s for s in field_spans(text, weights) if free(s[0], s[1])]
    order = lambda s: (KINDS.index(s[2]), s[0], s[1])
    return sorted(base, key=order), sorted(base + more, key=order)


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, base and spans (arrays of (start, end, kind), code points, end exclusive).

    Null and empty texts have no spans. Repeated rows give equal rows, null ids are kept; an empty table gives an empty
    result. A text of any length is decoded whole, in time in proportion to it. Of segmentations with equal scores, the one with
    fewer and earlier entities is taken. Other columns are not read, whatever their names."""
    spark = tuned(docs.sparkSession)
    weights = spark.sparkContext.broadcast(train())
    rows = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            found = [find_spans(t or "", weights.value) for t in block.column("text").to_pylist()]
            lists = [pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in f[v]] for f in found], span) for v in (0, 1)]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), *lists], names=["doc_id", "base", "spans"])

    kind = "array<struct<start:int,end:int,kind:string>>"
    return rows.mapInArrow(find, f"doc_id long, base {kind}, spans {kind}")


def op9_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE]
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *counts, F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
