"""Secret scans: fixed patterns, and a linear-chain CRF that tags what they miss."""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents that the tagger learns from, about; they are picked by a hash of their id. Windows of tokens learned from at most, and their length.
SAMPLE, RUNS, WINDOW = 8_000, 6_000, 16
#: Of windows without a label and without a token like a credential, one in so many is learned from.
PLAIN = 16
#: Characters of all distinct tokens that a worker remembers the features of; beyond, it starts anew.
REMEMBERED = 1 << 24
#: Made-up secrets learned from for each that the patterns find, and the characters of its text kept around them.
VARIANTS, CONTEXT = 6, 200
ROUNDS, RATE, RIDGE = 150, 0.1, 1e-4
#: Windows with a secret weigh as much as all others together, but each at most so many times as much as one of those.
BALANCE = 30
OUTSIDE, BEGIN, INSIDE = 0, 1, 2

# The base patterns, in the order of their kinds.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_PIECES = re.compile(r"\s+|[\w+/.-]+|[^\w\s+/.-]+")
_PARTS = re.compile(r"[^A-Za-z0-9]+")
# Words that stand before credentials.
HINTS = frozenset("access api auth authorization bearer client credential credentials jwt key login passphrase passwd password private pwd secret session sign signature token".split())


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """``(start, kind, end, value start, value end)`` of the fixed patterns, ordered by start and kind.

    For each kind the leftmost matches that do not overlap; those that are too
    short are dropped. (A run of hex digits that is long enough is the same run
    whether shorter ones are matched and dropped or never matched.)
    """
    out = []
    low = text.lower()
    if any(k in low for k in KEYS):
        out += [(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def file_features(text: str) -> list[float]:
    """Of the whole text: shares of digits and of characters as in code, and length."""
    raw = text.encode("utf-8", "ignore")
    n = max(1, len(raw))
    digits, code = n - len(raw.translate(None, b"0123456789")), n - len(raw.translate(None, b"{}();=<>[]\"'"))
    return [min(1.0, 5 * digits / n), min(1.0, 5 * code / n), min(1.0, math.log10(n) / 6)]


def _entropy(s: str) -> float:
    shares = _SHARES[len(s)] if len(s) < len(_SHARES) else [0.0] + [n / len(s) * math.log2(n / len(s)) for n in range(1, len(s) + 1)]
    return -sum([shares[n] for n in map(s.count, set(s))])


#: Of ``n`` equal characters in so many: their part of the entropy, with the sign changed.
_SHARES = [[0.0] + [n / size * math.log2(n / size) for n in range(1, size + 1)] for size in range(65)]
_DIGITS, _HEX, _ALNUM = b"0123456789", b"0123456789abcdefABCDEF", (string.ascii_letters + string.digits).encode()
#: Digits as 1, all else as 0.
_IS_DIGIT = bytes(chr(c).isdigit() and c < 128 for c in range(256))


#: Features of a token: its own shape, of its neighbours, of the file. What is kept of each distinct token: shape, and what neighbours ask of it.
SHAPE, AROUND, WIDTH = 16, 8, 27
SIGN, HINT, MARK, QUOTE, WORD = range(SHAPE, SHAPE + 5)


def shape(t: str) -> list[float]:
    """What a token shows by itself, and the five answers to its neighbours."""
    if t.isalpha() and t.islower():  # most tokens; as below
        hint, size = t in HINTS, [min(1.0, len(t) / 64), min(1.0, max(0, len(t) - 8) / 16), _entropy(t) / 6]
        hexed = len(t) >= 8 and not t.strip("abcdef")
        return [0.0, *size, 0.0, 0.0, 0.0, 0.0, 0.0, hexed, 0.0, 0.0, 0.0, hint, 1.0, not t.isascii(), 0.0, hint, 0.0, 0.0, 1.0]
    low = t.lower()
    if t.isascii():  # bytes tell the same sooner
        raw = t.encode()
        sign, digits = len(raw.translate(None, _ALNUM)) == len(raw), len(raw) - len(raw.translate(None, _DIGITS))
        upper, lower, hexed, ones = low != t, t.upper() != t, not raw.translate(None, _HEX), raw.translate(_IS_DIGIT)
        turns = ones.count(b"\0\1") + ones.count(b"\1\0")
    else:
        sign, digits = not any(c.isalnum() for c in t), sum(c.isdigit() for c in t)
        upper, lower, hexed = any(c.isupper() for c in t), any(c.islower() for c in t), False
        turns = sum(a.isdigit() != b.isdigit() for a, b in zip(t, t[1:]))
    hint = any([part in HINTS for part in _PARTS.split(low)])
    word = t.isalpha() and (t[1:] == t[1:].lower() or not lower)
    own = [
        sign,
        min(1.0, len(t) / 64),
        min(1.0, max(0, len(t) - 8) / 16),
        _entropy(t) / 6,
        digits > 0,
        not sign and not upper and not lower,
        digits / len(t),
        upper and lower and not word,
        not upper and not lower,
        len(t) >= 8 and hexed,
        turns / len(t),
        not sign and ("." in t or "-" in t or "/" in t),
        not sign and ("+" in t or "_" in t),
        hint,
        word,
        not t.isascii(),
    ]
    return [*own, sign, hint, "=" in t or ":" in t, '"' in t or "'" in t, word]


class Shapes(dict):
    """Numbers of distinct tokens, whose features are rows of ``rows``; 0 is blank."""

    def __init__(self):
        super().__init__()
        self.rows = np.zeros((1 << 10, SHAPE + 5), np.float32)
        self.used, self.chars, self.new = 1, 0, []

    def __missing__(self, piece: str) -> int:
        if piece[0].isspace():
            number = 0
        else:
            number, self.used = self.used, self.used + 1
            self.new.append(shape(piece))
        self.chars += len(piece) + 64
        self[piece] = number
        return number

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the tokens of a whole text, their starts and their ends."""
        if self.chars > REMEMBERED:
            self.clear()
            self.used, self.chars = 1, 0
        pieces = _PIECES.findall(text)
        numbers = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        if self.new:
            while self.used > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[self.used - len(self.new) : self.used] = self.new
            self.new = []
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        starts = np.concatenate([[0], ends[:-1]]) if len(pieces) else ends
        on = numbers > 0
        return numbers[on], starts[on], ends[on]


def _moved(column: np.ndarray, by: int) -> np.ndarray:
    """The column of the token ``by`` places before (after, if negative); 0 beyond the text."""
    out = np.zeros_like(column)
    if by > 0:
        out[by:] = column[:-by]
    else:
        out[:by] = column[-by:]
    return out


def around(answers: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``AROUND`` features of each token by its neighbours: a hint, an assignment and quotes before it, and what follows."""
    sign, hint, mark, quote, word = answers.T
    one, two = _moved(sign, 1), _moved(sign, 1) * _moved(sign, 2)
    glued = np.zeros(len(starts), np.float32)
    glued[1:] = starts[1:] == ends[:-1]
    near = np.maximum(_moved(hint, 1), np.maximum(one * _moved(hint, 2), two * _moved(hint, 3)))
    assigned = np.maximum(_moved(mark, 1), one * _moved(mark, 2))
    return np.stack([near, assigned, _moved(quote, 1), _moved(quote, -1), _moved(word, 1), _moved(word, -1), glued, _moved(glued, -1)], 1)


def text_features(text: str, shapes: Shapes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row of ``WIDTH`` for each token of the whole text, the tokens' starts and ends."""
    numbers, starts, ends = shapes.tokens(text)
    rows = shapes.rows[numbers]
    of_file = np.tile(np.array(file_features(text), np.float32), (len(rows), 1))
    return np.concatenate([rows[:, :SHAPE], around(rows[:, SHAPE:], starts, ends), of_file], 1), starts, ends


def run_labels(places: list[tuple[int, int]], secrets: list[tuple[int, int]]) -> list[int]:
    """Tags of tokens by the base patterns' values."""
    out, open_ = [], None
    for a, b in places:
        own = next((s for s in secrets if s[0] < b and a < s[1]), None)
        out.append(OUTSIDE if own is None else INSIDE if own == open_ else BEGIN)
        open_ = own
    return out


class Crf:
    """Weights of a linear-chain conditional random field over outside, begin and inside."""

    def __init__(self, emit: np.ndarray, step: np.ndarray):
        self.emit, self.step = emit, step  # (WIDTH + 1, 3), (3, 3); the token before the first is outside

    def scores(self, x: np.ndarray) -> np.ndarray:
        return x @ self.emit[:-1] + self.emit[-1]

    def decode(self, x: np.ndarray) -> list[int]:
        """The best sequence of tags of rows of features."""
        return self.path(self.scores(x))

    def path(self, scores: np.ndarray) -> list[int]:
        """The best sequence of tags, by Viterbi; the token before the first is outside."""
        (oo, ob, oi), (bo, bb, bi), (io, ib, ii) = self.step.tolist()
        scores = scores.tolist()
        # best scores with the last token outside, begin, inside; of equal ones the first tag, written out as this takes most of the time
        o, b, i = oo + scores[0][0], ob + scores[0][1], oi + scores[0][2]
        back = []
        for so, sb, si in scores[1:]:
            no, to, nb, tb, ni, ti = o + oo, 0, o + ob, 0, o + oi, 0
            if (v := b + bo) > no:
                no, to = v, 1
            if (v := i + io) > no:
                no, to = v, 2
            if (v := b + bb) > nb:
                nb, tb = v, 1
            if (v := i + ib) > nb:
                nb, tb = v, 2
            if (v := b + bi) > ni:
                ni, ti = v, 1
            if (v := i + ii) > ni:
                ni, ti = v, 2
            back.append((to, tb, ti))
            o, b, i = no + so, nb + sb, ni + si
        tag = max(range(3), key=(o, b, i).__getitem__)
        out = [tag]
        for came in reversed(back):
            out.append(tag := came[tag])
        return out[::-1]

    def decode_text(self, scores: np.ndarray) -> list[tuple[int, int]]:
        """``(first, beyond)`` token numbers of the spans on the best path through a whole text.

        A token is outside on the best path for certain if any path gains by
        setting it outside, whatever stands before and behind it; where the next
        token went on inside, it begins then, as nothing goes on from outside.
        Such tokens divide the text, and Viterbi runs between them: the path is
        that of the whole text.
        """
        if not len(scores):
            return []
        step, behind = self.step, np.zeros(len(scores))
        behind[:-1] = scores[1:, INSIDE] - scores[1:, BEGIN]
        certain = np.ones(len(scores), bool)
        for tag, befores in ((BEGIN, (OUTSIDE, BEGIN, INSIDE)), (INSIDE, (BEGIN, INSIDE))):
            into = min(step[s, OUTSIDE] - step[s, tag] for s in befores)
            # the next token stays, or there is none
            out_of = min(0, *(step[OUTSIDE, t] - step[tag, t] for t in (OUTSIDE, BEGIN)))
            # it went on inside, and begins now
            anew = step[OUTSIDE, BEGIN] - step[tag, INSIDE] + min(0, *(step[BEGIN] - step[INSIDE]))
            certain &= scores[:, OUTSIDE] - scores[:, tag] + into + np.minimum(out_of, anew - behind) > SLACK
        open_ = np.flatnonzero(~certain)
        out = []
        for part in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1) if len(open_) else []:
            first, beyond = int(part[0]), int(part[-1]) + 1
            # with the certain token behind it, whose tag the path must also reach
            tags = self.path(scores[first : beyond + 1])[: beyond - first] if beyond < len(scores) else self.path(scores[first:beyond])
            start = None
            for i, tag in enumerate([*tags, OUTSIDE], first):
                if start is not None and tag != INSIDE:
                    out.append((start, i))
                    start = None
                if tag == BEGIN:
                    start = i
        return out


NEVER = -1e4
#: What a path must gain at least to count as better, over the rounding of sums.
SLACK = 1e-6


def fit(runs: list[tuple[np.ndarray, list[int]]]) -> Crf:
    """Maximum weighted conditional likelihood with a ridge, by Adam on all runs at once; marginals by forward and backward sums."""
    emit, step = np.zeros((WIDTH + 1, 3)), np.zeros((3, 3))
    emit[-1, OUTSIDE] = 1.0
    barred = np.zeros((3, 3))
    barred[OUTSIDE, INSIDE] = NEVER
    if not runs:
        return Crf(emit, step + barred)
    longest = max(len(y) for _, y in runs)
    x = np.zeros((len(runs), longest, WIDTH + 1))
    y, on = np.zeros((len(runs), longest), int), np.zeros((len(runs), longest), bool)
    for i, (own, tags) in enumerate(runs):
        x[i, : len(tags), :-1], x[i, : len(tags), -1], y[i, : len(tags)], on[i, : len(tags)] = own, 1, tags, True
    secret = (y * on > 0).any(1)
    weight = np.where(secret, max(1, min(BALANCE, (~secret).sum() / max(1, secret.sum()))), 1.0)
    weight /= weight.sum()
    hot = np.eye(3)[y] * (on * weight[:, None])[..., None]
    came = np.concatenate([np.tile(np.eye(3)[OUTSIDE], (len(runs), 1, 1)), np.eye(3)[y][:, :-1]], 1)
    flat = x.reshape(-1, WIDTH + 1)
    seen_emit = flat.T @ hot.reshape(-1, 3)
    seen_step = np.einsum("rtj,rtk->jk", came, hot)
    first = [np.zeros_like(w) for w in (emit, step)]
    second = [np.zeros_like(w) for w in (emit, step)]
    for k in range(1, ROUNDS + 1):
        scores, move = (flat @ emit).reshape(hot.shape), np.exp(step + barred)
        # sums over paths, scaled at each token; a floor keeps the path outside from vanishing
        own = np.exp(np.maximum(scores - scores.max(2, keepdims=True), -60))
        ahead, behind = np.empty_like(own), np.ones_like(own)
        ahead[:, 0] = move[OUTSIDE] * own[:, 0]
        for t in range(1, longest):
            new = (ahead[:, t - 1] @ move) * own[:, t]
            ahead[:, t] = np.where(on[:, t, None], new / new.sum(1, keepdims=True), ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = (own[:, t + 1] * behind[:, t + 1]) @ move.T
            behind[:, t] = np.where(on[:, t + 1, None], new / new.sum(1, keepdims=True), 1)
        single = ahead * behind
        single *= (on * weight[:, None])[..., None] / single.sum(2, keepdims=True)
        pair = ahead[:, :-1, :, None] * move * (own * behind)[:, 1:, None, :]
        pair *= (on * weight[:, None])[:, 1:, None, None] / pair.sum((2, 3), keepdims=True)
        slope_step = pair.sum((0, 1)) - seen_step
        slope_step[OUTSIDE] += single[:, 0].sum(0)
        slopes = [(flat.T @ single.reshape(-1, 3) - seen_emit) + RIDGE * emit, slope_step + RIDGE * step]
        for w, s, m, v in zip((emit, step), slopes, first, second):
            m += 0.1 * (s - m)
            v += 0.01 * (s * s - v)
            w -= RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Crf(emit, step + barred)


def varied(text: str, start: int, end: int, rng: random.Random) -> tuple[str, int, int]:
    """What stands around a secret with another one in its place, of other characters and introduced in another way."""
    letters, digits = string.ascii_letters, string.digits
    some = rng.choice([letters, letters + digits, string.ascii_lowercase + digits, string.ascii_uppercase + digits, letters + digits + "+/", letters + digits + "@!$#%"])
    value = "".join(rng.choices(some, k=rng.randint(8, 44)))
    if rng.random() < 0.25:
        value += rng.choice(".-_") + "".join(rng.choices(letters + digits, k=rng.randint(8, 44)))
    word = rng.choice(sorted(HINTS))
    before = text[max(0, start - CONTEXT) : start] + rng.choice([word, word.upper(), word.title(), f"my_{word}"]) + rng.choice([": ", "=", " = ", ' = "', ": '", " ", ":"])
    return before + value + " " + text[end : end + CONTEXT], len(before), len(before) + len(value)


def windows(text: str, shapes: Shapes) -> list[tuple[np.ndarray, list[int]]]:
    """Features and tags of windows of ``WINDOW`` tokens: all that hold a secret or a token with digits of 8 characters or more, and one in ``PLAIN`` others.

    The patterns know few forms, so each secret is also learned from with
    ``VARIANTS`` made-up ones in its place, drawn by a hash of the text.
    """
    base, rng = base_spans(text), random.Random(zlib.crc32(text.encode("utf-8", "replace")))
    out, of_file = _windows(text, [(s[3], s[4]) for s in base], shapes), file_features(text)
    for s in base:
        for _ in range(VARIANTS):
            around_it, a, b = varied(text, s[0], s[2], rng)
            for x, y in _windows(around_it, [(a, b)], shapes):
                if any(y):
                    x[:, SHAPE + AROUND :] = of_file
                    out.append((x, y))
    return out


def _windows(text: str, secrets: list[tuple[int, int]], shapes: Shapes) -> list[tuple[np.ndarray, list[int]]]:
    x, starts, ends = text_features(text, shapes)
    tags = run_labels(list(zip(starts.tolist(), ends.tolist())), secrets) if secrets else [OUTSIDE] * len(x)
    wanted = set((np.flatnonzero((x[:, 4] > 0) & (x[:, 1] >= 8 / 64)) // WINDOW).tolist()) | {i // WINDOW for i, tag in enumerate(tags) if tag}
    out = []
    for k in range((len(x) + WINDOW - 1) // WINDOW):
        at = slice(k * WINDOW, (k + 1) * WINDOW)
        if k in wanted or zlib.crc32(text[starts[at][0] : ends[at][-1]].encode("utf-8", "replace")) % PLAIN == 0:
            y = tags[at]
            out.append((x[at], [BEGIN if y[0] == INSIDE else y[0], *y[1:]]))
    return out


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Crf:
    """Learns the tagger from windows that the fixed patterns label, each also with the neighbouring words left out, so that shape alone can tell."""
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total = rows.count()
    parts = 1 << 20
    if total > sample:
        rows = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(parts)) < parts * sample // total)

    def run(batches):
        shapes = Shapes()
        for batch in batches:
            found = [w for text in batch.column(0).to_pylist() for w in windows(text, shapes)]
            x, y = [w.ravel().astype(float).tolist() for w, _ in found], [tags for _, tags in found]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.list_(pa.int32()))], names=["x", "y"])

    found = rows.select("text").mapInArrow(run, "x array<double>, y array<int>")
    kept = found.orderBy(F.xxhash64("x", "y"), "x", "y").limit(RUNS).collect()
    runs = [(np.array(r.x).reshape(-1, WIDTH), list(r.y)) for r in kept]
    if not any(any(y) for _, y in runs):
        return fit([])
    blind = []
    for x, y in runs:
        x = x.copy()
        x[:, SHAPE : SHAPE + AROUND - 2] = 0  # the neighbouring words and symbols
        blind.append((x, y))
    return fit(runs + blind)


def clipped(start: int, end: int, base: list[tuple], text: str) -> list[tuple[int, int]]:
    """What base spans leave of a span, where a letter or digit is in it."""
    out = []
    for s in [*(s for s in base if s[0] < end and start < s[2]), (end, 0, end)]:
        if start < s[0] and any(c.isalnum() for c in text[start : s[0]]):
            out.append((start, min(s[0], end)))
        start = max(start, s[2])
    return out


def all_spans(text: str, crf: Crf, shapes: Shapes) -> tuple[list[tuple], list[tuple]]:
    """The base spans, and all spans: those and what they leave of tagged ones."""
    base = base_spans(text)
    numbers, starts, ends = shapes.tokens(text)
    rows = shapes.rows[numbers]
    of_file = np.array(file_features(text)) @ crf.emit[SHAPE + AROUND : -1] + crf.emit[-1]
    scores = rows[:, :SHAPE] @ crf.emit[:SHAPE] + around(rows[:, SHAPE:], starts, ends) @ crf.emit[SHAPE : SHAPE + AROUND] + of_file
    tagged = [(int(starts[a]), int(ends[b - 1])) for a, b in crf.decode_text(scores)]
    return base, sorted(base + [(a, len(KINDS), b, a, b) for span in tagged for a, b in clipped(*span, base, text)])


def written(spans: list[tuple]) -> str:
    names = (*KINDS, "crf")
    return ",".join(f"{names[s[1]]}:{s[0]}:{s[2]}" for s in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per document row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``.

    ``spans`` lists ``kind:start:end`` in code points, end exclusive, by start and
    then kind; kinds are the fixed patterns and ``crf``. All tokens of a text are
    one chain, and any of them may be tagged. Of tagged spans, what no base span
    covers is added; base spans always stay. Null and empty texts have none. The
    tagger learns from some ``sample`` documents; without a secret in them it
    tags nothing. Every text is scanned whole; repeated rows are scanned each for
    themselves, an empty table gives no rows, other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, id_col, text_col, sample))

    def run(batches):
        crf, shapes = sent.value, Shapes()
        for batch in batches:
            counts, digests, spans = [[], [], []], [], []
            for text in batch.column(1).to_pylist():
                base, every = all_spans(text, crf, shapes) if text else ([], [])
                for kind, column in enumerate(counts):
                    column.append(sum(s[1] == kind for s in base))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(every))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
