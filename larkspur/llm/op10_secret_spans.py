"""Secret scans: rules, and a linear-chain conditional random field that adds to them.

The rules find assignments to a secret's name, access keys and long hexadecimal runs; their spans always stay.  The random field
tags all tokens of each whole text, one chain a text, as begin, inside or outside of a secret, from the shape of the token and its
neighbours, the secret's name and the sign before it, and features of the whole text; Viterbi decoding gives the best tags, and
tagged spans that meet no rule's span are added.  A span may hold white space between its tokens.

A token that is out on the best path whatever the others are cuts a chain without loss, so that only the stretches between
such tokens are decoded, all of a slice at once.

The field is trained on windows of a bounded sample of documents (about ``SAMPLE_DOCS``, by a hash of their id; at most
``SAMPLE_WINDOWS`` distinct ones around rules' values, around long tokens, around names and anywhere), the rules' values being the
tags to learn, and on ``MADE_UP`` windows with invented values of other shapes, or ordinary words, behind a name.

Defined results: a null or empty text has no spans; without texts to learn from no span is added; repeated rows give
a row each; positions are code points, ends exclusive; other columns are not read.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import common

#: Documents that training looks at, about; windows that it takes of each kind, at most; and made-up ones.
SAMPLE_DOCS, SAMPLE_WINDOWS, MADE_UP = 20_000, 400, 1_200
#: Tokens of a window before and after its middle.
BEFORE, AFTER = 14, 8
#: Passes of training, step and shrinkage.
PASSES, STEP, SHRINK = 6, 0.3, 1e-3

#: The rules, in the order in which their kinds are listed.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "crf")

_NAMES = re.compile(rb"pass|secret|token|key|auth|bearer|cred|pwd")
_CUES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key", b"akia")
_LOWER = common.byte_set(b"abcdefghijklmnopqrstuvwxyz")
_UPPER = common.byte_set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = common.byte_set(b"0123456789")
_HEX = common.byte_set(b"0123456789abcdef")
_VOWEL = common.byte_set(b"aeiouyAEIOUY")
#: Classes of bytes: space, key characters, beyond ASCII, and signs, each of which is a token.
_CLASS = np.full(256, 3, np.int8)
_CLASS[common.SPACE], _CLASS[128:] = 0, 2
_CLASS[common.byte_set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = 1
_SORT = _LOWER * 1 + _UPPER * 2 + _DIGIT * 3
OUT, BEGIN, INSIDE = 0, 1, 2


def rule_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of all rules' spans, sorted; a failing match still uses up its text."""
    found = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def has_hex(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """False for texts that surely have no span of kind hex."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], _HEX[data], [False]]).astype(np.int8)))
    a, b = edge[::2], edge[1::2]
    out = np.zeros(len(at) - 1, bool)
    # a run may go on into the next texts: all that it touches are looked at
    for x, y in zip(a[b - a >= 16], b[b - a >= 16]):
        out[np.searchsorted(at, x, "right") - 1 : np.searchsorted(at, y, "left")] = True
    return out


# -- tokens and features ---------------------------------------------------------------------------------------------


class Tokens:
    """All tokens of texts laid end to end: byte spans, the first token of each text, and whether each holds a secret's name."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        kind = _CLASS[data]
        before = np.concatenate([[0], kind[:-1]]).astype(np.int8)
        begins = at[:-1][np.diff(at) > 0]
        before[begins] = 0
        first = (kind > 0) & ((kind != before) | (kind == 3))
        edge = first | ((kind == 0) & (before > 0))
        edge[begins] = True
        edges = np.append(np.flatnonzero(edge), len(data))
        self.start = np.flatnonzero(first)
        self.end = edges[np.searchsorted(edges, self.start, "right")] if len(self.start) else self.start
        self.first = np.searchsorted(self.start, at)
        self.text = np.repeat(np.arange(len(at) - 1), np.diff(self.first))
        self.named = np.zeros(len(self.start), bool)
        raw = common.LOWER[data].tobytes()
        found = np.array([m.start() for m in _NAMES.finditer(raw)], np.int64)
        if len(found) and len(self.start):
            self.named[np.searchsorted(self.start, found, "right") - 1] = True

    def __len__(self) -> int:
        return len(self.start)

    def files(self, size: np.ndarray) -> np.ndarray:
        """What the features know of each whole text: whether it holds a secret's name, and its size."""
        named = np.bincount(self.text[self.named], minlength=len(self.first) - 1) > 0
        return named * 4 + np.minimum(np.log2(size + 1).astype(np.int64), 15) // 4


#: Sizes of the blocks of feature codes, in the order in which ``features`` gives them.
_BLOCKS = (19 * 16, 19 * 8, 5 * 8, 6 * 16, 256, 333, 333, 20 * 19, 20 * 16, 3 * 19, 8 * 2, 2 * 16, 64 * 2)
_BASES = np.cumsum((0, *_BLOCKS))


def features(data: np.ndarray, tokens: Tokens, files: np.ndarray) -> np.ndarray:
    """A code of each block for each token: its shape, its neighbours, the name and sign before it, and its text as a whole."""
    n = len(tokens)
    if not n:
        return np.zeros((0, len(_BLOCKS)), np.int64)
    a, b = tokens.start, tokens.end

    def count(flags: np.ndarray, lo: np.ndarray = a) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(flags, out=sums[1:])
        return (sums[b] - sums[lo]).astype(np.int64)

    length, lower, upper, digit = b - a, count(_LOWER[data]), count(_UPPER[data]), count(_DIGIT[data])
    sort = _SORT[data]
    switch = np.minimum(count(np.concatenate([[False], sort[1:] != sort[:-1]]), np.minimum(a + 1, b)), 7)
    class_ = _CLASS[data[a]]
    kinds = (lower > 0) * 1 + (upper > 0) * 2 + (digit > 0) * 4 + (length > lower + upper + digit) * 8
    kinds = np.where(_UPPER[data[a]] & (upper == 1) & (kinds == 3), 18, kinds)
    kinds = np.where(class_ == 2, 16, np.where(class_ == 3, 17, kinds))
    size = np.minimum(length, 47) // 3
    letters = lower + upper
    vowel = np.where(letters > 0, 4 * count(_VOWEL[data]) // np.maximum(letters, 1), 5)
    single = np.where(class_ == 3, data[a], 0).astype(np.int64)
    small = np.where(class_ == 3, single, 256 + kinds * 4 + np.minimum(size, 3))
    same = np.concatenate([[False], tokens.text[1:] == tokens.text[:-1]])
    back = np.where(same, np.concatenate([[332], small[:-1]]), 332)
    ahead = np.where(np.append(same[1:], False), np.append(small[1:], 332), 332)
    index = np.arange(n)
    last = np.maximum.accumulate(np.where(tokens.named, index, -1))
    last = np.where(last >= tokens.first[tokens.text], last, -1)
    signs = np.concatenate([[0], np.cumsum((single == 58) | (single == 61))])
    distance = np.where(last < 0, 9, np.minimum(index - last, 9))
    cue = distance * 2 + ((distance < 9) & (signs[index] > signs[np.maximum(last, 0)]))
    prior = np.concatenate([[0], b[:-1]])
    gap = np.where(same & (prior == a), 0, 1)
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    gap = np.where(same & (lines[a] > lines[np.minimum(prior, a)]), 2, gap)
    equal = same & np.concatenate([[False], length[1:] == length[:-1]])
    like = np.where(same, np.minimum(np.concatenate([[0], size[:-1]]), 7), 0) * 8 + np.minimum(size, 7)
    codes = (kinds * 16 + size, kinds * 8 + switch, 4 * digit // length * 8 + switch, vowel * 16 + size, single, back, ahead, cue * 19 + kinds, cue * 16 + size, gap * 19 + kinds, files[tokens.text] * 2 + (size > 3), (count(_HEX[data]) == length) * 16 + size, like * 2 + equal)
    return np.stack([c + base for c, base in zip(codes, _BASES)], 1)


class Field:
    """Linear-chain conditional random field with tags out, begin and inside; inside never follows out."""

    def __init__(self):
        self.weights = np.zeros((_BASES[-1], 3))
        self.moves = np.zeros((3, 3))
        self.moves[OUT, INSIDE] = -1e9
        self.first = np.array([0.0, 0.0, -1e9])

    def scores(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), 3))
        for k in range(codes.shape[1]):
            out += self.weights[codes[:, k]]
        return out

    def surely_out(self, unary: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Tokens that are out on the best path whatever the others are: to take them out (and an inside after them to begin)
        gains more by their own scores than moves, and the score of the token after them, can lose.  No token comes after the ``last`` ones."""
        m, own = self.moves, (BEGIN, INSIDE)
        enter = min(min(m[p, OUT] - m[p, y] for p in range(3) for y in own), 0.0)
        leave = min(min(m[OUT, n] - m[y, n] for n in (OUT, BEGIN) for y in own), 0.0)
        turn = min(m[OUT, BEGIN] - m[y, INSIDE] for y in own) + min(*(m[BEGIN, n] - m[INSIDE, n] for n in range(3)), 0.0)
        after = np.append(unary[1:, BEGIN] - unary[1:, INSIDE], 0.0)
        moved = np.minimum(leave, turn + after)
        moved[last] = 0.0
        return unary[:, OUT] - unary[:, 1:].max(1) + enter + moved > 1e-9

    def decode(self, unary: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best tags of whole chains laid end to end, ``first`` being where each begins and the end of all.

        Chains fall apart, without loss, at tokens that are surely out; what is left between them is decoded by Viterbi, all
        stretches at once.
        """
        n = len(unary)
        tags = np.zeros(n, np.int8)
        if not n:
            return tags
        begins = np.zeros(n + 1, bool)
        begins[first] = True
        open_ = ~self.surely_out(unary, begins[1:])
        starts = np.flatnonzero(open_ & (begins[:-1] | ~np.concatenate([[False], open_[:-1]])))
        if not len(starts):
            return tags
        stops = np.flatnonzero(open_ & (begins[1:] | ~np.append(open_[1:], False))) + 1
        order = np.argsort(starts - stops, kind="stable")
        starts, stops = starts[order], stops[order]
        size = stops - starts
        best = np.where(begins[starts][:, None], self.first, self.moves[OUT]) + unary[starts]
        back = np.zeros((n, 3), np.int8)
        for t in range(1, int(size[0])):
            k = int(np.searchsorted(-size, -t, "left"))  # stretches longer than t
            paths = best[:k, :, None] + self.moves
            back[starts[:k] + t] = paths.argmax(1)
            best[:k] = paths.max(1) + unary[starts[:k] + t]
        final = (best + np.where(begins[stops][:, None], 0.0, self.moves[:, OUT])).argmax(1)
        for t in range(int(size[0]) - 1, -1, -1):
            k = int(np.searchsorted(-size, -t, "left"))
            tags[starts[:k] + t] = final[:k]
            final[:k] = back[starts[:k] + t, final[:k]]
        return tags

    def train(self, chains: list[tuple[np.ndarray, np.ndarray]], passes: int = PASSES, seed: int = 1) -> None:
        """Maximise the likelihood of the tags by adaptive gradient steps, a chain at a time."""
        rng, seen, seen_moves = np.random.default_rng(seed), np.full_like(self.weights, 1e-6), np.full((3, 3), 1e-6)
        for _ in range(passes):
            for k in rng.permutation(len(chains)):
                codes, tags = chains[k]
                own, moved = self.slopes(codes, tags)
                at, place = np.unique(codes, return_inverse=True)
                g = np.zeros((len(at), 3))
                np.add.at(g, place.reshape(codes.shape), own[:, None, :])
                g -= SHRINK * self.weights[at]
                seen[at] += g * g
                self.weights[at] += STEP * g / np.sqrt(seen[at])
                seen_moves += moved * moved
                step = STEP * moved / np.sqrt(seen_moves)
                step[OUT, INSIDE] = 0
                self.moves += step

    def slopes(self, codes: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The gradient of the log-likelihood of a chain's tags by each token's scores, and by the moves."""
        unary, n = self.scores(codes), len(tags)
        forward, backward = np.empty((n, 3)), np.zeros((n, 3))
        forward[0] = self.first + unary[0]
        for i in range(1, n):
            forward[i] = np.logaddexp.reduce(forward[i - 1][:, None] + self.moves, 0) + unary[i]
        for i in range(n - 2, -1, -1):
            backward[i] = np.logaddexp.reduce(self.moves + unary[i + 1] + backward[i + 1], 1)
        total = np.logaddexp.reduce(forward[-1])
        own = -np.exp(forward + backward - total)
        own[np.arange(n), tags] += 1
        moved = -np.exp(forward[:-1, :, None] + self.moves + (unary[1:] + backward[1:])[:, None, :] - total).sum(0)
        np.add.at(moved, (tags[:-1], tags[1:]), 1)
        return own, moved


def _joined(starts, kinds, ends) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in zip(starts, kinds, ends))


def tagged_spans(data: np.ndarray, at: np.ndarray, field: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first byte and last byte + 1 of all spans that the field tags as secrets, in order."""
    tokens = Tokens(data, at)
    tags = field.decode(field.scores(features(data, tokens, tokens.files(np.diff(at)))), tokens.first)
    begun = np.flatnonzero(tags == BEGIN)
    ends = np.flatnonzero((tags != OUT) & (np.append(tags[1:], OUT) != INSIDE))
    return tokens.text[begun], tokens.start[begun], tokens.end[ends]


# -- training --------------------------------------------------------------------------------------------------------


def windows(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, each: int = SAMPLE_WINDOWS, doc_id: str = "doc_id", text: str = "text") -> list[tuple[int, str, int, str]]:
    """kind, text, file feature and values ("start:end" in bytes) of at most ``each`` distinct windows of each kind.

    Kinds: 0 around a rule's value, 1 around a long token or one with a digit, 2 around a secret's name, 3 anywhere.
    """
    n = docs.count()
    rows = docs.where(common.sampled(F.xxhash64(doc_id, F.lit("sample")), F.lit(common.share_of(sample_docs, n)))) if sample_docs < n else docs

    def run(batches):
        for part in common.slices(batches):
            data, at = common.text_bytes(part.column(0))
            tokens = Tokens(data, at)
            files = tokens.files(np.diff(at))
            raw, low, out = data.tobytes(), common.LOWER[data].tobytes(), []
            look = has_hex(data, at)
            sums = np.concatenate([[0], np.cumsum(_DIGIT[data])])
            odd = (tokens.end - tokens.start >= 8) & ((sums[tokens.end] > sums[tokens.start]) | (tokens.end - tokens.start >= 24))
            for k, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist())):
                lo, hi = int(tokens.first[k]), int(tokens.first[k + 1])
                if lo == hi:
                    continue
                values = np.zeros((0, 2), np.int64)
                if look[k] or any(low.find(c, a, b) >= 0 for c in _CUES):
                    own = raw[a:b].decode("utf-8")
                    size = np.concatenate([[0], np.cumsum([len(c.encode()) for c in own])])
                    values = np.array([(a + size[v], a + size[y]) for _, _, y, v in rule_spans(own)], np.int64).reshape(-1, 2)
                middles = [(0, int(t)) for t in np.searchsorted(tokens.start, values[:, 0], "right") - 1]
                middles += [(1, int(t)) for t in lo + np.flatnonzero(odd[lo:hi])] + [(2, int(t)) for t in lo + np.flatnonzero(tokens.named[lo:hi])]
                middles.append((3, lo + int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=6).digest(), "big") % (hi - lo)))
                for kind, t in middles:
                    x, y = int(tokens.start[max(lo, t - BEFORE)]), int(tokens.end[min(hi - 1, t + AFTER)])
                    inside = values[(values[:, 0] < y) & (values[:, 1] > x)]
                    if (kind == 0) == (len(inside) > 0):
                        out.append((kind, raw[x:y].decode("utf-8"), int(files[k]), ",".join(f"{max(p - x, 0)}:{min(q, y) - x}" for p, q in inside.tolist())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.string(), pa.int64(), pa.string()))], ["kind", "window", "file", "inside"])

    found = common.materialize(rows.select(F.col(text).alias("text")).mapInArrow(run, "kind int, window string, file long, inside string"), "windows")
    out = []
    for kind in range(4):
        # copies teach nothing new, and must not use up the sample
        own = found.where(F.col("kind") == kind).distinct()
        out += [tuple(r) for r in own.orderBy(F.xxhash64("window"), "window", "file", "inside").limit(each).collect()]
    return out


def made_up(plain: list[str], n: int, seed: int = 1) -> list[tuple[str, list[tuple[int, int]]]]:
    """Windows with a value of some shape, or ordinary words, put behind a name: texts and byte spans of the values."""
    rng = random.Random(seed)
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    draw = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    parts = lambda sign: sign.join(draw(rng.choice([letters, letters.upper(), letters + digits, letters + letters.upper() + digits]), k) for k in [rng.randrange(4, 7)] * rng.randrange(3, 7))
    shapes = (
        lambda: draw(letters + letters.upper() + digits, rng.randrange(12, 44)),
        lambda: draw(letters + letters.upper(), rng.randrange(12, 40)),
        lambda: draw(letters + digits, rng.randrange(12, 40)),
        lambda: draw(letters + letters.upper() + digits + "+/_-", rng.randrange(16, 44)),
        lambda: "".join(draw(letters, rng.randrange(3, 8)).capitalize() for _ in range(rng.randrange(3, 6))),
        lambda: parts(rng.choice("-.:")),
        lambda: parts(" "),
    )
    names = ("password", "passwd", "Password", "secret", "token", "api key", "API_KEY", "auth", "credentials", "pwd", "bearer", "access key")
    links = (" is ", " was ", " ", ": ", " = ", "=", " -> ", " (", " \"", " set to ", " will be ")
    out = []
    for k in range(n if plain else 0):
        words = rng.choice(plain).split() or ["x"]
        cut = rng.randrange(len(words) + 1)
        left, right = " ".join(words[:cut]), " ".join(words[cut:])
        lead = f"{left} {rng.choice(names)}{rng.choice(links)}"
        secret = k % 3 < 2
        value = shapes[rng.randrange(len(shapes))]() if secret else " ".join(rng.choice(rng.choice(plain).split() or ["x"]) for _ in range(rng.randrange(1, 5)))
        tail = rng.choice([" ", ". ", ", ", "\n", ") "])
        begin = len(lead.encode())
        out.append((lead + value + tail + right, [(begin, begin + len(value.encode()))] if secret else []))
    return out


def _chain(text: str, file: int | None, values: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Feature codes and tags of a window, its tokens within a value being tagged."""
    data = np.frombuffer(text.encode(), np.uint8)
    at = np.array([0, len(data)])
    tokens = Tokens(data, at)
    tags = np.zeros(len(tokens), np.int64)
    for a, b in values:
        inside = np.flatnonzero((tokens.start >= a) & (tokens.end <= b))
        tags[inside], tags[inside[:1]] = INSIDE, BEGIN
    return features(data, tokens, tokens.files(np.diff(at)) if file is None else np.array([file])), tags


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, each: int = SAMPLE_WINDOWS, invented: int = MADE_UP, doc_id: str = "doc_id", text: str = "text") -> Field | None:
    """A field trained on windows of a bounded sample of documents, and on windows with made-up values; None without any."""
    with common.scratch(docs.sparkSession):
        found = windows(docs, sample_docs, each, doc_id, text)
    chains = [_chain(w, file, [tuple(map(int, v.split(":"))) for v in inside.split(",") if v]) for _, w, file, inside in found]
    chains += [_chain(w, None, values) for w, values in made_up([w for kind, w, _, _ in found if kind == 3], invented)]
    chains = [c for c in chains if len(c[1])]
    if not chains:
        return None
    field = Field()
    field.train(chains)
    return field


def scan_secrets(docs: DataFrame, field: Field | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 of the rules' spans, and all spans as kind:start:end; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches):
        model = shared.value
        for part in common.slices(batches):
            data, at = common.text_bytes(part.column(1))
            look = has_hex(data, at)
            tagged: dict[int, list[tuple[int, int]]] = {}
            if model is not None:
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                texts, begins, ends = tagged_spans(data, at, model)
                for k, x, y in zip(texts.tolist(), (points[begins] - points[at[texts]]).tolist(), (points[ends] - points[at[texts]]).tolist()):
                    tagged.setdefault(k, []).append((x, y))
            raw = common.LOWER[data].tobytes()
            counts = np.zeros((part.num_rows, 3), np.int64)
            digests, spans = [empty] * part.num_rows, [""] * part.num_rows
            for k, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist())):
                base = []
                if look[k] or any(raw.find(c, a, b) >= 0 for c in _CUES):
                    base = [(x, kind, y) for x, kind, y, _ in rule_spans(data[a:b].tobytes().decode("utf-8"))]
                for _, kind, _ in base:
                    counts[k, kind] += 1
                if base:
                    digests[k] = hashlib.sha256(_joined(*zip(*base)).encode()).hexdigest()
                every = sorted(base + [(x, 3, y) for x, y in tagged.get(k, []) if not any(x < q and p < y for p, _, q in base)])
                if every:
                    spans[k] = _joined(*zip(*every))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(counts[:, k]) for k in range(3)), pa.array(digests), pa.array(spans)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    return scan_secrets(docs, fit(docs))
