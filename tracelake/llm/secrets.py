"""Secret scans: fixed patterns, and a linear-chain conditional random field that tags tokens B, I or O.

Features of a token are its shape, the shapes and signs around it, hints before it, and the file it stands in. Weights are
learned here by conditional likelihood (forward-backward, Adam, a small L2 term) on labelled texts that `training_texts` writes
(a fixed seed, nothing from the corpus); no token is barred from any tag but I after O. Decoding is Viterbi over all tokens of a text, done
exactly where it can matter: a stretch of tags B I I ... only beats O throughout if the sum of its tokens' gains is positive,
so tokens that no such stretch can hold are O in the best path, and paths are worked out between them. Very long texts are read
in pieces that end at such tokens.

Defined results: null text counts as empty; offsets are code points, ends exclusive; a tagged stretch that touches a span of
the patterns adds nothing; of equal paths the one with more O is taken; copies of a row give equal results; an empty table
gives an empty table; other columns are ignored by `scan` and kept by `mask`, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "tagged")
ASSIGN = r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[\w+/-]+|[^\w\s+/-]|\n"
HINTS = frozenset("password passwd pwd pass passphrase secret token key apikey api_key access credential credentials auth bearer private signature sig".split())
#: Code points read at once; tokens of one piece take about 60 bytes each.
PIECE = 1 << 20
#: Distinct tokens whose type a worker remembers.
REMEMBERED = 200_000


def base_spans(text: str, patterns) -> list[tuple[int, int, str]]:
    """Spans of the three patterns, by start and then kind."""
    assign, access, hexa = patterns
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in access.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in hexa.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


class _Kinds(dict):
    """Translation of a character to its kind, worked out when it is first seen."""

    def __missing__(self, code):
        c = chr(code)
        self[code] = "A" if c.isupper() else "0" if c.isdigit() else "a" if c.isalpha() else "-"
        return self[code]


KIND = _Kinds()
SOUND = str.maketrans({c: "v" if c in "aeiouy" else "c" for c in "abcdefghijklmnopqrstuvwxyz"})
SOUNDS = re.compile("c+")
NAMED = re.compile("secret|token|passw|passph|api_?key")
TURNS = [x + y for x in "Aa0-" for y in "Aa0-" if x != y]


def shape(token: str) -> tuple[str, ...]:
    """What a token looks like; a few thousand different answers over any text."""
    n = len(token)
    if n == 1 and not token.isalnum():
        return (f"sign={token if token.isascii() else '?'}",)
    kinds, lower = token.translate(KIND), token.lower()
    upper, digit = kinds.count("A"), kinds.count("0")
    letters = upper + kinds.count("a")
    switches = sum(map(kinds.count, TURNS)) if upper or letters < n else 0
    out = [f"len={min(n // 4, 10)}", f"digits={10 * digit // n}", f"switch={min(10 * switches // n, 8)}", f"mix={letters > upper:d}{upper > 0:d}{digit > 0:d}{n > letters + digit:d}"]
    if letters >= 8:
        sounds = lower.translate(SOUND)
        run = max(map(len, SOUNDS.findall(sounds)), default=0)
        out += [f"vowels={10 * (letters - sounds.count('c')) // letters}", f"consonants={min(run, 8)}"]
    if letters == n and switches <= 1 and kinds[1:].count("A") == 0:
        out.append("word")
    if n >= 8 and (digit or letters == n) and all(c in "0123456789abcdef-" for c in lower):
        out.append("hex")
    if lower in HINTS or n < 24 and NAMED.search(lower):
        out.append("hint")
    return tuple(out)


def own_features(seen: tuple[str, ...], file: tuple[str, str]) -> list[str]:
    return ["bias", *seen, *(f"{x}&{seen[0]}" for x in file), *(f"{seen[0]}&{x}" for x in seen[1:4])]


def neighbour_features(seen: tuple[str, ...], place: int) -> list[str]:
    """What a token `place` places away adds."""
    return [f"{place}:{x}" for x in seen if x[0] in "shmw"]


def hinted_features(seen: tuple[str, ...]) -> list[str]:
    return ["hinted", *(f"hinted&{x}" for x in seen)]


PLACES, HINT_REACH = (-2, -1, 1), 5
FILES = [(f"code={i}", size) for i in range(4) for size in ("short", "long")]


def file_features(text: str) -> int:
    """Which of FILES a text is: how much it looks like code, and whether it is long."""
    lines = text.count("\n") + 1
    return 2 * min(3, 4 * (text.count("=") + text.count("{") + text.count(";")) // lines) + (len(text) > 2000)


def viterbi(emit: np.ndarray, move: np.ndarray) -> list[int]:
    """Best path over the states O, B, I; I never follows O and never starts."""
    score, back = emit[0] + np.array([0, 0, -1e9]), []
    for row in emit[1:]:
        every = score[:, None] + move
        back.append(every.argmax(axis=0))
        score = every.max(axis=0) + row
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


BAN = np.zeros((3, 3))
BAN[0, 2] = -1e9


class Field:
    """A trained field, ready to decode: weights by feature and the moves between states. Scores are over O's."""

    def __init__(self, model):
        self.weights, self.move = model
        self.types: dict[tuple, int] = {}
        self.of: dict[str, int] = {}
        self.rows: list[list[np.ndarray]] = []
        self.hints: list[bool] = []
        self.tables = None
        self.none = [self.sum([f"{d}:none"]) for d in PLACES]
        m = self.move
        # the most that one more tag of a stretch, its end, or going on with I instead of beginning can gain by moves alone
        self.step = max(m[0, 1] - m[0, 0], m[1, 1] - m[0, 0], m[2, 1] - m[0, 0], m[1, 2] - m[0, 0], m[2, 2] - m[0, 0], 0.0)
        self.end = max(max(m[last, then] - m[0, then] for last in (1, 2) for then in (0, 1)), 0.0)
        self.on = max(m[1, 2], m[2, 2]) - m[0, 1]

    def sum(self, features) -> np.ndarray:
        """What features add to B and I over what they add to O."""
        total = np.sum([self.weights.get(f, ZERO) for f in features], axis=0) if features else ZERO
        return total[1:] - total[0]

    def type_of(self, token: str) -> int:
        seen = shape(token)
        number = self.types.get(seen)
        if number is None:
            number = self.types[seen] = len(self.types)
            self.rows.append([*(self.sum(own_features(seen, f)) for f in FILES), *(self.sum(neighbour_features(seen, d)) for d in PLACES), self.sum(hinted_features(seen))])
            self.hints.append("hint" in seen)
            self.tables = None
        if len(self.of) >= REMEMBERED:
            self.of.clear()
        self.of[token] = number
        return number

    def emissions(self, tokens: list[str], file: int) -> np.ndarray:
        """Two rows: how much B and I gain over O at every token."""
        ids = list(map(self.of.get, tokens))
        if None in ids:
            ids = [self.type_of(t) if k is None else k for t, k in zip(tokens, ids, strict=True)]
        ids = np.array(ids, np.int64)
        if self.tables is None:
            self.tables, self.is_hint = np.array(self.rows).transpose(1, 2, 0).copy(), np.array(self.hints)
        hint = self.is_hint[ids]
        if hint.any():
            before = np.concatenate(([0], np.cumsum(hint)))
            at = np.arange(len(ids))
            hinted = np.flatnonzero(before[at] > before[np.maximum(at - HINT_REACH, 0)])
        out = np.empty((2, len(ids)))
        for state, row in enumerate(out):
            np.take(self.tables[file, state], ids, out=row)
            for k, d in enumerate(PLACES):
                table, none = self.tables[len(FILES) + k, state], self.none[k][state]
                if d < 0:
                    row[-d:] += table[ids[:d]]
                    row[:-d] += none
                else:
                    row[:-d] += table[ids[d:]]
                    row[-d:] += none
            if hint.any():
                row[hinted] += self.tables[-1, state][ids[hinted]]
        return out

    def gains(self, emit: np.ndarray):
        """(running sum, least of it before each token) of the most that a tag can gain over O at each token."""
        upto = np.concatenate(([0.0], np.cumsum(np.maximum(emit[0], emit[1]) + self.step)))
        return upto, np.minimum.accumulate(upto[:-1])

    def may_be_tagged(self, emit: np.ndarray) -> np.ndarray:
        """Tokens that some stretch of tags with more gain than loss can hold; all others are O in the best path."""
        upto, least = self.gains(emit)
        most = np.maximum.accumulate(upto[:0:-1])[::-1]
        return most - least + self.end > -1e-9

    def parting(self, emit: np.ndarray) -> int | None:
        """The last token that is O whatever follows, not too near the end: any stretch over it loses more up to there than
        it saves by going on behind it instead of beginning there."""
        if emit.shape[1] < 3 * HINT_REACH:
            return None
        upto, least = self.gains(emit)
        saved = np.maximum(emit[1, 1:] - emit[0, 1:] + self.on, 0)
        good = np.flatnonzero((upto[1:] - least)[:-1] + saved + self.end < -1e-9)
        good = good[(good > 2 * HINT_REACH) & (good < emit.shape[1] - HINT_REACH)]
        return int(good[-1]) if len(good) else None

    def stretches(self, emit: np.ndarray, after_o: bool = False) -> list[tuple[int, int]]:
        """First and last token of each tagged stretch of the best path."""
        out, places = [], np.flatnonzero(self.may_be_tagged(emit))
        for part in np.split(places, np.flatnonzero(np.diff(places) > 1) + 1):
            if not len(part):
                continue
            a, b = int(part[0]), int(part[-1]) + 1
            scores = np.concatenate((np.zeros((1, b - a)), emit[:, a:b])).T
            # the O on either side has its say by the moves from and to it
            if a or after_o:
                scores[0] += self.move[0]
            if b < emit.shape[1]:
                scores[-1] += self.move[:, 0]
            for k, state in enumerate(viterbi(scores, self.move)):
                if state == 1:
                    out.append([a + k, a + k])
                elif state == 2:
                    out[-1][1] = a + k
        return [tuple(x) for x in out]

    def spans(self, text: str, tokenizer, piece: int = PIECE) -> list[tuple[int, int]]:
        """Tagged spans of a text as code points. A long text is read in pieces; the tokens before a parting are context."""
        out, at, context, size, file = [], 0, 0, piece, file_features(text)
        while at < len(text):
            end = min(at + size, len(text))
            while end < len(text) and not text[end].isspace():
                end += 1
            part = text[at:end]
            tokens = tokenizer.findall(part)
            if not tokens:
                if end == len(text):
                    break
                if context == 0 and at == 0:
                    at = end
                    continue
                size *= 2
                continue
            emit = self.emissions(tokens, file)[:, context:]
            stop = None
            if end < len(text):
                stop = self.parting(emit)
                if stop is None:
                    size *= 2
                    continue
                emit = emit[:, : stop + 1]
            found = self.stretches(emit, context > 0)
            if found or stop is not None:
                places = [m.span() for m in tokenizer.finditer(part)]
                out += [(at + places[context + a][0], at + places[context + b][1]) for a, b in found]
            if stop is None:
                break
            # the next piece begins with enough tokens before the parting, which itself is O
            back = context + stop + 1 - 2 * HINT_REACH
            at, context, size = at + places[back][0], 2 * HINT_REACH, piece
        return out


ZERO = np.zeros(3)


def training_texts(n: int = 1200, seed: int = 3):
    """(text, spans of secrets): secrets of many forms, letters alone too, and look-alikes that are none."""
    rng = random.Random(seed)
    syllables = "an the er on re th ed ing to of st at in es ou ha le de que ion ment aux pa sch ich ung ver ent os ado ar ció la schaft fahrts dampf gesell str ght ness".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 6)))
    pick = lambda alphabet, lo, hi: "".join(rng.choice(alphabet) for _ in range(rng.randint(lo, hi)))
    low, high, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    every = low + high + dig
    hint = lambda: rng.choice(["password", "passphrase", "pwd", "secret", "token", "key", "api_key", "Bearer", "auth", "credential", "client_secret", "DB_PASSWORD"])
    sign = lambda: rng.choice([" = ", ": ", "=", '="', ': "', " ", ":\n  "])
    words = lambda lo, hi: " ".join(rng.choice([word(), word(), word().capitalize(), word().upper()]) if rng.random() < 0.2 else word() for _ in range(rng.randint(lo, hi)))

    def key():  # tells itself, hint or not
        return rng.choice(
            [
                lambda: pick("0123456789abcdef", 32, 64),
                lambda: pick(every, 20, 44),
                lambda: "sk_live_" + pick(every, 20, 30),
                lambda: "ghp_" + pick(every, 30, 38),
                lambda: pick(every + "+/", 36, 60) + "=" * rng.randint(0, 2),
                lambda: ".".join((pick(every, 20, 30), pick(every, 24, 50), pick(every + "_-", 24, 44))),
                lambda: "AKIA" + pick(high + dig, 16, 16),
                lambda: pick(low + high, 20, 40),
                lambda: pick(low + high, 16, 30),
            ]
        )()

    def hinted():  # a secret only where something says so
        return rng.choice(
            [key, key, lambda: word().capitalize() + word().capitalize() + word().capitalize(), lambda: word() + word().capitalize() + word().capitalize(), lambda: word() + pick(dig, 2, 6) + rng.choice(["", "x", "Q"]), lambda: pick(low, 12, 24), lambda: pick(low + high, 12, 24), lambda: pick(every, 8, 18)]
        )()

    def plain():
        return rng.choice(
            [
                lambda: f"{word()}.{pick(dig, 1, 3)}@mail{rng.randint(1, 9)}.example.com",
                lambda: f"({pick(dig, 3, 3)}){pick(dig, 3, 3)}-{pick(dig, 4, 4)}",
                lambda: pick(dig, 1, 19),
                lambda: f"20{pick(dig, 2, 2)}-{pick('01', 2, 2)}-{pick(dig, 2, 2)}T{pick(dig, 2, 2)}:{pick(dig, 2, 2)}",
                lambda: f"https://{word()}.example.org/{word()}/{word()}{pick(dig, 1, 4)}?page={pick(dig, 1, 2)}",
                lambda: word() + word() + pick(dig, 1, 4),
                lambda: f"{word()}_{word()}_{pick(dig, 1, 3)}",
                lambda: f"v{pick(dig, 1, 2)}.{pick(dig, 1, 2)}.{pick(dig, 1, 2)}-beta{pick(dig, 1, 1)}",
                lambda: pick(dig, 1, 4) + rng.choice(["GB", "mm", "th", "px", "kHz"]) + word(),
                lambda: word() + word().capitalize() + word().capitalize(),
                lambda: word().capitalize() + word() + word(),
                lambda: f"{word()}-{word()}-{word()}",
                lambda: word() * 2 + word(),
                lambda: (word() + word() + word()).capitalize(),
                lambda: f"/{word()}/{word()}/{word()}.{rng.choice(['txt', 'py', 'html'])}",
                lambda: f"{word()}({word()}, {word()}) {{ return {pick(dig, 1, 3)}; }}",
                lambda: f"{word()}{rng.choice('%#$&*')}{rng.choice('%#$&*')}{rng.choice('%#$&*')}",
                *[lambda: hint() + " " + words(1, 4)] * 2,
                *[lambda: hint() + rng.choice([" is ", " of ", " for ", " must be "]) + words(1, 3)] * 3,
            ]
        )()

    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(1, 4)):
            text += words(0, 8) + " "
            draw = rng.random()
            if draw < 0.4:
                text += plain()
            else:
                text += hint() + sign() if draw < 0.75 else ""
                secret = hinted() if draw < 0.75 else key()
                spans.append((len(text), len(text) + len(secret)))
                text += secret + rng.choice(["", "", "", "", '"', ";", ".", ","])
            text += rng.choice([" ", "\n", " "])
        yield text + words(0, 5) + ".", spans


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis=axis, keepdims=True)
    return (most + np.log(np.exp(x - most).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(emit: np.ndarray, move: np.ndarray, length: np.ndarray):
    """(log of the sum over all paths, chances of states, summed chances of moves) of padded sequences, by forward-backward."""
    n, most, _ = emit.shape
    ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
    ahead[:, 0] = emit[:, 0] + np.array([0, 0, -1e9])
    for t in range(1, most):
        ahead[:, t] = emit[:, t] + _log_sum(ahead[:, t - 1, :, None] + move, 1)
    for t in range(most - 2, -1, -1):
        after = _log_sum(move + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
        behind[:, t] = np.where((t < length - 1)[:, None], after, 0.0)
    total = _log_sum(ahead[np.arange(n), length - 1], 1)
    inside = np.arange(most) < length[:, None]
    states = np.where(inside[:, :, None], np.exp(np.minimum(ahead + behind - total[:, None, None], 0)), 0.0)
    both = ahead[:, :-1, :, None] + move + (emit[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]
    moves = np.where(inside[:, 1:, None, None], np.exp(np.minimum(both, 0)), 0.0).sum(axis=(0, 1))
    return total, states, moves


@functools.cache
def train(rounds: int = 100, rate: float = 0.15, ridge: float = 1e-4) -> tuple[dict, np.ndarray]:
    """Weights by feature and the moves between states, by the conditional likelihood of labelled texts."""
    tokenizer = re.compile(TOKEN)
    names: dict[str, int] = {}
    lists, gold, length = [], [], []
    for text, spans in training_texts():
        found = [(m.group(), m.start()) for m in tokenizer.finditer(text)]
        shapes, file = [shape(t) for t, _ in found], FILES[file_features(text)]
        starts = {a for a, _ in spans}
        gold.append([1 if at in starts else 2 if any(a < at < b for a, b in spans) else 0 for _, at in found])
        length.append(len(found))
        for i, seen in enumerate(shapes):
            fs = own_features(seen, file)
            for d in PLACES:
                fs += neighbour_features(shapes[i + d], d) if 0 <= i + d < len(shapes) else [f"{d}:none"]
            if any("hint" in s for s in shapes[max(0, i - HINT_REACH) : i]):
                fs += hinted_features(seen)
            lists.append([names.setdefault(f, len(names)) for f in fs])
    length = np.array(length)
    n, most = len(length), int(length.max())
    edge = np.cumsum([0] + [len(x) for x in lists])[:-1]
    flat = np.concatenate([np.array(x) for x in lists])
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    inside = np.arange(most) < length[:, None]
    want = np.zeros((n, most, 3))
    want[inside] = np.eye(3)[np.concatenate(gold)]
    want_moves = np.einsum("nta,ntb->ab", want[:, :-1], want[:, 1:])
    weights, move = np.zeros((len(names), 3)), np.zeros((3, 3))
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(move), np.zeros_like(move)]
    for step in range(1, rounds + 1):
        emit = np.zeros((n, most, 3))
        emit[inside] = np.add.reduceat(weights[flat], edge)
        _, states, moves = marginals(emit, move + BAN, length)
        wrong = (want - states)[inside]
        slope = np.stack([np.bincount(flat, wrong[owner, k], len(names)) for k in range(3)], axis=1) / n - ridge * weights
        turn = (want_moves - moves) / n - ridge * move
        for value, grad, k in ((weights, slope, 0), (move, turn, 2)):
            state[k] = 0.9 * state[k] + 0.1 * grad
            state[k + 1] = 0.99 * state[k + 1] + 0.01 * grad**2
            value += rate * (state[k] / (1 - 0.9**step)) / (np.sqrt(state[k + 1] / (1 - 0.99**step)) + 1e-8)
    return {f: weights[i] for f, i in names.items()}, move + BAN


def spans_of(text: str, field: Field, patterns, tokenizer, piece: int = PIECE) -> list[tuple[int, int, str]]:
    base = base_spans(text, patterns)
    extra = [(a, b, "tagged") for a, b in field.spans(text, tokenizer, piece) if all(b <= x or a >= y for x, y, _ in base)]
    return sorted(base + extra, key=lambda s: (s[0], KINDS.index(s[2])))


def _compiled():
    return (re.compile(ASSIGN), re.compile(ACCESS), re.compile(HEX)), re.compile(TOKEN)


def written(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _scan(model):
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_tagged", pa.int64())])

    def run(batches):
        field, (patterns, tokenizer) = Field(model), _compiled()
        for batch in batches:
            out = []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                spans = spans_of(value.as_py() or "", field, patterns, tokenizer)
                n = {k: sum(s[2] == k for s in spans) for k in KINDS}
                base = written(s for s in spans if s[2] != "tagged")
                out.append((doc, n["assign"], n["access"], n["hex"], hashlib.sha256(base.encode()).hexdigest(), written(spans), n["tagged"]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def scan(docs: DataFrame, model=None) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_tagged."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan(model or train()), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_tagged long")


def _mask(model, schema, mark):
    at = schema.names.index("text")
    sized = schema.names.index("n_chars") if "n_chars" in schema.names else None

    def run(batches):
        field, (patterns, tokenizer) = Field(model), _compiled()
        for batch in batches:
            texts, columns = batch.column(at).to_pylist(), batch.columns
            counts = columns[sized].to_pylist() if sized is not None else None
            for i, text in enumerate(texts):
                spans = spans_of(text or "", field, patterns, tokenizer)
                if spans:
                    parts, done = [], 0
                    for a, b, _ in spans:
                        if a >= done:
                            parts += [text[done:a], mark]
                        done = max(done, b)
                    texts[i] = "".join([*parts, text[done:]])
                    if counts is not None:
                        counts[i] = len(texts[i])
            columns = list(columns)
            columns[at] = pa.array(texts, type=batch.schema.field(at).type)
            if counts is not None:
                columns[sized] = pa.array(counts, type=batch.schema.field(sized).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run


def mask(docs: DataFrame, mark: str = "[SECRET]", model=None) -> DataFrame:
    """docs with every span in text replaced by `mark`; n_chars, where there is such a column, follows."""
    return docs.mapInArrow(_mask(model or train(), docs.schema, mark), docs.schema)
