"""Secrets in texts: fixed patterns, and a linear-chain conditional random field decoded by Viterbi."""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.wordhash import PART, parts, run_hashes, runs, slices

KINDS = ("assign", "access", "hex", "crf")

_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")

OUTSIDE, BEGIN, INSIDE = range(3)
Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """``(start, end, kind)`` of the fixed patterns, leftmost and non-overlapping within a kind."""
    out = []
    lower = text.lower()
    if any(w in lower for w in _ASSIGN_WORDS):
        out += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in _ACCESS.finditer(text)]
    return out + [(*m.span(), "hex") for m in _HEX.finditer(text)]


# Tokens: runs of letters, digits and all beyond ASCII, and runs of one other character. White space is no token.
_KIND = np.zeros(256, np.int8)
_KIND[33:127] = np.arange(2, 96)
_KIND[[*range(1, 9), *range(14, 32), 0, 127]] = 96
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
#: Upper, lower and digits of a run in one sum: 21 bits for each, as a part has under 2**21 bytes.
_CASE = np.zeros(256, np.int64)
_CASE[65:91], _CASE[97:123], _CASE[48:58] = 1, 1 << 21, 1 << 42
_CLASS = np.select([_CASE == 1, _CASE == 1 << 21, _CASE == 1 << 42], [1, 2, 3], 0).astype(np.int8)
_VOWEL = np.isin(np.arange(256), [ord(c) for c in "aeiouyAEIOUY"])
_LENGTHS = np.array([2, 4, 6, 8, 12, 16, 24, 32, 48])

# Words that tell of a secret beside them.
HINTS = (
    "password passwd pwd pass passphrase passcode secret secrets token tokens key keys apikey auth authorization bearer basic credential credentials cred creds private "
    "signature signing login pin otp webhook dsn session cookie salt clave contrasena contraseña passwort kennwort geheim mot motdepasse haslo"
).split()


def _word_bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(52)).astype(np.int64)


def _hashes(words: list[str]) -> np.ndarray:
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    return run_hashes(raw, *runs(raw, (_KIND > 0).astype(np.int8)))


_HINT_HASHES = np.unique(_hashes(HINTS))

#: Features of a token, each with its number of values. ``before``, ``before2`` and ``after`` are its neighbours' words by hash.
TABLES = {"shape": 1700, "letters": 240, "word": 4096, "before": 4096, "before2": 4096, "after": 4096, "gaps": 16, "left": 512, "right": 512, "hint": 1024, "file": 1024}


class Tokens:
    """The tokens of some texts (UTF-8, together under 2**21 bytes): places in the joined buffer, and features of each."""

    def __init__(self, texts: list[bytes], files: list[int]) -> None:
        """``files`` has the file feature (0 to 7) of each text."""
        self.data = b"\n".join(texts)
        raw = np.frombuffer(self.data, np.uint8)
        self.base = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        self.start, self.end = runs(raw, _KIND)
        self.doc = np.searchsorted(self.base, self.start, "right") - 1
        self.first = np.diff(self.doc, prepend=-1) != 0
        self._features(raw, np.asarray(files, np.int64))

    def _features(self, raw: np.ndarray, files: np.ndarray) -> None:
        start, end, n = self.start, self.end, len(self.start)
        self.ids: dict[str, np.ndarray] = {}
        if not n:
            return
        size, kind = end - start, _KIND[raw[start]].astype(np.int64)
        total = np.append(0, np.cumsum(_CASE[raw]))
        packed = total[end] - total[start]
        upper, lower, digit = packed & 0x1FFFFF, packed >> 21 & 0x1FFFFF, packed >> 42
        turn = np.append(0, np.cumsum(np.diff(_CLASS[raw], prepend=0) != 0, dtype=np.int32))
        turns = turn[end] - turn[start + 1]
        vowel = np.append(0, np.cumsum(_VOWEL[raw], dtype=np.int32))
        vowels = 4 * (vowel[end] - vowel[start]) // np.maximum(1, upper + lower)
        length = np.searchsorted(_LENGTHS, size, "right")
        cases = (upper > 0) * 4 + (lower > 0) * 2 + (digit > 0)
        share = np.minimum(3, 4 * digit // size + (digit > 0))
        word = kind == 1
        ids = self.ids
        ids["shape"] = np.where(word, ((length * 8 + cases) * 4 + share) * 5 + np.searchsorted([1, 2, 4, 8], turns, "right"), 1600 + kind)
        ids["letters"] = np.where(word, (np.minimum(vowels, 2) * 10 + length) * 8 + cases, 239)
        coarse = np.where(word, np.minimum(length // 2, 3) * 8 + cases, 32 + kind % 32)
        h = run_hashes(raw, start, end)
        own = _word_bucket(h)
        ids["word"] = own
        before, after = np.flatnonzero(~self.first), np.flatnonzero(~self.first) - 1
        second = before[1:][np.diff(before) == 1]  # has two tokens before it in its text
        none = np.full(n, 4095)
        for name, at, other in (("before", before, before - 1), ("before2", second, second - 2), ("after", after, after + 1)):
            ids[name] = none.copy()
            ids[name][at] = own[other]
        lines = np.append(0, np.cumsum(raw == 10, dtype=np.int32))
        line = lines[start]
        gap = np.full(n + 1, 3)  # 0 none, 1 white space, 2 a line's end, 3 the text's
        gap[before] = np.where(line[before] != line[before - 1], 2, (start[before] > end[before - 1]).astype(np.int64))
        gap[1:][after] = gap[before]
        ids["gaps"] = np.where(self.first, 3, gap[:-1]) * 4
        right = np.full(n, 3)
        right[after] = gap[before]
        ids["gaps"] += right
        for name, at, other, side in (("left", before, before - 1, ids["gaps"] // 4), ("right", after, after + 1, right)):
            ids[name] = np.full(n, 511)
            ids[name][at] = coarse[other] * 4 + side[at]
        # A word that hints at a secret among the last six tokens of the line, and the sign before the token's quote.
        seen = np.where(np.isin(h, _HINT_HASHES), np.arange(n), -(1 << 40))
        last = np.maximum.accumulate(np.append(-(1 << 40), seen[:-1]))
        near = np.maximum(last, 0)
        hinted = (np.arange(n) - last <= 6) & (line[near] == line) & (self.doc[near] == self.doc)
        sign = np.where(kind == _KIND[ord("=")], 1, np.where(kind == _KIND[ord(":")], 2, 0))
        quote = np.isin(kind, [_KIND[ord(c)] for c in "\"'`"])
        own_sign = np.zeros(n, np.int64)
        own_sign[before] = sign[before - 1]
        quoted = second[quote[second - 1]]
        own_sign[quoted] = sign[quoted - 2]
        own_sign[before[quote[before - 1] & (own_sign[before] == 0)]] = 3
        ids["hint"] = (hinted * 4 + own_sign) * 64 + coarse
        ids["file"] = files[self.doc] * 64 + coarse


def file_feature(data: bytes) -> int:
    """What kind of file a text is: the share of lines that assign something, and whether it holds a key block or exports."""
    lines = data.count(b"\n") + 1
    return min(3, (data.count(b"=") + data.count(b": ")) // lines) * 2 + (b"BEGIN " in data or b"export " in data)


class Field:
    """Weights of the chain: by feature and tag, and by neighbouring tags. A text is one chain of all its tokens."""

    def __init__(self) -> None:
        self.weights = {k: np.zeros((n, 3)) for k, n in TABLES.items()}
        self.moves = np.zeros((3, 3))

    def scores(self, tokens: Tokens) -> np.ndarray:
        out = np.zeros((len(tokens.start), 3))
        for name, at in tokens.ids.items():
            out += self.weights[name][at]
        if len(out):
            out[tokens.ids["gaps"] // 4 > 0, INSIDE] = -1e6  # a secret holds no white space
        return out

    def allowed(self) -> np.ndarray:
        """The scores of neighbouring tags; inside can't follow outside, nor start a chain."""
        moves = self.moves.copy()
        moves[OUTSIDE, INSIDE] = -np.inf
        return moves

    def surely_outside(self, s: np.ndarray) -> np.ndarray:
        """Tokens that are outside in the best path, whatever the others are.

        If such a token were begin or inside, making it outside (and an inside token after it begin) would
        raise the path's score; the least that this can gain is bounded by the moves.
        """
        m = self.moves
        before = min(m[p, OUTSIDE] - m[p, x] for p in range(3) for x in (BEGIN, INSIDE) if (p, x) != (OUTSIDE, INSIDE))
        plain = min(0, *(m[OUTSIDE, y] - m[x, y] for x in (BEGIN, INSIDE) for y in (OUTSIDE, BEGIN)))
        turned = min(m[OUTSIDE, BEGIN] - m[x, INSIDE] for x in (BEGIN, INSIDE)) + min(0, *(m[BEGIN, z] - m[INSIDE, z] for z in range(3)))
        ahead = np.append(s[1:, BEGIN] - s[1:, INSIDE], 0)
        return s[:, OUTSIDE] - s[:, 1:].max(1) + before + np.minimum(plain, turned + ahead) > 1e-9

    def decode(self, s: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The likeliest tags (Viterbi) of chains that begin where ``first`` says.

        Surely outside tokens cut a chain into stretches that can be decoded apart; all stretches advance in step.
        """
        tags = np.zeros(len(s), np.int8)
        open_ = ~self.surely_outside(s)
        at = np.flatnonzero(open_)
        if not len(at):
            return tags
        heads = np.flatnonzero((np.diff(at, prepend=-2) != 1) | first[at])
        size = np.diff(np.append(heads, len(at)))
        order = np.argsort(-size, kind="stable")
        head, size = at[heads[order]], size[order]
        m = self.allowed()
        best = m[OUTSIDE] + s[head]
        back = np.zeros((len(at), 3), np.int8)  # by step, then stretch; longest stretches first
        place, offset, left = [], 0, len(head)
        for k in range(1, int(size[0])):
            left = int(np.searchsorted(-size, -k, "left"))  # stretches with more than k tokens
            step = best[:left, :, None] + m
            back[offset : offset + left] = step.argmax(1)
            best[:left] = step.max(1) + s[head[:left] + k]
            place.append(offset)
            offset += left
        tail = head + size
        follows = (tail < len(s)) & ~np.append(first, True)[tail]
        tag = (best + np.where(follows[:, None], m[:, OUTSIDE], 0)).argmax(1)
        for k in range(int(size[0]) - 1, -1, -1):
            left = int(np.searchsorted(-size, -k, "left"))
            tags[head[:left] + k] = tag[:left]
            if k:
                tag[:left] = back[place[k - 1] + np.arange(left), tag[:left]]
        return tags

    def fit(self, texts: list[tuple[str, list[tuple[int, int]]]], rounds: int = 80, rate: float = 0.12) -> Field:
        """Maximum likelihood on texts with the ranges of their secrets in code points (Adam, with a little decay)."""
        data = [t.encode() for t, _ in texts]
        tokens = Tokens(data, [file_feature(d) for d in data])
        doc, n = tokens.doc, len(tokens.start)
        truth = np.zeros(n, np.int64)
        for k, (text, ranges) in enumerate(texts):
            for a, b in ranges:
                x, y = (tokens.base[k] + len(text[:p].encode()) for p in (a, b))
                own = slice(*np.searchsorted(tokens.start, (x, y)))
                truth[own] = INSIDE
                truth[own.start] = BEGIN
        size = np.bincount(doc, minlength=len(texts))
        order = np.argsort(-size, kind="stable")
        size = size[order][size[order] > 0]
        head = np.searchsorted(doc, order[: len(size)])
        live = [int(np.searchsorted(-size, -k, "left")) for k in range(int(size[0]))]
        params = [*self.weights.values(), self.moves]
        mean, var = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        pairs = np.flatnonzero(~tokens.first)
        seen = np.zeros((3, 3))
        np.add.at(seen, (truth[pairs - 1], truth[pairs]), 1)
        np.add.at(seen[OUTSIDE], truth[tokens.first], 1)
        for t in range(1, rounds + 1):
            s, m = self.scores(tokens), self.allowed()
            ahead, back = np.zeros((n, 3)), np.zeros((n, 3))
            ahead[head] = s[head] + m[OUTSIDE]
            for k, c in enumerate(live[1:], 1):
                at = head[:c] + k
                ahead[at] = s[at] + _log_sum(ahead[at - 1][:, :, None] + m, 1)
            for k in range(len(live) - 1, 0, -1):
                at = head[: live[k]] + k
                back[at - 1] = _log_sum(m + (s[at] + back[at])[:, None, :], 2)
            total = np.zeros(len(texts))
            total[order[: len(size)]] = _log_sum(ahead[head + size - 1], 1)
            marginal = np.exp(ahead + back - total[doc][:, None])
            grad = -marginal
            grad[np.arange(n), truth] += 1
            joint = np.exp(ahead[pairs - 1][:, :, None] + m + (s[pairs] + back[pairs])[:, None, :] - total[doc[pairs]][:, None, None]).sum(0)
            joint[OUTSIDE] += marginal[tokens.first].sum(0)
            grads = [np.stack([np.bincount(at, grad[:, y], TABLES[name]) for y in range(3)], 1) for name, at in tokens.ids.items()] + [seen - joint]
            for k, g in enumerate(grads):
                g = g / len(texts) - 2e-5 * params[k]
                mean[k] = 0.9 * mean[k] + 0.1 * g
                var[k] = 0.999 * var[k] + 0.001 * g * g
                params[k] += rate * (mean[k] / (1 - 0.9**t)) / (np.sqrt(var[k] / (1 - 0.999**t)) + 1e-7)
        self.moves[OUTSIDE, INSIDE] = 0  # never used
        return self


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis, keepdims=True)
    return np.log(np.exp(x - most).sum(axis)) + np.squeeze(most, axis)


_MIXED, _LOW, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_SYLLABLES = "an be co da el fi go ha in jo ka la me no or pa qui re sa ti un va wi yo ze er en ción ment lich ter ung eau ará str pri con".split()
_COMMON = "the of and to is was a in it that for on with el la de los que es un und der die das ist ein nicht le les des est une pas".split()


def training_texts(count: int = 2400, seed: int = 3) -> list[tuple[str, list[tuple[int, int]]]]:
    """Made-up texts with known secrets, and with look-alikes that are none, in prose and in files."""
    rng = random.Random(seed)
    pick = lambda chars, a, b: "".join(rng.choice(chars) for _ in range(rng.randint(a, b)))
    one = rng.choice
    word = lambda: "".join(one(_SYLLABLES) for _ in range(rng.randint(1, 4)))

    def prose() -> str:
        own = [one(_COMMON) if rng.random() < 0.3 else word() for _ in range(rng.randint(0, 9))]
        if rng.random() < 0.12:  # words with rows of signs
            own = [w + one(["", ".", ","]) + one(["###", "&&&", "$$$", "%%%", "***", "!!!"]) if rng.random() < 0.8 else w for w in own]
        if own and rng.random() < 0.5:
            own[0] = own[0].capitalize()
        if own and rng.random() < 0.15:
            own[rng.randrange(len(own))] = one([*HINTS[:16], "API", "config", "user", "file"])
        if own and rng.random() < 0.3:
            own[rng.randrange(len(own))] += one([",", ";", ":", " -", "!", "?", "'s"])
        if own and rng.random() < 0.2:
            own.insert(rng.randrange(len(own)), decoy())
        return " ".join(own) + one(["", "", ".", ".", "?", "###", "***"])

    def strong() -> str:
        return one([
            lambda: pick(_MIXED, 20, 44), lambda: one(["ghp_", "gho_", "sk_live_", "rk_test_", "xoxb-", "glpat-", "npm_", "SG."]) + pick(_MIXED, 20, 40), lambda: pick(_MIXED + "+/", 24, 60) + one(["", "=", "=="]),
            lambda: f"{pick(_MIXED, 8, 24)}-{pick(_MIXED, 16, 32)}", lambda: "eyJ" + pick(_MIXED, 16, 30) + "." + pick(_MIXED, 20, 40) + "." + pick(_MIXED + "_-", 20, 40),
        ])()

    def weak() -> str:
        return one([
            lambda: pick(_MIXED, 8, 16), lambda: pick(_MIXED + "!#$%&*@^?", 8, 18), lambda: word().capitalize() + pick(_DIGITS, 1, 4) + one("!#$%&*"), lambda: pick(_LOW, 16, 28),
            lambda: pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 16, 24), lambda: pick(_DIGITS, 6, 12), lambda: f"{word()[:3]}{pick('0123456789', 1, 3)}{one('!@#_-')}{word()}{pick(_DIGITS, 0, 3)}", lambda: f"{one('PpTtSs')}{pick('aeiou0134@', 1, 1)}{pick(_LOW + _DIGITS, 3, 6)}{one('!#$&')}{pick(_DIGITS, 1, 4)}",
        ])()

    def decoy() -> str:
        return one([
            lambda: f"{word()}{pick(_DIGITS, 1, 3)}-{word()}", lambda: f"https://www.{word()}.example/{word()}/{pick(_DIGITS, 1, 5)}?{word()}={word()}", lambda: f"{pick(_DIGITS, 4, 4)}-{pick(_DIGITS, 2, 2)}-{pick(_DIGITS, 2, 2)}T{pick(_DIGITS, 2, 2)}:{pick(_DIGITS, 2, 2)}",
            lambda: f"{word()}/{word()}_{word()}_v{pick(_DIGITS, 1, 2)}.txt", lambda: f"{word()}.{word()}{pick(_DIGITS, 0, 2)}@{word()}.example", lambda: f"{word()}{word().capitalize()}{word().capitalize()}()", lambda: f"v{pick(_DIGITS, 1, 2)}.{pick(_DIGITS, 1, 2)}.{pick(_DIGITS, 1, 2)}",
            lambda: f"{pick(_DIGITS, 1, 3)},{pick(_DIGITS, 3, 3)}.{pick(_DIGITS, 2, 2)}", lambda: f"+{pick(_DIGITS, 2, 3)} {pick(_DIGITS, 3, 4)}-{pick(_DIGITS, 4, 6)}", lambda: f"{pick(_LOW, 2, 4).upper()}-{pick(_DIGITS, 2, 6)}", lambda: pick(_DIGITS, 1, 19), lambda: f"<div class=\"{word()}-{word()}\">",
            lambda: f"{word()}={word()}", lambda: f"{word()}: {pick(_DIGITS, 1, 4)}", lambda: f"0x{pick('0123456789abcdef', 2, 8)}", lambda: word().upper() + word().upper(), lambda: word() + word() + word(), lambda: f"#{pick('0123456789abcdef', 6, 6)}", lambda: f"{pick(_DIGITS, 4, 4)} {pick(_DIGITS, 4, 4)} {pick(_DIGITS, 4, 4)} {pick(_DIGITS, 4, 4)}", lambda: one("#*$&%-=~") * rng.randint(3, 30),
        ])()

    def line(ranges_at: int) -> tuple[str, list[tuple[int, int]]]:
        r = rng.random()
        if r < 0.55:  # no secret here
            name = one([f"{one(HINTS)}", word(), f"{word()}_{one(HINTS)}", f"{one(HINTS)}_{word()}"])
            return one([prose, prose, lambda: f"{prose()} {decoy()} {prose()}", lambda: f"{name}{one([' = ', ': ', '='])}{one([word(), 'null', 'true', 'none', 'required', '', decoy(), '*****'])}", lambda: f"{prose()} {one(HINTS)} {prose()}", lambda: f"{one(HINTS).capitalize()} {word()} {word()}."])(), []
        hint = one(HINTS[: len(HINTS) - 4])
        name = one([hint, hint.upper(), f"{word()}_{hint}", f"{word().upper()}_{hint.upper()}", f"{word()}-{hint}", f"{word()}.{hint}"])
        if r < 0.68:
            head, value, tail = f"{prose()} ", strong(), one([f" {prose()}", "", ".", "\"", "\n"])
        elif r < 0.74:
            head, value, tail = f"{word()}://{word()}:", one([weak, strong])(), f"@{word()}.{word()}:{pick(_DIGITS, 2, 4)}/{word()}"
        else:
            value = one([weak, strong])()
            head, tail = one([
                (f"{prose()} {name}{one([' = ', '=', ': ', ':'])}", one([f" {prose()}", "", ";", ","])), (f"{one(['export ', '', 'set '])}{name.upper()}=", ""), (f"\"{name}\": \"", one(["\",", "\""])), (f"{name}{one([' = ', ' => ', '='])}{(q := one(chr(34) + chr(39)))}", q + one(["", f" {prose()}"])),
                (f"Authorization: {one(['Bearer', 'Basic', 'Token'])} ", one(["", "\"", f" {prose()}"])), (f"{prose()} {hint} {one(['is', 'was', 'es', 'ist', 'est', 'set to', 'now'])} ", one([f" {prose()}", ".", ""])), (f"{word()} --{hint} ", one(["", f" {prose()}", f" --{word()} {word()}"])), (f"{prose()} {one(['Bearer', 'bearer', 'token', 'key', 'Basic'])} ", one([f" {prose()}", ""])),
            ])
        at = ranges_at + len(head)
        return head + value + tail, [(at, at + len(value))]

    out = []
    for _ in range(count):
        text, ranges = "", []
        for _ in range(rng.randint(1, 3)):
            own, more = line(len(text))
            text, ranges = text + own + one(["\n", "\n", " "]), ranges + more
        out.append((text, ranges))
    return out


@lru_cache(1)
def default_field() -> Field:
    """The field fitted on made-up texts: the same wherever it is fitted, and independent of the corpus."""
    return Field().fit(training_texts())


def field_spans(texts: list[str], field: Field) -> list[list[Span]]:
    """Spans that the field tags as secrets in each text, in code points."""
    out: list[list[Span]] = [[] for _ in texts]
    group: list[tuple[int, int, bytes, int]] = []

    def flush() -> None:
        if not group:
            return
        tokens = Tokens([p for *_, p, _ in group], [f for *_, f in group])
        tags = field.decode(field.scores(tokens), tokens.first)
        begins = np.flatnonzero((tags == BEGIN))
        if len(begins):
            after = np.append(np.flatnonzero(tags != INSIDE), len(tags))
            ends = after[np.searchsorted(after, begins + 1)] - 1
            for x, y in zip(begins.tolist(), ends.tolist(), strict=True):
                k = int(tokens.doc[x])
                text, from_, part, _ = group[k]
                a, b = (int(p) - int(tokens.base[k]) for p in (tokens.start[x], tokens.end[y]))
                a = from_ + len(part[:a].decode("utf-8", "surrogatepass")) if not part.isascii() else from_ + a
                out[text].append((a, a + len(part[int(tokens.start[x] - tokens.base[k]) : b].decode("utf-8", "surrogatepass")), "crf"))
        group.clear()

    size = 0
    for k, text in enumerate(texts):
        data, at = text.encode("utf-8", "surrogatepass"), 0
        feature = file_feature(data)
        for part in parts(data):
            if size + len(part) > PART:
                flush()
                size = 0
            group.append((k, at, part, feature))
            size += len(part) + 1
            at += len(part) if part.isascii() else len(part.decode("utf-8", "surrogatepass"))
    flush()
    return out


def secret_spans(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans, and these with the field's where those overlap none; by start, then kind."""
    key = lambda s: (s[0], KINDS.index(s[2]), s[1])
    out = []
    for text, found in zip(texts, field_spans(texts, field), strict=True):
        base = sorted(base_spans(text), key=key)
        if base and found:
            starts, reach = [s[0] for s in base], []
            for _, b, _ in base:
                reach.append(max(b, reach[-1] if reach else 0))
            # Of the base spans that start before its end, none may end after its start.
            found = [s for s in found if not (k := bisect.bisect_left(starts, s[1])) or reach[k - 1] <= s[0]]
        out.append((base, sorted(base + found, key=key)))
    return out


def _said(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``.

    Spans are in code points, end exclusive, of the whole text; a null text counts as empty. The field tags
    all tokens of a text and adds spans of kind ``crf`` that overlap no base span; it takes a text of more than
    ``PART`` bytes in parts that end at white space. Null and repeated ids are scanned like any other; an empty
    table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field or default_field())

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                rows = []
                for base, spans in secret_spans([t or "" for t in batch.column(1).to_pylist()], shared.value):
                    rows.append((*[sum(k == s[2] for s in base) for k in KINDS[:3]], hashlib.sha256(_said(base).encode()).hexdigest(), _said(spans)))
                columns = zip(*rows, strict=True)
                yield pa.record_batch([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()] * 2, strict=True)]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", field: Field | None = None) -> DataFrame:
    """``docs`` with every secret span of the text replaced by ``mask``; null texts stay null, other columns as they are."""
    names, schema = docs.columns, docs.schema
    at = names.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(field or default_field())

    def hide(text: str | None, spans: list[Span]) -> str | None:
        if not spans:
            return text
        out, end = [], 0
        for a, b, _ in spans:
            if a >= end:
                out += [text[end:a], mask]
            end = max(end, b)
        return "".join([*out, text[end:]])

    def run(batches):
        for whole in batches:
            for batch in slices(whole, at):
                texts = batch.column(at).to_pylist()
                found = secret_spans([t or "" for t in texts], shared.value)
                text = pa.array([hide(t, spans) for t, (_, spans) in zip(texts, found, strict=True)], pa.string())
                yield pa.record_batch([text if k == at else c for k, c in enumerate(batch.columns)], names=names)

    return docs.mapInArrow(run, schema)
