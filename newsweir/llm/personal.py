"""Personal information inside free text, by a linear-chain conditional random field."""

from __future__ import annotations

import base64
import functools
import io
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from newsweir.llm.pii_examples import _CODED, KINDS, filled, invented_names, wording_words
from newsweir.llm.tokens import VOCABULARY
from newsweir.operators.partitions import spread

# Label 0 is outside; kind k begins with 1 + 2k and goes on with 2 + 2k.
_LABELS = 1 + 2 * len(KINDS)
_OFFSETS = (-3, -2, -1, 0, 1, 2, 3)
_TOKEN = re.compile(r"[^\W\d_]+|\d+|\n|[^\w\s]|_|\s")
_SLACK = 1e-2  # more than single precision loses of a bound
_CACHE = 400_000
_ROWS = 512


def _shape(w: str) -> str:
    if len(w) == 1:
        return "X1" if w.isupper() else "x1"
    if w.islower():
        return "x"
    if w.isupper():
        return "XX"
    return "Xx" if w[0].isupper() and w[1:].islower() else "xX"


# Assigned international calling codes, with and without the prefix 00.
_CALLING = frozenset(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 "
    "350 351 352 353 354 355 356 357 358 359 370 371 372 373 374 375 376 377 378 380 381 382 385 386 387 389 420 421 423".split()
)


_EDGES = ".,;:!?\"'<>»«“”„’]["


@functools.lru_cache(100_000)
def chunk_shapes(chunk: str) -> tuple[str, ...]:
    """How a blank-free chunk with digits or an at sign is written: exactly, and with its runs made one sign.

    Digits are 9, letters alone A or a, words W; chunks of letters alone have no shapes.
    """
    if not any(c.isdigit() or c == "@" for c in chunk):
        return ()
    s = re.sub(r"<[^>]*>", "", chunk.strip(_EDGES)).strip(_EDGES)
    s = re.sub(r"\d", "9", re.sub(r"[^\W\d_]{2,}", "W", s)).replace("\xa0", " ")
    s = re.sub(r"[^\W\d_](?<!W)", lambda m: "A" if m.group().isupper() else "a", s)
    return ("c" + s[:24], "k" + re.sub(r"9+", "9", s)[:16])


# Words for streets, and ends of street names, in English, Danish, Swedish, German and Norwegian.
_STREETS = frozenset(
    "street road lane avenue drive close row rise terrace mews court way square grove crescent gardens place walk hill parade wharf quay green "
    "st rd ave ln dr vej vei gade gate allé alle plads torv stræde väg gata gränd torg plan weg straße strasse gasse allee platz ufer damm ring".split()
)
_STREET_ENDS = tuple(
    (
        "vej vejen veien vei gade gaden gate gaten stræde strædet allé alléen vænget vangen parken torvet torv bakken haven svinget toften engen plads pladsen "
        "vägen väg gatan gata gränd gränden stigen torget backen allén straße strasse str weg gasse platz allee ring ufer damm stieg steig"
    ).split()
)


# Words for classes of roads, whose number is the road's and not a house's.
_ROADS = frozenset(
    "route rute motorway highway landstraße landstrasse landesstraße bundesstraße staatsstraße kreisstraße fernstraße schnellstraße autobahn "
    "hovedvej landevej primærrute sekundærrute motorvej europavej riksväg länsväg motorväg europaväg riksvei fylkesvei motorvei europavei".split()
)
# Words before a name or a number that is none, and those before a number of something else than a telephone.
_TITLES = frozenset("mr mrs ms miss dr fru frøken fröken frk hr herr frau prof nabo granne nachbar nachbarin family familie familien familjen neighbour".split())
_CODED_WORDS = frozenset(w.strip(".").lower() for w in _CODED)
# What a token may be in a form that is sure by itself, see Finder._formed.
_GIVEN, _FAMILY, _CAP, _LETTER, _COMMA, _STOP, _HYPHEN, _GLUED, _HOUSE, _WAY, _STREET, _WORD, _DIGITS, _POINT, _NUMBERED, _EIGHT, _CODE, _PLAIN = (1 << i for i in range(18))


class NameLists:
    """Given and family names, and the beginnings and ends that at least three of the families share."""

    def __init__(self, given: list[str], family: list[str]):
        self.given = frozenset(p for x in given for p in x.lower().split("-"))
        self.family = frozenset(x.lower() for x in family)
        heads, tails = (Counter(p for x in self.family for p in {cut(x, n) for n in (3, 4, 5)} if len(p) < len(x)) for cut in (lambda x, n: x[:n], lambda x, n: x[-n:]))
        self.heads, self.tails = (frozenset(p for p, n in c.items() if n >= 3) for c in (heads, tails))

    def like_family(self, w: str) -> str:
        """Whether a word begins ("h") and ends ("t") as listed families do."""
        h = any(w[:n] in self.heads for n in (3, 4, 5) if len(w) > n)
        t = any(w[-n:] in self.tails for n in (3, 4, 5) if len(w) > n)
        return "h" * h + "t" * t


def token_features(token: str, glued: bool, shapes: tuple[str, ...], lists: NameLists) -> list[str]:
    """What the recogniser sees of a token: its shape and its chunk's, ends and list membership, not which name it is."""
    g = "g" if glued else "s"
    if token.isdigit():
        n = len(token)
        f = [*shapes, f"d{n}", f"d{n}{g}", f"d{n}^{token[0]}"]
        if token.removeprefix("00") in _CALLING:
            f.append("calling")
        if n == 4:
            f.append(f"year{token[:2] in ('19', '20')}")
        if n >= 6:
            # A number that starts like a date: day and month, or year and month.
            day, month, year = int(token[:2]), int(token[2:4]), token[:2]
            f.append(f"date{1 <= day <= 31 and 1 <= month <= 12}{n}")
            f.append(f"born{1 <= month <= 12 and 1 <= int(token[4:6]) <= 31}{n}")
            f.append(f"year{year in ('19', '20')}{n}")
        return f
    if token[0].isalpha():
        w, s = token.lower(), _shape(token)
        f = ["w=" + w, *shapes, s, s + g, "e2" + w[-2:]]
        if len(w) >= 5:
            f += ["e3" + w[-3:], "e4" + w[-4:]]
        if w in _STREETS:
            f += ["S", "S" + s]
        elif len(w) >= 6 and w.endswith(_STREET_ENDS):
            f += ["Send", "Send" + s]
        if w in lists.given:
            f += ["G", "G" + s]
        if w in lists.family:
            f += ["F", "F" + s]
        elif like := lists.like_family(w):
            f += ["L" + like, "L" + like + s]
        return f
    return [*shapes[1:], "p" + token, "p" + token + g]


def token_marks(token: str, glued: bool, lists: NameLists, words: frozenset) -> int:
    """What a token may be, by the lists and the fixed words: the bits above.

    A family is listed, or begins and ends as listed ones do; a house's number has up to three digits; eight
    that don't begin as a year or with 0 may be a whole telephone number. `words` are those of the context.
    """
    w = token.lower()
    marks = _GLUED * glued | _CAP * token[0].isupper()
    if token.isdigit():
        marks |= _EIGHT * (len(token) == 8 and token[0] != "0" and token[:2] not in ("19", "20"))
        return marks | _DIGITS | _HOUSE * (len(token) <= 3 and token[0] != "0")
    if not token[0].isalpha():
        return marks | {",": _COMMA | _POINT, ".": _STOP | _POINT, "-": _HYPHEN | _POINT, ":": _POINT, "/": _POINT, "#": _CODE | _POINT}.get(token, 0)
    if len(w) == 1:
        return marks | _LETTER
    marks |= _WORD | _NUMBERED * (w in ("nr", "no")) | _CODE * (w in _CODED_WORDS) | _PLAIN * (w in words or w in _TITLES) | _GIVEN * (w in lists.given) | _FAMILY * (w in lists.family or lists.like_family(w) == "ht") | _WAY * (w in _STREETS)
    return marks | _STREET * (len(w) >= 6 and w.endswith(_STREET_ENDS) and w not in _ROADS)


def _pieces(chunk: str) -> list[tuple[str, bool, int, int]]:
    """(token, glued to the one before, start, end) of a blank-free chunk; white space itself is no token."""
    out, end = [], -1
    for m in _TOKEN.finditer(chunk):
        t = m.group()
        if t == "\n" or not t.isspace():
            out.append((t, m.start() == end, m.start(), m.end()))
            end = m.end()
    return out


_WEIGHTS = Path(__file__).with_name("personal_weights.npz")
# Words that are context however rarely the examples have them: of disguised addresses and of streets.
_ALWAYS = "at dot nr no str st rd ave street road lane avenue drive close row rise terrace mews court way square grove crescent gardens place walk hill parade wharf vej gade väg gata weg platz".split()


def _whole_words(vocabulary: str) -> list[str]:
    with open(vocabulary, "rb") as f:
        tokens = [base64.b64decode(line.split()[0]).decode(errors="ignore") for line in f]
    return sorted({t[1:].lower() for t in tokens if re.fullmatch(r" [a-zæøåäöüßéA-ZÆØÅÄÖÜ]{4,}", t)})


def _by_length(rows: list, buckets: int = 4) -> list[list]:
    rows = sorted(rows, key=lambda r: len(r[0]))
    return [x for k in range(buckets) if (x := rows[len(rows) * k // buckets : len(rows) * (k + 1) // buckets])]


class _Bucket:
    """Examples of similar length, padded to the longest, and their part of the likelihood's gradient."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], idx: np.ndarray):
        longest, count = max(len(r) for r, _ in rows), len(rows)
        used, where = np.unique(np.concatenate([r for r, _ in rows]), return_inverse=True)
        self.types, self.idx = len(used), idx[used]
        tok, self.gold = np.full((count, longest), -1), np.zeros((count, longest), int)
        at = 0
        for i, (r, y) in enumerate(rows):
            tok[i, : len(r)], self.gold[i, : len(r)] = where[at : at + len(r)], y
            at += len(r)
        self.real, self.n = tok >= 0, at
        # For each offset: the type seen there by each token (the last, empty one past an end), and the
        # tokens in the order of what they see, to sum gradients by type.
        self.seen, self.sums = [], []
        for o in _OFFSETS:
            s = np.full_like(tok, -1)
            if o < 0:
                s[:, -o:] = tok[:, :o]
            elif o > 0:
                s[:, :-o] = tok[:, o:]
            else:
                s = tok
            self.seen.append(s[self.real])
            self.sums.append(self._runs(s[self.real]))
        self.columns = [self._runs(c) for c in self.idx.T]
        self.target = np.eye(_LABELS, dtype=np.float32)[self.gold[self.real]]
        self.pairs = np.zeros((_LABELS, _LABELS), np.float32)
        both = self.real[:, 1:]
        np.add.at(self.pairs, (self.gold[:, :-1][both], self.gold[:, 1:][both]), 1)

    @staticmethod
    def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(x, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(x[order]) != 0])
        return order, starts, x[order][starts]

    def add_gradients(self, w: np.ndarray, trans: np.ndarray, gw: np.ndarray, gt: np.ndarray) -> None:
        """Forward and backward over all texts at once; expected less observed features go to gw and gt."""
        single, (count, longest) = np.float32, self.real.shape
        table = np.zeros((self.types + 1, len(_OFFSETS), _LABELS), single)
        table[:-1] = w[self.idx].sum(1).reshape(self.types, len(_OFFSETS), _LABELS)
        flat = sum(table[x, o] for o, x in enumerate(self.seen))
        e = np.full((count, longest, _LABELS), 1 / _LABELS, single)
        e[self.real] = np.exp(flat - flat.max(-1, keepdims=True)) + single(1e-20)
        m = np.exp(trans)
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[:, 0] = e[:, 0] / e[:, 0].sum(-1, keepdims=True)
        for t in range(1, longest):
            x = (a[:, t - 1] @ m) * e[:, t]
            a[:, t] = np.where(self.real[:, t, None], x / x.sum(-1, keepdims=True), a[:, t - 1])
        b[:, -1] = 1.0
        pair = np.zeros((_LABELS, _LABELS), single)
        for t in range(longest - 2, -1, -1):
            nxt = e[:, t + 1] * b[:, t + 1]
            x = nxt @ m.T
            on = self.real[:, t + 1, None]
            b[:, t] = np.where(on, x / x.sum(-1, keepdims=True), single(1))
            z = ((a[:, t] @ m) * nxt).sum(-1, keepdims=True)
            pair += (np.where(on, a[:, t] / z, single(0)).T @ nxt) * m
        p = (a * b)[self.real]
        d = p / p.sum(-1, keepdims=True) - self.target
        g = np.zeros((self.types + 1, len(_OFFSETS), _LABELS), single)
        for o, (order, starts, keys) in enumerate(self.sums):
            g[keys, o] = np.add.reduceat(d[order], starts)
        g = g[:-1].reshape(self.types, -1)
        for order, starts, keys in self.columns:
            gw[keys] += np.add.reduceat(g[order], starts)
        gt += pair - self.pairs


class Recogniser:
    """The field: weights of features at offsets from -3 to 3, and of label pairs, and lists of names.

    The weights don't depend on which names are listed, only on whether a token is: they are trained once
    on invented people, two thirds of them listed, and kept in a file beside this module.
    """

    def __init__(self, given: list[str], family: list[str]):
        self.lists = NameLists(given, family)
        with np.load(_WEIGHTS) as kept:
            self.features = {x: i for i, x in enumerate(bytes(kept["features"]).decode().split("\0"))}
            self.words = frozenset(bytes(kept["words"]).decode().split("\0"))
            self.weights, self.trans = kept["weights"].astype(np.float32), kept["trans"]

    @property
    def given(self) -> frozenset:
        return self.lists.given

    @classmethod
    def trained(cls, rounds: int = 11, steps: int = 560, vocabulary: str = VOCABULARY) -> Recogniser:
        """A model trained on pii_examples.filled by full-batch gradients of the likelihood.

        The neutral lines among the wordings are of words that a public tokenizer has as one token.
        """
        self = cls.__new__(cls)
        self.lists = NameLists(*invented_names()[2:])
        self._train(filled(rounds, ordinary=_whole_words(vocabulary)), steps)
        return self

    def save(self, path: Path = _WEIGHTS) -> None:
        """Features whose weights all round to nothing are left out; single precision is halved."""
        kept = np.flatnonzero((np.abs(self.weights).max(1) > 0.01) | (np.arange(len(self.weights)) == 0))
        names = list(self.features)
        text = lambda some: np.frombuffer("\0".join(some).encode(), np.uint8)
        out = io.BytesIO()
        np.savez_compressed(out, features=text(names[i] for i in kept), words=text(sorted(self.words)), weights=self.weights[kept].astype(np.float16), trans=self.trans)
        path.write_bytes(out.getvalue())

    def _tokens(self, text: str) -> list[tuple[str, bool, tuple, int, int]]:
        out, at = [], 0
        for chunk in text.split(" "):
            out += [(t, g, chunk_shapes(chunk), at + a, at + b) for t, g, a, b in _pieces(chunk)]
            at += len(chunk) + 1
        return out

    def _train(self, examples, steps: int, ridge: float = 3e-3, hidden: float = 0.08, parts: int = 4) -> None:
        """Weights of a great likelihood, by Adam; each step sees one of `parts` random parts of the examples."""
        # A token's word is hidden from its features now and then: the surroundings of a value vary.
        types: dict[tuple[str, bool, tuple, bool], int] = {}
        rng = np.random.default_rng(3)
        rows = []
        for text, spans in examples:
            tokens = self._tokens(text)
            gold = np.zeros(len(tokens), int)
            for a, b, kind in spans:
                inside = [i for i, t in enumerate(tokens) if a <= t[3] < b]
                gold[inside] = 2 + 2 * KINDS.index(kind)
                gold[inside[0]] -= 1
            hide = (rng.random(len(tokens)) < hidden).tolist()
            rows.append((np.array([types.setdefault((t, g, c, h), len(types)) for (t, g, c, _, _), h in zip(tokens, hide)]), gold))
        # Words are features if the wordings have them outside of slots and they aren't names: the context.
        self.words = (wording_words() - self.given) | frozenset(_ALWAYS)
        self.features: dict[str, int] = {"": 0}
        lists = [self._ids(t, g, c, grow=True, hide=h) for t, g, c, h in types]
        idx = np.zeros((len(types), max(map(len, lists))), int)
        for i, x in enumerate(lists):
            idx[i, : len(x)] = x
        rng.shuffle(rows)
        # Texts of about the same length lie in one bucket, as a bucket is padded to its longest.
        batches = [[_Bucket(x, idx) for x in _by_length(rows[k::parts])] for k in range(parts)]
        single = np.float32
        params = [np.zeros((len(self.features), len(_OFFSETS) * _LABELS), single), np.zeros((_LABELS, _LABELS), single)]
        first, second = ([np.zeros_like(x) for x in params] for _ in range(2))
        for step in range(1, steps + 1):
            batch = batches[step % parts]
            n_tokens = sum(b.n for b in batch)
            grads = [single(ridge / parts) * x for x in params]
            for bucket in batch:
                bucket.add_gradients(*params, *grads)
            grads[0][0] = 0
            rate = single(0.1 * min(1.0, 1.6 * (1 - step / steps) + 0.01))
            for x, g, m, v in zip(params, grads, first, second):
                g /= single(n_tokens)
                m += single(0.1) * (g - m)
                v += single(0.01) * (g * g - v)
                x -= rate * (m / single(1 - 0.9**step)) / (np.sqrt(v / single(1 - 0.99**step)) + single(1e-9))
        self.weights, self.trans = params

    def _ids(self, token: str, glued: bool, shapes: tuple[str, ...], grow: bool = False, hide: bool = False) -> list[int]:
        names = token_features(token, glued, shapes, self.lists)
        if names[0].startswith("w=") and (hide and names[0][2:] not in _ALWAYS or names[0][2:] not in self.words):
            names = names[1:]
        if grow:
            return [self.features.setdefault(x, len(self.features)) for x in names]
        return [self.features[x] for x in names if x in self.features]


class Finder:
    """Spans of texts by a Recogniser, many texts at a time; remembers what it knows of tokens and chunks."""

    def __init__(self, model: Recogniser):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        outer = self

        class Chunks(dict):
            def __missing__(self, chunk: str) -> tuple[int, ...]:
                v = self[chunk] = tuple(outer._type(t, g, chunk_shapes(chunk)) for t, g, _, _ in _pieces(chunk))
                return v

        self.types: dict[tuple[str, bool, tuple], int] = {}
        self.table = np.zeros((1024, len(_OFFSETS), _LABELS), np.float32)
        self.marks = np.zeros(1024, np.int32)
        self.chunks = Chunks()

    def _type(self, token: str, glued: bool, shapes: tuple[str, ...]) -> int:
        n = self.types.get((token, glued, shapes))
        if n is None:
            n = self.types[(token, glued, shapes)] = len(self.types)
            if n == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.marks = np.concatenate([self.marks, np.zeros_like(self.marks)])
            row = self.model.weights[self.model._ids(token, glued, shapes)].sum(0).reshape(len(_OFFSETS), _LABELS)
            self.table[n], self.marks[n] = row, token_marks(token, glued, self.model.lists, self.model.words)
        return n

    def _emissions(self, token: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The scores of each token's labels by the features of all tokens at the offsets in its text."""
        e = np.zeros((len(token), _LABELS), np.float32)
        for o, off in enumerate(_OFFSETS):
            n = len(token) - abs(off)
            if n <= 0:
                continue
            at, other = slice(max(-off, 0), max(-off, 0) + n), slice(max(off, 0), max(off, 0) + n)
            x = self.table[:, o][token[other]]
            x[owner[at] != owner[other]] = 0
            e[at] += x
        return e

    def _windows(self, e: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the stretches outside of which the best labels of the whole texts are 0.

        A run of labels a..b in place of zeros gains at most the sum of its tokens' best gains, each with
        the best transition that leads there, and that of the transition after it. A token is left out
        only if no run of its text that holds it can gain anything.
        """
        over = self.model.trans - self.model.trans[0, 0]
        # At a text's ends there is no transition.
        enter, leave = np.maximum(over[:, 1:].max(0), 0), max(float(over[1:, 0].max()), 0.0)
        gain = (e[:, 1:] - e[:, :1] + enter).max(1).astype(np.float64)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        most = np.zeros(len(gain))
        for a, b in zip(first, np.r_[first[1:], len(gain)]):
            upto = np.cumsum(gain[a:b])
            start = np.minimum.accumulate(np.r_[0.0, upto[:-1]])
            most[a:b] = np.maximum.accumulate(upto[::-1])[::-1] - start
        open_ = most + leave > -_SLACK
        edge = np.r_[False, open_[1:] & open_[:-1] & (owner[1:] == owner[:-1])]
        lo = np.flatnonzero(open_ & ~edge)
        hi = np.flatnonzero(open_ & ~np.r_[edge[1:], False]) + 1
        return lo, hi

    def labels(self, token: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The best labels of each whole text, by Viterbi over the stretches that may hold any but 0."""
        out = np.zeros(len(token), np.int8)
        # Whole texts of some 500,000 tokens at a time, or one that is longer.
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        cuts = first[np.r_[True, np.diff(first // 500_000) > 0]]
        for a, b in zip(cuts, np.r_[cuts[1:], len(token)]):
            self._label(token[a:b], owner[a:b], out[a:b])
        return out

    def _label(self, token: np.ndarray, owner: np.ndarray, out: np.ndarray) -> None:
        e = self._emissions(token, owner)
        lo, hi = self._windows(e, owner)
        length = hi - lo
        order = np.argsort(length, kind="stable")
        at = 0
        while at < len(order):
            # Windows of about the same length together, some 200,000 label rows at a time.
            n, size = 1, length[order[at]]
            while at + n < len(order) and length[order[at + n]] <= size * 1.25 + 4 and (n + 1) * length[order[at + n]] <= 200_000:
                n += 1
            own = order[at : at + n]
            self._decode(e, owner, lo[own], hi[own], out)
            at += n

    def _decode(self, emissions, owner, lo, hi, out) -> None:
        longest = int((hi - lo).max())
        pos = lo[:, None] + np.arange(longest)[None, :]
        real = pos < hi[:, None]
        pos = np.where(real, pos, lo[:, None])
        e = emissions[pos] * real[:, :, None]
        back = np.zeros((longest, len(lo), _LABELS), np.int8)
        score, trans = e[:, 0].copy(), self.model.trans
        # The tokens beside a window are 0, unless it lies at its text's end.
        before, after = np.maximum(lo - 1, 0), np.minimum(hi, len(owner) - 1)
        score += np.where(((lo > 0) & (owner[before] == owner[lo]))[:, None], trans[0], np.float32(0))
        for t in range(1, longest):
            x = score[:, :, None] + trans[None]
            back[t] = x.argmax(1)
            new = np.take_along_axis(x, back[t].astype(int)[:, None, :], 1)[:, 0] + e[:, t]
            score = np.where(real[:, t, None], new, score)
            back[t] = np.where(real[:, t, None], back[t], np.arange(_LABELS)[None, :])
        score += np.where(((hi < len(owner)) & (owner[after] == owner[lo]))[:, None], trans[:, 0], np.float32(0))
        best = score.argmax(1)
        for t in range(longest - 1, -1, -1):
            r = real[:, t]
            out[pos[r, t]] = best[r]
            if t:
                best = back[t][np.arange(len(lo)), best]

    def _formed(self, token: np.ndarray, owner: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The labels with names and addresses that their form and the lists make sure, whatever stands around them.

        A name is a listed given name before a family, with a letter, a hyphen or another name between, or
        after a family and a comma, or a letter and a dot before a family; a family is listed or begins and
        ends as listed ones do, and beside such a one the given name may be any word of no other use. Eight
        digits alone are a telephone number, unless a word for other numbers stands before. An address is a number, one or two words and a word for streets, all with
        capitals, or a word that ends as streets do and a number. What the field found of other kinds stays.
        """
        m, n = self.marks[token], len(token)

        def at(k: int) -> np.ndarray:
            out = np.zeros(n, np.int32)
            lo, hi = max(-k, 0), n - max(k, 0)
            if hi > lo:
                out[lo:hi] = np.where(owner[lo:hi] == owner[lo + k : hi + k], m[lo + k : hi + k], 0)
            return out

        seen = {k: at(k) for k in range(-2, 7)}

        def is_(k: int, *need: int, apart: bool | None = None) -> np.ndarray:
            """Whether the token at k has one mark of each of `need`, and stands apart or is glued."""
            out = np.ones(n, bool)
            for x in need:
                out &= (seen[k] & x) != 0
            return out if apart is None else out & (((seen[k] & _GLUED) == 0) == apart)

        # Not inside a word or number: what stands at a line's beginning is glued to the line's end.
        begins = is_(0, apart=True) | ((seen[-1] & (_WORD | _LETTER | _DIGITS | _POINT)) == 0)
        forms = []
        given, cap = is_(0, _GIVEN), is_(0, _CAP)
        forms.append((given & is_(1, _FAMILY, apart=True) & (cap == is_(1, _CAP)), 2, "name"))
        forms.append((is_(0, _FAMILY, _CAP) & is_(1, _COMMA, apart=False) & is_(2, _GIVEN, _CAP, apart=True), 3, "name"))
        # A family like the listed ones beside a word that isn't listed, nor known from the context.
        other = _FAMILY | _PLAIN | _WAY | _STREET
        stranger, follows = (is_(k, _WORD, _CAP) & ((seen[k] & other) == 0) for k in (0, 2))
        forms.append((stranger & begins & is_(1, _FAMILY, _CAP, apart=True), 2, "name"))
        forms.append((is_(0, _FAMILY, _CAP) & is_(1, _COMMA, apart=False) & follows & is_(2, apart=True), 3, "name"))
        glued_after = is_(1, _DIGITS | _LETTER | _WORD, apart=False) | is_(1, _POINT, apart=False) & is_(2, _DIGITS, apart=False) | is_(1, _DIGITS, apart=True)
        coded = is_(-1, _CODE) | is_(-2, _CODE)
        forms.append((is_(0, _EIGHT) & begins & ~coded & ~is_(-1, _DIGITS) & ~glued_after, 1, "phone"))
        forms.append((is_(0, _LETTER, _CAP) & begins & is_(1, _STOP, apart=False) & is_(2, _FAMILY, _CAP, apart=True), 3, "name"))
        forms.append((given & cap & is_(1, _GIVEN | _FAMILY, _CAP, apart=True) & is_(2, _FAMILY, _CAP, apart=True), 3, "name"))
        forms.append((given & cap & is_(1, _LETTER, _CAP, apart=True) & is_(2, _STOP, apart=False) & is_(3, _FAMILY, _CAP, apart=True), 4, "name"))
        for letter in (0, 1):
            # A number goes on if digits are glued to it, or to a sign that is.
            after = 2 + letter
            more = is_(after, _DIGITS, apart=False) | is_(after, _POINT, apart=False) & is_(after + 1, _DIGITS, apart=False) | is_(after, _LETTER | _WORD, apart=False)
            house = is_(1, _HOUSE, apart=True) & (is_(2, _LETTER, apart=False) if letter else True)
            forms.append((is_(0, _STREET, _CAP) & begins & house & ~more, 2 + letter, "address"))
            if not letter:
                forms.append((is_(0, _STREET, _CAP) & begins & is_(1, _NUMBERED, apart=True) & is_(2, _STOP, apart=False) & is_(3, _HOUSE, apart=True), 4, "address"))
            number = is_(0, _HOUSE) & begins & (is_(1, _LETTER, apart=False) if letter else True)
            first = is_(1 + letter, _WORD, _CAP, apart=True)
            forms.append((number & first & is_(2 + letter, _WAY, _CAP, apart=True), 3 + letter, "address"))
            forms.append((number & first & is_(2 + letter, _WORD, _CAP, apart=True) & is_(3 + letter, _WAY, _CAP, apart=True), 4 + letter, "address"))
        out = label.copy()
        hyphened = is_(0, apart=False) & is_(-1, _HYPHEN, apart=False) & is_(-2, _GIVEN)
        double = is_(0, _HYPHEN, apart=False) & is_(1, _WORD, _CAP, apart=False)
        for form, length, kind in forms:
            begin = 1 + 2 * KINDS.index(kind)
            for i in np.flatnonzero(form):
                a, b = i, i + length
                if kind == "name":
                    a -= 2 * hyphened[i]
                    b += 2 * (b < n and double[b])
                own = out[a:b]
                if ((own == 0) | (own == begin) | (own == begin + 1)).all():
                    if own[0] == 0:
                        own[0] = begin
                    own[1:] = begin + 1
        return out

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of what is found in each text, in order; null and empty texts have nothing."""
        if len(self.chunks) > _CACHE:
            self._forget()
        get = self.chunks.__getitem__
        tokens: list[int] = []
        counts = []
        for text in texts:
            before = len(tokens)
            if text:
                for c in map(get, text.split(" ")):
                    tokens += c
            counts.append(len(tokens) - before)
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
        token = np.array(tokens, np.int32)
        label = self._formed(token, owner, self.labels(token, owner)) if tokens else np.zeros(0, np.int8)
        starts = np.cumsum([0, *counts])
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        for i in np.unique(owner[label > 0]):
            out[i] = self._spans(texts[i], label[starts[i] : starts[i + 1]])
        return out

    def _spans(self, text: str, label: np.ndarray) -> list[tuple[int, int, str]]:
        """The spans of one text; only chunks that hold a labelled token are looked at again."""
        chunks = text.split(" ")
        before = np.cumsum([0, *(len(self.chunks[c]) for c in chunks)])
        offset = np.cumsum([0, *(len(c) + 1 for c in chunks)])
        hits = np.flatnonzero(label)
        spans, open_, last, places = [], None, -1, []
        for i, j in zip(hits, np.searchsorted(before, hits, side="right") - 1):
            if j != last:
                places, last = _pieces(chunks[j]), j
            _, _, a, b = places[i - before[j]]
            kind, begins = (label[i] - 1) // 2, label[i] % 2 == 1
            if open_ is not None and (begins or kind != open_[0] or i != open_[3] + 1):
                spans.append(open_)
                open_ = None
            open_ = (kind, open_[1] if open_ else offset[j] + a, offset[j] + b, i)
        if open_ is not None:
            spans.append(open_)
        exact = (settle(text, int(a), int(b), KINDS[k]) for k, a, b in self._joined(text, spans))
        return [x for x in exact if x]


    def _joined(self, text: str, spans: list[tuple]) -> list[tuple[int, int, int]]:
        """Spans without their last token; parts of one name that stand apart by a blank, or by a comma after a single word, are one."""
        out: list[tuple[int, int, int]] = []
        for k, a, b, _ in spans:
            if out and k == out[-1][0] and KINDS[k] == "name":
                gap, left, right = text[out[-1][2] : a], text[out[-1][1] : out[-1][2]], text[a:b]
                words = right.replace("\xa0", " ").split(" ")
                first = re.split(r"[ \xa0-]", right.lower())[0]
                after_comma = gap in (", ", ",\xa0") and not re.search(r"[ \xa0]", left) and len(words) == 1 and first in self.model.given
                if gap in (" ", "\xa0", "") or gap == ". " and len(re.split(r"[ \xa0]", left)[-1]) == 1 or after_comma:
                    out[-1] = (k, out[-1][1], b)
                    continue
            out.append((k, a, b))
        return out


_AT = r"(?:@|&#64;|\(at\)|\[at\]|\bat\b)"
_DOT = r"(?:\.|\(dot\)|\[dot\]|\bdot\b)"
# Blanks stand around a dot that is a word only; one that is a sign after a blank ends a sentence.
_EMAIL = re.compile(rf"[\w.+-]*\w\s?{_AT}\s?[\w-]+(?:\.[\w-]*\w|\s?(?!\.){_DOT}\s?[\w-]*\w)+", re.I)
_USER, _HOST = re.compile(r"[\w.+-]+\Z"), re.compile(r"(?:[\w-]*\w)?(?:\.[\w-]*\w|[ ]?(?:\(dot\)|\[dot\]|\bdot\b)[ ]?[\w-]*\w)*", re.I)
_NUMBER = re.compile(r"\+?(?:\(\+?\d+\)|\d)[\d \xa0()./\-]*\d|\d{7,}")
_MORE_DIGITS = re.compile(r"([ \xa0.\-/])\d{2,}\b")
_GLUED_BEFORE, _GLUED_AFTER = re.compile(r"(?<![\w.+(/-])\+?[\d()./-]*\d\)?[./-]?\Z"), re.compile(r"(?:[./-]?\d+)+(?![\w-])")
# Three digits after a whole number, and the written form of an American identity number.
_LAST_DIGITS, _SOCIAL = re.compile(r"[ \xa0]\d{3}\b(?![.,:/-]?\d|[ \xa0]\d)"), re.compile(r"\d{3}([- \xa0])\d{2}\1\d{4}")
# Titles and words before a name that are no part of it.
_TITLE = re.compile(
    r"(?:(?:mrs?|ms|miss|dr|fru|frøken|fröken|frk|hr|herr|frau|prof)\b\.?|(?:in|i|the|by|from|to|and|af|fra|til|og|av|från|till|och|von|vom|und)\b(?!\.))[ \xa0]+",
    re.I,
)
_FLOOR = re.compile(r"(?<=\d),[ \xa0]?\d+\Z|(?<=\d[a-zA-Z]),[ \xa0]?\d+\Z")
_BEFORE_STREET = re.compile(
    r"\b(?:gamle|gammel|gl\.|store|lille|ny|nye|nørre|sønder|søndre|øster|østre|vester|vestre|nordre|gamla|stora|lilla|nya|norra|södra|östra|västra|alte|neue|obere|untere|große|kleine)[ \xa0]\Z",
    re.I,
)
_HOUSE_FIRST = re.compile(r"\d+\s?[a-z]?\b,?\s+[^\W\d_]{2,}", re.I)


def settle(text: str, a: int, b: int, kind: str) -> tuple[int, int, str] | None:
    """The exact span of what was found, or None if it can't be such a thing.

    An email must hold a user, an at sign and a host with a dot, in whatever disguise, and is cut to them.
    Other spans are freed of punctuation at their ends. A phone number is digits with separators, 7 to 15
    of them, and takes in a group that follows by the same separator; an identity number has 9 or more
    letters and digits; an address has a number and a word, and begins with a number that stands before
    its street; a name has two parts on one line, after any title or preposition.
    """
    if kind == "email":
        # Characters of a user or host that are glued to it belong to it.
        if m := _USER.search(text, max(0, a - 64), a):
            a = m.start()
        b = max(b, _HOST.match(text, b, b + 64).end())
        m = _EMAIL.search(text, a, b)
        return (m.start(), m.end(), kind) if m else None
    while a < b and not text[a].isalnum() and not (kind == "phone" and text[a] in "+("):
        a += 1
    while a < b and not text[b - 1].isalnum() and not (kind == "phone" and text[b - 1] == ")"):
        b -= 1
    s = text[a:b]
    if kind == "phone":
        m = max(_NUMBER.finditer(s), key=lambda m: len(m.group()), default=None)
        if m is None:
            return None
        a, b = a + m.start(), a + m.end()
        # What is glued to a number is of it, if it is a number too.
        if (m := _GLUED_BEFORE.search(text, max(0, a - 16), a)) and sum(map(str.isdigit, m.group() + text[a:b])) <= 15:
            a = m.start()
        if (m := _GLUED_AFTER.match(text, b)) and sum(map(str.isdigit, text[a : m.end()])) <= 15:
            b = m.end()
        if _SOCIAL.fullmatch(text[a:b]):
            return a, b, "idnumber"
        if text[a - 1 : a] == "(" and text[a:b].count(")") > text[a:b].count("("):
            a -= 1
        # A further group set off as the last ones are belongs to it.
        gaps = re.findall(r"[ \xa0.\-/]", text[a:b])
        if not gaps and text[a:b].isdigit() and (m := _LAST_DIGITS.match(text, b)) and b - a + 3 <= 12:
            b = m.end()
        while gaps and (m := _MORE_DIGITS.match(text, b)) and m.group(1) == gaps[-1] and sum(map(str.isdigit, text[a : m.end()])) <= 13:
            b = m.end()
        return (a, b, kind) if 7 <= sum(map(str.isdigit, text[a:b])) <= 15 else None
    if kind == "idnumber":
        return (a, b, kind) if sum(c.isalnum() for c in s) >= 9 else None
    if kind == "address":
        if m := _HOUSE_FIRST.search(s):
            a, s = a + m.start(), s[m.start() :]
        if re.split(r"[ \xa0]", s.lower())[0] in _ROADS:
            return None
        # A floor or flat after the house is no part of it, an adjective before the street is.
        if m := _FLOOR.search(s):
            b, s = a + m.start(), s[: m.start()]
        if s[:1].isupper() and (m := _BEFORE_STREET.search(text, max(0, a - 12), a)):
            a, s = m.start(), m.group() + s
        return (a, b, kind) if re.search(r"\d", s) and re.search(r"[^\W\d_]{3}", s) else None
    while m := _TITLE.match(s):
        a, s = a + m.end(), s[m.end() :]
    if m := re.search(r"[, \xa0]+\d+\Z", s):
        b, s = a + m.start(), s[: m.start()]
    words = re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", s)
    # A letter without a dot before a word in lower case is a pronoun or preposition, as in "I heard".
    alone = len(words[0]) == 1 and not s.startswith(words[0] + ".") and len(words) > 1 and words[1].islower() if words else False
    if len(words) < 2 or alone or "\n" in s:
        return None
    # The dot of an initial at the end belongs to it.
    return a, b + (len(words[-1]) == 1 and text[b : b + 1] == "."), kind


def _over_texts(df: DataFrame, text: str, names: DataFrame, schema, emit) -> DataFrame:
    listed = names.filter("name is not null").select("name", "name_kind").distinct().collect()
    model = Recogniser([r["name"] for r in listed if r["name_kind"] == "given"], [r["name"] for r in listed if r["name_kind"] == "family"])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                b = batch.slice(at, _ROWS)
                texts = b.column(1).to_pylist()
                yield emit(b.column(0), texts, finder.find(texts))

    return spread(df).mapInArrow(run, schema)


def find_personal(df: DataFrame, doc: str, text: str, names: DataFrame) -> DataFrame:
    """(doc, pii_kind, pii_text): distinct strings of personal information in each text, exactly as written.

    A conditional random field over word-shape features labels the tokens; it was trained on the small
    labelled table of pii_examples. `names` (name, name_kind) is a reference list that the driver reads.
    A text of any length is one chain with the labels of its best path. Viterbi runs, in batches, over the
    stretches that may hold a label at all: bounds on the tokens' scores and the transitions prove that the
    best path is outside everywhere else. Names, addresses and numbers that are sure by their form and the
    lists are added, and all is trimmed and checked by form. Null and
    empty texts give no rows. Documents that occur twice give their rows for each, so ids should be unique.
    """

    def emit(ids, texts, found):
        rows = [(i, k, t[a:b]) for i, (t, spans) in enumerate(zip(texts, found)) for a, b, k in spans]
        rows = list(dict.fromkeys(rows))
        cols = [ids.take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())]
        return pa.RecordBatch.from_arrays(cols, [doc, "pii_kind", "pii_text"])

    rows = df.select(doc, text)
    return _over_texts(rows, text, names, f"`{doc}` {rows.schema[doc].dataType.simpleString()}, pii_kind string, pii_text string", emit)


def redact_personal(df: DataFrame, doc: str, text: str, names: DataFrame) -> DataFrame:
    """(doc, text): each text with what find_personal finds replaced by its kind, as [EMAIL]; null stays null."""

    def emit(ids, texts, found):
        out = []
        for t, spans in zip(texts, found):
            parts, at = [], 0
            for a, b, k in spans:
                parts += [t[at:a], f"[{k.upper()}]"]
                at = b
            out.append(t if t is None else "".join([*parts, t[at:]]))
        return pa.RecordBatch.from_arrays([ids, pa.array(out, pa.string())], [doc, text])

    rows = df.select(doc, text)
    return _over_texts(rows, text, names, f"`{doc}` {rows.schema[doc].dataType.simpleString()}, `{text}` string", emit)


if __name__ == "__main__":
    Recogniser.trained().save()
