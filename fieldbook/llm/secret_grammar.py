"""Secrets: fixed patterns find the plain ones, and stochastic automata inferred from labelled credentials score the rest.

Grammar inference: the labelled credentials of a family make a prefix tree with counts. States are merged while their ends
and outgoing symbols agree within the Hoeffding bound all the way down (red states are settled, blue ones are their children,
the most visited first), which leaves a small probabilistic automaton. Ordinary tokens give one more, as the background.

Labels come from the patterns' own matches in the corpus and from ``FORMATS``, well-known public token forms. A candidate is
any long run of credential characters with a digit that no pattern covers. It is taken if the best family's likelihood a
symbol is as good as that of held-out credentials, and exceeds the background's by more than any held-out ordinary token does.

Texts are read once, whole; what they hold goes on as one narrow row a document, and the automata are applied to that.
"""

from __future__ import annotations

import heapq
import math
import random
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.llm import bytescan
from fieldbook.llm.common import Workspace

# The base patterns of the contract and what a match must measure.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")  # the third pattern, [0-9a-f]+, is a run of bytes
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST = {"assign": 12, "access": 18, "hex": 16}  # bytes of the credential
BASE = tuple(LEAST)
CANDIDATE = 16  # bytes of a candidate, at least
ORDINARY = 6  # bytes of an ordinary token, at least
ORDINARY_A_CHUNK = 50  # that a chunk of about a megabyte offers for training
# Public token forms as (family, prefix, alphabet, length of the rest).
_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
FORMATS = (
    ("code_host", "ghp_", _ALNUM, 36),
    ("payments", "sk_live_", _ALNUM, 24),
    ("maps", "AIza", _ALNUM + "_-", 35),
    ("chat", "xoxb-", "0123456789-" + _ALNUM, 50),
)
LABELLED = 1000  # credentials of a family, at most
ORDINARY_TOKENS = 4000  # at most
LONGEST_EXAMPLE = 128  # longer labelled values are no examples; candidates are scored at any length
EXAMPLES = 40  # fewer labelled ones make no family
CONFIDENCE = 0.01
UNSEEN = 1e-9


@dataclass
class Automaton:
    """State 0 is the start. ``steps[s]`` maps a symbol to (next state, log probability); ``ends[s]`` is a log probability."""

    steps: list[dict]
    ends: list[float]

    def likelihood(self, value: str) -> float:
        """Mean log probability of a symbol, the end included. A symbol that a state doesn't know costs ``UNSEEN``, and the
        walk goes on from the state that knows it best, the start if none does."""
        at, total, unseen = 0, 0.0, math.log(UNSEEN)
        for c in value:
            step = self.steps[at].get(c)
            if step is None:
                total += unseen
                at = self.entry.get(c, 0)
            else:
                at = step[0]
                total += step[1]
        return (total + self.ends[at]) / (len(value) + 1)

    def __post_init__(self):
        best: dict = {}
        for known in self.steps:
            for c, (to, p) in known.items():
                if c not in best or p > best[c][1]:
                    best[c] = (to, p)
        self.entry = {c: to for c, (to, _) in best.items()}


@dataclass
class _Tree:
    """A prefix tree whose states are merged in place. ``kids[s]`` maps a symbol to (state, count)."""

    kids: list[dict] = field(default_factory=lambda: [{}])
    visits: list[int] = field(default_factory=lambda: [0])
    ended: list[int] = field(default_factory=lambda: [0])

    def add(self, value: str) -> None:
        at = 0
        self.visits[0] += 1
        for c in value:
            to, n = self.kids[at].get(c, (None, 0))
            if to is None:
                to = len(self.kids)
                self.kids.append({})
                self.visits.append(0)
                self.ended.append(0)
            self.kids[at][c] = (to, n + 1)
            self.visits[to] += 1
            at = to
        self.ended[at] += 1

    def alike(self, a: int, b: int, slack: float) -> bool:
        """Whether two states' ends and symbols, and those of the states they lead to, differ within the bound."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = self.visits[a], self.visits[b]
            bound = slack * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
            if bound >= 1:
                continue  # too few visits to tell anything here or further down
            if abs(self.ended[a] / na - self.ended[b] / nb) > bound:
                return False
            for c in self.kids[a].keys() | self.kids[b].keys():
                (ta, ca), (tb, cb) = self.kids[a].get(c, (None, 0)), self.kids[b].get(c, (None, 0))
                if abs(ca / na - cb / nb) > bound:
                    return False
                if ta is not None and tb is not None:
                    todo.append((ta, tb))
        return True

    def fold(self, a: int, b: int) -> None:
        """Add the tree under ``b`` to the states from ``a`` on."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.visits[a] += self.visits[b]
            self.ended[a] += self.ended[b]
            for c, (tb, cb) in self.kids[b].items():
                ta, ca = self.kids[a].get(c, (None, 0))
                self.kids[a][c] = (tb if ta is None else ta, ca + cb)
                if ta is not None:
                    todo.append((ta, tb))


def infer(values: Iterable[str], confidence: float = CONFIDENCE) -> Automaton:
    """The automaton of the given strings. The order of equals is that of the symbols, so the result is repeatable."""
    tree = _Tree()
    for v in sorted(values):
        tree.add(v)
    slack = math.sqrt(0.5 * math.log(2 / confidence))
    red, seen = [0], {0}
    blue = [(-tree.visits[t], c, 0, t) for c, (t, _) in tree.kids[0].items()]
    heapq.heapify(blue)
    while blue:
        _, c, parent, b = heapq.heappop(blue)
        if tree.kids[parent].get(c, (None, 0))[0] != b or b in seen:
            continue
        to = next((r for r in red if tree.alike(r, b, slack)), None)
        if to is None:
            red.append(b)
            seen.add(b)
            changed = [b]
        else:
            tree.kids[parent][c] = (to, tree.kids[parent][c][1])
            tree.fold(to, b)
            changed = red
        for r in changed:
            for s, (t, _) in tree.kids[r].items():
                if t not in seen:
                    heapq.heappush(blue, (-tree.visits[t], s, r, t))
    place = {r: i for i, r in enumerate(red)}
    steps, ends = [], []
    for r in red:
        n = tree.visits[r] + 1
        steps.append({c: (place[t], math.log(k / n)) for c, (t, k) in tree.kids[r].items()})
        ends.append(math.log(max(tree.ended[r], UNSEEN) / n))
    return Automaton(steps, ends)


@dataclass
class Model:
    """Families' automata with the likelihood that a member must reach, and what it must have over the background."""

    families: dict[str, tuple[Automaton, float]]
    background: Automaton | None
    margin: float

    def judge(self, value: str) -> tuple[str, float] | None:
        """(family, likelihood a symbol over the background's) of an accepted value."""
        value = value.rstrip(".=-")
        plain = self.background.likelihood(value) if self.background else math.log(UNSEEN)
        scored = [(a.likelihood(value), k, least) for k, (a, least) in self.families.items()]
        fit = [(p - plain, k) for p, k, least in scored if p >= least]
        best = max(fit, default=None)
        return (best[1], best[0]) if best and best[0] > self.margin else None


def _held_out(value: str) -> bool:
    return crc32(value.encode()) % 4 == 0


def train(labelled: dict[str, list[str]], ordinary: list[str]) -> Model:
    """Automata of three quarters of the labelled and ordinary strings; thresholds from the rest.

    A family's threshold is the least likelihood of its held-out members that is no outlier
    (beyond one and a half times the quartiles' distance). The margin is what no
    held-out ordinary token exceeds, and at least half a nat a symbol.
    """
    background = infer(v for v in ordinary if not _held_out(v)) if ordinary else None
    families = {}
    for k, values in sorted(labelled.items()):
        known, rest = [v for v in values if not _held_out(v)], sorted({v for v in values if _held_out(v)})
        if len(known) < EXAMPLES or not rest:
            continue
        a = infer(known)
        got = sorted(a.likelihood(v) for v in rest)
        low, high = got[len(got) // 4], got[3 * len(got) // 4]
        families[k] = (a, max(got[0], low - 1.5 * (high - low)))
    model = Model(families, background, 0.5)
    for v in ordinary:
        if _held_out(v):
            best = model.judge(v)
            if best:
                model.margin = best[1]
    return model


def format_examples(count: int = 400, seed: int = 7) -> dict[str, list[str]]:
    rnd = random.Random(seed)
    return {f: [p + "".join(rnd.choice(chars) for _ in range(n)) for _ in range(count)] for f, p, chars, n in FORMATS}


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])
_OPEN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])
READ = ("id long, base array<struct<kind:string,start:long,end:long,value:string>>, "
        "open array<struct<start:long,end:long,value:string>>, ordinary array<string>")
SPANS = "array<struct<kind:string,start:long,end:long,value:string,score:double>>"


def _members(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_HEX, _DIGIT = _members("0123456789abcdef"), _members("0123456789")
_CREDENTIAL, _TAIL = _members(_ALNUM + "+/_.=-"), _members(".=-")


def _runs(inside: np.ndarray, offs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal runs of ``least`` bytes or more; a run stops at a row's end."""
    n = len(inside)
    if not n:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    start = np.flatnonzero(inside & (~np.concatenate([[False], inside[:-1]]) | edge[:n]))
    end = np.flatnonzero(inside & (~np.concatenate([inside[1:], [False]]) | edge[1:])) + 1
    long = end - start >= least
    return start[long], end[long]


def _anchored(raw: bytes, where: list[int], pattern: re.Pattern, offs: np.ndarray):
    """Matches at the given places, leftmost first and none within another, each inside its row."""
    reach = 0
    for at, stop in zip(where, offs[np.searchsorted(offs, where, "right")].tolist() if where else []):
        if at >= reach:
            m = pattern.match(raw, at, stop)
            if m:
                reach = m.end()
                yield m


def _base(data: np.ndarray, raw: bytes, offs: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(start, kind number, end, credential's start and end) of the base spans of a chunk, in this order."""
    low, out = _LOWER[data].tobytes(), []
    words = sorted(m.start() for w in KEYWORDS for m in re.finditer(w, low))
    for m in _anchored(raw, words, ASSIGN, offs):
        if m.end(2) - m.start(2) >= LEAST["assign"]:
            out.append((m.start(), 0, m.end(), m.start(2), m.end(2)))
    for m in _anchored(raw, [m.start() for m in re.finditer(b"AKIA", raw)], ACCESS, offs):
        if m.end() - m.start() >= LEAST["access"]:
            out.append((m.start(), 1, m.end(), m.start(), m.end()))
    out += [(s, 2, e, s, e) for s, e in zip(*(x.tolist() for x in _runs(_HEX[data], offs, LEAST["hex"])))]
    return sorted(out)


def _open(data: np.ndarray, offs: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of long runs of credential characters with a digit that no base span meets; then of ordinary tokens."""
    start, end = _runs(_CREDENTIAL[data], offs, 6)
    if not len(start):
        return start, end, start, end
    body = np.maximum.accumulate(np.where(_TAIL[data], 0, np.arange(1, len(data) + 1)))  # end of the last other byte
    end = np.maximum(body[end - 1], start)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    free = np.ones(len(start), dtype=bool)
    if len(base):
        reach = np.maximum.accumulate(base[:, 2])
        before = np.searchsorted(base[:, 0], end, "left")
        free = (before == 0) | (reach[np.maximum(before - 1, 0)] <= start)
    cand = free & (end - start >= CANDIDATE) & (digits[end] > digits[start])
    plain = free & (end - start >= ORDINARY)
    return start[cand], end[cand], start[plain], end[plain]


def read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, base, open, ordinary): each text's base spans and candidates, and a few ordinary tokens of each chunk."""

    def lists(rows: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), values)

    def run(batches):
        for b in batches:
            for lo, hi, data, offs in bytescan.chunks(b.column(1)):
                raw, n = data.tobytes(), hi - lo
                inner = np.concatenate([[0], np.cumsum((data & 0xC0) == 0x80)])
                row_of = lambda at: np.searchsorted(offs, at, "right") - 1
                place = lambda at, row: at - offs[row] - (inner[at] - inner[offs[row]])
                cut = lambda s, e: pa.array([raw[x:y].decode() for x, y in zip(s.tolist(), e.tolist())], pa.string())
                base = np.array(_base(data, raw, offs), dtype=np.int64).reshape(-1, 5)
                rb = row_of(base[:, 0])
                spans = pa.StructArray.from_arrays(
                    [pa.array([BASE[k] for k in base[:, 1].tolist()], pa.string()), pa.array(place(base[:, 0], rb)),
                     pa.array(place(base[:, 2], rb)), cut(base[:, 3], base[:, 4])], fields=list(_SPAN))
                s, e, ps, pe = _open(data, offs, base)
                ro = row_of(s)
                cands = pa.StructArray.from_arrays([pa.array(place(s, ro)), pa.array(place(e, ro)), cut(s, e)], fields=list(_OPEN))
                some = np.sort(np.argsort(bytescan.mix(ps.astype(np.uint64) + np.uint64(len(data))), kind="stable")[:ORDINARY_A_CHUNK])
                words = lists(row_of(ps[some]), n, cut(ps[some], pe[some]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, n), lists(rb, n, spans), lists(ro, n, cands), words],
                                                 names=["id", "base", "open", "ordinary"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, READ)


def _sample(values: DataFrame, col: str, most: int) -> list[str]:
    """At most ``most`` distinct strings of a table, the first by hash."""
    rows = values.where(F.length(col) <= LONGEST_EXAMPLE).select(col).distinct().orderBy(F.xxhash64(col), col).limit(most)
    return [r[0] for r in rows.collect()]


def fit(found: DataFrame) -> Model:
    """Automata from bounded samples of what ``read`` found: ``LABELLED`` credentials a kind, ``ORDINARY_TOKENS`` tokens."""
    base = found.select(F.explode("base").alias("b")).select("b.kind", "b.value")
    labelled = {k: _sample(base.where(F.col("kind") == k), "value", LABELLED) for k in BASE}
    ordinary = _sample(found.select(F.explode("ordinary").alias("w")), "w", ORDINARY_TOKENS)
    return train(labelled | format_examples(), ordinary)


def scored(found: DataFrame, model: Model) -> DataFrame:
    """(id, base, spans): ``found`` with all accepted spans by start, base ones first; those of an automaton are named
    ``like_`` and their family and carry the score."""
    sent = found.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            spans = []
            for base, cands in zip(b.column("base").to_pylist(), b.column("open").to_pylist()):
                got = [{**s, "score": None} for s in base]
                for c in cands:
                    hit = sent.value.judge(c["value"])
                    if hit:
                        got.append({**c, "kind": "like_" + hit[0], "score": round(hit[1], 4)})
                order = {k: i for i, k in enumerate(BASE)}
                spans.append(sorted(got, key=lambda s: (s["start"], order.get(s["kind"], len(BASE)), s["kind"])))
            kind = pa.list_(pa.struct([*[f for f in _SPAN], ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("base"), pa.array(spans, kind)], names=["id", "base", "spans"])

    return found.select("id", "base", "open").mapInArrow(run, f"{READ.split(', open')[0]}, spans {SPANS}")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """One row for each row of ``docs``: id, base (spans of the patterns) and spans (all, with kind, start, end, value, score).
    Places are code points, end exclusive.

    Null and empty texts have none; a text of any length is read whole; repeated rows are judged each; other columns are
    ignored, and an empty table gives no rows. Without ``model`` one is fitted on this table. A family with fewer than
    ``EXAMPLES`` labelled credentials is left out, so that a table without any has the public forms alone.
    """
    ws = Workspace(docs.sparkSession, "secrets")
    found = ws.keep(read(docs, id_col, text_col))
    return scored(found, model or fit(found))


def listed(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda m: F.concat_ws(":", m["kind"], m["start"], m["end"])), ",")
