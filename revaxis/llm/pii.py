"""Personal data in texts: fixed patterns, and a character BiLSTM-CRF that adds spans.

The patterns give the base spans. The model reads overlapping windows of characters: a
bidirectional LSTM scores tags, a CRF with learnt transitions decodes each window, and the
spans of all windows of a text are reconciled by the choice of spans, not overlapping, that has
the largest total score. Base spans always stay; what the model finds beside them is added.

The model is trained in numpy on a bounded sample of windows, labelled by the base spans and
by rewritten copies of them (other groupings and prefixes). A span must hold what its kind cannot
be without, such as digits or an "@", so windows with neither can add nothing and are not
decoded; every other window of every text is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, sampled

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 80, 40
#: Documents whose windows may be learnt from, and windows that are (about, at most): a fifth
#: for each kind of span that they begin with, and a fifth without any.
TRAINING_DOCS, TRAINING_WINDOWS = 4_000, 2_000
HIDDEN = 20
#: Mean probability of a span's tags from which it is added.
CONFIDENCE = 0.95

# The patterns of the base spans. A digit run is entered at its start only and
# e-mail is looked up from "@", which gives the same matches in time linear in the text.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")
NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the patterns' matches, sorted."""
    spans, after, at = [], 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > after and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                after = domain.end()
                spans.append((start, 0, after))
                at = after - 1
        at = text.find("@", at + 1)
    for found in IP.finditer(text):
        parts = [part.lstrip("0") for part in found[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            spans.append((found.start(), 1, found.end()))
    for kind, pattern, low, high in ((2, CARD, 14, 19), (3, PHONE, 10, 15)):
        for found in pattern.finditer(text):
            digits = NOT_DIGIT.sub("", found[0])
            if low <= len(digits) <= high and (kind == 3 or luhn(digits)):
                spans.append((found.start(), kind, found.end()))
    spans.sort()
    return spans


# --- characters, windows and tags ------------------------------------------------

# Characters with a number of their own; digits share one, other characters two.
OWN = "abcdefghijklmnopqrstuvwxyz@.-+() \n_%/=:,\"'#[]"
SYMBOLS = 3 + len(OWN)
_NUMBERS = {c: 3 + i for i, c in enumerate(OWN)}
_TABLE = np.array([1 if 48 <= c < 58 else _NUMBERS.get(chr(c).lower(), 2) for c in range(128)], np.int16)
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
_ALLOWED = np.array([
    [to % 2 == 1 or to == 0 or (at != 0 and (at + 1) // 2 == to // 2) for to in range(TAGS)] for at in range(TAGS)
])
_BLOCKED = np.where(_ALLOWED, 0.0, -1e4)
_FIRST = np.array([0.0 if tag % 2 == 1 or tag == 0 else -1e4 for tag in range(TAGS)])


def numbered(text: str) -> np.ndarray:
    """A number for each code point; 0 stands for the space beyond a text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 128, _TABLE[np.minimum(codes, 127)], 2)


def window_starts(text: str) -> list[int]:
    """Starts of the windows with a digit or an "@"; windows of a text overlap by half."""
    found = set()
    for match in TRIGGER.finditer(text):
        cell = match.start() // STRIDE
        found.update((cell * STRIDE, max(0, cell - 1) * STRIDE))
    return sorted(found)


def window_numbers(numbers: np.ndarray, start: int) -> np.ndarray:
    out = np.zeros(WINDOW, np.int16)
    part = numbers[start : start + WINDOW]
    out[: len(part)] = part
    return out


def span_tags(spans, start: int) -> np.ndarray:
    """Tags of a window; earlier spans go before later ones that overlap them."""
    tags = np.zeros(WINDOW, np.int8)
    for low, kind, high in spans:
        a, b = max(low - start, 0), min(high - start, WINDOW)
        if a < b and not tags[a:b].any():
            tags[a:b] = 2 + 2 * kind
            tags[a] = 1 + 2 * kind  # a span cut by the window begins with it
    return tags


# --- the model -------------------------------------------------------------------

@dataclass
class Tagger:
    """Parameters by name: ``e`` input, ``u`` recurrent and ``b`` bias of both directions, ``w`` and ``o`` to tags, ``t`` transitions."""

    parameters: dict[str, np.ndarray]

    @staticmethod
    def fresh(seed: int) -> Tagger:
        draw, h = np.random.default_rng(seed), HIDDEN
        bias = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
        p = {
            "e": draw.normal(0, 0.3, (2, SYMBOLS, 4 * h)), "u": draw.normal(0, 1 / np.sqrt(h), (2, h, 4 * h)),
            "b": np.stack([bias, bias])[:, None], "w": draw.normal(0, 0.3, (2, h, TAGS)), "o": np.zeros(TAGS),
            "t": np.zeros((TAGS, TAGS)),
        }
        return Tagger({k: v.astype(np.float32) for k, v in p.items()})

    def emissions(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Scores of tags, by place in the window, window and tag. Both directions run in step."""
        p, h, (n, length) = self.parameters, HIDDEN, x.shape
        both = np.stack([x, x[:, ::-1]])
        state, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        out, steps = np.empty((length, 2, n, h), np.float32), []
        inputs = np.stack([p["e"][0][both[0]], p["e"][1][both[1]]]) + p["b"][:, None]
        for t in range(length):
            z = inputs[:, :, t] + state @ p["u"]
            gates = 1 / (1 + np.exp(-np.clip(z[..., : 3 * h], -30, 30)))
            i, f, o, g = gates[..., :h], gates[..., h : 2 * h], gates[..., 2 * h :], np.tanh(z[..., 3 * h :])
            before, cell_before = state, cell
            cell = f * cell + i * g
            squashed = np.tanh(cell)
            state = o * squashed
            out[t] = state
            if keep is not None:
                steps.append((i, f, o, g, squashed, before, cell_before))
        if keep is not None:
            keep |= {"both": both, "out": out, "steps": steps}
        return out[:, 0] @ p["w"][0] + out[::-1, 1] @ p["w"][1] + p["o"]

    def marginals(self, scores: np.ndarray):
        """Log partition, probabilities of tags, and expected transitions; scaled at each place."""
        length, move = len(scores), np.exp(self.parameters["t"].astype(float)) * _ALLOWED
        top = scores.max(2, keepdims=True)
        here = np.exp((scores - top).astype(float))
        alpha, beta, scale = np.empty_like(here), np.ones_like(here), np.empty(here.shape[:2])
        at = here[0] * (_FIRST == 0)
        for k in range(length):
            if k:
                at = (at @ move) * here[k]
            scale[k] = at.sum(1)
            at = alpha[k] = at / scale[k][:, None]
        for k in range(length - 2, -1, -1):
            beta[k] = ((here[k + 1] * beta[k + 1]) @ move.T) / scale[k + 1][:, None]
        tags = alpha * beta
        after = here[1:] * beta[1:] / scale[1:, :, None]
        moves = move * np.tensordot(alpha[:-1], after, ((0, 1), (0, 1)))
        return (np.log(scale) + top[..., 0]).sum(0), tags, moves

    def decode(self, x: np.ndarray):
        """Best tags of each window and the probability of each tag on its own."""
        scores, t = self.emissions(x), self.parameters["t"] + _BLOCKED
        _, tags, _ = self.marginals(scores)
        best, back = scores[0] + _FIRST, []
        for k in range(1, len(scores)):
            ways = best[:, :, None] + t
            back.append(ways.argmax(1))
            best = ways.max(1) + scores[k]
        at = best.argmax(1)
        path = [at]
        for pointers in reversed(back):
            at = pointers[np.arange(len(at)), at]
            path.append(at)
        path = np.array(path[::-1])
        chance = np.take_along_axis(tags, path[:, :, None], 2)[:, :, 0]
        return path.T, chance.T

    def gradients(self, x: np.ndarray, gold: np.ndarray):
        """Mean negative log likelihood of the tags and its gradient."""
        p, h, keep = self.parameters, HIDDEN, {}
        scores = self.emissions(x, keep)
        total, tags, moves = self.marginals(scores)
        n, places = len(x), np.arange(x.shape[1])
        one = np.zeros_like(tags)
        one[places[:, None], np.arange(n)[None, :], gold.T] = 1
        true = (scores * one).sum() + p["t"][gold[:, :-1], gold[:, 1:]].sum()
        by_score = (tags - one) / n
        seen = np.zeros_like(moves)
        np.add.at(seen, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
        grad = {"t": (moves - seen) / n * _ALLOWED, "o": by_score.sum((0, 1))}
        by_score = np.stack([by_score, by_score[::-1]], axis=1).astype(np.float32)
        grad["w"] = np.einsum("tdnh,tdnk->dhk", keep["out"], by_score)
        by_state = np.einsum("tdnk,dhk->tdnh", by_score, p["w"])
        zs = np.empty((len(places), 2, n, 4 * h), np.float32)
        d_state, d_cell, u = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32), np.zeros_like(p["u"])
        back = p["u"].transpose(0, 2, 1)
        for t in places[::-1]:
            i, f, o, g, squashed, before, cell_before = keep["steps"][t]
            d = d_state + by_state[t]
            d_cell = d_cell + d * o * (1 - squashed**2)
            z = zs[t]
            z[..., :h] = d_cell * g * i * (1 - i)
            z[..., h : 2 * h] = d_cell * cell_before * f * (1 - f)
            z[..., 2 * h : 3 * h] = d * squashed * o * (1 - o)
            z[..., 3 * h :] = d_cell * i * (1 - g**2)
            u += before.transpose(0, 2, 1) @ z
            d_state, d_cell = z @ back, d_cell * f
        hot = np.eye(SYMBOLS, dtype=np.float32)
        grad["e"] = np.stack([
            np.tensordot(hot[keep["both"][d].T.ravel()], zs[:, d].reshape(-1, 4 * h), ((0,), (0,))) for d in (0, 1)])
        return (total.sum() - true) / n, grad | {"u": u, "b": zs.sum((0, 2))[:, None]}


def fit_tagger(x: np.ndarray, gold: np.ndarray, epochs: int = 14, batch: int = 50, rate: float = 0.03, seed: int = 5) -> Tagger:
    """Adam on windows ``x`` with tags ``gold``; the same windows in any order give the same model."""
    order = np.lexsort(np.concatenate([gold.T, x.T]))
    x, gold = x[order], gold[order]
    tagger, draw = Tagger.fresh(seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in tagger.parameters.items()}
    second = {k: np.zeros_like(v) for k, v in tagger.parameters.items()}
    step, steps = 0, epochs * -(-len(x) // batch)
    for _ in range(epochs):
        shuffled = draw.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = shuffled[at : at + batch]
            _, gradient = tagger.gradients(x[rows], gold[rows])
            step += 1
            size = np.sqrt(sum((g**2).sum() for g in gradient.values()))
            slow = rate * (1 - 0.95 * step / steps)
            for k, g in gradient.items():
                g = g * min(1.0, 5.0 / (size + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                change = (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
                tagger.parameters[k] = (tagger.parameters[k] - slow * change).astype(np.float32)
    return tagger


# --- labelled windows --------------------------------------------------------------

def rewritten(text: str, spans, draw: np.random.Generator):
    """A copy of a text with phones and cards grouped differently, and their spans."""
    out, moved, at = [], [], 0
    size = 0
    for low, kind, high in spans:
        if low < at:
            continue
        found, digits = text[low:high], NOT_DIGIT.sub("", text[low:high])
        if kind == 3:
            d, sep = digits[-10:], draw.choice(["-", ".", " "])
            found = draw.choice([f"({d[:3]}) {d[3:6]}-{d[6:]}", sep.join((d[:3], d[3:6], d[6:])), f"+{digits}"])
        elif kind == 2:
            found = draw.choice(["", " ", "-", "."]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
        out.append(text[at:low])
        size += low - at
        moved.append((size, kind, size + len(found)))
        out.append(found)
        size += len(found)
        at = high
    return "".join(out) + text[at:], moved


def shaped_spans(text: str, spans) -> list[tuple[int, int, int]]:
    """The base spans, and numbers in a card's form with a wrong check digit.

    All digits are one symbol to the model, so it cannot learn the check, which is made afterwards; left
    without a tag, such numbers would only teach it to doubt the form.
    """
    more = [
        (found.start(), 2, found.end()) for found in CARD.finditer(text)
        if 14 <= len(digits := NOT_DIGIT.sub("", found[0])) <= 19 and not luhn(digits)
    ]
    return sorted([*spans, *more])


def labelled_windows(text: str, spans) -> list[tuple[list[int], list[int]]]:
    numbers = numbered(text)
    return [(window_numbers(numbers, s).tolist(), span_tags(spans, s).tolist()) for s in window_starts(text)]


def learn_tagger(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = TRAINING_DOCS, windows: int = TRAINING_WINDOWS,
) -> Tagger | None:
    """Train on windows of about ``rows`` documents with a digit or "@", picked by a hash of the text.

    About ``windows`` windows reach the driver, as many of each kind as there are, up to its part:
    rare kinds are learnt from no fewer than frequent ones. Without any there is no model.
    """
    @F.pandas_udf("array<struct<kind int, x array<int>, gold array<int>>>")
    def cut(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            spans = shaped_spans(t, base_spans(t))
            found = labelled_windows(t, spans)
            if spans:
                found += labelled_windows(*rewritten(t, spans, np.random.default_rng(len(t))))
            out.append([{"kind": next((t + 1) // 2 for t in [*g, 0] if t) if any(g) else 0, "x": x, "gold": g} for x, g in found])
        return pd.Series(out)

    part = sampled(docs.select(F.col(text).alias("t")).where(F.col("t").rlike("[0-9@]")), F.col("t"), rows)
    cuts = part.select(F.explode(cut("t")).alias("w")).select("w.*").distinct()
    counted = dict(map(tuple, cuts.groupBy("kind").count().collect()))
    cells, part = 1 << 30, windows // (1 + len(KINDS))
    share = F.lit(0)
    for kind, n in counted.items():
        share = F.when(F.col("kind") == kind, F.lit(min(cells, int(cells * part / n)))).otherwise(share)
    found = cuts.where(F.pmod(F.xxhash64(F.col("x").cast("string")), F.lit(cells)) < share).collect()
    if not found:
        return None
    return fit_tagger(np.array([r["x"] for r in found], np.int64), np.array([r["gold"] for r in found], np.int64))


# --- whole texts -------------------------------------------------------------------

def window_spans(path: np.ndarray, chance: np.ndarray, start: int, length: int):
    """``(low, high, kind, score)`` of a decoded window; spans cut by a window's edge are left to the next."""
    out, at = [], 0
    size = min(WINDOW, length - start)
    while at < size:
        tag = path[at]
        if tag % 2 == 0:
            at += 1
            continue
        end = at + 1
        while end < size and path[end] == tag + 1:
            end += 1
        cut = (at == 0 and start > 0) or (end == WINDOW and start + WINDOW < length)
        if not cut:
            out.append((start + at, start + end, (int(tag) - 1) // 2, float(chance[at:end].mean())))
        at = end
    return out


def reconciled(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """The spans without overlap that have the largest total score, over the whole text."""
    best_of: dict[tuple[int, int, int], float] = {}
    for low, high, kind, score in spans:
        best_of[low, high, kind] = max(score, best_of.get((low, high, kind), 0.0))
    ordered = sorted(best_of, key=lambda s: (s[1], s[0], s[2]))
    ends = [s[1] for s in ordered]
    best, taken = [0.0], []
    for i, (low, high, kind) in enumerate(ordered):
        before = int(np.searchsorted(ends[:i], low, side="right"))
        score = best[before] + best_of[low, high, kind]
        taken.append(score > best[i])
        best.append(max(best[i], score))
    out, i = [], len(ordered)
    while i:
        if taken[i - 1]:
            low, high, kind = ordered[i - 1]
            out.append((low, high, kind, best_of[low, high, kind]))
            i = int(np.searchsorted(ends[: i - 1], low, side="right"))
        else:
            i -= 1
    return out[::-1]


def plausible(kind: int, found: str) -> bool:
    """Whether a span holds what its kind cannot be without, as the patterns ask too."""
    digits = len(NOT_DIGIT.sub("", found))
    if kind == 0:
        return found.count("@") == 1
    if kind == 1:
        return found.count(".") == 3 and 4 <= digits <= 12
    return 10 <= digits <= 15 if kind == 3 else 14 <= digits <= 19 and luhn(NOT_DIGIT.sub("", found))


def added_spans(tagger: Tagger, texts: list[str], base: list[list], batch: int = 512) -> list[list[tuple[int, int, int, float]]]:
    """For each text the model's spans that overlap no base span."""
    places = [(i, s) for i, t in enumerate(texts) for s in window_starts(t)]
    numbers: dict[int, np.ndarray] = {}
    found: list[list] = [[] for _ in texts]
    for at in range(0, len(places), batch):
        part = places[at : at + batch]
        numbers = {i: numbers[i] if i in numbers else numbered(texts[i]) for i, _ in part}
        path, chance = tagger.decode(np.array([window_numbers(numbers[i], s) for i, s in part], np.int64))
        for row, (i, start) in enumerate(part):
            found[i].extend(window_spans(path[row], chance[row], start, len(texts[i])))
    out = []
    for text, spans, own in zip(texts, found, base):
        # Weak and implausible spans go first, so that they push no sound one out.
        out.append(reconciled([
            s for s in spans
            if s[3] >= CONFIDENCE and plausible(s[2], text[s[0] : s[1]]) and not any(s[0] < e and b < s[1] for b, _, e in own)
        ]))
    return out


def personal_spans(tagger: Tagger | None):
    """A function on text columns giving all spans, by start and then kind.

    ``score`` is 1 and ``base`` true for spans of the patterns. Null counts as empty.
    """
    kind = "array<struct<kind string, start int, end int, score double, base boolean>>"

    @F.pandas_udf(kind)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = [t or "" for t in batch]
            base = [base_spans(t) for t in texts]
            more = added_spans(tagger, texts, base) if tagger else [[] for _ in texts]
            out = []
            for own, added in zip(base, more):
                rows = [(s, k, e, 1.0, True) for s, k, e in own] + [(s, k, e, p, False) for s, e, k, p in added]
                out.append([
                    {"kind": KINDS[k], "start": s, "end": e, "score": p, "base": b} for s, k, e, p, b in sorted(rows)])
            yield pd.Series(out)

    return spans


def find_personal(docs: DataFrame, tagger: Tagger | None, text: str = "text", into: str = "spans") -> DataFrame:
    """Every row with its spans in column ``into``, which is replaced if there."""
    return docs.withColumn(into, personal_spans(tagger)(F.col(text)))


def joined_spans(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def mask_personal(docs: DataFrame, tagger: Tagger | None, text: str = "text") -> DataFrame:
    """Every row with its spans' text replaced by ``[kind]``; where spans overlap, the first is named."""
    column = free_name(docs, "spans")
    found = find_personal(docs, tagger, text, column)
    step = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    masked = F.aggregate(
        F.col(column), step,
        lambda a, s: F.when(s["start"] < a["at"], F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at"))).otherwise(
            F.struct(F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].alias("at"))),
        lambda a: F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, F.length(text))),
    )
    return found.withColumn(text, F.when(F.col(text).isNotNull(), masked)).drop(column)
