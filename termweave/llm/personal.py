"""Personal data: listed patterns, and a character tagger that adds what they miss.

The tagger is a bidirectional LSTM over characters with a CRF over tags, trained in numpy from
labelled spans: those the patterns find in a bounded sample of documents, and the same spans in
spellings that the patterns do not match. It reads overlapping windows around every digit
and @ that no pattern has claimed (each kind needs one of these); a character takes the tags of
the window in which it lies farthest from an edge, so a span that crosses windows is whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.tables import written

KINDS = ["email", "ip", "card", "phone"]
# The patterns; runs of digits are taken whole, so matching is linear.
USER = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")

WINDOW, STRIDE, MARGIN = 64, 32, 24
SAMPLE = 400  # labelled windows the tagger is trained on, at most
EPOCHS = 12
TAGS = 1 + 2 * len(KINDS)
CODES = 130

Span = tuple[int, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def fits(kind: int, text: str) -> bool:
    """What a match of the kind must hold besides its pattern."""
    digits = _digits(text)
    if kind == 1:
        return all(int(p) <= 255 for p in text.split(".")) if len(digits) <= 12 else all(
            int(p[-400:]) <= 255 and not p[:-400].strip("0") for p in text.split("."))
    if kind == 2:
        return 16 <= len(digits) <= 19 and _luhn(digits)
    if kind == 3:
        return 8 <= len(digits) <= 15
    return True


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) by kind, then start; matches that fail their test are dropped."""
    out: list[Span] = []
    if not TRIGGER.search(text):
        return out
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and USER.match(text, start - 1):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        last = domain.end() if domain else at + 1
        if domain:
            out.append((0, start, last))
        at = text.find("@", last)
    for kind, pattern in ((1, IP), (2, CARD), (3, PHONE)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if fits(kind, m.group())]
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where(points < 128, points, 128 + (points > 0x24F))


def open_windows(text: str, spans: list[Span]) -> list[tuple[int, str]]:
    """Overlapping windows around the digits and @ outside the spans."""
    claimed = sorted((a, b) for _, a, b in spans)
    regions: list[list[int]] = []
    k = 0
    for m in TRIGGER.finditer(text):
        at = m.start()
        while k < len(claimed) and claimed[k][1] <= at:
            k += 1
        if k < len(claimed) and claimed[k][0] <= at:
            continue
        lo, hi = max(0, at - MARGIN), min(len(text), at + 1 + MARGIN)
        if regions and lo <= regions[-1][1]:
            regions[-1][1] = hi
        else:
            regions.append([lo, hi])
    out = []
    for lo, hi in regions:
        for at in range(lo, max(lo + 1, hi - WINDOW + STRIDE), STRIDE):
            out.append((at, text[at:min(at + WINDOW, hi)]))
    return out


class Tagger:
    """Bidirectional LSTM with a CRF; parameters are plain arrays."""

    def __init__(self, hidden: int = 12, embedded: int = 10, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {"emb": draw.normal(0, 0.5, (CODES, embedded)), "out": draw.normal(0, 0.2, (2 * hidden, TAGS)),
                  "bias": np.zeros(TAGS), "move": np.zeros((TAGS, TAGS)), "first": np.zeros(TAGS)}
        for d in "fb":
            self.p["w" + d] = draw.normal(0, 0.3, (embedded + hidden, 4 * hidden))
            self.p["c" + d] = np.repeat([0.0, 1.0, 0.0, 0.0], hidden)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states for inputs (time, batch, embedded) read in the given order."""
        n, h = self.hidden, np.zeros((x.shape[1], self.hidden))
        c, out = np.zeros_like(h), np.zeros((*x.shape[:2], n))
        w, bias = self.p["w" + d], self.p["c" + d]
        for t in range(len(x)):
            z = np.concatenate([x[t], h], axis=1)
            a = z @ w + bias
            gates = 1 / (1 + np.exp(-a[:, :3 * n]))
            i, f, o = gates[:, :n], gates[:, n:2 * n], gates[:, 2 * n:]
            g = np.tanh(a[:, 3 * n:])
            new = f * c + i * g
            tc, m = np.tanh(new), mask[t][:, None]
            if keep is not None:
                keep.append((z, i, f, o, g, c, tc, m))
            c, h = np.where(m, new, c), np.where(m, o * tc, h)
            out[t] = h
        return out

    def _back(self, grad: np.ndarray, keep: list, d: str, total: dict) -> np.ndarray:
        n, w = self.hidden, self.p["w" + d]
        dh = np.zeros_like(grad[0])
        dc, dx = np.zeros_like(dh), np.zeros((*grad.shape[:2], w.shape[0] - n))
        for t in range(len(grad) - 1, -1, -1):
            z, i, f, o, g, c, tc, m = keep[t]
            dh = dh + grad[t]
            own = np.where(m, dh, 0)
            dnew = np.where(m, dc, 0) + own * o * (1 - tc * tc)
            da = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), own * tc * o * (1 - o),
                                 dnew * i * (1 - g * g)], axis=1)
            total["w" + d] += z.T @ da
            total["c" + d] += da.sum(axis=0)
            dz = da @ w.T
            dx[t] = dz[:, :-n]
            dh, dc = dz[:, -n:] + np.where(m, 0, dh), np.where(m, dnew * f, dc)
        return dx

    def emissions(self, grid: np.ndarray, mask: np.ndarray, keep: tuple | None = None) -> np.ndarray:
        x = self.p["emb"][grid]
        ahead = self._run(x, mask, "f", keep[0] if keep else None)
        back = self._run(x[::-1], mask[::-1], "b", keep[1] if keep else None)[::-1]
        both = np.concatenate([ahead, back], axis=2)
        if keep:
            keep[2].append(both)
        return both @ self.p["out"] + self.p["bias"]

    def gradient(self, grid: np.ndarray, mask: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the tags, and its gradient."""
        keep: tuple = ([], [], [])
        scores = self.emissions(grid, mask, keep)
        steps, many = grid.shape
        move, rows = self.p["move"], np.arange(many)
        alpha = np.zeros((steps, many, TAGS))
        alpha[0] = self.p["first"] + scores[0]
        for t in range(1, steps):
            alpha[t] = np.where(mask[t][:, None], _logsum(alpha[t - 1][:, :, None] + move, 1) + scores[t], alpha[t - 1])
        beta = np.zeros((steps, many, TAGS))
        for t in range(steps - 2, -1, -1):
            beta[t] = np.where(mask[t + 1][:, None], _logsum(move + (scores[t + 1] + beta[t + 1])[:, None, :], 2), beta[t + 1])
        whole = _logsum(alpha[-1], 1)
        hot = np.eye(TAGS)[tags]
        share = np.exp(alpha + beta - whole[None, :, None])
        dscores = np.where(mask[:, :, None], share - hot, 0) / many
        total = {k: np.zeros_like(v) for k, v in self.p.items()}
        loss = whole.sum() - (self.p["first"][tags[0]] + scores[0, rows, tags[0]]).sum()
        total["first"] += dscores[0].sum(axis=0)
        for t in range(1, steps):
            live = mask[t]
            pair = np.exp(alpha[t - 1][:, :, None] + move + (scores[t] + beta[t])[:, None, :] - whole[:, None, None])
            total["move"] += (pair[live].sum(axis=0) - hot[t - 1][live].T @ hot[t][live]) / many
            loss -= (move[tags[t - 1], tags[t]] + scores[t, rows, tags[t]])[live].sum()
        both = keep[2][0]
        total["out"] += np.einsum("tbh,tbk->hk", both, dscores)
        total["bias"] += dscores.sum(axis=(0, 1))
        dboth, n = dscores @ self.p["out"].T, self.hidden
        dx = self._back(dboth[:, :, :n], keep[0], "f", total)
        dx = dx + self._back(dboth[::-1, :, n:], keep[1], "b", total)[::-1]
        np.add.at(total["emb"], grid.ravel(), dx.reshape(-1, dx.shape[2]))
        return loss / many, total

    def train(self, texts: list[np.ndarray], tags: list[np.ndarray], epochs: int = EPOCHS, rate: float = 0.02, batch: int = 48) -> list[float]:
        """Adam over shuffled batches; the mean loss of every epoch."""
        draw = np.random.default_rng(11)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses, step = [], 0
        for _ in range(epochs):
            order, own = draw.permutation(len(texts)), []
            for at in range(0, len(order), batch):
                rows = order[at:at + batch]
                grid, mask = _grid([texts[i] for i in rows])
                wanted, _ = _grid([tags[i] for i in rows])
                loss, grad = self.gradient(grid, mask, wanted)
                own.append(loss)
                step += 1
                for k, g in grad.items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.p[k] -= rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)
            losses.append(float(np.mean(own)))
        return losses

    def decode(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """The most likely tags of each window."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(texts)
        for at in range(0, len(texts), 512):
            part = texts[at:at + 512]
            grid, mask = _grid(part)
            scores = self.emissions(grid, mask)
            best, came = self.p["first"] + scores[0], []
            for t in range(1, len(grid)):
                ways = best[:, :, None] + self.p["move"]
                came.append(np.where(mask[t][:, None], ways.argmax(axis=1), np.arange(TAGS)))
                best = np.where(mask[t][:, None], ways.max(axis=1) + scores[t], best)
            path = np.zeros(grid.shape, np.int64)
            path[-1] = best.argmax(axis=1)
            for t in range(len(grid) - 2, -1, -1):
                path[t] = came[t][np.arange(len(part)), path[t + 1]]
            for k, text in enumerate(part):
                out[at + k] = path[:len(text), k]
        return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _grid(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(len(r) for r in rows)
    grid = np.zeros((longest, len(rows)), np.int64)
    for k, r in enumerate(rows):
        grid[:len(r), k] = r
    return grid, np.arange(longest)[:, None] < np.array([len(r) for r in rows])[None, :]


def tags_of(length: int, spans: list[Span]) -> np.ndarray:
    tags = np.zeros(length, np.int64)
    for kind, a, b in spans:
        tags[a:b] = 2 + 2 * kind
        tags[a] = 1 + 2 * kind
    return tags


def spans_of(tags: np.ndarray) -> list[Span]:
    """Spans of a row of tags: a first tag and the inner tags of its kind after it."""
    out: list[Span] = []
    for at in np.flatnonzero(tags):
        kind, first = (int(tags[at]) - 1) // 2, tags[at] % 2 == 1
        if not first and out and out[-1][0] == kind and out[-1][2] == at:
            out[-1] = (kind, out[-1][1], int(at) + 1)
        elif first:
            out.append((kind, int(at), int(at) + 1))
    return out


def respelt(kind: int, text: str, turn: int) -> str:
    """The same datum in a spelling that the patterns do not match."""
    digits = _digits(text)
    if kind == 0:
        return text.replace("@", (" @ ", " @", "@ ")[turn % 3])
    if kind == 1:
        return text.replace(".", (" . ", " .", ". ")[turn % 3])
    if kind == 2:
        sep = (".", "_", "/")[turn % 3]
        return sep.join(digits[i:i + 4] for i in range(0, len(digits), 4))
    return (digits[-10:-7] + "-" + digits[-7:-4] + "-" + digits[-4:], "(" + digits[-10:-7] + ") " + digits[-7:-4] + "-" + digits[-4:],
            digits[-10:-7] + "." + digits[-7:-4] + "." + digits[-4:])[turn % 3]


def fit(examples: list[tuple[str, str, int, int, int]]) -> Tagger | None:
    """A tagger from (window, spans as text, own kind, start, end); None without examples."""
    texts, tags = [], []
    for turn, (text, marked, kind, a, b) in enumerate(examples):
        spans = [(KINDS.index(k), int(s), int(e)) for k, s, e in (x.split(":") for x in marked.split(",") if x)]
        texts.append(codes(text))
        tags.append(tags_of(len(text), spans))
        if kind >= 0:
            new = respelt(kind, text[a:b], turn)
            other = text[:a] + new + text[b:]
            shifted = [(k, s + (len(new) - b + a) * (s >= b), e + (len(new) - b + a) * (s >= b))
                       for k, s, e in spans if (k, s, e) != (kind, a, b) and (e <= a or s >= b)]
            texts.append(codes(other))
            tags.append(tags_of(len(other), [*shifted, (kind, a, a + len(new))]))
    if not texts:
        return None
    tagger = Tagger()
    tagger.train(texts, tags)
    return tagger


def _example(text: str, spans: list[Span], pick: Span | None, at: int) -> tuple[str, str, int, int, int]:
    """A window around a span (or a place without one), with the spans that lie in it whole."""
    lo, hi = (max(0, pick[1] - 20), min(len(text), pick[2] + 20)) if pick else (max(0, at - 30), min(len(text), at + 30))
    free = [(k, a - lo, b - lo) for k, a, b in spans if a >= lo and b <= hi]
    apart = [s for i, s in enumerate(free) if all(s[2] <= o[1] or s[1] >= o[2] for o in free[:i])]
    kind = (pick[0], pick[1] - lo, pick[2] - lo) if pick and (pick[0], pick[1] - lo, pick[2] - lo) in apart else (-1, 0, 0)
    return text[lo:hi], joined(apart), *kind


def accept(kind: int, text: str) -> bool:
    """Spans of the tagger must hold what the kind consists of."""
    digits = _digits(text)
    if kind == 0:
        user, _, host = text.partition("@")
        return bool(user.strip()) and bool(DOMAIN.fullmatch(host.strip())) and not re.search(r"\s\S+\s", text.replace("@", ""))
    if kind == 1:
        parts = re.split(r"\s*\.\s*", text)
        return len(parts) == 4 and all(re.fullmatch("[0-9]{1,3}", p) and int(p) < 256 for p in parts)
    if kind == 2:
        return 16 <= len(digits) <= 19 and _luhn(digits) and not re.search(r"[^\W\d_]", text)
    return 8 <= len(digits) <= 15 and bool(re.fullmatch(r"[(+]?[0-9][\x20()./0-9-]+[0-9]", text)) and len(digits) < len(text)


def added_spans(windows: list[tuple[int, str]], decoded: list[np.ndarray], base: list[Span]) -> list[Span]:
    """The tags of all windows of a document reconciled, as spans that touch no base span."""
    out: list[Span] = []
    k = 0
    while k < len(windows):
        # Windows that overlap cover one region.
        last = k
        while last + 1 < len(windows) and windows[last + 1][0] < windows[last][0] + len(windows[last][1]):
            last += 1
        lo, hi = windows[k][0], windows[last][0] + len(windows[last][1])
        tags, depth, text = np.zeros(hi - lo, np.int64), np.full(hi - lo, -1), [""] * (hi - lo)
        for (at, own), path in zip(windows[k:last + 1], decoded[k:last + 1]):
            place = np.arange(len(own))
            # Ends of the region are no cut, so they count as far from an edge.
            left = place if at > lo else np.full(len(own), WINDOW)
            right = place[::-1] if at + len(own) < hi else np.full(len(own), WINDOW)
            far, here = np.minimum(left, right), slice(at - lo, at - lo + len(own))
            better = far > depth[here]
            tags[here][better], depth[here][better] = path[better], far[better]
            text[here] = list(own)
        for kind, a, b in spans_of(tags):
            piece = "".join(text[a:b])
            around = "".join(text[max(0, a - 1):a]) + "".join(text[b:b + 1])
            if accept(kind, piece) and not any(c.isalnum() for c in around) and all(b + lo <= s or a + lo >= e for _, s, e in base):
                out.append((kind, a + lo, b + lo))
        k = last + 1
    return out


_SPAN = "array<struct<kind:int,start:long,end:long>>"
_EXAMPLE = "array<struct<text:string,spans:string,kind:int,start:int,end:int>>"


def find_personal(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, base and all (spans as structs of kind, start and end in code points,
    by kind as listed, then start).

    NULL and empty texts have no spans. Without a base span in the whole table there is nothing
    to train from, and nothing is added. Repeated rows each get a row; an empty table gives none.
    """
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            base, windows, examples = [], [], []
            for text in batch["text"]:
                spans = base_spans(text) if text else []
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                open_ = open_windows(text, spans) if text else []
                windows.append([{"at": a, "text": w} for a, w in open_])
                picks = [_example(text, spans, next(s for s in spans if s[0] == k), 0) for k in sorted({s[0] for s in spans})]
                if open_:
                    picks.append(_example(text, spans, None, open_[0][0] + MARGIN))
                examples.append([dict(zip(("text", "spans", "kind", "start", "end"), e)) for e in picks])
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "base": base, "windows": windows, "examples": examples})

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(
        scan, f"doc_id long, base {_SPAN}, windows array<struct<at:long,text:string>>, examples {_EXAMPLE}")
    rows = written(rows)
    taken = rows.where(F.size("examples") > 0).select(F.explode("examples").alias("e")).select("e.*").distinct()
    examples = []
    for kind in range(-1, len(KINDS)):
        first = taken.where(F.col("kind") == kind).orderBy(F.xxhash64("text"), "text", "spans", "start").limit(sample // (len(KINDS) + 1))
        examples += [tuple(r) for r in first.collect()]
    tagger = fit(examples) if any(e[1] for e in examples) else None
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def tag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            windows = [[(int(w["at"]), w["text"]) for w in ws] if own else [] for ws in batch["windows"]]
            decoded = own.decode([codes(w) for ws in windows for _, w in ws]) if any(windows) else []
            at, all_ = 0, []
            for ws, spans in zip(windows, batch["base"]):
                base = [(int(s["kind"]), int(s["start"]), int(s["end"])) for s in spans]
                new = added_spans(ws, decoded[at:at + len(ws)], base)
                at += len(ws)
                all_.append([{"kind": k, "start": a, "end": b} for k, a, b in sorted(base + new)])
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "base": batch["base"], "all": all_})

    return rows.select("doc_id", "base", "windows").mapInPandas(tag, f"doc_id long, base {_SPAN}, all {_SPAN}")
