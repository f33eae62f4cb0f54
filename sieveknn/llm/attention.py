"""A small causal self-attention model over subword ids, with its gradients; numpy.

One layer: the last ``CONTEXT`` inputs are attended to with a learned bias for each distance, then a feed-forward
layer, then a softmax over classes of ids and one over the members of the class. Every id of the vocabulary has an
input row, a class and a weight in it: frequent ids are grouped by their neighbours, all others by their counts.
Ids that training never meets share an input row and a class.
Texts are cut into blocks of ``BLOCK`` positions, of which ``CHUNK`` are computed at a time; each block sees the
``CONTEXT`` positions before it as well, so windows overlap and every id is scored once.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

BLOCK, CONTEXT = 16, 16
MEMBERS = 32  # ids of a class
TAIL_MEMBERS = 1024  # ids of a class of less frequent ids
BATCH = 1024  # blocks of a step
BUFFER = 32_768  # blocks that are shuffled together
PRODUCTS = 1 << 18  # states times members that are computed together
CHUNK = 128  # blocks that are computed together, so that they stay near the processor
_f = np.float32
_DISTANCE = (np.arange(BLOCK) + CONTEXT)[:, None] - np.arange(CONTEXT + BLOCK)[None, :]
_SEEN = (_DISTANCE >= 0) & (_DISTANCE < CONTEXT)  # causal, and the same reach for every position


def _longest(rows: np.ndarray) -> float:
    """The greatest length of a row."""
    return float(np.sqrt(np.einsum("nw,nw->n", rows, rows).max(initial=0)))


def _exp(t: np.ndarray, most: float) -> np.ndarray:
    """``exp`` of at most 60, in place; what is known to stay below ``most`` need not be cut off one by one."""
    if not most <= 60:
        np.minimum(t, _f(60), out=t)
    return np.exp(t, out=t)


def _log_ratio(part: np.ndarray, total: np.ndarray) -> np.ndarray:
    """log(part / total); what is smaller than single precision tells apart has the least logarithm, not minus infinity."""
    ratio = np.divide(np.maximum(part, _f(1e-30)), total, dtype=np.float64)
    return np.log(ratio, out=ratio)


@dataclass
class AttentionModel:
    """``slot`` and ``kind`` map an id to its slot and its class. Slots of a class are neighbours, from
    ``first[class]`` on, and end before ``first[class + 1]``. Ids that training never meets come last: they are the last class,
    without members in ``first``, and share an input row, which is followed by the pad's. ``share`` is a constant added to
    log P(id | class): of these ids the logarithm of their equal parts, 0 of all others."""

    slot: np.ndarray
    kind: np.ndarray
    first: np.ndarray
    share: np.ndarray
    start: int
    end: int
    p: dict[str, np.ndarray]

    def trained(self) -> dict[str, np.ndarray]:
        """What training changes: all parameters, but of the members only those that it meets. Views of ``p``."""
        return {k: v[: self.first[-1]] if k.startswith("member") else v for k, v in self.p.items()}

    def blocks(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs (n, CONTEXT + BLOCK) as input rows, targets (n, BLOCK) as ids, -1 for none, and each block's text."""
        pad, row = len(self.p["embed"]) - 1, np.minimum(self.slot, self.first[-1])
        inputs, targets, owner = [], [], []
        for k, ids in enumerate(texts):
            size = len(ids) + 1
            n = -(-size // BLOCK)
            x = np.full(CONTEXT + n * BLOCK, pad, np.int64)
            x[CONTEXT] = row[self.start]
            x[CONTEXT + 1 : CONTEXT + size] = row[ids]
            y = np.full(n * BLOCK, -1, np.int64)
            y[: size - 1] = ids
            y[size - 1] = self.end
            inputs.append(np.lib.stride_tricks.sliding_window_view(x, CONTEXT + BLOCK)[::BLOCK])
            targets.append(y.reshape(n, BLOCK))
            owner.append(np.full(n, k))
        return np.concatenate(inputs), np.concatenate(targets), np.concatenate(owner)

    def forward(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """The last states ``g`` and the probabilities ``c`` of all classes at each position."""
        g = self._states(x, self._tables())["g"]
        c = self._class_weights(g)
        c /= c.sum(axis=1, keepdims=True)
        return {"g": g.reshape(*x[:, CONTEXT:].shape, -1), "c": c.reshape(*x[:, CONTEXT:].shape, -1)}

    def log_probabilities(self, texts: list[np.ndarray], batch: int = 1536) -> np.ndarray:
        """Natural log probability of each list of ids and its end."""
        x, y, owner = self.blocks(texts)
        total = np.zeros(len(texts))
        tables = self._tables()
        for at in range(0, len(x), batch):
            ids = y[at : at + batch].reshape(-1)
            g, log = self._class_logs(x[at : at + batch], ids, tables)
            log += self.share[ids]
            log += self._member_logs(g, ids)
            total += np.bincount(owner[at : at + batch], np.where(ids < 0, 0.0, log).reshape(-1, BLOCK).sum(axis=1), len(texts))
        return total

    def _tables(self) -> tuple:
        """What attention makes of each input row, the weight of each distance, and what else is alike for all blocks.

        Values carry a one, so that one product gives sums of weights and values; the pad's row is zero. States carry a one as well,
        which meets the biases. Last comes what no product of a query and a key exceeds.
        """
        p = self.p
        e = p["embed"]
        query, key = e @ p["query"] * _f(e.shape[1] ** -0.5), e @ p["key"]
        both = np.concatenate([key, e @ p["value"], np.ones((len(e), 1), e.dtype)], axis=1)
        both[-1, key.shape[1] :] = 0
        near = np.where(_SEEN, np.exp(p["near"])[np.clip(_DISTANCE, 0, CONTEXT - 1)], 0).astype(e.dtype)
        rows = np.concatenate([e, np.zeros((len(e), 1), e.dtype)], axis=1)
        up = np.concatenate([p["up"], p["up_bias"][None]])
        down = np.concatenate([p["down"], np.zeros((len(p["down"]), 1), e.dtype)], axis=1)
        return query, both, near, rows, up, down, _longest(query) * _longest(key)

    def _states(self, x: np.ndarray, tables: tuple) -> dict[str, np.ndarray]:
        """All that lies between the inputs and the last states ``g``. Weights ``a`` are not divided by their sum ``s``."""
        query, both, near, rows, up, down, most = tables
        last, width = x[:, CONTEXT:], query.shape[1]
        q, kv = query.take(last, 0), both.take(x, 0)
        a = _exp(q @ kv[:, :, :width].transpose(0, 2, 1), most)
        a *= near
        o = (a @ kv[:, :, width:]).reshape(last.size, -1)
        s = np.maximum(o[:, -1:], _f(1e-20))
        o /= s
        h = rows.take(last.reshape(-1), 0)
        h += o
        h[:, -1] = 1
        u = h @ up
        np.maximum(u, 0, out=u)
        g = u @ down
        g += h
        return {"q": q, "kv": kv, "a": a, "s": s, "o": o, "h": h, "u": u, "g": g}

    def _class_weights(self, g: np.ndarray) -> np.ndarray:
        """For each state, numbers in proportion to the probabilities of the classes."""
        classes, bias = self.p["classes"], self.p["class_bias"]
        return _exp(g @ np.concatenate([classes, bias[None]]), _longest(g) * _longest(classes.T) + bias.max())

    def _class_logs(self, x: np.ndarray, ids: np.ndarray, tables: tuple) -> tuple[np.ndarray, np.ndarray]:
        """The last states and the log probability of each id's class."""
        states, logs = [], []
        for at in range(0, len(x), CHUNK):
            g = self._states(x[at : at + CHUNK], tables)["g"]
            c = self._class_weights(g)
            right = c[np.arange(len(g)), self.kind[ids[at * BLOCK : at * BLOCK + len(g)]]]
            logs.append(_log_ratio(right, c @ np.ones(c.shape[1], c.dtype)))
            states.append(g)
        return np.concatenate(states), np.concatenate(logs)

    def _member_logs(self, g: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Log probability of each id within its class, but for ``share``; positions are sorted by class once."""
        order, runs = self._by_class(ids)
        states, slots = g.take(order, 0), self.slot[ids[order]]
        wanted, total = np.ones(len(ids), _f), np.ones(len(ids), _f)
        members, most = self._member_rows(states)
        for c, a, b in runs:
            p, total[a:b] = self._inside(states[a:b], c, members, most)
            wanted[a:b] = p[np.arange(b - a), slots[a:b] - self.first[c]]
        out = np.empty(len(ids))
        out[order] = _log_ratio(wanted, np.maximum(total, _f(1e-30)))
        return out

    def _by_class(self, ids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Positions in order of the class wanted there, and runs ``class, begin, end`` of bounded size; what has no members comes last."""
        flat = ids.reshape(-1)
        kinds = np.where(flat < 0, len(self.first) - 1, self.kind[flat]).astype(np.int16)
        order = np.argsort(kinds, kind="stable")
        cuts, runs = np.searchsorted(kinds[order], np.arange(len(self.first))).tolist(), []
        for c, members in enumerate(np.diff(self.first).tolist()):
            step = max(1, PRODUCTS // members)
            runs += [(c, a, min(a + step, cuts[c + 1])) for a in range(cuts[c], cuts[c + 1], step)]
        return order, runs

    def _member_rows(self, states: np.ndarray) -> tuple[np.ndarray, float]:
        """The weights of the members that training meets, each with its bias, and what no product with one of ``states`` exceeds."""
        weights, bias = self.p["member"][: self.first[-1]], self.p["member_bias"][: self.first[-1]]
        most = _longest(states) * _longest(weights) + bias.max(initial=-np.inf)
        return np.concatenate([weights, bias[:, None]], axis=1), most

    def _inside(self, states: np.ndarray, c: int, members: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
        """Numbers in proportion to the probabilities of the members of class ``c``, and their sum, for each state."""
        low, high = self.first[c], self.first[c + 1]
        p = _exp(states @ members[low:high].T, most)
        return p, p @ np.ones(high - low, p.dtype)

    def _members(self, g: np.ndarray, ids: np.ndarray):
        """For each class: its positions, the probabilities of its members there, the member wanted."""
        order, runs = self._by_class(ids)
        states = g.reshape(-1, g.shape[-1])
        members, most = self._member_rows(states)
        for c, a, b in runs:
            rows = order[a:b]
            p, total = self._inside(states[rows], c, members, most)
            yield rows, p / total[:, None], self.slot[ids.reshape(-1)[rows]] - self.first[c]

    def gradients(self, x: np.ndarray, ids: np.ndarray, with_loss: bool = True) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of classes and members (0 without ``with_loss``), and the gradients of ``trained``."""
        p, tables = self.p, self._tables()
        e = p["embed"]
        width = e.shape[1]
        flat = lambda t: t.reshape(-1, t.shape[-1])
        wanted = ids.reshape(-1)
        count = max(1, int((wanted >= 0).sum()))
        part = (wanted >= 0).astype(e.dtype) / e.dtype.type(count)
        kinds = self.kind[wanted]
        d = {k: np.zeros_like(v) for k, v in self.trained().items()}
        cuts = [slice(at, at + CHUNK) for at in range(0, len(x), CHUNK)]
        passed, dg, loss = [], np.empty((len(wanted), width), e.dtype), 0.0
        for cut in cuts:
            f = self._states(x[cut], tables)
            rows = slice(cut.start * BLOCK, cut.stop * BLOCK)
            share, at = part[rows], np.arange(len(f["g"]))
            c = self._class_weights(f["g"])
            total = c @ np.ones(c.shape[1], c.dtype)
            if with_loss:
                loss -= float((np.log(c[at, kinds[rows]] / total + 1e-9) * share).sum())
            c *= (share / total)[:, None]
            c[at, kinds[rows]] -= share
            found = f["g"].T @ c
            d["classes"] += found[:-1]
            d["class_bias"] += found[-1]
            np.matmul(c, p["classes"].T, out=dg[rows])
            passed.append(f)
        order, runs = self._by_class(ids)
        states, slots, shares = np.concatenate([f["g"] for f in passed]).take(order, 0), self.slot[wanted[order]], part[order]
        members, most = self._member_rows(states)
        back = np.zeros_like(dg)
        for k, a, b in runs:
            rows = slice(a, b)
            low, high = self.first[k], self.first[k + 1]
            inside, total = self._inside(states[rows], k, members, most)
            at, member = np.arange(len(inside)), slots[rows] - low
            if with_loss:
                loss -= float(np.log(inside[at, member] / total + 1e-9) @ shares[rows])
            inside *= (shares[rows] / total)[:, None]
            inside[at, member] -= shares[rows]
            found = inside.T @ states[rows]
            d["member"][low:high] += found[:, :-1]
            d["member_bias"][low:high] += found[:, -1]
            np.matmul(inside, p["member"][low:high], out=back[rows])
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        dg += back.take(place, 0)
        near, every = np.zeros(_SEEN.shape, e.dtype), np.empty((*x.shape, width), e.dtype)
        scale = _f(width**-0.5)
        both = np.concatenate([p["key"], p["value"]], axis=1)
        for cut, f in zip(cuts, passed, strict=True):
            g = dg[cut.start * BLOCK : cut.stop * BLOCK]
            n = len(f["a"])
            du = g @ p["down"].T
            du *= f["u"] > 0
            d["down"] += f["u"].T @ g
            found = f["h"].T @ du
            d["up"] += found[:-1]
            d["up_bias"] += found[-1]
            dh = du @ p["up"].T
            dh += g
            # A weight's gradient is its part of the state's, less what all weights of the position have in common.
            back = np.empty((len(dh), width + 1), dh.dtype)
            np.divide(dh, f["s"], out=back[:, :-1])
            np.negative(np.einsum("nw,nw->n", back[:, :-1], f["o"][:, :-1]), out=back[:, -1])
            back = back.reshape(n, BLOCK, -1)
            ds = back @ f["kv"][:, :, width:].transpose(0, 2, 1)
            ds *= f["a"]
            near += ds.sum(axis=0)
            dq, dkv = ds @ f["kv"][:, :, :width], np.empty((*x[cut].shape, 2 * width), e.dtype)
            np.matmul(ds.transpose(0, 2, 1), f["q"], out=dkv[:, :, :width])
            np.matmul(f["a"].transpose(0, 2, 1), back[:, :, :-1], out=dkv[:, :, width:])
            dq *= scale
            seen, last = e.take(x[cut].reshape(-1), 0), e.take(x[cut][:, CONTEXT:].reshape(-1), 0)
            d["query"] += last.T @ flat(dq)
            found = seen.T @ flat(dkv)
            d["key"] += found[:, :width]
            d["value"] += found[:, width:]
            np.matmul(flat(dkv), both.T, out=flat(every[cut]))
            dh += flat(dq) @ p["query"].T
            every[cut][:, CONTEXT:] += dh.reshape(n, BLOCK, -1)
        d["near"] = np.bincount(_DISTANCE[_SEEN], near[_SEEN], CONTEXT)
        # Positions of an input row are brought together, then summed.
        used = x.reshape(-1).astype(np.uint16 if len(e) < 1 << 16 else np.int64)
        order = np.argsort(used, kind="stable")
        used = used[order]
        starts = np.flatnonzero(np.concatenate([[True], used[1:] != used[:-1]]))
        d["embed"][used[starts]] = np.add.reduceat(flat(every).take(order, 0), starts, axis=0)
        d["embed"][-1] = 0
        return loss, d


def frequent(counts: np.ndarray, slots: int = 1024) -> np.ndarray:
    """The ids that are grouped by their neighbours, most frequent first."""
    return np.argsort(-counts, kind="stable")[: min(slots - 1, len(counts))]


def neighbours(rows: list[np.ndarray], top: np.ndarray, size: int) -> np.ndarray:
    """How often each of ``top`` (and, last, any other id) stands behind each of them; ids are below ``size``."""
    n = len(top)
    place = np.full(size, n)
    place[top] = np.arange(n)
    found = np.zeros((n + 1) ** 2)
    pairs, held = [], 0
    for k, r in enumerate(rows):
        s = place[r]
        pairs.append(s[1:] * (n + 1) + s[:-1])
        held += len(s)
        if held > 1 << 20 or k == len(rows) - 1:
            found += np.bincount(np.concatenate(pairs), minlength=len(found))
            pairs, held = [], 0
    return found.reshape(n + 1, n + 1)


def group_ids(before: np.ndarray, classes: int, rounds: int = 8) -> np.ndarray:
    """A class for each frequent id: k-means over which frequent ids stand before and behind it."""
    n = len(before) - 1
    wide, behind = min(n, 192), before.T
    x = np.sqrt(np.concatenate([before[:n, :wide], behind[:n, :wide]], axis=1)).astype(_f)
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-6
    classes = min(classes, n)
    centre = x[np.linspace(0, n - 1, classes).astype(int)]
    for _ in range(rounds):
        nearest = (x @ centre.T).argmax(axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, nearest, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(norm > 0, sums / (norm + 1e-6), centre)
    return (x @ centre.T).argmax(axis=1)


def fresh(before: np.ndarray, top: np.ndarray, counts: np.ndarray, start: int, end: int, classes: int = 24, width: int = 16, seed: int = 5) -> AttentionModel:
    """The model before training; ``counts`` are the corpus counts of all ids, ends included."""
    groups = group_ids(before, classes)
    # Large groups become several classes of MEMBERS ids, frequent ones together: a softmax costs its length.
    parts = [part for g in range(classes) if (groups == g).any() for part in np.split(top[groups == g], range(MEMBERS, (groups == g).sum(), MEMBERS))]
    rest = np.argsort(-counts, kind="stable")[len(top) :]
    met = (counts[rest] > 0) | (rest == start) | (rest == end)
    rest, never = rest[met], rest[~met]
    parts += [rest[at : at + TAIL_MEMBERS] for at in range(0, len(rest), TAIL_MEMBERS)]
    first = np.concatenate([[0], np.cumsum([len(part) for part in parts])])
    parts += [never] if len(never) else []
    order = np.concatenate(parts)
    kind, slot = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    for k, part in enumerate(parts):
        kind[part] = k
    slot[order] = np.arange(len(order))
    share = np.zeros(len(counts))
    share[never] = -np.log(max(1, len(never)))
    mass = np.bincount(kind, counts + 1.0, len(parts))
    rng = np.random.default_rng(seed)
    normal = lambda *s: rng.normal(0, 0.2, s).astype(_f)
    p = {
        "embed": normal(first[-1] + 2, width), "query": normal(width, width), "key": normal(width, width), "value": normal(width, width),
        "near": np.zeros(CONTEXT, _f), "up": normal(width, 2 * width), "up_bias": np.zeros(2 * width, _f), "down": normal(2 * width, width),
        "classes": normal(width, len(parts)), "class_bias": np.log(mass / mass.sum() + 1e-9).astype(_f),
        "member": normal(len(order), width), "member_bias": np.log((counts[order] + 1.0) / mass[kind[order]]).astype(_f),
    }
    # What training never meets stays neutral.
    p["embed"][len(top) :] = 0
    p["member"][len(top) :] = 0
    return AttentionModel(slot, kind, first, share, start, end, p)


class Trainer:
    """Steps of Adam on a model's own copy of the parameters."""

    def __init__(self, model: AttentionModel, seed: int, batch: int = BATCH):
        self.model = replace(model, p={k: v.copy() for k, v in model.p.items()})
        self.rng, self.batch, self.step = np.random.default_rng(seed), batch, 0
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.trained().items()}

    def learn(self, x: np.ndarray, y: np.ndarray, speed) -> None:
        """One pass over the blocks in random order; ``speed`` is a number, or makes one of the step."""
        order = self.rng.permutation(len(x))
        for at in range(0, len(x), self.batch):
            pick = order[at : at + self.batch]
            self.step += 1
            _, d = self.model.gradients(x[pick], y[pick], with_loss=False)
            rate = speed(self.step) if callable(speed) else speed
            for name, value in self.model.trained().items():
                m, v = self.moments[name]
                g = d[name].astype(_f)
                m *= _f(0.9)
                v *= _f(0.99)
                m += _f(0.1) * g
                g *= g
                v += _f(0.01) * g
                np.multiply(v, _f(1 / (1 - 0.99**self.step)), out=g)
                np.sqrt(g, out=g)
                g += _f(1e-8)
                np.divide(m, g, out=g)
                g *= _f(rate / (1 - 0.9**self.step))
                value -= g


def train(
    rows: list[np.ndarray], counts: np.ndarray, start: int, end: int, slots: int = 1024, classes: int = 24, width: int = 16, steps: int = 500, batch: int = 64, seed: int = 5
) -> AttentionModel:
    """Fits the model to ``rows`` of ids on one machine; ``counts`` are the corpus counts of all ids, ends included."""
    top = frequent(counts, slots)
    before = neighbours([np.concatenate([[start], r, [end]]).astype(np.int64) for r in rows], top, len(counts))
    model = fresh(before, top, counts, start, end, classes, width, seed)
    if not rows:
        return model
    x, y, _ = model.blocks(rows)
    trainer = Trainer(model, seed, batch)
    while trainer.step < steps:
        some = trainer.rng.permutation(len(x))[: (steps - trainer.step) * batch]
        trainer.learn(x[some], y[some], lambda step: 0.02 * (1 - 0.95 * step / steps))
    return trainer.model
