"""Human pose from heat maps: part peaks and affinity fields to people, box crops to keypoints, pose suppression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Limbs as (part, part, x map, y map), and the limbs of the ears, which only extend people.
BODY_25 = {
    "parts": 25,
    "ears": (18, 19),
    "limbs": [
        (1, 8, 26, 27), (1, 2, 40, 41), (1, 5, 48, 49), (2, 3, 42, 43), (3, 4, 44, 45), (5, 6, 50, 51), (6, 7, 52, 53),
        (8, 9, 32, 33), (9, 10, 28, 29), (10, 11, 30, 31), (8, 12, 34, 35), (12, 13, 36, 37), (13, 14, 38, 39),
        (1, 0, 56, 57), (0, 15, 58, 59), (15, 17, 62, 63), (0, 16, 60, 61), (16, 18, 64, 65), (2, 17, 46, 47),
        (5, 18, 54, 55), (14, 19, 66, 67), (19, 20, 68, 69), (14, 21, 70, 71), (11, 22, 72, 73), (22, 23, 74, 75), (11, 24, 76, 77),
    ],
}
COCO_18 = {
    "parts": 18,
    "ears": (17, 18),
    "limbs": [
        (1, 2, 31, 32), (1, 5, 39, 40), (2, 3, 33, 34), (3, 4, 35, 36), (5, 6, 41, 42), (6, 7, 43, 44), (1, 8, 19, 20),
        (8, 9, 21, 22), (9, 10, 23, 24), (1, 11, 25, 26), (11, 12, 27, 28), (12, 13, 29, 30), (1, 0, 47, 48), (0, 14, 49, 50),
        (14, 16, 53, 54), (0, 15, 51, 52), (15, 17, 55, 56), (2, 16, 37, 38), (5, 17, 45, 46),
    ],
}
MAX_PEOPLE = 96


def peaks(plane: np.ndarray, threshold: float, most: int) -> np.ndarray:
    """(n, 3) x, y, value of strict maxima among the eight neighbours, in row order, centred on a 7x7 neighbourhood."""
    v = plane.astype(np.float64)
    h, w = v.shape
    mid = v[1:-1, 1:-1]
    top = mid > threshold
    for dy in (0, 1, 2):
        for dx in (0, 1, 2):
            if (dy, dx) != (1, 1):
                top &= mid > v[dy : h - 2 + dy, dx : w - 2 + dx]
    out = []
    for y, x in zip(*(np.nonzero(top)[i][:most] + 1 for i in (0, 1))):
        ys, xs = np.arange(max(0, y - 3), min(h, y + 4)), np.arange(max(0, x - 3), min(w, x + 4))
        s = v[np.ix_(ys, xs)]
        out.append(((s.sum(0) * xs).sum() / s.sum(), (s.sum(1) * ys).sum() / s.sum(), v[y, x]))
    return np.array(out).reshape(-1, 3)


def limb_scores(a: np.ndarray, b: np.ndarray, fx: np.ndarray, fy: np.ndarray, samples: int = 10, least: float = 0.05, more_than: int = 9) -> np.ndarray:
    """(len a, len b) mean field along each candidate limb; -inf where too few samples agree."""
    h, w = fx.shape
    d = b[None, :, :2] - a[:, None, :2]
    norm = np.sqrt((d**2).sum(2))
    t = np.arange(samples) / samples
    at = a[:, None, None, :2] + t[None, None, :, None] * d[:, :, None]
    xi, yi = (np.minimum(w - 1, (at[..., 0] + 0.5).astype(int)), np.minimum(h - 1, (at[..., 1] + 0.5).astype(int)))
    unit = d / np.where(norm > 1e-6, norm, 1)[..., None]
    s = unit[..., 0, None] * fx[yi, xi] + unit[..., 1, None] * fy[yi, xi]
    good = s > least
    n = good.sum(2)
    return np.where((n > more_than) & (norm > 1e-6), (s * good).sum(2) / np.maximum(n, 1), -np.inf)


def greedy_pairs(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """Best pairs first (of equals the later indices), each row and column once."""
    i, j = np.nonzero(np.isfinite(scores))
    order = sorted(zip(scores[i, j], i, j), reverse=True)
    rows, cols, out = set(), set(), []
    for s, a, b in order:
        if a not in rows and b not in cols:
            rows.add(a)
            cols.add(b)
            out.append((int(a), int(b), float(s)))
    return out


def assemble(maps: np.ndarray, model: dict = BODY_25, peak_threshold: float = 0.05, most: int = 127, min_parts: int = 3, min_score: float = 0.4, scale: float = 1.0) -> np.ndarray:
    """(people, parts, 3) keypoints in frame pixels from (channels, h, w) heat maps and fields."""
    parts = [peaks(maps[p], peak_threshold, most) for p in range(model["parts"])]
    people: list[dict] = []  # part -> peak, with "n" and "score"
    for number, (pa, pb, mx, my) in enumerate(model["limbs"]):
        a, b = parts[pa], parts[pb]
        if not len(a) or not len(b):
            for p, own in ((pa, a), (pb, b)):
                for k in range(len(own)):
                    if not any(h.get(p) == k for h in people):
                        people.append({p: k, "n": 1, "score": own[k, 2]})
            continue
        links = greedy_pairs(limb_scores(a, b, maps[mx], maps[my]))
        if number in model["ears"]:
            for i, j, _ in links:
                for h in people:
                    if h.get(pa) == i and pb not in h:
                        h[pb] = j
                    elif h.get(pb) == j and pa not in h:
                        h[pa] = i
            continue
        for i, j, s in links:
            owners = [h for h in people if h.get(pa) == i] if number else []
            for h in owners:
                h[pb] = j
                h["n"] += 1
                h["score"] += b[j, 2] + s
            if not owners:
                people.append({pa: i, pb: j, "n": 2, "score": a[i, 2] + b[j, 2] + s})
    kept = [h for h in people if h["n"] >= min_parts and h["score"] / h["n"] > min_score][:MAX_PEOPLE]
    out = np.zeros((len(kept), model["parts"], 3))
    for i, h in enumerate(kept):
        for p in range(model["parts"]):
            if p in h:
                out[i, p] = parts[p][h[p]] * (scale, scale, 1)
    return out


#: Candidate pairs that are held at once.
PAIRS = 1 << 17


def _grouped(groups: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]][: len(groups)])


def peaks_many(maps: np.ndarray, parts: int, threshold: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """`peaks` of the first `parts` planes of (frames, channels, h, w): all in order of frame and part, and how many each frame and part has."""
    frames, channels, h, w = maps.shape
    values = maps.reshape(-1)
    f, p = np.divmod(np.flatnonzero(maps[:, :parts] > threshold), parts * h * w)
    p, y = np.divmod(p, h * w)
    y, x = np.divmod(y, w)
    f, p, y, x = (a[(x > 0) & (x < w - 1) & (y > 0) & (y < h - 1)] for a in (f, p, y, x))
    at = ((f * channels + p) * h + y) * w + x
    v = values[at]
    top = np.ones(len(v), bool)
    for d in (-w - 1, -w, 1 - w, -1, 1, w - 1, w, w + 1):
        top &= v > values[at + d]
    group = (f * parts + p)[top]
    count = np.bincount(group, minlength=frames * parts)
    top = np.flatnonzero(top)[np.arange(len(group)) - (np.cumsum(count) - count)[group] < most]
    at, y, x, v = at[top], y[top], x[top], v[top]
    far = np.arange(-3, 4)[:, None]
    ys, xs = y + far, x + far
    inside = ((ys >= 0) & (ys < h))[:, None] & ((xs >= 0) & (xs < w))[None]
    s = np.where(inside, values.take((far * w + at)[:, None] + far[None], mode="clip"), 0.0)  # by row and column of a neighbourhood
    down, across = s.sum(0), s.sum(1)
    total = down.sum(0)
    return np.stack([(down * xs).sum(0) / total, (across * ys).sum(0) / total, v], 1), np.minimum(count, most).reshape(frames, parts)


def _links(maps: np.ndarray, found: np.ndarray, first: np.ndarray, count: np.ndarray, limbs: np.ndarray) -> tuple[np.ndarray, ...]:
    """`greedy_pairs` of every limb and frame: limb, place among the limb's links of its frame, frame, peaks, score, in that order."""
    (frames, channels, h, w), values = maps.shape, maps.reshape(-1)
    a, b = count[:, limbs[:, 0]].T.ravel(), count[:, limbs[:, 1]].T.ravel()  # by limb and frame
    n = a * b
    ends = np.cumsum(n)
    kept = []
    for begin in range(0, int(ends[-1]), PAIRS):
        at = np.arange(begin, min(begin + PAIRS, int(ends[-1])))
        g = np.searchsorted(ends, at, "right")
        i, j = np.divmod(at - (ends - n)[g], b[g])
        limb, f = np.divmod(g, frames)
        pa, pb, mx, my = limbs[limb].T
        (x, y, _), (x2, y2, _) = found[first[f, pa] + i].T, found[first[f, pb] + j].T
        dx, dy = x2 - x, y2 - y
        norm = np.sqrt(dx**2 + dy**2)
        t = (np.arange(10) / 10)[:, None]
        cell = np.minimum(h - 1, (y + t * dy + 0.5).astype(int)) * w + np.minimum(w - 1, (x + t * dx + 0.5).astype(int))
        length = np.where(norm > 1e-6, norm, 1)
        s = dx / length * values[(f * channels + mx) * (h * w) + cell] + dy / length * values[(f * channels + my) * (h * w) + cell]
        good = s > 0.05
        agree = good.sum(0)
        s = s * good
        s = ((s[0] + s[1]) + (s[2] + s[3])) + ((s[4] + s[5]) + (s[6] + s[7])) + s[8] + s[9]  # in the order of a sum over ten neighbours in memory
        s = s / np.maximum(agree, 1)
        fine = (agree > 9) & (norm > 1e-6) & np.isfinite(s)
        kept.append([x[fine] for x in (g, i, j, s)])
    if not kept:
        return (np.zeros(0, int),) * 5 + (np.zeros(0),)
    g, i, j, s = (np.concatenate(x) for x in zip(*kept))
    order = np.lexsort((-j, -i, -s, g))
    g, i, j, s = g[order], i[order], j[order], s[order]
    out, place = [], 0
    row, col = np.full(len(n), -1), np.full(len(n), -1)
    while len(g):
        best = _grouped(g)
        out.append([*np.divmod(g[best], frames), np.full(len(best), place), i[best], j[best], s[best]])
        row[g[best]], col[g[best]] = i[best], j[best]
        rest = (i != row[g]) & (j != col[g])
        g, i, j, s, place = g[rest], i[rest], j[rest], s[rest], place + 1
    if not out:
        return (np.zeros(0, int),) * 5 + (np.zeros(0),)
    limb, f, place, i, j, s = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((f, place, limb))
    return limb[order], place[order], f[order], i[order], j[order], s[order]


class _People:
    """The people of many frames while they are put together: their peaks by part (-1: none), number and score."""

    def __init__(self, frames: int, parts: int):
        self.have, self.n, self.score, self.count = np.full((frames, 4, parts), -1), np.zeros((frames, 4), int), np.zeros((frames, 4)), np.zeros(frames, int)

    def add(self, f: np.ndarray, peaks: dict[int, np.ndarray | int], score: np.ndarray) -> None:
        """One more in each of the frames f, all different."""
        if not len(f):
            return
        at = self.count[f]
        if at.max() >= self.n.shape[1]:
            more = ((0, 0), (0, self.n.shape[1]))
            self.have, self.n, self.score = np.pad(self.have, (*more, (0, 0)), constant_values=-1), np.pad(self.n, more), np.pad(self.score, more)
        for p, k in peaks.items():
            self.have[f, at, p] = k
        self.n[f, at], self.score[f, at] = len(peaks), score
        self.count[f] += 1


def assemble_many(maps: np.ndarray, model: dict = BODY_25, peak_threshold: float = 0.05, most: int = 127, min_parts: int = 3, min_score: float = 0.4, scale: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """`assemble` of many frames at once: how many people each has, and (people, parts, 3) keypoints of all."""
    limbs = np.array(model["limbs"])
    maps = np.ascontiguousarray(maps, np.float64)
    found, count = peaks_many(maps, model["parts"], peak_threshold, most)
    pairs = np.cumsum((count[:, limbs[:, 0]] * count[:, limbs[:, 1]]).sum(1))
    cuts = [*_grouped(pairs // PAIRS).tolist(), len(maps)]
    ends = np.concatenate([[0], np.cumsum(count.sum(1))])
    got = [_assembled(maps[a:b], found[ends[a] : ends[b]], count[a:b], limbs, model, min_parts, min_score, scale) for a, b in zip(cuts, cuts[1:])]
    return np.concatenate([n for n, _ in got]), np.concatenate([p for _, p in got])


def _assembled(maps, found, count, limbs, model, min_parts, min_score, scale) -> tuple[np.ndarray, np.ndarray]:
    frames, parts = count.shape
    first = (np.cumsum(count.ravel()) - count.ravel()).reshape(count.shape)
    value = found[:, 2]
    limb, place, f, i, j, s = _links(maps, found, first, count, limbs)
    begins = [*_grouped(limb * (len(value) + 1) + place).tolist(), len(limb)]
    steps: dict[int, list[slice]] = {}
    for b, e in zip(begins, begins[1:]):
        steps.setdefault(int(limb[b]), []).append(slice(b, e))
    people = _People(frames, parts)
    missing = (count[:, limbs[:, 0]] == 0) | (count[:, limbs[:, 1]] == 0)
    some = missing.any(0).tolist()
    for number, (pa, pb, _, _) in enumerate(model["limbs"]):
        for p in (pa, pb) if some[number] else ():
            own = np.where(missing[:, number], count[:, p], 0)
            for k in range(own.max()):
                at = np.flatnonzero(own > k)
                at = at[~(people.have[at, :, p] == k).any(1)]
                people.add(at, {p: k}, value[first[at, p] + k])
        for step in steps.get(number, []):
            at, a, b, link = f[step], i[step], j[step], s[step]
            at_a, at_b = people.have[at, :, pa], people.have[at, :, pb]
            if number in model["ears"]:
                far = (at_a == a[:, None]) & (at_b < 0)
                near = ~far & (at_b == b[:, None]) & (at_a < 0)
                people.have[at, :, pb], people.have[at, :, pa] = np.where(far, b[:, None], at_b), np.where(near, a[:, None], at_a)
                continue
            owners = (at_a == a[:, None]) if number else np.zeros(at_a.shape, bool)
            more = value[first[at, pb] + b]
            people.have[at, :, pb] = np.where(owners, b[:, None], at_b)
            people.n[at] += owners
            people.score[at] = np.where(owners, people.score[at] + (more + link)[:, None], people.score[at])
            new = ~owners.any(1)
            people.add(at[new], {pa: a[new], pb: b[new]}, (value[first[at, pa] + a] + more + link)[new])
    fine = (people.n >= max(min_parts, 1)) & (people.score / np.maximum(people.n, 1) > min_score)
    fine &= np.cumsum(fine, 1) <= MAX_PEOPLE
    at, h = np.nonzero(fine)
    k = people.have[at, h]
    held = k >= 0
    out = np.zeros((len(at), parts, 3))
    out[held] = found[(first[at] + k)[held]] * (scale, scale, 1)
    return fine.sum(1), out


@dataclass
class PoseLimits:
    """Parameters of pose suppression: fixed values of the body models."""

    delta1: float = 1.0
    mu: float = 1.7
    delta2: float = 2.65
    gamma: float = 22.48
    least_score: float = 0.3
    matches: float = 5.0
    alpha: float = 0.1


#: Fixed values of the models of 133 and 136 points under the loss that weights regions.
WHOLE_BODY = PoseLimits(1.0, 1.65, 8.0, 3.6, 0.01, 3.0, 0.15)
FACE_FACTOR, HAND_FACTOR = 1.9, 0.55
FACE_POINTS, HAND_POINTS = 68, 42


def heatmap_points(maps: np.ndarray, crop: tuple[float, float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """(joints, 2) frame pixels and scores of (joints, h, w) heat maps of one crop (x, y, w, h).

    The greatest cell shifts a quarter towards its higher neighbour; the crop's aspect is the map's.
    """
    n, h, w = maps.shape
    at = maps.reshape(n, -1).argmax(1)
    score = maps.reshape(n, -1)[np.arange(n), at]
    y, x = np.divmod(at, w)
    p = np.stack([x, y], 1).astype(np.float64)
    i = np.flatnonzero((x > 0) & (x < w - 1) & (y > 0) & (y < h - 1))
    p[i, 0] += 0.25 * np.sign(maps[i, y[i], x[i] + 1] - maps[i, y[i], x[i] - 1])
    p[i, 1] += 0.25 * np.sign(maps[i, y[i] + 1, x[i]] - maps[i, y[i] - 1, x[i]])
    p[score <= 0] = 0
    scale = crop[2] / w
    centre = np.array([crop[0] + crop[2] / 2, crop[1] + crop[3] / 2])
    return (p - np.array([w, h]) / 2) * scale + centre, score.astype(np.float64)


def heatmap_points_many(maps: np.ndarray, crops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`heatmap_points` of many crops: (crops, joints, 2) and (crops, joints)."""
    n, joints, h, w = maps.shape
    maps = maps.reshape(n * joints, h, w)
    at = maps.reshape(n * joints, -1).argmax(1)
    score = maps.reshape(n * joints, -1)[np.arange(n * joints), at]
    y, x = np.divmod(at, w)
    p = np.stack([x, y], 1).astype(np.float64)
    i = np.flatnonzero((x > 0) & (x < w - 1) & (y > 0) & (y < h - 1))
    p[i, 0] += 0.25 * np.sign(maps[i, y[i], x[i] + 1] - maps[i, y[i], x[i] - 1])
    p[i, 1] += 0.25 * np.sign(maps[i, y[i] + 1, x[i]] - maps[i, y[i] - 1, x[i]])
    p[score <= 0] = 0
    centre = np.stack([crops[:, 0] + crops[:, 2] / 2, crops[:, 1] + crops[:, 3] / 2], 1)
    return (p.reshape(n, joints, 2) - np.array([w, h]) / 2) * (crops[:, 2] / w)[:, None, None] + centre[:, None], score.reshape(n, joints)


def _distance(d: np.ndarray, picked: np.ndarray, scores: np.ndarray, limit: PoseLimits) -> np.ndarray:
    near = np.where(d <= 1, np.tanh(picked / limit.delta1) * np.tanh(scores / limit.delta1), 0)
    return (near + limit.mu * np.exp(-d / limit.delta2)).sum(1)


def pose_nms(points: np.ndarray, scores: np.ndarray, boxes: np.ndarray, min_area: float = 0.0, limit: PoseLimits | None = None, compat: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
    """Merged poses in order of their mean score. points (n, joints, 2), scores (n, joints), boxes (n, 4) x, y, w, h.

    Models with 133 or more joints count matches of body, face and hand points apart; with `compat` those counts are
    always 0, as an integer division in the original leaves them.
    """
    limit = limit or PoseLimits()
    n, joints = scores.shape
    whole = joints >= 133
    points, scores = points.astype(np.float64).copy(), scores.astype(np.float64).copy()
    reference = limit.alpha * boxes[:, 2:].max(1)
    human = scores.mean(1)
    live = np.ones(n, bool)
    out = []
    while live.any():
        rows = np.flatnonzero(live)
        pick = rows[int(np.argmax(human[rows]))]
        d = np.sqrt(((points[rows] - points[pick]) ** 2).sum(2))
        final = _distance(d, scores[pick], scores[rows], limit)
        near = min(reference[pick], 7.0)
        if whole:
            factor = np.concatenate([np.ones(joints - FACE_POINTS - HAND_POINTS), np.full(FACE_POINTS, FACE_FACTOR), np.full(HAND_POINTS, HAND_FACTOR)])
            sure = int((scores[pick] > limit.least_score / 2).sum())
            step = 0 if compat or not sure else joints / sure / 2
            matched = (d / near <= factor).sum(1) * step
        else:
            matched = (d / near <= 1).sum(1)
        gone = (final > limit.gamma) | (matched >= limit.matches)
        if not gone.any():
            gone = rows == pick
        live[rows[gone]] = False
        if scores[pick].max() < limit.least_score:
            continue
        weight = np.where(d[gone] <= min(reference[pick], 15.0), scores[rows[gone]], 0)
        total = weight.sum(0)
        share = weight / np.where(total > 0, total, 1)
        merged = (points[rows[gone]] * share[..., None]).sum(0)
        merged_score = (share**2 * total).sum(0)
        points[pick], scores[pick] = merged, merged_score
        if not whole and merged_score.max() < limit.least_score:
            continue
        size = merged.max(0) - merged.min(0)
        if 1.5 * 1.5 * size[0] * size[1] >= min_area:
            out.append((merged, merged_score))
    return out


def pose_nms_many(points: np.ndarray, scores: np.ndarray, boxes: np.ndarray, frame: np.ndarray, min_area: float = 0.0, limit: PoseLimits | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`pose_nms` of many frames at once, for models of fewer than 133 joints: frame, points and scores of the poses.

    frame: the frame of each pose, in ascending order. One round picks a pose in every frame that has one left.
    """
    limit = limit or PoseLimits()
    x, y, scores = points[..., 0].astype(np.float64), points[..., 1].astype(np.float64), scores.astype(np.float64).copy()
    reference = limit.alpha * boxes[:, 2:].max(1)
    human = scores.mean(1)
    live = np.arange(len(points))
    out = []
    while len(live):
        begins = _grouped(frame[live])
        of = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(live)]))  # a live pose's frame, among those left
        most = np.maximum.reduceat(human[live], begins)[of]
        best = np.flatnonzero((human[live] == most) | np.isnan(human[live]))
        pick = live[best[_grouped(of[best])]]
        picked = pick[of]
        d = np.sqrt((x[live] - x[picked]) ** 2 + (y[live] - y[picked]) ** 2)
        row, joint = np.nonzero(d <= 1)
        near = np.zeros(d.shape)
        near[row, joint] = np.tanh(scores[picked[row], joint] / limit.delta1) * np.tanh(scores[live[row], joint] / limit.delta1)
        final = (near + limit.mu * np.exp(-d / limit.delta2)).sum(1)
        matched = (d / np.minimum(reference[picked], 7.0)[:, None] <= 1).sum(1)
        gone = (final > limit.gamma) | (matched >= limit.matches)
        gone |= ~np.logical_or.reduceat(gone, begins)[of] & (live == picked)
        rows, to = live[gone], of[gone]
        runs = _grouped(to)
        weight = np.where(d[gone] <= np.minimum(reference[picked[gone]], 15.0)[:, None], scores[rows], 0)
        total = np.add.reduceat(weight, runs)
        share = weight / np.where(total > 0, total, 1)[to]
        merged_x, merged_y = np.add.reduceat(x[rows] * share, runs), np.add.reduceat(y[rows] * share, runs)
        merged_score = np.add.reduceat(share**2 * total[to], runs)
        sure = ~(scores[pick].max(1) < limit.least_score)
        x[pick[sure]], y[pick[sure]], scores[pick[sure]] = merged_x[sure], merged_y[sure], merged_score[sure]
        area = 1.5 * 1.5 * (merged_x.max(1) - merged_x.min(1)) * (merged_y.max(1) - merged_y.min(1))
        kept = sure & ~(merged_score.max(1) < limit.least_score) & (area >= min_area)
        out.append((frame[pick[kept]], np.stack([merged_x[kept], merged_y[kept]], 2), merged_score[kept]))
        live = live[~gone]
    if not out:
        return frame[:0], points[:0], scores[:0]
    at, p, s = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(at, kind="stable")
    return at[order], p[order], s[order]
