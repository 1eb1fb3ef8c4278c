"""Action recognition input: clips of a window of poses and their heat-map volumes."""

from __future__ import annotations

import numpy as np

CLIP, CLIPS, SEED = 48, 10, 255


def sample_clips(n: int, clip: int = CLIP, clips: int = CLIPS, seed: int = SEED) -> np.ndarray:
    """Frame indices of `clips` clips of `clip` frames from a window of n.

    Short windows repeat from evenly spread starts. Longer ones draw at random, here from a seeded generator of our own,
    so indices are reproducible but not those of another random source.
    """
    if n <= 0:
        return np.zeros(0, np.int64)
    rng = np.random.Generator(np.random.PCG64(seed))
    out = []
    for i in range(clips):
        if n < clip:
            start = i * n // clips if n >= clips else i
            out.append((start + np.arange(clip)) % n)
        elif n < 2 * clip:
            skips = np.sort(rng.permutation(clip + 1)[: n - clip])
            j = np.arange(clip)
            out.append((j + np.searchsorted(skips, j, "right")) % n)
        else:
            edge = np.arange(clip + 1) * n // clip
            out.append((edge[:-1] + rng.integers(0, 1 << 30, clip) % np.diff(edge)) % n)
    return np.concatenate(out)


def compact(points: np.ndarray, frame: tuple[int, int], padding: float = 0.25, threshold: float = 10, ratio: float = 1.0) -> tuple[np.ndarray, tuple[float, float]]:
    """Points moved to a padded box around all of them, and the box's (width, height). Tiny poses stay as they are."""
    lo, hi = points.reshape(-1, 2).min(0), points.reshape(-1, 2).max(0)
    if (hi - lo < threshold).any():
        return points, (float(frame[0]), float(frame[1]))
    half = (hi - lo) / 2 * (1 + padding)
    half[1] = max(ratio * half[0], half[1])
    half[0] = max(half[1] / ratio, half[0])
    mid = (hi + lo) / 2
    lo, hi = np.trunc(mid - half), np.trunc(mid + half)
    return points - lo, tuple((hi - lo).tolist())


def resize_crop(points: np.ndarray, size: tuple[float, float], side: int = 64) -> np.ndarray:
    """Shorter side to `side`, aspect kept, then the centre cut out."""
    scale = side / min(size)
    new = np.array([int(size[0] * scale + 0.5), int(size[1] * scale + 0.5)])
    return points * (new / np.array(size)) - (new - side) // 2


def heat_volume(points: np.ndarray, scores: np.ndarray, side: int = 64, sigma: float = 0.6) -> np.ndarray:
    """(joints, frames, side, side) Gaussian maps from (frames, people, joints, 2); people merge by maximum."""
    frames, people, joints, _ = points.shape
    out = np.zeros((joints, frames, side, side))
    axis = np.arange(side)
    for f in range(frames):
        for p in range(people):
            gx = np.exp(-((axis[None] - points[f, p, :, 0:1]) ** 2) / 2 / sigma**2)
            gy = np.exp(-((axis[None] - points[f, p, :, 1:2]) ** 2) / 2 / sigma**2)
            m = gy[:, :, None] * gx[:, None, :] * scores[f, p][:, None, None]
            out[:, f] = np.maximum(out[:, f], m)
    return out


def action_input(points: np.ndarray, scores: np.ndarray, frame: tuple[int, int]) -> np.ndarray:
    """(2 halves, clips, joints, clip, 64, 64): both halves are the same."""
    idx = sample_clips(len(points))
    moved, size = compact(points, frame)
    moved = resize_crop(moved, size)
    v = heat_volume(moved, scores)[:, idx]  # each frame once
    v = v.reshape(v.shape[0], CLIPS, CLIP, *v.shape[2:]).swapaxes(0, 1)
    return np.stack([v, v])


def clip_heat(points: np.ndarray, scores: np.ndarray, frame: tuple[int, int], block: int = 64) -> tuple[np.ndarray, np.ndarray, int]:
    """(clips, joints, clip) flat cell and value of the greatest heat of each map of action_input, and the maps' side.

    A frame's maps are the same in every clip that holds it, so each frame that a clip holds is looked at once, some frames at a time.
    """
    idx = sample_clips(len(points))
    moved, size = compact(points, frame)
    moved = resize_crop(moved, size)
    held, where = np.unique(idx, return_inverse=True)
    cells, heats, side = [], [], 64
    for i in range(0, len(held), block):
        v = heat_volume(moved[held[i : i + block]], scores[held[i : i + block]], side)
        v = v.reshape(*v.shape[:2], -1)
        at = v.argmax(2)
        cells.append(at)
        heats.append(np.take_along_axis(v, at[..., None], 2)[..., 0])
    cell, heat = (np.concatenate(a, 1)[:, where].reshape(-1, CLIPS, CLIP).swapaxes(0, 1) for a in (cells, heats))
    return cell, heat, side
