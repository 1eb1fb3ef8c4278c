"""Constant-velocity Kalman filter of boxes, for many tracks at once.

The state is (centre x, centre y, aspect, height) and its velocity. Noise is diagonal and each coordinate moves with its own
velocity only, so the 8x8 filter falls apart into four 2x2 filters, kept here as arrays of shape (tracks, 4).
"""

from __future__ import annotations

import numpy as np

#: Fixed values of the motion model: weights of the height in position and velocity noise, and the aspect's own noise.
POSITION, VELOCITY = 1 / 20, 1 / 160
ASPECT_START, ASPECT_STEP, ASPECT_SEEN = (1e-2, 1e-5), (1e-2, 1e-5), 1e-1


def measure(tlwh: np.ndarray) -> np.ndarray:
    """(left, top, width, height) boxes as measurements."""
    h = tlwh[:, 3]
    return np.stack([tlwh[:, 0] + tlwh[:, 2] / 2, tlwh[:, 1] + h / 2, tlwh[:, 2] / h, h], 1)


def box(mean: np.ndarray) -> np.ndarray:
    w = mean[:, 2] * mean[:, 3]
    return np.stack([mean[:, 0] - w / 2, mean[:, 1] - mean[:, 3] / 2, w, mean[:, 3]], 1)


def _noise(h: np.ndarray, weight: float, aspect: float) -> np.ndarray:
    s = np.repeat((weight * h)[:, None], 4, 1)
    s[:, 2] = aspect
    return s * s


class Motion:
    """pos, vel and the variances pp, pv, vv of each track."""

    def __init__(self, z: np.ndarray):
        self.pos, self.vel = z.copy(), np.zeros_like(z)
        self.pp = _noise(z[:, 3], 2 * POSITION, ASPECT_START[0])
        self.vv = _noise(z[:, 3], 10 * VELOCITY, ASPECT_START[1])
        self.pv = np.zeros_like(z)

    @staticmethod
    def join(parts: list["Motion"]) -> "Motion":
        out = Motion(np.zeros((0, 4)))
        for name in ("pos", "vel", "pp", "pv", "vv"):
            setattr(out, name, np.concatenate([getattr(p, name) for p in parts] or [np.zeros((0, 4))]))
        return out

    def take(self, rows) -> "Motion":
        out = Motion(np.zeros((0, 4)))
        for name in ("pos", "vel", "pp", "pv", "vv"):
            setattr(out, name, getattr(self, name)[rows])
        return out

    def predict(self, rows: np.ndarray, steady: np.ndarray) -> None:
        """One step of the given tracks; the height of those not `steady` keeps still."""
        self.vel[rows[~steady], 3] = 0.0
        h = self.pos[rows, 3]
        qp, qv = _noise(h, POSITION, ASPECT_STEP[0]), _noise(h, VELOCITY, ASPECT_STEP[1])
        self.pos[rows] += self.vel[rows]
        self.pp[rows] += 2 * self.pv[rows] + self.vv[rows] + qp
        self.pv[rows] += self.vv[rows]
        self.vv[rows] += qv

    def correct(self, rows: np.ndarray, z: np.ndarray) -> None:
        r = _noise(self.pos[rows, 3], POSITION, ASPECT_SEEN)
        s = self.pp[rows] + r
        kp, kv = self.pp[rows] / s, self.pv[rows] / s
        d = z - self.pos[rows]
        self.pos[rows] += kp * d
        self.vel[rows] += kv * d
        self.vv[rows] -= kv * self.pv[rows]
        self.pv[rows] *= 1 - kp
        self.pp[rows] *= 1 - kp


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of all (left, top, width, height) boxes, both border pixels counted."""
    lo = np.maximum(a[:, None, :2], b[None, :, :2])
    hi = np.minimum((a[:, :2] + a[:, 2:])[:, None], (b[:, :2] + b[:, 2:])[None])
    inter = np.clip(hi - lo + 1, 0, None).prod(2)
    area = lambda x: (x[:, 2] + 1) * (x[:, 3] + 1)
    return inter / (area(a)[:, None] + area(b)[None] - inter)
