"""Raster operators on raw arrays (height, width, channels), for use inside Arrow batches."""

from __future__ import annotations

import numpy as np

from strandline.functions.decode import resize_plane


def crop(image: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    return image[max(y, 0) : y + h, max(x, 0) : x + w]


def resize(image: np.ndarray, width: int, height: int, region: tuple[int, int, int, int] | None = None) -> np.ndarray:
    """Stretched to width x height, after a crop to (x, y, w, h) if given."""
    part = crop(image, *region) if region else image
    return np.rint(resize_plane(part, width, height)).astype(image.dtype)


def letterbox(image: np.ndarray, net_w: int, net_h: int, fill: int = 114) -> np.ndarray:
    h, w = image.shape[:2]
    ratio = min(net_w / w, net_h / h)
    nw, nh = int(w * ratio), int(h * ratio)
    out = np.full((net_h, net_w, *image.shape[2:]), fill, image.dtype)
    y, x = int((net_h - nh) / 2), int((net_w - nw) / 2)
    out[y : y + nh, x : x + nw] = resize(image, nw, nh)
    return out


def normalise(image: np.ndarray, mean: tuple[float, ...], std: tuple[float, ...], scale: float = 1.0, swap: bool = False) -> np.ndarray:
    """alpha * x + beta for each channel, channels first; `swap` turns BGR into RGB."""
    x = image[..., ::-1] if swap else image
    alpha, beta = scale / np.array(std), -np.array(mean) / np.array(std) * scale
    return (x.astype(np.float64) * alpha + beta).transpose(2, 0, 1)


def stitch(images: list[np.ndarray], vertical: bool = False) -> np.ndarray:
    """Side by side, or one above the other; missing area is black."""
    hs, ws = [i.shape[0] for i in images], [i.shape[1] for i in images]
    shape = (sum(hs), max(ws)) if vertical else (max(hs), sum(ws))
    out = np.zeros((*shape, *images[0].shape[2:]), images[0].dtype)
    at = 0
    for i in images:
        if vertical:
            out[at : at + i.shape[0], : i.shape[1]] = i
            at += i.shape[0]
        else:
            out[: i.shape[0], at : at + i.shape[1]] = i
            at += i.shape[1]
    return out


def blend_width(left_w: int, right_w: int, left_x: int, right_x: int) -> int:
    """Width of two images that overlap over the columns left_x..right_x, up to a multiple of 32."""
    return -(-(left_w + right_w - (right_x - left_x + 1)) // 32) * 32


def blend(left: np.ndarray, right: np.ndarray, left_x: int, right_x: int) -> np.ndarray:
    """Joined with a linear ramp over the overlap; columns beyond the content are black."""
    n = right_x - left_x + 1
    out = np.zeros((left.shape[0], blend_width(left.shape[1], right.shape[1], left_x, right_x), *left.shape[2:]), left.dtype)
    start = left.shape[1] - n
    out[:, :start] = left[:, :start]
    ramp = np.linspace(1, 0, n).reshape(1, n, *[1] * (left.ndim - 2))
    out[:, start : start + n] = np.rint(left[:, start:] * ramp + right[:, :n] * (1 - ramp))
    out[:, start + n : start + right.shape[1]] = right[:, n:]
    return out


def look_up(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Every value replaced by its entry in a table of 256."""
    return np.asarray(table)[plane]


def remap(image: np.ndarray, grid: np.ndarray, turn: bool = False) -> np.ndarray:
    """Nearest pixel at each (x, y) of a grid (h, w, 2); outside is black. turn: rotated by 180 degrees."""
    g = np.rint(grid).astype(int)
    inside = (g[..., 0] >= 0) & (g[..., 0] < image.shape[1]) & (g[..., 1] >= 0) & (g[..., 1] < image.shape[0])
    out = image[np.clip(g[..., 1], 0, image.shape[0] - 1), np.clip(g[..., 0], 0, image.shape[1] - 1)].copy()
    out[~inside] = 0
    return out[::-1, ::-1] if turn else out


def fit_affine(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """2x3 transform of three or more points, by least squares."""
    a = np.concatenate([src, np.ones((len(src), 1))], 1)
    return np.linalg.lstsq(a, dst, rcond=None)[0].T


def warp_affine(image: np.ndarray, m: np.ndarray, width: int, height: int) -> np.ndarray:
    """The image under a 2x3 transform, nearest pixel."""
    inv = np.linalg.inv(np.vstack([m, [0, 0, 1]]))
    gy, gx = np.mgrid[0:height, 0:width]
    at = np.stack([gx, gy, np.ones_like(gx)], -1) @ inv.T
    return remap(image, at[..., :2])


def disparity_bytes(disparity: np.ndarray) -> np.ndarray:
    """Least to 0, greatest to 255."""
    lo, hi = disparity.min(), disparity.max()
    return np.zeros(disparity.shape, np.uint8) if hi <= lo else ((disparity - lo) / (hi - lo) * 255).astype(np.uint8)
