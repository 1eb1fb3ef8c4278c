import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from strandline.functions import action, assignment, ctc, decode, image, motion, ocr, pose
from strandline.operators.tracking import Tracker, TrackerConfig


@given(st.integers(0, 4), st.integers(0, 4), st.integers(0, 10_000))
@settings(max_examples=60, deadline=None)
def test_assignment_is_best(n, m, seed):
    cost = np.random.default_rng(seed).random((n, m))
    limit = 0.8
    pairs, rows, cols = assignment.assign(cost, limit)
    value = sum(cost[p] for p in pairs) + limit / 2 * (len(rows) + len(cols))
    best = min(sum(cost[i, j] for i, j in zip(r, c)) + limit / 2 * (n + m - 2 * k) for k in range(min(n, m) + 1) for r in itertools.combinations(range(n), k) for c in itertools.permutations(range(m), k))
    assert abs(value - best) < 1e-9
    assert sorted([i for i, _ in pairs] + rows) == list(range(n)) and sorted([j for _, j in pairs] + cols) == list(range(m))


def test_motion_equals_full_filter():
    rng = np.random.default_rng(3)
    z = np.array([[100.0, 50.0, 0.5, 80.0]])
    m = motion.Motion(z)
    mean = np.concatenate([z[0], np.zeros(4)])
    h = z[0, 3]
    cov = np.diag(np.array([h / 10, h / 10, 1e-2, h / 10, h / 16, h / 16, 1e-5, h / 16]) ** 2)
    f = np.eye(8) + np.diag(np.ones(4), 4)
    hm = np.eye(4, 8)
    for _ in range(5):
        h = mean[3]
        q = np.diag(np.array([h / 20, h / 20, 1e-2, h / 20, h / 160, h / 160, 1e-5, h / 160]) ** 2)
        mean, cov = f @ mean, f @ cov @ f.T + q
        m.predict(np.array([0]), np.array([True]))
        seen = z + rng.normal(size=4) * [3, 3, 0.01, 3]
        h = mean[3]
        r = np.diag(np.array([h / 20, h / 20, 1e-1, h / 20]) ** 2)
        k = cov @ hm.T @ np.linalg.inv(hm @ cov @ hm.T + r)
        mean, cov = mean + k @ (seen[0] - hm @ mean), cov - k @ hm @ cov
        m.correct(np.array([0]), seen)
        np.testing.assert_allclose(np.concatenate([m.pos[0], m.vel[0]]), mean, rtol=1e-9, atol=1e-9)


def clip(frames):
    t = Tracker(TrackerConfig())
    return [[(i, d) for i, d, *_ in t.update([b[:4] for b in f], [b[4] for b in f], [0] * len(f))] for f in frames]


def test_tracker_keeps_ids():
    a = [[(10 + 4 * i, 10, 40, 80, 0.9), (400 - 4 * i, 10, 40, 80, 0.9)] for i in range(10)]
    assert {tuple(x) for x in clip(a)} == {((1, 0), (2, 1))}
    gap = a[:4] + [[x[0]] for x in a[4:7]] + a[7:]  # one hidden, then back under its id
    assert clip(gap)[-1][0][0] == 1 and sorted(i for i, _ in clip(gap)[-1]) == [1, 2]
    low = [*a[:5], [(*a[5][0][:4], 0.2), a[5][1]]]  # a weak box still carries a tracked one
    assert sorted(i for i, _ in clip(low)[-1]) == [1, 2]


def test_tracker_births():
    a = [[(10, 10, 40, 80, 0.9)]] * 3 + [[(10, 10, 40, 80, 0.9), (300, 10, 40, 80, 0.9)]] * 2
    got = clip(a)
    assert [len(g) for g in got] == [1, 1, 1, 1, 2]  # a later birth must be seen again at once
    assert clip([[], [(1, 1, 9, 9, 0.05)], []]) == [[], [], []]


def test_nms_properties():
    rng = np.random.default_rng(1)
    b = decode.Boxes(np.concatenate([rng.integers(0, 200, (60, 2)), rng.integers(20, 80, (60, 2))], 1).astype(float), rng.random(60).round(1), rng.integers(0, 3, 60))
    k = decode.nms(b, 0.3)
    v = motion.iou_matrix(k.tlwh, k.tlwh)
    assert len(k.score) < 60 and (np.diff(k.score) <= 0).all() and v.shape[0] == len(k.score)


def test_decoders_find_the_planted_box():
    m = np.zeros((3, 9))
    m[0], m[1], m[2] = [320, 320, 100, 60, 0.9, 0, 0.8, 0, 0], [322, 321, 100, 60, 0.8, 0, 0.8, 0, 0], [100, 500, 50, 50, 0.1, 1, 0, 0, 0]
    for b in (decode.decode_v5([m], (1280, 720), (640, 640), 0.3, 0.5), decode.decode_v7([m], (1280, 720), (640, 640), {1: 0.3}, 0.5)):
        assert len(b.score) == 1 and b.klass[0] == 1 and abs(b.score[0] - 0.72) < 1e-9 and abs(b.tlwh[0] - [540, 300, 200, 120]).max() <= 3
    v8 = np.concatenate([m[:, :4], m[:, 4:5] * m[:, 5:]], 1).T
    for net in (False, True):
        b = decode.decode_v8(v8, (1280, 720), (640, 640), 0.3, 0.5, net)
        assert b.tlwh.tolist() == [[540, 300, 200, 120]]
    grids = [np.full((3, n, n, 9), -12.0) for n in (80, 40, 20)]
    grids[1][2, 20, 20] = [0, 0, 0, 0, 5, -9, 5, -9, -9]
    b = decode.decode_v5(grids, (640, 640), (640, 640), 0.5, 0.5)
    assert b.klass.tolist() == [1] and b.tlwh[0].tolist() == [298, 268, 59, 119]


def test_yolox_face_and_rotated():
    n = sum((64 // s) ** 2 for s in (8, 16, 32))
    out = np.zeros((n, 7))
    out[9] = [0.5, 0.5, np.log(2), np.log(3), 0.9, 0.1, 0.9]
    b = decode.decode_yolox(out, (64, 64), (64, 64), 0.3, 0.5)
    assert b.tlwh.tolist() == [[4, 0, 16, 24]] and b.klass.tolist() == [1]
    priors = sum((640 // s) ** 2 * 2 for s in (8, 16, 32))
    conf, loc, marks = np.zeros((priors, 2)), np.zeros((priors, 4)), np.zeros((priors, 10))
    conf[0, 1] = 0.9
    f = decode.decode_faces(loc, conf, marks, (640, 640), 0.5, 0.4)
    assert f.tlwh.round(6).tolist() == [[0, 0, 12, 12]] and f.extra["points"][0, 0].round(6).tolist() == [4, 4]
    rows = np.array([[100, 100, 40, 20, 0.9, 0.0, 0.1], [101, 100, 40, 20, 0.8, 0.0, 0.1], [300, 300, 10, 30, 0.7, 0.6, 0.2]]).T
    boxes, score, k = decode.decode_v8_obb(rows, (640, 640), (640, 640), 0.5, 0.5)
    assert score.tolist() == [0.9, 0.7, 0.6] and k.tolist() == [0, 0, 1] and boxes[1, 2] == 30
    assert abs(decode.prob_iou(boxes[0], boxes[0]) - 1) < 1e-3


def test_ctc_beam():
    p = np.array([[0.1, 0.9, 0.0], [0.2, 0.8, 0.0], [0.9, 0.1, 0.0], [0.1, 0.3, 0.6]])
    s, mean = ctc.beam_search(p, 3)
    assert s == [1, 2] and abs(mean - 0.75) < 1e-9
    assert ctc.beam_search(np.array([[1.0, 0, 0]]), 2) == ([], 0.0)
    assert len(ctc.PLATE) == 68


def test_text_boxes():
    p = np.zeros((120, 200))
    p[40:60, 30:150] = 0.9
    p[90:92, 10:12] = 0.9
    p[10:30, 160:190] = 0.4
    boxes = ocr.text_boxes(p, (400, 240))
    assert len(boxes) == 1 and boxes[0][0][0] < 60 and boxes[0][2][1] > 118
    assert len(ocr.components(np.array([[1, 0, 1], [0, 1, 0], [0, 0, 0], [1, 1, 0]]))) == 2


def test_openpose_person():
    h = w = 60
    maps = np.zeros((78, h, w))
    at = {1: (30, 10), 8: (30, 40), 2: (20, 12), 5: (40, 12)}
    yy, xx = np.mgrid[0:h, 0:w]
    for p, (x, y) in at.items():
        maps[p] = np.exp(-((xx - x) ** 2 + (yy - y) ** 2) / 4)
    for a, b, mx, my in pose.BODY_25["limbs"]:
        if a in at and b in at:
            d = np.array(at[b]) - at[a]
            d = d / np.linalg.norm(d)
            maps[mx], maps[my] = d
    people = pose.assemble(maps, scale=2.0)
    assert people.shape == (1, 25, 3) and np.allclose(people[0, 8, :2], [60, 80], atol=0.1) and people[0, 3, 2] == 0


def test_pose_suppression_merges():
    p = np.tile(np.random.default_rng(0).random((1, 17, 2)) * 100, (2, 1, 1))
    p[1] += 0.5
    got = pose.pose_nms(p, np.full((2, 17), 0.8), np.array([[0, 0, 100, 100], [0, 0, 100, 100]]))
    assert len(got) == 1 and np.allclose(got[0][0], p[0] + 0.25)
    maps = np.zeros((2, 8, 6))
    maps[0, 3, 2], maps[0, 3, 3] = 1.0, 0.5
    pts, s = pose.heatmap_points(maps, (0, 0, 60, 80))
    assert s.tolist() == [1, 0] and pts[0].tolist() == [22.5, 30.0]


def test_action_input():
    assert action.sample_clips(5, 8, 2).tolist() == [0, 1, 2, 3, 4, 0, 1, 2, 2, 3, 4, 0, 1, 2, 3, 4]
    for n in (60, 500):
        s = action.sample_clips(n).reshape(10, 48)
        assert s.min() >= 0 and s.max() < n and (action.sample_clips(n) == s.ravel()).all()
    v = action.action_input(np.random.default_rng(0).random((6, 1, 3, 2)) * 200, np.ones((6, 1, 3)), (640, 480))
    assert v.shape == (2, 10, 3, 48, 64, 64) and v.max() <= 1


def test_images():
    im = np.arange(4 * 6 * 3, dtype=np.uint8).reshape(4, 6, 3)
    assert image.stitch([im, im[:2]]).shape == (4, 12, 3) and image.stitch([im, im[:, :2]], True).shape == (8, 6, 3)
    assert image.resize(im, 6, 4).tolist() == im.tolist() and image.letterbox(im, 12, 12).shape == (12, 12, 3)
    assert image.blend_width(100, 100, 10, 29) == 192 and image.blend(np.ones((4, 60)), np.ones((4, 60)), 0, 9).shape == (4, 128)
    assert image.look_up(im, np.arange(255, -1, -1, dtype=np.uint8))[0, 0, 0] == 255
    g = np.stack(np.meshgrid(np.arange(6), np.arange(4)), -1)
    assert (image.remap(im, g) == im).all() and (image.remap(im, g, True) == im[::-1, ::-1]).all()
    m = image.fit_affine(np.array([[0, 0], [1, 0], [0, 1]]), np.array([[2, 3], [3, 3], [2, 4]]))
    np.testing.assert_allclose(m, [[1, 0, 2], [0, 1, 3]], atol=1e-9)
    assert image.disparity_bytes(np.array([[1.0, 2.0]])).tolist() == [[0, 255]] and image.crop(im, 1, 1, 2, 2).shape == (2, 2, 3)
    assert image.normalise(im, (0, 0, 0), (1, 1, 1), swap=True)[0, 0, 0] == 2
    assert image.warp_affine(im, np.array([[1, 0, 1], [0, 1, 0]]), 6, 4)[0, 1, 0] == 0


@pytest.mark.parametrize("thr", [0.3, {0: 0.3}])
def test_empty_tensors(thr):
    assert len(decode.decode_v5([np.zeros((0, 9))], (64, 64), (64, 64), thr, 0.5).score) == 0
    assert len(decode.decode_v8(np.zeros((6, 0)), (64, 64), (64, 64), thr, 0.5).score) == 0
